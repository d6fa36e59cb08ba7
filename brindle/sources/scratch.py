"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system and path object of a path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the cluster or the session, or one of our own in local mode where that is unset (tests).

    Elsewhere an unset folder is an error: a machine's own folder would lose what other executors wrote.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        return _OWN_FOLDERS.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="brindle-"))
    if "://" not in base:
        # A plain path belongs to the cluster's default file system, as everywhere in Spark.
        files, path = file_system(spark, base)
        base = files.makeQualified(path).toString()
        base = "file://" + base.removeprefix("file:") if base.startswith("file:/") and "://" not in base else base
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/brindle/{label}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            files, target = file_system(spark, path)
            files.delete(target, True)
        except Exception:  # the session has gone; the folder's owner cleans up
            pass

    atexit.register(clean)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """The table as written to the shared folder: one evaluation, whatever reads it, and no lineage behind it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
