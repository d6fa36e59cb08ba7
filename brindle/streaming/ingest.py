"""Streaming ingest: chunk files arrive in any order, and the index settles to one content.

Each row carries the version of the file that brought it, and a table beside the index keeps, for each document and each
total that a file declared, the last version that did. Both merge by maxima, so merging twice, in parts or in another
order gives the same: this is the stream's state, and unlike a query's own it survives a lost streaming checkpoint.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.sources.scratch import file_system, written
from brindle.sources.sinks import OVERHANG, last_rows

CHUNKS = "id string, document_id string, index int, total int, text string"
HELD, DECLARED = CHUNKS + ", version string", "document_id string, total int, version string"
BUCKETS = 64


def stream_chunks(spark: SparkSession, path: str, files: int | None = None, newest_first: bool = False) -> DataFrame:
    """Chunk records from a folder of JSON files, as they arrive, with the time and name of their file.

    files: how many files a micro-batch takes at most (None: all that are there).
    """
    arrived = F.struct("_metadata.file_modification_time", "_metadata.file_path").alias("_arrived")
    reader = spark.readStream.schema(CHUNKS).option("latestFirst", newest_first)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).json(path).select("*", arrived)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _version(arrived: Column) -> Column:
    """A file's version as a string in the order of time, then path."""
    return F.concat_ws(" ", F.lpad(F.unix_micros(arrived["file_modification_time"]).cast("string"), 20, "0"), arrived["file_path"])


def declarations(rows: DataFrame, order: str | None = None) -> DataFrame:
    """What each version says a document's total is: document_id, total, version.

    With an order column, the last row of a version declares it, else all its rows do. Rows without a document or a total declare nothing.
    """
    told = rows.where("document_id IS NOT NULL AND total IS NOT NULL")
    if order is None:
        return told.select(*_names(DECLARED)).distinct()
    last = F.max_by("total", F.struct(F.col(order), -F.col("total"))).alias("total")
    return told.groupBy("document_id", "version").agg(last).select(*_names(DECLARED))


def merged_declarations(*tables: DataFrame) -> DataFrame:
    """The last version of each document's each total: as many rows a document as totals it ever had."""
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole.groupBy("document_id", "total").agg(F.max("version").alias("version"))


def settle(rows: DataFrame, declared: DataFrame, overhang: int = OVERHANG) -> DataFrame:
    """Chunks that stand after all versions: of each id the row of the last version, unless its own or a later version declares an end before it.

    An end reaches over `overhang` places, as in sinks.stale_ids. Rows alike in id and version: the greatest by hash. A null id is an id;
    rows without a document or a place are never past an end. The result doesn't depend on the order in which rows or declarations came.
    """
    c, d = last_rows(rows, "id", "version").alias("c"), merged_declarations(declared).alias("d")
    past = (F.col("c.document_id") == F.col("d.document_id")) & (F.col("d.version") >= F.col("c.version"))
    past &= (F.col("c.index") >= F.col("d.total")) & (F.col("c.index") < F.col("d.total") + overhang)
    return c.join(d, past, "left_anti")


def _declared_path(index_path: str) -> str:
    return index_path.rstrip("/") + ".declared"


def _held(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table in folders by bucket and generation; one that isn't there is empty, one that can't be read is an error."""
    schema += ", bucket int, generation string"
    files, target = file_system(spark, path)
    return spark.read.schema(schema).parquet(path) if files.exists(target) else spark.createDataFrame([], schema)


def current(spark: SparkSession, index_path: str) -> DataFrame:
    """The index as it stands, also while a batch is half written: id, document_id, index, total, text, version."""
    rows, declared = _held(spark, index_path, HELD), _held(spark, _declared_path(index_path), DECLARED)
    return settle(rows.select(*_names(HELD)), declared.select(*_names(DECLARED)))


def _exchange(table: DataFrame, path: str, generation: str, buckets: list[int]) -> None:
    """Add a generation to buckets, then drop their earlier ones; a stop in between leaves both, which merge to the same."""
    spark = table.sparkSession
    table.withColumn("generation", F.lit(generation)).write.mode("append").partitionBy("bucket", "generation").parquet(path)
    files, _ = file_system(spark, path)
    for b in buckets:
        _, folder = file_system(spark, f"{path}/bucket={b}")
        for old in files.listStatus(folder) if files.exists(folder) else []:
            if old.isDirectory() and old.getPath().getName() != f"generation={generation}":
                files.delete(old.getPath(), True)


def replacing(index_path: str):
    """A foreachBatch function that settles a batch's documents in the index.

    Batches may be replayed, split and reordered: whatever order files are met in, the last version of a file (time, then path) wins, an older one
    that comes late replaces nothing, and ends that a shorter version declared hold against all older chunks. Of rows of one id in a file the last wins.
    Batches without `_arrived` take their number as the version.
    Only buckets (by a hash of the document) that the batch touches are written, as a new generation beside the old one, which goes when the new one is whole.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version = _version(F.col("_arrived")) if "_arrived" in batch.columns else F.lit(f"{number:020d}")
        bucket = F.pmod(F.xxhash64("document_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
        placed = batch.select(*_names(CHUNKS), version.alias("version"), bucket, F.monotonically_increasing_id().alias("_place"))
        once = written(placed, "batch")
        buckets = [r["bucket"] for r in once.select("bucket").distinct().collect()]  # BUCKETS at most
        if not buckets:
            return
        touched = F.col("bucket").isin(buckets)
        new_rows = last_rows(once.withColumn("_order", F.struct("version", "_place")), "id", "_order").select(*_names(HELD))
        told = _held(spark, _declared_path(index_path), DECLARED).where(touched).select(*_names(DECLARED))
        ends = written(merged_declarations(told, declarations(once, "_place")).withColumn("bucket", bucket), "declared")
        old_rows = _held(spark, index_path, HELD).where(touched).select(*_names(HELD))
        whole = written(settle(old_rows.unionByName(new_rows), ends.drop("bucket")).withColumn("bucket", bucket), "merged")
        generation = uuid.uuid4().hex
        # The ends go first: chunks that they dropped can't come back from a batch that stops here.
        _exchange(ends, _declared_path(index_path), generation, buckets)
        _exchange(whole, index_path, generation, buckets)

    return run


def ingest_stream(spark: SparkSession, source: str, index_path: str, checkpoint: str, files: int | None = None, newest_first: bool = False) -> StreamingQuery:
    """Ingest what is there now, in micro-batches, and stop."""
    writer = stream_chunks(spark, source, files, newest_first).writeStream.foreachBatch(replacing(index_path))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
