"""Sinks: replacing documents in a chunk index, pruning stale chunks, size guard, JSON results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERHANG, MAX_METADATA = 80, 10_240


def last_rows(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by an order column; of rows alike in that, the greatest."""
    whole = F.struct(*[F.col(c) for c in batch.columns])
    return batch.groupBy(key).agg(F.max_by(whole, F.struct(F.col(order), F.xxhash64(F.to_json(whole)))).alias("_last")).select("_last.*")


def upsert(index: DataFrame, batch: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Rows of the batch replace rows of the same key; with an order column, the batch's last row of a key wins."""
    batch = batch if order is None else last_rows(batch, key, order)
    return index.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch.select(*index.columns))


def replace_documents(index: DataFrame, batch: DataFrame) -> DataFrame:
    """Documents of the batch replace all their chunks; others stay."""
    return index.join(batch.select("document_id").distinct(), "document_id", "left_anti").unionByName(batch)


def stale_ids(batch: DataFrame, overhang: int = OVERHANG, order: str = "index") -> DataFrame:
    """Ids past each document's declared end that an earlier, longer version may have left; its last chunk declares the end."""
    ends = batch.groupBy("document_id").agg(F.max_by("total", F.struct(F.col(order), -F.col("total"))).alias("total"))
    return ends.select("document_id", F.explode(F.sequence("total", F.col("total") + overhang - 1)).alias("index")).select("document_id", F.concat_ws("#", "document_id", "index").alias("id"))


def prune(index: DataFrame, batch: DataFrame, order: str = "index") -> DataFrame:
    """The index without stale ids of the batch's documents; nothing to delete is no error."""
    return index.join(stale_ids(batch, order=order).select("id"), "id", "left_anti")


def metadata_bytes(*columns: str) -> Column:
    """UTF-8 bytes of a row's metadata as JSON."""
    return F.octet_length(F.to_json(F.struct(*columns)))


def guarded(chunks: DataFrame, *columns: str, limit: int = MAX_METADATA) -> DataFrame:
    """Chunks whose metadata fits; a larger one fails the job."""
    too_large = F.concat(F.lit("metadata too large for "), F.col("id"))
    return chunks.where(F.when(metadata_bytes(*columns) <= limit, True).otherwise(F.raise_error(too_large).cast("boolean")))


def write_json(df: DataFrame, path: str) -> None:
    """Results as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, *by: str) -> None:
    """Results as Parquet, in folders by some columns."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def report(df: DataFrame, *order: str) -> DataFrame:
    """A few summary rows as one JSON array of records, in order (report)."""
    rows = df.select(F.struct(*[F.col(c) for c in [*order, *[c for c in df.columns if c not in order]]]).alias("r"))
    return rows.agg(F.to_json(F.array_sort(F.collect_list("r"))).alias("report"))


def write_report(df: DataFrame, path: str, *order: str) -> None:
    """Summary rows as one text file with a JSON array."""
    report(df, *order).coalesce(1).write.mode("overwrite").text(path)
