"""Sources: JSON records, line lists, identifiers in free text, documents as files, index statistics and sizes."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import text as T

FIGURES = "array<struct<value:double,unit:string,conditions:string>>"
CATALOGUE = f"part string, channel string, vds double, rdson {FIGURES}, id {FIGURES}, package array<string>"
MIN_CHARS = 500


def json_records(spark: SparkSession, path: str, schema: str = CATALOGUE) -> DataFrame:
    """A JSON array of records, with a declared schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def line_list(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that aren't empty."""
    return spark.read.text(path).select(T.trim(F.col("value")).alias("id")).where("id <> ''")


def identifiers(spark: SparkSession, path: str) -> DataFrame:
    """Distinct part numbers in free text, sorted."""
    found = spark.read.text(path).select(F.explode(T.part_numbers(F.col("value"), any_case=False)).alias("part"))
    return found.distinct().orderBy("part")


def document_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as documents: part (file stem), text; those under the least length are left out."""
    read = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]+)?$", 1).alias("part"), F.col("value").alias("text"))
    return readable(read)


def extracted(files: DataFrame, extract: Callable[[bytes], str], out: str = "text") -> DataFrame:
    """Texts of binary files (path, content) by an injected extractor, a file at a time: path, part (file stem), the text, error.

    A file the extractor can't read has a null text and the reason. Two readings (with and without layout) are two calls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    text, error = extract(row["content"]), None
                except Exception as e:  # the reason is the result
                    text, error = None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([{"path": row["path"], out: text, "error": error}], pa.schema([("path", pa.string()), (out, pa.string()), ("error", pa.string())]))

    read = files.select("path", "content").mapInArrow(run, f"path string, {out} string, error string")
    return read.withColumn("part", F.regexp_extract("path", r"([^/]+?)(\.[^./]+)?$", 1))


def judged(documents: DataFrame) -> DataFrame:
    """Documents with status: ok, or why they are rejected (no text, too short)."""
    n = F.length(T.trim(F.col("text")))
    return documents.withColumn("status", F.when(F.col("text").isNull(), "no text").when(n < MIN_CHARS, "too short").otherwise("ok"))


def plain_reading(text: Column) -> Column:
    """The text without its layout: every run of white space is one blank."""
    return T.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fetched(ids: DataFrame, get: Callable[[str], tuple[int, str, bytes | None]], delay: float = 0.25) -> DataFrame:
    """Documents by an injected download (id -> http status, content type, body): id, cached, http_status, content_type, content.

    ids: id and cached; a cached document isn't downloaded again. Each task waits between its downloads, so the number of partitions bounds the load.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("id", pa.string()), ("cached", pa.bool_()), ("http_status", pa.int32()), ("content_type", pa.string()), ("content", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                status, kind, body = (None, None, None) if row["cached"] else get(row["id"])
                if not row["cached"]:
                    time.sleep(delay)
                yield pa.RecordBatch.from_pylist([{**row, "http_status": status, "content_type": kind, "content": body}], kinds)

    return ids.select("id", "cached").mapInArrow(run, "id string, cached boolean, http_status int, content_type string, content binary")


def with_metadata(matches: DataFrame, *fields: str) -> DataFrame:
    """Search results whose metadata is there."""
    return matches.dropna(subset=list(fields))


def demo_questions(spark: SparkSession) -> DataFrame:
    """Five questions that show each route; the last one's part is held out: id, question, route, split."""
    rows = [
        (1, "Which N-channel part rated 40 V has the lowest on-resistance at Tj = 25 °C; VGS = 10 V?", "set", "indexed"),
        (2, "How many parts come in the LFPAK56 package?", "set", "indexed"),
        (3, "What is the drain current of PSMN1R0-30YLD?", "document", "indexed"),
        (4, "What is the on-state resistance of BUK764R0-40E at VGS = 10 V?", "document", "indexed"),
        (5, "What is the package of PSMNR90-80CSF?", "document", "holdout"),
    ]
    return spark.createDataFrame(rows, "id int, question string, route string, split string")


def readable(documents: DataFrame) -> DataFrame:
    """Documents with enough text."""
    return documents.where(F.length(T.trim(F.col("text"))) >= MIN_CHARS)


def fetch_status(fetches: DataFrame) -> DataFrame:
    """Fetches by status (http_status, content_type, cached): ok, missing or failed."""
    status = F.when(F.col("cached"), "ok").when(F.col("http_status") == 404, "missing").when((F.col("http_status") == 200) & F.col("content_type").contains("pdf"), "ok").otherwise("failed")
    return fetches.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def index_stats(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Number of vectors and their dimension."""
    return vectors.agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size(vector)).cast("long").alias("dims"))


def index_sizes(chunks: DataFrame, sizes: dict[str, int | None]) -> DataFrame:
    """Documents and chunks of the first n documents by id, for each named size (None: all)."""
    per = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    largest = max((n for n in sizes.values() if n is not None), default=0)
    # Only the largest bounded size needs an order.
    top = per.orderBy("document_id").limit(largest).withColumn("i", F.row_number().over(Window.orderBy("document_id")))
    out = None
    for name, n in sizes.items():
        part = per if n is None else top.where(F.col("i") <= n)
        row = part.agg(F.lit(name).alias("size"), F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))
        out = row if out is None else out.unionByName(row)
    return out
