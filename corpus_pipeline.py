"""The corpus pipeline: five of the training-data operators, one after the other.

Each stage is written to the shared folder as Parquet and read again as the next one's documents, so
a lost executor costs a stage's tasks at most. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import line_dedup, mixing, packing, quality, similar
from brindle.llm.common import Written, marked


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    # Columns of the input that bear a result's name travel under another.
    own = {c: c if c in ("text", "lang") else f"_column_{i}" for i, c in enumerate(docs.columns)}
    judged = quality.quality(docs.select(*[F.col(f"`{c}`").alias(name) for c, name in own.items()]))
    return judged.where("kept").select(*[F.col(name).alias(c) for c, name in own.items()])


def line_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without boilerplate lines; n_chars follows the text."""
    own = {c: c if c in ("doc_id", "text", "source", "n_chars") else f"_column_{i}" for i, c in enumerate(docs.columns)}
    cut = line_dedup.line_dedup(docs.select(*[F.col(f"`{c}`").alias(name) for c, name in own.items()]))
    length = F.when(F.col("n_removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return cut.withColumn("n_chars", length).select(*[F.col(name).alias(c) for c, name in own.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates (five-word shingles): the smallest doc_id, then the least text hash.

    Linked are prints within 2 bits and texts of Jaccard similarity 0.8 or more. Identifiers may be null or
    repeated: a row goes only where another of its component stays.
    """
    # The hash of a row tells which columns are null, so that rows of one hash are equal.
    row = F.xxhash64(*[x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])
    key = F.xxhash64("text").alias("key")
    sketched = Written(similar.sketches(docs.select("text", key, row.alias("row"), F.col("doc_id").cast("long").alias("id"))), "sketches").df
    labels = similar.groups(sketched, docs.select(key, "text"))
    # Copies share a print: they come down to a row of it before they meet its label.
    of_print = sketched.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "row")).alias("best"))
    best = of_print.join(labels, "fp").groupBy("label").agg(F.min("best").alias("best"))
    chosen = Written(best.select(F.col("best.key").alias("key"), F.col("best.row").alias("row")), "chosen").df
    # Rows that surely stay, and stand once, don't travel: only those marked as doubtful meet the chosen ones.
    counted = sketched.groupBy("key", "row").agg(F.count(F.lit(1)).alias("n")).join(chosen.withColumn("stays", F.lit(True)), ["key", "row"], "left")
    doubtful = Written(counted.where((F.col("n") > 1) | F.col("stays").isNull()).select("row"), "doubtful").df
    own = {c: f"_column_{i}" for i, c in enumerate(docs.columns)}
    keyed = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in own.items()], key, row.alias("row"))
    judged = marked(keyed, "row", doubtful, "doubt")
    settled = judged.where("doubt").join(chosen, ["key", "row"], "left_semi").dropDuplicates(["key", "row"])
    columns = [F.col(name).alias(c) for c, name in own.items()]
    return judged.where("not doubt").select(*columns).unionAll(settled.select(*columns))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mixture's number of passes."""
    own = {c: c if c in ("doc_id", "text", "source") else f"_column_{i}" for i, c in enumerate(docs.columns)}
    mixed = mixing.mix(docs.select(*[F.col(f"`{c}`").alias(name) for c, name in own.items()]))
    return mixed.select(*[F.col(name).alias(c) for c, name in own.items()])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in the packed sequences."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_rules),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources", source_mixture),
    ("best-fit packing", packed),
]

#: The stages use XXH64, a tokenizer and iteration, which DuckDB's SQL can't express; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = Written(stage(spark, docs, sf_dir), name.replace(" ", "-")).df
    return STAGES[-1][1](spark, docs, sf_dir)
