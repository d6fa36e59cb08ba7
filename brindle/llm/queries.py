"""Registered queries of the training-data operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import conversation_repair, line_dedup, mixing, neighbours, packing, quality, secret_scan, simhash, sstable, suffix_dedup, token_counts, url_filter, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many went as boilerplate, and a digest of the rest."""
    found = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the token shards, as read back from their files."""
    return sstable.token_shards(_table(spark, sf_dir, "documents")).drop("shard")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest rows of every embedding whose vec_id is divisible by 50."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pass over every document in the mixture, one and a half times the corpus in all."""
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), corpora=1.5).drop("text")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint over three-word shingles and component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words_per_shingle=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece's place in the packed sequences."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the removal of repeated 200-byte strings leaves of every document."""
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return quality.quality(_table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("chars_distance", "words_distance")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document."""
    return secret_scan.secret_report(_table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by its prefixes' counts, and the code points that fit the limit."""
    counted = token_counts.count_prefixes(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return counted.select("doc_id", n_bytes, "n_tokens", (F.col("n_tokens") > token_counts.LIMIT).alias("over_limit"), "fits")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every embedding, after four rounds of refinement."""
    return vector_codes.code_report(_table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired digest of every damaged conversation."""
    return conversation_repair.repair_report(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_shards": op2_token_shards,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_source_mixing": op4_source_mixing,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_url_filter": op9_url_filter,
    "op10_secret_scan": op10_secret_scan,
    "op11_token_counts": op11_token_counts,
    "op12_vector_codes": op12_vector_codes,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op8_quality_rules": quality.ORACLE,
    "op9_url_filter": url_filter.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op3_nearest_neighbours": """
        SELECT q.vec_id AS query_id,
               CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY
                   list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) AS INTEGER) AS rank,
               c.vec_id AS vec_id,
               list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score
        FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id
        WHERE q.vec_id % 50 = 0
        QUALIFY rank <= 5""",
}
