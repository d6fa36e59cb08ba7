"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2 bits have a value within 1 bit of both. So each distinct
fingerprint emits itself and its 64 one-bit variants, and equal variants meet after a shuffle. Rows of a variant
are distinct fingerprints, at most 65, however many documents share them; they all lie within 2 bits
of one another, so links from the first of them to the others keep every connection. With a radius of one
bit, a variant that is itself a fingerprint is linked with the others of its bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from brindle.llm.common import Written
from brindle.llm.components import connected_components

SEED = 42
#: Shingles whose bits are counted at once.
SLICE = 200_000


def fingerprint(text: str | None, words_per_shingle: int) -> int:
    """SimHash of a whole text as a signed 64-bit integer; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = words_per_shingle
    counts, total = np.zeros(64, np.int64), max(1, len(words) - n + 1)
    for start in range(0, total, SLICE):
        part = words[start : start + SLICE + n - 1]
        shingles = zip(*(part[i:] for i in range(n)), strict=False) if len(words) >= n else [words]
        h = np.array([xxh64_intdigest(b" ".join(x), SEED) for x in shingles], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, words_per_shingle: int) -> DataFrame:
    """doc_id and fp (signed 64-bit) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), words_per_shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def ball_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within 2 bits (1 with radius 1).

    distinct: one column fp without repeats.
    """
    flips = [0, *(1 << i if i < 63 else -(1 << 63) for i in range(64))]
    masks = F.array(*[F.lit(x).cast("long") for x in flips])
    variants = distinct.select("fp", F.explode(masks).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp")

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, 0
        for batch in batches:
            variant, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(variant):
                continue
            opens = np.concatenate([[variant[0] != last if last is not None else True], variant[1:] != variant[:-1]])
            at = np.maximum.accumulate(np.where(opens, np.arange(len(fp)), -1))
            heads = np.where(at >= 0, fp[at], first)
            last, first = int(variant[-1]), int(heads[-1])
            linked = ~opens
            a, b = heads[linked], fp[linked]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
            if radius == 1:
                near &= a == variant[linked]
            yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near])], ["a", "b"])

    # The variant's own fingerprint, if it is one, comes first.
    dealt = variants.repartition("variant").sortWithinPartitions("variant", F.col("fp") != F.col("variant"), "fp")
    return dealt.mapInArrow(collide, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, words_per_shingle: int = 5, radius: int = 2) -> DataFrame:
    """Fingerprint and component of every document.

    Takes doc_id and text; other columns don't matter. Null and empty texts have fingerprint zero and are
    linked like any other; repeated rows are in one component; a component's id is its smallest doc_id
    that isn't null. radius: 1 or 2 bits. Result: doc_id, fp, component_id.
    """
    if radius not in (1, 2):
        raise ValueError("ball hashing by one-bit variants finds links of 1 or 2 bits")
    prints = Written(fingerprints(documents, words_per_shingle), "fingerprints").df
    distinct = Written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes").df
    labels = connected_components(ball_links(distinct.select("fp"), radius))
    linked = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    linked = Written(linked, "labels").df
    least = linked.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_print = linked.join(least, "label").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")
