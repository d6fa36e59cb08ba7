"""Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

One 64-bit SimHash can't tell such pairs from others: their prints differ by 0 to 14 bits. So texts meet in
bands of minimal shingle hashes, and every pair that meets is verified on its whole sets of shingles. A pair of
similarity 0.8 meets with a probability of 1 - (1 - 0.8**4)**24 = 0.999997, a closer one more surely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from brindle.llm.common import Written, sieved, spread_join, spread_semi_join
from brindle.llm.components import connected_components
from brindle.llm.simhash import SEED, SLICE, ball_links, fingerprint

WORDS = 5
#: Bands of so many minimal hashes each.
BANDS, ROWS = 24, 4
#: Share of equal bytes of signatures from which sets are compared: at similarity 0.8 a pair falls below it once in a million.
LIKELY = 0.6
#: Texts that stay in open buckets get one bit of each of so many minimal hashes more. Bits of sets of similarity s agree with a
#: probability of (1 + s) / 2; of two at 0.8, more than so many differ once in a million (4.9 standard deviations).
BITS = 2048
FAR_BITS = int(0.1 * BITS + 4.9 * (0.09 * BITS) ** 0.5)
#: A bucket's first text meets all others, then so many times more of the next ones do, and so on; all pairs left are compared once they
#: are so many for each text and band at most.
PAIRS_A_MEMBER, WIDEN = 10, 8
_BIT_MULTIPLIERS = np.random.default_rng(SEED + 1).integers(0, 2**63, BITS, np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of a text's five-word shingles, ascending; a shorter text is one shingle, none without words."""
    words = (text or "").encode().lower().split()
    if len(words) < WORDS:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    every = np.fromiter((xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(WORDS)), strict=False)), np.uint64)
    return np.unique(every)


def minima(shingles: np.ndarray, multipliers: np.ndarray = _MULTIPLIERS) -> np.ndarray:
    """Least value of a set under each of the hash functions."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, SLICE // len(multipliers))
    for at in range(0, len(shingles), step):
        part = shingles[at : at + step]
        least = np.minimum(least, ((part ^ (part >> np.uint64(29)))[None, :] * multipliers[:, None]).min(axis=1))
    return least


def minimum_bits(shingles: np.ndarray) -> np.ndarray:
    """One bit of each of BITS minimal hashes, packed into signed 64-bit numbers."""
    return np.packbits((minima(shingles, _BIT_MULTIPLIERS) >> np.uint64(40)).astype(np.uint8) & 1).view(np.int64)


def bands(shingles: np.ndarray, least: np.ndarray | None = None) -> list[int]:
    """One signed hash a band of the set's minimal hashes; none for the empty set."""
    if not len(shingles):
        return []
    least = minima(shingles) if least is None else least
    found = [xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return [x - (1 << 64) if x >> 63 else x for x in found]


def signature(least: np.ndarray) -> bytes:
    """One byte of each minimal hash: sets of Jaccard similarity s agree in a share of s of them, give or take chance."""
    return (least >> np.uint64(40)).astype(np.uint8).tobytes()


def similar(a: Column, b: Column) -> Column:
    """Whether sets have a Jaccard similarity of 0.8 or more, in whole numbers."""
    return 9 * F.size(F.array_intersect(a, b)) >= 4 * (F.size(a) + F.size(b))


def sketches(rows: DataFrame) -> DataFrame:
    """fp, n_shingles, bands and signature of every row beside its other columns; rows: text and columns that stay."""
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "fp long", "n_shingles int", "bands array<long>", "signature binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes, found, signatures = [], [], [], []
            for x in batch.column("text"):
                text = x.as_py()
                shingles = shingle_set(text)
                prints.append(fingerprint(text, WORDS))
                sizes.append(len(shingles))
                least = minima(shingles)
                found.append(bands(shingles, least))
                signatures.append(signature(least))
            columns = [*(batch.column(f.name) for f in kept), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64())), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), "fp", "n_shingles", "bands", "signature"])

    return rows.select("text", *[f"`{f.name}`" for f in kept]).mapInArrow(run, schema)


def _sets(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shingles = shingle_set(batch.column(1)[i].as_py())
                numbers = [pa.array([x], pa.list_(pa.int64())) for x in (shingles.view(np.int64), minimum_bits(shingles))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *numbers], ["key", "shingles", "bits"])

    return texts.select("key", "text").mapInArrow(run, "key long, shingles array<long>, bits array<long>")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (fp, label) after links between labels (a, b) merge some of them."""
    merged = connected_components(links).select(F.col("node").alias("label"), F.col("label").alias("_least"))
    return Written(labels.join(merged, "label", "left").select("fp", F.coalesce("_least", "label").alias("label")), "near-labels").df


def _open_buckets(labelled: DataFrame, compared: int) -> tuple[DataFrame, int, int]:
    """Labelled members of the buckets that still hold uncompared texts of different labels; the largest bucket's size; their pairs of different labels."""
    alike = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = alike.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("same"))
    sizes = Written(sizes.where((F.col("kinds") > 1) & (F.col("n") > compared + 1)).select("bucket", "n", ((F.col("n").cast("double") * F.col("n") - F.col("same")) / 2).alias("pairs")), "bucket-sizes").df
    total, largest, pairs = sizes.agg(F.sum("n"), F.max("n"), F.sum("pairs")).first()
    kept = spread_semi_join(sieved(labelled, "bucket", sizes.select("bucket")), sizes, ["bucket"], "n", total or 0)
    return Written(kept, "buckets").df, largest or 0, int(pairs or 0)


def _pairs(members: DataFrame, bits: DataFrame | None, compared: int, width: int) -> DataFrame:
    """Pairs of a bucket's next texts with the later ones, where labels differ and sizes allow the similarity.

    The order in a bucket: those with the least share of shingles of their own come first. Two texts have no more shingles
    in common than either shares with any text; those whose bits differ too much aren't similar. Hot buckets are salted.
    """
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("alone", "key"))
    heads = members.withColumn("_rank", rank).where(F.col("_rank") <= compared + width).where(F.col("_rank") > compared)
    heads = heads.select("bucket", *[F.col(c).alias(f"a_{c}") for c in ("key", "n_shingles", "n_shared", "alone", "label")])
    near, total = F.lit(True), members.count()
    if bits is not None:
        # Bits join the texts only here, so that they travel once a round.
        members, heads = members.join(bits, "key"), heads.join(bits.select(F.col("key").alias("a_key"), F.col("bits").alias("a_bits")), "a_key")
        apart = [F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("a_bits", F.lit(i)))) for i in range(BITS // 64)]
        near = sum(apart[1:], apart[0]) <= FAR_BITS
    met = spread_join(members, heads, ["bucket"], total)
    later = (F.col("alone") > F.col("a_alone")) | ((F.col("alone") == F.col("a_alone")) & (F.col("key") > F.col("a_key")))
    able = 9 * F.least("n_shared", "a_n_shared") >= 4 * (F.col("n_shingles") + F.col("a_n_shingles"))
    return met.where(later & (F.col("label") != F.col("a_label")) & able & near).select("a_key", "a_label", F.col("key").alias("b_key"), F.col("label").alias("b_label")).distinct()


def _likely(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in LIKELY or more of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (4, 5))
                yield batch.select([0, 1, 2, 3]).filter(pa.array((a == b).mean(axis=1) >= LIKELY))

    side = lambda x: signatures.select(F.col("key").alias(f"{x}_key"), F.col("signature").alias(f"{x}_signature"))
    n = pairs.count()
    both = spread_join(spread_join(pairs, side("a"), ["a_key"], n), side("b"), ["b_key"], n)
    return both.select("a_key", "a_label", "b_key", "b_label", "a_signature", "b_signature").mapInArrow(run, "a_key long, a_label long, b_key long, b_label long")


def _shared(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members with n_shared, the shingles that another text of open buckets has too, and alone, the share of the rest."""
    there = sieved(sets, "key", members.select("key")).join(members.select("key").distinct(), "key", "left_semi").select("key", F.explode("shingles").alias("shingle"))
    own = there.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).where("n = 1").groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("_own"))
    n = F.coalesce("_own", F.lit(0))
    known = members.drop("n_shared", "alone").join(own, "key", "left")
    return known.withColumns({"n_shared": F.col("n_shingles") - n, "alone": n / F.col("n_shingles")}).select(*members.columns)


def groups(sketched: DataFrame, texts: DataFrame, radius: int = 2) -> DataFrame:
    """Label of every fingerprint: the least one that links reach, by SimHash within the radius or by Jaccard similarity.

    sketched: key (hash of the text), fp, n_shingles, bands, signature; texts: key and text. Rows may repeat. Texts that meet
    in a band are a bucket. First each bucket's first text is compared with all others, then the text with the fewest shingles of its
    own, which is the likeliest origin of near copies; so a group of them makes as many pairs as it has texts. Only buckets that
    still hold different labels stay open. Some more first texts are compared, then all pairs of different labels at once where they
    are few for each member, else more first texts again. Texts with too many shingles of their own, or too different minimal
    hashes, make no pairs. So every pair that meets is linked if it is similar. Result: fp, label.
    """
    distinct = Written(sketched.select("key", "fp", "n_shingles", "bands", "signature").distinct(), "distinct-texts").df
    prints = distinct.select("fp").distinct()
    found = connected_components(ball_links(prints, radius)).select(F.col("node").alias("fp"), F.col("label").alias("_least"))
    labels = Written(prints.join(found, "fp", "left").select("fp", F.coalesce("_least", "fp").alias("label")), "near-labels").df
    # Labels join the texts before they are dealt out to their bands.
    members = distinct.join(labels, "fp").select(F.explode("bands").alias("bucket"), "key", "fp", "n_shingles", F.col("n_shingles").alias("n_shared"), F.lit(0.0).alias("alone"), "label")
    n_members, rounds, compared, width, sets = distinct.count() * BANDS, 0, 0, 1, None
    while True:
        members, largest, remaining = _open_buckets(members, compared)
        if not largest:
            return labels
        if sets is None:
            sets = Written(_sets(sieved(texts, "key", members.select("key")).join(members.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])), "shingle-sets").df
        elif rounds == 1:
            members = Written(_shared(members, sets), "buckets").df
        elif rounds > 2 and remaining <= PAIRS_A_MEMBER * n_members:
            width = largest
        else:
            width *= WIDEN
        pairs = Written(_pairs(members, sets.select("key", "bits") if rounds else None, compared, width), "pairs")
        likely = Written(_likely(pairs.df, distinct.select("key", "signature")), "likely-pairs") if not rounds else pairs
        n = likely.df.count()
        if n:
            side = lambda x: sieved(sets, "key", likely.df.select(f"{x}_key")).select(F.col("key").alias(f"{x}_key"), F.col("shingles").alias(f"{x}_shingles"))  # noqa: E731, B023
            whole = spread_join(spread_join(likely.df, side("a"), ["a_key"], n), side("b"), ["b_key"], n).where(similar(F.col("a_shingles"), F.col("b_shingles")))
            labels = _relabelled(labels, whole.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct())
            members = members.drop("label").join(labels, "fp")
        pairs.drop()
        if likely is not pairs:
            likely.drop()
        # The second round has an order of its own, so its count of compared texts begins there.
        rounds, compared = rounds + 1, compared + width if rounds else 0
