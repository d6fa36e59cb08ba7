"""Vector codes by partial-distance search: four codebooks of 256 entries over integer vectors.

Components become integers; each of four rounds assigns every part of every vector to its codebook's nearest entry and replaces the
entries by their parts' floored means. The search looks at a part's positions in the order of falling variance over the codebook:
a mask drops an entry once its distance so far strictly exceeds the best whole distance known, so that ties stay and the lower
index wins. A round is one pass over the table whose tasks send one row an entry; only codebooks (256 vectors) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import Written, broadcast_if_small, shield, spread_join

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Positions whose distances are added before entries are dropped again.
STEP = 4
#: Part-vectors that are searched at once, and integers that a batch holds at most.
SEARCHED, BATCH_VALUES = 2048, 1 << 21
LARGEST_LONG = (1 << 63) - 1
#: Digits that hold the sum of any number of rows of any finite double.
BASE, WIDE_DIGITS = 10**18, 19


def bounds(dims: int) -> list[int]:
    """Where the parts of a vector begin and end; equal parts wherever they can be."""
    return [dims * p // PARTS for p in range(PARTS + 1)]


def integers(values: np.ndarray, wide: bool) -> np.ndarray:
    """floor(SCALE * x) of finite numbers; as Python's integers where 64 bits could overflow."""
    if not wide:
        return np.floor(values * float(SCALE)).astype(np.int64)
    exact = np.empty(values.size, object)
    exact[:] = [int(np.floor(x * SCALE)) if abs(x) < 2.0**52 else int(x) * SCALE for x in values.ravel().tolist()]
    return exact.reshape(values.shape)


def nearest(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each vector's nearest entry (squared Euclidean distance, ties to the lower index), and that distance."""
    index, best = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), vectors.dtype)
    variance = book.astype(np.float64).var(axis=0)
    order = np.argsort(-variance, kind="stable")
    entries = np.ascontiguousarray(book[:, order])
    for at in range(0, len(vectors), SEARCHED):
        index[at : at + SEARCHED], best[at : at + SEARCHED] = _search(vectors[at : at + SEARCHED][:, order], entries)
    return index, best


def _search(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """nearest for a few vectors; positions are in the order of the search."""
    width = vectors.shape[1]
    sums = np.zeros((len(vectors), len(entries)), vectors.dtype)
    for d in range(min(STEP, width)):
        sums += (vectors[:, d, None] - entries[None, :, d]) ** 2
    # The entry that leads after the first positions gives the first whole distance.
    lead = sums.argmin(axis=1)
    best = ((vectors - entries[lead]) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= best[:, None])
    total = sums[row, entry]
    for d in range(STEP, width, STEP):
        total = total + ((vectors[row, d : d + STEP] - entries[entry, d : d + STEP]) ** 2).sum(axis=1)
        stays = total <= best[row]
        row, entry, total = row[stays], entry[stays], total[stays]
    # What is left is whole: entries stand in order within a vector, so the first of the least is the lowest.
    order = np.lexsort((entry, total, row)) if vectors.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], total[i], entry[i])), np.int64)
    first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
    return entry[first], total[first]


def _batches(batches: Iterator[pa.RecordBatch], column: int, dims: int, wide: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the rows with their vectors as integers."""
    rows = max(1, BATCH_VALUES // max(dims, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, integers(part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims), wide)


def refine(vectors: DataFrame, books: list[np.ndarray], dims: int, wide: bool) -> list[np.ndarray]:
    """One round: every part to its nearest entry, entries to the floored mean of their parts; unused entries stay."""
    cuts, width = bounds(dims), max(np.diff(bounds(dims)))
    # Python's integers travel as digits of base 10**18, the highest one with the sign.
    digits = WIDE_DIGITS if wide else 1
    sums = [f"s{d}_{i}" for d in range(width) for i in range(digits)]
    kind = "decimal(38,0)" if wide else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((PARTS, ENTRIES, width), object if wide else np.int64), np.zeros((PARTS, ENTRIES), np.int64)
        for _, values in _batches(batches, 0, dims, wide):
            for p in range(PARTS):
                own = values[:, cuts[p] : cuts[p + 1]]
                index, _ = nearest(own, books[p])
                np.add.at(total[p, :, : own.shape[1]], index, own)
                count[p] += np.bincount(index, minlength=ENTRIES)
        part, entry = np.nonzero(count)
        columns = [total[part, entry, d] for d in range(width)]
        if wide:
            columns = [x // BASE**i % BASE if i + 1 < digits else x // BASE**i for x in columns for i in range(digits)]
        values = [pa.array(x.tolist(), pa.decimal128(38, 0) if wide else pa.int64()) for x in columns]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(entry, pa.int64()), pa.array(count[part, entry], pa.int64()), *values], ["part", "entry", "n", *sums])

    partial = vectors.mapInArrow(run, ", ".join(["part long, entry long, n long", *(f"{s} {kind}" for s in sums)]))
    summed = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums])
    out = [book.copy() for book in books]
    for row in summed.collect():  # PARTS * ENTRIES rows at most
        book = out[row["part"]]
        whole = [sum(int(row[f"s{d}_{i}"]) * BASE**i for i in range(digits)) for d in range(book.shape[1])]
        book[row["entry"]] = [x // row["n"] for x in whole]
    return out


def encode(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of vectors, and the codebooks: key, label, code, error (long). Other columns are left out.

    Vectors that are null or hold null or non-finite components go; so do those of another length than the commonest (ties: the longer). Vectors whose
    length isn't a multiple of 4 are cut as evenly as they can be. Codebooks start from the least keys (null ones last; rows of one key go by
    their components); fewer than 256 rows make fewer entries. Repeated rows are encoded each; an empty table has no codes and empty codebooks.
    Components over some 10^8 are computed with Python's integers, slower; an error beyond a long is null.
    """
    spark = vectors.sparkSession
    x = F.col(f"`{vector}`")
    usable = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = vectors.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{label}`").alias("_label"), x.cast("array<double>").alias("_vector")).where(usable)
    largest = F.max(F.coalesce(F.array_max(F.transform("_vector", F.abs)), F.lit(0.0))).alias("largest")
    lengths = kept.groupBy(F.size("_vector").alias("dims")).agg(F.count(F.lit(1)).alias("n"), largest)
    shape = lengths.orderBy(F.desc("n"), F.desc("dims")).first()
    schema = "_key " + kept.schema["_key"].dataType.simpleString() + ", _label " + kept.schema["_label"].dataType.simpleString() + ", code string, error long"
    if shape is None:
        return spark.createDataFrame([], schema).select(F.col("_key").alias(key), F.col("_label").alias(label), "code", "error"), []
    dims, reach = shape["dims"], int(shape["largest"] * SCALE) + 1
    # Distances, and sums of up to 2^34 components, fit into 64 bits.
    wide = max(dims, 1) * (2 * reach) ** 2 > LARGEST_LONG or reach > 1 << 29
    kept = kept.where(F.size("_vector") == dims)
    first = kept.orderBy(F.asc_nulls_last("_key"), "_vector").limit(ENTRIES).collect()
    start = integers(np.array([r["_vector"] for r in first], np.float64).reshape(len(first), dims), wide)
    cuts = bounds(dims)
    books = [start[:, cuts[p] : cuts[p + 1]].copy() for p in range(PARTS)]
    for _ in range(ROUNDS):
        books = refine(kept.select("_vector"), books, dims, wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in _batches(batches, 2, dims, wide):
            found = [nearest(values[:, cuts[p] : cuts[p + 1]], books[p]) for p in range(PARTS)]
            codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            errors = sum(best for _, best in found)
            errors = pa.array([int(e) if e <= LARGEST_LONG else None for e in errors] if wide else errors, pa.int64())
            n = 2 * PARTS
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([codes[i : i + n] for i in range(0, len(codes), n)], pa.string()), errors], ["_key", "_label", "code", "error"])

    return kept.mapInArrow(run, schema).select(F.col("_key").alias(key), F.col("_label").alias(label), "code", "error"), books


def digest(books: list[np.ndarray]) -> str:
    """Lowercase SHA-256 of all entries' components in decimal, by part, entry, position."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book.tolist() for x in entry).encode()).hexdigest()


def code_report(vectors: DataFrame) -> DataFrame:
    """Codes and errors of vectors (vec_id, embedding, label), the errors of each label together, and the codebooks' digest."""
    shielded, _ = shield(vectors.select("vec_id", "embedding", "label"), ("vec_id", "embedding", "label"), ())
    found, books = encode(shielded)
    found = Written(found, "codes").df
    # A label of null is a label of its own; a label that holds many rows is dealt over many tasks.
    group = [F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_label"), F.col("label").isNull().alias("_null")]
    by_label = Written(found.groupBy(*group).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"), F.count(F.lit(1)).alias("_rows")), "label-errors").df
    labels, rows = by_label.agg(F.count(F.lit(1)), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    keyed, sums = found.select("*", *group), by_label.drop("_rows")
    hinted = broadcast_if_small(sums, labels)
    joined = keyed.join(hinted, ["_label", "_null"]) if hinted is not sums else spread_join(keyed, sums, ["_label", "_null"], rows)
    fits = F.when(F.col("_sum") <= LARGEST_LONG, F.col("_sum").cast("long"))
    return joined.select("vec_id", "code", "error", fits.alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))


ORACLE = """
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS i, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
    SELECT i, p, list_slice(v, p * (len(v) // 4) + 1, (p + 1) * (len(v) // 4)) AS x FROM kept, range(4) t(p)),
book0 AS MATERIALIZED (SELECT p, i - 1 AS e, x FROM parts WHERE i <= 256),
{rounds},
ends AS MATERIALIZED ({final}),
coded AS (
    SELECT i, string_agg(printf('%02x', (best).e), '' ORDER BY p) AS code, CAST(sum((best).d) AS BIGINT) AS error FROM ends GROUP BY i),
digest AS (
    SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (i), digest"""
_ASSIGN = """SELECT i, p, min({{'d': list_sum(list_transform(list_zip(parts.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS best
    FROM parts JOIN book{k} b USING (p) GROUP BY i, p"""
_ROUND = """near{n} AS MATERIALIZED ({assign}),
means{n} AS (
    SELECT p, e, list(m ORDER BY j) AS x FROM (
        SELECT p, (best).e AS e, j, CAST(floor(sum(c) / count(*)) AS BIGINT) AS m
        FROM (SELECT p, best, unnest(x) AS c, generate_subscripts(x, 1) AS j FROM parts JOIN near{n} USING (i, p)) GROUP BY ALL) GROUP BY p, e),
book{n} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN means{n} m USING (p, e))"""
ORACLE = ORACLE.format(
    rounds=",\n".join(_ROUND.format(n=n, k=n - 1, assign=_ASSIGN.format(k=n - 1)) for n in range(1, ROUNDS + 1)), final=_ASSIGN.format(k=ROUNDS), last=ROUNDS
)
