"""Nearest neighbours by a block matrix join.

Vectors are scaled to unit length and quantised to int8. A query tile times a candidate tile gives
every cosine up to an error that the quantisation residuals bound; only pairs whose upper bound
reaches the k-th lower bound of their query are recomputed in double precision from the original
vectors. Each tile pair yields k rows a query at most, and heaps merge those.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import Written, attempt

#: Rows of a tile. 4,096 query rows by 8,192 candidates are worked off 256 query rows at a time.
QUERY_ROWS, CANDIDATE_ROWS, SLICE = 4096, 8192, 256
TILE = "tile long, dim int, n int, ids binary, vectors binary, codes binary, scales binary, errors binary, sizes binary"


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, ...]:
    """int8 codes of the unit vectors, their scales, the residuals' lengths, and the codes' lengths."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, np.sqrt(((unit - near) ** 2).sum(axis=1)), np.sqrt((near**2).sum(axis=1))


def tiles(vectors: DataFrame, id_column: str, vector_column: str, rows: int) -> DataFrame:
    """Vectors that take part, packed into tiles of one dimension each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, held = attempt()[0], 0, {}

        def tile(dim: int, parts: list) -> pa.RecordBatch:
            nonlocal seq
            ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            codes, scale, error, size = quantise(x)
            seq += 1
            cells = [(task << 32) + seq, dim, len(ids), *(v.tobytes() for v in (ids, x, codes, scale, error, size))]
            kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(cells, kinds, strict=True)], [c.split()[0] for c in TILE.split(", ")])

        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            keep = pc.and_(pc.is_valid(ids), pc.is_valid(lists))
            ids, lists = ids.filter(keep).to_numpy(zero_copy_only=False).astype(np.int64), lists.filter(keep)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes[sizes > 0]).tolist():
                of = np.flatnonzero(sizes == dim)
                x = flat[starts[of][:, None] + np.arange(dim)]
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                # A power of two times a vector has the same cosines; its squares neither vanish nor overflow.
                x = np.ldexp(x[good], -np.frexp(np.abs(x[good]).max(axis=1, initial=0.0))[1][:, None])
                held.setdefault(dim, []).append((ids[of[good]], x))
                while sum(len(p[0]) for p in held[dim]) >= rows:
                    all_ids, all_x = (np.concatenate([p[i] for p in held[dim]]) for i in (0, 1))
                    held[dim] = [(all_ids[rows:], all_x[rows:])]
                    yield tile(dim, [(all_ids[:rows], all_x[:rows])])
        for dim, parts in held.items():
            if sum(len(p[0]) for p in parts):
                yield tile(dim, parts)

    return vectors.select(id_column, vector_column).mapInArrow(run, TILE)


def _open(batch: pa.RecordBatch, row: int, side: str) -> tuple[np.ndarray, ...]:
    get = lambda name: batch.column(f"{side}_{name}")[row].as_py()
    dim = get("dim")
    return (
        np.frombuffer(get("ids"), np.int64),
        np.frombuffer(get("vectors")).reshape(-1, dim),
        np.frombuffer(get("codes"), np.int8).reshape(-1, dim),
        *(np.frombuffer(get(x)) for x in ("scales", "errors", "sizes")),
    )


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosines in double precision, summed in order of the components, so that equal vectors tie."""
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        x, y = a[:, j], b[:, j]
        dot += x * y
        aa += x * x
        bb += y * y
    return dot / np.sqrt(aa * bb)


def nearest_in_tiles(query: tuple, candidate: tuple, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The k nearest identifiers of a candidate tile for each row of a query tile: query ids, candidate ids, best cosines."""
    q_ids, q_x, q_codes, q_scale, q_error, q_size = query
    c_ids, c_x, c_codes, c_scale, c_error, c_size = candidate
    right = c_codes.T.astype(np.float32)
    # Rows that repeat an identifier are one neighbour: the first place of each in the order by identifier.
    by_id = np.argsort(c_ids, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(c_ids[by_id]) != 0)[: len(c_ids)])
    for at in range(0, len(q_ids), SLICE):
        rows = slice(at, at + SLICE)
        # Sums of products of int8 codes stay under 2**24 up to 1,040 components: exact in float32.
        kind = np.float32 if right.shape[0] <= 1040 else np.float64
        near = (q_codes[rows].astype(kind) @ right.astype(kind, copy=False)).astype(np.float64)
        near *= q_scale[rows, None]
        near *= c_scale[None, :]
        bound = q_size[rows, None] * c_error[None, :] + q_error[rows, None] * (c_size + c_error)[None, :] + 1e-9
        own = q_ids[rows, None] == c_ids[None, :]
        low = np.where(own, -np.inf, near - bound)
        if len(starts) < len(c_ids):
            low = np.maximum.reduceat(low[:, by_id], starts, axis=1)
        least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(low), -np.inf)
        i, j = np.nonzero((near + bound >= least[:, None]) & ~own)
        score = cosines(q_x[rows][i], c_x[j])
        if len(starts) < len(c_ids):
            order = np.lexsort((-score, c_ids[j], i))
            i, j, score = i[order], j[order], score[order]
            best = np.append(True, (i[1:] != i[:-1]) | (c_ids[j[1:]] != c_ids[j[:-1]]))[: len(i)]
            i, j, score = i[best], j[best], score[best]
        order = np.lexsort((c_ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, i, "left")
        top = np.arange(len(i)) - first < k
        yield q_ids[rows][i[top]], c_ids[j[top]], score[top]


def nearest(vectors: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k nearest rows by cosine of every query row, its own identifier left out.

    Rows with a null identifier, and vectors that are null, empty, zero or hold null or non-finite
    components, take no part; only vectors of one dimension are compared. Rows that repeat an identifier count as one
    neighbour, at its best cosine. Ties go to the smaller identifier. Every pair is bounded, so the
    result is exact. Result: query_id, rank, vec_id, score.
    """
    queries = vectors.where(is_query)
    n = queries.count()
    asked = Written(tiles(queries.select(id_column, vector_column).repartition(max(1, ceil(n / QUERY_ROWS))), id_column, vector_column, QUERY_ROWS), "queries").df
    there = Written(tiles(vectors, id_column, vector_column, CANDIDATE_ROWS), "candidates").df
    across, down = max(1, asked.count()), max(1, there.count())
    cell = lambda df, side, own, n_own, other, n_other: df.select(
        F.pmod(F.xxhash64("tile"), F.lit(n_own)).alias(own),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))).alias(other),
        *[F.col(c).alias(f"{side}_{c}") for c in df.columns],
    )
    left, right = cell(asked, "q", "row", across, "col", down), cell(there, "c", "col", down, "row", across)
    pairs = left.join(right.hint("shuffle_merge"), ["row", "col"]).where("q_dim = c_dim")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                for found in nearest_in_tiles(_open(batch, row, "q"), _open(batch, row, "c"), k):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for query, other, score in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                heap = heaps.setdefault(query, [])
                entry = (score, -other)
                same = next((x for x in heap if x[1] == -other), None)
                if same is not None:
                    if same < entry:
                        heap[heap.index(same)] = entry
                        heapq.heapify(heap)
                elif len(heap) < k:
                    heapq.heappush(heap, entry)
                elif heap[0] < entry:
                    heapq.heapreplace(heap, entry)
        rows = [(q, i + 1, -v, s) for q, heap in heaps.items() for i, (s, v) in enumerate(sorted(heap, reverse=True))]
        if rows:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["query_id", "rank", "vec_id", "score"])

    found = pairs.select(*[c for c in pairs.columns if c not in ("row", "col")]).mapInArrow(products, "query_id long, vec_id long, score double")
    return found.repartition("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
