"""Exact cosine search over a written index of cells.

Vectors belong to the cell of their nearest centroid and stand in a folder a cell. Angles between vectors are
a metric, so a query at angle a from a centroid is no nearer to any vector of the cell than a less the cell's greatest
angle, or its least angle less a. A search reads the cells around each query until they hold k candidates,
and then only cells that this bound can't exclude; other folders aren't read. Centroids are fitted on a bounded
sample. They decide how much is read, never what is found.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from brindle.sources.scratch import scratch_path, written

#: Bytes of all centroids (as doubles), which every task holds, and of the sample that they are fitted on; cells are 4,096 at most.
CENTROID_BYTES, SAMPLE_BYTES, MAX_CELLS, SAMPLE_A_CELL, ROUNDS = 16 << 20, 64 << 20, 4096, 32, 5
#: Bytes of vectors (as doubles) on either side of one task's products, and entries of one product.
BLOCK_BYTES, LEAST_BLOCK, PRODUCT = 16 << 20, 256 << 10, 1 << 19
#: Radians and cosine that rounding may move a bound by; an exact score decides whatever is within them.
SLACK, MARGIN = 1e-5, 1e-9
#: Pairs that are scored exactly at once, bytes of their vectors (as doubles) and of a batch of routes, and routes that one task writes.
PAIRS, BATCH_BYTES, TASK_ROUTES = 1 << 14, 4 << 20, 200_000


def _dot(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def has_cosine(vec: str) -> Column:
    """The vector has no null, finite components only, and a squared norm that is neither zero nor infinite."""
    clean = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    norm = _dot(F.col(vec))
    return F.coalesce(F.col(vec).isNotNull() & clean & F.when(clean, (norm > 0) & (norm < float("inf"))), F.lit(False))


def usable(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector has a cosine."""
    return df.where(has_cosine(vec))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    flat = pc.list_flatten(column)
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise scalar products, added in order of the components, so that equal vectors tie wherever they are scored."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _fit(sample: np.ndarray, n: int) -> np.ndarray:
    """Unit centroids of unit rows by a few rounds of spherical k-means; empty ones stay as they are."""
    centroids = np.unique(sample, axis=0)
    centroids = centroids[np.linspace(0, len(centroids) - 1, min(n, len(centroids))).astype(int)]
    for _ in range(ROUNDS):
        near = np.concatenate([(part @ centroids.T).argmax(axis=1) for part in np.array_split(sample, len(sample) * len(centroids) // PRODUCT + 1)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        length = np.sqrt((sums * sums).sum(axis=1))
        centroids[length > 1e-9] = sums[length > 1e-9] / length[length > 1e-9, None]
    return centroids


def _angles(units: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centroids.T, -1.0, 1.0))


def _slices(rows: int, width: int) -> Iterator[slice]:
    step = max(1, PRODUCT // max(1, width))
    return (slice(i, min(i + step, rows)) for i in range(0, rows, step))


def _first_copies(x: np.ndarray, cell: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that k + 1 equal vectors of their cell precede. Vectors whose sums agree by chance may stay."""
    total = _in_order(x, np.broadcast_to(np.sqrt(np.arange(2.0, x.shape[1] + 2)), x.shape))
    order = np.lexsort((total, cell))
    a, b = order[1:], order[:-1]
    same = (total[a] == total[b]) & (cell[a] == cell[b])
    near = np.flatnonzero(same)
    for i in range(0, len(near), PAIRS):
        some = near[i : i + PAIRS]
        same[some] = (x[a[some]] == x[b[some]]).all(axis=1)
    starts = np.flatnonzero(np.r_[True, ~same])
    nth = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
    return np.sort(order[nth <= k])


def best_pairs(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k best vectors (chunk_id, document_id, vec and, if queries name cells, cell) of each query (qid, q_vec and maybe cells, own and kth), ties by
    chunk_id: qid, chunk_id, document_id, score. What is below kth is left out.

    All vectors have one length. Only the vectors are held as doubles; queries pass by slices, so a task's memory rests on the vectors' bytes.
    """
    right = right.take(pc.sort_indices(right["chunk_id"], null_placement="at_start")) if right.num_rows else right
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if left.num_rows and right.num_rows:
        dims = pc.list_value_length(right["vec"])[0].as_py()
        x = matrix(right["vec"], dims)
        cell = right["cell"].to_numpy() if "cell" in right.column_names else np.zeros(len(x), np.int64)
        right = right.select(["chunk_id", "document_id"])
        if pc.count_distinct(right["chunk_id"], mode="all").as_py() == len(x):
            # Of equal vectors of a cell the first k and one, for the query's own, are all that can be among the k best.
            stay = _first_copies(x, cell, k)
            right, x, cell = right.take(pa.array(stay)), x[stay], cell[stay]
        ids = pc.dictionary_encode(right["chunk_id"].combine_chunks(), null_encoding="encode")
        opens = np.searchsorted(ids.indices.to_numpy(), np.arange(len(ids.dictionary) + 1))
        cells, of_cell = np.unique(cell, return_inverse=True)
        x_norm = np.sqrt(_in_order(x, x))
        x_units = x / x_norm[:, None]
        step = max(1, min(PAIRS, BATCH_BYTES // (8 * dims)))
        for part in _slices(left.num_rows, len(x)):
            some = left.slice(part.start, part.stop - part.start)
            q = matrix(some["q_vec"], dims)
            q_norm = np.sqrt(_in_order(q, q))
            near = (q / q_norm[:, None]) @ x_units.T
            if "cells" in some.column_names:
                named = pc.list_flatten(some["cells"]).to_numpy()
                asking = np.repeat(np.arange(len(q)), pc.list_value_length(some["cells"]).to_numpy())
                place = np.minimum(np.searchsorted(cells, named), len(cells) - 1)
                held = np.zeros((len(q), len(cells)), bool)
                held[asking, place] |= cells[place] == named
                if not held.all():
                    near[~held[:, of_cell]] = -np.inf
            if "own" in some.column_names:
                at = pc.fill_null(pc.index_in(some["own"], value_set=ids.dictionary), -1).to_numpy()
                for i in np.flatnonzero(at >= 0):
                    near[i, opens[at[i]] : opens[at[i] + 1]] = -np.inf
            # What is below the kth found before can't be among the k best.
            least = some["kth"].to_numpy() if "kth" in some.column_names else np.full(len(q), -np.inf)
            floor = least.copy()
            many = np.count_nonzero(near >= least[:, None] - MARGIN, axis=1) > 4 * k
            if many.any():
                floor[many] = np.maximum(floor[many], np.partition(near[many], -k, axis=1)[:, -k])
            row, j = np.nonzero((near >= floor[:, None] - MARGIN) & (near > -np.inf))
            dots = [_in_order(q[row[i : i + step]], x[j[i : i + step]]) for i in range(0, len(row), step)]
            score = np.concatenate(dots) / (q_norm[row] * x_norm[j]) if dots else np.zeros(0)
            best = np.lexsort((j, -score, row))
            best = best[score[best] >= least[row[best]]]
            row, j, score = row[best], j[best], score[best]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
            keep = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) < k
            found.append((row[keep] + part.start, j[keep], score[keep]))
    row, j, score = (np.concatenate(c) for c in zip(*found, strict=True))
    of_vector = right.take(pa.array(j, pa.int64()))
    return pa.table({"qid": left["qid"].take(pa.array(row, pa.int64())), "chunk_id": of_vector["chunk_id"], "document_id": of_vector["document_id"], "score": pa.array(score, pa.float64())})


@dataclass(frozen=True)
class CellIndex:
    """Vectors of chunks (chunk_id, document_id, vec) in folders by cell, and of each cell its centroid, size and angles.

    Vectors that are null, zero, of null or non-finite components, or of another length than the commonest (the longer of two as common) take no part.
    """

    spark: SparkSession
    path: str
    schema: StructType
    dims: int
    centroids: np.ndarray
    sizes: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def build(cls, chunks: DataFrame, path: str | None = None) -> CellIndex:
        """Write the index to a folder (a fresh one in the shared folder unless told)."""
        spark = chunks.sparkSession
        path = path or scratch_path(spark, "cells")
        able = usable(chunks.select("chunk_id", "document_id", "vec"), "vec")
        lengths = able.groupBy(F.size("vec").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
        empty = np.zeros(0)
        if lengths is None:
            return cls(spark, path, able.schema, 0, np.zeros((0, 0)), empty, empty, empty)
        dims, n = lengths["dims"], lengths["n"]
        able = able.where(F.size("vec") == dims)
        cells = max(1, min(isqrt(n), MAX_CELLS, CENTROID_BYTES // (8 * dims)))
        rows = max(1, min(cells * SAMPLE_A_CELL, SAMPLE_BYTES // (8 * dims)))
        drawn = able.orderBy(F.xxhash64("chunk_id", "vec")).select("vec").limit(rows).toArrow()
        centroids = _fit(_units(matrix(drawn["vec"], dims)), cells)
        shared = spark.sparkContext.broadcast(centroids)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                units = _units(matrix(batch.column("vec"), dims)) if batch.num_rows else np.zeros((0, dims))
                cell, angle = np.zeros(len(units), np.int32), np.zeros(len(units))
                for part in _slices(len(units), len(shared.value)):
                    found = _angles(units[part], shared.value)
                    cell[part] = found.argmin(axis=1)
                    angle[part] = found.min(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angle), pa.array(cell)], [*batch.schema.names, "angle", "cell"])

        schema = StructType([*able.schema.fields, StructField("angle", DoubleType()), StructField("cell", IntegerType())])
        # By range, so that a cell with a large part of all rows is written by several tasks.
        placed = able.mapInArrow(assign, schema).repartitionByRange("cell", "chunk_id", F.xxhash64("vec"))
        placed.write.partitionBy("cell").parquet(path)
        stats = spark.read.schema(schema).parquet(path).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()
        sizes, low, high = np.zeros(len(centroids), np.int64), np.zeros(len(centroids)), np.zeros(len(centroids))
        for r in stats:
            sizes[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
        return cls(spark, path, schema, dims, centroids, sizes, low, high)

    def _tiles(self) -> tuple[np.ndarray, np.ndarray]:
        """Each cell's tile (small cells share one), and into how many pieces a tile's rows are dealt."""
        size = self.sizes * self.dims * 8
        bound = min(BLOCK_BYTES, max(LEAST_BLOCK, int(size.sum()) // 64))
        tile, held, last = np.zeros(len(size), np.int64), [0], 0
        for cell, s in enumerate(size):
            if held[last] and held[last] + s > bound:
                held.append(0)
                last += 1
            tile[cell] = last
            held[last] += int(s)
        return tile, np.array([-(-h // bound) or 1 for h in held])

    def routes(self, queries: DataFrame, k: int) -> DataFrame:
        """Queries with the tiles and cells they read: a row a query and tile, with the cells in it.

        Without a column kth these are the nearest cells that hold k candidates besides the query's own; with
        it, the cells that may hold a cosine of kth or more, but for those in the column home, which goes.
        """
        tile, _ = self._tiles()
        later = "kth" in queries.columns
        kept = [c for c in queries.columns if c != "home"]
        shared = self.spark.sparkContext.broadcast((self.centroids, self.sizes, self.low, self.high, tile))
        dims = self.dims

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, sizes, low, high, tile = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                units = _units(matrix(batch.column("q_vec"), dims))
                for part in _slices(len(units), len(centroids)):
                    angle = _angles(units[part], centroids)
                    order = np.argsort(np.where(sizes > 0, angle, np.inf), axis=1, kind="stable")
                    before = np.cumsum(sizes[order], axis=1) - sizes[order]
                    wanted = np.zeros(angle.shape, bool)
                    np.put_along_axis(wanted, order, before < k + 1, axis=1)
                    if later:
                        reach = np.arccos(np.clip(batch.column("kth").to_numpy(zero_copy_only=False)[part], -1.0, 1.0)) + SLACK
                        wanted = np.maximum(angle - high, low - angle) <= reach[:, None]
                        for i, cells in enumerate(batch.column("home").slice(part.start, len(angle)).to_pylist()):
                            wanted[i, cells] = False
                    row, cell = np.nonzero(wanted & (sizes > 0))
                    opens = np.ones(len(row), bool)
                    opens[1:] = (row[1:] != row[:-1]) | (tile[cell[1:]] != tile[cell[:-1]])
                    starts = np.flatnonzero(opens)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pa.array(cell, pa.int32()))
                    # A query's vector stands once a tile.
                    step = max(1, BATCH_BYTES // (8 * dims))
                    for i in range(0, len(starts), step):
                        some = starts[i : i + step]
                        taken = batch.select(kept).take(pa.array(row[some] + part.start))
                        yield pa.RecordBatch.from_arrays([*taken.columns, lists.slice(i, len(some)), pa.array(tile[cell[some]], pa.int32())], [*kept, "cells", "tile"])

        schema = StructType([*[queries.schema[c] for c in kept], StructField("cells", ArrayType(IntegerType())), StructField("tile", IntegerType())])
        return queries.mapInArrow(route, schema)

    def _meet(self, routed: DataFrame, k: int) -> DataFrame:
        """The k best of each query in every block of vectors it meets: qid, chunk_id, document_id, score."""
        # Cells are 4,096 at most; the folders of others aren't listed for reading. A route is counted with its first cell.
        heads = routed.select(F.posexplode("cells").alias("pos", "cell")).groupBy("cell").agg(F.count_if(F.col("pos") == 0).alias("n")).collect()
        cells = sorted(r["cell"] for r in heads)
        tile, pieces = self._tiles()
        asked_of = np.zeros(len(pieces), np.int64)
        if heads:
            np.add.at(asked_of, tile[[r["cell"] for r in heads]], [r["n"] for r in heads])
        blocks = max(1, -(-int(asked_of.max()) * self.dims * 8 // BLOCK_BYTES))
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        places = self.spark.createDataFrame([(c, int(tile[c]), int(pieces[tile[c]])) for c in cells], "cell int, tile int, pieces int")
        read = self.spark.read.schema(self.schema).parquet(self.path).where(F.col("cell").isin(cells))
        vectors = read.join(F.broadcast(places), "cell").withColumn("piece", F.pmod(F.xxhash64("chunk_id", "vec"), "pieces").cast("int"))
        vectors = vectors.withColumn("block", every(F.lit(blocks))).select("tile", "piece", "block", "cell", "chunk_id", "document_id", "vec")
        counts = self.spark.createDataFrame([(t, int(pieces[t])) for t in sorted({int(tile[c]) for c in cells})], "tile int, pieces int")
        asked = routed.join(F.broadcast(counts), "tile").withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
        asked = asked.withColumn("piece", every(F.col("pieces"))).drop("pieces")

        def products(left: pa.Table, right: pa.Table) -> pa.Table:
            return best_pairs(left, right, k)

        known = {f.name: f for f in self.schema.fields}
        schema = StructType([routed.schema["qid"], known["chunk_id"], known["document_id"], StructField("score", DoubleType())])
        keys = ["tile", "piece", "block"]
        return asked.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(products, schema)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best of each query (qid, q_vec and, if a query is a chunk itself, its id as own), by exact cosine: qid, chunk_id, document_id, score, rank.

        A qid and a chunk_id stand once. Ties go by chunk_id. Queries without a qid, or whose vector has no cosine with the index's, have no rows.
        """
        from brindle.operators.retrieval import top_k

        columns = [c for c in ("qid", "own") if c in queries.columns]
        asked = usable(queries.select(*columns, "q_vec"), "q_vec").where((F.size("q_vec") == self.dims) & F.col("qid").isNotNull())
        if not self.dims:
            none = asked.select("qid", *[F.lit(None).cast(self.schema[c].dataType).alias(c) for c in ("chunk_id", "document_id")], F.lit(0.0).alias("score")).where(F.lit(False))
            return top_k(none, k, "chunk_id")
        near = written(self.routes(asked, k), "routes")
        first = written(self._meet(near, k), "first")
        home = near.groupBy("qid").agg(F.flatten(F.collect_list("cells")).alias("home"))
        # The kth of what the nearest cells gave; too few (a repeated own id) bound nothing.
        kth = top_k(first, k, "chunk_id").groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(-2.0).alias("kth"))
        bounded = asked.join(home, "qid").join(kth, "qid", "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0)))
        # Few bytes become many routes, so Spark would leave them to one task.
        tasks = -(-near.count() * len(self._tiles()[1]) // TASK_ROUTES) or 1
        rest = self._meet(written(self.routes(bounded.repartition(tasks, "qid"), k), "routes"), k)
        # Written, as callers read it more than once.
        return written(top_k(first.unionByName(rest), k, "chunk_id"), "found")
