"""The cell index: equal to brute force, and reading few cells where vectors cluster."""

from functools import reduce
from math import sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators.cells import CellIndex
from brindle.operators.retrieval import dense_search

CHUNKS, QUERIES = "chunk_id string, document_id string, vec array<float>", "qid long, q_vec array<float>, own string"


def brute(vectors, queries, k):
    """(qid, chunk_id, score) of the k best: plain sums in order of the components, ties by id."""
    # Not by sum, which compensates for rounding.
    dot = lambda a, b: reduce(lambda s, xy: s + float(xy[0]) * float(xy[1]), zip(a, b, strict=True), 0.0)
    found = []
    for qid, q, own in queries:
        scored = sorted((-dot(q, v) / (sqrt(dot(q, q)) * sqrt(dot(v, v))), i) for i, v in vectors if i != own)
        found += [(qid, i, -s) for s, i in scored[:k]]
    return sorted(found)


def rows(df):
    return sorted((r.qid, r.chunk_id, r.score) for r in df.collect())


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies"])
def test_equals_brute_force(spark, kind):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(400, 8)).astype(np.float32)
    if kind == "clusters":
        x = (np.repeat(draw.normal(size=(20, 8)), 20, axis=0) * 5 + x * 0.1).astype(np.float32)
    if kind == "copies":
        x[100:240] = x[0]  # a third of all rows are one vector
    ids = [f"c{i:03d}" for i in range(400)]
    chunks = spark.createDataFrame([(i, "d", v.tolist()) for i, v in zip(ids, x, strict=True)], CHUNKS)
    asked = [(n, x[n].tolist(), ids[n]) for n in (0, 105, 239, 260, 399)] + [(1000, draw.normal(size=8).astype(np.float32).tolist(), None)]
    assert rows(dense_search(spark.createDataFrame(asked, QUERIES), chunks, 7)) == brute([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], asked, 7)


def test_small_blocks(spark, monkeypatch):
    """Cells split in pieces and queries in blocks change nothing."""
    from brindle.operators import cells

    for name, bytes_ in (("BLOCK_BYTES", 2048), ("LEAST_BLOCK", 1024), ("PRODUCT", 64), ("PAIRS", 16)):
        monkeypatch.setattr(cells, name, bytes_)
    x = np.random.default_rng(6).normal(size=(300, 4)).astype(np.float32)
    vectors = [(f"c{i:03d}", v.tolist()) for i, v in enumerate(x)]
    asked = [(i, v, c) for i, (c, v) in enumerate(vectors[::3])]
    chunks = spark.createDataFrame([(i, "d", v) for i, v in vectors], CHUNKS)
    assert rows(dense_search(spark.createDataFrame(asked, QUERIES), chunks, 5)) == brute(vectors, asked, 5)


def test_far_cells_are_not_read(spark):
    draw = np.random.default_rng(7)
    x = (np.repeat(np.eye(30) * 20, 30, axis=0) + draw.normal(size=(900, 30)) * 0.1).astype(np.float32)
    index = CellIndex.build(spark.createDataFrame([(f"c{i:03d}", "d", v.tolist()) for i, v in enumerate(x)], CHUNKS))
    asked = spark.createDataFrame([(1, x[5].tolist(), "c005")], QUERIES)
    near = index.routes(asked, 5)
    read = [c for r in near.collect() for c in r.cells]
    kth = index.search(asked, 5).agg(F.min("score")).first()[0]
    later = index.routes(asked.withColumn("kth", F.lit(kth)).withColumn("home", F.array(*map(F.lit, read)).cast("array<int>")), 5)
    read += [c for r in later.collect() for c in r.cells]
    assert len(index.sizes) == 30 and len(read) <= 3 and sum(index.sizes[read]) <= 90
    # Only those folders are listed for the scan.
    files = index._meet(near, 5)._jdf.queryExecution().toString()
    assert "PartitionFilters" in files and "cell#" in files


def test_vectors_without_cosine(spark):
    """Null, zero, non-finite, short and half-null vectors take no part; an empty index finds nothing."""
    odd = [("null", "d", None), ("zero", "d", [0.0, 0.0]), ("nan", "d", [float("nan"), 1.0]), ("inf", "d", [float("inf"), 1.0]), ("short", "d", [1.0]), ("half", "d", [None, 1.0])]
    good = [("a", "d", [1.0, 0.0]), ("b", "d", [0.0, 1.0]), ("c", "d", [2.0, 0.0])]
    asked = spark.createDataFrame([(i, v, None) for i, (_, _, v) in enumerate([*good, *odd])], QUERIES)
    found = dense_search(asked, spark.createDataFrame(good + odd, CHUNKS), 10).collect()
    assert sorted((r.qid, r["rank"], r.chunk_id) for r in found) == [(0, 1, "a"), (0, 2, "c"), (0, 3, "b"), (1, 1, "b"), (1, 2, "a"), (1, 3, "c"), (2, 1, "a"), (2, 2, "c"), (2, 3, "b")]
    assert dense_search(asked, spark.createDataFrame(odd[:4], CHUNKS), 3).count() == 0 and dense_search(asked.limit(0), spark.createDataFrame(good, CHUNKS), 3).count() == 0


def test_recall_curve(spark):
    """Each size searches its own documents and asks only what they hold; a size that answers no question has zeros."""
    from brindle.operators import evaluation as E

    chunks = [(f"{d}#{i}", d, [float(x), float(y), 1.0]) for d, i, x, y in [("a", 0, 9, 0), ("a", 1, 8, 0), ("b", 0, 0, 9), ("c", 0, 9, 1), ("d", 0, 0, 8)]]
    c = spark.createDataFrame(chunks, "chunk_id string, document_id string, vec array<double>")
    # The first question is nearest to c, but asks about a, which it names; the last one's document is nowhere.
    asked = [(1, [9.0, 1.0, 1.0], "a", "a"), (2, [0.0, 9.0, 1.0], "b", None), (3, [0.0, 8.0, 1.0], "b", None), (4, [1.0, 1.0, 1.0], "z", None)]
    q = spark.createDataFrame(asked, "qid long, q_vec array<double>, gold string, symbol string")
    got = {r["size"]: r for r in E.recall_curve(q, c, {"one": 1, "two": 2, "all": None}).collect()}
    figures = lambda r: (r.documents, r.chunks, r.questions, r.dense_recall_1, r.dense_recall_5, r.fused_recall_1)
    assert figures(got["one"]) == (1, 2, 1, 1.0, 1.0, 1.0)
    assert figures(got["two"]) == (2, 3, 3, 1.0, 1.0, 1.0)
    assert figures(got["all"]) == (4, 5, 3, round(1 / 3, 4), 1.0, round(2 / 3, 4))
    assert got["all"].stored_dims == 5 * 1024 and got["all"].cost == 0.0
    none = E.recall_curve(q.where("gold = 'z'"), c, {"one": 1}).first()
    assert figures(none) == (1, 2, 0, 0.0, 0.0, 0.0)
