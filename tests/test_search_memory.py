"""Exact search: a task's memory rests on its vectors, not on how many queries and routes meet them, and readers of a result share one search."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brindle.operators import cells
from brindle.operators.cells import CellIndex
from brindle.operators.retrieval import dense_search

CHUNKS, QUERIES = "chunk_id string, document_id string, vec array<float>", "qid long, q_vec array<float>, own string"


def test_products_take_no_memory_a_query(monkeypatch):
    monkeypatch.setattr(cells, "PRODUCT", 1 << 16)
    draw = np.random.default_rng(8)
    lists = lambda n: pa.array(draw.normal(size=(n, 32)).astype(np.float32).tolist(), pa.list_(pa.float32()))
    right = pa.table({"chunk_id": [f"c{i:03}" for i in range(200)], "document_id": ["d"] * 200, "vec": lists(200), "cell": pa.array([i % 4 for i in range(200)], pa.int32())})

    def peak(n):
        left = pa.table({"qid": range(n), "q_vec": lists(n), "cells": pa.array([[0, 1, 2, 3]] * n, pa.list_(pa.int32())), "kth": [0.9] * n})
        tracemalloc.start()
        cells.best_pairs(left, right, 5)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    few = peak(500)
    assert peak(8000) < 1.5 * few


def test_routes_come_in_small_batches(spark, monkeypatch):
    """Each query reads every tile, and its vector stands once a tile: batches hold BATCH_BYTES of them."""
    monkeypatch.setattr(cells, "LEAST_BLOCK", 256)
    monkeypatch.setattr(cells, "BATCH_BYTES", 1024)
    x = np.random.default_rng(9).normal(size=(300, 4)).astype(np.float32)
    index = CellIndex.build(spark.createDataFrame([(f"c{i:03}", "d", v.tolist()) for i, v in enumerate(x)], CHUNKS))
    asked = spark.createDataFrame([(i, x[i].tolist(), None) for i in range(40)], QUERIES).withColumns({"kth": F.lit(-1.0), "home": F.array().cast("array<int>")})
    stub = SimpleNamespace(columns=asked.columns, schema=asked.schema, mapInArrow=lambda route, schema: route)
    sizes = [b.num_rows for b in index.routes(stub, 5)(iter(asked.toArrow().to_batches()))]
    assert max(sizes) == 1024 // 32 and sum(sizes) == 40 * len(index._tiles()[1]) > 400
    assert "home" not in index.routes(asked, 5).columns


def test_a_result_is_searched_once(spark):
    chunks = spark.createDataFrame([(f"c{i}", "d", [float(i), 1.0]) for i in range(20)], CHUNKS)
    found = dense_search(spark.createDataFrame([(1, [1.0, 1.0], None)], QUERIES), chunks, 3)
    assert "CoGroup" not in found._jdf.queryExecution().toString() and found.count() == 3
