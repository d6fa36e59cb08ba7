"""Vector codes against whole-distance search in plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, _key int, `a.b` int"


def brute(rows):
    """Codes of (id, vector, label) rows whose vectors are all usable."""
    rows = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows]
    if not rows:
        return {}, ""
    dims = len(rows[0][1])
    cuts = [dims * p // 4 for p in range(5)]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    books = [[r[1][a:b] for r in first] for a, b in zip(cuts, cuts[1:])]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            members = {}
            for _, v, _ in rows:
                x = v[cuts[p] : cuts[p + 1]]
                members.setdefault(near(x, books[p])[1], []).append(x)
            for e, xs in members.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out, by_label = [], {}
    for i, v, label in rows:
        found = [near(v[cuts[p] : cuts[p + 1]], books[p]) for p in range(4)]
        error = sum(d for d, _ in found)
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, label))
        by_label[label] = by_label.get(label, 0) + error
    long = lambda x: x if x < 1 << 63 else None
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, code, long(error), long(by_label[label])) for i, code, error, label in out), key=repr), sha


def run(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], schema).repartition(3)
    got = V.code_report(df).collect()
    assert len({r.codebooks_sha256 for r in got}) <= 1
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr), got[0].codebooks_sha256 if got else ""


def vector(rng, dims=8, scale=1.0):
    return [float(np.float32(rng.choice([rng.gauss(0, scale), 0.0, -0.25, round(rng.gauss(0, 3)) / 4]))) for _ in range(dims)]


def test_edges(spark):
    """Nulls, other lengths, ties and repeated rows; the labels of null and of other values."""
    rng = random.Random(3)
    good = [(rng.choice([None, *range(400)]), vector(rng), rng.choice([None, 1, 2])) for _ in range(330)]
    good += [good[5], good[5], (None, good[7][1], None)]
    bad = [(1, None, 1), (2, [None] * 8, 1), (3, [1.0] * 7 + [math.nan], 2), (4, [math.inf] * 8, 1), (5, [], 2), (6, [1.0] * 4, 1), (None, [-math.inf] * 8, None)]
    assert run(spark, good + bad) == brute(good)


def test_few_rows_and_odd_lengths(spark):
    rng = random.Random(4)
    for dims, n in ((8, 1), (6, 20), (3, 9), (1, 300)):
        rows = [(i, vector(rng, dims), i % 3) for i in range(n)]
        assert run(spark, rows) == brute(rows)
    assert run(spark, []) == ([], "") and run(spark, [(1, None, 1)]) == ([], "")
    assert run(spark, [(2, [], 1), (1, [], 1)])[0] == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]


def test_values_beyond_64_bits(spark):
    rng = random.Random(5)
    rows = [(i, [x * rng.choice([1.0, 1e6, 1e9]) for x in vector(rng)], i % 2) for i in range(30)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert run(spark, rows) == brute(rows)
    rows = [(i, [x * 1e300 for x in vector(rng, 4)], None) for i in range(12)]
    assert run(spark, rows, SCHEMA.replace("float", "double")) == brute(rows)


def test_dropped_entries_change_nothing():
    """The masked search finds what whole distances find, ties included."""
    rng = np.random.default_rng(1)
    for width in (1, 4, 6, 16):
        book, vectors = rng.integers(-3, 4, (256, width)), rng.integers(-4, 5, (3000, width))
        whole = ((vectors[:, None] - book[None]) ** 2).sum(axis=2)
        index, best = V.nearest(vectors, book)
        assert (index == whole.argmin(axis=1)).all() and (best == whole.min(axis=1)).all()


@pytest.mark.parametrize("limit", [0, 100_000])
def test_hot_label(spark, monkeypatch, limit):
    """A label with most rows, with and without a broadcast."""
    monkeypatch.setattr("brindle.llm.common.HOT_FLOOR", 10)
    monkeypatch.setattr(V, "broadcast_if_small", lambda df, n: F.broadcast(df) if n <= limit else df)
    rng = random.Random(6)
    rows = [(i, vector(rng, 4), 7 if i % 10 else None if i % 20 else i) for i in range(200)]
    assert run(spark, rows) == brute(rows)
