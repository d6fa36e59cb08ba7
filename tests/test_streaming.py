"""Streamed ingest: replayed, split, reordered and interrupted batches settle to one index."""

import os
import random

import pytest

from brindle.streaming import ingest


def by_hand(files, overhang=80):
    """The index after files (in the order of their versions) one by one: rows upsert, then the last declared total prunes what was there and what came."""
    held = {}
    for rows in files:
        totals = {}
        for i, d, n, total, text in rows:
            held[i] = (d, n, text)
            totals[d] = total
        for d, total in totals.items():
            held = {i: v for i, v in held.items() if not (v[0] == d and total <= v[1] < total + overhang)}
    return sorted((i, v[2]) for i, v in held.items())


def versions(seed, number=7):
    """Files of versions of three documents: longer, shorter, partial, and ids given twice in one file."""
    r = random.Random(seed)
    files = []
    for v in range(number):
        rows = []
        for d in r.sample("abc", 2):
            total = r.choice([1, 2, 3, 5, 90])
            places = r.sample(range(total), r.randint(1, min(total, 6)))
            rows += [(f"{d}#{n}", d, n, total, f"{d}{n} of {v}") for n in places]
            rows += [(f"{d}#{places[0]}", d, places[0], total, f"again {v}")] if r.random() < 0.4 else []
        files.append(rows)
    return files


def put(spark, folder, name, rows, when):
    """One file of rows with a modification time of its own."""
    out = os.path.join(folder, name)
    spark.createDataFrame(rows, ingest.CHUNKS).coalesce(1).write.json(out)
    for f in os.listdir(out):
        os.utime(os.path.join(out, f), (when, when))


def held(spark, path):
    """The stored rows; they are also what the settled view shows."""
    stored = sorted((r.id, r.text) for r in spark.read.parquet(path).collect())
    assert stored == sorted((r.id, r.text) for r in ingest.current(spark, path).collect())
    return stored


@pytest.mark.parametrize("seed", [2])
def test_order_split_and_replay_do_not_matter(spark, tmp_path, seed):
    files = versions(seed)
    for v, rows in enumerate(files):
        put(spark, str(tmp_path / "in"), f"v{v}", rows, 1_700_000_000 + v)
    expected = by_hand(files)
    source = str(tmp_path / "in" / "*")

    def ingested(name, checkpoint, **how):
        path = str(tmp_path / name)
        ingest.ingest_stream(spark, source, path, str(tmp_path / checkpoint), **how).awaitTermination()
        return held(spark, path)

    assert ingested("whole", "c1") == expected
    assert ingested("split", "c2", files=1) == expected
    assert ingested("late", "c3", files=1, newest_first=True) == expected
    assert ingested("late", "c4", files=2) == expected  # all over again with a lost checkpoint


def test_late_shorter_version_ends_older_chunks_only(spark, tmp_path):
    old = [(f"a#{i}", "a", i, 5, "1") for i in range(5)]
    shorter = [(f"a#{i}", "a", i, 3, "2") for i in range(3)]
    partial = [(f"a#{i}", "a", i, 5, "3") for i in range(4)]
    for v, rows in enumerate([old, shorter, partial]):
        put(spark, str(tmp_path / "in"), f"v{v}", rows, 1_700_000_000 + v)
    run = lambda name, at, cp: ingest.ingest_stream(spark, str(tmp_path / "in" / name), str(tmp_path / "x"), str(tmp_path / cp)).awaitTermination()
    run("v0", "x", "c0")
    run("v2", "x", "c2")
    assert held(spark, str(tmp_path / "x")) == [("a#0", "3"), ("a#1", "3"), ("a#2", "3"), ("a#3", "3"), ("a#4", "1")]
    run("v1", "x", "c1")  # late: ends version 1's last chunk, not version 3's
    assert held(spark, str(tmp_path / "x")) == [(f"a#{i}", "3") for i in range(4)]
    run("v0", "x", "c3")  # the end still holds when the first file comes again
    assert held(spark, str(tmp_path / "x")) == [(f"a#{i}", "3") for i in range(4)]


def test_stop_between_writes(spark, tmp_path, monkeypatch):
    """A batch that stops after any of its writes leaves a settled view, and merging it again mends the rest."""
    schema = ingest.CHUNKS
    first = spark.createDataFrame([(f"a#{i}", "a", i, 4, "old") for i in range(4)], schema)
    second = spark.createDataFrame([(f"a#{i}", "a", i, 2, "new") for i in range(2)], schema)
    real = ingest._exchange
    for stop in (0, 1, 2):
        path = str(tmp_path / f"index{stop}")
        ingest.replacing(path)(first, 0)
        calls = []

        def broken(table, where, generation, buckets):
            if len(calls) == stop:
                raise RuntimeError("lost")
            calls.append(where)
            # the write is whole, the earlier generation still there
            real(table, where, generation, [])

        monkeypatch.setattr(ingest, "_exchange", broken)
        if stop < 2:
            with pytest.raises(RuntimeError):
                ingest.replacing(path)(second, 1)
        else:
            ingest.replacing(path)(second, 1)
            assert sorted((r.id, r.text) for r in ingest.current(spark, path).collect()) == [("a#0", "new"), ("a#1", "new")]
        monkeypatch.setattr(ingest, "_exchange", real)
        ingest.replacing(path)(second, 1)
        assert held(spark, path) == [("a#0", "new"), ("a#1", "new")]


def test_nulls_empty_batches_and_broken_index(spark, tmp_path):
    path = str(tmp_path / "n")
    run = ingest.replacing(path)
    run(spark.createDataFrame([], ingest.CHUNKS), 0)
    assert not os.path.exists(path) and ingest.current(spark, path).count() == 0
    rows = [(None, "a", 0, 1, "x"), ("a#1", "a", None, 1, "y"), ("b#0", None, 0, 0, "z"), ("c#0", "c", 0, None, None)]
    run(spark.createDataFrame(rows, ingest.CHUNKS), 1)
    run(spark.createDataFrame(rows, ingest.CHUNKS), 2)
    assert {(r.id, r.text) for r in ingest.current(spark, path).collect()} == {(None, "x"), ("a#1", "y"), ("b#0", "z"), ("c#0", None)}
    broken = tmp_path / "b"
    (broken / "bucket=1" / "generation=1").mkdir(parents=True)
    (broken / "bucket=1" / "generation=1" / "x.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="parquet|Parquet|PARQUET"):
        ingest.current(spark, str(broken)).count()
