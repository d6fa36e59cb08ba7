"""Search within documents of many chunks and queries: dealt pieces lose and repeat no pair."""

import random

from brindle.operators import retrieval as S


def test_pieces_give_the_same_hits(spark, monkeypatch):
    rng = random.Random(3)
    vec = lambda: [rng.choice([0.5, 1.0, -1.0]) for _ in range(3)]
    chunks = spark.createDataFrame([(f"{'ab'[i % 5 == 0]}#{i:03}", "ab"[i % 5 == 0], vec()) for i in range(200)], "chunk_id string, document_id string, vec array<float>")
    queries = spark.createDataFrame([(i, vec(), "abc"[i % 3], f"a#{i:03}") for i in range(60)], "qid int, q_vec array<float>, document_id string, own string")
    whole = sorted(map(tuple, S.search_within(queries, chunks, 7).collect()))
    monkeypatch.setattr(S, "PIECE_CHUNKS", 20)
    monkeypatch.setattr(S, "PIECE_QUERIES", 6)
    pairs = S._pieces(chunks, queries)
    assert sorted(map(tuple, S.search_within(queries, chunks, 7).collect())) == whole and len(whole) == 40 * 7
    tasks = {(r.document_id, r._piece, r._block): r["count"] for r in pairs.groupBy("document_id", "_piece", "_block").count().collect()}
    assert sum(tasks.values()) == 20 * 160 + 20 * 40 and len(tasks) > 20 and max(tasks.values()) < 500
