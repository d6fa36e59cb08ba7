"""Search within large documents: blocks of vectors give what rows of pairs give, and no pair becomes a row."""

import random

from brindle.operators import retrieval as S


def test_blocks_give_the_rows_of_pairs(spark, monkeypatch):
    rng = random.Random(4)
    vec = lambda n=3: [rng.choice([0.5, 1.0, -1.0, 0.25]) for _ in range(n)]
    rows = [(f"{'ab'[i % 9 == 0]}#{i:03}", "ab"[i % 9 == 0], vec()) for i in range(200)]
    odd = [("a#null", "a", None), ("a#half", "a", [None, 1.0, 1.0]), ("a#short", "a", [1.0, 1.0]), ("a#nan", "a", [float("nan"), 1.0, 1.0]), (None, "a", vec())]
    asked = [(i, vec(), "abc"[i % 3], f"{'ab'[i % 9 == 0]}#{i:03}") for i in range(60)] + [(60, None, "a", None), (61, vec(2), "a", None), (62, vec(), None, None)]
    queries = spark.createDataFrame(asked, "qid int, q_vec array<float>, document_id string, own string")
    for held in (rows, rows + odd):
        chunks = spark.createDataFrame(held, "chunk_id string, document_id string, vec array<float>")
        pairs = sorted(map(str, S._as_rows(queries, chunks, 7).collect()))
        monkeypatch.setattr(S, "PIECE_CHUNKS", 30)
        monkeypatch.setattr(S, "PIECE_QUERIES", 100)
        monkeypatch.setattr(S, "BLOCK_BYTES", 360)  # 15 vectors
        found = S.search_within(queries, chunks, 7)
        assert sorted(map(str, found.collect())) == pairs and len(pairs) > 280
        assert "FlatMapCoGroups" in found._jdf.queryExecution().toString()
        monkeypatch.undo()
