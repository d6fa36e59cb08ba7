"""Prefix counts against the library's encoding of every prefix."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import token_counts as T

PIECES = ["a", "the ", "ing", " ", "  ", "\n", "\t", "▁", "é", "1", "23", "ü", "…", "日", "本", "<s>", "\x00", "🙂", "tion", "x" * 20, "=====", "aaa", "▁ ", " ▁", "hello", "\r\n", "ﬁ", "　"]


@pytest.fixture(scope="module")
def counter():
    return T.PrefixCounter(T.tokenizer_path(T.MODEL))


def wanted(counter, text):
    return [len(ids) for ids in counter.library.encode([text[:k] for k in range(1, len(text) + 1)])] if text else []


def test_every_prefix(counter):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    texts += ["", " ", " " * 100, "a" * 700, "日" * 300, "▁" * 50, " x" * 20, "=" * 400]
    counts, ends = counter.counts([x.encode() for x in texts])
    for text, got in zip(texts, np.split(counts, ends[:-1]), strict=True):
        assert got.tolist() == wanted(counter, text), text


def test_pair_table_overflows(counter, monkeypatch):
    """Verdicts that push each other out of the table are asked for again."""
    monkeypatch.setattr(T, "PAIR_BITS", 3)
    small = T.PrefixCounter(T.tokenizer_path(T.MODEL))
    rng = random.Random(6)
    for text in ["".join(rng.choice(PIECES) for _ in range(40)) for _ in range(20)]:
        assert small.counts([text.encode()])[0].tolist() == wanted(counter, text)


def test_kept_units_change_nothing(counter, monkeypatch):
    monkeypatch.setattr(T, "KEPT_UNITS", 5)
    small = T.PrefixCounter(T.tokenizer_path(T.MODEL))
    for text in ["one two three four five six seven", "three two one nine", "one two three"]:
        assert small.counts([text.encode()])[0].tolist() == wanted(counter, text)


def test_documents(spark, docs, empty, texts, counter):
    """Nulls, empty and long texts, repeated rows, clashing names; answers from what is stored."""
    own = docs.withColumn("fits", F.lit("own")).withColumn("a.b", F.lit(1))
    counted = T.count_prefixes(own, limit=50)
    assert "a.b" in counted.columns and counted.count() == docs.count()
    asked = counted.select("doc_id", "text", "n_tokens", "fits", *[T.tokens_upto(F.col("prefix_tokens"), F.lit(k)).alias(f"t{k}") for k in (0, 3, 10**6)], T.longest_within(F.col("prefix_tokens"), F.lit(7)).alias("w7"))
    for r in asked.collect():
        text = r["text"] or ""
        each = [0, *wanted(counter, text[:2000])]
        n = len(counter.library.encode(text))
        assert r["n_tokens"] == n == r["t1000000"] and r["t0"] == 0 and r["t3"] == each[min(3, len(text))]
        assert r["w7"] == max(k for k, c in enumerate(each) if c <= 7)
        if len(text) <= 2000 or n > 2000:
            assert r["fits"] == max(k for k, c in enumerate(each) if c <= 50)
    assert T.count_prefixes(empty).count() == 0


def test_steps_of_any_width():
    for counts in ([], [1, 2, 3], [5, 1, 200], [1, 40_000, 2], [2, 500]):
        assert T.opened(T.sealed(np.array(counts, np.int32))).tolist() == [0, *counts]


def test_rounds_split_nothing(spark, docs, monkeypatch):
    whole = {(r.doc_id, r.n_tokens, r.fits) for r in T.count_prefixes(docs).collect()}
    monkeypatch.setattr(T, "ROUND_BYTES", 50)
    assert {(r.doc_id, r.n_tokens, r.fits) for r in T.count_prefixes(docs).collect()} == whole
