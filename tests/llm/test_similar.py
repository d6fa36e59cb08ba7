"""Near duplicates by Jaccard similarity of five-word shingles, against brute force."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from brindle.llm import common, similar
from tests.llm.test_ops import WORD, reach, simhash_of


def shingles_of(text):
    words = WORD.findall(text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stage_links_similar_texts(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(40, 400))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            edited = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 60))):
                edited[rng.randrange(len(edited))] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(edited))
    # A chain, each like the next: a bucket's first text alone doesn't connect it.
    words = [f"c{i}" for i in range(200)]
    texts += [" ".join(words[k * 8 : k * 8 + 120]) for k in range(10)]
    sets, prints = [shingles_of(t) for t in texts], [simhash_of(t, 5) for t in texts]
    pairs = [(a, b) for b in range(len(texts)) for a in range(b)]
    alike = [(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    near = [(a, b) for a, b in pairs if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert len(set(alike) - set(near)) > 20
    want = set(reach(range(len(texts)), alike + near).values())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want


def test_bands_of_long_sets_in_slices(monkeypatch):
    shingles = similar.shingle_set(" ".join(f"w{i}" for i in range(3000)))
    whole = similar.bands(shingles)
    monkeypatch.setattr(similar, "SLICE", 7 * len(similar._MULTIPLIERS))
    assert similar.bands(shingles) == whole and similar.bands(similar.shingle_set("")) == []


def test_sieve_loses_no_key(spark, monkeypatch):
    rows = spark.range(20_000).select(F.when(F.col("id") % 7 > 0, F.xxhash64("id")).alias("key"), "id", F.lit("x").alias("_extra"))
    keys = rows.where("id % 10 = 0").select("key")
    wanted = {r.key for r in keys.collect()}
    for bits in (common.SIEVE_BITS, 1 << 15):
        monkeypatch.setattr(common, "SIEVE_BITS", bits)
        found = common.marked(rows, "key", keys, "may").collect()
        assert len(found) == 20_000 and all(r.may for r in found if r.key in wanted)
        by_chance = sum(r.may for r in found if r.key not in wanted)
        assert by_chance < 20_000 * 2.5 * len(wanted) / bits + 20
        kept = common.sieved(rows, "key", keys)
        assert kept.columns == rows.columns and kept.count() == sum(r.may for r in found)
    assert common.sieved(rows, "key", keys.where("false")).count() == 0


def test_rows_that_repeat_or_go_alone_are_settled(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [(1, " ".join(words), 1), (1, " ".join(words), 1), (2, " ".join(words), 1), (None, " ".join(words[:59]), 1), (3, "one of its own kind only", 1), (3, "quite another text with that number", 1), (4, None, 1), (5, "", 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, _place int").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, (r.text or "")[:5]) for r in kept.collect()) == [(1, "w0 w1"), (3, "one o"), (3, "quite"), (4, "")]
