"""The pipeline's stages, one after the other, against brute force on the smallest tables and on edge cases."""

import collections

import corpus_pipeline
from tests.llm.test_ops import base_of, reach, simhash_of
from tests.llm.test_similar import shingles_of

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows[name] = docs.collect()
        assert docs.columns == columns or k == 4
    given = spark.read.parquet(f"{SF}/documents.parquet").collect()
    kept = {r.doc_id for r in rows["quality rules"]}
    assert kept <= {r.doc_id for r in given if not base_of(r.text)[-1]} and len(kept) > 0.7 * len(given)
    lined = rows["line dedup"]
    assert {r.doc_id for r in lined} == kept
    prints = {r.doc_id: simhash_of(r.text, 5) for r in lined}
    near = [(a, b) for a in set(prints.values()) for b in set(prints.values()) if (a ^ b).bit_count() <= 2]
    # Texts of five-word similarity 0.8 or more are linked too, however far apart their prints are.
    sets = {r.doc_id: shingles_of(r.text) for r in lined}
    similar = [(prints[a], prints[b]) for a in sets for b in sets if a < b and sets[a] and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    label = reach(set(prints.values()), near + similar)
    best = {}
    for i, p in sorted(prints.items()):
        best.setdefault(label[p], i)
    one = {r.doc_id for r in rows["SimHash near-dedup"]}
    assert one == set(best.values())
    assert {r.doc_id for r in rows["mixing sources"]} == one
    packed = collections.Counter((r.doc_id, r.piece) for r in rows["best-fit packing"])
    mixed = collections.Counter(r.doc_id for r in rows["mixing sources"])
    assert all(packed[(i, 0)] == n for i, n in mixed.items())
    assert corpus_pipeline.run(spark, SF).count() == len(rows["best-fit packing"])


def test_stages_bear_edge_cases(spark, docs, empty):
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").count()
        assert stage(spark, empty, "").count() == 0, name
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == kept.select("doc_id").distinct().count()
