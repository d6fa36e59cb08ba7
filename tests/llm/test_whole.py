"""Cases in which operators once did less than the whole job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import neighbours, secret_scan, simhash, url_filter


@pytest.mark.parametrize("first", ["-", "_", "=", "+", "/", "==", "--client-key="])
def test_secrets_that_begin_with_separators(one, first):
    secret = first + "9aF3kLq8Zx2Vb7Nm4Rt6Yw1Pc5"
    spans = one(secret_scan.random_strings(F.lit(f"key {secret} end")))
    assert [(s.start, s.end) for s in spans] == [(4, 4 + len(secret))]


@pytest.mark.parametrize("part", ["sample", "EXAMPLE", "your_", "dummy", "0123456789", "abcdefghij", "aaaaaaaa"])
def test_allowed_parts_suppress_only_their_windows(one, part):
    secret = "9aF3kLq8Zx2Vb7Nm4Rt6Yw1Pc5"
    found = lambda text: one(F.size(secret_scan.random_strings(F.lit(text))))
    assert found(f"x {part}{secret} y") == found(f"x {secret}{part} y") == 1
    assert found(f"x {secret[:13]}{part}{secret[13:]} y") == 0


def test_separators_alone_are_no_secret(one):
    assert one(F.size(secret_scan.random_strings(F.lit("=-_+/" * 10)))) == 0


def test_distrust_reaches_along_a_chain(spark):
    n = 30
    page = lambda i, to: (i, f"http://h{i}.net/" if i else "http://h0.com/de/", f'<a href="http://{to}/">x</a>')
    name = lambda i: "h0.com" if i == 0 else f"h{i}.net"
    pages = [(0, "http://h0.com/de/", "")] + [page(i, name(i - 1)) for i in range(1, n)]
    verdict = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert set(verdict.values()) == {"block"} and len(verdict) == n


def test_propagation_converges(spark):
    n = 30
    links = [(f"h{i}", f"h{(i + 1) % n}", 1) for i in range(n)]
    seeds = [("h0", 1.0, 0.0), ("h7", 0.0, 1.0)]
    found = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(spark.createDataFrame(seeds, "host string, trust double, distrust double"), spark.createDataFrame(links, "src string, dst string, n long")).collect()}
    step = np.roll(np.eye(n), 1, axis=0)
    solve = lambda m, at: np.linalg.solve(np.eye(n) - 0.85 * m, 0.15 * np.eye(n)[at])
    trust, distrust = solve(step, 0), solve(step.T, 7)
    assert all(abs(found[f"h{i}"][0] - trust[i]) < 1e-5 and abs(found[f"h{i}"][1] - distrust[i]) < 1e-5 for i in range(n))


def test_null_and_shared_identifiers_are_no_duplicates(spark):
    texts = [" ".join(f"t{k}w{i}" for i in range(60)) for k in range(12)]
    rows = [(None if k < 4 else 7 if k < 8 else k, t) for k, t in enumerate(texts)]
    rows += [rows[0], rows[5], (99, texts[1]), (3, texts[11])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.text for r in kept) == sorted(texts)
    assert {r.text: r.doc_id for r in kept} == {t: {1: 99, 11: 3}.get(k, rows[k][0]) for k, t in enumerate(texts)}



def test_repeated_candidates_take_one_place(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(1, 40)]
    query = rng.normal(size=8)
    hot = [(100 + k, (query + 0.01 * (k + 1) * rng.normal(size=8)).tolist()) for k in range(2)]
    rows = [(0, query.tolist()), *vectors, *hot * 6, (100, [-x for x in query.tolist()])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    best = {}
    for i, v in rows[1:]:
        best[i] = max(best.get(i, -2.0), float(neighbours.cosines(query[None], np.array([v]))[0]))
    want = sorted(best, key=lambda i: (-best[i], i))[:5]
    found = neighbours.nearest(df, F.col("vec_id") == 0, 5).orderBy("rank").collect()
    assert [r.vec_id for r in found] == want and all(abs(r.score - best[r.vec_id]) < 1e-12 for r in found)


@pytest.mark.parametrize("size", [1e-200, 1e200])
def test_extreme_magnitudes_take_part(spark, size):
    rng = np.random.default_rng(4)
    vectors = [(rng.normal(size=8) * (size if i % 2 else 1.0)).tolist() for i in range(20)]
    found = neighbours.nearest(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"), F.col("vec_id") == 1, 5).orderBy("rank").collect()
    unit = np.array(vectors) / np.abs(vectors).max(axis=1, keepdims=True)
    score = neighbours.cosines(np.repeat(unit[1:2], 20, 0), unit)
    assert [r.vec_id for r in found] == [i for i in np.argsort(-score).tolist() if i != 1][:5]


def test_links_of_radius_one(spark):
    prints = [5, 8, 12, 13, 77, 76, 1 << 40]
    links = simhash.ball_links(spark.createDataFrame([(p,) for p in prints], "fp long"), 1).collect()
    assert {frozenset(x) for x in links} == {frozenset((a, b)) for a in prints for b in prints if (a ^ b).bit_count() == 1}
