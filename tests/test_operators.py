"""Operators on literal cases: catalogue, planner, retrieval, preparation, labels, grading, evaluation, sources and sinks."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brindle.operators import catalog as C
from brindle.operators import evaluation as E
from brindle.operators import grading as G
from brindle.operators import labels as L
from brindle.operators import planning as P
from brindle.operators import preparation as R
from brindle.operators import retrieval as S
from brindle.sources import readers, sinks

A10 = "VGS = 10 V; ID = 25 A; Tj = 25 °C"


def part(name="P", channel="N", vds=40.0, rdson=((10.0, A10),), id_=((50.0, "VGS = 10 V; Tmb = 25 °C"),), package=("LFPAK56",)):
    return (name, channel, vds, [(v, "mΩ", c) for v, c in rdson], [(v, "A", c) for v, c in id_], list(package))


def ask(spark, rows, **spec):
    df = spark.createDataFrame(rows, readers.CATALOGUE)
    return [(r.kind, r.cond_class, r.value, r.parts, r.candidates) for r in C.run_query(df, C.QuerySpec(**spec)).collect()]


def test_extrema(spark):
    rows = [part("LOW", rdson=((1.0, "VGS = 4.5 V; Tj = 25 °C"),)), part("BEST", rdson=((5.0, A10),)), part("C", rdson=((9.0, "Tj = 25 °C; VGS = 10 V"),))]
    assert ask(spark, rows, op="min", field="rdson", conditions=A10) == [("extremum", "Tj = 25 °C; VGS = 10 V", 5.0, ["BEST"], 2)]
    assert [x[0] for x in ask(spark, rows, op="min", field="rdson")] == ["ambiguous-conditions"] * 2
    both = [part("X", rdson=((2.4, "VGS = 10 V"), (3.6, "VGS = 4.5 V"))), part("Y", rdson=((5.0, "VGS = 10 V"), (6.0, "VGS = 4.5 V")))]
    assert {x[3][0] for x in ask(spark, both, op="min", field="rdson")} == {"X"}
    assert ask(spark, [part("A", rdson=((4.0, A10),)), part("B", rdson=((4.0, A10),))], op="min", field="rdson")[0][3] == ["A", "B"]
    p = [part("WEAK", "P", -30.0, id_=((-2.4, "Tamb = 25 °C"),)), part("STRONG", "P", -30.0, id_=((-8.8, "Tamb = 25 °C"),))]
    assert ask(spark, p, op="max", field="id")[0][2:4] == (8.8, ["STRONG"])
    assert ask(spark, rows, op="max", field="rdson", vds=1.0) == [("empty", None, None, None, 0)]


def test_counts_and_channel(spark):
    rows = [part("A"), part("B", vds=-60.0), part("C", None, -30.0, package=("SOT669",))]
    n = lambda **f: ask(spark, rows, op="count", **f)[0][4]
    assert (n(package=" lfpak56 "), n(package="SOT669"), n(channel="N"), n(channel="P"), n(vds=30.0)) == (2, 1, 2, 1, 1)


def test_vocabulary_and_dedupe(spark):
    terms = {tuple(r) for r in C.vocabulary(spark.createDataFrame([part("A"), part("B", vds=-30.0)], readers.CATALOGUE)).collect()}
    assert {t for k, t in terms if k == "rating"} == {"30", "40"} and {t for k, t in terms if k == "rdson_class"} == {"Tj = 25 °C; VGS = 10 V"}
    m = spark.createDataFrame([("A", "c", 3.0, "x", 1), ("A", "c", -5.0, "y", 2), ("A", "c", 5.0, "z", 3)], "part string, cond_class string, value double, conditions string, pos int")
    assert [(r.value, r.conditions) for r in C.conservative_dedupe(m, ["part"]).collect()] == [(-5.0, "x")]


V = P.Vocabulary(("LFPAK56", "Power-SO8"), (30.0, 40.0), {"rdson": ("Tj = 25 °C; VGS = 10 V",), "id": ()})


@pytest.mark.parametrize("plan, want", [
    ({"route": "catalog", "op": "min", "field": "rdson", "filters": {"vds": -30}}, C.QuerySpec("min", "rdson", vds=30.0)),
    ({"route": "catalog", "op": "count", "filters": {"package": "lfpak56"}}, C.QuerySpec("count", package="LFPAK56")),
    ({"route": "catalog", "op": "min", "field": "rdson", "filters": {"conditions": "VGS = 10 V; Tj = 25 °C"}}, C.QuerySpec("min", "rdson", conditions="Tj = 25 °C; VGS = 10 V")),
    ({"route": "catalog", "op": "min", "field": "rdson", "filters": {"conditions": "VGS = 7 V"}}, C.QuerySpec("min", "rdson")),
    ({"route": "catalog", "op": "min", "field": "rdson", "filters": {"package": "X"}}, None), ({"route": "catalog", "op": "min", "field": "rdson", "filters": {"vds": 55}}, None),
    ({"route": "catalog", "op": "min"}, None), ({"route": "catalog", "op": "sum", "field": "id"}, None),
])
def test_parse_plan(plan, want):
    for text in (json.dumps(plan), "```json\n" + json.dumps(plan) + "\n```", "Sure. " + json.dumps(plan)):
        assert P.parse_plan(text, V)[1] == want
    assert P.parse_plan("", V) == P.parse_plan('{"route": "cat', V) == ("unsupported", None)


def ranking(spark, rows):
    return spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(rows)], "qid string, document_id string, rank long")


def order(df):
    return [r.document_id for r in df.orderBy("rank").collect()]


def test_fusion_and_rerank(spark):
    assert order(S.fuse([ranking(spark, "XYZ"), ranking(spark, "YX")], (1.0, 1.0)))[-1] == "Z"
    assert order(S.fuse([ranking(spark, ["D"]), ranking(spark, ["S"])], (1.0, 1.0))) == ["D", "S"]
    assert order(S.fuse([ranking(spark, ["D"]), ranking(spark, ["S"])])) == ["S", "D"]
    named = spark.createDataFrame([("q", "C"), ("q", "ABSENT")], "qid string, document_id string")
    assert order(S.rerank_symbols(ranking(spark, "ABCD"), named)) == ["C", "A", "B", "D"]


def test_search_plan_and_order(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid int, q_vec array<float>")
    c = spark.createDataFrame([(f"d{i}#0", f"d{i}", [1.0, i / 10]) for i in range(20)], "chunk_id string, document_id string, vec array<float>")
    found = S.dense_search(q, c, 3)
    assert order(found) == ["d0", "d1", "d2"]
    assert "WindowGroupLimit" in found._jdf.queryExecution().toString()


def test_metrics(spark):
    gold = spark.createDataFrame([("q", "C")], "qid string, gold string")
    ranks = E.gold_ranks(ranking(spark, "ABCD"), gold)
    m = E.retrieval_metrics(ranks, ks=(1, 3, 10)).first()
    assert (m.recall_1, m.recall_3, m.mrr, m.ndcg_10) == (0.0, 1.0, 0.3333, 0.5)
    p = E.percentiles(spark.range(1, 101).withColumn("g", F.lit(1)), ["g"], "id", {"p50": 0.5, "p95": 0.95}).first()
    assert (p.p50, p.p95) == (51, 96)
    assert sorted(r.id for r in S.stride_sample(spark.range(10), 4, "id").collect()) == [0, 2, 5, 7]
    assert sorted(r._i for r in S.numbered(spark.range(1000), "id").collect()) == list(range(1000))


def test_chunks(spark, one):
    cut = lambda t: one(R.chunks_of(F.lit(t)))
    block = "\n".join("line number %d of a long block with words" % i for i in range(60))
    assert len(cut(block)) > 1 and all(len(c) <= 1800 for c in cut(block))
    assert [len(c) for c in cut("x" * 5000)] == [1100, 1100, 1100, 1100, 600]
    assert cut("short") == ["short"] and cut("") == []
    blocks = cut("\n\n".join(chr(97 + i) * 100 + "\n" + chr(97 + i) * 99 for i in range(8)))
    assert all(a.split("\n")[-1] in b for a, b in zip(blocks, blocks[1:], strict=False))
    rows = R.chunk(spark.createDataFrame([("DOC-7", "short text")], "id string, text string")).collect()
    assert [(r.id, r.total) for r in rows] == [("DOC-7#0", 1)]


def plain_pieces(block):
    """A block over 1,800 characters: lines packed to 1,100, a line over 1,800 in slices of 1,100 ahead of the open piece."""
    if len(block) <= 1800:
        return [block]
    done, piece = [], ""
    for line in block.split("\n"):
        if piece and len(piece) + 1 + len(line) > 1100:
            done, piece = [*done, piece], ""
        if len(line) > 1800:
            done += [line[i : i + 1100] for i in range(0, len(line), 1100)]
        else:
            piece = f"{piece}\n{line}" if piece else line
    return [*done, piece] if piece else done


def plain_tail(text):
    lines, size = [], 0
    for line in reversed(text.split("\n")):
        if size + len(line) > 180:
            break
        lines, size = [line, *lines], size + len(line) + 1
    return "\n".join(lines)


def plain_chunks(text):
    done, current = [], ""
    for piece in [p for block in re.split("\n{2,}", text) if block.strip() for p in plain_pieces(block)]:
        if current and len(current) + 2 + len(piece) > 1100:
            done, current = [*done, current.strip()], plain_tail(current)
        current = f"{current}\n\n{piece}" if current else piece
    return [*done, current.strip()] if current.strip() else done


def test_chunks_by_brute_force(spark):
    """Random texts of words, long lines and long blocks, cut in plain Python."""
    draw = random.Random(7)
    line = lambda: "x" * draw.randrange(1801, 4000) if draw.random() < 0.05 else " ".join("w" * draw.randrange(1, 12) for _ in range(draw.randrange(1, 40)))
    texts = ["\n\n".join("\n".join(line() for _ in range(draw.choice([1, 2, 5, 20]))) for _ in range(draw.randrange(1, 9))) for _ in range(200)]
    found = R.chunk(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")).collect()
    got = {(int(r.document_id), r["index"]): r.text for r in found}
    assert got == {(i, k): c for i, t in enumerate(texts) for k, c in enumerate(plain_chunks(t))}


def test_chunks_of_long_texts(spark):
    """Lines, blocks and runs of blanks of 4 MB: all text is cut, and nothing grows with the square of its length."""
    units = ["word word word word word word\n", "some words here\nand here\n\n", " " * 1000 + "x", "x" * 997]
    texts = [u * (4_000_000 // len(u)) for u in units] + ["", None, " \n\n\u3000"]
    rows = R.chunk(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("total").alias("total"), F.max("index").alias("last"), F.max(F.length("text")).alias("long")
    )
    found = {int(r.document_id): r for r in rows.collect()}
    assert sorted(found) == [0, 1, 2, 3] and all(r.n == r.total == r.last + 1 and r.long <= 1800 for r in found.values()) and found[3].n == -(-len(texts[3]) // 1100)


def test_prepare(spark):
    text = "Product data sheet\nVDS   drain-source voltage   Tj = 25 °C   -   30   V\n      Tj = -55 °C   -   27   V\n\n      Tj = 25 °C   -   1   V\nplain prose\n12. Legal information\nnever"
    got = R.prepare(spark.createDataFrame([("a", text)], "id string, text string")).first().text.split("\n")
    assert got[1].strip().startswith("VDS   drain-source voltage   Tj = -55") and got[3] == "      Tj = 25 °C   -   1   V" and got[-1] == "plain prose"


def test_degenerate(one):
    bad = lambda t: one(R.is_degenerate(F.lit(t)))
    assert bad("ohm " * 20) and not bad("ohm " * 5) and not bad("") and not bad("The rating is 25 A at VGS = 10 V; ID = 25 A and Tj = 25 °C for this part")


def test_degenerate_shares(spark):
    """Texts whose commonest word has a share about the limit, in three orders, against plain counts."""
    r = random.Random(3)
    texts = []
    for n in (0, 1, 11, 12, 13, 40, 200):
        for share in (0.1, 0.29, 0.3, 0.31, 0.5, 1.0):
            often = int(n * share)
            words = ["ohm"] * often + [f"w{r.randrange(max(1, n // r.choice([1, 2, 4])))}" for _ in range(n - often)]
            texts += [" ".join(order) for order in (words, words[::-1], sorted(words, key=lambda _: r.random()))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", R.is_degenerate(F.col("t")).alias("bad")).collect()
    for row in got:
        words = row.t.split()
        assert row.bad == (len(words) >= 12 and max(Counter(words).values()) / len(words) > 0.3), row


DATASHEET = """N-channel 30 V MOSFET
Quick reference data
VDS    drain-source voltage    25 °C ≤ Tj ≤ 175 °C    -    -    30    V
ID     drain current    VGS = 10 V; Tmb = 100 °C    -    -    25    A
       VGS = 10 V; Tmb = 25 °C    -    -    50    A
Static characteristics
RDSon  drain-source on-state resistance  VGS = 4.5 V; ID = 5 A; Tj = 25 °C   -   7   8.49   mΩ
       VGS = 10 V; ID = 5 A; Tj = 25 °C   -   5   5.9   mΩ
Package outline
Ordering information
PX1    LFPAK56;   plastic
       Power-SO8  SOT669
"""


def test_labels(spark):
    rows = L.parse(spark.createDataFrame([("PX1", DATASHEET), ("NONE", "no table")], "part string, text string")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.channel, r.vds_v, r.rdson_mohm.value, r.id_a.value) == ("N", 30.0, 5.9, 50.0)
    assert len(r.rdson_all) == 2 and len(r.id_all) == 2 and r.package == ["LFPAK56", "Power-SO8", "SOT669"]


@pytest.mark.parametrize("text, want", [("13.9 mΩ at 25 °C", (True, 13.9, True)), ("25 mΩ", (False, 25.0, True)), ("no figure", (False, None, None)), ("-13.9 mΩ", (True, 13.9 * -1, False)), ("10.8 mΩ or 20 mΩ", (False, 10.8, True))])
def test_value_match(one, text, want):
    assert tuple(one(G.value_match(F.lit(text), F.lit(13.9), F.lit("mΩ")))) == want


def test_grades(one):
    g = lambda ok, found, refused, holdout: one(G.grade(F.lit(ok), F.lit(found).cast("double"), F.lit(refused), F.lit(holdout)))
    assert g(True, 1.0, True, True) == "refused-correctly" and g(True, 1.0, True, False) == "refused-wrongly" and g(True, 1.0, False, True) == "hallucinated"
    assert g(False, None, False, False) == "no-value" and g(False, 1.0, False, False) == "wrong-value"
    assert one(G.states_count(F.lit("there are 12 parts"), F.lit(12))) and not one(G.states_count(F.lit("1.12 or 12,5"), F.lit(12)))
    assert one(G.guard_refuses(F.array(F.lit("A1")), F.array(F.lit("B2")))) and not one(G.guard_refuses(F.array().cast("array<string>"), F.array(F.lit("B2"))))


def test_sinks(spark, tmp_path):
    chunks = lambda d, n: [(f"{d}#{i}", d, i, n, "t") for i in range(n)]
    schema = "id string, document_id string, index int, total int, text string"
    old, new = spark.createDataFrame(chunks("a", 9) + chunks("b", 2), schema), spark.createDataFrame(chunks("a", 3), schema)
    assert {r.id for r in sinks.prune(sinks.upsert(old, new), new).collect()} == {"a#0", "a#1", "a#2", "b#0", "b#1"}
    stale = [r.id for r in sinks.stale_ids(spark.createDataFrame(chunks("a", 10), schema)).collect()]
    assert len(stale) == 80 and "a#10" in stale and "a#60" in stale and "a#9" not in stale
    with pytest.raises(Exception, match="too large"):
        sinks.guarded(new, "text", limit=3).collect()
    sinks.write_json(new, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_streaming_ingest(spark, tmp_path):
    from brindle.streaming.ingest import CHUNKS, ingest_stream

    put = lambda name, rows: spark.createDataFrame(rows, CHUNKS).coalesce(1).write.json(str(tmp_path / "in" / name))
    run = lambda: ingest_stream(spark, str(tmp_path / "in" / "*"), str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination()
    put("1", [(f"a#{i}", "a", i, 4, "old") for i in range(4)] + [("b#0", "b", 0, 1, "b")])
    run()
    put("2", [(f"a#{i}", "a", i, 2, "new") for i in range(2)])
    run()
    got = sorted((r.id, r.text) for r in spark.read.parquet(str(tmp_path / "index")).collect())
    assert got == [("a#0", "new"), ("a#1", "new"), ("b#0", "b")]
