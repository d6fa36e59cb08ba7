"""Names mentioned in documents: tokens travel without their text, names of several tokens are looked for whole."""

from brindle.operators import retrieval as S


def test_names_of_one_and_of_several_tokens(spark):
    texts = [(1, "a Power-SO8 case, power and SO8"), (1, "power only"), (2, "SO8 power"), (3, None), (None, "the power-so8"), (4, "LFPAK56D")]
    names = [("power",), ("Power‑SO8",), ("lfpak56",), ("",), (None,), ("power",)]
    got = S.mentions(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(names, "name string"))
    want = [(1, "power"), (1, "power"), (2, "power"), (None, "power"), (1, "Power‑SO8"), (None, "Power‑SO8")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_no_text_is_shuffled(spark):
    d = spark.createDataFrame([(1, "of a text")], "doc_id int, text string")
    found = S.mentions(d, spark.createDataFrame([("of",)], "name string"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
