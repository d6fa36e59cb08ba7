"""Known names in texts against one regular expression after another."""

import random
import re

import pytest
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import names as N
from brindle.operators import planning as P


def stripped(text, names):
    """The text once each name, the longest first, has been replaced wherever it stands alone."""
    text = re.sub(T.DASHES, "-", text)
    for name in sorted(set(names), key=lambda n: (-len(n), n)):
        text = re.sub(rf"(^|[^A-Za-z0-9-]){re.escape(re.sub(T.DASHES, '-', name))}(?![A-Za-z0-9-])", r"\1 ", text, flags=re.IGNORECASE)
    return text


def brute(text, names):
    return list(dict.fromkeys(re.findall(T.IDENTIFIER, stripped(text, names))))


def named(spark, texts, names):
    df = N.named_parts(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), spark.createDataFrame([(n,) for n in names], "name string"))
    return {r.id: r.named for r in df.collect()}


NAMES = ["Power-SO8", "DFN2020MD-6", "SOT669", "SOT8002", "LFPAK 56 D", "56 D", "LFPAK", "(WLCSP) 4", "SO8/SOT96", "AB12", "ab12 CD34", "TO‑220", "é", "-", ""]


def test_random_texts(spark):
    rng = random.Random(8)
    pieces = [*NAMES, "power-so8", "X", "SOT669X-40", "PSMN1R0-30YLD", "AB12-7", " ", " ", " ", ", ", "‑", "-", "(", ")", "/", "_", "é", "CD34", "EF5G"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    got = named(spark, texts, NAMES)
    for i, text in enumerate(texts):
        assert got[i] == brute(text, NAMES) == N.python_named_parts(text, NAMES), text


def test_text_is_kept_but_for_names(spark):
    texts = [(1, "Is Power‑SO8 (or LFPAK 56 D) like SOT669, SOT669 or sot669x?", "x"), (2, "", "y"), (3, None, "z"), (4, "none", None)]
    names = spark.createDataFrame([(n,) for n in [*NAMES, None]], "name string")
    found = N.without_names(spark.createDataFrame(texts, "id int, text string, `a.b` string"), names)
    assert found.columns == ["id", "text", "a.b"]
    assert {r.id: r.text for r in found.collect()} == {1: "Is   (or  ) like  ,   or sot669x?", 2: "", 3: None, 4: "none"}
    assert N.without_names(spark.createDataFrame(texts[:1], "id int, text string, x string"), names.limit(0)).first().text == "Is Power-SO8 (or LFPAK 56 D) like SOT669, SOT669 or sot669x?"


def test_a_hundred_thousand_names(spark):
    """A vocabulary of any size is a table; one token begins a third of its names."""
    names = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("SOT "), F.col("id"))).otherwise(F.concat(F.lit("PK"), F.col("id"), F.lit("-A"))).alias("name"))
    texts = ["Is PK1-A or PK1-AB in SOT 3 or SOT 4?", "PK3-A PK99998-A PK100001-A", "sot 99999 AB1 sot 99998"]
    df = N.named_parts(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), names)
    assert {r.id: r.named for r in df.collect()} == {0: ["PK1-AB"], 1: ["PK3-A", "PK100001-A"], 2: ["AB1"]}
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("question, want", [("How many parts come in Power-SO8 or DFN2020MD‑6?", "set"), ("What is SOT669X-40?", "document")])
def test_route(spark, question, want):
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    assert P.route(spark.createDataFrame([(1, question)], "id int, text string"), names).first()["route"] == want
