"""Batches of set questions: what is broadcast goes by counted rows, and answers need no lists of parts."""

import re

from pyspark.sql import functions as F

from brindle.functions import joins
from brindle.operators import catalog as C
from brindle.plans import bindings
from brindle.plans import views as V
from tests.test_queries import SF
from tests.test_set_batches import CATALOGUE, SPECS, catalogue


def broadcasts(df):
    """The text of each broadcast table's plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [re.search(r"[A-Za-z*(]|$", line).start() for line in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:end])


def test_parts_go_by_their_number(spark, monkeypatch):
    """A million parts fit a file small enough for Spark to broadcast."""
    assert any("p_partkey" in x for x in broadcasts(V.named_catalogue(spark, SF)))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    assert not list(broadcasts(V.named_catalogue(spark, SF)))


def test_only_keys_and_their_answers_are_broadcast(spark, monkeypatch):
    of_keys = lambda found: [x for x in found if "event_id" in x and "p_partkey" not in x]
    assert len(of_keys(broadcasts(bindings.batch_set_questions(spark, SF)))) == 3  # of the counts, and of the figures, which the plan shows twice
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    found = list(broadcasts(bindings.batch_set_questions(spark, SF)))
    assert not of_keys(found) and not [x for x in found if "p_partkey" in x and "candidates" not in x]


def test_figures_under_keys_are_made_once(spark):
    """Both users of the figures read them from one exchange, dealt by key and part."""
    df = bindings.batch_set_questions(spark, SF)
    df.write.format("noop").mode("overwrite").save()
    dealt = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "REPARTITION_BY_COL" in x]
    assert len(dealt) == 2 and len({re.sub(r"#\d+L?|\[plan_id=\d+\]|^[ :+-]*", "", x) for x in dealt}) == 1


def test_unlisted_as_listed(spark):
    rows = catalogue(spark)
    asked = [(i, op, field, channel, vds, None, None) for i, (op, field, channel, vds) in enumerate((o, f, c, v) for o in ("min", "max", "count") for f in ("rdson", "id", "vds") for c in (None, "N") for v in (None, 20.0, 99.0))]
    specs = spark.createDataFrame(asked, SPECS)
    key = ["qid", "kind", "cond_class", "value", "unit", "candidates"]
    listed = C.run_queries(rows, specs).select(*key, F.size("parts").alias("n"), F.get("parts", F.lit(0)).alias("first"))
    short = C.run_queries(rows, specs, listed=False)
    assert dict(short.dtypes)["n_parts"] == "int" and dict(short.dtypes)["first_part"] == "string"
    assert {tuple(r) for r in short.select(*key, "n_parts", "first_part").collect()} == {tuple(r) for r in listed.collect()}


def test_another_column_competes_as_the_rating(spark):
    """Filters go by vds, the named column competes."""
    rows = spark.createDataFrame([("P1", "N", None, None, None, None), ("P2", "N", 20.0, None, None, None), ("P3", "N", 40.0, None, None, None)], CATALOGUE)
    rows = rows.withColumn("rated", F.coalesce("vds", F.lit(-60.0)))
    specs = spark.createDataFrame([(1, "max", "vds", None, None, None, None), (2, "max", "vds", None, 20.0, None, None), (3, "max", "vds", None, 60.0, None, None)], SPECS)
    found = {r.qid: (r.kind, r.value, r.parts) for r in C.run_queries(rows, specs, rated="rated").collect()}
    assert found == {1: ("extremum", 60.0, ["P1"]), 2: ("extremum", 20.0, ["P2"]), 3: ("empty", None, None)}
