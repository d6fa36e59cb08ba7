"""How tables are dealt: broadcasts and tasks go by counted rows, not by the bytes of files."""

from pyspark.sql import functions as F

from brindle.functions import joins
from brindle.operators import labels as L
from brindle.operators import names as N


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_never_broadcast(spark, tmp_path, monkeypatch):
    """Parquet of texts that compress well looks small enough to broadcast."""
    path = str(tmp_path / "texts")
    spark.range(1000).select("id", F.concat(F.lit("What of PN1-"), "id", F.lit(" in SO8?")).alias("text")).write.parquet(path)
    names = spark.createDataFrame([("SO8",)], "name string")
    found = N.named_parts(spark.read.parquet(path), names)
    assert all(r.named == [f"PN1-{r.id}"] and r.text == f"What of PN1-{r.id} in SO8?" for r in found.collect())
    sides = [line for line in plan(N.named_parts(spark.read.parquet(path), names)).splitlines() if "Join" in line]
    assert sides and not any("BuildLeft" in line for line in sides)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    assert "BroadcastHashJoin" not in plan(N.occurrences(spark.read.parquet(path), names))
    assert all(r.named == [f"PN1-{r.id}"] for r in N.named_parts(spark.read.parquet(path), names).collect())


def test_tasks_of_table_rows_grow_with_the_lines(spark, monkeypatch):
    lines = spark.range(300).select((F.col("id") % 30).alias("part"), F.col("id").alias("pos"), F.lit("RDSon  resistance  VGS = 10 V  - 5 mΩ").alias("line"))
    few = {tuple(r) for r in L.table_rows(lines, "RDSon").collect()}
    monkeypatch.setattr(joins, "TASK_ROWS", 50)
    rows = L.table_rows(lines, "RDSon")
    assert "hashpartitioning(part" in plan(rows) and ", 6), REPARTITION_BY_NUM" in plan(rows) and plan(rows).count("Exchange") == 1
    assert {tuple(r) for r in rows.collect()} == few and len(few) == 30
    picked = L.reference_resistance(rows)
    assert plan(picked).count("Exchange") == 1 and picked.count() == 30
