"""Many set questions in one plan against each by itself."""

import itertools
import random

from brindle.operators import catalog as C

CATALOGUE = "part string, channel string, vds double, rdson array<struct<value:double,unit:string,conditions:string>>, id array<struct<value:double,unit:string,conditions:string>>, package array<string>"
SPECS = "qid int, op string, field string, channel string, vds double, package string, conditions string"
CONDITIONS = ["VGS = 10 V; ID = 5 A", "Tj = 25 °C; VGS = 10 V", "vgs = 10 V", "", "note", None]


def catalogue(spark):
    rng = random.Random(2)
    figures = lambda: None if rng.random() < 0.1 else [(rng.choice([1.0, -2.0, 2.0, 5.0, None]), "mΩ", rng.choice(CONDITIONS)) for _ in range(rng.randint(0, 4))]
    names = lambda: rng.choice([None, [], ["SOT23"], ["sot23 ", "LFPAK"], ["LFPAK", "lfpak", None]])
    rows = [(f"P{i:03}", rng.choice(["N", "P", None]), rng.choice([None, 20.0, -20.0, 40.0]), figures(), figures(), names()) for i in range(60)]
    return spark.createDataFrame([*rows, rows[3], rows[3]], CATALOGUE).repartition(3)


def test_each_as_by_itself(spark):
    rows = catalogue(spark)
    filters = itertools.product([None, "N"], [None, 20.0], [None, " Sot23"], [None, "VGS = 10 V; note", "Tj = 99 °C"])
    specs = [(op, field, *f) for f in filters for op, field in (("count", None), ("min", "rdson"), ("max", "id"), ("max", "vds"))]
    asked = [(i, *s) for i, s in enumerate(specs)] + [(9000, "min", "rdson", None, None, None, None), (9001, "sum", "rdson", None, None, None, None)]
    got = {}
    for r in C.run_queries(rows, spark.createDataFrame(asked, SPECS)).collect():
        got.setdefault(r.qid, []).append(tuple(r)[1:])
    assert set(got) == {i for i, op, *_ in asked if op != "sum"} and sorted(got[9000], key=repr) == sorted(got[1], key=repr)
    rng = random.Random(4)
    kinds = {r[0] for found in got.values() for r in found}
    assert kinds == {"count", "extremum", "ambiguous-conditions", "empty"}
    for i, op, field, channel, vds, package, conditions in rng.sample(asked[:-2], 22):
        want = [tuple(r) for r in C.run_query(rows, C.QuerySpec(op, field, channel, vds, package, conditions)).collect()]
        assert sorted(got[i], key=repr) == sorted(want, key=repr), (i, op, field, channel, vds, package, conditions)


def test_no_join_without_a_key(spark):
    specs = spark.createDataFrame([(1, "min", "rdson", "N", None, None, None), (2, "count", None, None, 20.0, "SOT23", None)], SPECS)
    plan = C.run_queries(catalogue(spark), specs)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nothing_asked_or_there(spark):
    none = spark.createDataFrame([], SPECS)
    assert C.run_queries(catalogue(spark), none).count() == 0
    specs = spark.createDataFrame([(1, "min", "rdson", None, None, None, None), (2, "count", None, None, None, None, None)], SPECS)
    found = {tuple(r) for r in C.run_queries(spark.createDataFrame([], CATALOGUE), specs).collect()}
    assert found == {(1, "empty", None, None, "mΩ", None, 0), (2, "count", None, 0.0, None, None, 0)}
