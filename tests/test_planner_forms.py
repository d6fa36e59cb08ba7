"""Both forms of the planner's grammar give one reading of each answer."""

import itertools
import json

from brindle.operators import catalog as C
from brindle.operators import planning as P

RATINGS, PACKAGES = (30.0, 40.0), ("LFPAK56", "Power-SO8")
CLASSES = {"rdson": ("Tj = 25 °C; VGS = 10 V",), "id": ("Tmb = 25 °C; VGS = 10 V",)}
V = P.Vocabulary(PACKAGES, RATINGS, CLASSES)


def texts():
    out = ["", "no plan", "{", "}{", "[1]", "{}", '{"route": 7}', '{"route": "lookup"} tail', '{"route": "catalog"}', '{"route": "catalog", "spec": []}', '{"route": "catalog", "op": "count", "filters": {"vds": NaN}}']
    values = {"vds": [30, -40.0, 55, "30", "abc", True, None, [30], {"a": 1}], "package": [" lfpak56 ", "X", 7, None, ["LFPAK56"]], "channel": ["N", "n", 1, None], "conditions": ["VGS = 10 V; Tj = 25 °C; ID = 5 A", "VGS = 10 V; Tmb = 25 °C", "nothing", 5]}
    for name, some in values.items():
        for value, (op, field) in itertools.product(some, [("min", "rdson"), ("max", "id"), ("max", "vds"), ("count", None), ("count", "odd")]):
            body = {"op": op, "field": field, "filters": {name: value}}
            out.append(json.dumps({"route": "catalog", **body}, ensure_ascii=False))
            out.append("Sure: " + json.dumps({"route": "catalog", "spec": body}, ensure_ascii=False))
        out.append(json.dumps({"route": "catalog", "op": "min", "field": "rdson", name: some[0]}, ensure_ascii=False))
    out += [json.dumps({"route": "catalog", "op": op, "field": field, "filters": f}) for op in ("min", "sum", None, 3) for field in ("rdson", "odd", None, 1) for f in ({}, [], "x", None)]
    return out


def test_forms_agree(spark):
    every = texts()
    terms = [("rating", "30"), ("rating", "40"), *(("package", p) for p in PACKAGES), *((f"{f}_class", c) for f, cs in CLASSES.items() for c in cs)]
    rows = P.check_plans(spark.createDataFrame(list(enumerate(every)), "id int, text string").repartition(2), spark.createDataFrame(terms, "kind string, term string")).collect()
    assert len(rows) == len(every)
    for r in rows:
        route, spec = P.parse_plan(every[r.id], V)
        mine = (r.op, r.field, r.channel, r.vds, r.package, r.conditions)
        assert r.route == route and mine == ((spec.op, spec.field, spec.channel, spec.vds, spec.package, spec.conditions) if spec else (None,) * 6), every[r.id]


def test_wrong_types_are_ignored():
    assert P.parse_plan('{"route": "catalog", "op": "count", "field": "odd", "filters": {"vds": "abc", "package": 7}}', V) == ("catalog", C.QuerySpec("count"))
    assert P.parse_plan('{"route": "catalog", "op": "min", "field": "id", "vds": 55, "filters": {"vds": true}}', V) == ("catalog", C.QuerySpec("min", "id"))
    assert P.parse_plan('{"route": "catalog", "op": "min", "field": "id", "filters": {"vds": 55}}', V) == ("unsupported", None)
