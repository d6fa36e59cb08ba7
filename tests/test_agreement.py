"""Agreement, winners, totals and name checks where their inputs are null, empty or within a tolerance."""

from brindle.operators import evaluation as E
from brindle.operators import labels as L

FIGURES = "array<struct<value:double,unit:string,conditions:string>>"
ONE = "struct<value:double,conditions:string>"


def test_cells_and_observation(spark):
    catalogue = spark.createDataFrame(
        [("A", -40.0, [(-5.02, "mΩ", "Tj = 25 °C; VGS = 10 V")], [(3.0, "A", "Tamb = 25 °C")], ["LFPAK56-1"]), ("B", None, None, None, None), ("C", 20.1, [], [], []), ("D", 1.0, [], [], [])],
        f"part string, vds double, rdson {FIGURES}, id {FIGURES}, package array<string>",
    )
    labels = spark.createDataFrame(
        [("A", -40.1, (5.0, "VGS = 10 V; ID = 2 A; Tj = 25 °C"), (3.0, "Tmb = 25 °C"), ["LFPAK56‑1; a b"]), ("B", 30.0, (1.0, ""), None, ["X1"]), ("C", 20.0, None, None, ["lower"]), ("E", 1.0, None, None, None)],
        f"part string, vds_v double, rdson_mohm {ONE}, id_a {ONE}, package array<string>",
    )
    want = {("A", "vds"): True, ("A", "rdson"): True, ("A", "rdson_conditions"): True, ("A", "id"): False, ("A", "id_conditions"): False, ("A", "package"): True,
            ("B", "vds"): False, ("B", "rdson"): False, ("B", "rdson_conditions"): False, ("B", "package"): False, ("C", "vds"): True}
    assert {(r.part, r.field): r.agrees for r in E.joined_cells(catalogue, labels).collect()} == want
    rows, seen = E.joined_disagreements(catalogue, labels)
    found = {(r.part, r.field): (r.catalogue, r.label) for r in rows.collect()}
    assert set(found) == {k for k, ok in want.items() if not ok}
    assert found["A", "id"] == ("3 @ Tamb = 25 °C", "3 @ Tmb = 25 °C") and found["A", "id_conditions"] == ("Tamb = 25 °C", "Tmb = 25 °C")
    assert seen.get["n_vds"] == 3 and seen.get["agrees_vds"] == 2 and seen.get["n_id_conditions"] == 1
    other = spark.createDataFrame([("A", 40.0, None, None, None)], labels.schema)
    assert [r.rate for r in E.joined_agreement(catalogue, other).collect()] == [0.0]  # the sign counts


def test_winners_without_truth(spark):
    cases = spark.createDataFrame([([], ["a"], None), (None, ["a"], ["a"]), (["a"], None, ["b", None]), (["a"], ["a"], ["a"])], "truth_parts array<string>, retrieved array<string>, pool array<string>")
    assert [(r.saw_winner, r.winner_in_pool) for r in E.seen_winners(cases).collect()] == [(False, None), (False, False), (None, False), (True, True)]


def test_totals_beside_a_null_group(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a",), ("a",), (None,)], "d string")
    assert {tuple(r) for r in E.with_totals(df, "d", F.count(F.lit(1)).alias("n")).collect()} == {("a", False, 2), (None, False, 1), (None, True, 3)}


def test_name_check_skips_labels_without_figures(spark):
    rows = [("PSMN1R0-40YLD", -40.0, (1.05,)), ("PSMN1R0-40AAA", 30.0, (1.0,)), ("PSMN2R0-40YLD", 40.0, (3.0,)), ("PSMN3R0-40YLD", None, (3.0,)), ("PSMN4R0-40YLD", 40.0, None)]
    counts, shown = L.name_check_counts(spark.createDataFrame(rows, "part string, vds_v double, rdson_mohm struct<value:double>"))
    assert tuple(counts.first()) == (3, 2, 2) and [r.part for r in shown.collect()] == ["PSMN2R0-40YLD"]
