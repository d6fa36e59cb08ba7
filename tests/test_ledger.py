"""Models are asked once a text, whatever reads the answers."""

import uuid

import pytest
from pyspark.sql import functions as F

from brindle import models
from tests.test_engine import embed, engine, generate  # noqa: F401


class Noted:
    """A hook that leaves a file a call, so that calls on executors can be counted."""

    def __init__(self, folder, hook):
        self.folder, self.hook = str(folder), hook

    def __call__(self, asked):
        for text in asked if isinstance(asked, list) else [asked]:
            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(text)
        return self.hook(asked)


def notes(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def test_one_call_a_text(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    ledger = models.Ledger(spark, f"file://{tmp_path}/ledger")
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "prompt string, n int").repartition(3)
    answered = ledger.generate(df, Noted(calls, str.upper))
    for _ in range(2):
        assert sorted((r.n, r.answer) for r in answered.collect()) == [(1, "A"), (2, "B"), (3, "A"), (4, None)]
    more = ledger.generate(df.select("prompt").union(spark.createDataFrame([("c",)], "prompt string")), Noted(calls, str.upper), out="said")
    assert more.count() == 5 and notes(calls) == ["a", "b", "c"]
    assert {tuple(r.v) for r in ledger.embed(df.where("n < 3"), Noted(calls, lambda t: [[float(len(x))] for x in t]), "prompt", "v").collect()} == {(1.0,)}
    assert notes(calls) == ["a", "a", "b", "b", "c"]


def test_finished_tasks_are_not_asked_again(spark, tmp_path, monkeypatch):
    """A run that fails at one text leaves the others' answers; the next run asks for that text alone."""
    calls = tmp_path / "calls"
    calls.mkdir()
    monkeypatch.setattr(models.Ledger, "CALLS_A_TASK", 1)
    ledger = models.Ledger(spark, f"file://{tmp_path}/ledger")
    df = spark.createDataFrame([(f"text {i}",) for i in range(12)], "prompt string")

    def broken(prompt):
        if prompt == "text 7":
            import time

            time.sleep(6)
            raise models.ModelError("no", 400)
        return prompt

    with pytest.raises(Exception, match="no"):
        ledger.generate(df, Noted(calls, broken))
    first = notes(calls)
    assert ledger.generate(df, Noted(calls, lambda x: x)).where("answer = prompt").count() == 12
    again = sorted(set(notes(calls)) & {x for x in notes(calls) if notes(calls).count(x) > first.count(x)})
    assert "text 7" in again and len(again) < 12


def test_engine_asks_once(engine, spark, tmp_path):  # noqa: F811
    from brindle.engine import Engine

    calls = tmp_path / "calls"
    calls.mkdir()
    own = Engine(engine.catalogue, engine.index, Noted(calls, embed), Noted(calls, generate))
    asked = spark.createDataFrame([("a", "PXN020-40B?"), ("b", "PXN020-40B?")], "qid string, question string")
    answered = own.answer(asked)
    assert answered.count() == 2 and answered.count() == 2 and own.retrieve(asked).count() > 0
    assert len(notes(calls)) == 2  # one vector, one answer
    new = [("PXN010-40A#0", "PXN010-40A", 0, 1, "PXN010-40A new")]
    schema = "id string, document_id string, index int, total int, text string"
    for _ in range(3):
        own.ingest(spark.createDataFrame(new, schema))
        assert own.stats()["vectors"] == 3
    assert len(notes(calls)) == 3


def test_sets_in_a_batch(engine, spark):  # noqa: F811
    asked = [("a", "Which part has the lowest resistance?"), ("b", "How many are rated 99 V?"), ("c", "Which P-channel part carries most?")]
    rows = {r.qid: r for r in engine.answer_sets(spark.createDataFrame(asked, "qid string, question string")).collect()}
    assert (rows["a"].kind, rows["a"].parts, rows["a"].value, rows["a"].refused) == ("extremum", ["PXN010-40A"], 10.0, False)
    assert (rows["b"].route, rows["b"].kind, rows["b"].refused) == ("unsupported", None, True) and (rows["c"].kind, rows["c"].refused) == ("empty", True)
    assert engine.call(spark.createDataFrame([(1, "Question: 10 mΩ")], "qid int, prompt string")).first().answer == "10 mΩ"
    assert engine.answer_sets(spark.createDataFrame(asked[:1], "qid string, question string")).select(F.col("candidates")).first()[0] == 2
