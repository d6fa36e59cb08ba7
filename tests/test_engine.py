"""The engine's surface and model hooks, with stubs in the models' place."""

import json

import pytest
from pyspark.sql import functions as F

from brindle import errors, models
from brindle.engine import Engine
from brindle.operators import planning
from brindle.sources import readers

PARTS = {"PXN010-40A": [1.0, 0.0], "PXN020-40B": [0.0, 1.0]}


def embed(texts):
    """Texts that name a part point at it."""
    return [PARTS.get(next((p for p in PARTS if p in t), ""), [0.7, 0.7]) for t in texts]


def generate(prompt):
    if prompt.startswith("Turn"):
        question = prompt.rsplit("Question: ", 1)[1]
        if "lowest" in question:
            return json.dumps({"route": "catalog", "op": "min", "field": "rdson", "filters": {"vds": 40}})
        if "99" in question:
            return json.dumps({"route": "catalog", "op": "count", "filters": {"vds": 99}})
        return json.dumps({"route": "catalog", "op": "max", "field": "id", "filters": {"channel": "P"}})
    if prompt.startswith("Read"):
        return '{"channel": "N", "vds": 40, "package": "LFPAK56"}' if "PXN010" in prompt.split("as JSON")[0] else "nothing"
    return "10 mΩ" if "10 mΩ" in prompt else "NOT_IN_CORPUS"


@pytest.fixture(scope="module")
def engine(spark):
    figures = [(10.0, "mΩ", "VGS = 10 V; Tj = 25 °C")]
    rows = [(p, "N", 40.0, [(v + i, u, c) for v, u, c in figures], [], ["LFPAK56"]) for i, p in enumerate(PARTS)]
    chunks = [(f"{p}#{i}", p, f"{p}\nRDSon {10 + k} mΩ part {i}", v) for k, (p, v) in enumerate(PARTS.items()) for i in range(2)]
    index = spark.createDataFrame(chunks, "chunk_id string, document_id string, text string, vec array<float>")
    return Engine(spark.createDataFrame(rows, readers.CATALOGUE), index, embed, generate, token="t", base_url="https://docs/")


def test_ask_set(engine):
    found = engine.ask("Which part has the lowest resistance?")
    assert (found["route"], found["kind"], found["refused"]) == ("catalog", "extremum", False)
    assert "10 mΩ: PXN010-40A" in found["answer"] and found["sources"] == [{"part": "PXN010-40A", "url": "https://docs/PXN010-40A"}]
    assert engine.ask("How many are rated 99 V?") | {"ms": 0} == {"answer": "NOT_IN_CORPUS", "refused": True, "sources": [], "route": "catalog", "kind": "unsupported", "spec": None, "ms": 0}
    assert engine.ask("Which P-channel part carries most?")["kind"] == "empty"


def test_ask_document(engine):
    found = engine.ask("What is the resistance of PXN010-40A in LFPAK56?")
    assert found["answer"] == "10 mΩ" and found["sources"][0]["part"] == "PXN010-40A" and found["route"] == "document"
    assert engine.ask("What is the resistance of ABC123?")["refused"]
    with pytest.raises(errors.InvalidRequest) as e:
        engine.ask(" ")
    assert e.value.envelope()["error"]["code"] == "invalid_request" and e.value.status == 400
    with pytest.raises(errors.MissingHook) as e:
        Engine(engine.catalogue, engine.index).ask("How many?")
    assert e.value.hooks == ("generate",)


def test_batches(engine, spark):
    asked = spark.createDataFrame([("a", "PXN020-40B?"), ("b", "XYZ999?"), ("c", "about resistance")], "qid string, question string")
    first = {r.qid: r.document_id for r in engine.retrieve(asked).where("rank = 1").collect()}
    assert first["a"] == "PXN020-40B" and set(engine.retrieve(asked, "dense").columns) == {"qid", "document_id", "rank"}
    assert {r.qid: r.refused for r in engine.answer(asked).collect()} == {"a": False, "b": True, "c": False}
    with pytest.raises(errors.InvalidRequest):
        engine.retrieve(asked, "other")
    assert engine.stats() == {"vectors": 4, "dimensions": 2, "strategy": "hybrid-rrf"} and engine.questions().count() == 5


def test_ingest_and_extract(engine, spark):
    read = planning.parse_attributes(engine.extract(spark.createDataFrame([(p,) for p in PARTS], "part string"), "t")).collect()
    assert {r.part: (r.readable, r.vds) for r in read} == {"PXN010-40A": (True, 40.0), "PXN020-40B": (False, None)}
    with pytest.raises(errors.Unauthorised):
        engine.ingest(engine.index, "wrong")
    other = Engine(engine.catalogue, engine.index, embed, generate)
    new = spark.createDataFrame([("PXN010-40A#0", "PXN010-40A", 0, 1, "PXN010-40A new")], "id string, document_id string, index int, total int, text string")
    assert sorted((r.chunk_id, r.text) for r in other.ingest(new).collect() if r.document_id == "PXN010-40A") == [("PXN010-40A#0", "PXN010-40A new")]


def test_hooks(spark, one):
    with pytest.raises(Exception, match="2 texts gave 1 vectors"):
        models.embed(spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1), lambda t: [[1.0]]).collect()
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise models.ModelError("busy", 429)
        return "ok"

    assert models.with_retries(flaky, sleep=waits.append) == "ok" and waits == [1.0, 2.0, 4.0]
    with pytest.raises(models.ModelError):
        models.with_retries(lambda: (_ for _ in ()).throw(models.ModelError("no", 400)), sleep=waits.append)
    assert models.is_degenerate("ohm " * 20) and not models.is_degenerate("ohm " * 5)
    prompts = spark.createDataFrame([("p",)], "prompt string")
    assert models.generate(prompts, lambda p, seen=[]: seen.append(p) or ("ohm " * 20 if len(seen) < 2 else "fine")).first().answer == "fine"
    decode = lambda x: one(models.decode_response(F.lit(x)))
    assert decode('{"response": " a "}') == "a" and decode('{"choices": [{"message": {"content": "b"}}]}') == "b"
    assert decode('{"response": ""}') == decode("broken") == models.UNREADABLE


def test_files_and_downloads(spark, tmp_path):
    for name, text in (("A1.pdf", b"  layout   text " * 50), ("B2.pdf", b"\xff")):
        (tmp_path / name).write_bytes(text)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    layout = readers.extracted(files, lambda b: b.decode()).orderBy("part").collect()
    assert [(r.part, r.text is None, r.error is None) for r in layout] == [("A1", False, True), ("B2", True, False)]
    assert readers.judged(spark.createDataFrame([(None,), ("x",), ("y" * 500,)], "text string")).toPandas().status.tolist() == ["no text", "too short", "ok"]
    ids = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("d", False)], "id string, cached boolean")
    get = lambda i: {"a": (200, "application/pdf", b"x"), "b": (404, "text/html", None), "d": (200, "text/html", b"")}[i]
    status = {r.status: r.n for r in readers.fetch_status(readers.fetched(ids, get, 0.0)).collect()}
    assert status == {"ok": 2, "missing": 1, "failed": 1}
