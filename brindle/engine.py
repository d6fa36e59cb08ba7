"""The engine's surface: ask, stats, questions, ingest, retrieval and answers for batches, extraction."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle import errors, models
from brindle.functions import text as T
from brindle.operators import catalog, grading, names, planning, retrieval
from brindle.operators.cells import CellIndex
from brindle.sources import readers, sinks
from brindle.sources.scratch import written

STRATEGIES = ("dense", "dense+symbol", "hybrid-rrf")
#: What a part's attributes are looked for by, and how many chunks each finds.
PROBES = (("quick reference data ratings drain-source voltage current resistance", 12), ("ordering information package", 6))


class Engine:
    """Answers over a catalogue (readers.CATALOGUE) and a chunk index (chunk_id, document_id, text, vec).

    embed and generate are injected; without them only what needs no model works. symbols: identifiers that a query
    names (Column -> Column); by default what is left once the catalogue's package names are taken out. The vocabulary is computed once.
    Batches ask the models through a ledger (a folder; one of the session's own by default): one call a text, whatever reads the results.
    """

    def __init__(
        self, catalogue: DataFrame, index: DataFrame, embed: models.Embedder | None = None, generate: models.Generator | None = None,
        symbols: Callable[[Column], Column] | None = None, token: str | None = None, base_url: str = "", ledger: str | None = None,
    ):
        self.catalogue, self.index, self.base_url = catalogue, index, base_url
        self._embed, self._generate, self._token = embed, generate, token
        self.symbols = symbols
        self.spark: SparkSession = catalogue.sparkSession
        self.ledger = models.Ledger(self.spark, ledger)
        self._cells: tuple[DataFrame, CellIndex] | None = None

    @cached_property
    def vocabulary(self) -> planning.Vocabulary:
        return planning.Vocabulary.of(catalog.vocabulary(self.catalogue))

    def _needs(self, **hooks: object) -> None:
        if missing := [name for name, hook in hooks.items() if hook is None]:
            raise errors.MissingHook(*missing)

    def _allowed(self, token: str | None) -> None:
        if self._token is not None and token != self._token:
            raise errors.Unauthorised("wrong or missing token")

    def stats(self) -> dict:
        """Vectors, dimensions and strategy of the index."""
        row = readers.index_stats(self.index, "vec").first()
        return {"vectors": row["vectors"], "dimensions": row["dims"], "strategy": STRATEGIES[-1]}

    def questions(self) -> DataFrame:
        return readers.demo_questions(self.spark)

    def ask(self, question: str) -> dict:
        """Answer one question: answer, refused, sources, route, kind, spec, and milliseconds taken."""
        if not isinstance(question, str) or not question.strip():
            raise errors.InvalidRequest("question must be a text that isn't empty")
        began = time.perf_counter()
        found = self._ask_document(question) if names.python_named_parts(question, self.vocabulary.packages) else self._ask_set(question)
        return {**found, "ms": round((time.perf_counter() - began) * 1000)}

    def _refusal(self, route: str, kind: str | None = None, spec: object = None) -> dict:
        return {"answer": T.REFUSAL, "refused": True, "sources": [], "route": route, "kind": kind, "spec": spec}

    def _ask_set(self, question: str) -> dict:
        self._needs(generate=self._generate)
        v = self.vocabulary
        prompt = models.planner_prompt(question, list(v.packages), list(v.ratings), {f: list(c) for f, c in v.classes.items()})
        try:
            text = models.with_retries(lambda: self._generate(prompt))
        except models.ModelError as e:
            raise errors.ModelFailed(str(e)) from e
        route, spec = planning.parse_plan(text, v)
        if route != "catalog":
            return self._refusal("catalog", route)  # never falls through to the other route
        rows = catalog.run_query(self.catalogue, spec).withColumn("sentence", catalog.explain_column(spec)).collect()
        kind = rows[0]["kind"]
        if kind == "empty":
            return self._refusal("catalog", kind, spec)
        lead = "It depends on the conditions: " if kind == "ambiguous-conditions" else ""
        parts = list(dict.fromkeys(p for r in rows for p in r["parts"] or []))[:3]
        return {"answer": lead + "; ".join(r["sentence"] for r in rows), "refused": False, "sources": [self._source(p) for p in parts], "route": "catalog", "kind": kind, "spec": spec}

    def _ask_document(self, question: str) -> dict:
        asked = self.spark.createDataFrame([("q", question)], "qid string, question string")
        row = self.answer(asked).first()
        if row["refused"]:
            return self._refusal("document")
        return {"answer": row["answer"], "refused": False, "sources": [self._source(p) for p in row["retrieved"][:3]], "route": "document", "kind": None, "spec": None}

    def _source(self, part: str) -> dict:
        return {"part": part, "url": self.base_url + part}

    def _named(self, asked: DataFrame) -> DataFrame:
        """Questions with the identifiers they name (symbols)."""
        if self.symbols is not None:
            return asked.withColumn("symbols", self.symbols(F.col("question")))
        known = self.catalogue.select(F.explode("package").alias("name"))
        found = names.named_parts(asked.select(F.col("qid").alias("id"), F.col("question").alias("text")), known)
        return asked.join(found.select(F.col("id").alias("qid"), F.col("named").alias("symbols")), "qid")

    def cells(self) -> CellIndex:
        """The cells of the index as it is now; written once, until the next ingest."""
        if self._cells is None or self._cells[0] is not self.index:
            self._cells = (self.index, CellIndex.build(self.index))
        return self._cells[1]

    def _searches(self, questions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        self._needs(embed=self._embed)
        asked = written(self._named(self.ledger.embed(questions.select("qid", "question"), self._embed, "question", "q_vec")), "asked")
        # Both searches are read twice, for the ranking and for the evidence.
        dense = written(self.cells().search(asked.select("qid", "q_vec"), retrieval.K), "dense")
        named = asked.select("qid", "q_vec", F.explode("symbols").alias("document_id"))
        return asked, dense, written(retrieval.search_within(named, self.index), "within")

    def retrieve(self, questions: DataFrame, strategy: str = STRATEGIES[-1]) -> DataFrame:
        """Document ranking of each question (qid, question): qid, document_id, rank."""
        if strategy not in STRATEGIES:
            raise errors.InvalidRequest(f"strategy must be one of {', '.join(STRATEGIES)}")
        asked, dense, within = self._searches(questions)
        ranked = retrieval.to_documents(dense)
        if strategy == "dense":
            return ranked
        if strategy == "dense+symbol":
            return retrieval.rerank_symbols(ranked, asked.select("qid", F.explode("symbols").alias("document_id")))
        return retrieval.fuse([ranked, retrieval.to_documents(within)]).select("qid", "document_id", "rank")

    def answer(self, questions: DataFrame, guard: bool = True) -> DataFrame:
        """Answers of questions (qid, question): qid, answer, refused, retrieved. Refused questions reach no model."""
        self._needs(generate=self._generate)
        asked, dense, within = self._searches(questions)
        ranked = retrieval.fuse([retrieval.to_documents(dense), retrieval.to_documents(within)])
        lists = ranked.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "document_id"))), lambda x: x["document_id"]).alias("retrieved"))
        chosen = retrieval.evidence(within, dense).join(self.index.select("chunk_id", "text"), "chunk_id")
        shown = chosen.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("document_id").alias("part"), "text"))), lambda x: F.struct(x["part"], x["text"])).alias("evidence"))
        whole = asked.join(lists, "qid", "left").join(shown, "qid", "left")
        stops = F.col("evidence").isNull() | (grading.guard_refuses(F.col("symbols"), F.coalesce("retrieved", F.array().cast("array<string>"))) if guard else F.lit(False))
        whole = whole.withColumn("_stops", stops)
        prompts = whole.where(~F.col("_stops")).select("qid", models.answer_prompt(F.col("question"), F.col("evidence")).alias("prompt"))
        said = self.ledger.generate(prompts, self._generate).select("qid", "answer")
        joined = whole.select("qid", "retrieved").join(said, "qid", "left").withColumn("answer", F.coalesce("answer", F.lit(T.REFUSAL)))
        return joined.select("qid", "answer", F.col("answer").contains(T.REFUSAL).alias("refused"), F.coalesce("retrieved", F.array().cast("array<string>")).alias("retrieved"))

    def call(self, prompts: DataFrame) -> DataFrame:
        """The model's plain answers to prompts (qid, prompt): qid, answer."""
        self._needs(generate=self._generate)
        return self.ledger.generate(prompts.select("qid", "prompt"), self._generate).select("qid", "answer")

    def answer_sets(self, questions: DataFrame) -> DataFrame:
        """Answers of set questions (qid, question), planned by the model and run in one plan: qid, route, kind, cond_class, value, unit, parts, candidates, refused.

        A row a class, as run_query gives them. What the vocabulary doesn't bear out is refused, and never answered by the other route.
        """
        self._needs(generate=self._generate)
        v = self.vocabulary
        lead = models.planner_prompt("", list(v.packages), list(v.ratings), {f: list(c) for f, c in v.classes.items()})
        said = self.call(questions.select("qid", F.concat(F.lit(lead), "question").alias("prompt")))
        plans = written(planning.check_plans(said.select(F.col("qid").alias("id"), F.col("answer").alias("text")), catalog.vocabulary(self.catalogue)), "plans")
        found = catalog.run_queries(self.catalogue, plans.where("route = 'catalog'").withColumnRenamed("id", "qid"))
        joined = plans.select(F.col("id").alias("qid"), "route").join(found, "qid", "left")
        return joined.withColumn("refused", F.coalesce(F.col("kind") == "empty", F.lit(True)))

    def ingest(self, chunks: DataFrame, token: str | None = None) -> DataFrame:
        """The index after chunks (id, document_id, index, total, text) replace their documents' chunks; stale ones go."""
        self._allowed(token)
        self._needs(embed=self._embed)
        batch = self.ledger.embed(sinks.guarded(chunks, "document_id", "text", "index"), self._embed, "text", "vec")
        renamed = batch.withColumnRenamed("id", "chunk_id").select("chunk_id", "document_id", "text", "vec")
        kept = self.index.withColumnRenamed("chunk_id", "id")
        kept = sinks.prune(kept, chunks).withColumnRenamed("id", "chunk_id").select("chunk_id", "document_id", "text", "vec")
        self.index = written(sinks.upsert(kept, renamed, "chunk_id"), "index")
        return self.index

    def extract(self, parts: DataFrame, token: str | None = None) -> DataFrame:
        """Attributes of parts (part), read by the model from the chunks that two probes find in each part's document."""
        self._allowed(token)
        self._needs(embed=self._embed, generate=self._generate)
        vectors = models.with_retries(lambda: self._embed([p for p, _ in PROBES]))
        searches = []
        for vector, (_, k) in zip(vectors, PROBES, strict=True):
            probe = parts.select(F.col("part").alias("qid"), F.col("part").alias("document_id"), F.lit(vector).cast("array<float>").alias("q_vec"))
            searches.append(retrieval.search_within(probe, self.index, k))
        chunks = retrieval.first_seen(searches).join(self.index.select("chunk_id", "text"), "chunk_id")
        texts = chunks.groupBy(F.col("qid").alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"))
        prompts = texts.select("part", models.extraction_prompt(F.col("part"), F.col("texts")).alias("prompt"))
        return self.ledger.generate(prompts, self._generate, out="text").select("part", "text")
