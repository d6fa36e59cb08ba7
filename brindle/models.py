"""Model hooks: the caller injects embedders and generators; prompts, response decoding and retries are here.

Nothing in this module reaches a network. Hooks run in Arrow batches on executors, and no other part of the library needs them. A ledger records their calls.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.sources.scratch import file_system, scratch_path, written

Embedder = Callable[[list[str]], list[list[float]]]
Generator = Callable[[str], str]

UNREADABLE = "__UNREADABLE_RESPONSE__"
EMBED_BATCH = 32


class ModelError(Exception):
    """A model call failed; status as of HTTP."""

    def __init__(self, message: str, status: int = 500):
        super().__init__(message)
        self.status = status


def with_retries(call: Callable[[], object], attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> object:
    """Call again after 1, 2, 4, ... seconds where the model is overloaded or broken; other errors pass at once."""
    for attempt in range(attempts):
        try:
            return call()
        except ModelError as e:
            if attempt + 1 == attempts or (e.status < 500 and e.status != 429):
                raise
            sleep(2.0**attempt)
    return None


def embed(df: DataFrame, embedder: Embedder, text: str = "text", out: str = "embedding", batch: int = EMBED_BATCH) -> DataFrame:
    """Add a vector for each text. The model must give as many vectors as it gets texts."""
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                texts = part.column(text).to_pylist()
                vectors = with_retries(lambda texts=texts: embedder(texts))
                if len(vectors) != len(texts):
                    raise ModelError(f"{len(texts)} texts gave {len(vectors)} vectors")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], [*kept, out])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out}` array<float>"]))


def is_degenerate(text: str, min_words: int = 12, max_share: float = 0.3) -> bool:
    """preparation.is_degenerate for one string, beside a model."""
    words = pc.list_flatten(pc.split_pattern_regex(pa.array([text.lower()]), r"[^\p{L}\p{N}]+"))
    words = [w for w in words.to_pylist() if w]
    return len(words) >= min_words and max(map(words.count, set(words))) / len(words) > max_share


def generate(df: DataFrame, generator: Generator, prompt: str = "prompt", out: str = "answer") -> DataFrame:
    """Add the model's answer to each prompt; a degenerate answer is asked for once more."""
    kept = df.columns

    def answer(question: str) -> str:
        first = with_retries(lambda: generator(question))
        return with_retries(lambda: generator(question)) if is_degenerate(first) else first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            answers = [answer(x) for x in rows.column(prompt).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(answers, pa.string())], [*kept, out])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out}` string"]))


class Ledger:
    """A write-once record of one model's calls, in a folder that all executors share: each text is asked once, whatever reads the answers and however often.

    Calls go by the SHA-256 of their text. Texts without a record are found by an anti-join, each once, and asked in tasks of a bounded
    number; a task's answers are on record as soon as it commits, so a lost task repeats only its own, and a run after a failed one asks
    only for what is missing. Two runs at once may both ask; the least answer counts then. One ledger a model.
    """

    CALLS_A_TASK = 256

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "ledger")

    def _recorded(self, kind: str, schema: str) -> DataFrame:
        path = f"{self.path}/{kind}"
        files, target = file_system(self.spark, path)
        return self.spark.read.schema(schema).parquet(path) if files.exists(target) else self.spark.createDataFrame([], schema)

    def _answered(self, df: DataFrame, kind: str, text: str, out: str, result: str, call: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """df with the answers to its texts, asked for now where the ledger has none; null texts have null answers."""
        schema = f"_key string, _answer {result}"
        key = F.sha2(F.col(f"`{text}`"), 256).alias("_key")
        asked = df.select(key, F.col(f"`{text}`").alias("_text")).where("_text is not null").dropDuplicates(["_key"])
        missing = written(asked.join(self._recorded(kind, schema).select("_key"), "_key", "left_anti"), "missing")
        if n := missing.count():
            answers = call(missing.repartition(-(-n // self.CALLS_A_TASK), "_key")).select("_key", "_answer")
            # The second algorithm moves a task's file to its place when the task commits, not when all have.
            answers.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{self.path}/{kind}")
        once = self._recorded(kind, schema).groupBy("_key").agg(F.min("_answer").alias(out))
        return df.withColumn("_key", key).join(once, "_key", "left").select(*[F.col(f"`{c}`") for c in df.columns], out)

    def embed(self, df: DataFrame, embedder: Embedder, text: str = "text", out: str = "embedding") -> DataFrame:
        """models.embed, by the ledger."""
        return self._answered(df, "embed", text, out, "array<float>", lambda asked: embed(asked, embedder, "_text", "_answer"))

    def generate(self, df: DataFrame, generator: Generator, prompt: str = "prompt", out: str = "answer") -> DataFrame:
        """models.generate, by the ledger."""
        return self._answered(df, "generate", prompt, out, "string", lambda asked: generate(asked, generator, "_text", "_answer"))


def decode_response(raw: Column) -> Column:
    """The text of a model's JSON response, in either of two shapes; a sentinel where there is none."""
    v = F.try_parse_json(raw)
    at = lambda path: F.nullif(T.trim(F.try_variant_get(v, path, "string")), F.lit(""))
    return F.coalesce(at("$.response"), at("$.choices[0].message.content"), F.lit(UNREADABLE))


def answer_prompt(question: Column, evidence: Column) -> Column:
    """Prompt for one question over its evidence (array of struct part, text)."""
    shown = F.array_join(F.transform(evidence, lambda e: F.concat(F.lit("["), e["part"], F.lit("]\n"), T.visible(e["text"]))), "\n\n")
    rule = f"Use only the excerpts. Give figures with unit and conditions. If they don't answer the question, reply {T.REFUSAL}."
    return F.concat(F.lit(rule + "\n\n"), shown, F.lit("\n\nQuestion: "), question)


def planner_prompt(question: str, packages: list[str], ratings: list[float], classes: dict[str, list[str]]) -> str:
    """Prompt that asks for a plan as JSON over the vocabulary."""
    return (
        'Turn the question into JSON {"route": "catalog" | "lookup" | "unsupported", "op": "min" | "max" | "count", "field": "vds" | "rdson" | "id", '
        '"filters": {"channel", "vds", "package", "conditions"}}. Use only these values.\n'
        f"Packages: {', '.join(packages)}\nRatings: {', '.join(f'{r:g}' for r in ratings)}\n"
        + "".join(f"Conditions of {f}: {' | '.join(c)}\n" for f, c in classes.items())
        + f"Question: {question}"
    )


def extraction_prompt(part: Column, chunks: Column) -> Column:
    """Prompt that asks for a part's attributes as JSON, from its chunks (array of texts)."""
    ask = 'as JSON {"channel", "vds", "rdson": [{"value", "unit", "conditions"}], "id": [...], "package": [...]}, each figure with the conditions printed beside it.\n\n'
    return F.concat(F.lit("Read the attributes of "), part, F.lit(f" {ask}"), F.array_join(F.transform(chunks, lambda c: T.visible(c)), "\n\n"))
