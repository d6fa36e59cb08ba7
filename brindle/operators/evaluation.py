"""Evaluation: retrieval metrics, rates, percentiles, agreement and vocabulary audits."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import planning, retrieval
from brindle.sources.scratch import written


TOLERANCE = 0.01


def gold_ranks(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """1-based rank of each question's gold document, 0 when absent (ranked: qid, document_id, rank; gold: qid, gold)."""
    hit = ranked.join(gold, "qid").where(F.col("document_id") == F.col("gold")).groupBy("qid").agg(F.min("rank").alias("hit"))
    return gold.join(hit, "qid", "left").select("qid", F.coalesce("hit", F.lit(0)).cast("long").alias("rank"))


def recall_at(rank: Column, k: int) -> Column:
    return F.when(rank.between(1, k), 1.0).otherwise(0.0)


def reciprocal(rank: Column) -> Column:
    return F.when(rank > 0, 1.0 / rank).otherwise(0.0)


def ndcg_at(rank: Column, k: int) -> Column:
    return F.when(rank.between(1, k), 1.0 / F.log2(rank + 1.0)).otherwise(0.0)


def mean(x: Column, digits: int = 4) -> Column:
    """Mean rounded, 0 over nothing."""
    return F.coalesce(F.round(F.avg(x), digits), F.lit(0.0))


def rate(passes: Column, digits: int = 3) -> Column:
    """Share of rows that pass, 0 over nothing."""
    return mean(F.when(passes, 1.0).otherwise(0.0), digits)


def retrieval_metrics(ranks: DataFrame, *by: str, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Questions, recall at some depths, MRR and nDCG."""
    r = F.col("rank")
    return ranks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("questions"), *[mean(recall_at(r, k)).alias(f"recall_{k}") for k in ks], mean(reciprocal(r)).alias("mrr"),
        *[mean(ndcg_at(r, k)).alias(f"ndcg_{k}") for k in ks if k > 3],
    )


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The element at floor(n*p) of the sorted values, for each group.

    Equal values are counted first. The counts are range-partitioned by group and value, so that a group of many
    values spreads over partitions; a partition's running count begins after those before it.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    dealt = written(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()), "counts")
    parts = dealt.groupBy(*by, "_part").agg(F.sum("_n").alias("_in"))
    before = F.coalesce(F.sum("_in").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = parts.select(*by, "_part", before.alias("_before"), F.sum("_in").over(Window.partitionBy(*by)).alias("_total"))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy(value))
    placed = dealt.join(bases, [*by, "_part"]).withColumn("_upto", upto)
    at = lambda p: F.min(F.when(F.col("_upto") > F.floor(F.col("_total") * p), F.col(value)))
    return placed.groupBy(*by).agg(F.max("_total").alias("n"), *[at(p).alias(name) for name, p in shares.items()])


def sets_audit(df: DataFrame, catalogue: str, label: str, document: str) -> DataFrame:
    """Names fabricated, missed by the label and missed by the catalogue, and whether all label names are there."""
    minus = lambda a, b: F.array_sort(F.array_except(a, b))
    return df.withColumns({
        "fabricated": minus(catalogue, document),
        "missed_by_label": minus(document, label),
        "missed_by_catalogue": minus(document, catalogue),
        "all_of_label": F.size(F.array_except(label, catalogue)) == 0,
    })


def carries(figures: Column, cond_class: Column, value: Column | None = None, tolerance: float = 0.01) -> Column:
    """Some figure has this class, and this magnitude where one is given."""
    same = lambda m: T.class_of(m["conditions"]) == cond_class
    if value is None:
        return F.exists(figures, same)
    return F.exists(figures, lambda m: same(m) & T.near(m["value"], value, tolerance))


def agreement(df: DataFrame, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows and agreement rate of each field, over rows whose label has it (fields: name -> present, agrees)."""
    cells = F.array(*[F.struct(F.lit(n).alias("field"), p.alias("present"), a.alias("agrees")) for n, (p, a) in fields.items()])
    long = df.select(F.inline(cells)).where("present")
    return long.groupBy("field").agg(F.count(F.lit(1)).alias("n"), rate(F.col("agrees"), 4).alias("rate"))


def storage_curve(sizes: DataFrame, dims: int = 1024) -> DataFrame:
    """Stored dimensions and monthly cost of an index of some chunks (sizes: a chunks column)."""
    stored = F.col("chunks") * F.lit(dims)
    cost = F.round(F.greatest(F.lit(0.0), stored - 10_000_000.0) / 100_000_000.0 * 0.05, 4)
    return sizes.withColumns({"stored_dims": stored.cast("long"), "cost": cost})


def first_documents(chunks: DataFrame, n: int | None) -> DataFrame:
    """The chunks of the first n documents by id (None: all)."""
    if n is None:
        return chunks
    return chunks.join(chunks.select("document_id").distinct().orderBy("document_id").limit(n), "document_id", "left_semi")


def recall_curve(questions: DataFrame, chunks: DataFrame, sizes: dict[str, int | None], dims: int = 1024) -> DataFrame:
    """What growth costs: a row for each size of the index (its first n documents by id; None: all), with the documents and chunks it
    holds, its storage and cost, and the quality of dense and fused search over the questions whose gold document it holds.

    questions: qid, q_vec, gold, symbol (the document a question names, or null) and, if questions are chunks themselves, own; chunks:
    chunk_id, document_id, vec. Each size is searched as an index of its own. An index that answers no question has zeros.
    """
    held, hits = [], []
    for name, n in sizes.items():
        part = first_documents(chunks, n)
        asked = written(planning.in_index(questions, part, "gold"), "asked")
        gold = asked.select("qid", "gold")
        dense = retrieval.to_documents(retrieval.dense_search(asked.drop("gold", "symbol"), part))
        named = asked.where("symbol IS NOT NULL").withColumn("document_id", F.col("symbol")).drop("gold", "symbol")
        fused = retrieval.fuse([dense, retrieval.to_documents(retrieval.search_within(named, part))])
        both = gold_ranks(dense, gold).withColumnRenamed("rank", "dense").join(gold_ranks(fused.drop("score"), gold).withColumnRenamed("rank", "fused"), "qid")
        hits.append(written(both.select(F.lit(name).alias("size"), "dense", "fused"), "hits"))
        held.append(part.select(F.lit(name).alias("size"), "document_id"))
    whole = lambda tables: functools.reduce(DataFrame.unionByName, tables)
    figures = {f"{c}_{f}": m for c in ("dense", "fused") for f, m in (("recall_1", mean(recall_at(F.col(c), 1))), ("recall_5", mean(recall_at(F.col(c), 5))), ("mrr", mean(reciprocal(F.col(c)))))}
    quality = whole(hits).groupBy("size").agg(F.count(F.lit(1)).alias("questions"), *[m.alias(c) for c, m in figures.items()])
    stored = whole(held).groupBy("size").agg(F.countDistinct("document_id").alias("documents"), F.count(F.lit(1)).alias("chunks"))
    return storage_curve(stored, dims).join(quality, "size", "left").fillna(0, ["questions", *figures])


def joined_cells(catalogue: DataFrame, labels: DataFrame) -> DataFrame:
    """Six fields of catalogue rows (part, vds, rdson, id, package) beside the labels (part, vds_v, rdson_mohm, id_a, package) of their
    parts: part, field, agrees, catalogue, label; a row where the label has the field.

    The rating agrees with its sign within the tolerance; a figure where some row has its class and, within the tolerance, its magnitude; a class
    where some row has it; packages where all names of the label, cleaned as the catalogue's are, are there.
    """
    names = ("vds_v", "rdson_mohm", "id_a", "package")
    both = catalogue.join(labels.select("part", *[F.col(c).alias(f"l_{c}") for c in names]), "part")
    no_figures, no_names = F.array().cast("array<struct<value:double,unit:string,conditions:string>>"), F.array().cast("array<string>")
    read = both.withColumns({"rdson": F.coalesce("rdson", no_figures), "id": F.coalesce("id", no_figures), "package": F.coalesce("package", no_names), "l_package": T.clean_packages(F.coalesce("l_package", no_names))})
    label, there = F.col, lambda c: F.col(c).isNotNull()
    cls = lambda m: T.class_of(m["conditions"])
    printed = lambda c: F.array_join(F.transform(c, lambda m: F.concat(T.number_text(m["value"]), F.lit(" @ "), m["conditions"])), " | ")
    one = lambda c: F.concat(T.number_text(label(c)["value"]), F.lit(" @ "), label(c)["conditions"])
    classes = lambda c: F.array_join(F.array_distinct(F.transform(c, cls)), " | ")
    near = F.abs(F.col("vds") - F.col("l_vds_v")) <= F.abs("l_vds_v") * TOLERANCE
    cells = [("vds", there("l_vds_v"), near, T.number_text(F.col("vds")), T.number_text(F.col("l_vds_v")))]
    for field, c in (("rdson", "l_rdson_mohm"), ("id", "l_id_a")):
        cells.append((field, there(c), carries(F.col(field), cls(label(c)), label(c)["value"], TOLERANCE), printed(field), one(c)))
        cells.append((f"{field}_conditions", there(c), carries(F.col(field), cls(label(c))), classes(field), cls(label(c))))
    cells.append(("package", F.size("l_package") > 0, F.size(F.array_except("l_package", "package")) == 0, F.array_join("package", "|"), F.array_join("l_package", "|")))
    row = lambda n, p, a, said, wanted: F.struct(F.lit(n).alias("field"), p.alias("present"), F.coalesce(a, F.lit(False)).alias("agrees"), said.alias("catalogue"), wanted.alias("label"))
    return read.select("part", F.inline(F.array(*[row(*c) for c in cells]))).where("present").drop("present")


def joined_agreement(catalogue: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows and agreement rate of each field of joined_cells."""
    return joined_cells(catalogue, labels).groupBy("field").agg(F.count(F.lit(1)).alias("n"), rate(F.col("agrees"), 4).alias("rate"))


def joined_disagreements(catalogue: DataFrame, labels: DataFrame) -> tuple[DataFrame, Observation]:
    """Cells that disagree (part, field, catalogue, label), and an observation of the pass that makes them: n_FIELD and agrees_FIELD for each field."""
    seen, fields = Observation("agreement"), ("vds", "rdson", "id", "package", "rdson_conditions", "id_conditions")
    counts = [x for f in fields for x in (F.count_if(F.col("field") == f).alias(f"n_{f}"), F.count_if((F.col("field") == f) & F.col("agrees")).alias(f"agrees_{f}"))]
    return joined_cells(catalogue, labels).observe(seen, *counts).where(~F.col("agrees")).drop("agrees"), seen


def answered(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers with their questions (both by id); an answer to no known question is left out."""
    return answers.join(questions, "id")


def subset_by_id(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of some ids (one column); an id without a row fails the job."""
    found = ids.select(key).distinct().join(rows.withColumn("_there", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no row with {key} "), F.col(key).cast("string"))).cast("boolean")
    return found.where(F.when(F.col("_there"), True).otherwise(missing)).drop("_there")


def seen_winners(cases: DataFrame) -> DataFrame:
    """saw_winner and winner_in_pool of set-query cases (truth_parts, retrieved, pool): null where there is no list, false where no truth is in it."""
    truth = F.coalesce("truth_parts", F.array().cast("array<string>"))
    meets = lambda c: F.when(F.col(c).isNotNull(), F.coalesce(F.arrays_overlap(truth, c), F.lit(False)))
    return cases.withColumns({"saw_winner": meets("retrieved"), "winner_in_pool": meets("pool")})


def mechanism(cases: DataFrame) -> DataFrame:
    """Shares of winners retrieved, and of wrong answers that never saw the winner or had it in no pool, and the graded superlatives; nulls don't count."""
    wrong = F.col("outcome") == "wrong"
    share = lambda passes, among: mean(F.when(among, F.when(passes, 1.0).otherwise(0.0)), 4)
    return cases.agg(
        share(F.col("saw_winner"), F.col("saw_winner").isNotNull()).alias("winner_retrieved"),
        share(~F.col("saw_winner"), wrong & F.col("saw_winner").isNotNull()).alias("wrong_without_seeing_winner"),
        share(~F.col("winner_in_pool"), wrong & F.col("winner_in_pool").isNotNull()).alias("wrong_winner_not_in_pool"),
        F.count("winner_in_pool").alias("superlatives_graded"),
    )


def hallucinated_but_correct(graded: DataFrame) -> DataFrame:
    """Inventions, and the share of them whose figure begins with the expected value as printed (reason, found_text, value)."""
    bad = graded.where(F.col("reason") == "hallucinated")
    return bad.agg(F.count(F.lit(1)).alias("n"), rate(F.coalesce(starts_with_value(F.col("found_text"), F.col("value")), F.lit(False)), 4).alias("share"))


def guarded_rates(questions: DataFrame) -> DataFrame:
    """Share of questions the guard refuses, held out and indexed (holdout, refused)."""
    return questions.groupBy("holdout").agg(F.count(F.lit(1)).alias("n"), rate(F.col("refused"), 4).alias("refused"))


def with_totals(df: DataFrame, dimension: str, *aggregates: Column) -> DataFrame:
    """A breakdown and, in the row where is_total is true, the whole; one pass by grouping sets. A null dimension is a group like others."""
    total = (F.grouping_id() > 0).alias("is_total")
    return df.groupingSets([[F.col(dimension)], []], F.col(dimension)).agg(total, *aggregates)


def all_names(catalogue: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct names of two vocabularies (name), the longest first."""
    return catalogue.select("name").union(labels.select("name")).distinct().orderBy(F.desc(F.length("name")), "name")


def starts_with_value(found: Column, value: Column) -> Column:
    """The printed value begins what was found."""
    return F.startswith(found, T.number_text(value))
