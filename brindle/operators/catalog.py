"""Catalogue queries: counts and extrema with ties, comparable only within a condition class.

A catalogue row: part, channel, vds, package (array of names), rdson and id (arrays of struct value,
unit, conditions). All operators take and return DataFrames; nothing is collected, except by vocabulary lookups of the
planner.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.functions.joins import beside

FIELDS = ("vds", "rdson", "id")


@dataclass(frozen=True)
class QuerySpec:
    """What a set question asks: op (min, max, count), a field, and filters."""

    op: str
    field: str | None = None
    channel: str | None = None
    vds: float | None = None
    package: str | None = None
    conditions: str | None = None


def channel_of() -> Column:
    """The channel as read; the rating's sign stands in for a null one."""
    return F.coalesce("channel", F.when(F.col("vds") < 0, "P").when(F.col("vds").isNotNull(), "N"))


def matches(rows: DataFrame, spec: QuerySpec) -> DataFrame:
    """Rows that pass the channel, rating and package filters."""
    if spec.channel is not None:
        rows = rows.where(channel_of() == spec.channel)
    if spec.vds is not None:
        rows = rows.where(F.abs("vds") == spec.vds)
    if spec.package is not None:
        rows = rows.where(F.exists("package", lambda p: T.same(p, F.lit(spec.package))))
    return rows


def candidates(rows: DataFrame, field: str) -> DataFrame:
    """One row for each figure that competes: part, value (magnitude), cond_class."""
    if field == "vds":
        return rows.where("vds is not null").select("part", F.abs("vds").alias("value"), F.lit(None).cast("string").alias("cond_class"))
    inside = rows.select("part", F.explode(field).alias("m"))
    return inside.select("part", F.abs("m.value").alias("value"), T.class_of(F.col("m.conditions")).alias("cond_class"))


def pool(rows: DataFrame, spec: QuerySpec) -> DataFrame:
    """Distinct parts that compete; the class is compared exactly, and excludes all where the field has none."""
    found = candidates(matches(rows, spec), spec.field or "rdson")
    if spec.conditions is not None:
        found = found.where(F.col("cond_class") == T.class_of(F.lit(spec.conditions)))
    return found.select("part").distinct()


def extrema(found: DataFrame, op: str) -> DataFrame:
    """For each class: best value, all parts that tie at it, and how many parts compete.

    Each part's best comes first, as a partial aggregate; then a class needs a row a part. The class's best
    joins back, a handful of rows.
    """
    pick = F.min if op == "min" else F.max
    per_part = found.groupBy("cond_class", "part").agg(pick("value").alias("value"))
    best = per_part.groupBy("cond_class").agg(pick("value").alias("best"), F.count(F.lit(1)).alias("candidates"))
    tied = per_part.alias("p").join(best.alias("b"), F.col("p.cond_class").eqNullSafe(F.col("b.cond_class")) & (F.col("p.value") == F.col("b.best")))
    return tied.groupBy(F.col("b.cond_class").alias("cond_class"), "best", "candidates").agg(F.array_sort(F.collect_list("p.part")).alias("parts"))


def run_query(rows: DataFrame, spec: QuerySpec) -> DataFrame:
    """Answer a set question: kind, cond_class, value, unit, parts, candidates; one row a class.

    kind: count, extremum, ambiguous-conditions (several classes and none was named) or empty.
    """
    passing = matches(rows, spec)
    null = lambda kind: F.lit(None).cast(kind)
    if spec.op == "count":
        return passing.agg(F.count(F.lit(1)).alias("candidates")).select(
            F.lit("count").alias("kind"), null("string").alias("cond_class"), F.col("candidates").cast("double").alias("value"),
            null("string").alias("unit"), null("array<string>").alias("parts"), "candidates",
        )
    found = candidates(passing, spec.field)
    if spec.field != "vds" and spec.conditions is not None:
        found = found.where(T.same(F.col("cond_class"), T.class_of(F.lit(spec.conditions))))
        found = found.withColumn("cond_class", T.class_of(F.lit(spec.conditions)))
    groups = extrema(found, spec.op)
    classes = groups.agg(F.count(F.lit(1)).alias("classes"))
    kind = F.when(F.col("classes") > 1, "ambiguous-conditions").when(F.col("classes") == 1, "extremum").otherwise("empty")
    # One row of counts stands on the left, so that an empty answer has a row too.
    joined = classes.join(groups, F.lit(True), "left")
    return joined.select(
        kind.alias("kind"), "cond_class", F.col("best").alias("value"), F.lit(T.unit_of(spec.field)).alias("unit"),
        "parts", F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"),
    ).orderBy(F.desc("candidates"), "cond_class")


def explain_column(spec: QuerySpec) -> Column:
    """A sentence for each row of a run_query result."""
    names = {"rdson": "R_DS(on)", "id": "I_D", "vds": "V_DS"}
    parts = F.when(F.size("parts") == 1, F.get("parts", F.lit(0))).otherwise(
        F.concat(F.array_join(F.slice("parts", F.lit(1), F.greatest(F.size("parts") - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at("parts", -1))
    )
    value = F.concat_ws(" ", T.number_text(F.col("value")), "unit")
    word = "lowest" if spec.op == "min" else "highest"
    what = f"{word} {names.get(spec.field, '')}"
    filters = [f"{spec.channel}-channel"] if spec.channel else []
    filters += [f"rated {spec.vds:g} V"] if spec.vds is not None else []
    filters += [f"in a {spec.package} package"] if spec.package else []
    tail = " " + ", ".join(filters) if filters else ""
    n = T.number_text(F.col("candidates"))
    where = F.when(F.col("cond_class").isNotNull(), F.concat(F.lit(", specified at "), "cond_class", F.lit(","))).otherwise("")
    return (
        F.when(F.col("kind") == "count", F.concat(n, F.when(F.col("candidates") == 1, " part").otherwise(" parts"), F.lit(f" in this corpus{tail}.")))
        .when(F.col("kind") == "extremum", F.concat(F.lit("Of the "), n, F.lit(" parts in this corpus"), where, F.lit(f" the {what} is "), value, F.lit(": "), parts, F.lit(".")))
        .when(F.col("kind") == "ambiguous-conditions", F.concat(F.lit("at "), "cond_class", F.lit(": "), value, F.lit(" ("), parts, F.lit(", of "), n, F.lit(" parts)")))
        .otherwise(T.REFUSAL)
    )


def vocabulary(rows: DataFrame) -> DataFrame:
    """Every name, rating and condition class that occurs: kind and term, distinct."""
    term = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), c.alias("term"))
    found = term(rows.select(F.explode("package").alias("p")), "package", F.col("p"))
    found = found.unionByName(term(rows.where("vds is not null"), "rating", T.number_text(F.abs("vds"))))
    for field in ("rdson", "id"):
        found = found.unionByName(term(candidates(rows, field), f"{field}_class", F.col("cond_class")))
    return found.distinct()


def conservative_dedupe(measurements: DataFrame, keys: list[str]) -> DataFrame:
    """For each key and class the figure of the largest magnitude, with its sign; the first place wins ties.

    measurements: keys, cond_class, value, conditions, pos. The conditions kept are those of the first row.
    """
    return measurements.groupBy(*keys, "cond_class").agg(
        F.max_by("value", F.struct(F.abs("value"), -F.col("pos"))).alias("value"), F.min_by("conditions", "pos").alias("conditions")
    )


def _key(x: Column) -> Column:
    return F.lower(T.trim(x))


def run_queries(rows: DataFrame, specs: DataFrame, by_part: bool = False, rated: str = "vds", listed: bool = True) -> DataFrame:
    """Answer many set questions in one plan: qid, kind, cond_class, value, unit, parts, candidates; rows as run_query gives them for each.

    specs: qid, op, field, channel, vds, package, conditions, where null filters let every row pass. Specs that ask for the same rows share one
    key. A figure is keyed once for each set of filters that some spec uses (16 sets at most) and each of its packages, and meets the specs' keys by equality; one grouped pass by
    key, class and part, then by key and class, finds minima and maxima together. A spec's op is applied last, so that all
    specs of a key share its groups. Repeated part rows count as run_query counts them, or once a part if told by_part; null ops or unknown fields find nothing.

    Keys are broadcast by their counted number, figures never; a row's figures come down to its least and greatest of a class before they are keyed.
    rated: the column whose magnitude competes as the rating; filters go by vds. Unless listed, n_parts and first_part stand in place of parts, and no list is made.
    """
    nothing, low = F.lit(""), F.lit(-1.0)
    asked = F.when((F.col("op") != "count") & (F.col("field") != "vds"), class_key(F.col("conditions")))
    bits = [F.col("channel").isNotNull(), F.col("vds").isNotNull(), F.col("package").isNotNull(), asked.isNotNull()]
    pattern = sum((F.when(bit, 1 << i).otherwise(0) for i, bit in enumerate(bits)), F.lit(0))
    key = ["_field", "_pattern", "_channel", "_rating", "_package", "_class"]
    wanted = specs.where("op in ('min', 'max', 'count')").select(
        "qid", "op", F.when(F.col("op") == "count", "count").otherwise(F.col("field")).alias("_field"), pattern.alias("_pattern"), F.coalesce("channel", nothing).alias("_channel"),
        F.coalesce(F.abs(F.col("vds").cast("double")), low).alias("_rating"), F.coalesce(_key(F.col("package")), nothing).alias("_package"), F.coalesce(_key(asked), nothing).alias("_class"), asked.alias("_asked"),
    )
    keys = wanted.select(*key).distinct()
    counts_of = keys.groupBy("_pattern").count().collect()  # 16 rows at most
    used, asked_keys = [r[0] for r in counts_of], beside(keys, sum(r[1] for r in counts_of))
    kind = "struct<_pattern:int,_channel:string,_rating:double,_package:string,_class:string>"

    def keyed(figures: DataFrame) -> DataFrame:
        """Figures (part, channel, rating, names, _field, cls and others) under every key that may ask for them."""
        each = []
        for p in used:
            filters = ((0, F.col("channel"), nothing, "_channel"), (1, F.col("rating"), low, "_rating"), (3, F.col("cls"), nothing, "_class"))
            channel, rating, cls = ((value if p >> i & 1 else other).alias(name) for i, value, other, name in filters)
            lead = (F.lit(p).alias("_pattern"), channel, rating)
            names = F.col("names") if p >> 2 & 1 else F.array(nothing)
            each.append(F.transform(names, lambda name: F.struct(*lead, name.alias("_package"), cls)))  # noqa: B023
        found = F.coalesce(F.flatten(F.array(*[F.coalesce(x, F.array().cast(f"array<{kind}>")) for x in each])), F.array().cast(f"array<{kind}>")) if each else F.array().cast(f"array<{kind}>")
        kept = [c for c in figures.columns if c not in ("channel", "rating", "names", "cls")]
        return figures.withColumn("_k", F.explode(found)).select(*kept, "_k.*").join(asked_keys, key)

    names = F.array_compact(F.array_distinct(F.transform("package", _key)))
    flat = rows.select("part", channel_of().alias("channel"), F.abs("vds").alias("rating"), names.alias("names"), F.abs(rated).alias("rated"), "rdson", "id")
    counts = keyed(flat.select("part", "channel", "rating", "names", F.lit("count").alias("_field"), F.lit(None).cast("string").alias("cls")))
    counted = counts.groupBy(*key).agg((F.countDistinct("part") if by_part else F.count(F.lit(1))).alias("candidates"))
    figure = "array<struct<_field:string,value:double,conditions:string>>"
    of = lambda name: F.coalesce(F.transform(name, lambda m: F.struct(F.lit(name).alias("_field"), F.abs(m["value"]).alias("value"), m["conditions"].alias("conditions"))), F.array().cast(figure))
    rating = F.when(F.col("rated").isNotNull(), F.array(F.struct(F.lit("vds").alias("_field"), F.col("rated").alias("value"), F.lit(None).cast("string").alias("conditions")))).otherwise(F.array().cast(figure))
    long = flat.withColumn("_m", F.explode(F.concat(rating, of("rdson"), of("id")))).select("part", "channel", "rating", "names", "_m.*")
    classed = long.withColumn("cond_class", F.when(F.col("_field") != "vds", T.class_of(F.col("conditions"))))
    ends = classed.groupBy("part", "channel", "rating", "names", "_field", "cond_class").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    figures = keyed(ends.withColumn("cls", _key(F.col("cond_class"))))
    # A named class is one group however its figures spell it; the rating has no classes.
    group = F.when((F.col("_pattern").bitwiseAND(F.lit(8)) == 0) & (F.col("_field") != "vds"), F.col("cond_class"))
    per_part = figures.select(*key, "part", "low", "high", F.coalesce(group, nothing).alias("_group"), group.isNull().alias("_whole")).groupBy(*key, "_group", "_whole", "part").agg(F.min("low").alias("min"), F.max("high").alias("max")).repartition(*key, "part")
    best = per_part.groupBy(*key, "_group", "_whole").agg(F.min("min").alias("_min"), F.max("max").alias("_max"), F.count(F.lit(1)).alias("candidates"))
    tied = per_part.join(best, [*key, "_group", "_whole"]).where((F.col("min") == F.col("_min")) | (F.col("max") == F.col("_max")))
    at = lambda x: F.when(F.col(x) == F.col(f"_{x}"), F.col("part"))
    ties = {"parts": lambda x: F.array_sort(F.collect_list(at(x)))} if listed else {"n_parts": lambda x: F.count(at(x)).cast("int"), "first_part": lambda x: F.min(at(x))}
    groups = tied.groupBy(*key, "_group", "_whole", "_min", "_max", "candidates").agg(*[f(x).alias(f"_{x}_{c}") for c, f in ties.items() for x in ("min", "max")])
    # Classes are counted a key, so that nothing moves once the groups have met their specs.
    answers = wanted.where("op <> 'count'").join(groups.withColumn("_classes", F.count(F.lit(1)).over(Window.partitionBy(*key))), key, "left")
    classes = F.coalesce("_classes", F.lit(0))
    least = F.col("op") == "min"
    pick = lambda x, y: F.when(F.col("candidates").isNotNull(), F.when(least, F.col(x)).otherwise(F.col(y)))
    units = F.create_map(*[F.lit(x) for f in FIELDS for x in (f, T.unit_of(f))])
    extrema_ = answers.select(
        "qid", F.when(classes > 1, "ambiguous-conditions").when(classes == 1, "extremum").otherwise("empty").alias("kind"),
        F.when(F.col("candidates").isNotNull(), F.coalesce("_asked", F.when(~F.col("_whole"), F.col("_group")))).alias("cond_class"), pick("_min", "_max").alias("value"), F.element_at(units, F.col("_field")).alias("unit"),
        *[pick(f"_min_{c}", f"_max_{c}").alias(c) for c in ties], F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"),
    )
    n = F.coalesce("candidates", F.lit(0)).cast("long")
    null = lambda kind: F.lit(None).cast(kind)
    totals = wanted.where("op = 'count'").join(counted, key, "left").select("qid", F.lit("count").alias("kind"), null("string").alias("cond_class"), n.cast("double").alias("value"), null("string").alias("unit"), *[null(extrema_.schema[c].dataType).alias(c) for c in ties], n.alias("candidates"))
    return extrema_.unionByName(totals)


def class_key(conditions: Column) -> Column:
    """class_of conditions, null where there are none."""
    return F.when(conditions.isNotNull(), T.class_of(conditions))
