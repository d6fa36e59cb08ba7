"""Planning and routing: JSON recovered from text, checked against the vocabulary; identifiers; the set-question generator."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators.catalog import FIELDS, QuerySpec, candidates, extrema
from brindle.operators.names import named_parts


@dataclass(frozen=True)
class Vocabulary:
    """Names, ratings and condition classes of a catalogue."""

    packages: tuple[str, ...] = ()
    ratings: tuple[float, ...] = ()
    classes: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def of(cls, terms: DataFrame, max_terms: int = 100_000) -> Vocabulary:
        """From catalog.vocabulary's rows. More distinct terms than the bound are an error, not a driver out of memory: check_plans joins instead."""
        found: dict[str, list[str]] = {}
        terms = terms.distinct()
        if (n := terms.count()) > max_terms:
            raise ValueError(f"{n} terms are over the bound of {max_terms}; check plans by check_plans")
        for row in terms.orderBy("kind", "term").collect():
            found.setdefault(row["kind"], []).append(row["term"])
        ratings = tuple(sorted(map(float, found.get("rating", ()))))
        return cls(tuple(found.get("package", ())), ratings, {f: tuple(found.get(f"{f}_class", ())) for f in ("rdson", "id")})


def python_class_of(conditions: str) -> str:
    """class_of for one string on the driver, where a single question is planned."""
    flags = re.IGNORECASE
    terms = [t.strip() for t in conditions.split(";")]
    kept = [t for t in terms if re.search(r"^(V(?:GS|DS)|T(?:j|mb|amb)|ID)\s*=|^t\s*[≤<]", t, flags)]
    return "; ".join(sorted(t for t in kept if not re.match(r"ID\s*=", t, flags)))


def _no_number(name: str) -> float:
    raise ValueError(name)


def parse_plan(text: str, vocabulary: Vocabulary) -> tuple[str, QuerySpec | None]:
    """Route and spec of a planner's answer.

    One grammar, here and in check_plans: op, field and filters stand in the plan or in its spec. A count's field is ignored. Filters of a wrong type, and
    any beside the filters, are ignored; a rating or package that the vocabulary lacks makes the plan unsupported; unknown conditions are
    dropped, and so are conditions on the rating.
    """
    found = re.search(r"\{.*\}", text, re.DOTALL)
    try:
        plan = json.loads(found.group(), parse_constant=_no_number) if found else None
    except ValueError:
        plan = None
    route = plan.get("route") if isinstance(plan, dict) else None
    if route != "catalog":
        return "lookup" if route == "lookup" else "unsupported", None
    body = plan["spec"] if isinstance(plan.get("spec"), dict) else plan
    op, wanted = body.get("op"), None if body.get("op") == "count" else body.get("field")
    if op not in ("min", "max", "count") or (op != "count" and wanted not in FIELDS):
        return "unsupported", None
    filters = body["filters"] if isinstance(body.get("filters"), dict) else {}
    channel = filters.get("channel") if filters.get("channel") in ("N", "P") else None
    vds = filters.get("vds")
    vds = float(abs(vds)) if isinstance(vds, int | float) and not isinstance(vds, bool) else None
    if vds is not None and vds not in vocabulary.ratings:
        return "unsupported", None
    package = filters.get("package") if isinstance(filters.get("package"), str) else None
    if package is not None:
        package = next((p for p in vocabulary.packages if p.strip().lower() == package.strip().lower()), None)
        if package is None:
            return "unsupported", None
    conditions = filters.get("conditions") if isinstance(filters.get("conditions"), str) and wanted != "vds" else None
    if conditions is not None:
        key = python_class_of(conditions).lower()
        conditions = next((c for c in vocabulary.classes.get(wanted or "rdson", ()) if c.lower() == key), None)
    return "catalog", QuerySpec(op, wanted, channel, vds, package, conditions)


def read_plans(plans: DataFrame) -> DataFrame:
    """Plans (id, text) as columns by parse_plan's grammar, before the vocabulary: id, route, op, field, channel, vds, package, conditions."""
    whole = F.try_parse_json(T.json_object(F.col("text")))
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(F.col("_v"), path, "variant")), F.lit("VOID"))
    read = plans.select("id", whole.alias("_v"))
    read = read.withColumn("_nested", kind("$.spec").startswith("OBJECT"))
    either = lambda path, of: F.when(F.col("_nested"), of(f"$.spec.{path}")).otherwise(of(f"$.{path}"))
    text = lambda path: F.when(kind(path) == "STRING", F.try_variant_get(F.col("_v"), path, "string"))
    number = lambda path: F.when(kind(path).rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"), F.try_variant_get(F.col("_v"), path, "double"))
    typed = read.select(
        "id", text("$.route").alias("_route"), either("op", text).alias("_op"), either("field", text).alias("_field"), either("filters.channel", text).alias("_channel"),
        F.abs(either("filters.vds", number)).alias("_vds"), either("filters.package", text).alias("_package"), either("filters.conditions", text).alias("_conditions"),
    )
    count = F.col("_op") == "count"
    fits = F.coalesce((F.col("_route") == "catalog") & (count | (F.col("_op").isin("min", "max") & F.col("_field").isin(*FIELDS))), F.lit(False))
    route_ = F.when(fits, "catalog").when(F.col("_route") == "lookup", "lookup").otherwise("unsupported")
    only = lambda c, name: F.when(fits, c).alias(name)
    field_ = F.when(~count, F.col("_field"))
    under = F.when(F.coalesce(field_, F.lit("rdson")) != "vds", F.col("_conditions"))
    channel = F.when(F.col("_channel").isin("N", "P"), F.col("_channel"))
    return typed.select("id", route_.alias("route"), only(F.col("_op"), "op"), only(field_, "field"), only(channel, "channel"), only(F.col("_vds"), "vds"), only(F.col("_package"), "package"), only(under, "conditions"))


def parse_plans(plans: DataFrame) -> DataFrame:
    """What read_plans reads of the route, the op, its field, rating and package."""
    return read_plans(plans).select("id", "route", "op", "field", "vds", "package")


def check_plans(plans: DataFrame, terms: DataFrame) -> DataFrame:
    """Plans (id, text) read and checked against catalog.vocabulary's rows, all in joins: id, route, op, field, channel, vds, package, conditions.

    parse_plan's grammar: an unknown rating or package makes a plan unsupported; the package takes its true spelling; unknown conditions are dropped.
    """
    key = lambda c: F.lower(T.trim(c))
    ratings = terms.where("kind = 'rating'").select(F.col("term").cast("double").alias("_rating")).distinct()
    names = terms.where("kind = 'package'").groupBy(key(F.col("term")).alias("_package")).agg(F.min("term").alias("_name"))
    classes = terms.where("kind in ('rdson_class', 'id_class')").groupBy("kind", F.lower("term").alias("_class")).agg(F.min("term").alias("_conditions"))
    asked = F.lower(T.class_of(F.col("conditions")))
    found = (
        read_plans(plans).withColumns({"_named": key(F.col("package")), "_asked": asked, "_kind": F.concat(F.coalesce("field", F.lit("rdson")), F.lit("_class"))})
        .join(ratings, F.col("vds") == F.col("_rating"), "left").join(names, F.col("_named") == F.col("_package"), "left")
        .join(classes, (F.col("_kind") == F.col("kind")) & (F.col("_asked") == F.col("_class")), "left")
    )
    known = (F.col("vds").isNull() | F.col("_rating").isNotNull()) & (F.col("_named").isNull() | F.col("_name").isNotNull())
    only = lambda c, name: F.when(known, c).alias(name)
    route_ = F.when(known, F.col("route")).otherwise("unsupported")
    return found.select("id", route_.alias("route"), *[only(F.col(c), c) for c in ("op", "field", "channel", "vds")], only(F.col("_name"), "package"), only(F.col("_conditions"), "conditions"))


def part_questions(labels: DataFrame) -> DataFrame:
    """Questions on single parts with their truth: id, part, dimension, split, question, value, unit, names.

    labels: part, vds_v, rdson_mohm, id_a (structs with value and conditions), package. Conditions stand in the question where there are any.
    """
    under = lambda m: F.when(F.coalesce(m["conditions"], F.lit("")) != "", F.concat(F.lit(" at "), m["conditions"])).otherwise("")
    part = F.col("part")
    none = F.lit(None).cast("array<string>")

    def asked(dimension: str, words: str, condition: Column, value: Column, unit: str | None, names: Column, there: Column) -> Column:
        text = F.concat(F.lit(f"What is the {words} of "), part, condition, F.lit("?"))
        return F.when(there, F.struct(F.lit(dimension).alias("dimension"), text.alias("question"), value.cast("double").alias("value"), F.lit(unit).cast("string").alias("unit"), names.alias("names")))

    figure = lambda c: F.col(c)["value"]
    each = F.array_compact(F.array(
        asked("vds", "drain-source voltage rating", F.lit(""), F.col("vds_v"), "V", none, F.col("vds_v").isNotNull()),
        asked("rdson", "on-state resistance", under(F.col("rdson_mohm")), figure("rdson_mohm"), "mΩ", none, figure("rdson_mohm").isNotNull()),
        asked("id", "drain current", under(F.col("id_a")), figure("id_a"), "A", none, figure("id_a").isNotNull()),
        asked("package", "package", F.lit(""), F.lit(None), None, F.col("package"), F.coalesce(F.size("package") > 0, F.lit(False))),
    ))
    split = F.when(T.is_holdout(part), "holdout").otherwise("indexed").alias("split")
    return labels.select("part", split, F.inline(each)).select(F.concat_ws(":", "part", "dimension").alias("id"), "part", "dimension", "split", "question", "value", "unit", "names")


def question_summary(questions: DataFrame) -> DataFrame:
    """Questions and distinct parts by dimension and split."""
    return questions.groupBy("dimension", "split").agg(F.count(F.lit(1)).alias("questions"), F.countDistinct("part").alias("parts"))


def in_index(questions: DataFrame, chunks: DataFrame, part: str = "part") -> DataFrame:
    """Questions whose part the index holds (chunks: document_id)."""
    return questions.join(chunks.select(F.col("document_id").alias(part)).distinct(), part, "left_semi")


def parse_attributes(rows: DataFrame) -> DataFrame:
    """Attribute rows from a model's text (part, text): typed fields, wrong types skipped, an object read as a list of one."""
    v = F.try_parse_json(T.json_object(F.col("text")))
    one = "struct<value:double,unit:string,conditions:string>"
    figures = lambda f: F.coalesce(F.try_variant_get(v, f"$.{f}", f"array<{one}>"), F.array_compact(F.array(F.try_variant_get(v, f"$.{f}", one))))
    names = F.coalesce(F.try_variant_get(v, "$.package", "array<string>"), F.array_compact(F.array(F.try_variant_get(v, "$.package", "string"))))
    letter = F.try_variant_get(v, "$.channel", "string")
    clean = lambda f: F.transform(F.filter(figures(f), lambda m: m["value"].isNotNull()), lambda m: F.struct(m["value"].alias("value"), m["unit"].alias("unit"), T.clean_conditions(F.coalesce(m["conditions"], F.lit(""))).alias("conditions")))
    return rows.select(
        "part", v.isNotNull().alias("readable"), F.when(letter.isin("N", "P"), letter).alias("channel"), F.try_variant_get(v, "$.vds", "double").alias("vds"),
        clean("rdson").alias("rdson"), clean("id").alias("id"), T.clean_packages(names).alias("package"),
    )


def unreadable(rows: DataFrame) -> DataFrame:
    """Model texts that hold no attributes, with the reason: part, reason, head."""
    v = F.try_parse_json(T.json_object(F.col("text")))
    reason = F.when(F.col("text").isNull() | (T.trim(F.col("text")) == ""), "empty").when(T.json_object(F.col("text")).isNull(), "no object").when(v.isNull(), "broken object")
    return rows.select("part", reason.alias("reason"), T.preview(F.col("text"), 100).alias("head")).where("reason is not null")


def route(questions: DataFrame, names: DataFrame) -> DataFrame:
    """Questions (id, text and others) with their route: document when identifiers are left after known names (name) are taken out, else set."""
    return named_parts(questions, names).withColumn("route", F.when(F.size("named") > 0, "document").otherwise("set")).drop("named")


def set_questions(rows: DataFrame, min_candidates: int = 4) -> DataFrame:
    """Generated set questions with truth: id, kind, question, truth_parts, truth_value, unit, candidates.

    Superlatives for each (channel, rating, class), counts for each package and rating; groups under the least size
    make no question. Each part competes with its conservative figure in a class.
    """
    parts = []
    for kind, name, op in (("min-rdson", "rdson", "min"), ("max-id", "id", "max")):
        inside = rows.where("vds is not null and channel is not null").select("part", "channel", F.abs("vds").alias("rating"), F.posexplode(name).alias("pos", "m"))
        figures = inside.select("part", "channel", "rating", T.class_of(F.col("m.conditions")).alias("cls"), F.abs("m.value").alias("v")).where("cls <> ''")
        kept = figures.groupBy("part", "channel", "rating", "cls").agg(F.max("v").alias("value"))
        key = F.concat_ws("|", "channel", T.number_text(F.col("rating")), "cls")
        best = extrema(kept.select("part", "value", key.alias("cond_class")), op).where(F.col("candidates") >= min_candidates)
        c = F.split("cond_class", r"\|")
        word = "lowest on-resistance" if name == "rdson" else "highest drain current"
        text = F.concat(F.lit("Which "), c[0], F.lit("-channel part rated "), c[1], F.lit(f" V has the {word} at "), c[2], F.lit("?"))
        unit = T.unit_of(name)
        parts.append(best.select(F.concat(F.lit(f"corpus:{kind}:"), "cond_class").alias("id"), F.lit(kind).alias("kind"), text.alias("question"), F.col("parts").alias("truth_parts"), F.col("best").alias("truth_value"), F.lit(unit).alias("unit"), "candidates"))
    by_package = rows.select("part", F.explode("package").alias("key")).distinct()
    by_rating = rows.where("vds is not null").select("part", T.number_text(F.abs("vds")).alias("key")).distinct()
    for kind, df, ask in (("count-package", by_package, "How many parts come in the "), ("count-vds", by_rating, "How many parts are rated ")):
        n = df.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_candidates)
        text = F.concat(F.lit(ask), "key", F.lit(" package?" if kind == "count-package" else " V?"))
        parts.append(n.select(F.concat(F.lit(f"corpus:{kind}:"), "key").alias("id"), F.lit(kind).alias("kind"), text.alias("question"), F.array().cast("array<string>").alias("truth_parts"), F.col("n").cast("double").alias("truth_value"), F.lit(None).cast("string").alias("unit"), F.col("n").alias("candidates")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pool_size(rows: DataFrame, name: str) -> DataFrame:
    """Parts that compete in each class of a field."""
    return candidates(rows, name).groupBy("cond_class").agg(F.countDistinct("part").alias("parts"))
