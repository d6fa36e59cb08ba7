"""Grading of answers: values with units, text with aliases, refusals, set-query outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import text as T


def value_match(text: Column, value: Column, unit: Column, tolerance: Column | float = 0.01) -> Column:
    """Struct ok, found (value), signed: the first same-unit figure within tolerance, else the closest.

    A tie for the closest keeps the earlier figure. signed: whether signs agree; null when zero is expected or none is found.
    """
    same_unit = F.filter(T.measures(text), lambda m: m["unit"] == unit)
    distance = lambda m: F.abs(F.abs(m["value"]) - F.abs(value))

    def choose(found: Column) -> Column:
        hits = F.filter(found, lambda m: T.near(m["value"], value, tolerance))
        least = F.array_min(F.transform(found, lambda m, i: F.struct(distance(m).alias("d"), i.alias("i"), m["value"].alias("v"))))
        best = F.when(F.size(hits) > 0, F.get(hits, F.lit(0))["value"]).otherwise(least["v"])
        signed = F.when((value != 0) & best.isNotNull(), F.signum(best) == F.signum(value))
        return F.struct((F.size(hits) > 0).alias("ok"), best.alias("found"), signed.alias("signed"))

    return F.transform(F.array(same_unit), choose)[0]


def text_match(text: Column, names: Column) -> Column:
    """Any of the accepted names is mentioned."""
    return F.exists(names, lambda n: T.mentions(text, n))


def grade(ok: Column, found: Column, refused: Column, holdout: Column) -> Column:
    """Reason: match, wrong-value, no-value, refused-correctly, refused-wrongly or hallucinated."""
    return (
        F.when(refused & holdout, "refused-correctly")
        .when(refused, "refused-wrongly")
        .when(holdout, "hallucinated")
        .when(ok, "match")
        .when(found.isNull(), "no-value")
        .otherwise("wrong-value")
    )


def signed_value_match(text: Column, value: Column, unit: Column) -> Column:
    """Any same-unit figure within one per cent, signs included."""
    return F.exists(T.measures(text), lambda m: (m["unit"] == unit) & (F.abs(m["value"] - value) <= F.greatest(F.abs(value) * 0.01, F.lit(1e-9))))


def states_count(text: Column, expected: Column) -> Column:
    """The expected number stands alone as a whole number of up to four digits."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\d.,])(\d{1,4})(?![\d.,])"), F.lit(1))
    return F.array_contains(F.transform(found, lambda x: x.cast("long")), expected.cast("long"))


def set_outcome(empty: Column, guarded: Column, refused: Column, hedged: Column, correct: Column) -> Column:
    """Outcome of a set query, in order of precedence."""
    return (
        F.when(empty, "catalog-empty").when(guarded, "guard-refused").when(refused, "model-refused")
        .when(hedged, "hedged").when(correct, "correct").otherwise("wrong")
    )


def names_part(text: Column, part: Column) -> Column:
    """The part is named as a whole identifier; case matters, a hyphen belongs to a name."""
    return F.regexp_like(text, F.concat(F.lit("(?<![A-Za-z0-9-])"), T.quoted(part), F.lit("(?![A-Za-z0-9-])")))


def carries_value(excerpt: Column, value: Column, unit: Column, tolerance: Column | float = 0.01) -> Column:
    """An excerpt holds a figure that would be graded right."""
    return value_match(excerpt, value, unit, tolerance)["ok"]


def hedged(route: Column, kind: Column, conditions: Column) -> Column:
    """The catalogue answered with several classes although the question's filter names one."""
    return F.coalesce((route == "catalog") & (kind == "ambiguous-conditions") & conditions.isNotNull(), F.lit(False))


def baseline_outcome(text: Column, guarded: Column, correct: Column) -> Column:
    """Outcome without a catalogue: refusal is read from the text, and there is no hedge."""
    refused = F.coalesce(text.contains(T.REFUSAL), F.lit(True))
    return set_outcome(F.lit(False), guarded, refused, F.lit(False), correct)


def guard_refuses(named: Column, retrieved: Column) -> Column:
    """Identifiers are named, and none of them was retrieved."""
    return (F.size(named) > 0) & ~F.arrays_overlap(named, retrieved)
