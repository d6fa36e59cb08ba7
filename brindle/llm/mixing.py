"""Mixing sources to target weights by temperature, in DataFrame operations.

A source's share of tokens p becomes a weight proportional to p**t. The exponent t lies in [0, 1]; it is
found by bisection, each step one aggregate over the sources that evaluates several exponents at once.
Weights times a budget of tokens give each source its quota. A source's documents fall into blocks by
hash, blocks are permuted by another hash, and passes over the permutation are taken until the quota is met:
whole passes, then whole blocks, then the documents of one last block up to a hash.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import Written, broadcast_if_small, shield
from brindle.llm.quality import words_of

#: Blocks that a source's documents are dealt into.
BLOCKS = 1024
#: Target entropy as a share of the highest possible one, and the most passes over any source.
ENTROPY_SHARE, MAX_REPEATS = 0.95, 2.0
#: Exponents evaluated in one aggregate: each step narrows the bracket to a sixteenth.
POINTS = 16
#: Parts of a pass below this come from rounding.
TOLERANCE = 1e-9


def _moments(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """Sums of p**t and of p**t log p, for several t, in one aggregate over the sources."""
    aggregates: list[Column] = []
    for i, t in enumerate(exponents):
        power = F.pow("p", F.lit(t))
        aggregates += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log("p")).alias(f"a{i}")]
    row = shares.agg(*aggregates).first()
    return [(row[f"z{i}"], row[f"a{i}"]) for i in range(len(exponents))]


def _bracket(meets: Callable[[list[float]], list[bool]], tolerance: float) -> tuple[float, float]:
    """Bisection in [0, 1], several points a step: the largest point that meets a falling condition, and the next one tried."""
    low, high = 0.0, 1.0
    while high - low > tolerance:
        points = [low + (high - low) * i / POINTS for i in range(1, POINTS)]
        k = sum(meets(points))
        low, high = [low, *points, high][k], [low, *points, high][k + 1]
    return low, high


def bisect_exponent(shares: DataFrame, entropy_share: float, max_repeats: float, corpora: float | None = None, tolerance: float = 1e-9) -> float:
    """Largest exponent whose entropy meets the target, or the least that the repetition limit allows, if larger.

    shares: one row a source with its share p > 0. corpora: the budget, in corpora; without one the commonest source
    is passed once. Entropy and the passes over the rarest source fall as the exponent grows, so
    both conditions bracket one point. At exponent 1 every source is passed alike, as often as the budget says.
    """
    n, least, most = shares.agg(F.count(F.lit(1)), F.min("p"), F.max("p")).first()
    if n < 2 or least == most:
        return 1.0
    target = entropy_share * math.log(n)

    def spread(points: list[float]) -> list[bool]:
        return [math.log(z) - t * a / z >= target for t, (z, a) in zip(points, _moments(shares, points), strict=True)]

    def repeats_too_often(points: list[float]) -> list[bool]:
        if corpora is None:
            return [math.exp((t - 1) * (math.log(least) - math.log(most))) > max_repeats for t in points]
        return [corpora * least ** (t - 1) / z > max_repeats for t, (z, _) in zip(points, _moments(shares, points), strict=True)]

    exponent = 1.0 if spread([1.0])[0] else _bracket(spread, tolerance)[0]
    return _bracket(repeats_too_often, tolerance)[1] if repeats_too_often([exponent])[0] else exponent


def mix(
    documents: DataFrame,
    entropy_share: float = ENTROPY_SHARE,
    max_repeats: float = MAX_REPEATS,
    budget: float | None = None,
    corpora: float | None = None,
    seed: int = 0,
    source: str = "source",
    tokens: Column | None = None,
) -> DataFrame:
    """Repeat documents so that sources hold their target weights of tokens.

    Takes doc_id, text and the source column; other columns are kept. tokens: a document's number of tokens, if the
    table knows it; else the words of its text stand for them. Adds epoch (1 for the first
    pass) and block (the place of the document's block in its source's permutation); input columns of those
    names are replaced. Without a budget (in tokens, or as corpora: a multiple of all tokens) the commonest source is passed once and no document is left
    out. No source is passed more than max_repeats times; a budget over that many corpora comes down to it. A null source is a source of its own. Texts without words, null ones too, weigh nothing and are taken once a
    pass. Rows that repeat are dealt alike, each as a document. A source's last, partial pass goes over
    its quota by part of one document at most, rows of one doc_id and text counted as one. Hot sources are only aggregated,
    by block; of one block a source the hashes, not the texts, are ordered.
    """
    if tokens is not None:
        documents = documents.withColumn("__brindle_tokens", tokens)
    needed = ("doc_id", "text", source, *(["__brindle_tokens"] if tokens is not None else []))
    documents, names = shield(documents, needed, ("epoch", "block"))
    names.pop("__brindle_tokens", None)
    again = [F.col(name).alias(c) for c, name in names.items()]
    weigh = F.size(words_of(F.col("text"))).cast("long") if tokens is None else F.coalesce(F.col("__brindle_tokens").cast("long"), F.lit(0).cast("long"))
    place = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    dealt = documents.withColumns({
        "_source": F.coalesce(F.col(source).cast("string"), F.lit("")),
        "_null": F.col(source).isNull(),
        "_at": F.struct(place.alias("hash"), F.col("doc_id").alias("id")),
        "_block": F.pmod(place, F.lit(BLOCKS)).cast("int"),
    })
    group = ["_source", "_null"]
    blocks = Written(dealt.groupBy(*group, "_block").agg(F.sum(weigh).alias("tokens")), "blocks").df
    sources = blocks.groupBy(*group).agg(F.sum("tokens").alias("total"))
    total = sources.agg(F.sum("total")).first()[0] or 0
    if not total:
        return documents.select(*again, F.lit(1).alias("epoch"), F.lit(0).alias("block"))
    shares = Written(sources.where("total > 0").withColumn("p", F.col("total") / F.lit(float(total))), "shares").df
    wished = corpora if budget is None else budget / total
    corpora = None if wished is None else min(wished, max_repeats)
    exponent = bisect_exponent(shares, entropy_share, max_repeats, corpora)
    weight = F.pow("p", F.lit(exponent))
    norm, once = shares.agg(F.sum(weight), F.max(F.col("total") / weight)).first()
    wanted = once * norm if corpora is None else corpora * total
    quota = shares.select(*group, (F.lit(float(wanted)) * weight / F.lit(norm) / F.col("total")).alias("passes"), "total")
    # A pass that only rounding keeps from being whole is whole, and a rest that only rounding makes is none.
    whole, part = F.floor(F.col("passes") + TOLERANCE), F.col("passes") - F.floor(F.col("passes") + TOLERANCE)
    quota = quota.select(*group, whole.cast("int").alias("whole"), (F.when(part > TOLERANCE, part).otherwise(0.0) * F.col("total")).alias("rest"))
    order = Window.partitionBy(*group).orderBy(F.xxhash64(F.lit(seed + 1), F.col("_source"), F.col("_block")), "_block")
    upto = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = blocks.select(*group, "_block", "tokens", (F.row_number().over(order) - 1).alias("block"), (upto - F.col("tokens")).alias("before"))
    joined = ranked.join(quota, group, "left")
    room = F.greatest(F.lit(0.0), F.coalesce("rest", F.lit(0.0)) - F.col("before"))
    plan = Written(joined.select(*group, "_block", "block", F.coalesce("whole", F.lit(1)).alias("whole"), "tokens", room.alias("room")), "plan").df
    last = plan.where((F.col("room") > 0) & (F.col("room") < F.col("tokens"))).select(*group, "_block", "room")
    # The last hash that is taken of each source's partial block: its hashes are summed up first, copies of a row together.
    inside = dealt.join(broadcast_if_small(last, last.count()), [*group, "_block"]).groupBy(*group, "_at", "room").agg(F.sum(weigh).alias("tokens"))
    before = F.sum("tokens").over(Window.partitionBy(*group).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    cuts = inside.withColumn("_before", before).where(F.col("_before") < F.col("room")).groupBy(*group).agg(F.max("_at").alias("_last"))
    cut = Written(plan.join(cuts, group, "left").select(*group, "_block", "block", "whole", "room", "tokens", "_last"), "cuts").df
    placed = dealt.join(broadcast_if_small(cut, cut.count()), [*group, "_block"])
    also = (F.col("room") > 0) & ((F.col("room") >= F.col("tokens")) | (F.col("_at") <= F.col("_last")))
    taken = placed.withColumn("_copies", F.col("whole") + also.cast("int")).where("_copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return taken.select(*again, "epoch", "block")
