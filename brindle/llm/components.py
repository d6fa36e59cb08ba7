"""Connected components by alternating star contractions, each step a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import Written


def _settled(edges: DataFrame) -> bool:
    """Whether the links are stars: every big node has one link, and no small node is a big one."""
    big = edges.select(F.col("big").alias("node"), F.lit(1).alias("as_big"), F.lit(0).alias("as_small"))
    both = big.union(edges.select("small", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("as_big").alias("n"), F.max("as_small").alias("below"))
    return both.where("n > 1 or n > 0 and below > 0").count() == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """Least node reachable from each node that has a link.

    edges: two columns of the same orderable type. Result: node, label (a component's least node has
    no row of its own). Self-links, repeated and null links don't matter. Rounds grow with the
    logarithm of the longest path, until all links are stars; a round is two joins on deduplicated links, whose hot
    hub, if any, only stands on the side that adaptive execution can split.
    """
    a, b = (F.col(x) for x in edges.columns)
    table = Written(
        edges.where(a != b).select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small")).distinct(), "links"
    )
    while not _settled(table.df):
        least = table.df.groupBy("big").agg(F.min("small").alias("least"))
        # Large star: a link to a node becomes a link to that node's least neighbour.
        above = least.select(F.col("big").alias("small"), F.col("least").alias("lower"))
        large = Written(
            table.df.join(above, "small", "left").select("big", F.coalesce("lower", "small").alias("small")).distinct(), "links"
        )
        # Small star: all smaller neighbours of a node, and itself, hang on the least of them.
        least = large.df.groupBy("big").agg(F.min("small").alias("least"))
        both = large.df.join(least, "big").where(F.col("small") != F.col("least"))
        moved = both.select(F.col("small").alias("big"), F.col("least").alias("small"))
        small = Written(moved.union(least.select("big", F.col("least").alias("small"))).distinct(), "links")
        table.drop()
        large.drop()
        table = small
    return table.df.select(F.col("big").alias("node"), F.col("small").alias("label"))
