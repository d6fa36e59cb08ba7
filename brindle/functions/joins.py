"""Sizes of joins and shuffles by counted rows, where the bytes of files mislead: columns that compress well are many times as large in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a broadcast may hold, and rows that a task of a dealt table takes.
BROADCAST_ROWS, TASK_ROWS = 100_000, 200_000


def beside(df: DataFrame, rows: int) -> DataFrame:
    """A counted table that another is joined with: broadcast within the bound, else both sides are shuffled, whatever size the other is guessed at."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A table dealt by keys over as many partitions as its counted rows need."""
    return df.repartition(max(1, -(-df.count() // TASK_ROWS)), *keys)
