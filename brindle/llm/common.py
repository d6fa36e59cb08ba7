"""Shared pieces: written intermediate tables, binary files in the shared folder, bounded broadcasts."""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.scratch import file_system, scratch_path

#: White space of the contracts (0x20 and 0x09 to 0x0D) as a regular-expression class body.
WHITE = r"\x20\x09-\x0D"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours through Hadoop's file system."""
    files, target = file_system(spark, path)
    files.delete(target, True)


class Written:
    """A table written to the shared folder: it cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, label)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete a table that nothing reads any more."""
        delete(self.spark, self.path)


def shield(df: DataFrame, needed: tuple[str, ...], results: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """Give all columns but the needed ones names that no operator uses; columns named like a result go.

    Returns the frame and, for each column that stays, its name in it.
    """
    names = {c: c if c in needed else f"__brindle_{i}" for i, c in enumerate(df.columns) if c not in results or c in needed}
    return df.select(*[F.col(f"`{c}`").alias(name) for c, name in names.items()]), names


#: Rows of 8 to 16 bytes that a broadcast may hold; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when a counted table is within the bound; else leave the join to shuffle."""
    return F.broadcast(df) if rows <= limit else df


#: Bits of a bitmap of hashed keys, and bytes of the pieces it is broadcast in: 8 MB, however many keys there are.
SIEVE_BITS, PIECE = 1 << 26, 256
_MAP_BITS, _MAP_BYTES = 32_768, 4_096


def marked(rows: DataFrame, on: str, keys: DataFrame, mark: str) -> DataFrame:
    """Rows with a column that is true where the column on may be among the keys: where it is, and by chance elsewhere.

    keys: one column, repeats don't matter. Hashed keys set bits of a bitmap of a fixed size, which is broadcast. A false mark is
    certain. Of n keys other rows are marked with a probability of n / SIEVE_BITS at most; exact joins settle what is marked.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE_BITS))
    set_bits = keys.select(place(F.col(keys.columns[0])).alias("_place"))
    maps = set_bits.groupBy(F.shiftright("_place", 15).alias("_map")).agg(F.bitmap_construct_agg(F.col("_place") % _MAP_BITS).alias("_bits"))
    n = _MAP_BYTES // PIECE
    cut = maps.select("_map", "_bits", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_i"))
    pieces = cut.select((F.col("_map") * n + F.col("_i")).alias("_piece"), F.substring("_bits", F.col("_i") * PIECE + 1, F.lit(PIECE)).alias("_bits"))
    placed = rows.withColumn("_place", place(F.col(on)))
    met = placed.withColumn("_piece", F.shiftright("_place", (8 * PIECE).bit_length() - 1)).join(F.broadcast(pieces), "_piece", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright("_place", 3) % PIECE + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (F.col("_place") % 8 + 1).cast("int"))
    return met.select(*[f"`{c}`" for c in rows.columns], F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False)).alias(mark))


def sieved(rows: DataFrame, on: str, keys: DataFrame) -> DataFrame:
    """Rows whose column on may be among the keys, so that most rows which an exact join would drop don't travel to it."""
    return marked(rows, on, keys, "_may").where("_may").drop("_may")


#: A key with more than this part of all rows is hot, so there are at most so many hot keys; their rows go to so many tasks.
HOT_PART, SALTS = 2_000, 64


def spread_semi_join(rows: DataFrame, keys: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Rows whose key is among the keys, with the rows of hot keys dealt over many tasks.

    keys: each key once, with its weight; weights add up to total at most. That bounds the hot keys, which
    are broadcast: 2,000 at most, each of which stands once a salt on the other side.
    """
    hot = F.col(weight) > total / HOT_PART
    known = keys.where(hot).select(*on, F.lit(True).alias("_hot"))
    salted = rows.join(F.broadcast(known), on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(0).cast("int"))
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(keys.select(*on, F.explode(salts).alias("_salt")), [*on, "_salt"], "left_semi").select(*rows.columns)


#: Rows of a key that one task takes in any case.
HOT_FLOOR = 4096


def spread_join(rows: DataFrame, unique: DataFrame, on: list[str], total: int) -> DataFrame:
    """Inner join with a table that holds few rows of a key; rows of hot keys are dealt over many tasks.

    total: at least the number of rows; a key is hot from a part of it on, and no less than HOT_FLOOR rows. That bounds the hot keys, which are broadcast: 2,000 at most, whose rows of
    the other table stand once a salt.
    """
    hot = F.broadcast(Written(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(total / HOT_PART, HOT_FLOOR)).select(*on, F.lit(True).alias("_hot")), "hot-keys").df)
    dealt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(0).cast("int")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = rows.join(hot, on, "left").withColumn("_salt", dealt).drop("_hot")
    return salted.join(unique.join(hot, on, "left").withColumn("_salt", F.explode(salts)).drop("_hot"), [*on, "_salt"]).drop("_salt")


def attempt() -> tuple[int, int]:
    """Partition id and unique attempt id of the running task."""
    context = TaskContext.get()
    return (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
