"""Text preparation: noise lines, carried-forward symbols, chunks with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from brindle.functions import text as T

# Fixed values that results depend on.
FOOTER = r"(?i)All information provided in this document is subject to legal disclaimers"
PRINT_LINE = r"(?i)^\s*(Product data sheet|Product specification|Objective data sheet)\b"
LEGAL_TAIL = r"^\s*\d{1,2}\.\s+Legal information\b"
SYMBOL_ROW = r"^(\s*)([A-Z][A-Za-z0-9()]{0,7})(\s{2,})([a-z][a-z\-\s]{2,}?)(\s{2,})(\S.*)$"
DATA_ROW = r"\s(-?[\d.]+|-)\s+[^\s]*\s*(V|A|W|K/W|°C|nC|µA|mA|mΩ|Ω|nF|pF|ns|µs|mJ)\s*$"
HAS_CONDITION = r"[A-Za-z]+\s*=\s*-?[\d.]"
TARGET, OVERLAP, CEILING = 1100, 180, 1800
#: Unicode's white space, as trim takes it.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def lines_of(documents: DataFrame) -> DataFrame:
    """documents (id, text) as lines: id, pos, line."""
    return documents.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def strip(text: Column, running_head: str | None = None) -> Column:
    """Cut at the legal section; drop footer, print and running-head lines. In the row, without a shuffle."""
    lines = F.split(text, "\n")
    first_legal = F.array_position(F.transform(lines, lambda x: x.rlike(LEGAL_TAIL)), F.lit(True))
    body = F.when(first_legal > 0, F.slice(lines, F.lit(1), first_legal.cast("int") - 1)).otherwise(lines)
    noise = lambda x: x.rlike(FOOTER) | x.rlike(PRINT_LINE) | (x.rlike(rf"^\s*{running_head}\s*$") if running_head else F.lit(False))
    return F.array_join(F.filter(body, lambda x: ~noise(x)), "\n")


def bind(lines: DataFrame) -> DataFrame:
    """Carry a table row's symbol to the condition rows that continue it.

    lines: id, pos, line. The symbol of the last opening row holds until a blank line; continuation rows
    get it after their indent. A window a document; blocks are counted by blank lines before.
    """
    order = Window.partitionBy("id").orderBy("pos")
    line = F.col("line")
    blank = ~line.rlike(r"\S")
    opens = line.rlike(SYMBOL_ROW) & line.rlike(DATA_ROW)
    part = lambda g: F.regexp_extract(line, SYMBOL_ROW, g)
    symbol = F.concat(part(2), part(3), F.rtrim(part(4)))
    marked = lines.withColumn("_block", F.sum(blank.cast("int")).over(order)).withColumn("_symbol", F.when(opens, symbol))
    inside = Window.partitionBy("id", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last("_symbol", ignorenulls=True).over(inside)
    goes_on = carried.isNotNull() & ~blank & ~line.rlike(SYMBOL_ROW) & line.rlike(HAS_CONDITION) & line.rlike(DATA_ROW)
    bound = F.concat(F.regexp_extract(line, r"^(\s*)", 1), carried, F.lit("   "), F.regexp_replace(line, r"^\s*", ""))
    return marked.select("id", "pos", F.when(goes_on, bound).otherwise(line).alias("line"))


def prepare(documents: DataFrame, running_head: str | None = None) -> DataFrame:
    """Noise lines removed and symbols bound, as whole texts again (id, text)."""
    stripped = documents.select("id", strip(F.col("text"), running_head).alias("text"))
    joined = bind(lines_of(stripped)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return joined.select("id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def _pieces(block: str) -> Iterator[str]:
    """A block over the ceiling: its lines packed up to the target, a longer line in slices."""
    if len(block) <= CEILING:
        yield block
        return
    start = end = at = 0  # the open piece, and where the next line begins
    while at <= len(block):
        stop = block.find("\n", at)
        stop = len(block) if stop < 0 else stop
        if end > start and stop - start > TARGET:
            yield block[start:end]
            start = end = at
        if stop - at > CEILING:
            yield from (block[i : min(i + TARGET, stop)] for i in range(at, stop, TARGET))
            start = end = stop + 1
        else:
            start, end = (start if end > start else at), stop
        at = stop + 1
    if end > start:
        yield block[start:end]


def _tail(text: str) -> str:
    """Last whole lines that fit the overlap: what follows the first line break within it."""
    if len(text) <= OVERLAP:
        return text
    return text[-OVERLAP - 1 :].partition("\n")[2]


def _packed(text: str) -> Iterator[str]:
    current = ""
    for block in re.split("\n{2,}", text):
        for piece in _pieces(block) if block.strip(SPACES) else ():
            if current and len(current) + 2 + len(piece) > TARGET:
                yield current.strip(SPACES)
                current = _tail(current)
            current = f"{current}\n\n{piece}" if current else piece
    if current.strip(SPACES):
        yield current.strip(SPACES)


def _cut(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else list(_packed(t)))


def chunks_of(text: Column) -> Column:
    """Chunks of a text: blocks packed greedily to the target, each chunk seeded with the last one's tail. Linear in the text's length.

    In Arrow batches: Spark copies a fold's state at every step, so a fold that builds the list is quadratic.
    """
    return F.pandas_udf(_cut, ArrayType(StringType()))(T.normalise(text))


def chunk(documents: DataFrame) -> DataFrame:
    """Chunk documents (id, text): id (document#index), document_id, index, total, text."""
    # The number of chunks is in each element: beside the generator, it would need all chunks in every row.
    counted = lambda c: F.transform(c, lambda x, i: F.struct(i.alias("index"), F.size(c).alias("total"), x.alias("text")))
    cut = documents.select(F.col("id").alias("document_id"), chunks_of(F.col("text")).alias("c"))
    rows = cut.select("document_id", F.inline(counted(F.col("c"))))
    return rows.select(F.concat_ws("#", "document_id", "index").alias("id"), "document_id", "index", "total", "text")


def anchored(chunks: DataFrame) -> DataFrame:
    """Chunks with their document's id on a first line."""
    return chunks.withColumn("text", F.concat("document_id", F.lit("\n"), "text"))


def is_degenerate(text: Column, min_words: int = 12, max_share: float = 0.3) -> Column:
    """One word makes up more than a share of a text of some length."""
    return F.transform(F.array(T.words(text)), lambda w: (F.size(w) >= min_words) & (_most(w) / F.size(w) > max_share))[0]


def _most(w: Column) -> Column:
    """How often the commonest element occurs: the longest run in sorted order."""
    run = lambda s, x: F.struct(
        x.alias("x"),
        F.when(s["x"].eqNullSafe(x), s["n"] + 1).otherwise(1).alias("n"),
        F.greatest(s["best"], F.when(s["x"].eqNullSafe(x), s["n"] + 1).otherwise(1)).alias("best"),
    )
    start = F.struct(F.lit(None).cast("string").alias("x"), F.lit(0).alias("n"), F.lit(0).alias("best"))
    return F.aggregate(F.array_sort(w), start, run, lambda s: s["best"])
