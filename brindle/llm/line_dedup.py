"""Line dedup by distinct-site spread.

A HyperLogLog sketch of sites for each line's hash, merged by aggregation, tells on how many sites the
line stands. Lines whose estimate is near the threshold get an exact distinct count. Lines on enough
sites are boilerplate and go, but for their first place in the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import WHITE, Written, broadcast_if_small, shield
from brindle.llm.quality import let

#: log2 of a sketch's registers, and its relative error times three.
LG_K, MARGIN = 10, 0.1
#: Sites from which a line is boilerplate, and the words it must have.
MIN_SITES, MIN_WORDS = 8, 3


def _row_key() -> Column:
    """Repeated rows share it; they hold the same lines."""
    return F.xxhash64("doc_id", "text")


def _lines(documents: DataFrame, site: str) -> DataFrame:
    """Lines that may be boilerplate: row, doc_id, site, place, key."""
    placed = documents.select(_row_key().alias("row"), "doc_id", F.col(site).alias("site"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    # Words are counted by the gaps between them, white space at the ends aside.
    several = F.col("line").rlike(rf"[^{WHITE}]" + rf"[{WHITE}]+[^{WHITE}]+" * (MIN_WORDS - 1))
    return placed.where(several).select("row", "doc_id", "site", "place", F.xxhash64(F.btrim("line", F.lit(" \t\r"))).alias("key"))


def boilerplate(documents: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Keys of the lines on min_sites distinct sites or more, each with its first place (doc_id, place)."""
    lines = _lines(documents, site)
    sketched = lines.groupBy("key").agg(
        F.hll_sketch_agg(F.coalesce(F.col("site").cast("string"), F.lit("")), F.lit(LG_K)).alias("sketch"),
        F.min(F.struct("doc_id", "place")).alias("first"),
    )
    spread = sketched.select("key", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    low, high = min_sites * (1 - MARGIN) - 1, min_sites * (1 + MARGIN) + 1
    likely = Written(spread.where(F.col("sites") >= low), "spread").df
    near = likely.where(F.col("sites") <= high).select("key")
    n = near.count()
    exact = lines.join(broadcast_if_small(near, n), "key", "left_semi").groupBy("key", F.coalesce(F.col("site").cast("string"), F.lit("")).alias("site")).agg(F.lit(1).alias("one"))
    passed = exact.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("key")
    sure = likely.where(F.col("sites") > high)
    return sure.select("key", "first").unionByName(likely.join(passed, "key", "left_semi").select("key", "first"))


def line_dedup(documents: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Remove boilerplate lines from every document; adds n_lines and n_removed_lines.

    Takes doc_id, text and the site column; other columns are kept (those named like a result are replaced).
    All documents stay. A null site is a site of its own; a null text stays null, with no lines. Lines are
    compared without blanks at their ends; those of fewer than three words stay. Of a boilerplate line
    the occurrence of the smallest (doc_id, place) stays, in all rows that repeat that document.
    Hot lines are counted in partial aggregates; a document's removals are one list of places.
    """
    documents, names = shield(documents, ("doc_id", "text", site), ("n_lines", "n_removed_lines"))
    found = Written(boilerplate(documents, site, min_sites), "boilerplate").df
    n = found.count()
    hit = _lines(documents, site).join(broadcast_if_small(found, n), "key").where(~F.struct("doc_id", "place").eqNullSafe(F.col("first")))
    gone = hit.groupBy("row").agg(F.collect_set("place").alias("_gone"))
    keyed = documents.withColumn("_row", _row_key())
    joined = keyed.join(gone, keyed["_row"] == gone["row"], "left")

    def cut(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), cut))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    n_gone = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long")
    kept = [(text if c == "text" else F.col(name)).alias(c) for c, name in names.items()]
    return joined.select(*kept, n_lines.alias("n_lines"), n_gone.alias("n_removed_lines"))


ORACLE = f"""
    WITH placed AS (
        SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
    lines AS (
        SELECT doc_id, source, i - 1 AS place, lines[i] AS line
        FROM (SELECT doc_id, source, lines, unnest(range(1, len(lines) + 1)) AS i FROM placed)),
    able AS (
        SELECT doc_id, source, place, trim(line, ' ' || chr(9) || chr(13)) AS line FROM lines
        WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= {MIN_WORDS}),
    spread AS (
        SELECT line, min(ROW(doc_id, place)) AS first FROM able GROUP BY line
        HAVING count(DISTINCT coalesce(source, '')) >= {MIN_SITES}),
    gone AS (
        SELECT doc_id, place FROM able JOIN spread USING (line) WHERE ROW(doc_id, place) <> first),
    rest AS (
        SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.place) AS text
        FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.place = g.place GROUP BY l.doc_id),
    n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(d.lines) AS BIGINT) AS n_lines, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed_lines,
           sha256(coalesce(rest.text, '')) AS text_sha256
    FROM placed d LEFT JOIN rest USING (doc_id) LEFT JOIN n USING (doc_id)"""
