"""URL filters: host and path rules, then trust and distrust propagated over the hosts' link graph."""

from __future__ import annotations

import string
from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import Written, broadcast_if_small

#: (verdict, host, path): a rule fits its host and all subdomains where the path begins with its path.
Rule = tuple[str, str, str]
#: The production rules.
RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING = 0.85
#: Rounds end when no host's score changes by more than this.
TOLERANCE = 1e-6
#: A host is blocked if its distrust is over this many times its trust.
DISTRUST_RATIO = 2.0

_LINK = r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^"'\s<>]+)"""


def _ascii_lower(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; else empty."""
    return F.coalesce(_ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule as host and path in a row, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """Links between different hosts: src, dst and how many there are."""
    links = pages.select(F.col("_host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("url"))
    target = F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), F.col("url"))).otherwise(F.col("url"))
    hosts = links.select("src", host_of(target).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return hosts.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """Personalised PageRank over host links: trust along links, distrust against them.

    seeds: host, trust, distrust (the teleport vectors); links: src, dst, n. A link hands on its share
    of its source's trust, and its share of its target's distrust. Result: host, trust, distrust.
    Seeds aren't scaled to sum to 1, so that a host's own pages weigh alike in both scores, and a host without links on
    hands nothing on: against PageRank that gives such mass back to the seeds, all scores are smaller by one factor.
    Links are kept once a direction; a round is one join on the giving host, whose unique
    scores meet links that adaptive execution can split, and one partial sum. Each round's changes add up to
    DAMPING times the last one's at most, so rounds end by the bound that the seeds' sum gives; beyond it is an error.
    """
    outs = links.groupBy("src").agg(F.sum("n").alias("out"))
    ins = links.groupBy("dst").agg(F.sum("n").alias("in"))
    shared = links.join(outs, "src").join(ins, "dst")
    forth = shared.select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("out")).alias("t"), F.lit(0.0).alias("d"))
    back = shared.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("n") / F.col("in")).alias("d"))
    edges = Written(forth.unionByName(back), "edges").df
    every = seeds.select("host").union(edges.select("host")).distinct().join(seeds, "host", "left")
    base = Written(every.select("host", *[(F.coalesce(c, F.lit(0.0)) * (1 - DAMPING)).alias(c) for c in ("trust", "distrust")]), "seeds").df
    if edges.isEmpty():
        return base
    mass = max(1.0, *(x or 0.0 for x in base.agg(F.sum("trust"), F.sum("distrust")).first()))
    scores, old, rounds = base, None, 1 + ceil(log(TOLERANCE / mass) / log(DAMPING))
    for _ in range(rounds):
        given = edges.join(scores, "host").groupBy(F.col("to").alias("host")).agg(F.sum(F.col("trust") * F.col("t")).alias("t"), F.sum(F.col("distrust") * F.col("d")).alias("d"))
        plus = lambda c, own: F.col(c) + DAMPING * F.coalesce(own, F.lit(0.0))
        new = Written(base.join(given, "host", "left").select("host", plus("trust", "t").alias("trust"), plus("distrust", "d").alias("distrust")), "scores")
        moved = new.df.alias("x").join(scores.alias("y"), "host").agg(
            F.max(F.greatest(F.abs(F.col("x.trust") - F.col("y.trust")), F.abs(F.col("x.distrust") - F.col("y.distrust"))))
        )
        change = moved.first()[0]
        if old is not None:
            old.drop()
        scores, old = new.df, new
        if change is None or change <= TOLERANCE:
            return scores
    raise RuntimeError(f"scores of hosts still change by {change} after {rounds} rounds")


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Host, path, fitting rule and verdict of every page.

    Takes page_id, url and html; other columns don't matter. A null url, or one without ://, has an
    empty host and path, fits no rule and is allowed. Seeds: a host's share of pages that rules allow,
    and of those they block. Pages that no rule fits get their host's verdict: block where distrust
    is over twice the trust. Repeated rows are judged alike. rules: a short list (each is an expression).
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    placed = pages.select("page_id", host.alias("_host"), path.alias("_path"), "html")
    name, verdict = ruled(F.col("_host"), F.col("_path"), rules)
    share = lambda kind: F.avg(F.coalesce((F.col("_verdict") == kind).cast("double"), F.lit(0.0)))
    seeds = placed.withColumn("_verdict", verdict).where("_host <> ''").groupBy(F.col("_host").alias("host")).agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = propagate(Written(seeds, "hosts").df, Written(host_links(placed), "host-links").df)
    bad = Written(scores.where(F.col("distrust") > DISTRUST_RATIO * F.col("trust")).select(F.col("host").alias("_bad")), "bad").df
    joined = placed.drop("html").join(broadcast_if_small(bad, bad.count()), F.col("_host") == F.col("_bad"), "left")
    by_host = F.when(F.col("_bad").isNotNull(), "block").otherwise("allow")
    return joined.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), name.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"))


#: Covers tables without links between hosts, like the driver's, where no score moves; propagation has its own tests.
ORACLE = """
    WITH placed AS (
        SELECT page_id,
               translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
        FROM pages),
    rules(verdict, rule_host, rule_path) AS (
        VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
               ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
    fitting AS (
        SELECT DISTINCT host, path, first_value(rule_host || rule_path) OVER w AS rule, first_value(verdict) OVER w AS verdict
        FROM placed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        WINDOW w AS (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC)),
    judged AS (SELECT page_id, placed.host, placed.path, rule, verdict FROM placed LEFT JOIN fitting USING (host, path)),
    hosts AS (
        SELECT host, avg(CASE WHEN verdict = 'block' THEN 1.0 ELSE 0.0 END) > 2 * avg(CASE WHEN verdict = 'allow' THEN 1.0 ELSE 0.0 END) AS bad
        FROM judged WHERE host <> '' GROUP BY host)
    SELECT page_id, judged.host, path, rule, coalesce(verdict, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict
    FROM judged LEFT JOIN hosts ON judged.host = hosts.host"""
