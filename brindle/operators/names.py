"""Known names taken out of texts: token positions meet a vocabulary of any size by equality."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.functions.joins import beside

# A hyphen belongs to a token, so a name stands alone where no letter, digit or hyphen touches it.
TOKEN = r"[A-Za-z0-9-]+"


def _tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))


def _core(tokens: Column, gaps: Column, n: Column) -> Column:
    """The first n tokens with what stands between them, lower case; gaps[0] stands before the first token."""
    inner = F.zip_with(F.slice(tokens, F.lit(1), n - 1), F.slice(gaps, F.lit(2), n - 1), lambda t, g: F.concat(t, g))
    return F.lower(F.concat(F.array_join(inner, ""), F.get(tokens, n - 1)))


def vocabulary(names: DataFrame) -> DataFrame:
    """Names (name) by their tokens: name, first, n (tokens), core, lead and trail (what stands around the tokens), size. Names without a token go."""
    folded = names.select("name", T.fold_dashes(F.col("name")).alias("_name")).where("name is not null").distinct()
    read = folded.withColumns({"_tokens": _tokens(F.col("_name")), "_gaps": F.split("_name", TOKEN)}).withColumn("n", F.size("_tokens")).where("n > 0")
    return read.select(
        "name", F.lower(F.get("_tokens", F.lit(0))).alias("first"), "n", _core(F.col("_tokens"), F.col("_gaps"), F.col("n")).alias("core"),
        F.lower(F.get("_gaps", F.lit(0))).alias("lead"), F.lower(F.element_at("_gaps", -1)).alias("trail"), F.length("_name").alias("size"),
    )


def occurrences(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Where names (name) stand alone in texts (id, text), any case, dashes folded: id, at (token), n (tokens), lead, trail, size, name.

    The vocabulary is read as a trie of two levels, both tables: a token that begins some name asks, for each length that such names have, for
    the name of so many tokens from there. Both joins are by equality, so neither a large vocabulary nor a long text makes pairs. A row
    of the first join holds the tokens that the longest name needs, not the text. Only the vocabulary is ever broadcast, by its counted names.
    """
    known = vocabulary(names)
    most = known.agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("names")).first()
    longest = most["n"] or 0
    lengths = known.groupBy("first").agg(F.collect_set("n").alias("_lengths"))
    tokens, gaps = F.col("_tokens"), F.col("_gaps")
    read = texts.select("id", T.fold_dashes(F.col("text")).alias("_text")).select("id", _tokens(F.col("_text")).alias("_tokens"), F.split("_text", TOKEN).alias("_gaps")).where(F.size("_tokens") > 0)
    window = lambda i: F.struct(i.alias("at"), F.slice(tokens, i + 1, F.lit(longest)).alias("tokens"), F.slice(gaps, i + 1, F.lit(longest + 1)).alias("gaps"))
    places = read.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.size("_tokens") - 1), window)).alias("_w")).select("id", "_w.*")
    met = places.withColumn("first", F.lower(F.get("tokens", F.lit(0)))).join(beside(lengths, most["names"]), "first").withColumn("n", F.explode("_lengths")).where(F.col("n") <= F.size("tokens"))
    cores = met.select("id", "at", "n", _core(F.col("tokens"), F.col("gaps"), F.col("n")).alias("core"), F.lower(F.get("gaps", F.lit(0))).alias("_before"), F.lower(F.get("gaps", F.col("n"))).alias("_after"))
    found = cores.join(beside(known, most["names"]), ["core", "n"]).where(F.endswith("_before", "lead") & F.startswith("_after", "trail"))
    return found.select("id", "at", "n", F.length("lead").alias("lead"), F.length("trail").alias("trail"), "size", "name")


def without_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Texts (id, text) with a blank in place of each name (name) that stands alone: the longest first, then by name, then the leftmost.

    Names that overlap one taken before stay. id must be unique; null texts stay null. Dashes come back as hyphens.
    """
    order = F.struct((-F.col("size")).alias("k"), "name", "at", "n", "lead", "trail")
    apart = lambda o: lambda t: (t["at"] + t["n"] <= o["at"]) | (o["at"] + o["n"] <= t["at"])
    kind = "array<struct<at:int,n:int,lead:int,trail:int>>"
    span = lambda o: F.struct(o["at"].alias("at"), o["n"].alias("n"), o["lead"].alias("lead"), o["trail"].alias("trail"))
    chosen = F.aggregate(F.array_sort(F.collect_list(order)), F.array().cast(kind), lambda taken, o: F.when(F.forall(taken, apart(o)), F.array_append(taken, span(o))).otherwise(taken))
    spans = occurrences(texts, names).groupBy("id").agg(chosen.alias("_spans"))
    joined = texts.join(spans, "id", "left").withColumn("_text", T.fold_dashes(F.col("text")))
    read = joined.withColumns({"_tokens": _tokens(F.col("_text")), "_gaps": F.split("_text", TOKEN)})
    some, tokens = F.col("_spans"), F.col("_tokens")

    def kept(gap: Column, i: Column) -> Column:
        """A gap and the token after it: names leave a blank, and take what belongs to them of the gaps around."""
        inside = F.exists(some, lambda s: (s["at"] < i) & (i < s["at"] + s["n"]))
        opens, ends = F.filter(some, lambda s: s["at"] == i), F.filter(some, lambda s: s["at"] + s["n"] == i)
        first, last = F.get(opens, F.lit(0)), F.get(ends, F.lit(0))
        after = F.coalesce(last["trail"], F.lit(0))
        left = F.substr(gap, after + 1, F.greatest(F.length(gap) - after - F.coalesce(first["lead"], F.lit(0)), F.lit(0)))
        taken = F.exists(some, lambda s: (s["at"] <= i) & (i < s["at"] + s["n"]))
        token = F.when(first.isNotNull(), " ").when(taken, "").otherwise(F.coalesce(F.get(tokens, i), F.lit("")))
        return F.when(inside, "").otherwise(F.concat(left, token))

    text = F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(F.array_join(F.transform("_gaps", kept), ""))
    return read.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in texts.columns])


def named_parts(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Texts (id, text and others) with named: the distinct identifiers that are left without the names, in order of their first place."""
    # The text as it was goes along in the row: a join with the texts again would broadcast them where their files are small.
    left = without_names(texts.withColumn("_whole", F.col("text")), names)
    return left.select(*[F.col("_whole").alias(c) if c == "text" else F.col(f"`{c}`") for c in texts.columns], T.named_parts(F.col("text")).alias("named"))


@lru_cache(maxsize=4)
def _index(names: tuple[str, ...]) -> dict[str, dict[int, list[tuple[str, str, str, int, str]]]]:
    """Names by their first token and number of tokens, for one question on the driver."""
    found: dict[str, dict[int, list[tuple[str, str, str, int, str]]]] = {}
    for name in names:
        folded = re.sub(T.DASHES, "-", name)
        tokens = list(re.finditer(TOKEN, folded))
        if tokens:
            a, b = tokens[0].start(), tokens[-1].end()
            found.setdefault(tokens[0].group().lower(), {}).setdefault(len(tokens), []).append((folded[a:b].lower(), folded[:a].lower(), folded[b:].lower(), len(folded), name))
    return found


def python_named_parts(question: str, names: Iterable[str]) -> list[str]:
    """named_parts of one question, on the driver."""
    text = re.sub(T.DASHES, "-", question)
    tokens, index = list(re.finditer(TOKEN, text)), _index(tuple(names))
    found = []
    for i, token in enumerate(tokens):
        for n, known in index.get(token.group().lower(), {}).items():
            if i + n > len(tokens):
                continue
            a, b = token.start(), tokens[i + n - 1].end()
            before, after = text[tokens[i - 1].end() if i else 0 : a].lower(), text[b : tokens[i + n].start() if i + n < len(tokens) else len(text)].lower()
            found += [(-size, name, i, i + n, a - len(lead), b + len(trail)) for core, lead, trail, size, name in known if core == text[a:b].lower() and before.endswith(lead) and after.startswith(trail)]
    taken: list[tuple[int, int, int, int]] = []
    for _, _, i, j, a, b in sorted(found):
        if all(j <= k or m <= i for k, m, _, _ in taken):
            taken.append((i, j, a, b))
    for _, _, a, b in sorted(taken, reverse=True):
        text = f"{text[:a]} {text[b:]}"
    return list(dict.fromkeys(re.findall(T.IDENTIFIER, text)))
