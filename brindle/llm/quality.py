"""Quality rules: base counts, then divergence from language references, all in SQL functions.

A document is compared with its language's reference by two histograms: character classes, and the
language's most common words. The distance is Jensen-Shannon's, the square root of the divergence (base 2, so 0 to 1);
the two distances together are the root of the sum of their squares. References are the
mean histograms over all documents of the language that pass the base rules; shares, not counts, are
averaged, so one very long document weighs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import WHITE, Written, broadcast_if_small, shield

#: Character classes, by regular expression; what none takes is the last class, "other".
CLASSES = {
    "lower": r"\p{Ll}",
    "upper": r"\p{Lu}",
    "digit": r"\p{Nd}",
    "stop": r"[.,;:!?'\"()-]",
    "symbol": r"[#*$%&|<>@^~_=+/\\\[\]{}`]",
}
#: Common words of a language's histogram; all its other words are one more class.
COMMON_WORDS = 12
#: A document is judged by characters from so many word characters on, and by words from so many words on.
MIN_CHARS, MIN_WORDS = 200, 80
#: Documents that a language needs for a reference.
MIN_DOCUMENTS = 20
#: A document is rejected if its characters' distance, or that and its words' together, is over this.
MAX_CHARS_DISTANCE, MAX_DISTANCE = 0.283, 0.3


def let(value: Column, body) -> Column:
    """Bind a value to a lambda variable, so that body's lambdas don't evaluate it again and again."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text as the contracts define them; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{WHITE}]+"), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more, the first included.

    Windows are compared by 64-bit hashes of their words. Sorting (hash, place) puts equal windows side by side.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def places(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        last = F.size(s) - 1
        twice = F.filter(s, lambda x, i: ((i > 0) & same(i, i - 1)) | ((i < last) & same(i, i + 1)))
        covered = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(covered)).cast("long")

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(ordered, places))

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(hashes, count))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"[^{WHITE}]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def character_counts(words: Column) -> Column:
    """Struct of word_chars, n_symbols and the classes' counts, from the words put together.

    Each class is taken out in turn, so that the next one searches only what is left: lower-case letters go first,
    and most of a text with them. No two classes share a character, and the rules' symbols are not letters.
    """
    glued = F.array_join(words, "")

    def taken(text: Column, classes: list[str], counts: list[Column], symbols: Column | None) -> Column:
        if not classes:
            return F.struct(symbols.alias("n_symbols"), F.array(*counts).alias("classes"))
        rest = F.regexp_replace(text, classes[0] + "+", "")

        def go_on(left: Column) -> Column:
            found = F.length(symbols_of(left)) if symbols is None else symbols
            return taken(left, classes[1:], [*counts, F.length(text) - F.length(left)], found)

        return let(rest, go_on)

    symbols_of = lambda left: F.regexp_replace(left, "[^#*$%&|<>]+", "")
    return let(glued, lambda g: F.struct(F.length(g).cast("long").alias("word_chars"), taken(g, list(CLASSES.values()), [], None).alias("found")))


def divergence(pairs: Column) -> Column:
    """Jensen-Shannon divergence, base 2, of an array of structs (p, q)."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return F.aggregate(
        pairs, F.lit(0.0), lambda total, x: total + (part(x["p"], (x["p"] + x["q"]) / 2) + part(x["q"], (x["p"] + x["q"]) / 2)) / 2
    )


def class_shares(counts: Column, word_chars: Column) -> Column:
    """Shares of the character classes (counts: an array of theirs) among the characters of words."""
    known = [(F.get(counts, F.lit(i)) / word_chars).cast("double") for i in range(len(CLASSES))]
    return F.array(*known, F.greatest(F.lit(0.0), F.lit(1.0) - sum(known[1:], known[0])))


def common_words(documents: DataFrame) -> DataFrame:
    """The most common words of each language, of letters only, counted over all its documents: _lang, _common (array)."""
    words = documents.select(F.col("lang").alias("_lang"), F.explode(words_of(F.col("text"))).alias("word"))
    counted = words.groupBy("_lang", "word").agg(F.count(F.lit(1)).alias("n")).where("word rlike '^\\\\p{L}+$'")
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("n"), "word"))
    top = counted.withColumn("rank", rank).where(F.col("rank") <= COMMON_WORDS)
    return top.groupBy("_lang").agg(F.array_sort(F.collect_list("word")).alias("_common"))


def word_shares(words: Column, common: Column) -> Column:
    """Shares of the common words among all words, and of the other words.

    Words no longer than the longest common one stand between two blanks each; what goes when a word and its
    blanks are removed tells how often it stands there.
    """

    def shares(spaced: Column) -> Column:
        gone = lambda c: F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.concat(F.lit(" "), c, F.lit(" ")), F.lit("")))
        held = F.transform(common, lambda c: (gone(c) / (F.octet_length(c) + 2)).cast("int"))
        n = F.size(words).cast("double")
        return let(held, lambda k: F.concat(F.transform(k, lambda x: x / n), F.array(1.0 - F.aggregate(k, F.lit(0), lambda a, x: a + x) / n)))

    longest = F.array_max(F.transform(common, lambda c: F.octet_length(c)))
    short = let(longest, lambda most: F.filter(words, lambda x: F.octet_length(x) <= most))
    return let(F.concat(F.lit(" "), F.array_join(short, "  "), F.lit(" ")), shares)


def measured(documents: DataFrame) -> DataFrame:
    """Base columns of every document and its two histograms; documents bring _common, their language's words."""
    common = F.col("_common")
    judged = lambda w: F.struct(
        F.size(w).cast("long").alias("n"),
        repeated_words(w).alias("repeated"),
        character_counts(w).alias("chars"),
        F.when((F.size(w) >= MIN_WORDS) & common.isNotNull(), word_shares(w, common)).alias("shares"),
    )
    counted = documents.select("*", let(words_of(F.col("text")), judged).alias("_words"), duplicate_lines(F.col("text")).alias("n_dup_lines"))
    named = counted.withColumns({
        "n_words": F.col("_words.n"),
        "word_chars": F.col("_words.chars.word_chars"),
        "n_symbols": F.col("_words.chars.found.n_symbols").cast("long"),
        "n_repeat_words": F.col("_words.repeated"),
        "_word_shares": F.col("_words.shares"),
    })
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    enough = ~failed & (F.col("word_chars") >= MIN_CHARS)
    return named.withColumns({
        "base_failed": failed,
        "_class_shares": F.when(enough, class_shares(F.col("_words.chars.found.classes"), F.col("word_chars"))),
    }).drop("_words")


def _mean(shares: str, n: int) -> Column:
    return F.array(*[F.avg(F.get(F.col(shares), F.lit(i))) for i in range(n)])


def _distance(shares: str, reference: str) -> Column:
    return F.when(F.col(shares).isNotNull() & F.col(reference).isNotNull(), F.sqrt(F.greatest(F.lit(0.0), divergence(F.arrays_zip(F.col(shares).alias("p"), F.col(reference).alias("q"))))))


def quality(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Base counts, distances and verdict for every document.

    Takes text and lang. keep: columns of documents that the result has too (all, if none are named), unless
    they bear a result's name, when the result replaces them. Null texts have no words. A null or rare language has no reference, and its
    documents, like those under the least lengths, are judged by the base rules alone. Repeated rows
    get equal results; an empty table gives an empty result. What is joined is a row for each
    language, broadcast behind a check of their number; beyond it, the join shuffles and splits hot languages.
    """
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chars_distance", "words_distance", "kept"]
    chosen = documents if keep is None else documents.select(*dict.fromkeys([*keep, "text", "lang"]))
    documents, names = shield(chosen, ("text", "lang"), tuple(results))
    names = names if keep is None else {c: name for c, name in names.items() if c in keep}
    columns = list(names.values())
    common = Written(common_words(documents.where("lang is not null")), "common").df
    judged = measured(documents.join(broadcast_if_small(common, common.count()), documents["lang"] == common["_lang"], "left").drop("_lang"))
    judged = Written(judged.select(*dict.fromkeys([*columns, "lang"]), *results[:6], "_class_shares", "_word_shares"), "measured").df
    # The histograms' means: a sum for each language and class, made in each task first.
    sums = judged.where("lang is not null and _class_shares is not null").groupBy(F.col("lang").alias("_lang"))
    means = sums.agg(F.count(F.lit(1)).alias("_n"), _mean("_class_shares", len(CLASSES) + 1).alias("_class_means"), _mean("_word_shares", COMMON_WORDS + 1).alias("_word_means"))
    references = Written(means.where(F.col("_n") >= MIN_DOCUMENTS).drop("_n"), "references").df
    known = judged.join(broadcast_if_small(references, references.count()), judged["lang"] == references["_lang"], "left")
    found = known.withColumns({
        "chars_distance": _distance("_class_shares", "_class_means"),
        "words_distance": F.when(~F.col("base_failed"), _distance("_word_shares", "_word_means")),
    })
    chars, words = (F.coalesce(c, F.lit(0.0)) for c in ("chars_distance", "words_distance"))
    near = (chars <= MAX_CHARS_DISTANCE) & (F.sqrt(chars * chars + words * words) <= MAX_DISTANCE)
    return found.select(*[F.col(name).alias(c) for c, name in names.items()], *results[:-1], (~F.col("base_failed") & near).alias("kept"))


def _oracle() -> str:
    """The whole verdict in DuckDB's SQL; doc_id is unique in its table."""
    word, letters = r"[^\x20\x09-\x0D]+", r"\p{L}+"
    classes = [r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[.,;:!?''\"()-]", r"[#*$%&|<>@^~_=+/\\\[\]{}`]"]
    counts = ", ".join(f"(length(text) - length(regexp_replace(text, '{c}', '', 'g')))::DOUBLE / word_chars" for c in classes)
    half = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((p + q) / 2)) ELSE 0.0::DOUBLE END"
    distance = f"sqrt(greatest(0.0::DOUBLE, sum({half('p')} + {half('q')}) / 2))"
    return f"""
    WITH d AS (
        SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM documents),
    windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
    twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    held AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
    counted AS (
        SELECT d.doc_id, lang, text, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
               CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
               CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(held.n, 0) AS BIGINT) AS n_repeat_words
        FROM d LEFT JOIN held USING (doc_id)),
    base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
    common AS (
        SELECT lang, word FROM (SELECT lang, unnest(w) AS word FROM d WHERE lang IS NOT NULL) WHERE regexp_full_match(word, '{letters}') GROUP BY lang, word
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) <= {COMMON_WORDS}),
    shares AS (SELECT doc_id, lang, [{counts}] AS s FROM base WHERE NOT base_failed AND word_chars >= {MIN_CHARS}),
    chars AS (
        SELECT doc_id, lang, 'c' || i AS k, CASE WHEN i <= 5 THEN s[i] ELSE greatest(0.0::DOUBLE, 1 - list_sum(s)) END AS p
        FROM (SELECT *, unnest(range(1, 7)) AS i FROM shares)),
    each AS (SELECT doc_id, base.lang AS lang, word AS k, len(list_filter(w, lambda x: x = word)) / n_words AS p FROM base JOIN common ON base.lang = common.lang WHERE n_words >= {MIN_WORDS}),
    words AS (SELECT * FROM each UNION ALL SELECT doc_id, lang, '', 1 - sum(p) FROM each GROUP BY doc_id, lang),
    means AS (
        SELECT lang, k, avg(p) AS q FROM (SELECT * FROM chars UNION ALL SELECT words.* FROM words SEMI JOIN shares USING (doc_id)) AS x
        WHERE lang IN (SELECT lang FROM shares GROUP BY lang HAVING count(*) >= {MIN_DOCUMENTS}) GROUP BY lang, k),
    near_chars AS (SELECT doc_id, {distance} AS x FROM chars JOIN means USING (lang, k) GROUP BY doc_id),
    near_words AS (SELECT doc_id, {distance} AS x FROM words JOIN means USING (lang, k) GROUP BY doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND coalesce(c.x, 0) <= {MAX_CHARS_DISTANCE} AND sqrt(coalesce(c.x, 0) ** 2 + coalesce(n.x, 0) ** 2) <= {MAX_DISTANCE} AS kept
    FROM base LEFT JOIN near_chars c USING (doc_id) LEFT JOIN near_words n USING (doc_id)"""


ORACLE = _oracle()
