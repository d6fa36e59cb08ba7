"""Secret scans: rules, and sliding-window Shannon entropy over candidate strings, all in SQL functions."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.quality import let

#: Base rules, in order of kind: pattern, its group whose length counts, the least length. As runs of
#: one class are maximal, a least length inside the pattern of access and hex changes nothing.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
LEAST_ASSIGNED = 6

#: Candidate strings and their alphabet; a window is this long.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Character classes of candidates, the first that fits: whole-string pattern, bits from which a window is random. Numbers (dates,
#: telephone and account numbers) have no window over the bits of their class: their highest possible entropy is 3.3 bits.
CLASSES = (("^[0-9+/_=-]+$", 99.0), ("^[0-9a-fA-F]+$", 3.0), ("^[a-z_=+/-]+$|^[A-Z_=+/-]+$", 4.1), (".*", 3.85))
#: Whole candidates that are no secrets: identifiers of known shapes, runs of separators, paths.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[-_=+/]+$",
    # Possessive, so that Java's engine loops over the segments instead of calling itself; a segment ends at its slash either way.
    r"^/?(?:[a-z0-9_-]{1,19}/)++[a-z0-9_-]*$",
)
#: Parts of candidates that are no secrets, placeholders and runs: windows that overlap one don't count.
ALLOWED_PART = r"(?i:example|placeholder|changeme|your[_-]|dummy|sample|test[_-]?key|abcdefghij|0123456789)|(.)\1{7,}"


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda total, n: total + n)


def running_sums(lengths: Column, chunk: int = 256) -> Column:
    """Running sums of an array: sums of chunks first, so that long arrays take no quadratic time."""

    def with_chunks(x: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / chunk).cast("int")), lambda c: _sum(F.slice(x, c * chunk + 1, chunk)))
        bases = lambda s: F.transform(s, lambda _, c: _sum(F.when(c > 0, F.slice(s, F.lit(1), c)).otherwise(F.array().cast("array<int>"))))
        place = lambda i: F.floor(i / chunk).cast("int")
        return let(let(chunks, bases), lambda base: F.transform(x, lambda _, i: F.get(base, place(i)) + _sum(F.slice(x, place(i) * chunk + 1, i % chunk + 1))))

    return let(lengths, with_chunks)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches: an array of structs (start, end, found), in code points."""
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def place(found: Column) -> Column:
        gaps = F.split(text, pattern)
        lengths = F.zip_with(gaps, found, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
        groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        struct = lambda m, end, g: F.struct((end - F.length(m)).alias("start"), end.alias("end"), g.alias("found"))
        zipped = lambda ends: F.transform(F.arrays_zip(found.alias("m"), F.slice(ends, F.lit(1), F.size(found)).alias("e"), groups.alias("g")), lambda x: struct(x["m"], x["e"], x["g"]))
        return F.when(F.size(found) > 0, let(running_sums(lengths), zipped)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


#: Windows that are scanned together.
SCANNED = 4096


def highest_entropy(candidate: Column) -> Column:
    """Highest Shannon entropy, in bits a character, of a candidate's windows; 0 for a candidate without one.

    The state holds the sum of n log2 n over the window's counts n. A step changes it by two counts alone, those of the character that
    enters and of the one that leaves.
    """
    letters = F.split(candidate, "")
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    weight = [n * log2(n) if n > 1 else 0.0 for n in range(WINDOW + 2)]
    # What one more of a character that the window holds n times changes in the sum, by n.
    gains = F.array(*[F.lit(weight[n + 1] - weight[n]) for n in range(WINDOW + 1)])

    def scan(code: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            before = F.slice(code, F.greatest(i - WINDOW, F.lit(0)) + 1, F.least(i, F.lit(WINDOW)))
            count = lambda x: F.size(F.filter(before, lambda c: c == x))
            into, full = F.get(code, i), i >= WINDOW
            out = F.when(full, F.get(code, i - WINDOW)).otherwise("")
            left = F.when(full, F.get(gains, count(out) - 1)).otherwise(0.0)
            total = state["sum"] - left + F.get(gains, count(into) - (out == into).cast("int"))
            bits = F.when(i >= WINDOW - 1, F.lit(log2(WINDOW)) - total / WINDOW).otherwise(0.0)
            return F.struct(total.alias("sum"), F.greatest(state["best"], bits).alias("best"))

        return F.aggregate(F.sequence(F.lit(0), F.size(code) - 1), start, step, lambda state: state["best"])

    return let(letters, scan)


def is_random(part: Column, least: Column) -> Column:
    """Some window of a part reaches so many bits. A block of d different characters has at most log2(d); only those that may reach it are scanned."""
    reaches = lambda block: F.log2(F.size(F.array_distinct(F.split(block, ""))).cast("double")) >= least
    return F.exists(blocks(part), lambda block: reaches(block) & (highest_entropy(block) >= least))


def blocks(part: Column) -> Column:
    """A string in pieces of SCANNED windows each (a character begins a window), so that a long one is scanned with little at a time."""
    return F.regexp_extract_all(part, F.lit(rf"(?=(.{{1,{SCANNED + WINDOW - 1}}})).{{1,{SCANNED}}}"), F.lit(1))


def random_strings(text: Column) -> Column:
    """Candidates, as spans, that aren't allowed as a whole and hold a random window apart from allowed parts."""

    def suspicious(x: Column) -> Column:
        least = F.when(x["found"].rlike(CLASSES[0][0]), CLASSES[0][1])
        for pattern, bits in CLASSES[1:]:
            least = least.when(x["found"].rlike(pattern), bits)
        allowed = x["found"].rlike(ALLOWED[0])
        for pattern in ALLOWED[1:]:
            allowed = allowed | x["found"].rlike(pattern)
        parts = F.filter(F.split(x["found"], ALLOWED_PART), lambda part: F.length(part) >= WINDOW)
        return F.when(allowed, F.lit(False)).otherwise(F.exists(parts, lambda part: is_random(part, least)))

    return F.filter(matches(text, CANDIDATE), suspicious)


def find_secrets(documents: DataFrame, text_column: str = "text") -> DataFrame:
    """Add secret_spans to documents: an array of (start, kind, end) by start, then kind; kind indexes KINDS.

    Offsets are code points, the end is exclusive. Null texts count as empty. Spans of the base rules
    always stay; an entropy span is added unless it lies inside one of them. The scan is a projection: no
    shuffle, and repeated rows, ties or other columns don't matter (a column named secret_spans is replaced). No pattern recurses on long
    texts, and time is linear in a text's length.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rules = ((ASSIGN, 2, LEAST_ASSIGNED), (ACCESS, 0, 0), (HEX, 0, 0))

    def spans(found: Column, kind: int) -> Column:
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    def long_enough(found: Column, least: int) -> Column:
        return F.filter(found, lambda x: F.length(x["found"]) >= least) if least else found

    base = F.concat(*[spans(long_enough(matches(text, pattern, group), least), kind) for kind, (pattern, group, least) in enumerate(rules)])

    def with_entropy(known: Column) -> Column:
        inside = lambda x: F.exists(known, lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"]))
        return F.sort_array(F.concat(known, F.filter(spans(random_strings(text), len(rules)), lambda x: ~inside(x))))

    return documents.withColumn("secret_spans", let(base, with_entropy))


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def secret_report(documents: DataFrame) -> DataFrame:
    """Counts by kind and digests of the spans for every document."""
    found = find_secrets(documents.select("doc_id", "text"))
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    base = joined(F.filter(spans, lambda x: x["kind"] < 3))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(base, 256).alias("base_sha256"), joined(spans).alias("spans")
    )
