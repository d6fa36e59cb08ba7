"""Entropy spans of the secret scan against a window-by-window search in plain Python."""

import collections
import math
import random
import re

from brindle.llm import secret_scan
from tests.llm.test_ops import RULES

LONG = re.compile("[A-Za-z0-9+/_=-]+")
WHOLE = [re.compile(x) for x in ("(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "[-_=+/]+", "/?([a-z0-9_-]{1,19}/)+[a-z0-9_-]*")]
PART = re.compile(r"example|placeholder|changeme|your[_-]|dummy|sample|test[_-]?key|abcdefghij|0123456789", re.IGNORECASE)


def bits(window):
    return -sum(n / 20 * math.log2(n / 20) for n in collections.Counter(window).values())


def least_bits(s):
    if re.fullmatch("[0-9+/_=-]+", s):
        return math.inf
    if re.fullmatch("[0-9a-fA-F]+", s):
        return 3.0
    return 4.1 if re.fullmatch("[a-z_=+/-]+|[A-Z_=+/-]+", s) else 3.85


def pieces(s):
    """What is left of a candidate without its allowed parts: words of placeholders and runs of over seven equal characters."""
    at, start, found = 0, 0, []
    while at < len(s):
        word, run = PART.match(s, at), next((i for i in range(at, len(s)) if s[i].lower() != s[at].lower()), len(s))
        end = word.end() if word else run if run - at >= 8 else None
        if end is None:
            at += 1
        else:
            found.append(s[start:at])
            at = start = end
    return [*found, s[start:]]


def spans_of(text):
    base = [(m.start(), k, m.end()) for k, (_, rule, group, least) in enumerate(RULES) for m in rule.finditer(text) if len(m.group(group)) >= least]
    found = list(base)
    for m in LONG.finditer(text):
        s = m.group()
        if len(s) < 20 or any(rule.fullmatch(s) for rule in WHOLE) or any(b[0] <= m.start() and m.end() <= b[2] for b in base):
            continue
        if any(bits(p[i : i + 20]) >= least_bits(s) for p in pieces(s) for i in range(len(p) - 19)):
            found.append((m.start(), 3, m.end()))
    return ",".join(f"{(*(r[0] for r in RULES), 'entropy')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_entropy_spans_against_every_window(spark):
    rng = random.Random(23)
    alphabets = [secret_scan.ALPHABET, "0123456789", "0123456789-/", "0123456789abcdef", "0123456789ABCDEFabcdef", "abcdefghijklmnopqrstuvwxyz_", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdeXYZ019", "-_=+/", "aB1"]
    fixed = ["example", "your_", "Dummy", "test-key", "0123456789", "aaaaaaaa", "AaAaAaAaA", "------------", "src/lib/", "/", "=", "token=", "secret: ", "AKIA", "550e8400-e29b-41d4-a716-446655440000"]
    texts = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(1, 8)):
            letters = rng.choice(alphabets)
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else "".join(rng.choice(letters) for _ in range(rng.choice([3, 12, 19, 20, 21, 30, 60]))))
            parts.append(rng.choice(["", "", " ", "\n", "é", "🙂 ", '"']))
        texts.append("".join(parts))
    want = {i: spans_of(t) for i, t in enumerate(texts)}
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.spans for r in secret_scan.secret_report(rows).collect()} == want
    kinds = collections.Counter(x.split(":")[0] for w in want.values() for x in w.split(",") if x)
    assert kinds["entropy"] > 100 and all(kinds[k] > 3 for k in ("assign", "hex"))


def test_very_long_candidates(spark):
    """Very many characters of paths, separators, one letter, hexadecimal, base64: no recursion, no time beyond linear."""
    rng = random.Random(31)
    n = 600_000
    base64 = "".join(rng.choices(secret_scan.ALPHABET[:64], k=50_000)) * (n // 50_000)
    hexes = "".join(rng.choices("0123456789ABCDEF", k=50_000)) * (n // 50_000)
    late = "xy" * (n // 2) + "9aF3kLq8Zx2Vb7Nm4Rt6Yw1Pc5"
    texts = ["a/" * (n // 2), "-=" * (n // 2), "x" * n, "A1-A-" * (n // 5), base64, hexes, late, "AKIA" * (n // 4), '"' * n]
    found = secret_scan.secret_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)).collect()
    spans = {r.doc_id: r.spans for r in found}
    assert [spans[i] for i in (0, 1, 2, 3, 8)] == [""] * 5
    assert spans[4] == f"entropy:0:{n}" and spans[5] == f"entropy:0:{n}" and spans[6] == f"entropy:0:{len(late)}" and spans[7] == f"access:0:{n}"


def test_windows_across_blocks(one, monkeypatch):
    """A random window that begins anywhere near a block's end is found."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(secret_scan, "SCANNED", 30)
    secret = "9aF3kLq8Zx2Vb7Nm4Rt6"
    for lead in range(25, 70, 7):
        text = "ab" * 40
        assert one(F.size(secret_scan.random_strings(F.lit(text[:lead] + secret + text[:9])))) == 1, lead
    assert one(F.size(secret_scan.random_strings(F.lit("ab" * 400)))) == 0
