"""Conversation repair against a search of the cheapest edits that knows no signatures."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import pytest

from brindle.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string, copies string, _found string, `a.b` int"
NONE = hashlib.sha256(b"").hexdigest()


def damaged(rows):
    """Rows after the damage, by conversation, in order."""
    shown = lambda x: " " if x is None else str(x)
    found = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        kind, role, text = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20, shown(role), shown(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        found[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for own in found.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return found


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def search(rows, bad):
    """Cheapest edits first, the least in ASCII order among them: cost, edits, repaired rows."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, edits, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, edits, out
        if (i, last) in done:
            continue
        done.add((i, last))

        def push(edit, more, at, role, text):
            if role[0] in {"": "su", "s": "u", "u": "a", "a": "u"}[last]:
                heapq.heappush(heap, (cost + more, edits + edit, at, role[0], (*out, f"{role}:{text}")))

        for new in ("user", "assistant"):
            push("I", 3, i, new, "")
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, last, out))
            if bad[i] not in ("blank", "duplicate"):
                extra = 3 if bad[i] == "truncated" else 0
                if role[:1] in ("s", "u", "a"):
                    push("K", extra, i + 1, role, text)
                for new in ("user", "assistant"):
                    push("R", 3 + extra, i + 1, new, text)


def brute(rows):
    out = []
    for conv, own in damaged(rows).items():
        bad = faults(own)
        turns = [t for t, _, _ in own if t is not None]
        initials = [role[:1] for _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, edits, repaired = search(own, bad)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *map(bad.count, ("blank", "duplicate", "truncated")), illegal, cost, edits, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    got = C.repair_report(spark.createDataFrame([(*r, "c", "f", 1) for r in rows], SCHEMA).repartition(3)).collect()
    return sorted(map(tuple, got), key=repr)


def make(seed, n):
    """Conversations with nulls in any column, ties, repeated rows, odd roles, blanks, unended texts."""
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "admin", "su"]
    texts = ["Yes.", "No!", "why? ", "cut", "", "  \n", " ", "b\x0b.", None, "é!", "last: ...\t", "?"]
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, 12)):
            usual = ["user", "assistant"][turn % 2]
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None, 2]), usual if rng.random() < 0.6 else rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Text {turn}."))
    return rows + rng.sample(rows, 30)


@pytest.mark.parametrize("limit", [0, C.BROADCAST_BYTES])
def test_random_conversations(spark, monkeypatch, limit):
    monkeypatch.setattr(C, "BROADCAST_BYTES", limit)
    monkeypatch.setattr("brindle.llm.common.HOT_FLOOR", 5)
    rows = make(3, 250)
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    assert run(spark, []) == []
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "A.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", NONE)]
    far = [(0, -(2**63), "user", "A."), (0, 2**63 - 1, "assistant", "B.")]
    assert run(spark, far)[0][1] in (0, 2**63 - 1)
    long = [(1, t, ["user", "assistant"][t % 2], f"{'long ' * 20_000 if t == 5 else t}.") for t in range(3000)]
    assert run(spark, long) == brute(long)


def test_walk_is_a_search_for_each_signature():
    """All signatures of up to four rows, and random longer ones: shared layers change nothing."""
    letters = "xsuaoSUAO"
    rng = random.Random(9)
    some = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 14))) for _ in range(300)]
    short = [""]
    for _ in range(3):
        short += [s + c for s in short for c in letters]
    ordered = sorted({*some, *short})
    for signature, cost, edits in C.walk(ordered):
        rows = [(0, {"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "tool"), "") for c in signature]
        bad = ["blank" if c == "x" else "truncated" if c.isupper() else "" for c in signature]
        assert (cost, edits) == search(rows, bad)[:2], signature


def test_layers_are_computed_once_a_shared_prefix(monkeypatch):
    calls, real = [], C.layer
    monkeypatch.setattr(C, "layer", lambda above, letter: calls.append(letter) or real(above, letter))
    assert [s for s, _, _ in C.walk(["ua", "uaua", "uauax", "uaxu"])] == ["ua", "uaua", "uauax", "uaxu"]
    assert len(calls) == 2 + 2 + 1 + 2
