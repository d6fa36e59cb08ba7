"""Conversation repair by dynamic programming over a trie of signatures.

A conversation's signature has one letter a row: its role's initial and its fault. The cheapest edits depend on nothing else. Distinct signatures
are range-partitioned and sorted, so that those with a common beginning follow each other in one task: a walk over their prefix
trie in that order computes one layer of least costs a node, once for all signatures below it, and each terminal node reads its edits
off the layers above. Texts meet the edits again as sorted streams, so no conversation is held in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import Written, spread_join

#: What edits cost. A truncated row that stays costs more by another 3.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Damage is dealt by crc32 of conv_id:turn modulo this.
DAMAGES = 20
BROADCAST_BYTES = 8 << 20
LARGEST_LONG = (1 << 63) - 1

# States of a repaired conversation, by its last role's initial: nothing yet, system, user, assistant. Where each initial leads:
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
#: The state after an inserted or re-roled row: the one initial of user and assistant that may follow.
NEXT = (USER, USER, ASSISTANT, USER)
ENDS = (NOTHING, ASSISTANT)
FAR = 1 << 60
#: The letter of a row that must go; all others are the role's initial (o for any other role), upper case where the row is truncated.
GOES = "x"


def moves(letter: str) -> list[tuple[str, int, tuple[int | None, ...]]]:
    """Edits of a row, in ASCII order: the edit's initial, its cost, and the state it leads to from each state."""
    found: list[tuple[str, int, tuple[int | None, ...]]] = [("D", DELETE, (NOTHING, SYSTEM, USER, ASSISTANT))]
    if letter != GOES:
        more = TRUNCATED if letter.isupper() else 0
        if letter.lower() in FOLLOWS:
            found.append(("K", more, FOLLOWS[letter.lower()]))
        found.append(("R", REROLE + more, NEXT))
    return found


MOVES = {letter: moves(letter) for letter in "xsuaoSUAO"}


def _inserted(costs: list[int]) -> tuple[int, ...]:
    """Least costs of a layer once rows may be inserted."""
    for _ in range(2):  # no third insertion in a row leads to a state that one of the first two doesn't
        for state in range(4):
            costs[NEXT[state]] = min(costs[NEXT[state]], costs[state] + INSERT)
    return tuple(costs)


#: The layer above the first row.
ROOT = _inserted([0, FAR, FAR, FAR])


def layer(above: tuple[int, ...], letter: str) -> tuple[int, ...]:
    """Least costs of each state after one more row."""
    costs = [FAR] * 4
    for _, cost, to in MOVES[letter]:
        for state in range(4):
            if to[state] is not None:
                costs[to[state]] = min(costs[to[state]], above[state] + cost)
    return _inserted(costs)


def cheapest(signature: str, layers: list[tuple[int, ...]]) -> tuple[int, str]:
    """Cost and edits of a terminal node, from the layers on its path: of the cheapest edits the least in ASCII order.

    Backwards, the states on a cheapest path are marked; forwards, the least edit that stays on them is taken. Edits
    fix all roles, so one state is reached at a time.
    """
    total = min(layers[-1][state] for state in ENDS)
    on = [0] * len(layers)  # a bit a state
    for i in range(len(layers) - 1, -1, -1):
        here, marks = layers[i], 0
        if i + 1 == len(layers):
            marks = sum(1 << s for s in ENDS if here[s] == total)
        else:
            below, ahead = on[i + 1], layers[i + 1]
            for _, cost, to in MOVES[signature[i]]:
                for s in range(4):
                    if to[s] is not None and below >> to[s] & 1 and here[s] + cost == ahead[to[s]]:
                        marks |= 1 << s
        for _ in range(2):
            for s in range(4):
                if marks >> NEXT[s] & 1 and here[s] + INSERT == here[NEXT[s]]:
                    marks |= 1 << s
        on[i] = marks
    edits, state, i = [], NOTHING, 0
    while True:
        here = layers[i]
        if i == len(signature):
            if state in ENDS and here[state] == total:
                return total, "".join(edits)
            options = []
        else:
            options = [(e, i + 1, to[state]) for e, cost, to in MOVES[signature[i]] if to[state] is not None and on[i + 1] >> to[state] & 1 and here[state] + cost == layers[i + 1][to[state]]]
        if on[i] >> NEXT[state] & 1 and here[state] + INSERT == here[NEXT[state]]:
            options.append(("I", i, NEXT[state]))
        edit, i, state = min(options)
        edits.append(edit)


def walk(signatures: Iterable[str]) -> Iterator[tuple[str, int, str]]:
    """Signatures in order with their cost and edits. The path from the trie's root to the node at hand is held, a layer a node."""
    path, layers = "", [ROOT]
    for signature in signatures:
        shared = 0
        for a, b in zip(path, signature, strict=False):
            if a != b:
                break
            shared += 1
        del layers[shared + 1 :]
        for letter in signature[shared:]:
            layers.append(layer(layers[-1], letter))
        path = signature
        yield signature, *cheapest(signature, layers)


def repairs(signatures: DataFrame) -> DataFrame:
    """Cost and edits (audit) of distinct signatures (one column): signature, cost, audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = walk(s for batch in batches for s in batch.column(0).to_pylist())
        kinds = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
        rows, size = [], 0
        for row in found:
            rows.append(row)
            size += len(row[0])
            if size > 1 << 20 or len(rows) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=kinds)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=kinds)

    once = signatures.select(F.col(signatures.columns[0]).alias("signature")).distinct()
    return once.repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(run, "signature string, cost long, audit string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) after the damage: copies (0 where the row is dropped) and the new role and text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % DAMAGES
    rows = conversations.select("conv_id", "turn", kind.alias("_kind"), space("role").alias("_role"), space("text").alias("_text"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text"))
    copies = F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _streams(batches: Iterator[pa.RecordBatch], state: type, columns: list[str], results: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their conversation (the first column), one after the other, into a state each; results of conversations that are over."""
    current, out, kinds = None, [], None
    for batch in batches:
        kinds = kinds or pa.schema([("conv_id", batch.schema.field(columns[0]).type), *results])
        for conversation, *row in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
            if current is None or conversation != current.conversation:
                if current is not None:
                    out.append({"conv_id": current.conversation, **current.result()})
                current = state(conversation)
            current.add(*row)
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)
            out = []
    if current is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": current.conversation, **current.result()}], kinds)


class _Signature:
    """Counts and signature of one conversation, from its rows in order: a byte a row is held."""

    LEGAL = frozenset(("su", "ua", "au"))

    def __init__(self, conversation: object):
        self.conversation, self.letters, self.before = conversation, bytearray(), ""
        self.first = self.last = None
        self.turns = self.illegal = 0
        self.faults = {"b": 0, "d": 0, "t": 0, "": 0}

    def add(self, turn: int | None, initial: str, fault: str, copies: int) -> None:
        for copy in range(copies):
            if turn is not None and copy == 0 and (self.last is None or turn != self.last):
                self.first = turn if self.first is None else self.first
                self.last, self.turns = turn, self.turns + 1
            own = "d" if copy and fault != "b" else fault  # a copy repeats the row before it
            self.faults[own] += 1
            known = initial if initial in FOLLOWS else "o"
            self.illegal += bool(self.before) and self.before + known not in self.LEGAL
            self.before = known
            self.letters += (GOES if own in ("b", "d") else known.upper() if own == "t" else known).encode()

    def result(self) -> dict:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        f = self.faults
        return {"gaps": min(gaps, LARGEST_LONG), "blank": f["b"], "duplicate": f["d"], "truncated": f["t"], "illegal": self.illegal, "signature": self.letters.decode()}


class _Repaired:
    """Digest of one conversation's repaired rows, from its edits and then its rows in order: a hash's state is held, and the edits."""

    def __init__(self, conversation: object):
        self.conversation, self.hash, self.rows = conversation, hashlib.sha256(), 0
        self.found, self.edits, self.at, self.state = {}, "", 0, NOTHING

    def _row(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.rows else "") + role + ":" + text).encode())
        self.rows += 1
        self.state = FOLLOWS[role[0]][self.state]

    def _open(self) -> str:
        return "user" if NEXT[self.state] == USER else "assistant"

    def _inserts(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self._row(self._open(), "")
            self.at += 1

    def add(self, found: dict | None, role: str | None, text: str | None, copies: int | None) -> None:
        if found is not None:
            self.found, self.edits = found, found["audit"]
            return
        for _ in range(copies):
            self._inserts()
            edit = self.edits[self.at]
            self.at += 1
            if edit != "D":
                self._row(role if edit == "K" else self._open(), text)

    def result(self) -> dict:
        self._inserts()
        return {**self.found, "repaired_sha256": self.hash.hexdigest()}


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def signatures(rows: DataFrame) -> DataFrame:
    """Counts of faults and the signature of each conversation of damaged rows: conv_id, gaps, blank, duplicate, truncated, illegal, signature.

    One shuffle, of rows without their texts. A row whose role and text (by length and SHA-256) stand earlier in its conversation is a duplicate.
    """
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    narrow = rows.select("conv_id", "turn", "role", _digest(), "copies", (F.length(bare) == 0).alias("_blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("_cut"))
    same = Window.partitionBy("conv_id", "role", "_digest", F.col("copies") == 0).orderBy("turn")
    fault = F.when(F.col("_blank"), "b").when(F.row_number().over(same) > 1, "d").when(F.col("_cut"), "t").otherwise("")
    # The window's keys begin with the conversation, so it needs no shuffle of its own.
    placed = narrow.repartition("conv_id").withColumn("_fault", fault).withColumn("_initial", F.substring("role", 1, 1))
    sorted_ = placed.sortWithinPartitions("conv_id", "turn", "role", "_digest").select("conv_id", "turn", "_initial", "_fault", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _streams(batches, _Signature, ["conv_id", "turn", "_initial", "_fault", "copies"], [*((c, pa.int64()) for c in COUNTS), ("signature", pa.string())])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return sorted_.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, signature string")


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("_digest")


def repair_report(conversations: DataFrame) -> DataFrame:
    """Faults, cheapest edits and repaired digest of every damaged conversation (conv_id, turn, role, text).

    Null roles and texts are one space; a null conv_id is a conversation of its own. Rows of one turn go by role and then by their text's SHA-256, after
    the damage; exact repeats are duplicates. Other columns are left out; an empty table has no rows. A conversation's digest is one hash over its rows in
    order, so they pass through one task, which holds the hash's state and a byte a row.
    """
    rows = damaged(conversations)
    found = Written(signatures(rows), "signatures").df
    answers = Written(repairs(found.select("signature")), "repairs").df
    n, size = answers.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("signature") + F.octet_length("audit") + 64), F.lit(0))).first()
    # Many conversations share a signature: where the answers aren't small, a frequent one's rows are dealt over many tasks.
    solved = found.join(F.broadcast(answers), "signature") if size <= BROADCAST_BYTES else spread_join(found, answers, ["signature"], found.count())
    null = lambda kind: F.lit(None).cast(kind)
    edits = solved.select("conv_id", null("long").alias("turn"), null("string").alias("role"), null("binary").alias("_digest"), F.struct(*COUNTS, "cost", "audit").alias("_found"), null("string").alias("text"), null("int").alias("copies"))
    texts = rows.where("copies > 0").select("conv_id", "turn", "role", _digest(), null(edits.schema["_found"].dataType).alias("_found"), "text", "copies")
    both = edits.unionAll(texts).repartition("conv_id").sortWithinPartitions("conv_id", F.col("_found").isNull(), "turn", "role", "_digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _streams(batches, _Repaired, ["conv_id", "_found", "role", "text", "copies"], [*((c, pa.int64()) for c in (*COUNTS, "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return both.select("conv_id", "_found", "role", "text", "copies").mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in (*COUNTS, 'cost'))}, audit string, repaired_sha256 string")
