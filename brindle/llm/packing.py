"""Best-fit packing by a configuration linear program over the length histogram.

Pieces are at most one sequence long, so their length histogram has at most that many entries
whatever the corpus. Only it reaches the driver. Configurations (multisets of lengths that fit one
sequence) cover the histogram; multiplicative weights price the lengths, a knapsack dynamic program
finds the best configuration at those prices, and its share of the cover is rounded to whole
sequences. The last few sequences' worth is packed best-fit decreasing, by counts. The plan then goes back to the pieces
by each piece's rank among those of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import Written, attempt
from brindle.llm.tokenizing import encoder, rounds

#: Pieces that a knapsack chooses from at least; steps in which the cover is made but for rounding; how fast prices follow the
#: cover; sequences whose worth is left to best fit; seed of the draws.
DRAW, STEPS, RATE, REST, SEED = 64, 1000, 0.5, 20, 42

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def token_pieces(documents: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Encode whole texts and cut those over the capacity; only the last piece may be shorter.

    task and nth number the pieces of each length within the task that made them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(vocabulary).encode, attempt()[0], np.zeros(capacity + 1, np.int64)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, texts in rounds(batch.column(1)):
                ids, ends = encode(texts, end_id)
                raw, rows, begin = ids.astype("<u4"), [], 0
                for name, end in zip(names[a:b], ends.tolist(), strict=True):
                    for piece, at in enumerate(range(begin, end, capacity)):
                        n = min(capacity, end - at)
                        rows.append((name, piece, at - begin, n, zlib.crc32(raw[at : at + n]), task, int(seen[n])))
                        seen[n] += 1
                    begin = end
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                arrays = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return documents.select("doc_id", "text").mapInArrow(cut, PIECES)


def drawn(left: np.ndarray, pieces: int, offset: float) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and counts of about so many of the pieces that are left, drawn in order of length.

    Half are drawn at even steps through the pieces, half through their tokens, so that long ones are among them.
    """
    chosen = np.zeros(len(left), np.int64)
    for mass in (left, left * np.arange(len(left))):
        upto = np.cumsum(mass)
        at = ((np.arange(pieces // 2) + offset) * (upto[-1] / (pieces // 2))).astype(np.int64)
        chosen += np.bincount(np.searchsorted(upto, at, "right"), minlength=len(left))
    chosen = np.minimum(chosen, left)
    lengths = np.flatnonzero(chosen)
    return lengths, chosen[lengths]


def best_configuration(lengths: np.ndarray, counts: np.ndarray, prices: np.ndarray, capacity: int) -> Counter:
    """Bounded knapsack by dynamic program: the best-priced of the multisets of lengths that fill a sequence most.

    A length is used no more often than it is counted: its copies are items of 1, 2, 4, ... of them at once.
    """
    items = []
    for n, k, price in zip(lengths.tolist(), counts.tolist(), prices.tolist(), strict=True):
        k, times = min(k, capacity // n), 1
        while k > 0:
            some = min(times, k)
            items.append((n, some, price * some))
            k, times = k - some, times * 2
    # value[room]: the best price of items that take up exactly this room.
    value, takes = np.full(capacity + 1, -np.inf), np.zeros((len(items), capacity + 1), bool)
    value[0] = 0.0
    for take, (n, some, price) in zip(takes, items, strict=True):
        with_it = value[: capacity + 1 - n * some] + price
        np.greater(with_it, value[n * some :], out=take[n * some :])
        np.maximum(with_it, value[n * some :], out=value[n * some :])
    room, held = int(np.flatnonzero(value > -np.inf)[-1]), Counter()
    for take, (n, some, _) in zip(takes[::-1], items[::-1], strict=True):
        if take[room]:
            held[n] += some
            room -= n * some
    return held


def configuration_program(counts: np.ndarray, capacity: int) -> tuple[list[tuple[list[int], int]], np.ndarray, np.ndarray]:
    """Multiplicative weights for the covering program: configurations with whole numbers of sequences, the counts left, last prices.

    A length costs its tokens, somewhat more for long ones, times a weight, the exponential of how far its cover lags behind
    that of all tokens; each configuration that is used multiplies the weights of its lengths by how
    far it covers them. A knapsack over a draw of the remaining pieces, a wider one where no
    choice fills a sequence, finds the best configuration at these prices. It is used for a fixed share of the sequences still needed, rounded at once to a whole number, one at
    least, and as its scarcest length allows, so later prices see the rounded cover. The loop ends when the rest is worth few
    sequences: steps grow with the logarithm of the corpus.
    """
    left, tokens = counts.copy(), np.arange(capacity + 1)
    least, total = np.maximum(counts, 1), int((counts * tokens).sum())
    rng, plan, todo = np.random.default_rng(SEED), [], total
    while todo > REST * capacity:
        pieces = int(left.sum())
        for wider in (1, 4, 16):
            lengths, some = drawn(left, wider * max(DRAW, 4 * capacity * pieces // todo), rng.random())
            prices = lengths * (1 + lengths / capacity) * np.exp(RATE * (left[lengths] / least[lengths] - todo / total))
            held = best_configuration(lengths, some, prices, capacity)
            if sum(n * k for n, k in held.items()) == capacity or int(some.sum()) == pieces:
                break
        times = max(1, min(todo // capacity // STEPS, *(int(left[n]) // k for n, k in held.items())))
        for n, k in held.items():
            left[n] -= k * times
            todo -= n * k * times
        plan.append((sorted(held.elements(), reverse=True), times))
    return plan, left, tokens * (1 + tokens / capacity) * np.exp(RATE * (left / least - todo / max(1, total)))


def least_sequences(counts: np.ndarray, prices: np.ndarray, capacity: int) -> int:
    """Lower bound on the sequences by duality: no sequence holds more than the best configuration's price.

    An unbounded knapsack over all lengths, so its price is no less than that of any configuration.
    """
    lengths, value = np.flatnonzero(counts), np.zeros(capacity + 1)
    for room in range(1, capacity + 1):
        fit = lengths[: np.searchsorted(lengths, room, "right")]
        value[room] = max(value[room - 1], (prices[fit] + value[room - fit]).max(initial=0.0))
    return int(np.ceil((prices * counts).sum() / value[capacity] - 1e-6)) if value[capacity] > 0 else 0


def packing_plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Configurations and the number of sequences of each; together they hold every piece once."""
    counts = np.zeros(capacity + 1, np.int64)
    for n, k in histogram.items():
        counts[n] = k
    whole, counts[capacity] = int(counts[capacity]), 0
    full = [([capacity], whole)] * bool(whole)
    plan, left, _ = configuration_program(counts, capacity)
    plan += best_fit(left, capacity)
    # Rounding may cost a sequence or two more than best fit when each length occurs a few times only.
    alone = best_fit(counts, capacity)
    return full + (plan if sum(times for _, times in plan) <= sum(times for _, times in alone) else alone)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing by counts: equal lengths go into equal open sequences together."""
    open_: dict[int, list[tuple[list[int], int]]] = {}
    rooms: list[int] = []

    def add(room: int, content: list[int], times: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((content, times))

    for n in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[n])
        while todo:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                per = capacity // n
                if todo >= per:
                    add(capacity - per * n, [n] * per, todo // per)
                    todo %= per
                else:
                    add(capacity - todo * n, [n] * todo, 1)
                    todo = 0
                continue
            room = rooms[at]
            content, times = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            each = min(room // n, max(1, todo // times))
            used = min(times, todo // each)
            add(room - each * n, content + [n] * each, used)
            if used < times:
                add(room, content, times - used)
            todo -= used * each
    return [x for found in open_.values() for x in found]


def slots(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """The plan by length and rank: from which rank on a slot takes the pieces, its first sequence, its offset.

    Rows: at most the plan's configurations times their pieces, whatever the number of documents.
    """
    taken: Counter = Counter()
    rows, sequence = [], 0
    for content, times in plan:
        offset = 0
        for n in content:
            rows.append((n, taken[n], sequence, offset))
            taken[n] += times
            offset += n
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(documents: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Pack documents into as few sequences of at most `capacity` tokens as the plan finds.

    Takes doc_id and text; other columns don't matter. Null text: empty, one token. Repeated rows are
    packed as often as they occur; null identifiers stay null. Result per piece: doc_id, piece, start,
    length, ids_crc32, sequence_id, offset. Ranks come from counts per task and length, so a length
    that a third of all pieces share isn't gathered anywhere.
    """
    spark = documents.sparkSession
    pieces = Written(token_pieces(documents, vocabulary, end_id, capacity), "pieces").df
    counted = Written(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths").df
    histogram = {int(r["length"]): int(r["n"]) for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(packing_plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = table.value
        order = (plan["length"] << 40) + plan["rank"]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            slot = np.searchsorted(order, (length << 40) + rank, "right") - 1
            sequence = plan["sequence"][slot] + rank - plan["rank"][slot]
            columns = [*batch.columns[:5], pa.array(sequence), pa.array(plan["offset"][slot])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
