"""Removal of long repeated byte strings by an index family of suffix arrays.

A match is long if it has `length` bytes, so suffixes are compared by their first `length` bytes (a window): arrays are in
the order of those bytes, equal windows stand side by side, and arrays merge like any sorted lists.

Not every suffix travels. A window's key is the least hash of its `GRAM`-byte strings. Equal windows
have equal keys, and neighbouring windows mostly share one, so windows fall into runs of one key, about
one for each 80 bytes. Runs, as (key, digest of the run's text), are the sampled suffixes that all documents' arrays hold:

1. Keys that occur at one place only can't hold a repeat and go.
2. Runs whose whole text stands at two places or more are repeats in all their windows; they are counted
   in partial aggregates, so a group of copies of any size comes down to a row in each task.
3. What is left are the edges of repeats: keys with differing runs. One run of each text fetches its
   bytes, and the windows of a key meet in an index family: each new batch gets a suffix array, which is
   merge-scanned against the arrays of all levels, and arrays of equal size merge into one of the next level.

A key with very many differing runs would make one family, and its task, as large as the corpus. Windows of
such keys are spread instead by their own digests and counted in partial aggregates.

Windows found twice become byte intervals, which go back to their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import Written, spread_semi_join

#: Bytes of the strings whose least hash is a window's key.
GRAM = 40
#: Bytes of text that array operations cover at once.
CHUNK = 1 << 18
#: Windows of a batch of the index family.
BATCH_WINDOWS = 1 << 16
#: Differing runs of a key (80 windows each, on average) beyond which its windows are spread by digest.
HOT_RUNS = 4096

_POWERS = 8
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _RANDOM.integers(0, 2**64, (2, 256), dtype=np.uint64)
_FACTORS = _RANDOM.integers(0, 2**64, (2, _POWERS + 1), dtype=np.uint64) | np.uint64(1)


def _ladder(data: np.ndarray, upto: int, family: int = 0) -> list[np.ndarray]:
    """Hashes of all strings of 1, 2, 4, ... bytes, up to `upto`."""
    found = [_BYTES[family][data]]
    for level in range(upto.bit_length() - 1):
        h, span = found[-1], 1 << level
        found.append(h[:-span] * _FACTORS[family, level] + h[span:] if len(h) > span else h[:0])
    return found


def _combined(ladder: list[np.ndarray], size: int, at: np.ndarray | slice, family: int = 0) -> np.ndarray:
    """Hashes of the strings of `size` bytes at some places, put together from the ladder's powers of two."""
    total, offset = None, 0
    for level in reversed(range(size.bit_length())):
        if size >> level & 1:
            part = ladder[level][at + offset] if isinstance(at, np.ndarray) else ladder[level][offset : len(ladder[0]) - size + 1 + offset]
            total = part.copy() if total is None else total * _FACTORS[family, _POWERS] + part
            offset += 1 << level
    return _mixed(total)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Least or largest of every `width` neighbours."""
    span, best = 1, values
    while span * 2 <= width:
        best = pick(best[:-span], best[span:])
        span *= 2
    return pick(best[: len(values) - width + 1], best[width - span :]) if width > span else best


def _joint(batch_texts: list[bytes], length: int) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Texts put together into chunks: the chunk's bytes, and its parts as (text, offset in it, offset in the chunk).

    A long text is cut into parts that overlap by length - 1 bytes, so that each window lies in one part.
    """
    held, parts, size = [], [], 0
    for i, text in enumerate(batch_texts):
        for at in range(0, max(1, len(text) - length + 1), CHUNK):
            piece = text[at : at + CHUNK + length - 1]
            if len(piece) < length:
                continue
            parts.append((i, at, size))
            held.append(piece)
            size += len(piece)
            if size >= CHUNK:
                yield b"".join(held), parts
                held, parts, size = [], [], 0
    if held:
        yield b"".join(held), parts


def runs(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one key: text index, first window, windows, key, digest, whether the key alone repeats inside."""
    width = length - GRAM + 1
    for data, parts in _joint(texts, length):
        raw = np.frombuffer(data, np.uint8)
        ladder = _ladder(raw, length)
        grams = _combined(ladder, GRAM, slice(None))
        keys = _sliding(grams, width, np.minimum)
        begins = np.array([p[2] for p in parts])
        ends = np.append(begins[1:], len(raw)) - length  # last window of each part
        place = np.arange(len(keys))
        part = np.searchsorted(begins, place, "right") - 1
        valid = place <= ends[part]
        opens = np.empty(len(keys), bool)
        opens[0] = True
        np.not_equal(keys[1:], keys[:-1], out=opens[1:])
        opens[begins] = True
        opens[1:] |= valid[1:] != valid[:-1]
        start = np.flatnonzero(opens)
        # A run takes no more windows than one gram can be least in, so that two windows cover its text.
        long_ = np.diff(np.append(start, len(keys)))
        extra = (long_ - 1) // width
        if extra.any():
            start = np.concatenate([start, *[s + width * np.arange(1, e + 1) for s, e in zip(start[extra > 0].tolist(), extra[extra > 0].tolist(), strict=True)]])
            start.sort()
        count = np.diff(np.append(start, len(keys)))
        keep = valid[start]
        start, count = start[keep], count[keep]
        key = keys[start]
        # Grams that are least in some window; a key with more such grams than runs repeats inside a run.
        padded = np.zeros(len(keys) + 2 * (width - 1), np.uint64)
        padded[width - 1 : width - 1 + len(keys)] = np.where(valid, keys, 0)
        least = grams == _sliding(padded, width, np.maximum)
        names, times = np.unique(grams[least], return_counts=True)
        of = np.searchsorted(names, key)
        of[of == len(names)] = 0
        inside = (names[of] == key) & (times[of] > 1)
        digest = _combined(ladder, length, start) * np.uint64(0x9E3779B97F4A7C15) + _combined(ladder, length, start + count - 1) + count.astype(np.uint64)
        owner = part[start]
        text = np.array([p[0] for p in parts])[owner]
        first = start - begins[owner] + np.array([p[1] for p in parts])[owner]
        yield text, first, count, key, _mixed(digest), inside


def _pack(first: np.ndarray, count: np.ndarray, inside: np.ndarray) -> np.ndarray:
    return (first.astype(np.int64) << 9) | (count.astype(np.int64) << 1) | inside


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sampled_suffixes(documents: DataFrame, length: int) -> DataFrame:
    """All runs of all documents: key, digest, row (two columns), place (first window, windows, inside in one number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for text, first, count, key, digest, inside in runs(_texts(batch.column(2)), length):
                columns = [key.view(np.int64), digest.view(np.int64), ids[text], marks[text], _pack(first, count, inside)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "digest", "row_id", "row_mark", "place"])

    return documents.select("row_id", "row_mark", "text").mapInArrow(run, "key long, digest long, row_id long, row_mark long, place long")


def _windows(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings put together, and where in that each of their windows begins."""
    sizes = np.array([len(x) for x in strings])
    begins, n = np.cumsum(sizes) - sizes, sizes - length + 1
    upto = np.cumsum(n)
    return np.frombuffer(b"".join(strings), np.uint8), np.repeat(begins - (upto - n), n) + np.arange(upto[-1])


class IndexFamily:
    """Suffix arrays in levels of geometric sizes over texts that come in batches.

    An array holds places of suffixes (windows) in the order of their bytes; a window's number is its place
    among all windows added. Suffixes are compared byte by byte, over the `length` that makes a match long.
    Memory: the texts, 16 bytes a window, and the bytes of two slices of SLICE windows.
    """

    SLICE = 1 << 16

    def __init__(self, length: int):
        self.length = length
        self.data = np.empty(0, np.uint8)
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.repeated: list[np.ndarray] = []
        self.windows = 0

    def _suffixes(self, places: np.ndarray) -> np.ndarray:
        # All are of one width, so that trailing zero bytes, which this type ignores, make no difference.
        return np.lib.stride_tricks.sliding_window_view(self.data, self.length)[places].view(f"S{self.length}").ravel()

    def _slices(self, places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for at in range(0, len(places), self.SLICE):
            yield at, self._suffixes(places[at : at + self.SLICE])

    def add(self, strings: list[bytes]) -> None:
        """Index a batch: build its suffix array, scan it against those of all levels for long matches, merge equal levels."""
        raw, places = _windows(strings, self.length)
        places = places + len(self.data)
        self.data = np.concatenate([self.data, raw])
        suffixes = self._suffixes(places)
        order = np.argsort(suffixes, kind="stable")
        places, numbers, suffixes = places[order], self.windows + order, suffixes[order]
        self.windows += len(places)
        same = np.flatnonzero(suffixes[1:] == suffixes[:-1])
        self.repeated += [numbers[same], numbers[same + 1]]
        for level in self.levels.values():
            self._merge_scan(suffixes, numbers, level)
        array, height = (places, numbers), 0
        while height in self.levels:
            array, height = self._merged(self.levels.pop(height), array), height + 1
        self.levels[height] = array

    def _merge_scan(self, suffixes: np.ndarray, numbers: np.ndarray, level: tuple[np.ndarray, np.ndarray]) -> None:
        def among(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a

        for at, there in self._slices(level[0]):
            lo, hi = np.searchsorted(suffixes, there[0], "left"), np.searchsorted(suffixes, there[-1], "right")
            if lo < hi:
                mine = suffixes[lo:hi]
                self.repeated += [numbers[lo:hi][among(mine, there)], level[1][at : at + len(there)][among(there, mine)]]

    def _merged(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        before = np.concatenate([sum(np.searchsorted(there, mine) for _, there in self._slices(a[0])) for _, mine in self._slices(b[0])])
        return np.insert(a[0], before, b[0]), np.insert(a[1], before, b[1])


_DIGEST = np.dtype("c16")


def window_digests(strings: list[bytes], length: int) -> np.ndarray:
    """128-bit digests of all windows of some strings, as a dtype that numpy sorts and compares as a pair."""
    raw, at = _windows(strings, length)
    out = np.empty(len(at), _DIGEST)
    # Two 53-bit numbers each are exact as doubles, and complex numbers sort by both in turn.
    out.real = _combined(_ladder(raw, length, 0), length, at, 0) >> np.uint64(11)
    out.imag = _combined(_ladder(raw, length, 1), length, at, 1) >> np.uint64(11)
    return out


def _spans(number: np.ndarray, first: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Repeated windows (numbers over all strings) as maximal intervals of each string: string, start, end."""
    number = np.unique(number)
    string = np.searchsorted(begin, number, "right") - 1
    opens = np.ones(len(number), bool)
    opens[1:] = (number[1:] != number[:-1] + 1) | (string[1:] != string[:-1])
    lo = np.flatnonzero(opens)
    hi = np.append(lo[1:], len(number)) - 1
    owner = string[lo]
    start = first[owner] + number[lo] - begin[owner]
    return owner, start, start + (number[hi] - number[lo]) + length


def repeated_edges(strings: DataFrame, length: int) -> DataFrame:
    """Intervals (row_id, row_mark, start, end) of windows that stand twice among the runs of their key.

    strings: key, row_id, row_mark, place, bytes. Keys are whole in a partition and come sorted, so a
    family is closed, and its memory freed, at the first change of key after a batch's worth of windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, rows, pending, waiting, last = IndexFamily(length), [], [], 0, None

        def index() -> None:
            nonlocal pending, waiting
            if pending:
                family.add(pending)
                pending, waiting = [], 0

        def close() -> pa.RecordBatch | None:
            index()
            table = np.array(rows, np.int64).reshape(-1, 4)
            number = np.concatenate(family.repeated) if family.repeated else np.empty(0, np.int64)
            if not len(number):
                return None
            begin = np.cumsum(table[:, 3]) - table[:, 3]
            owner, start, end = _spans(number, table[:, 2], begin, length)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (table[owner, 0], table[owner, 1], start, end)], ["row_id", "row_mark", "start", "end"])

        for batch in batches:
            keys, ids, marks, places = (batch.column(i).to_pylist() for i in range(4))
            for key, row_id, mark, place, text in zip(keys, ids, marks, places, batch.column(4).to_pylist(), strict=True):
                if key != last and family.windows + waiting >= BATCH_WINDOWS:
                    if (found := close()) is not None:
                        yield found
                    family, rows = IndexFamily(length), []
                last = key
                count = len(text) - length + 1
                rows.append((row_id, mark, place >> 9, count))
                pending.append(text)
                waiting += count
                if waiting >= BATCH_WINDOWS:
                    index()
        if rows and (found := close()) is not None:
            yield found

    dealt = strings.select("key", "row_id", "row_mark", "place", "bytes").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "row_id long, row_mark long, start long, end long")


def hot_edges(places: DataFrame, length: int) -> DataFrame:
    """Intervals of windows that stand twice among the runs asked for, whatever the size of their keys.

    places: row_id, row_mark, doc_id, text, asked. Each window travels as its digest; equal ones are counted in
    each task first, and adaptive execution splits a digest that stands in very many runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row_id, mark, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(3)), batch.column(4).to_pylist(), strict=True):
                first = np.array([x["place"] >> 9 for x in wanted])
                count = np.array([x["place"] >> 1 & 255 for x in wanted])
                for at in range(0, len(first), HOT_RUNS):
                    f, c = first[at : at + HOT_RUNS], count[at : at + HOT_RUNS]
                    digests = window_digests([text[i : i + n + length - 1] for i, n in zip(f.tolist(), c.tolist(), strict=True)], length)
                    start = np.repeat(f - (np.cumsum(c) - c), c) + np.arange(len(digests))
                    n = len(digests)
                    columns = [digests.real.astype(np.int64), digests.imag.astype(np.int64), np.full(n, row_id), np.full(n, mark), start]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["high", "low", "row_id", "row_mark", "start"])

    windows = Written(places.mapInArrow(run, "high long, low long, row_id long, row_mark long, start long"), "hot-windows").df
    twice = windows.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("high", "low")
    return windows.join(twice, ["high", "low"], "left_semi").select("row_id", "row_mark", "start", (F.col("start") + F.lit(length)).alias("end"))


def _identified(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("row_id"),
        F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()).alias("row_mark"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def _merged(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that some spans (start and end in one number) cover."""
    spans = np.sort(spans)
    start, end = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    opens = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    return start[opens], end[np.append(opens[1:], len(end)) - 1]


def remove_repeats(documents: DataFrame, length: int = 200, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that also starts anywhere else.

    Takes doc_id and text; other columns don't matter. Null texts count as empty; texts shorter than the
    length stay whole. A row is known by its doc_id and its text's hash; rows that repeat another are
    copies of it, so all their windows repeat and the shared intervals are right for each. Result:
    doc_id, n_bytes, n_removed, n_spans, kept (binary). Memory: one text and one batch; the
    family of one key holds some 20 bytes for each window of the key's differing runs, of which there are at most
    hot_runs. Windows of keys with more are spread by digest.
    """
    if not GRAM < length < 256:
        raise ValueError(f"the length must be over {GRAM} and under 256")
    rows = _identified(documents)
    suffixes = Written(sampled_suffixes(rows, length), "suffixes")
    total = suffixes.df.count()
    times = suffixes.df.groupBy("key").agg(F.sum(F.lit(1) + F.col("place").bitwiseAND(F.lit(1).cast("long"))).alias("times"))
    times = Written(times.where("times > 1"), "times")
    # A run counts twice in times at most, so they add up to no more than twice the runs.
    shared = Written(spread_semi_join(suffixes.df, times.df, ["key"], "times", 2 * total), "shared")
    times.drop()
    suffixes.drop()
    texts = shared.df.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_id", "row_mark", "place")).alias("one"))
    texts = Written(texts, "run-texts").df
    kinds = texts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    mixed = Written(kinds.where("kinds > 1 or least = 1").select("key", (F.col("kinds") > hot_runs).alias("hot")), "mixed").df
    any_hot = not mixed.where("hot").isEmpty()
    whole = spread_semi_join(shared.df, texts.where("n > 1"), ["key", "digest"], "n", total)
    first, count = F.shiftright("place", 9), F.shiftright("place", 1).bitwiseAND(F.lit(255).cast("long"))
    certain = whole.select("row_id", "row_mark", first.alias("start"), (first + count + F.lit(length - 1)).alias("end"))

    def places(hot: bool) -> DataFrame:
        asked = texts.join(mixed.where(F.col("hot") == hot), "key").select("key", "one.*")
        lists = asked.groupBy("row_id", "row_mark").agg(F.collect_list(F.struct("key", "place")).alias("asked"))
        return rows.join(lists, ["row_id", "row_mark"]).select("row_id", "row_mark", "doc_id", "text", "asked")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "row_id", "row_mark", "place", "bytes"]
        for batch in batches:
            data, lists_ = _texts(batch.column(3)), batch.column(4).to_pylist()
            for row_id, mark, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), data, lists_, strict=True):
                key, place = [x["key"] for x in wanted], [x["place"] for x in wanted]
                cut = [text[p >> 9 : (p >> 9) + (p >> 1 & 255) + length - 1] for p in place]
                n = len(key)
                columns = [pa.array(key), pa.array([row_id] * n), pa.array([mark] * n), pa.array(place), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    strings = places(False).mapInArrow(fetch, "key long, row_id long, row_mark long, place long, bytes binary")
    found = certain.unionByName(repeated_edges(strings, length))
    if any_hot:
        found = found.unionByName(hot_edges(places(True), length))
    # A span is one number, so that a set of them is hashed and not searched.
    spans = found.groupBy("row_id", "row_mark").agg(F.collect_set(F.shiftleft("start", 32).bitwiseOR(F.col("end"))).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, spans_ in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), batch.column(2), strict=True):
                kept, removed, n, at = [], 0, 0, 0
                if spans_.is_valid:
                    starts, ends = _merged(spans_.values.to_numpy())
                    removed, n = int((ends - starts).sum()), len(starts)
                    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
                        kept.append(text[at:start])
                        at = end
                kept.append(text[at:])
                out.append((doc_id, len(text), removed, n, b"".join(kept)))
            if out:
                kinds_ = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds_, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = rows.join(spans, ["row_id", "row_mark"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")

