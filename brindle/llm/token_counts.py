"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

Two facts about merging the best pair first (score, then the leftmost) carry the method. A sequence of tokens is the encoding
of its text if each two neighbours, alone, encode as themselves; and the tokens before a token of an encoding are the
encoding of the prefix they cover. So each prefix has one last token: the one whose start is a prefix whose own last token
stands beside it, and its count is that prefix's count plus one. The library is asked about pairs of tokens only, once each.

No token crosses from another character to a space, so texts fall into units (blanks and the word after them). A worker
solves each distinct unit once, all new units of a round together in array operations, and keeps frequent ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from brindle.llm.common import shield
from brindle.llm.tokenizing import tokenizer_path

MODEL, LIMIT = "piece_bpe_32k.model", 4096
SPACE = "▁"
#: Units a worker keeps in each of two generations, and the longest that it keeps, in code points.
KEPT_UNITS, KEPT_LENGTH = 400_000, 64
#: Longer units are solved by themselves, a character at a time.
LONG_UNIT = 256
#: Pairs of tokens whose verdict a worker keeps, as a power of two.
PAIR_BITS = 20
#: Bytes of text in a round of array operations, and more only for one longer text.
ROUND_BYTES = 4_000_000

_COUNTERS: dict[str, PrefixCounter] = {}


def counter(name: str) -> PrefixCounter:
    """The worker's counter for a model file, made once for all its tasks."""
    if name not in _COUNTERS:
        _COUNTERS[name] = PrefixCounter(tokenizer_path(name))
    return _COUNTERS[name]


class PrefixCounter:
    """Counts of all prefixes for a sentencepiece BPE model without normalisation rules."""

    def __init__(self, path: str):
        self.library = lib = SentencePieceProcessor(model_file=path)
        special = (lib.is_unknown, lib.is_control, lib.is_byte, lib.is_unused)
        pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size()) if not any(kind(i) for kind in special)]
        crossing = [p for p in pieces if SPACE in p.lstrip(SPACE) or (p[0] == SPACE and p.strip(SPACE) and p[:2] == SPACE * 2)]
        probe = ["a  b", " \ta\n b ", "½ﬁ"]
        plain = all(lib.decode(lib.encode(x)) == x for x in probe) and lib.encode("a", out_type=str)[0][0] == SPACE
        if crossing or not plain or any("\n" in p for p in pieces) or len(lib.encode("\x00")) != 2:
            raise ValueError(f"{path} isn't a BPE model with byte fallback whose tokens keep to words")
        whole = lib.encode([self._alone(p) for p in pieces])
        self.pieces = [p for p, ids in zip(pieces, whole, strict=True) if p == SPACE or len(ids) - 2 * (p[0] != SPACE) == 1]
        self.place = {p: i for i, p in enumerate(self.pieces)}
        #: Stand-ins for a character without a token, and for the start of a unit: nothing merges with either.
        self.other, self.start = len(self.pieces), len(self.pieces) + 1
        self.longest = max(map(len, self.pieces))
        self._trie()
        self.pair_keys, self.pair_fits = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.young: dict[str, bytes] = {" ": self._long(" ").tobytes()}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _alone(text: str) -> str:
        """What to encode for a text's own tokens; a line feed, two tokens, keeps the library's leading space off it."""
        return text[1:] if text[0] == SPACE else "\n" + text

    def _trie(self) -> None:
        """Nodes of all beginnings of pieces as one table: (node, character class) to node. Node 0 is none, 1 the root."""
        nodes, parents = {"": 1}, {}
        for piece in self.pieces:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in nodes:
                    nodes[piece[:k]] = len(nodes) + 1
                    parents[piece[:k]] = nodes[piece[: k - 1]]
        deep = sorted({x[-1] for x in nodes if len(x) > 1})
        self.classes = np.zeros(0x110000, np.int16)
        self.classes[[ord(c) for c in deep]] = np.arange(1, len(deep) + 1)
        self.firsts = np.zeros(0x110000, np.int32)
        inner = {node: i + 1 for i, node in enumerate(sorted({p for x, p in parents.items() if len(x) > 1}))}
        self.inner = np.zeros(len(nodes) + 2, np.int32)
        self.inner[list(inner)] = list(inner.values())
        self.steps = np.zeros((len(inner) + 1, len(deep) + 1), np.int32)
        self.token = np.full(len(nodes) + 2, -1, np.int32)
        for text, node in nodes.items():
            if len(text) == 1:
                self.firsts[ord(text)] = node
            elif text:
                self.steps[inner[parents[text]], self.classes[ord(text[-1])]] = node
            self.token[node] = self.place.get(text, -1)

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each two tokens, alone, encode as themselves. Verdicts are kept in a table of a fixed size."""
        keys = left.astype(np.int64) * (self.start + 1) + right
        slots = (keys * np.int64(0x9E3779B97F4A7C1) >> 17) & ((1 << PAIR_BITS) - 1)
        fits, known = self.pair_fits[slots], self.pair_keys[slots] == keys
        free = (left >= self.other) | (right >= self.other)
        new = ~known & ~free
        if new.any():
            asked, where = np.unique(keys[new], return_inverse=True)
            pairs = [(self.pieces[k // (self.start + 1)], self.pieces[k % (self.start + 1)]) for k in asked.tolist()]
            found = self.library.encode([self._alone(a + b) for a, b in pairs], out_type=str)
            said = np.array([(ids if a[0] == SPACE else ids[2:]) == [a, b] for (a, b), ids in zip(pairs, found, strict=True)])
            fits[new] = said[where]
            self.pair_keys[slots[new]], self.pair_fits[slots[new]] = keys[new], fits[new]
        return fits | free

    def _together(self, units: list[str]) -> list[bytes]:
        """Counts of each unit's prefixes (of 1 code point, 2, ...) as 32-bit integers, all units in step."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        firsts = np.cumsum(sizes) - sizes
        left = np.repeat(firsts + sizes, sizes) - np.arange(len(codes))  # characters from here to the unit's end
        # Place p + unit stands for the prefix before character p, so that each unit has a place more than characters.
        unit = np.repeat(np.arange(len(units)), sizes)
        places = len(codes) + len(units)
        weights = np.array([1, 2, 3, 4])[(codes > 0x7F).astype(int) + (codes > 0x7FF) + (codes > 0xFFFF)]
        at, node = np.arange(len(codes)), self.firsts[codes]
        starts, ends, tokens = [], [], []
        alone = self.token[node] < 0  # a character without a token is one for each of its bytes
        starts.append(at[alone]), ends.append(at[alone] + 1), tokens.append(np.full(alone.sum(), self.other, np.int32))
        for n in range(1, self.longest + 1):
            has = self.token[node] >= 0
            starts.append(at[has]), ends.append(at[has] + n), tokens.append(self.token[node[has]])
            goes = (left[at] > n) & (self.inner[node] > 0)
            at, node = at[goes], node[goes]
            if not len(at):
                break
            node = self.steps[self.inner[node], self.classes[codes[at + n]]]
            at, node = at[node > 0], node[node > 0]
        start, end, token = np.concatenate(starts), np.concatenate(ends), np.concatenate(tokens)
        which = unit[start]
        offset = end - firsts[which]
        order = np.argsort(offset.astype(np.int16), kind="stable")
        cuts = np.searchsorted(offset[order], np.arange(1, LONG_UNIT + 2))
        last, counts = np.full(places, self.start, np.int32), np.zeros(places, np.int32)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                break
            some = order[a:b]
            left_place = start[some] + which[some]
            fits = self._fits(last[left_place], token[some])
            some, left_place = some[fits], left_place[fits]
            place = end[some] + which[some]
            last[place] = token[some]
            weight = np.where(token[some] == self.other, weights[start[some]], 1)
            counts[place] = counts[left_place] + weight
        keep = np.ones(places, bool)
        keep[firsts + np.arange(len(units))] = False
        raw, ends = counts[keep].tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _long(self, unit: str) -> np.ndarray:
        """The same for one long unit, a character at a time."""
        unit = unit.replace(" ", SPACE)
        last, counts = np.full(len(unit) + 1, self.start, np.int32), np.zeros(len(unit) + 1, np.int32)
        fits: dict[tuple[int, int], bool] = {}
        for end in range(1, len(unit) + 1):
            if unit[end - 1] not in self.place:
                last[end], counts[end] = self.other, counts[end - 1] + len(unit[end - 1].encode())
                continue
            for n in range(1, min(self.longest, end) + 1):
                token = self.place.get(unit[end - n : end])
                if token is None:
                    continue
                pair = (int(last[end - n]), token)
                if pair not in fits:
                    fits[pair] = bool(self._fits(np.array([pair[0]]), np.array([token]))[0])
                if fits[pair]:
                    last[end], counts[end] = token, counts[end - n] + 1
                    break
        return counts[1:]

    def _known(self, units: list[str]) -> list[bytes]:
        """Counts of distinct units, from those kept or else solved now."""
        found: list[bytes | None] = []
        for unit in units:
            counts = self.young.get(unit)
            if counts is None and (counts := self.old.get(unit)) is not None:
                self.young[unit] = counts
            found.append(counts)
        new = [i for i, counts in enumerate(found) if counts is None]
        short = [i for i in new if len(units[i]) <= LONG_UNIT]
        for at in range(0, len(short), 100_000):
            part = short[at : at + 100_000]
            for i, counts in zip(part, self._together([units[i].replace(" ", SPACE) for i in part]), strict=True):
                found[i] = counts
                if len(units[i]) <= KEPT_LENGTH:
                    self.young[units[i]] = found[i]
        for i in new:
            if found[i] is None:
                found[i] = self._long(units[i]).tobytes()
        if len(self.young) > KEPT_UNITS:
            self.old, self.young = self.young, {}
        return found

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the prefixes of UTF-8 texts (of 1 code point, 2, ...) in a row, and where each text's end."""
        # The library puts a space before each text that isn't empty; it has a count that no prefix of the text asks for.
        data = b"".join(b" " + x for x in texts if x)
        sizes = np.fromiter((len(x) + 1 for x in texts if x), np.int64)
        if not len(sizes):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        raw = np.frombuffer(data, np.uint8)
        heads = np.cumsum(sizes) - sizes
        blank, feed = raw == 0x20, raw == 0x0A
        mark = np.zeros(len(raw), bool)  # the last byte of a U+2581, which is a space to the library
        mark[2:] = (raw[2:] == 0x81) & (raw[1:-1] == 0x96) & (raw[:-2] == 0xE2)
        opens = feed.copy()
        opens[1:] |= (blank[1:] & ~blank[:-1] & ~mark[:-1]) | feed[:-1]
        opens[heads] = True
        cuts = np.flatnonzero(opens)
        buffers = [None, pa.py_buffer(np.append(cuts, len(raw)).astype(np.int64)), pa.py_buffer(data)]
        coded = pa.Array.from_buffers(pa.large_utf8(), len(cuts), buffers).dictionary_encode()
        codes = coded.indices.to_numpy()
        solved = self._known(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, solved), np.int64, len(solved)) // 4
        flat = np.frombuffer(b"".join(solved), np.int32)
        starts = np.cumsum(lengths) - lengths
        totals = flat[starts + lengths - 1].astype(np.int64)[codes]
        n = lengths[codes]
        upto = np.cumsum(n)
        of_text = np.searchsorted(heads, cuts, side="right") - 1
        before = np.cumsum(totals) - totals
        first = np.flatnonzero(np.diff(of_text, prepend=-1))
        before -= before[first][of_text]
        out = flat[np.repeat(starts[codes] - (upto - n), n) + np.arange(upto[-1])] + np.repeat(before, n).astype(np.int32)
        text_ends = np.append(upto[first[1:] - 1], upto[-1])
        out = np.delete(out, np.append(0, text_ends[:-1]))
        ends = np.zeros(len(texts), np.int64)
        ends[[i for i, x in enumerate(texts) if x]] = np.diff(text_ends, prepend=0) - 1
        return out, np.cumsum(ends)


def sealed(counts: np.ndarray) -> bytes:
    """Counts of one text's prefixes as bytes: the width of a step, then the steps from prefix to prefix."""
    steps = np.diff(counts, prepend=np.int32(0))
    for width in (1, 2):
        if not len(steps) or (abs(steps) < 1 << (8 * width - 1)).all():
            return bytes([width]) + steps.astype(f"<i{width}").tobytes()
    return b"\x04" + steps.astype("<i4").tobytes()


def opened(stored: bytes) -> np.ndarray:
    """Counts of the prefixes of 0, 1, 2, ... code points."""
    return np.append(0, np.cumsum(np.frombuffer(stored, f"<i{stored[0]}", offset=1), dtype=np.int64))


def count_prefixes(documents: DataFrame, text: str = "text", model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """Add n_tokens (long), fits (long) and prefix_tokens (binary) to documents; columns of those names are replaced.

    n_tokens: the library's count for the whole text, without added tokens. prefix_tokens: the counts of all its prefixes, some byte a code
    point, which tokens_upto and longest_within read. fits: code points of the longest prefix of at most limit tokens. Null texts count as
    empty. Repeated rows, ties and other columns don't matter. No shuffle; a task holds one round of texts, or one longer text.
    """
    shielded, names = shield(documents, (text,), ("n_tokens", "fits", "prefix_tokens"))
    kept = shielded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for rows in batches:
            column = rows.column(kept.index(text)).cast(pa.large_binary())
            sizes = np.cumsum(np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]))
            start = 0
            while start < len(column):
                end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + ROUND_BYTES)))
                texts = [x or b"" for x in column.slice(start, end - start).to_pylist()]
                counts, ends = count.counts(texts)
                each = np.split(counts, ends[:-1])
                tokens = pa.array([int(x[-1]) if len(x) else 0 for x in each], pa.int64())
                fits = pa.array([longest(x, limit) for x in each], pa.int64())
                yield pa.RecordBatch.from_arrays([*rows.slice(start, end - start).columns, tokens, fits, pa.array(map(sealed, each), pa.binary())], [*kept, "n_tokens", "fits", "prefix_tokens"])
                start = end

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in shielded.schema.fields), "n_tokens long, fits long, prefix_tokens binary"])
    found = shielded.mapInArrow(run, schema)
    return found.select(*[F.col(name).alias(c) for c, name in names.items()], "n_tokens", "fits", "prefix_tokens")


def longest(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix within a budget of tokens; counts of 1, 2, ... code points. A longer prefix may need fewer tokens."""
    within = np.flatnonzero(counts <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def tokens_upto(prefix_tokens: Column, points: Column) -> Column:
    """Tokens of the prefix of so many code points; of the whole text beyond its end. Null in, null out."""

    def read(stored: pa.Array, n: pa.Array) -> pa.Array:
        each = zip(stored.to_pylist(), n.to_pylist(), strict=True)
        return pa.array([None if s is None or k is None else int((c := opened(s))[min(max(k, 0), len(c) - 1)]) for s, k in each], pa.int64())

    read.__annotations__ = {"stored": pa.Array, "n": pa.Array, "return": pa.Array}
    return F.arrow_udf(read, "long")(prefix_tokens, points)


def longest_within(prefix_tokens: Column, budget: Column) -> Column:
    """Code points of the longest prefix of at most so many tokens: where to truncate. Null in, null out."""

    def read(stored: pa.Array, n: pa.Array) -> pa.Array:
        each = zip(stored.to_pylist(), n.to_pylist(), strict=True)
        return pa.array([None if s is None or k is None else longest(opened(s)[1:], k) for s, k in each], pa.int64())

    read.__annotations__ = {"stored": pa.Array, "n": pa.Array, "return": pa.Array}
    return F.arrow_udf(read, "long")(prefix_tokens, budget)
