"""Whole-text encoding with the tokenizers library, a distinct word at a time.

Both vocabularies split a text into pre-tokens before any merge, and no pre-token spans a lone
space or line feed between two characters that aren't white space. Encoding such pieces by
themselves therefore gives exactly the ids of the whole text. Prose repeats its pieces, so each
batch encodes every distinct piece once, keeps the frequent ones for the next batch, and puts the
texts' ids together with array operations. Texts with any other white space, texts that hold the
string of an added token (such as <|endoftext|>, which the library reads as that token), and tokenizers
of any other set-up, are encoded whole.
"""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Pieces a worker keeps in each of two generations (some 200 bytes each).
KEPT_PIECES = 400_000
#: Longer pieces aren't kept.
KEPT_CHARS = 64
#: Bytes of text that one round of array operations covers, and more only for one longer text.
ROUND_BYTES = 6_000_000

_ENCODERS: dict[str, Encoder] = {}


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine; a path is returned as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str) -> Encoder:
    """The worker's encoder for a vocabulary file, made once for all its tasks."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(tokenizer_path(name))
    return _ENCODERS[name]


def rounds(column: pa.Array, limit: int = ROUND_BYTES):
    """A column of texts in slices of about as many bytes as the limit: first row, end row, texts."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        total += size
        if total >= limit or i + 1 == len(sizes):
            yield start, i + 1, column.slice(start, i + 1 - start).to_pylist()
            start, total = i + 1, 0


class Encoder:
    """Ids of texts, exactly as the tokenizers library gives them for each whole text."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.spaced = self.by_piece = False
        vocabulary = self.tokenizer.get_vocab()
        added = sorted(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids of tokens that begin with a space
        self.opens[[i for x, i in vocabulary.items() if x[0] == "\u0120"]] = True
        rare = next((x for x in "\x01\u00f7\u00a7\u00b6" if len(self._whole(x)) == 1), None)
        self.rare = f" {rare} "
        if rare:
            self._setup()

    def _setup(self) -> None:
        """Find out whether a piece takes the space before it, and whether pieces can be encoded alone."""
        pre, norm = str(self.tokenizer.pre_tokenizer), str(self.tokenizer.normalizer)
        if "ByteLevel" not in pre or "add_prefix_space=True" in pre or "Prepend" in norm or self.tokenizer.post_processor:
            return
        probe = ["a b", "Ab, c'd\nef 1 22 x", "\u00e9 \u00df \u0301x."]
        for spaced in (True, False) if len(self._whole("\n")) == 1 else (False,):
            self.spaced, self.by_piece = spaced, True
            ids, ends = self._by_piece(probe)
            if all(ids[a:b].tolist() == self._whole(x).tolist() for x, a, b in zip(probe, [0, *ends], ends)):
                return
        self.by_piece = False

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _new(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that aren't known yet: many are joined into one text, whose ids tell them apart."""
        found: list[bytes] = []
        for at in range(0, len(pieces), 16384):
            part = pieces[at : at + 16384]
            joined = [self.joint.join(part[i : i + 512]) for i in range(0, len(part), 512)]
            ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
            for own, i in zip(ids, range(0, len(part), 512), strict=True):
                group = part[i : i + 512]
                if self.joint:
                    cuts = np.flatnonzero(own == self.joint_id)
                    starts, ends = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(own)]])
                else:
                    starts = np.flatnonzero(self.opens[own])
                    ends = np.concatenate([starts[1:], [len(own)]])
                if len(starts) == len(group):
                    raw, four = own.tobytes(), np.stack([starts, ends]).T * 4
                    found += [raw[x:y] for x, y in four.tolist()]
                else:  # a piece holds the joint itself
                    found += [self._whole(x).tobytes() for x in group]
        return found

    def _known(self, pieces: list[str]) -> tuple[list[bytes], list[int]]:
        """Ids of distinct pieces, from those kept or else from the library; and which hold white space inside."""
        young, old, found, new, odd = self.young, self.old, [], [], []
        for at, piece in enumerate(pieces):
            ids = young.get(piece)
            if ids is None:
                if (ids := old.get(piece)) is not None:
                    young[piece] = ids
                elif piece.split() != [piece[1:] if piece[:1] == " " and self.spaced else piece] and piece != "\n":
                    odd.append(at)
                    ids = b""
                else:
                    new.append(at)
            found.append(ids)
        lead = [at for at in new if self.spaced and pieces[at][0] == " "]
        rest = [at for at in new if not self.spaced or pieces[at][0] != " "]
        for ats, joint in ((lead, ""), (rest, "\n" if self.spaced else self.rare)):
            self.joint, self.joint_id = joint, int(self._whole(joint)[0]) if joint else -1
            alone = {at: self._whole(pieces[at]).tobytes() for at in ats if pieces[at] == joint.strip(" ")}
            ats = [at for at in ats if at not in alone]
            for at, ids in {**alone, **dict(zip(ats, self._new([pieces[at] for at in ats]), strict=True))}.items():
                found[at] = ids
                if len(pieces[at]) <= KEPT_CHARS:
                    young[pieces[at]] = ids
        if len(young) > KEPT_PIECES:
            self.old, self.young = young, {}
        return found, odd

    def _by_piece(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n "), " ")
        ends = split.offsets.to_numpy()[1:].astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        feed = words.index("\n") if "\n" in words else -1
        if self.spaced:
            bare = np.zeros(len(codes), bool)
            bare[np.concatenate([[0], ends[:-1]])] = True
            bare[1:] |= codes[:-1] == feed
            bare |= codes == feed
            used, where = _distinct(codes.astype(np.int64) * 2 + bare, 2 * len(words))
            pieces = [words[k >> 1] if k & 1 else " " + words[k >> 1] for k in used.tolist()]
        else:
            pieces, where = words, codes
        found, odd = self._known(pieces)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        starts = np.cumsum(sizes) - sizes
        n = sizes[where]
        upto = np.cumsum(n)
        ids = flat[np.repeat(starts[where] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
        text_ends = np.concatenate([[0], upto])[ends]
        if not odd:
            return ids, text_ends
        strange = np.zeros(len(pieces), bool)
        strange[odd] = True
        whole = np.unique(np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))[strange[where]])
        parts = np.split(ids, text_ends[:-1])
        for i in whole.tolist():
            parts[i] = self._whole(texts[i])
        return np.concatenate(parts), np.cumsum([len(x) for x in parts])

    def encode(self, texts: list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row and where each text's end; null texts count as empty.

        end_id, if given, follows the ids of every text.
        """
        texts = [x or "" for x in texts]
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if self.by_piece:
            # An empty text has one empty piece, which would count as white space.
            whole = {i for i, x in enumerate(texts) if self.added and self.added.search(x)}
            full = [i for i, x in enumerate(texts) if x and i not in whole]
            sizes = np.zeros(len(texts), np.int64)
            ids = np.empty(0, np.uint32)
            if full:
                ids, ends = self._by_piece([texts[i] for i in full])
                sizes[full] = np.diff(ends, prepend=0)
            if whole:
                parts = np.split(ids, np.cumsum(sizes)[:-1])
                for i in whole:
                    parts[i] = self._whole(texts[i])
                sizes, ids = np.array([len(x) for x in parts], np.int64), np.concatenate(parts)
        else:
            parts = [self._whole(x) for x in texts]
            sizes, ids = np.array([len(x) for x in parts], np.int64), np.concatenate(parts)
        ends = np.cumsum(sizes)
        if end_id is not None:
            ids = np.insert(ids, ends, np.uint32(end_id))
            ends = ends + np.arange(1, len(ends) + 1)
        return ids, ends


def _distinct(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys under n and each key's place among them, without a sort."""
    seen = np.zeros(n, bool)
    seen[keys] = True
    used = np.flatnonzero(seen)
    place = np.zeros(n, np.int64)
    place[used] = np.arange(len(used))
    return used, place[keys]
