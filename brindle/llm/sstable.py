"""Token-ID shards as sorted string tables.

A shard file holds, in this order: data blocks, the sparse block index, the Bloom filter, the footer.

- Keys: one byte (0 for a null identifier, else 1), the identifier as a big-endian 64-bit integer
  with its sign bit flipped, and two big-endian 32-bit numbers that tell repeated identifiers apart: the
  shard and an ordinal in it. Byte order is therefore identifier order, nulls first, over all shards.
- Data block: zstd of entries followed by their restart offsets. An entry is the length of the
  prefix shared with the key before it, the length of the rest, the number of ids (three varints),
  the key's rest, and the ids as little-endian 16-bit integers, or 32-bit ones where the footer says
  so. Every 16th entry (a restart) has its whole key.
- Block index: per block its last key, offset, compressed and raw size, raw size of its entries.
- Bloom filter: about 10 bits a key, 7 probes derived from one XXH128 of the key.
- Footer (fixed size): offsets and sizes of index and filter, documents, ids, id width, shard, magic.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import attempt
from brindle.llm.tokenizing import encoder, rounds
from brindle.sources.scratch import scratch_path

MAGIC = b"BRNDLSST"
FOOTER = struct.Struct("<QQQQQQB3xI8s")
KEY = struct.Struct(">BQII")
INDEX_ENTRY = struct.Struct(f"<{KEY.size}sQIII")
RESTART_EVERY = 16
PROBES = 7


def encode_key(identifier: int | None, shard: int = 0, ordinal: int = 0) -> bytes:
    """Order-preserving key of a document."""
    flipped = 0 if identifier is None else (identifier + (1 << 63)) & ((1 << 64) - 1)
    return KEY.pack(identifier is not None, flipped, shard, ordinal)


def decode_key(key: bytes) -> tuple[int | None, int, int]:
    """Identifier, shard and ordinal of a key."""
    there, flipped, shard, ordinal = KEY.unpack(key)
    return (flipped - (1 << 63) if there else None), shard, ordinal


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh128_intdigest(key)
    a, b = h & (2**64 - 1), (h >> 64) | 1
    return [(a + i * b) % 2**64 % bits for i in range(PROBES)]


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system that a path of the shared folder belongs to."""
    return pafs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; entries must come in key order. Memory: one block, the index and 16 bytes a key."""

    def __init__(self, sink, shard: int = 0, width: int = 2, block_bytes: int = 65536):
        self.sink, self.shard, self.width, self.block_bytes = sink, shard, width, block_bytes
        self.packer = zstandard.ZstdCompressor(level=1)
        self.offset = self.documents = self.ids = 0
        self.index: list[bytes] = []
        self.keys = bytearray()
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.size, self.restarts, self.last, self.entries = [], 0, [], b"", 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.entries % RESTART_EVERY:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(self.size)
        if self.width == 2 and len(ids) and int(ids.max()) > 65535:
            raise ValueError("an id doesn't fit the shard's 16-bit ids; write it with width=4")
        raw = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        entry = b"".join([_varint(shared), _varint(len(key) - shared), _varint(len(ids)), key[shared:], raw])
        self.block.append(entry)
        self.size += len(entry)
        self.entries += 1
        self.last = key
        self.keys += key
        self.documents += 1
        self.ids += len(ids)
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.block:
            return
        raw = b"".join(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts)
        packed = self.packer.compress(raw)
        self.sink.write(packed)
        self.index.append(INDEX_ENTRY.pack(self.last, self.offset, len(packed), len(raw), self.size))
        self.offset += len(packed)
        self._fresh()

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, 10 * self.documents)
        bloom = np.zeros(bits // 8 + 1, np.uint8)
        for at in range(0, len(self.keys), KEY.size):
            for bit in _probes(bytes(self.keys[at : at + KEY.size]), bits):
                bloom[bit >> 3] |= 1 << (bit & 7)
        self.sink.write(index)
        self.sink.write(bloom.tobytes())
        self.sink.write(FOOTER.pack(self.offset, len(index), self.offset + len(index), bits, self.documents, self.ids, self.width, self.shard, MAGIC))


class ShardReader:
    """Looks up identifiers in a shard, or reads it from end to end, a block at a time."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        end = self.file.size()
        foot = FOOTER.unpack(self.file.read_at(FOOTER.size, end - FOOTER.size))
        index_at, index_size, self.bloom_at, self.bits, self.documents, self.ids, self.width, self.shard, magic = foot
        if magic != MAGIC:
            raise ValueError(f"{uri} isn't a shard")
        raw = self.file.read_at(index_size, index_at)
        self.index = [INDEX_ENTRY.unpack_from(raw, at) for at in range(0, index_size, INDEX_ENTRY.size)]
        self.last_keys = [x[0] for x in self.index]
        self.bloom: bytes | None = None

    def may_hold(self, key: bytes) -> bool:
        """The Bloom filter's answer: false only for keys that aren't there. The filter is read once."""
        if self.bloom is None:
            self.bloom = self.file.read_at(self.bits // 8 + 1, self.bloom_at)
        return all(self.bloom[bit >> 3] >> (bit & 7) & 1 for bit in _probes(key, self.bits))

    def _load(self, block: int) -> tuple[memoryview, int]:
        _, offset, packed, raw, entries = self.index[block]
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, offset), max_output_size=raw)
        return memoryview(data), entries

    def _entry(self, data: memoryview, at: int, last: bytes) -> tuple[bytes, np.ndarray, int]:
        shared, at = _read_varint(data, at)
        rest, at = _read_varint(data, at)
        count, at = _read_varint(data, at)
        key = last[:shared] + bytes(data[at : at + rest])
        at += rest
        end = at + count * self.width
        return key, np.frombuffer(data[at:end], "<u2" if self.width == 2 else "<u4").astype("<u4"), end

    def get(self, identifier: int | None, ordinal: int = 0) -> np.ndarray | None:
        """A document's ids: filter, binary search of the index, then of the block's restarts."""
        key = encode_key(identifier, self.shard, ordinal)
        block = bisect.bisect_left(self.last_keys, key)
        if block == len(self.index) or not self.may_hold(key):
            return None
        data, entries = self._load(block)
        restarts = np.frombuffer(data[entries:], "<u4")
        low, high = 0, len(restarts) - 1
        while low < high:
            mid = (low + high + 1) // 2
            if self._entry(data, int(restarts[mid]), b"")[0] <= key:
                low = mid
            else:
                high = mid - 1
        at, last = int(restarts[low]), b""
        while at < entries:
            last, ids, at = self._entry(data, at, last)
            if last == key:
                return ids
            if last > key:
                return None
        return None

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for block in range(len(self.index)):
            data, entries = self._load(block)
            at, last = 0, b""
            while at < entries:
                last, ids, at = self._entry(data, at, last)
                yield last, ids


MANIFEST = "shard int, path string, n_docs long, n_ids long, first_id long, last_id long"


def write_token_shards(documents: DataFrame, folder: str, vocabulary: str, end_id: int, width: int = 2) -> list:
    """Encode whole texts and write them as shards whose order is that of doc_id.

    Takes doc_id and text; other columns don't matter. A null text counts as empty (only the end
    id); null identifiers come first; repeated identifiers are kept, ordered by a hash of the text.
    Range partitioning orders the shards; the hash and the row's place are further sort keys, so that
    even one identifier that holds a third of all rows spreads over shards. Each task writes a file of its own name and renames
    it when whole, so a lost or repeated attempt leaves no torn shard. Returns the manifest: one row
    per shard (shard, path, n_docs, n_ids, first_id, last_id) in key order.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tried = attempt()
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        own, final = f"{path}/.attempt-{shard:06d}-{tried}", f"{path}/shard-{shard:06d}.sst"
        encode, first, last, ordinal, writer = encoder(vocabulary).encode, None, object(), 0, None
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, texts in rounds(batch.column(1)):
                if writer is None:
                    sink = store.open_output_stream(own)
                    writer, first = ShardWriter(sink, shard, width), names[a]
                ids, ends = encode(texts, end_id)
                start = 0
                for name, end in zip(names[a:b], ends.tolist(), strict=True):
                    ordinal = ordinal + 1 if name == last else 0
                    last = name
                    writer.add(encode_key(name, shard, ordinal), ids[start:end])
                    start = end
        if writer is not None:
            writer.close()
            sink.close()
            store.move(own, final)
            row = [f"{folder}/shard-{shard:06d}.sst", writer.documents, writer.ids, first, last]
            kinds = [pa.string(), *[pa.int64()] * 4]
            arrays = [pa.array([shard], pa.int32()), *(pa.array([x], k) for x, k in zip(row, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in MANIFEST.split(", ")])

    keyed = documents.select("doc_id", "text").withColumns({"_h": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("doc_id"), F.asc("_h"), F.asc("_row")]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return sorted(dealt.mapInArrow(write, MANIFEST).collect(), key=lambda x: x.shard)


def lookup(manifest: list, identifier: int | None) -> list[np.ndarray]:
    """Ids of every document of an identifier: binary search of the shards' ranges, then of the shards that may hold it."""
    rank = lambda x: (x is not None, x or 0)
    found, at = [], bisect.bisect_left(manifest, rank(identifier), key=lambda m: rank(m.last_id))
    while at < len(manifest) and rank(manifest[at].first_id) <= rank(identifier):
        reader, ordinal = ShardReader(manifest[at].path), 0
        while (ids := reader.get(identifier, ordinal)) is not None:
            found.append(ids)
            ordinal += 1
        at += 1
    return found


def read_token_shards(spark: SparkSession, manifest: list) -> DataFrame:
    """Read shards back: doc_id, start (ids before the document), n_tokens, ids_crc32, shard."""
    starts, total = [], 0
    for row in manifest:
        starts.append((row.shard, row.path, total))
        total += row.n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows: list[tuple] = []
                for key, ids in ShardReader(path):
                    rows.append((decode_key(key)[0], start, len(ids), zlib.crc32(ids.tobytes()), shard))
                    start += len(ids)
                    if len(rows) == 20_000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    table = spark.createDataFrame(starts, "shard int, path string, start long")
    table = table.repartition(max(1, min(len(starts), 10_000)), "shard") if starts else table
    return table.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    arrays = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])


def token_shards(documents: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """Write documents as token shards in the shared folder and describe them as read back."""
    spark = documents.sparkSession
    manifest = write_token_shards(documents, scratch_path(spark, "shards"), vocabulary, end_id)
    return read_token_shards(spark, manifest)
