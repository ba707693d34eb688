"""Token ids in sorted-string-table shards.

A shard file holds documents in ascending key order. A key is 9 bytes: 0 for a null doc_id, else 1 and the id with its
sign bit flipped, big-endian, so byte order is id order. Layout::

    block*   entries of about BLOCK_BYTES, compressed with zstandard
    index    per block: first key, offset, bytes, entries, ids before it in the shard
    bloom    BLOOM_BITS bits a key
    footer   offsets and lengths of index and bloom, counts, width of an id, crc32 of index and bloom, magic

    entry    varint shared, varint rest, varint ids, key bytes after the shared ones, ids (little-endian)

The keys of a block are prefix-compressed against the key before. ``get`` looks a key up: the Bloom filter says if it
may be there, a binary search over the sparse index finds its block, and one block is read. Shards are ranges of the
documents by (doc_id, digest of the text), so repeated ids are dealt out too. A shard appears under its name only when
it is whole, and only shards of the tasks that Spark counted are listed, so a lost executor leaves no half a file behind.

Encoding keeps the ids of distinct units: a text is cut where a pre-token begins in any case, units not seen before
are encoded by the tokenizers library in batches, and a text's ids are gathered from those of its units.

Defined results: a null or empty text has the end id alone; a null doc_id sorts first; rows that repeat are stored each;
an empty table gives no shards and no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelake.llm import shared, vocab
from gatelake.llm import text as tx

BLOCK_BYTES = 64 << 10
BLOOM_BITS = 10
BLOOM_HASHES = 7
END_ID = 2
MAGIC = b"GLSST001"
_FOOTER = struct.Struct("<QQQQQQII8s")
_INDEX = struct.Struct("<9sQIIQ")
CACHE_UNITS = 600_000
RUN_UNITS = 256


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * b) % (1 << 64) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard to a binary stream; keys come in ascending order."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.at = out, width, 0
        self.compress = zstandard.ZstdCompressor(level=1).compress
        self.index, self.keys, self.n_ids = [], [], 0
        self._open()

    def _open(self) -> None:
        self.block, self.size, self.entries, self.last, self.first, self.before = [], 0, 0, b"", b"", self.n_ids

    def add(self, key: bytes, ids: bytes) -> None:
        if not self.entries:
            self.first = key
        same = 0
        while same < len(self.last) and self.last[same] == key[same]:
            same += 1
        entry = _varint(same) + _varint(len(key) - same) + _varint(len(ids) // self.width) + key[same:] + ids
        self.block.append(entry)
        self.size += len(entry)
        self.entries += 1
        self.n_ids += len(ids) // self.width
        self.last = key
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            self._close()

    def _close(self) -> None:
        data = self.compress(b"".join(self.block))
        self.out.write(data)
        self.index.append(_INDEX.pack(self.first, self.at, len(data), self.entries, self.before))
        self.at += len(data)
        self._open()

    def finish(self) -> None:
        if self.entries:
            self._close()
        bits = max(64, len(self.keys) * BLOOM_BITS + 7 & ~7)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        self.out.write(index)
        self.out.write(bytes(bloom))
        self.out.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.n_ids, self.width, zlib.crc32(bytes(bloom), zlib.crc32(index)), MAGIC))


class Reader:
    """Reads a shard from a seekable binary file."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.expand = file, zstandard.ZstdDecompressor().decompress
        at, n, bloom_at, bloom_n, self.n_keys, self.n_ids, self.width, crc, magic = _FOOTER.unpack(self._bytes(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        index, self.bloom = self._bytes(at, n), self._bytes(bloom_at, bloom_n)
        if zlib.crc32(self.bloom, zlib.crc32(index)) != crc:
            raise ValueError("a shard's index or Bloom filter is damaged")
        self.index = list(_INDEX.iter_unpack(index))
        self.firsts = [x[0] for x in self.index]

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, number: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, n, entries, _ = self.index[number]
        data = self.expand(self._bytes(at, n))
        place, key = 0, b""
        for _ in range(entries):
            same, place = _read_varint(data, place)
            rest, place = _read_varint(data, place)
            ids, place = _read_varint(data, place)
            key = key[:same] + data[place : place + rest]
            place += rest
            yield key, data[place : place + ids * self.width]
            place += ids * self.width

    def items(self) -> Iterator[tuple[bytes, bytes]]:
        for number in range(len(self.index)):
            yield from self._block(number)

    def get(self, key: bytes) -> list[np.ndarray]:
        """Ids of each document under a key."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, len(self.bloom) * 8)):
            return []
        number, found = max(bisect_right(self.firsts, key) - 1, 0), []
        while number > 0 and self.firsts[number] == key:  # a repeated id may begin in an earlier block
            number -= 1
        while number < len(self.index) and self.firsts[number] <= key:
            found += [np.frombuffer(ids, f"<u{self.width}") for k, ids in self._block(number) if k == key]
            number += 1
        return found


_random = np.random.Generator(np.random.PCG64(1618))
_BYTES = _random.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RAW = np.arange(256)
_ASCII_WORD = ((_RAW >= 48) & (_RAW <= 57)) | ((_RAW >= 65) & (_RAW <= 90)) | ((_RAW >= 97) & (_RAW <= 122))
_ASCII_SOLID = (_RAW > 32) & (_RAW < 127)
_MARK = np.isin(_RAW, list(b".,;:!?)"))


def unit_starts(data: bytes, bounds: np.ndarray) -> np.ndarray:
    """Byte places at which a pre-token begins, whatever stands around, with the document bounds.

    These are: a space or line break after a non-space; a mark after an ASCII letter or digit; an ASCII letter or digit
    after a line break that follows a non-space alone. Doubtful places are left out, which only makes units longer."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return bounds[:-1]
    begins = np.zeros(len(raw), bool)
    solid, word = _ASCII_SOLID[raw], _ASCII_WORD[raw]
    # a byte of a longer character counts as a non-space unless it can be the last of a Unicode space
    wide = (raw >= 0x80) & ~np.isin(raw, [0x80, 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF, *range(0x81, 0x8B)])
    latin = np.zeros(len(raw), bool)
    latin[1:] = (raw[1:] >= 0x80) & (raw[:-1] >= 0xC3) & (raw[:-1] < 0xE0)  # two-byte characters past U+00BF are no spaces
    full = solid | wide | latin
    gap = (raw == 32) | (raw == 10)
    begins[1:] = (gap[1:] & full[:-1]) | (_MARK[raw[1:]] & word[:-1])
    begins[2:] |= word[2:] & (raw[1:-1] == 10) & full[:-2]
    begins[bounds[:-1][bounds[:-1] < len(raw)]] = True
    return np.flatnonzero(begins)


class Encoder:
    """Ids of whole texts by the tokenizers library. Texts are cut into units at places that begin a pre-token in any
    case; each distinct unit is encoded once by the library and kept under two 64-bit hashes of its bytes."""

    def __init__(self, path: str, width: int):
        self.tokenizer, self.dtype = vocab.tokenizer(path), np.dtype(f"<u{width}")
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # the byte-level sign for a space
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.second = np.zeros(0, np.uint64)
        self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.dtype)

    def _hashes(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        raw, n, out = np.frombuffer(data, np.uint8), len(data), []
        for table in _BYTES:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(table[raw] * tx.power("base", n + 1)[:n], out=sums[1:])
            out.append(tx.mixed((sums[ends] - sums[starts]) * tx.power("inverse", n + 1)[starts]))
        return out

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each unit, and all ids. A space and letters is one pre-token wherever it stands, so such
        units are encoded many at a time; the ids whose token begins with a space tell where each begins."""
        plain = np.array([u[0] == " " and u[1:].isalpha() for u in units], bool)
        words = [u for u, p in zip(units, plain.tolist(), strict=True) if p]
        rest = self._library([u for u, p in zip(units, plain.tolist(), strict=True) if not p])
        runs = [words[i : i + RUN_UNITS] for i in range(0, len(words), RUN_UNITS)]
        counts, ids = [], []
        for run, x in zip(runs, self.tokenizer.encode_batch_fast(["".join(run) for run in runs], add_special_tokens=False), strict=True):
            found = np.array(x.ids, self.dtype)
            begins = np.flatnonzero(self.spaced[found])
            if len(begins) == len(run):
                counts.append(np.diff(begins, append=len(found)))
                ids.append(found)
            else:  # the library's letters are not Python's
                each = self._library(run)
                counts.append(np.array([len(y) for y in each], np.int64))
                ids.append(np.fromiter(itertools.chain.from_iterable(each), self.dtype))
        lengths = np.zeros(len(units), np.int64)
        if words:
            lengths[plain] = np.concatenate(counts)
        lengths[~plain] = np.fromiter(map(len, rest), np.int64, len(rest))
        flat = np.zeros(int(lengths.sum()), self.dtype)
        whose = np.repeat(plain, lengths)
        if words:
            flat[whose] = np.concatenate(ids)
        flat[~whose] = np.fromiter(itertools.chain.from_iterable(rest), self.dtype)
        return lengths, flat

    def encode(self, data: bytes, bounds: np.ndarray) -> list[bytes]:
        """Ids of each document of a slice."""
        if len(self.known) > CACHE_UNITS:
            self._clear()
        starts = unit_starts(data, bounds)
        ends = np.append(starts[1:], len(data))
        full = ends > starts
        starts, ends = starts[full], ends[full]
        first, second = self._hashes(data, starts, ends)
        distinct, at, inverse = np.unique(first, return_index=True, return_inverse=True)
        rows = np.array([self.known.get(h, -1) for h in distinct.tolist()], np.int64)
        new = np.flatnonzero(rows < 0)
        if len(new):
            places = at[new]
            lengths, flat = self._units([data[a:b].decode("utf-8") for a, b in zip(starts[places].tolist(), ends[places].tolist(), strict=True)])
            rows[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(distinct[new].tolist(), rows[new].tolist(), strict=True))
            self.second = np.concatenate([self.second, second[places]])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, flat])
        row = rows[inverse]
        if not np.array_equal(self.second[row], second):  # two units with one hash
            return [np.array(x, self.dtype).tobytes() for x in self._library([data[a:b].decode("utf-8") for a, b in itertools.pairwise(bounds.tolist())])]
        lengths = self.lengths[row]
        held = np.zeros(len(self.lengths) + 1, np.int64)
        np.cumsum(self.lengths, out=held[1:])
        total = np.zeros(len(row) + 1, np.int64)
        np.cumsum(lengths, out=total[1:])
        out = self.flat[np.repeat(held[row] - total[:-1], lengths) + np.arange(total[-1])]
        cuts = total[np.searchsorted(starts, bounds)]
        return [out[a:b].tobytes() for a, b in itertools.pairwise(cuts.tolist())]


_encoders: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, width: int) -> Encoder:
    if (path, width) not in _encoders:
        _encoders[path, width] = Encoder(path, width)
    return _encoders[path, width]


MANIFEST = "shard int, path string, n_docs long, n_ids long"


def write(docs: DataFrame, tokenizer_path: str, folder: str, width: int = 2) -> DataFrame:
    """Writes the shards into ``folder`` and returns their manifest (shard, path, n_docs, n_ids), a row a shard.
    ``width`` is the bytes of an id: 2 holds vocabularies of up to 65,536."""

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(_uri(folder))
        store.create_dir(base, recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"{base}/{shard:06d}-{uuid.uuid4().hex}.sst"
        coder, end = _encoder(tokenizer_path, width), np.array([END_ID], f"<u{width}").tobytes()
        n_docs, writer, out = 0, None, None
        for batch in batches:
            for lo, hi, data, bounds in tx.slices(batch):
                if writer is None:
                    out = store.open_output_stream(name + ".part")
                    writer = Writer(out, width)
                for doc_id, ids in zip(batch.column("doc_id").slice(lo, hi - lo).to_pylist(), coder.encode(data, bounds), strict=True):
                    writer.add(key_of(doc_id), ids + end)
                    n_docs += 1
        if writer is not None:
            writer.finish()
            out.close()
            store.move(name + ".part", name)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{name.rsplit('/', 1)[1]}"], "n_docs": [n_docs], "n_ids": [writer.n_ids]})

    n = shared.ranges(docs)
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    ranged = keyed.repartitionByRange(n, "doc_id", "text_key").sortWithinPartitions("doc_id", "text_key")
    return ranged.select("doc_id", "text").transform(shared.arrow, run, MANIFEST)


def _uri(path: str) -> str:
    """Hadoop's name of a store as Arrow knows it."""
    return re.sub(r"^s3[an]://", "s3://", path)


def open_shard(path: str) -> Reader:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(_uri(path))
    file = store.open_input_file(at)
    return Reader(file, file.size())


REPORT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(manifest: DataFrame) -> DataFrame:
    """Each document of the listed shards, in their order: doc_id, start (ids of all documents before it), n_tokens and
    the crc32 of its ids as unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                reader, rows = open_shard(path), []
                for key, ids in reader.items():
                    found = np.frombuffer(ids, f"<u{reader.width}")
                    rows.append((id_of(key), start, len(found), zlib.crc32(found.astype("<u4").tobytes())))
                    start += len(found)
                    if len(rows) >= 8192:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    ordered = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard, not a document
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(ordered), F.lit(0)))
    return placed.select("path", "before").repartition(max(1, manifest.count())).transform(shared.arrow, run, REPORT)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes shards and their manifest to the shared folder and reads the documents back from the files."""
    folder = shared.new_path(docs.sparkSession, "sst")
    manifest, _ = shared.written(write(docs, tokenizer_path, folder), "manifest")
    return read(manifest)
