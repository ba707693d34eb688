"""Words of whole texts and their 64-bit hashes, for a slice of an Arrow batch at a time.

Texts are taken as UTF-8 bytes in one buffer, so that splitting and hashing are a few numpy passes and
not a loop over words. A slice holds whole documents only; memory is bounded by SLICE_BYTES or one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
_U = np.uint64
#: An odd base and its inverse modulo 2**64, for hashes of byte strings by prefix sums.
_BASE = _U(0x9E3779B97F4A7C55)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
#: Odd factors for the words of a k-gram.
FACTORS = np.array([(0xD6E8FEB86659FD93 * (2 * i + 1)) ** 3 & (1 << 64) - 1 | 1 for i in range(16)], dtype=np.uint64)

_powers = {"base": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}


def _table(keep) -> bytes:
    """A map of bytes: lower case, and a space for what is not kept."""
    return bytes((b + 32 if 65 <= b <= 90 else b) if keep(b) else 32 for b in range(256))


#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = _table(lambda b: b >= 0x80 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)
#: Words [^\x20\x09-\x0D]+ after lower-casing A-Z.
SPACED = _table(lambda b: b != 32 and not 9 <= b <= 13)
#: The same words as they stand.
SPACED_CASED = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits spread over the whole word (the murmur3 finaliser)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        factors = np.full(max(n, min(2 * n, SLICE_BYTES + 1)), _BASE if kind == "base" else _BASE_INV, np.uint64)
        factors[0] = 1
        _powers[kind] = np.cumprod(factors, dtype=np.uint64)
    return _powers[kind]


class Words:
    """Words of the documents of a slice: byte places in ``data``, hashes, and each document's first word."""

    def __init__(self, data: bytes, bounds: np.ndarray, table: bytes):
        self.data, self.bounds = data, bounds
        low = np.frombuffer(data.translate(table), np.uint8)
        self.low = low
        inside = np.zeros(len(low) + 1, bool)
        inside[:-1] = low != 32
        opens, closes = inside[:-1].copy(), inside[:-1].copy()
        opens[1:] &= ~inside[:-2]
        closes[:-1] &= ~inside[1:-1]
        edges = bounds[(bounds > 0) & (bounds < len(low))]
        opens[edges] = inside[edges]
        closes[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        #: Word numbers at which documents begin, with the end.
        self.first = np.searchsorted(self.starts, bounds)
        self._hashes: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            n = len(self.low)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.low.astype(np.uint64) + _U(1)) * power("base", n + 1)[:n], out=sums[1:])
            self._hashes = mixed((sums[self.ends] - sums[self.starts]) * power("inverse", n + 1)[self.starts])
        return self._hashes

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; those that would leave the document mean nothing."""
        h = self.hashes
        n = max(len(h) - k + 1, 0)
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total += h[i : i + n] * FACTORS[i]
        return mixed(total)


def column(batch: pa.RecordBatch, name: str) -> tuple[bytes, np.ndarray]:
    """Bytes and offsets of a text column, null as empty."""
    col = pc.fill_null(batch.column(name), "").cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    return (b"" if col.buffers()[2] is None else col.buffers()[2]), offsets


def slices(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first row, end row, bytes, byte places of the documents in them), each of SLICE_BYTES or one document."""
    data, offsets = column(batch, name)
    view, n, lo = memoryview(data), len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1)
        yield lo, hi, bytes(view[int(offsets[lo]) : int(offsets[hi])]), offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words_of(text: str | None, table: bytes) -> list[bytes]:
    """The words of one text, for small tables and tests."""
    return (text or "").encode("utf-8", "surrogatepass").translate(table).split()
