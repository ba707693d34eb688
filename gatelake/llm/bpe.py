"""Byte-level BPE by a monoid tree reduction.

Encoding. A text is halved until a leaf is short, leaves are encoded, and neighbours are joined up the tree. Two rules
prove which tokens a join cannot change:

* Between a non-space and a space, between a letter or digit and something else, and after a symbol other than the
  apostrophe, the pre-token pattern always ends a match, whatever stands around (it has no look-behind, and its
  look-ahead and contractions don't cross such a place). So tokens left of the last such place of the left part and right of the
  first such place of the right part stay; what lies between is encoded anew.
* Inside one pre-token a row of tokens is its BPE encoding if and only if each pair of neighbours is the encoding of
  the pair's own bytes. A seam is mended by encoding windows of 1, 2, 4, ... tokens on each side anew until both
  outer pairs hold. The right half begins BACK tokens before the end of the left one, so that both halves of a
  periodic run are in step and most seams hold as they are.

Decoding concatenates bytes up a tree of token slices.

Defined results: a null text is empty and has no tokens (the digests are those of no bytes); a null doc_id stays null;
repeated rows are encoded each; an empty table gives an empty table; columns but doc_id and text are not read. Memory
is that of one document and its ids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.llm import shared, vocab

LEAF_CHARS = 2048
LEAF_BYTES = 4096
LEAF_TOKENS = 1024
#: Tokens at the end of a left half that the right half begins with.
BACK = 8

#: Places at which every pre-tokenisation has an end of a match.
_SURE = regex.compile(r"(?<=\S)(?= )|(?<=\p{L})(?=[0-9.,;:!?()\n])|(?<=[0-9])(?=[A-Za-z.,;:!?()\n])|(?<=[.,;:!?()])(?=[A-Za-z0-9\n])")


class Encoder:
    """Ids of whole texts over a tiktoken vocabulary."""

    def __init__(self, path: str):
        import public_tokenizers

        self.coder = vocab.encoder(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.leaf = self.coder.encode_ordinary
        self.piece = self.coder._core_bpe.encode_single_piece
        self.bytes_of = self.coder.decode_single_token_bytes

    def encode(self, text: str) -> list[int]:
        return self._text(text, 0, len(text))

    def _text(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= LEAF_CHARS:
            return self.leaf(text[lo:hi])
        mid = (lo + hi) // 2
        a, b = self._around(text, lo, mid, hi)
        if b - a > LEAF_CHARS:  # a long run without a sure place is encoded once, and not at every level above it
            return (self._text(text, lo, a) if a > lo else []) + self._window(text[a:b]) + (self._text(text, b, hi) if b < hi else [])
        left, right = self._text(text, lo, mid), self._text(text, mid, hi)
        keep = len(left) - len(self.leaf(text[a:mid])) if a > lo else 0
        drop = len(self.leaf(text[mid:b])) if b < hi else len(right)
        return left[:keep] + self.leaf(text[a:b]) + right[drop:]

    def _around(self, text: str, lo: int, mid: int, hi: int) -> tuple[int, int]:
        """The last sure place before the middle and the first one after it, or the ends, by windows that grow."""
        a = b = None
        reach = 32
        while a is None or b is None:
            if a is None:
                start = max(lo, mid - reach)
                a = max((m.start() for m in _SURE.finditer(text, start, mid) if m.start() > start), default=lo if start == lo else None)
            if b is None:
                end = min(hi, mid + reach)
                b = next((m.start() for m in _SURE.finditer(text, mid, end) if m.start() > mid), hi if end == hi else None)
            reach *= 2
        return a, b

    def _window(self, text: str) -> list[int]:
        if len(text) <= LEAF_CHARS:
            return self.leaf(text)
        return [i for part in self.pattern.findall(text) for i in self._run(part.encode("utf-8"))]

    def _run(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        if len(data) <= LEAF_BYTES:
            return self.piece(data)
        mid = len(data) // 2
        left = self._run(data[:mid])
        back = min(BACK, len(left) - 1)
        kept = left[: len(left) - back]
        return self._mend(kept, self._run(data[mid - sum(len(self.bytes_of(t)) for t in left[len(kept) :]) :]))

    def _fits(self, a: int, b: int) -> bool:
        return self.piece(self.bytes_of(a) + self.bytes_of(b)) == [a, b]

    def _mend(self, left: list[int], right: list[int]) -> list[int]:
        if self._fits(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            i, j = max(len(left) - k, 0), min(k, len(right))
            window = self.piece(b"".join(map(self.bytes_of, left[i:] + right[:j])))
            if (i == 0 or self._fits(left[i - 1], window[0])) and (j == len(right) or self._fits(window[-1], right[j])):
                return left[:i] + window + right[j:]
            k *= 2

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return self.coder.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian unsigned 32-bit integers) of every whole text."""

    def run(batches):
        coder = Encoder(path)
        for batch in batches:
            for ids, texts in _parts(batch):
                yield pa.RecordBatch.from_arrays([ids, pa.array([np.array(coder.encode(t or ""), "<u4").tobytes() for t in texts.to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(shared.arrow, run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and the bytes ``decoded`` from ``ids``."""

    def run(batches):
        coder = Encoder(path)
        for batch in batches:
            for ids, data in _parts(batch):
                yield pa.RecordBatch.from_arrays([ids, pa.array([coder.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in data.to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").transform(shared.arrow, run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every text in one pass; counts and digests of both, and the ids themselves if wanted."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def run(batches):
        coder = Encoder(path)
        for batch in batches:
            for ids, texts in _parts(batch):
                coded = [coder.encode(t or "") for t in texts.to_pylist()]
                packed = [np.array(x, "<u4").tobytes() for x in coded]
                columns = [
                    ids,
                    pa.array([len(x) for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
                    pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in coded], pa.string()),
                ]
                columns += [pa.array(packed, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(shared.arrow, run, schema)


def _parts(batch: pa.RecordBatch, rows: int = 64):
    for lo in range(0, batch.num_rows, rows):
        part = batch.slice(lo, rows)
        yield part.column(0), part.column(1)
