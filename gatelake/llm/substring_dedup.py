"""Substring dedup by hashing lines, and passages within and across them.

A line is normalised to its words (A-Z lower-cased, runs of [0-9a-z] and non-ASCII) and has a 64-bit digest, if it has a
word. Digests are grouped over the whole corpus and the earliest ranked occurrence stays: documents rank by doc_id (null
last, these by a digest of their text), lines by their place. All later occurrences are repeats. A repeated line of
``line_words`` words or more is removed, by default every one that has a word.

A passage whose ends are joined to other text need not hold whole lines. So lines are also cut into sentences (at one of
.!? before white space), and texts into chunks, where the hash of two words is the least of the NEAR words on both sides: a
place that the text around it decides, so a passage has the same chunks wherever it stands, but for its first and last.
Sentences and chunks of UNIT_WORDS words or more have digests and an earliest document as lines have; a run of ``run_words``
words or more that all stand in repeated lines, sentences or chunks is removed, from its first to its last word. Of a passage
of no whole line or sentence up to a chunk at each end stays.

With ``line_words`` at ``run_words``, stock lines that are shorter stay unless they stand beside other repeats.

What stays keeps its place in the original: ``removed`` lists the cut code-point spans of the original text.

Digests are grouped in two steps: a partial aggregate before the shuffle, so a unit that a third of all documents has
is one row a task; then a join back, which Spark splits if a digest is hot.

Defined results: null and empty texts have no units and stay; rows that share a doc_id count as one document, so what
they share with one another stays; rows with a null doc_id rank after all others, each text of them as a document of its
own (so only equal texts keep what they share); a very long text is cut in one piece and holds a worker's memory for its
words alone; an empty table gives an empty table; other columns pass through ``dedup`` unchanged whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelake.llm import shared
from gatelake.llm import text as tx

UNIT_WORDS = 3
#: Words of a run of repeats that is a passage and no stock phrase.
RUN_WORDS = 20
#: A chunk begins at the least hash among so many words before and after.
NEAR = 3
#: Rank of rows without a doc_id.
LAST = (1 << 63) - 1

_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class Units:
    """Words of the documents of a slice, cut three ways: into lines, sentences and chunks.

    ``kinds`` has for each way the word numbers of the cuts, each document's first unit, digests, and which of them count;
    ``lines`` and ``sentences`` are the byte places of those cuts."""

    def __init__(self, data: bytes, bounds: np.ndarray):
        raw = np.frombuffer(data, np.uint8)
        self.places = words = tx.Words(data, bounds, tx.ALNUM)
        breaks = raw == 10
        ends = breaks.copy()
        ends[:-1] |= _STOP[raw[:-1]] & _SPACE[raw[1:]]
        self.lines = lines = np.union1d(np.flatnonzero(breaks) + 1, bounds)
        self.sentences = sentences = np.union1d(np.flatnonzero(ends) + 1, bounds)
        n = len(words)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words.hashes * tx.power("base", n + 1)[:n], out=sums[1:])
        inverse = tx.power("inverse", n + 1)

        def kind(at: np.ndarray, first: np.ndarray, least: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            sizes = np.diff(at)
            digests = tx.mixed((sums[at[1:]] - sums[at[:-1]]) * inverse[at[:-1]] + sizes.astype(np.uint64) * tx.FACTORS[salt])
            return at, first, digests, sizes >= least

        chunks = np.union1d(self._begins(), words.first)
        self.kinds = [
            kind(np.searchsorted(words.starts, lines), np.searchsorted(lines, bounds), 1, 11),  # a line is compared with lines only
            kind(np.searchsorted(words.starts, sentences), np.searchsorted(sentences, bounds), UNIT_WORDS, 12),
            kind(chunks, np.searchsorted(chunks, words.first), UNIT_WORDS, 12),
        ]

    def of(self, document: int) -> np.ndarray:
        """Distinct digests of a document."""
        held = [digests[first[document] : first[document + 1]][counts[first[document] : first[document + 1]]] for _, first, digests, counts in self.kinds]
        return np.unique(np.concatenate(held))

    def bytes_of(self, start: int, end: int) -> tuple[int, int]:
        """Byte span of words, with the whole sentence at an end that is one of a sentence."""
        at = self.kinds[1][0]
        i, j = int(np.searchsorted(at, start, "right")) - 1, int(np.searchsorted(at, end, "left"))
        first = int(self.sentences[i]) if at[i] == start else int(self.places.starts[start])
        return first, int(self.sentences[j]) if at[j] == end else int(self.places.ends[end - 1])

    def _begins(self) -> np.ndarray:
        """Words at which a chunk begins."""
        h, n = self.places.hashes, len(self.places)
        doc = np.repeat(np.arange(len(self.places.first) - 1), self.places.counts)
        pairs = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        if n > 1:
            pairs[:-1] = np.where(doc[1:] == doc[:-1], tx.mixed(h[:-1] * tx.FACTORS[0] + h[1:] * tx.FACTORS[1]), pairs[:-1])
        least = np.ones(n, bool)
        for d in range(1, min(NEAR, n - 1) + 1):
            other = doc[d:] != doc[:-d]
            least[d:] &= other | (pairs[d:] < pairs[:-d])
            least[:-d] &= other | (pairs[:-d] <= pairs[d:])
        return np.flatnonzero(least)


def _keyed() -> tuple[Column, Column]:
    """Rank of a document, and a key that tells rows of one rank apart."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.coalesce(F.xxhash64("text"), F.lit(0))


def repeats(docs: DataFrame) -> DataFrame:
    """(rank, text_key, digests): the digests of a document that an earlier document has."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, bounds in tx.slices(batch):
                units = Units(data, bounds)
                lists = [units.of(i).view(np.int64) for i in range(hi - lo)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("rank"), part.column("text_key"), pa.array(lists, pa.list_(pa.int64()))], names=["rank", "text_key", "digests"])

    rank, key = _keyed()
    lists = docs.select(rank.alias("rank"), key.alias("text_key"), "text").transform(shared.arrow, run, "rank long, text_key long, digests array<long>")
    units = lists.select("rank", "text_key", F.explode("digests").alias("digest"))
    unnamed = F.when(F.col("rank") == LAST, F.col("text_key"))
    ends = units.groupBy("digest").agg(F.min("rank").alias("earliest"), F.max("rank").alias("latest"), F.min(unnamed).alias("first_key"), F.max(unnamed).alias("last_key"))
    earliest = ends.where(f"earliest != latest or (earliest = {LAST} and first_key != last_key)").select("digest", "earliest", F.when(F.col("earliest") == LAST, F.col("first_key")).alias("first_key"))
    earliest, _ = shared.written(earliest, "earliest")  # not an aggregate any more, so Spark can split a hot digest's join
    later = units.join(earliest, "digest").where("rank != earliest or text_key != first_key")
    return later.groupBy("rank", "text_key").agg(F.collect_set("digest").alias("digests"))


def _again(digests: np.ndarray, counts: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of a document's units are repeats: of an earlier document, or of a place before in this one."""
    again = np.isin(digests, known)
    _, first = np.unique(digests, return_index=True)
    later = np.ones(len(digests), bool)
    later[first] = False
    return np.flatnonzero((again | later) & counts)


def spans_to_cut(units: Units, document: int, known: np.ndarray, line_words: int, run_words: int) -> list[tuple[int, int]]:
    """Byte spans of a document to remove: repeated lines, and runs of words in repeated lines, sentences or chunks."""
    lo, hi = int(units.places.first[document]), int(units.places.first[document + 1])
    mark = np.zeros(hi - lo + 2, np.int8)  # a word without a mark on both sides
    spans = []
    for number, (at, first, digests, counts) in enumerate(units.kinds):
        a, b = int(first[document]), int(first[document + 1])
        for i in (_again(digests[a:b], counts[a:b], known) + a).tolist():
            mark[at[i] - lo + 1 : at[i + 1] - lo + 1] = 1
            if number == 0 and at[i + 1] - at[i] >= line_words:
                spans.append((int(units.lines[i]), int(units.lines[i + 1])))
    turns = (np.flatnonzero(np.diff(mark)) + lo).tolist()
    spans += [units.bytes_of(s, e) for s, e in zip(turns[::2], turns[1::2], strict=True) if e - s >= run_words]
    return _joined(spans)


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _cut(names: list[str], out: list[str], line_words: int, run_words: int):
    def run(batches):
        for batch in batches:
            texts, removed = [], []
            found, column = batch.column("_digests"), batch.column("_text")
            for lo, hi, data, bounds in tx.slices(batch, "_text"):
                units = None
                for i in range(lo, hi):
                    if not column[i].is_valid:
                        texts.append(None)
                        removed.append([])
                        continue
                    units = units or Units(data, bounds)
                    known = found[i].values.to_numpy(zero_copy_only=False).view(np.uint64) if found[i].is_valid else np.zeros(0, np.uint64)
                    raw, base = data[bounds[i - lo] : bounds[i - lo + 1]], int(bounds[i - lo])
                    places = [(s - base, e - base) for s, e in spans_to_cut(units, i - lo, known, line_words, run_words)]
                    at, last, pieces, spans = 0, 0, [], []
                    for s, e in places:
                        pieces.append(raw[last:s])
                        start = at + len(pieces[-1].decode("utf-8"))
                        at = start + len(raw[s:e].decode("utf-8"))
                        spans.append([start, at])
                        last = e
                    texts.append(b"".join([*pieces, raw[last:]]).decode("utf-8"))
                    removed.append(spans)
            columns = [batch.column(c) for c in names] + [pa.array(texts, pa.string()), pa.array(removed, pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=out)

    return run


def dedup(docs: DataFrame, line_words: int = 1, run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with repeats cut out of ``text``, and a last column of the removed code-point spans (array of
    [start, end)), named ``removed`` or, where ``docs`` has that name, with underscores before it.

    Every later occurrence of a line of ``line_words`` words or more goes, and every run of ``run_words`` words or more in
    repeated lines, sentences or chunks."""
    found = repeats(docs)
    rank, key = _keyed()
    inner = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, inner, strict=True)], rank.alias("rank"), key.alias("text_key"))
    joined = plain.join(found, ["rank", "text_key"], "left")
    at = docs.columns.index("text")
    others = [n for i, n in enumerate(inner) if i != at]
    joined = joined.select(*others, F.col(inner[at]).alias("_text"), F.col("digests").alias("_digests"))
    types = {n: docs.schema[i] for i, n in enumerate(inner)}
    schema = T.StructType([T.StructField(n, types[n].dataType, True) for n in others] + [T.StructField("_text", T.StringType()), T.StructField("_removed", T.ArrayType(T.ArrayType(T.LongType())))])
    done = joined.transform(shared.arrow, _cut(others, [f.name for f in schema], max(1, line_words), run_words), schema)
    last = "removed"
    while last in docs.columns:
        last = "_" + last
    return done.select(*[F.col("_text" if i == at else inner[i]).alias(c) for i, c in enumerate(docs.columns)], F.col("_removed").alias(last))
