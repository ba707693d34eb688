"""Quality rules as a short-circuit cascade.

A rule looks at one or two counts of a document. On a bounded sample (SAMPLE_ROWS documents) each rule's cost and
the share that it rejects are measured; rules then run in the order of rejection per cost, and each sees only the
documents that all before it kept. A document is kept if no rule rejects it, so the order, and with it the sample,
decides the speed and never the result.

Defined results: a null or empty text has no words and is rejected as short; a null doc_id stays null; repeated rows
are judged each on its own; an empty table gives an empty table; other columns pass through ``cascade`` unchanged
whatever their names, and ``facts`` reads only doc_id and text. Texts are judged whole.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.llm import shared
from gatelake.llm import text as tx

#: Documents on which costs and rejections are estimated, and the longest taken; they set the order of rules only.
SAMPLE_ROWS = 500
SAMPLE_CHARS = 20_000
#: Partitions, spread over the table, that the sample is read from.
SAMPLE_PARTS = 8
SYMBOLS = b"#*$%&|<>"

_COUNTS = ("n_words", "word_chars", "n_symbols", "_lines", "n_repeat_words")
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


class Facts:
    """Counts of each document of a slice, each computed when first asked for."""

    def __init__(self, data: bytes, bounds: np.ndarray):
        self.data, self.bounds = data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def only(self, keep: np.ndarray) -> Facts:
        """The facts of the documents under the mask; counts that are known are not made again."""
        spans = [self.data[self.bounds[i] : self.bounds[i + 1]] for i in np.flatnonzero(keep)]
        part = Facts(b"".join(spans), np.cumsum([0, *map(len, spans)]))
        part.__dict__.update({name: self.__dict__[name][..., keep] for name in _COUNTS if name in self.__dict__})
        return part

    def _per_document(self, flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[bounds])

    @cached_property
    def words(self) -> tx.Words:
        return tx.Words(self.data, self.bounds, tx.SPACED_CASED)

    @cached_property
    def n_words(self) -> np.ndarray:
        return self.words.counts

    @cached_property
    def word_chars(self) -> np.ndarray:
        low = self.words.low
        return self._per_document((low != 32) & ((low & 0xC0) != 0x80), self.bounds)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._per_document(_IS_SYMBOL[np.frombuffer(self.data, np.uint8)], self.bounds)

    @cached_property
    def _lines(self) -> np.ndarray:
        found = np.zeros((2, len(self)), np.int64)
        for i in range(len(self)):
            lines = [x for x in self.data[self.bounds[i] : self.bounds[i + 1]].split(b"\n") if x and not x.isspace()]
            found[:, i] = len(lines), len(lines) - len(set(lines))
        return found

    @property
    def n_lines(self) -> np.ndarray:
        return self._lines[0]

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines[1]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        words = self.words
        document = np.repeat(np.arange(len(self), dtype=np.uint64), words.counts)
        at = np.flatnonzero(document[2:] == document[:-2]) if len(words) > 2 else np.zeros(0, np.int64)
        keys = tx.mixed(words.grams(3)[at] + document[at] * tx.FACTORS[7]) if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = np.zeros(len(at) + 1, bool)
        same[1:-1] = ranked[1:] == ranked[:-1]
        repeated = at[order[same[:-1] | same[1:]]]
        steps = np.zeros(len(words) + 1, np.int64)
        np.add.at(steps, repeated, 1)
        np.add.at(steps, repeated + 3, -1)
        return self._per_document(np.cumsum(steps)[:-1] > 0, words.first)


Rule = Callable[[Facts], np.ndarray]

#: Each rule gives True for the documents that it rejects. The first two are the base rules.
RULES: dict[str, Rule] = {
    "short": lambda f: f.n_words < 50,
    "repeated_words": lambda f: 100 * f.n_repeat_words > 50 * f.n_words,
    "symbols": lambda f: 10 * f.n_symbols > f.n_words,
    "repeated_lines": lambda f: 100 * f.n_dup_lines > 60 * f.n_lines,
    "word_length": lambda f: (f.word_chars < 2 * f.n_words) | (f.word_chars > 25 * f.n_words),
}
BASE_RULES = ("short", "repeated_words")


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Facts]]:
    for lo, hi, data, bounds in tx.slices(batch):
        yield lo, hi, Facts(data, bounds)


def verdicts(facts: Facts, order: list[str]) -> np.ndarray:
    """Numbers of the documents that no rule rejects; each rule sees only those left by the rules before it."""
    left = np.arange(len(facts))
    for name in order:
        rejected = RULES[name](facts)
        if rejected.any():
            left, facts = left[~rejected], facts.only(~rejected)
    return left


def estimate(docs: DataFrame) -> list[str]:
    """Rules by rejections per second, the best first, on SAMPLE_ROWS documents of at most SAMPLE_CHARS.

    They are the first ones of SAMPLE_PARTS partitions spread over the table, so a sorted table is not judged by its beginning.
    Other partitions are not read, and the sample has a bound in bytes, so it is measured on the driver."""
    rows = docs.select("text").where(F.length("text") <= SAMPLE_CHARS).rdd
    parts = sorted({round(x) for x in np.linspace(0, rows.getNumPartitions() - 1, SAMPLE_PARTS)} if rows.getNumPartitions() else ())
    each = -(-SAMPLE_ROWS // max(1, len(parts)))
    texts = [row.text.encode("utf-8") for row in docs.sparkSession.sparkContext.runJob(rows, lambda held: list(itertools.islice(held, each)), parts)] if parts else []
    data, bounds = b"".join(texts), np.cumsum([0, *map(len, texts)])
    gain = {}
    for name, rule in RULES.items():
        began = time.perf_counter()
        rejected = int(rule(Facts(data, bounds)).sum())
        gain[name] = rejected / (time.perf_counter() - began + 1e-9)
    return sorted(RULES, key=lambda name: -gain[name])


def cascade(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that every rule keeps, with all their columns."""
    order = estimate(docs)

    def keep(batches):
        for batch in batches:
            mask = np.zeros(batch.num_rows, bool)
            for lo, _, facts in _slices(batch):
                mask[lo + verdicts(facts, order)] = True
            yield batch.filter(pa.array(mask))

    return docs.transform(shared.arrow, keep, docs.schema)


FACTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def facts(docs: DataFrame) -> DataFrame:
    """The counts of every document, whether a base rule rejects it, and the cascade's verdict."""
    order = estimate(docs)

    def count(batches):
        for batch in batches:
            for lo, hi, f in _slices(batch):
                columns = [f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words]
                failed = np.logical_or.reduce([RULES[name](f) for name in BASE_RULES])
                kept = np.zeros(len(f), bool)
                kept[verdicts(f, order)] = True
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *map(pa.array, columns), pa.array(failed), pa.array(kept)], names=[x.split()[0] for x in FACTS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(shared.arrow, count, FACTS)
