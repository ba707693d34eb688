"""Benchmark decontamination with a generalised suffix automaton over the normalised test items.

Texts are lower-cased (A-Z) and cut into words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. A window is WINDOW consecutive words of
an item; a shorter item, but not an empty one, is one window. The automaton of all items is built once a worker and
task words stream through it: the longest match at each word and the suffix links tell which windows end there. Words
that no item has lead nowhere from every state, so whole runs of them are passed over at once.

The items are the stated query set. They are taken in blocks of at most BLOCK_WORDS words, each block's automaton in
turn, so a broadcast and an automaton stay bounded whatever the size of the benchmark; one block is the usual case.
What the blocks find in a text is put together before it is counted, judged or cut, so results don't depend on blocks.

Defined results: null and empty texts have no words, no hits, and stay; null doc_ids and item_ids are kept as null (a
null item_id counts as an item and is left out of the joined ids); repeated items count once by item_id; repeated rows
are scanned each; a very long text is scanned in one piece, in time in proportion to its words; with no benchmark nothing
is hit; other columns of documents pass through ``clean`` unchanged whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.llm import shared
from gatelake.llm import text as tx

WINDOW = 10
BLOCK_WORDS = 2_000_000


class Automaton:
    """Suffix automaton of a list of word rows; windows of an item are marked on the states they end in."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        rows = []
        for item, words in items:
            rows.append((item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
        for _, row in rows:
            last = 0
            for symbol in row:
                last = self._extend(last, symbol)
        #: Of each state: the (length, item) marks of windows that end in it.
        self.marks: dict[int, set[tuple[int, object]]] = {}
        self.shortest = min([window, *(len(row) for _, row in rows if row)])
        for item, row in rows:
            size = min(window, len(row))
            state = matched = 0
            for symbol in row:
                state, matched = self.step(state, matched, symbol)
                if matched >= size > 0:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    self.marks.setdefault(at, set()).add((size, item))
        #: The nearest state with marks on the way along suffix links, itself included.
        self.marked = [-1] * len(self.link)
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.marked[state] = state if state in self.marks else self.marked[self.link[state]] if state else -1

    def _extend(self, last: int, symbol: int) -> int:
        found = self.next[last].get(symbol)
        if found is not None:
            return found if self.length[found] == self.length[last] + 1 else self._split(last, symbol, found)
        new = self._state(self.length[last] + 1, {})
        at = last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            target = self.next[at][symbol]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, symbol, target)
        return new

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(0)
        return len(self.length) - 1

    def _split(self, at: int, symbol: int, target: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[target]))
        self.link[copy], self.link[target] = self.link[target], copy
        while at >= 0 and self.next[at].get(symbol) == target:
            self.next[at][symbol] = copy
            at = self.link[at]
        return copy

    def step(self, state: int, matched: int, symbol: int) -> tuple[int, int]:
        """The longest suffix of the text so far that is in the automaton, after one more word."""
        while state and symbol not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        if symbol in self.next[state]:
            return self.next[state][symbol], matched + 1
        return 0, 0

    def windows(self, state: int, matched: int) -> Iterator[tuple[int, object]]:
        """Marks of the windows that end at a word with this state and matching length."""
        at = self.marked[state]
        while at > 0:
            for size, item in self.marks[at]:
                if size <= matched:
                    yield size, item
            at = self.marked[self.link[at]]

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Merged [start, end) word spans of the windows in a text, and the items they come from."""
        known = np.fromiter(map(self.vocabulary.get, words, _minus_ones), np.int64, len(words))
        inside = np.zeros(len(words) + 2, bool)
        inside[1:-1] = known >= 0
        begins, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        long = ends - begins >= self.shortest
        spans: list[list[int]] = []
        items: set = set()
        for lo, hi in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
            state = matched = 0
            for i, symbol in enumerate(known[lo:hi].tolist(), lo):
                state, matched = self.step(state, matched, symbol)
                if matched >= self.shortest and self.marked[state] > 0:
                    for size, item in self.windows(state, matched):
                        items.add(item)
                        start = i + 1 - size
                        while spans and spans[-1][1] >= start:
                            start = min(start, spans.pop()[0])
                        spans.append([start, i + 1])
        return spans, items


_minus_ones = itertools.repeat(-1)
_built: dict[tuple, Automaton] = {}


def _automaton(key: tuple, items: list, window: int) -> Automaton:
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(items, window)
    return _built[key]


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Words of the items, in blocks of at most BLOCK_WORDS words (or one item), read to the driver a partition at a time.
    No result depends on their order."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").distinct().toLocalIterator():
        words = tx.words_of(row.text, tx.ALNUM)
        if words:
            if block and size + len(words) > BLOCK_WORDS:
                yield block
                block, size = [], 0
            block.append((row.item_id, words))
            size += len(words)
    if block:
        yield block


def _word_places(text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
    data = text.encode("utf-8")
    words = tx.Words(data, np.array([0, len(data)]), tx.ALNUM)
    return words.starts, words.ends, data


def _matcher(docs: DataFrame, number: int, block: list, window: int):
    shared = docs.sparkSession.sparkContext.broadcast(block)
    key = (uuid.uuid4().hex, number, window)

    def run(batches):
        automaton = _automaton(key, shared.value, window)
        for batch in batches:
            n, spans, items = [], [], []
            for text in batch.column("text"):
                words = _words(text)
                found, which = automaton.scan(words)
                n.append(len(words))
                spans.append(found)
                items.append([None if x is None else str(x) for x in which])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "key", "n_words", "spans", "items"],
            )

    return run


def _words(text: pa.StringScalar) -> list[bytes]:
    held = text.as_buffer()
    return held.to_pybytes().translate(tx.ALNUM).split() if held is not None else []


def _without(text: str, spans: list) -> str:
    """A text without word spans, which are in order and apart."""
    starts, ends, data = _word_places(text)
    pieces, last = [], 0
    for a, b in spans:
        pieces.append(data[last : starts[a]])
        last = ends[b - 1]
    return b"".join([*pieces, data[last:]]).decode("utf-8")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """``docs`` without contaminated spans: those of ``window`` words or more (or a whole shorter item) are cut out of
    the text, from the first to the last byte of their words; a document of which more than ``coverage`` of the words
    is hit, by all items together, goes. Cutting is repeated until no window is left, as what then stands side by side
    can be one again."""
    found = blocks(benchmark)
    first, second = next(found, None), next(found, None)
    if first is None:
        return docs
    if second is None:  # all that follows, within a pass over the rows
        return docs.transform(shared.arrow, _cleaner(docs, first, window, coverage), docs.schema)
    return _clean_by_blocks(docs, benchmark, window, coverage)


def _cleaner(docs: DataFrame, block: list, window: int, coverage: float):
    items = docs.sparkSession.sparkContext.broadcast(block)
    key, at = (uuid.uuid4().hex, window), docs.columns.index("text")

    def run(batches):
        automaton = _automaton(key, items.value, window)
        for batch in batches:
            texts, kept, changed = [], [], False
            for value in batch.column(at):
                text = value.as_py()
                words = _words(value)
                spans, _ = automaton.scan(words)
                kept.append(sum(b - a for a, b in spans) <= coverage * len(words))
                while spans and kept[-1]:
                    changed = True
                    text = _without(text, spans)
                    spans, _ = automaton.scan(text.encode("utf-8").translate(tx.ALNUM).split())
                texts.append(text)
            if changed:
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch.filter(pa.array(kept, pa.bool_()))

    return run


_KEY = ["_one", "_two"]
_STATE = "_one long, _two long, text string, dropped boolean"


def _key() -> list:
    """128 bits that stand for a text."""
    return [F.xxhash64("text").alias("_one"), F.xxhash64(F.lit(1), "text").alias("_two")]


def _hits(texts: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, list[str]]:
    """(_one, _two, spans) of the texts that some block hits, written a block at a time; and written tables."""

    def matcher(key: tuple, items):
        def run(batches):
            automaton = _automaton(key, items.value, window)
            for batch in batches:
                spans = [automaton.scan(_words(text))[0] for text in batch.column("text")]
                out = pa.RecordBatch.from_arrays([batch.column("_one"), batch.column("_two"), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=[*_KEY, "spans"])
                yield out.filter(pa.array([bool(x) for x in spans], pa.bool_()))

        return run

    spark, every, paths = texts.sparkSession, None, []
    for block in blocks(benchmark):
        items = spark.sparkContext.broadcast(block)
        part, path = shared.written(texts.transform(shared.arrow, matcher((uuid.uuid4().hex, window), items), "_one long, _two long, spans array<array<long>>"), "hits")
        items.unpersist()
        every = part if every is None else every.unionByName(part)
        paths.append(path)
    found, path = shared.written(every.dropDuplicates().groupBy(*_KEY).agg(F.flatten(F.collect_list("spans")).alias("spans")), "hits")
    return found, [*paths, path]


def _merged(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _clean_by_blocks(docs: DataFrame, benchmark: DataFrame, window: int, coverage: float) -> DataFrame:
    """The same with a benchmark of several blocks: rounds over the distinct texts that were hit, each round with the
    spans of all blocks; then the documents are joined with what became of those texts."""

    def cutter(judge: bool):
        def run(batches):
            for batch in batches:
                texts, dropped = [], []
                for value, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                    spans = _merged(spans)
                    gone = judge and sum(b - a for a, b in spans) > coverage * len(_words(value))
                    texts.append(None if gone else _without(value.as_py(), spans))
                    dropped.append(gone)
                yield pa.RecordBatch.from_arrays([batch.column("_one"), batch.column("_two"), pa.array(texts, pa.string()), pa.array(dropped, pa.bool_())], names=[x.split()[0] for x in _STATE.split(", ")])

        return run

    spark = docs.sparkSession
    texts = docs.where("text is not null").select(*_key(), "text")
    found, paths = _hits(texts, benchmark, window)
    hit = texts.join(found, _KEY).dropDuplicates(_KEY)
    state, at = shared.written(hit.transform(shared.arrow, cutter(True), _STATE), "cut")
    while True:
        # a state keeps the key of the text that it began as
        again, more = _hits(state.where("not dropped").select(*_KEY, "text"), benchmark, window)
        paths += more
        if again.isEmpty():
            break
        rest = state.join(again.select(*_KEY), _KEY, "left_anti")
        cut = state.join(again, _KEY).transform(shared.arrow, cutter(False), _STATE)
        paths.append(at)
        state, at = shared.written(rest.unionByName(cut), "cut")
    shared.remove(spark, *paths)
    held = state.select(F.col("_one").alias("_a"), F.col("_two").alias("_b"), F.col("text").alias("_text"), "dropped")
    inner = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, inner, strict=True)], *[k.alias(n) for k, n in zip(_key(), _KEY, strict=True)])
    both = plain.join(held, (F.col("_one") == F.col("_a")) & (F.col("_two") == F.col("_b")), "left").where("not coalesce(dropped, false)")
    return both.select(*[(F.coalesce("_text", n) if c == "text" else F.col(n)).alias(c) for c, n in zip(docs.columns, inner, strict=True)])


MATCHES = "doc_id long, key long, n_words long, spans array<array<long>>, items array<string>"
REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Counts of each document. With one block of items a document's row is ready at once; with more, the rows that
    the blocks give for it are merged by its id."""
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("key"))
    parts = [texts.transform(shared.arrow, _matcher(docs, i, block, window), MATCHES) for i, block in enumerate(blocks(benchmark))]
    parts = parts or [texts.transform(shared.arrow, _matcher(docs, 0, [], window), MATCHES)]
    if len(parts) == 1:
        return parts[0].transform(shared.arrow, _digest, REPORT)
    every = parts[0].withColumn("block", F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        every = every.unionByName(part.withColumn("block", F.lit(i)))
    merged = every.groupBy("doc_id", "key", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.count_if(F.col("block") == 0).cast("int").alias("copies"))
    return merged.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("doc_id", "key", "n_words", "spans", "items").transform(shared.arrow, _digest, REPORT)


def _digest(batches):
    for batch in batches:
        hit, count, digest = [], [], []
        for spans, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
            end = total = 0
            for a, b in sorted(spans):
                total += max(0, b - max(a, end))
                end = max(end, b)
            hit.append(total)
            count.append(len(set(items)))
            digest.append(hashlib.sha256(",".join(sorted({x for x in items if x is not None})).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array([x > 0 for x in hit], pa.bool_())],
            names=[x.split()[0] for x in REPORT.split(", ")],
        )
