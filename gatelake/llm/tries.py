"""Token counts by dynamic programming that shares a trie.

Pre-tokens are the matches of the vocabulary's pattern. Distinct ones are inserted in a trie of bytes. A node holds the
forward score of its prefix: the best sum of piece scores over all ways to cut the prefix into pieces of the
vocabulary (fewer pieces win a tie), found from the scores of the nodes above it, so a shared prefix is computed
once. A terminal's count of pieces is the pre-token's; a document's is the sum over its pre-tokens.

A piece of rank r scores -log(r + 2), a Zipf prior on the ranks of the vocabulary; single bytes are pieces, so every
text has a count. A trie lives in one Python worker, at most MAX_NODES nodes, then a new one begins. A pre-token of over
LONG bytes is counted by the same recurrence without being kept.

Defined results: a null or empty text has no pre-tokens and 0 tokens; a null doc_id stays null; repeated rows give a row
each; an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import math
from operator import itemgetter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.llm import shared, vocab

MAX_NODES = 1_000_000
LONG = 512


class Trie:
    """Counts of pre-tokens over a vocabulary of byte pieces."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.longest = max(map(len, scores))
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        #: Of each node: forward score and number of pieces on the best way.
        self.forward: list[float] = [0.0]
        self.pieces: list[int] = [0]
        self.counts: dict[str, int] = {}

    def _best(self, data: bytes, end: int, forward, pieces) -> tuple[float, int]:
        """Score and pieces of data[:end] from those of shorter prefixes, given by their length."""
        get, top, least = self.scores.get, -math.inf, 0
        for start in range(end - 1, max(-1, end - self.longest - 1), -1):
            score = get(data[start:end])
            if score is not None:
                score += forward[start]
                if score > top or score == top and pieces[start] + 1 < least:
                    top, least = score, pieces[start] + 1
        return top, least

    def count(self, token: str) -> int:
        """Pieces of a pre-token; inserts it if it is new."""
        found = self.counts.get(token)
        if found is not None:
            return found
        data = token.encode("utf-8")
        forward, pieces, node, kept = [0.0], [0], 0, len(data) <= LONG
        for end in range(1, len(data) + 1):
            child = self.children.get(node << 8 | data[end - 1]) if kept else None
            if child is None:
                score, n = self._best(data, end, forward, pieces)
                if kept:
                    child = len(self.forward)
                    self.children[node << 8 | data[end - 1]] = child
                    self.forward.append(score)
                    self.pieces.append(n)
            else:
                score, n = self.forward[child], self.pieces[child]
            forward.append(score)
            pieces.append(n)
            node = child or 0
        if kept:
            self.counts[token] = pieces[-1]
        return pieces[-1]

    def total(self, tokens: list[str]) -> int:
        counts = self.counts
        for token in set(tokens):
            if token not in counts:
                self.count(token)
        try:
            return sum(map(counts.__getitem__, tokens))
        except KeyError:  # a long pre-token
            return sum(map(self.count, tokens))


_tries: dict[str, Trie] = {}


def trie(path: str) -> Trie:
    if path not in _tries:
        _tries[path] = Trie({piece: -math.log(rank + 2) for piece, rank in vocab.ranks_at(path).items()})
    return _tries[path]


REPORT = "doc_id long, n_pretokens long, n_tokens long"


def counts(docs: DataFrame, path: str) -> DataFrame:
    """Pre-tokens and tokens of every document."""

    def run(batches):
        import public_tokenizers

        split, held = regex.compile(public_tokenizers.PATTERN).findall, trie(path)
        for batch in batches:
            out = []
            for text in batch.column("text"):
                tokens = split(text.as_py() or "")
                out.append((len(tokens), held.total(tokens)))
                if len(held.forward) > MAX_NODES:
                    held.clear()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(map(itemgetter(i), out)), pa.int64()) for i in (0, 1))], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(shared.arrow, run, REPORT)
