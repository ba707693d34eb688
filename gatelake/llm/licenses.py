"""License scans by diagonal voting.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. The hashes of all rolling K-word grams of all texts
are joined with the places of the same grams in the templates (a fixed table of a few hundred rows, which is
broadcast). A match at word p of a document and word q of a template votes for the diagonal p - q. Votes are counted by
diagonal, neighbouring diagonals of a template (up to SLACK words inserted or left out) are merged into spans, and
spans are verified on the words themselves.

Base phrases must stand word by word, so one diagonal has to hold all their grams. Passages of known licenses
may differ: on the diagonals of a span, words of the template are aligned with words of the text in their order. Each
aligned word counts 1, each word put in between takes off INSERTED; the best alignment's sum over the template's words
is its score, and from COVER on it is a label. So a span is as wide as such an alignment can drift. Only
texts that can't have such a span, by their grams and words in any order, are not sent on to the verification. A document
scores its best label.

Defined results: null and empty texts have no words, null first and last words, empty labels and score 0; a null doc_id
stays null; repeated rows give a row each; a very long text is scanned in one piece, and its spans are found in time in
proportion to its votes; an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.llm import shared
from gatelake.llm import text as tx

K = 2
SLACK = 2
COVER = 0.7
#: What a word put into a passage takes off its count of aligned words.
INSERTED = 0.5

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Passages of public license texts, and their labels.
PASSAGES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-notice",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this work is licensed under a creative commons attribution": "creative-commons",
    "mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
}
TEMPLATES = [(words.split(), label, True) for words, label in BASE.items()] + [(words.split(), label, False) for words, label in PASSAGES.items()]

#: Stands at the end of each document's grams and matches the template of the document itself.
_SENTINEL = 0
SCAN = "doc_id long, text_key long, n_words long, text string, grams array<long>"


def _words_of(words: list[str]) -> tx.Words:
    data = " ".join(words).encode()
    return tx.Words(data, np.array([0, len(data)]), tx.ALNUM)


def _grams_of(words: list[str]) -> list[int]:
    return _words_of(words).grams(K).view(np.int64).tolist()


def _places(spark) -> DataFrame:
    rows = [(gram, number, q) for number, (words, _, _) in enumerate(TEMPLATES) for q, gram in enumerate(_grams_of(words))]
    return spark.createDataFrame([(_SENTINEL, -1, 0), *rows], "gram long, template int, q int")


def grams(docs: DataFrame) -> DataFrame:
    """For each document a row with all its rolling grams, and a row with the sentinel, its count of words and, if a span
    of some template may stand there, its text for the verification."""
    sets = [(set(_grams_of(words)), _words_of(words).hashes.tolist(), exact) for words, _, exact in TEMPLATES]
    wanted = np.array(sorted(set().union(*(grams for grams, _, _ in sets))), np.int64)
    known = np.array(sorted(set().union(*(hashes for _, hashes, exact in sets if not exact))), np.uint64)

    def enough(found: np.ndarray, said: np.ndarray) -> bool:
        """Whether a span of some template can be verified: a base phrase needs all its grams, a passage a vote and COVER
        of its words, wherever they stand."""
        held, words = set(found.tolist()), None
        for grams, hashes, exact in sets:
            if exact:
                if grams <= held:
                    return True
            elif not grams.isdisjoint(held):
                words = set(said.tolist()) if words is None else words
                if sum(h in words for h in hashes) >= COVER * len(hashes):
                    return True
        return False

    def run(batches):
        for batch in batches:
            for lo, hi, data, bounds in tx.slices(batch):
                words = tx.Words(data, bounds, tx.ALNUM)
                every = words.grams(K).view(np.int64)
                hit = np.isin(every, wanted)
                spoken = np.isin(words.hashes, known)
                some = np.zeros(len(every) + 1, np.int64)
                np.cumsum(hit, out=some[1:])
                first, n = words.first, len(every)
                ends = np.maximum(np.minimum(first[1:] - K + 1, n), np.minimum(first[:-1], n))
                hits = some[ends] - some[np.minimum(first[:-1], n)]
                opens = np.minimum(first[:-1], n)
                texts = [None] * (hi - lo)
                for i in np.flatnonzero(hits):
                    own = slice(first[i], first[i + 1])
                    if enough(every[opens[i] : ends[i]][hit[opens[i] : ends[i]]], words.hashes[own][spoken[own]]):
                        texts[i] = data[bounds[i] : bounds[i + 1]].decode("utf-8")
                part = batch.slice(lo, hi - lo)
                rows = len(part)
                lists = [every[a:b] for a, b in zip(np.minimum(first[:-1], n).tolist(), ends.tolist(), strict=True)]
                counts = pa.array(words.counts, pa.int64())
                for text, held in ((pa.nulls(rows, pa.string()), lists), (pa.array(texts, pa.string()), [[_SENTINEL]] * rows)):
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), counts, text, pa.array(held, pa.list_(pa.int64()))], names=[x.split()[0] for x in SCAN.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_key"), "text").transform(shared.arrow, run, SCAN)


def votes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, template, diagonal): number of voting grams; template -1 is the document itself."""
    places = grams(docs).select("doc_id", "text_key", "n_words", "text", F.posexplode("grams").alias("p", "gram"))
    found = places.join(F.broadcast(_places(docs.sparkSession)), "gram")
    own = F.col("template") == -1
    return found.groupBy("doc_id", "text_key", "template", F.when(own, 0).otherwise(F.col("p") - F.col("q")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.max("n_words").alias("n_words"), F.max("text").alias("text")
    )


def _spans(diagonals: list[int], width: int) -> Iterator[tuple[int, int]]:
    """(lowest, highest) of merged neighbours among sorted diagonals, none wider than ``width`` or inside another."""
    last = None
    for i, low in enumerate(diagonals):
        high = low
        for j in range(i + 1, len(diagonals)):
            if diagonals[j] - high > SLACK or diagonals[j] - low > width:
                break
            high = diagonals[j]
        if high != last:
            yield low, high
        last = high


def aligned(words: list[str], wanted: list[str], low: int, high: int) -> float:
    """The best alignment's score of a template on the diagonals of a span, 0 if it can't reach COVER."""
    places = [(q, q + d) for q, w in enumerate(wanted) for d in range(max(low, -q), min(high, len(words) - 1 - q) + 1) if words[q + d] == w]
    if len({q for q, _ in places}) < COVER * len(wanted):
        return 0.0
    best: list[float] = []
    for i, (q, p) in enumerate(places):
        best.append(1 + max((best[j] - INSERTED * max(0, (p - b) - (q - a)) for j, (a, b) in enumerate(places[:i]) if a < q and b < p), default=0))
    return max(best) / len(wanted)


def verify(words: list[str], found: list[tuple[int, int, int]]) -> tuple[list[int], set[str], set[str], float]:
    """Starts of the base phrases, base labels, all labels and the score, from the words along voted diagonals."""
    starts, base, labels, score = [], set(), set(), 0.0
    diagonals: dict[int, set[int]] = {}
    for template, diagonal, _ in found:
        diagonals.setdefault(template, set()).add(diagonal)
    for template, voted in sorted(diagonals.items()):
        wanted, label, exact = TEMPLATES[template]
        if exact:
            there = [d for d in sorted(voted) if d >= 0 and words[d : d + len(wanted)] == wanted]
            starts += there
            base |= {label} if there else set()
            score = 1.0 if there else score
            continue
        # an alignment that reaches COVER has no more words put in than this, and fewer left out
        width = int((1 - COVER) * len(wanted) / INSERTED)
        reached = max((aligned(words, wanted, low, high) for low, high in _spans(sorted(voted), width)), default=0.0)
        if reached >= COVER:
            labels.add(label)
            score = max(score, reached)
    return starts, base, labels | base, score


REPORT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def report(docs: DataFrame) -> DataFrame:
    """A row a document: places and labels of its license phrases and passages."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                found = [(x["template"], x["diagonal"], x["votes"]) for x in r["found"]]
                words = [w.decode("utf-8") for w in tx.words_of(r["text"], tx.ALNUM)] if found else []
                starts, base, labels, score = verify(words, found)
                rows.append((r["doc_id"], r["n_words"], len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in REPORT.split(", ")])

    own = F.col("template") == -1
    counted = votes(docs)
    one = counted.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.max("text").alias("text"),
        F.max(F.when(own, F.col("votes"))).alias("copies"),  # a sentinel a row, so as many as the row repeats
        F.collect_list(F.when(~own, F.struct("template", "diagonal", "votes"))).alias("found"),
    )
    return one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies").transform(shared.arrow, run, REPORT)
