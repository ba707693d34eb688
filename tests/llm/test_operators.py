"""Every operator against a brute-force version, and on nulls, empty and long texts, repeats, empty tables and clashing columns."""

from __future__ import annotations

import functools
import hashlib
import html
import html.parser as html_parser
import json
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from gatelake.llm import bpe, chat, decontaminate, graph, licenses, near_dup, quality, shared, sstable, substring_dedup, tries, vocab, wrappers
from gatelake.llm import text as tx

DOCS = "doc_id long, text string, kept string, removed long, n_words string"
LONG = "lorem ipsum dolor " * 20_000
WORD_PARTS = ["the", "and", "er", "thon", "ing", "é", "日本", "x1", "blah"]


def documents(spark, rows):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "a", 7, "b") for i, t in rows], DOCS)


def prose(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(WORD_PARTS) for _ in range(draw.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, white space, a very long text, repeats and near copies."""
    base = prose(120, 1)
    near = re.sub("[a-z]", lambda m: m[0].upper(), base.replace(" ", "  ", 1))
    rows = [(1, base), (2, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, LONG), (8, "one two"), (9, "One  two"), (None, base), (10, prose(80, 2)), (11, "a b c <|endoftext|> ''s"), (12, "x" * 5000)]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def words(text, pattern):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(pattern, lower)


ALNUM, SPACED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"


# Words


def test_words_match_the_patterns():
    draw = random.Random(3)
    pieces = ["a", "B", "9", "é", "日", " ", "\n", "\t", "\x0b", ".", "_", "~", "\x7f", "\x85", " "]
    for table, pattern in ((tx.ALNUM, ALNUM), (tx.SPACED, SPACED)):
        texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 12))) for _ in range(200)]
        data = [t.encode() for t in texts]
        bounds = np.cumsum([0, *map(len, data)])
        found = tx.Words(b"".join(data), bounds, table)
        got = [found.data[a:b].translate(table).decode() for a, b in zip(found.starts, found.ends, strict=True)]
        assert got == [w for t in texts for w in words(t, pattern)]
        assert found.counts.tolist() == [len(words(t, pattern)) for t in texts]
        by_word = {}
        for w, h in zip(got, found.hashes.tolist(), strict=True):
            assert by_word.setdefault(w, h) == h
        assert len(set(by_word.values())) == len(by_word)


# 1 and 3: byte-pair encoding and token counts


def test_tree_encoding_equals_the_library(monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_CHARS", 8)
    monkeypatch.setattr(bpe, "LEAF_BYTES", 4)
    monkeypatch.setattr(bpe, "LEAF_TOKENS", 3)
    coder, library = bpe.Encoder(vocab.tiktoken_path()), vocab.encoder(vocab.tiktoken_path())
    draw = random.Random(5)
    pieces = ["a", "b", "the", " ", "  ", "\n", "'s", "'", "''", "'re", "é", "日本", "1", "23", ".", "\t", "!!", "ab'll", "$%", " "]
    for _ in range(600):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 80)))
        ids = coder.encode(text)
        assert ids == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


@pytest.mark.parametrize("back", [0, 1, 8])
def test_long_runs_equal_the_library(back, monkeypatch):
    """Pre-tokens of any length, periodic or not, between ordinary text, with leaves that cut them often."""
    monkeypatch.setattr(bpe, "LEAF_CHARS", 64)
    monkeypatch.setattr(bpe, "LEAF_BYTES", 32)
    monkeypatch.setattr(bpe, "BACK", back)
    coder, library = bpe.Encoder(vocab.tiktoken_path()), vocab.encoder(vocab.tiktoken_path())
    draw = random.Random(6)
    for _ in range(150):
        period = "".join(draw.choice("abcé日.!- ") for _ in range(draw.randint(1, 5)))
        text = prose(draw.randint(0, 30), draw.random()) + draw.choice([" ", "", "\n"]) + period * draw.randint(1, 200) + draw.choice([" ", "", "'s "]) + prose(draw.randint(0, 30), draw.random())
        assert coder.encode(text) == library.encode_ordinary(text)


def test_a_very_long_run_is_encoded_in_time_of_its_length():
    coder, library = bpe.Encoder(vocab.tiktoken_path()), vocab.encoder(vocab.tiktoken_path())
    for text in ("a" * 200_000, "abc" * 60_000 + " end"):
        began = time.perf_counter()
        assert coder.encode(text) == library.encode_ordinary(text)
        assert time.perf_counter() - began < 10


def test_bpe_round_trip(odd, empty):
    library = vocab.encoder(vocab.tiktoken_path())
    got = rows_of(bpe.round_trip(odd, vocab.tiktoken_path()))
    want = []
    for r in odd.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))
    back = bpe.decode(bpe.encode(odd, vocab.tiktoken_path()), vocab.tiktoken_path())
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((r.text or "").encode() for r in odd.collect())
    assert bpe.round_trip(empty, vocab.tiktoken_path()).collect() == []


def test_trie_counts_are_the_best_cuts(odd, empty):
    scores = {p: -math.log(r + 2) for p, r in vocab.ranks_at(vocab.tiktoken_path()).items()}
    longest = max(map(len, scores))

    def best(data):
        found = [(0.0, 0)]
        for end in range(1, len(data) + 1):
            found.append(max((found[s][0] + scores[data[s:end]], found[s][1] - 1) for s in range(max(0, end - longest), end) if data[s:end] in scores))
        return -found[-1][1]

    for r in tries.counts(odd.where("doc_id is null or doc_id != 7"), vocab.tiktoken_path()).collect():
        text = next(x.text for x in odd.collect() if x.doc_id == r.doc_id) or ""
        tokens = regex.findall(public_tokenizers.PATTERN, text)
        assert (r.n_pretokens, r.n_tokens) == (len(tokens), sum(best(t.encode()) for t in tokens))
    assert tries.counts(empty, vocab.tiktoken_path()).collect() == []


def test_trie_shares_prefixes_and_starts_anew():
    trie = tries.Trie({bytes([i]): -5.0 for i in range(256)} | {b"ab": -1.0, b"abc": -1.5})
    assert [trie.count(w) for w in ("ab", "abc", "abcab", "abd")] == [1, 1, 2, 2]
    assert len(trie.forward) == 1 + 5 + 1  # abcab, and the d of abd
    assert trie.count("ab" * 400) == 400 and "ab" * 400 not in trie.counts
    trie.clear()
    assert trie.count("abc") == 1


# 4: shards


def test_unit_encoder_equals_the_library():
    library = vocab.tokenizer(vocab.tokenizers_path())
    coder = sstable.Encoder(vocab.tokenizers_path(), 2)
    draw = random.Random(7)
    pieces = ["a", "the", " ", "  ", "\n", "\n\n", "'s", "'", "é", "à", "日本", "1", ".", ",", "\t", " x", "　", "\u0085", "<|endoftext|>", "…"]
    for _ in range(150):
        texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 50))) for _ in range(draw.randint(1, 5))]
        data = [t.encode() for t in texts]
        got = coder.encode(b"".join(data), np.cumsum([0, *map(len, data)]))
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_shards(spark, odd, empty):
    library = vocab.tokenizer(vocab.tokenizers_path())
    ids = {}
    for r in odd.collect():
        ids.setdefault(r.doc_id, []).append(library.encode(r.text or "", add_special_tokens=False).ids + [sstable.END_ID])
    got = sstable.report(odd, vocab.tokenizers_path()).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        assert (r.n_tokens, r.ids_crc32) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids[r.doc_id]]
    manifest = sstable.write(odd, vocab.tokenizers_path(), shared.new_path(spark, "test-sst")).collect()
    found = {i: [x.tolist() for m in manifest for x in sstable.open_shard(m.path).get(sstable.key_of(i))] for i in [None, 1, 2, 7, 99, -5]}
    assert found[99] == found[-5] == []
    for i in (None, 1, 2, 7):
        assert sorted(found[i]) == sorted(ids[i])
    assert sstable.report(empty, vocab.tokenizers_path()).collect() == []


def test_shard_keys_sort_as_ids():
    ids = [None, -(1 << 63), -5, 0, 3, 1 << 40, (1 << 63) - 1]
    keys = [sstable.key_of(i) for i in ids]
    assert keys == sorted(keys) and [sstable.id_of(k) for k in keys] == ids


# 2: substring dedup


def test_repeated_passages_are_cut_but_for_the_first(spark, empty):
    passage = "This passage has quite a lot of words in it. And it goes on for a second sentence of some length, as passages do. It has a third one too."
    own = ["Only the first text says this here.", "Only the second text says that there.", "Only the third text says nothing much."]
    docs = documents(spark, [(3, f"{own[2]} {passage}"), (1, f"{passage}\n{own[0]}"), (2, f"{own[1]} {passage.upper()} Short stock phrase here."), (4, "Short stock phrase here."), (5, None), (6, ""), (7, f"{own[2]}"), (8, f"Short stock phrase here.\n{own[0]} More.")])
    got = {r.doc_id: r for r in substring_dedup.dedup(docs).collect()}
    assert got[1].text == f"{passage}\n{own[0]}" and got[1]["_removed"] == []
    assert got[2].text.split() == f"{own[1]} Short stock phrase here.".split()
    assert passage not in got[3].text and own[2] in got[3].text
    assert got[4].text == "Short stock phrase here." and got[5].text is None and got[6].text == "" and got[7].text == own[2]
    assert got[8].text == f"{own[0]} More."  # a repeated line goes, however short
    spared = {r.doc_id: r.text for r in substring_dedup.dedup(docs, line_words=20).collect()}
    assert spared[8] == f"Short stock phrase here.\n{own[0]} More." and passage not in spared[3]
    original = {r.doc_id: r.text for r in docs.collect()}
    for i, r in got.items():
        spans = [tuple(x) for x in r["_removed"]]
        if spans:
            text, last, kept = original[i], 0, ""
            for a, b in spans:
                kept, last = kept + text[last:a], b
            assert kept + text[last:] == r.text
    assert substring_dedup.dedup(docs).columns == [*docs.columns, "_removed"]
    assert substring_dedup.dedup(empty).collect() == []


def brute_dedup(rows, line_words, run_words):
    """Kept texts of (doc_id, text) rows: words compared as words; only the places of chunks come from the operator."""
    split = []
    for i, text in rows:
        data = (text or "").encode()
        cut = substring_dedup.Units(data, np.array([0, len(data)]))
        spoken = [m for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", data)]
        said = [m[0].lower() for m in spoken]
        assert len(said) == len(cut.places)
        ends = {m.end() for m in re.finditer(rb"\n", data)}
        stops = ends | {m.end() for m in re.finditer(rb"[.!?](?=[ \t\n\x0b\x0c\r])", data)}
        ways = []
        for places, least in ((ends, 1), (stops, 3)):
            edges = sorted({0, len(data)} | places)
            ways.append([(sum(m.start() < a for m in spoken), sum(m.start() < b for m in spoken), least, (a, b)) for a, b in zip(edges, edges[1:])])
        edges = cut.kinds[2][0].tolist()
        ways.append([(a, b, 3, None) for a, b in zip(edges, edges[1:])])
        split.append((i if i is not None else math.inf, text or "" if i is None else "", text, data, spoken, said, ways))
    owner = {}
    for n, (rank, key, _, _, _, said, ways) in enumerate(split):
        for w, way in enumerate(ways):
            for a, b, least, _ in way:
                if b - a >= least:
                    unit = (w == 0, *said[a:b])
                    owner[unit] = min(owner.get(unit, (rank, key)), (rank, key), key=lambda k: (k[0], shared_key(k[1]) if k[0] == math.inf else 0))
    out = []
    for rank, key, text, data, spoken, said, ways in split:
        marked, gone = set(), set()
        for w, way in enumerate(ways):
            seen = set()
            for a, b, least, span in way:
                unit = (w == 0, *said[a:b])
                if b - a >= least and (owner[unit] != (rank, key) or unit in seen):
                    marked |= set(range(a, b))
                    if w == 0 and b - a >= line_words:
                        gone |= set(range(*span))
                seen.add(unit)
        at = 0
        while at < len(said):
            end = at
            while end in marked:
                end += 1
            if end - at >= run_words:
                left = next((s for a, b, _, (s, _) in reversed(ways[1]) if a == at), spoken[at].start())
                right = next((e for a, b, _, (_, e) in ways[1] if b == end), spoken[end - 1].end())
                gone |= set(range(left, right))
            at = max(end, at + 1)
        out.append((rank, None if text is None else bytes(c for i, c in enumerate(data) if i not in gone).decode()))
    return out


def shared_key(text):
    """The digest that ranks texts without a doc_id."""
    return KEYS[text]


KEYS = {}


@pytest.mark.parametrize("line_words", [1, 6])
def test_dedup_against_brute_force(spark, line_words):
    draw = random.Random(41)
    sentences = [" ".join(draw.choice(["Éa", "bo", "cé", "du", "Ei", "fo", "go", "hu"]) for _ in range(draw.randint(1, 7))) + draw.choice(".!?,") for _ in range(25)]
    rows = [(i % 30 if i % 9 else None, "".join(draw.choice(sentences) + draw.choice([" ", " ", "\n", ""]) for _ in range(draw.randint(0, 12)))) for i in range(60)]
    rows += [(40, None), (None, None), (41, ""), (None, " \n "), (42, "bo du. " * 400), (43, rows[0][1])]
    rows = [*{(i, t): None for i, t in rows if sum(x == i for x, _ in rows) == 1 or i is None}]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    KEYS.update({r.text or "": r.key for r in docs.where("doc_id is null").selectExpr("text", "coalesce(xxhash64(text), 0) as key").collect()})
    got = [(math.inf if r.doc_id is None else r.doc_id, r.text) for r in substring_dedup.dedup(docs, line_words, 9).collect()]
    order = lambda r: (r[0], r[1] is None, r[1] or "")
    assert sorted(got, key=order) == sorted(brute_dedup(rows, line_words, 9), key=order)


def test_rows_of_one_id_keep_what_they_share(spark):
    text = prose(60, 9) + "."
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    got = rows_of(substring_dedup.dedup(docs).select("doc_id", F.length("text")))
    assert got == [(1, len(text)), (1, len(text)), (2, 0), (None, 0)]


def test_texts_without_ids_are_documents_of_their_own(spark):
    line, other = "a line that all of them have", "another line"
    docs = spark.createDataFrame([(None, f"{line}\n{other} {i}") for i in range(5)] + [(None, f"{line}\n{other} 0")], "doc_id long, text string")
    got = sorted(r.text for r in substring_dedup.dedup(docs).collect())
    assert sum(line in t for t in got) in (1, 2) and sorted(t.split("\n")[-1] for t in got) == sorted(f"{other} {i}" for i in [0, 0, 1, 2, 3, 4])


def test_repeats_within_a_document(spark):
    unit = "A sentence of at least twenty words that stands twice in one document is cut the second time it is said there, surely."
    docs = spark.createDataFrame([(1, f"{unit} {unit} End of it now.")], "doc_id long, text string")
    assert substring_dedup.dedup(docs).first().text == f"{unit} End of it now."


def test_passages_with_joined_ends_are_cut(spark):
    """A repeated passage goes but for a few words at its ends also where it holds no whole sentence or line."""
    draw = random.Random(29)
    fresh = lambda n: " ".join(f"w{draw.randrange(10**9)}" for _ in range(n))
    passages = [fresh(60) for _ in range(40)] + [f"{fresh(25)}. {fresh(10)}. {fresh(25)}" for _ in range(20)]
    before = {i: fresh(30) for i in range(120)}
    after = {i: fresh(30) for i in range(120)}
    docs = spark.createDataFrame([(i, f"{before[i]} {passages[i % 60]} {after[i]}") for i in range(120)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in substring_dedup.dedup(docs).collect()}
    left = []
    for i in range(120):
        assert got[i].startswith(before[i]) and got[i].endswith(after[i])
        if i < 60:
            assert passages[i] in got[i]
        else:
            left.append(len(words(got[i], ALNUM)) - 60)
    assert max(left) < 50 and sum(left) < 60 * 15


# 5: decontamination


def windows_hit(doc, items, size):
    hit, which = set(), set()
    for item, held in items:
        k = min(size, len(held))
        found = {tuple(held[i : i + k]) for i in range(len(held) - k + 1)} if k else set()
        for i in range(len(doc) - k + 1 if k else 0):
            if tuple(doc[i : i + k]) in found:
                which.add(item)
                hit |= set(range(i, i + k))
    return hit, which


def test_automaton_against_all_windows():
    draw = random.Random(11)
    for _ in range(400):
        letters = [c.encode() for c in "abcd"[: draw.randint(1, 4)]]
        items = [(i, [draw.choice(letters) for _ in range(draw.randint(0, 8))]) for i in range(draw.randint(0, 5))]
        size = draw.randint(1, 5)
        automaton = decontaminate.Automaton([x for x in items if x[1]], size)
        doc = [draw.choice([*letters, b"z"]) for _ in range(draw.randint(0, 30))]
        spans, which = automaton.scan(doc)
        assert ({i for a, b in spans for i in range(a, b)}, which) == windows_hit(doc, items, size)


@pytest.mark.parametrize("block", [2_000_000, 12])
def test_contamination_report(spark, odd, empty, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    base = words(prose(120, 1), ALNUM)
    bench = spark.createDataFrame([(1, " ".join(base[5:30])), (2, "ONE, two"), (3, None), (4, ""), (5, "never said here at all"), (2, "ONE, two")], "item_id long, text string")
    items = [(r.item_id, words(r.text, ALNUM)) for r in bench.collect()]
    want = []
    for r in odd.collect():
        doc = words(r.text, ALNUM)
        hit, which = windows_hit(doc, items, 10)
        want.append((r.doc_id, len(doc), len(hit), len(which), hashlib.sha256(",".join(sorted(map(str, which))).encode()).hexdigest(), bool(hit)))
    assert rows_of(decontaminate.report(odd, bench)) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert decontaminate.report(empty, bench).collect() == []
    assert {r.n_hit for r in decontaminate.report(odd, bench.limit(0)).collect()} == {0}


def test_cleaning_cuts_passages_and_drops_what_is_mostly_one(spark):
    item = prose(30, 21)
    before, after = prose(40, 22), prose(40, 23)
    docs = documents(spark, [(1, f"{before} {item} {after}"), (2, f"so, {item}!"), (3, before), (4, None)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.clean(docs, bench).collect()}
    assert set(got) == {1, 3, 4} and got[3] == before and got[4] is None
    assert item not in got[1] and before in got[1] and after in got[1]
    assert {r.n_hit for r in decontaminate.report(spark.createDataFrame(list(got.items()), "doc_id long, text string"), bench).collect()} == {0}


def brute_clean(text, items, size, coverage=0.5):
    """The text that stays, or None if the document goes; items are (id, words)."""
    turn = 0
    while True:
        data = text.encode()
        spoken = list(re.finditer(rb"[0-9A-Za-z\x80-\xff]+", data))
        hit, _ = windows_hit([m[0].lower().decode() for m in spoken], items, size)
        if not turn and len(hit) > coverage * len(spoken):
            return None
        if not hit:
            return text
        turn, gone = turn + 1, set()
        for i in hit:
            gone |= set(range(spoken[i].start(), spoken[i].end()))
            if i + 1 in hit:
                gone |= set(range(spoken[i].end(), spoken[i + 1].start()))
        text = bytes(c for i, c in enumerate(data) if i not in gone).decode()


@pytest.mark.parametrize("block", [2_000_000, 6])
def test_cleaning_against_brute_force(spark, empty, block, monkeypatch):
    """Items of several blocks that interleave: spans are put together, coverage is judged once, and no window is left."""
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    draw = random.Random(51)
    say = lambda n: " ".join(draw.choice("abcdé") for _ in range(n))
    bench = [(i, say(draw.randint(3, 6))) for i in range(4)] + [(2, "a b"), (None, "é é é é"), (7, None), (8, "")]
    bench += [bench[0]]
    docs = [(i, say(draw.randint(0, 40)) + draw.choice(["", ".", "! a b"])) for i in range(60)]
    docs += [(70, f"z z z z z z z z {bench[0][1].replace(' ', f' {bench[1][1]} ', 1)} z z z z z z z z"), (71, None), (72, ""), (1, docs[1][1]), (None, docs[2][1]), (73, "q " * 3000 + bench[1][1])]
    items = [(i, words(t, ALNUM)) for i, t in bench]
    want = [(i, t if t is None else brute_clean(t, items, 4)) for i, t in docs]
    want = [(i, t) for (i, t), (_, old) in zip(want, docs, strict=True) if t is not None or old is None]
    held = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, spans string, dropped int")
    tests = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.clean(held, tests, window=4)
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert got.columns == held.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=order) == sorted(want, key=order)
    assert decontaminate.clean(held, tests.limit(0)).count() == len(docs)
    assert decontaminate.clean(empty, tests).collect() == []


# 6: chat


def test_escapes_are_reversible():
    draw = random.Random(13)
    for _ in range(500):
        text = "".join(draw.choice(["<", "|", "\\", "turn", ">", "a", chat.END]) for _ in range(draw.randint(0, 12)))
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


@pytest.mark.parametrize("tokens, leaves", [(1 << 16, 4096), (40, 2)])
def test_chat_packs_give_back_all_conversations(spark, tokens, leaves, monkeypatch):
    monkeypatch.setattr(chat, "PACK_TOKENS", tokens)
    monkeypatch.setattr(chat, "PACK_LEAVES", leaves)
    rows = [(c, 0, "system", "Be kind.") for c in range(6)]
    rows += [(c, 1, "user", "hello" if c % 2 else "héllo <|end|>") for c in range(6)] + [(c, 2, "assistant", f"answer {c // 2} <|turn|>\\|") for c in range(5)]
    rows += [(7, 0, None, None), (8, None, "assistant", ""), (9, 0, "assistant", "<"), (9, 1, "assistant", "\\|x"), (9, 1, "assistant", "\\|x"), (None, 0, "user", "whose?")]
    held = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    want = []
    for c in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for i, t, r, x in rows if i == c), key=lambda y: (y[0] is not None, y))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        said = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        size = sum(len(chat.TURN + chat.escape(r) + chat.TEXT + chat.escape(x) + chat.END) for _, r, x in turns)
        want.append((c, len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    path = vocab.tiktoken_path()
    assert rows_of(chat.report(held, path)) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert chat.report(held.limit(0), path).collect() == []


def test_shared_turns_are_emitted_once(spark):
    packer = chat.Packer(lambda s: list(s.encode()))
    packer.add(1, [("user", "hi"), ("assistant", "yes")])
    packer.add(2, [("user", "hi"), ("assistant", "no")])
    packer.add(3, [("user", "hi"), ("assistant", "no")])
    row = packer.row()
    assert len(row["nodes"]) == 3 and bytes(row["ids"]).count(b"hi") == 1 and [x["node"] for x in row["leaves"]] == [1, 2, 2]
    first, yes, no = row["nodes"]
    assert row["position_ids"][no["start"]] == row["position_ids"][yes["start"]] == first["stop"]
    assert row["attend"][2] == [{"start": first["start"], "stop": first["stop"]}]
    assert bytes(i for i, m in zip(row["ids"], row["loss"], strict=True) if m) == b"yesno"


# 7: wrappers


PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul>{menu}</ul></nav><div class="ad">Buy</div><article><h1>{title}</h1>{body}</article><div class="comments"><p>Me too</p></div><footer>&copy; x</footer></body></html>'


def page(i, n):
    return PAGE.format(menu="<li><a href='/a'>a</a></li>" * (1 + i % 4), title=f"Title {i}", body="".join(f"<p><b>Say</b> {i}.{k} &amp; on\n  and</p>" for k in range(n)))


def test_main_text(spark):
    rows = [(i, f"https://h{i % 2}.example.com/{i}", page(i, 1 + i % 5)) for i in range(12)] + [(20, None, page(20, 2)), (21, "http://x.org/a", None), (22, "http://x.org/b", ""), (23, "http://h0.example.com/cut", page(23, 3)[:-60]), (0, "https://h0.example.com/0", page(0, 1))]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = wrappers.extract(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        source = next(x[2] for x in rows if x[0] == r.page_id)
        if not source:
            assert (r.text, r.n_chars) == ("", 0)
            continue
        n = source.count("<p><b>Say")
        want = "\n".join([f"Title {r.page_id}", *(f"Say {r.page_id}.{k} & on and" for k in range(n))])
        assert (r.text, r.n_chars) == (want, len(want))
    assert wrappers.extract(pages.limit(0)).collect() == []


def test_wrappers_are_union_free_and_match_all_rows(spark):
    rows = [wrappers.row_of(wrappers.Page(page(i, n)).tokens) for i, n in ((0, 1), (1, 4), (2, 0))]
    merged = wrappers.merge(wrappers.merge(rows[0], rows[1]), rows[2])
    text = wrappers.as_regex(merged)
    assert "|" not in text and "(<li" not in text.replace("(#text)+", "")
    pattern = lambda w: "".join(re.escape(e[1]) + " " if e[0] == "t" else f"(?:{pattern(e[1])}){e[0]}" for e in w)
    for row in rows:
        flat = lambda w: "".join(e[1] + " " if e[0] == "t" else flat(e[1]) for e in w)
        assert re.fullmatch(pattern(merged), flat(row)), (text, flat(row))


def test_pages_without_an_article(spark):
    body = "<html><body><div id='menu'><a href=x>one two three</a></div><div class='story'><p>{}</p><p>More text follows here, and more.</p></div><div class='sidebar'>{}</div></body></html>"
    pages = spark.createDataFrame([(i, f"http://n.example/{i}", body.format(f"Story {i} is told at length " * 3, "side " * 200)) for i in range(4)], "page_id long, url string, html string")
    for r in wrappers.extract(pages).collect():
        assert r.text.startswith(f"Story {r.page_id}") and r.text.endswith("More text follows here, and more.") and "side" not in r.text


def test_hosts_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "BUCKET", 2)
    rows = [(i, "http://big.example/", "<html><body><article>" + "".join(f"<{t}>x</{t}>" for t in ["section"] * (i % 3) + ["div"] * (i % 4)) + f"<p>Text {i}</p></article></body></html>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert wrappers.wrappers(pages).count() == 1
    assert all(r.text.endswith(f"Text {r.page_id}") for r in wrappers.extract(pages).collect())


def test_slots_are_places_in_the_wrapper(spark):
    """A list of links has the containers of the story but another place in the wrapper, and is no content."""
    menu, story = "<div>{}</div>".format("<a href=x>go</a> " * 3 + "go"), "<div><p>Story {} is told here at some length.</p></div>"
    pages = spark.createDataFrame([(i, "http://slots.example/", f"<html><body>{menu}<section><p>An aside {i}</p></section>{story.format(i)}</body></html>") for i in range(4)], "page_id long, url string, html string")
    assert [r.text for r in wrappers.extract(pages).orderBy("page_id").collect()] == [f"An aside {i}\nStory {i} is told here at some length." for i in range(4)]


def strange_pages(n, seed=0):
    """(page_id, url, html, wanted text): class names that mean nothing, a notice and a legal note that do not vary, a menu of
    links, an article in two containers with optional parts between, and comments of no name behind it."""
    draw, rows = random.Random(seed), []
    notice, legal = "We would like to tell you about our terms here at length, as the law asks of us in this place.", "All of this belongs to somebody, and no part of it may be given away by anybody at all."
    for i in range(n):
        said = [f"{prose(12, seed * 1000 + i * 10 + k)} {i}" for k in range(4)]
        parts = draw.randint(0, 2)
        extra = "".join(f"<section class=qq><p>{said[3]} {k}</p></section>" for k in range(parts))
        remarks = "".join(f"<section class=zz><p>{draw.choice(['Anna B.', 'Otto', 'J. Doe'])}, {1 + k} May 2021</p><p>{prose(9, i * 100 + k)}</p></section>" for k in range(draw.randint(0, 3)))
        menu = "".join(f"<a href=x>go {prose(2, k)}</a> " for k in range(draw.randint(2, 4)))
        html_text = f"<html><body><div class=a1>{menu}</div><div class=a1><p>{notice}</p></div><div class=k9><div class=p1><p>{said[0]}</p><p>{said[1]}</p></div>{extra}<div class=p2><p>{said[2]}</p></div></div>{remarks}<div class=a1>{legal}</div></body></html>"
        rows.append((i, "http://strange.example/", html_text, "\n".join([said[0], said[1], *(f"{said[3]} {k}" for k in range(parts)), said[2]])))
    return rows


def test_names_that_mean_nothing(spark):
    rows = strange_pages(30)
    pages = spark.createDataFrame([(*r[:3], "x", "y") for r in rows], "page_id long, url string, html string, host string, content string")
    got = {r.page_id: r.text for r in wrappers.extract(pages).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_the_wrapper_decides(spark, monkeypatch):
    """With an empty wrapper, slots that only their place tells apart are judged as one, and the result is another."""
    pages = spark.createDataFrame([r[:3] for r in strange_pages(12, 1)], "page_id long, url string, html string")
    with_wrapper = {r.page_id: r.text for r in wrappers.extract(pages).collect()}
    inferred = wrappers._inferred

    def empty_ones(shapes):
        level, paths = inferred(shapes)
        return level.withColumn("row", F.lit("[]")), paths

    monkeypatch.setattr(wrappers, "_inferred", empty_ones)
    without = {r.page_id: r.text for r in wrappers.extract(pages).collect()}
    assert with_wrapper == {r[0]: r[3] for r in strange_pages(12, 1)}
    assert sum(with_wrapper[i] != without[i] for i in without) > 6


class Blocks(html_parser.HTMLParser):
    """(tags around, text, linked characters) of blocks, by another parser; tags have their place among equal ones, counted
    from the end of the page's body for what stands behind its second container."""

    def __init__(self, source):
        super().__init__()
        self.stack, self.counts, self.found, self.linked, self.text, self.links = [], {}, [], 0, "", 0
        self.feed(source)
        self.flush()

    def flush(self):
        text = " ".join(self.text.split())
        if text:
            self.found.append((tuple(self.stack), text, self.links))
        self.text, self.links = "", 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.linked += 1
            return
        self.flush()
        if tag != "p":
            key = (*self.stack, tag, dict(attrs).get("class"))
            self.counts[key] = self.counts.get(key, 0) + 1
            single = dict(attrs).get("class") == "a1"  # these stand one by one, the others in groups
            self.stack.append((tag, dict(attrs).get("class"), self.counts[key] if single else 0))

    def handle_endtag(self, tag):
        if tag == "a":
            self.linked -= 1
            return
        self.flush()
        if tag != "p":
            self.stack.pop()

    def handle_data(self, data):
        self.text += data
        self.links += len(data) * (self.linked > 0)


def test_main_text_against_brute_force(spark):
    """All pages of a host at once, with copies of pages, by a parser and slots of another kind."""
    rows = strange_pages(40, 2)
    rows += [(100 + i, *rows[i % 3][1:]) for i in range(30)]  # copies don't make a text one of the template
    parsed = {r[0]: Blocks(r[2]).found for r in rows}
    distinct = {tuple(x): i for i, x in parsed.items()}
    texts, links = {}, {}
    for i in distinct.values():
        for place in {b[0] for b in parsed[i]}:
            mine = [b for b in parsed[i] if b[0] == place]
            texts.setdefault(place, []).append("\n".join(b[1] for b in mine))
            links[place] = links.get(place, 0) + sum(2 * b[2] - len(b[1]) for b in mine)
    fixed = {place for place, held in texts.items() if len(held) >= 3 and max(map(held.count, held)) >= 0.9 * len(held)}
    signed = {place for place, held in texts.items() if sum(bool(re.match(r"[A-Z][^\n]*, \d+ May \d+\n", x)) for x in held) > len(held) / 2}
    want = {i: "\n".join(b[1] for b in blocks if b[0] not in fixed | signed and links[b[0]] < 0) for i, blocks in parsed.items()}
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in wrappers.extract(pages).collect()} == want


def test_common_places_are_longest(monkeypatch):
    draw = random.Random(81)
    for bits in (1 << 28, 40):
        monkeypatch.setattr(wrappers, "TABLE_BITS", bits)
        for _ in range(200):
            a, b = ([draw.randrange(4) for _ in range(draw.randint(0, 18))] for _ in range(2))
            table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
            got = wrappers.common(a, b)
            assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
            assert len(got) == table[-1][-1]


def test_long_rows_are_merged_in_time():
    draw, rows = random.Random(82), []
    for _ in range(2):
        tokens = []
        for _ in range(1700):
            label = f"div.{draw.choice('abcdefgh')}"
            tokens += ["<" + label, wrappers.TEXT, ">" + label]
        rows.append([["t", t] for t in tokens])
    began = time.perf_counter()
    merged = wrappers.merge(*rows)
    assert time.perf_counter() - began < 3 and merged


def test_a_very_long_page(spark):
    body = "".join(f"<div class=c{i % 7}><p>Part {i} of it is said here.</p></div>" for i in range(3000))
    pages = spark.createDataFrame([(1, "http://long.example/", f"<html><body><article>{body}</article></body></html>")], "page_id long, url string, html string")
    assert wrappers.extract(pages).first().text == "\n".join(f"Part {i} of it is said here." for i in range(3000))


@pytest.mark.parametrize("text, found", [("Anna, 3 May 2021", True), ("by Otto K. on 2021-05-03 at 10:11", True), ("J. Doe says:", True), ("joe_x 2 hours ago", True), ("3 May 2021", False), ("May 3, 2021", False), ("On 3 May 2021", False), ("The story of the year 2021", False), ("It was on 3 May that a long sentence began to be told to all of us", False)])
def test_bylines(text, found):
    assert wrappers.byline(text) == found


def test_wrappers_parse_the_rows_they_come_from():
    draw = random.Random(17)
    for _ in range(150):
        pages = ["".join(f"<{t}>{'x' * draw.randint(0, 1)}</{t}>" for t in draw.choices(["div", "ul", "section"], k=draw.randint(0, 7))) for _ in range(draw.randint(1, 6))]
        tokens = [wrappers.Page(p).tokens for p in pages]
        wrapper = wrappers.row_of(tokens[0])
        for row in tokens[1:]:
            wrapper = wrappers.merge(wrapper, wrappers.row_of(row))
        for row in tokens:
            found = wrappers.parse(wrappers.program(wrapper), row)
            assert found is not None and len(found) == row.count(wrappers.TEXT)
    assert wrappers.parse(wrappers.program(wrappers.row_of(["<div", ">div"])), ["<ul", ">ul"]) is None


def test_templates_of_a_host_are_judged_on_their_own(spark):
    said = "{} is said here at length, in quite a few words."
    bodies = {
        "article": f"<article><p>{said}</p></article>",
        "main": f"<main><p>{said}</p></main>",
        "content": f"<div class='content'><p>{said}</p></div>",
        "siblings": f"<div class='story'><section class='a'><p>{said}</p></section><ul><li><a href=x>a link in {{}}</a></li></ul><section class='b'><p>{said}</p></section></div>",
        "list": f"<div><p>{said}</p></div><ul><li>One more thing {{}}</li></ul>",
    }
    rows = [(i * 10 + k, "http://mixed.example/", f"<html><body><nav><a href=x>menu</a></nav>{body.replace('{}', f'{name} {i}')}<footer>end</footer></body></html>") for i in range(4) for k, (name, body) in enumerate(bodies.items())]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(4):
        for k, name in enumerate(bodies):
            text = said.format(f"{name} {i}")
            assert got[i * 10 + k] == {"siblings": f"{text}\na link in {name} {i}\n{text}", "list": f"{text}\nOne more thing {name} {i}"}.get(name, text)


def content_of(html_text):
    """What is content of a page that is its host's only one."""
    found, held = wrappers.Page(html_text), {}
    for at, (_, text, linked) in zip(found.places, found.blocks, strict=True):
        held[at] = tuple(x + y for x, y in zip(held.get(at, (0, 0)), (len(text), linked), strict=True))
    wanted = wrappers.content_slots(found.tokens, held)
    return [text for at, (_, text, _) in zip(found.places, found.blocks, strict=True) if at in wanted]


@pytest.mark.parametrize("around", ["<div class='page no-sidebar'>", "<div id='has-cookie-notice'>", "<div class='widget Blog'>", "<div class='content with-header'>", "<div class='notice'>", "<main><div class='widget'>"])
def test_class_words_around_an_article_do_not_hide_it(around):
    outside = "<div class='sidebar'><p>Not this one</p></div><div class='comments'><article><p>Nor this</p></article></div>"
    assert content_of(f"<body>{around}<article><p>The article says this.</p></article>{outside}</div></body>") == ["The article says this."]
    assert content_of(f"<body>{around}<p>A page without one says this at some length.</p><div class='sidebar'><p>Not this</p></div></div><footer>end</footer></body>") == ["A page without one says this at some length."]


@pytest.mark.parametrize("word", ["share", "related", "alert", "notice", "banner", "ad"])
def test_sections_of_an_article_stay(word):
    assert content_of(f"<article><p>First.</p><section class='{word}'><p>A real section.</p></section><div class='{word}'><a href=x>Links only</a></div></article><div class='{word}'>Out</div>") == ["First.", "A real section."]


def test_pages_of_chrome_alone_are_empty():
    assert content_of("<nav><a href=x>menu</a></nav><article></article><div class='ad'>Buy</div><footer>end</footer>") == []


@pytest.mark.parametrize(
    "source, texts",
    [
        ("<script>for(i=0;i<n;i++){}</script><p>text</p>", ["text"]),
        ("<script>if(a<b)document.write('<p>x</p><!--')</SCRIPT ><p>text</p>", ["text"]),
        ("<style>a<b{}</style><p>text</p><script>var x", ["text"]),
        ("<head><script>var t='</head>';a<b</script><title>T<b</title></head><body><p>text</p>", ["text"]),
        ("<p>one</p><select><option>a<option>b<p>two</p>", ["one", "two"]),
        ("<p>one</p><canvas><p>two</p>", ["one", "two"]),
        ("<p>one</p><object data=x><p>two</p><object>no<object>no</object></object><p>three</p>", ["one", "two", "three"]),
        ("<p>one</p><svg><svg>no</svg>no</svg><script src=x/></script><p>two</p>", ["one", "two"]),
    ],
)
def test_silent_elements_end_at_their_end_tag(source, texts):
    assert [text for _, text, _ in wrappers.Page(source).blocks] == texts


def test_references_and_space():
    assert wrappers.Page("<p>a&nbsp;&lt;b&gt;\n &eacute;&#233;</p>").blocks == [("", "a <b> éé", 0)]
    assert html.unescape("&eacute;") == "é"


# 8: near duplicates


def shingles(text):
    w = words(text, SPACED)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        component = least.get(find(i)) if d is not None else None
        out.append((d, len(sets[i]), component, component == d))
    return out


def near_copies(seed, n, edits):
    draw = random.Random(seed)
    base = prose(150, seed).split()
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(draw.randint(0, edits)):
            copy[draw.randrange(len(copy))] = f"w{draw.randrange(50)}"
        out.append(" ".join(copy))
    return out


def test_near_duplicates_against_all_pairs(spark, odd, empty):
    texts = near_copies(31, 40, 8) + near_copies(32, 12, 3) + [prose(90, s) for s in range(40, 52)]
    rows = [(100 + i, t) for i, t in enumerate(texts)] + [(r.doc_id, r.text) for r in odd.collect()]
    random.Random(1).shuffle(rows)
    got = rows_of(near_dup.report(documents(spark, rows)))
    assert got == sorted(brute_components(rows), key=lambda r: tuple((x is None, str(x)) for x in r))
    assert near_dup.report(empty).collect() == []


def test_one_of_each_group_stays(spark, odd):
    kept = near_dup.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 8, 10, 11, 12] and ids.count(None) == 1


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    a, b, c = prose(60, 201), prose(60, 202), prose(60, 203)
    docs = spark.createDataFrame([(1, a, 0, "x"), (2, b, 0, "x"), (2, a, 0, "x"), (3, b, 0, "x"), (3, c, 0, "x"), (3, c, 0, "x")], "doc_id long, text string, _doc int, first string")
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, a), (2, b), (3, c)])


def test_classes_are_told_apart_by_their_whole_digest(spark):
    """Two sets whose digests begin alike stay two classes, and give a row a document."""
    rows = [(i, t) for i, t in enumerate(near_copies(33, 6, 0) + near_copies(34, 6, 3) + [prose(90, s) for s in range(60, 66)])]
    docs = documents(spark, rows)
    table, _ = shared.written(near_dup.sketches(docs).withColumn("high", F.when(F.col("high").isNotNull(), 7)), "sketches")
    out, _ = near_dup.components_of(docs, table)
    got = sorted((r.doc_id, r.least.doc_id) for r in out.collect())
    assert got == sorted((d, c) for d, _, c, _ in brute_components(rows))


@pytest.mark.parametrize("hot", [2, 1024])
def test_pairs_of_the_prefix_filter(spark, hot, monkeypatch):
    """All pairs of rows of a shingle that can be linked, however common it is, but not those of one component."""
    monkeypatch.setattr(near_dup, "HOT_ROWS", hot)
    draw = random.Random(71)
    rows = [(draw.randrange(3), node, draw.randrange(8), size, draw.randrange(max(1, size // 4))) for node, size in enumerate(draw.choices(range(1, 60), k=150))]
    held = spark.createDataFrame(rows, "shingle long, node long, root long, size int, place int")
    top = {}
    for s in range(3):
        count = {}
        for r in rows:
            if r[0] == s:
                count[r[2]] = count.get(r[2], 0) + 1
        top[s] = max(count, key=lambda k: (count[k], k))
    tops = spark.createDataFrame([(s, t, min(r[3] for r in rows if r[0] == s), sum(r[0] == s for r in rows)) for s, t in top.items()], "shingle long, top long, smallest int, n long")
    want = set()
    for s, a, ra, na, pa_ in rows:
        for z, b, rb, nb, pb in rows:
            if s == z and a < b and ra != rb and 175 * min(na - pa_, nb - pb) >= 75 * (na + nb):
                want.add((a, b))
    assert {(r.a, r.b) for r in near_dup._pairs(held, tops).collect()} == want and want


def test_the_pairwise_round_finds_what_stars_leave(spark, monkeypatch):
    """Without a round of stars after the first, links come from the prefix filter; the components are the same."""
    monkeypatch.setattr(near_dup, "STARS", 1)
    seen, across = [], near_dup._across
    monkeypatch.setattr(near_dup, "_across", lambda *a: seen.append(1) or across(*a))
    texts = near_copies(35, 60, 25) + near_copies(36, 30, 20)
    rows = list(enumerate(texts))
    assert rows_of(near_dup.report(documents(spark, rows))) == sorted(brute_components(rows), key=lambda r: tuple((x is None, str(x)) for x in r))
    assert seen


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}


# 9: licenses


def test_base_phrases_and_labels(spark, odd, empty):
    texts = ["MIT License. CC-BY 4.0! gnu general public license", "the GNU General  Public\nLicense and the Apache License, Version 2.0", "gnu general public mit", "cc by cc by cc by", "Permission is hereby granted, free of charge, to any person obtaining one copy of this software and its documentation files", "licence of the public", None, "", "mit license", "mit license"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9, "mit license"), (None, "apache license")]
    got = licenses.report(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id)
        w = words(text, ALNUM)
        places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        starts = [p for p, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert next(r for r in got if r.doc_id == 4).labels == "mit"  # a passage with words changed
    assert licenses.report(empty).collect() == []
    assert len(licenses.report(odd).collect()) == odd.count()


def brute_labels(text):
    """Labels and score of a text by every alignment on every window of neighbouring diagonals."""
    w, labels, score = words(text, ALNUM), set(), 0.0
    for template, label, exact in licenses.TEMPLATES:
        n = len(template)
        if exact:
            if any(w[i : i + n] == template for i in range(len(w))):
                labels.add(label)
                score = 1.0
            continue
        voted = {i - q for q in range(n - 1) for i in range(len(w) - 1) if w[i : i + 2] == template[q : q + 2]}
        most = int((1 - licenses.COVER) * n / licenses.INSERTED)
        for low in voted:
            high = low
            while any(d in voted and d - low <= most for d in range(high + 1, high + licenses.SLACK + 1)):
                high = max(d for d in range(high + 1, high + licenses.SLACK + 1) if d in voted and d - low <= most)

            @functools.cache
            def best(q, p):
                """The most that an alignment from the pair (q, p) on can count."""
                after = [(a, b) for a in range(q + 1, n) for b in range(p + 1, len(w)) if low <= b - a <= high and w[b] == template[a]]
                return 1 + max([0, *(best(a, b) - licenses.INSERTED * max(0, (b - p) - (a - q)) for a, b in after)])

            reached = max([0, *(best(q, q + d) / n for q in range(n) for d in range(low, high + 1) if 0 <= q + d < len(w) and w[q + d] == template[q])])
            if reached >= licenses.COVER:
                labels.add(label)
                score = max(score, reached)
    return ",".join(sorted(labels)), score


def test_labels_and_scores_against_brute_force(spark):
    """Words replaced, left out, put in and moved, alone and beside other phrases."""
    draw, texts = random.Random(19), []
    for passage in licenses.PASSAGES:
        w = passage.split()
        most = len(w) - math.ceil(licenses.COVER * len(w))
        for at in [list(range(1, len(w) - 1, 2))[:most], list(range(1, len(w) - 1, 3))[:most], sorted(draw.sample(range(len(w)), most))]:
            changed = ["zzz" if i in at else x for i, x in enumerate(w)]
            texts += [" ".join(changed), " ".join(f"{x} qqq" if i % 3 == 1 else x for i, x in enumerate(w)), prose(30, len(texts)) + " " + " ".join(changed), " ".join(x for i, x in enumerate(w) if i not in at), " ".join(f"{x} qqq" if i in at else x for i, x in enumerate(w))]
        pieces = [" ".join(w[i : i + 2]) + " zzz" for i in range(len(w) - 1)]
        texts += [" ".join(pieces), " ".join(w[len(w) // 2 :] + w[: len(w) // 2]), " ".join(reversed(w)), passage, f"{passage} {passage}"]
    texts += [f"{t} mit license" for t in texts[::3]]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        labels, score = brute_labels(text)
        assert got[i][0] == labels and abs(got[i][1] - score) < 1e-9, (text, got[i], labels, score)
    drifting = texts.index(" ".join(" ".join(w[i : i + 2]) + " zzz" for w in [list(licenses.PASSAGES)[0].split()] for i in range(len(w) - 1)))
    assert got[drifting] == ("", 0.0)  # a passage in pieces far apart is none


# 10: quality


def brute_facts(text):
    text = text or ""
    w = re.findall(SPACED, text)
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(SPACED, x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_counts_are_carried_over():
    texts = [b"", b"a b c a b c a b c", b"x # y\nx # y\n\n", "\u00e9t\u00e9 word ".encode() * 40]
    whole = quality.Facts(b"".join(texts), np.cumsum([0, *map(len, texts)]))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    known = {name: getattr(whole, name) for name in names}
    keep = np.array([True, False, True, True])
    part, fresh = whole.only(keep), quality.Facts(b"".join(texts), np.cumsum([0, *map(len, texts)])).only(keep)
    for name in names:
        assert getattr(part, name).tolist() == known[name][keep].tolist() == getattr(fresh, name).tolist()
    assert "words" not in vars(part) and "words" in vars(fresh)


def test_ranges_grow_with_bytes(spark, monkeypatch):
    made = spark.createDataFrame([(i, "text " * 100) for i in range(50)], "doc_id long, text string")
    docs, _ = shared.written(made, "test-ranges")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert shared.ranges(docs) == shared.ranges(made) == shared.ranges(docs.limit(0)) == least
    monkeypatch.setattr(shared, "RANGE_BYTES", 500)
    assert least < shared.ranges(docs) == shared.ranges(docs.unionByName(made)) < 100 and shared.ranges(made) == least
    got = sstable.report(docs, vocab.tokenizers_path()).orderBy("start").collect()
    assert [r.doc_id for r in got] == list(range(50))


def test_quality_facts(spark, odd, empty):
    extra = documents(spark, [(50, "a b c a b c"), (51, "x\nx\n\n \nx y"), (52, "### $$ & | <b> " * 30), (53, prose(100, 61) + "\n" + prose(60, 62))])
    docs = odd.unionByName(extra)
    for r in quality.facts(docs).collect():
        want = brute_facts(next(x.text for x in docs.collect() if x.doc_id == r.doc_id))
        assert tuple(r[1:7]) == want, r
        assert not (r.kept and r.base_failed)
    kept = quality.cascade(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in quality.facts(docs).where("kept").collect())
    assert quality.facts(empty).collect() == [] and quality.cascade(empty).collect() == []


def test_a_scope_removes_what_operators_wrote(spark, odd, tmp_path):
    with shared.scope(spark):
        out, path = shared.written(odd, "scoped")
        assert out.count() == odd.count()
    with pytest.raises(Exception, match="scoped"):
        spark.read.parquet(path)


def test_the_sample_is_spread_over_the_table(spark, monkeypatch):
    """A table sorted by what a rule rejects is not judged by its first rows."""
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 16)
    docs = spark.range(800).repartitionByRange(8, "id").selectExpr("id as doc_id", "if(id < 400, 'short', repeat('### ', 60)) as text")
    assert sorted(quality.estimate(docs)) == sorted(quality.RULES) and quality.estimate(docs.limit(0)) is not None


def test_the_order_of_rules_does_not_matter(odd):
    texts = [(r.text or "").encode() for r in odd.collect()]
    facts = lambda: quality.Facts(b"".join(texts), np.cumsum([0, *map(len, texts)]))
    names = list(quality.RULES)
    want = quality.verdicts(facts(), names).tolist()
    for seed in range(5):
        random.Random(seed).shuffle(names)
        assert quality.verdicts(facts(), names).tolist() == want
    assert sorted(quality.estimate(odd)) == sorted(quality.RULES)


def test_wrapper_elements_are_json():
    assert json.loads(json.dumps(wrappers.row_of(["<a", wrappers.TEXT, ">a"])))
