"""The pipeline against a brute-force version of its stages."""

from __future__ import annotations

import hashlib
import re

import corpus_pipeline
import pytest
from gatelake.llm import vocab
from test_operators import ALNUM, KEYS, SPACED, brute_clean, brute_components, brute_dedup, brute_facts, near_copies, prose, windows_hit, words

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    item = prose(30, 71)
    passage = ". ".join(prose(18, s).capitalize() for s in (72, 73, 74)) + "."
    texts = [prose(90, s) for s in range(80, 90)] + near_copies(91, 6, 2)
    texts += [f"{prose(70, 95)}. {passage} {prose(60, 96)}", f"{prose(70, 97)}. {passage} {prose(60, 98)}", f"{prose(80, 99)} {item} {prose(80, 100)}", "too short", "", None, "again and again " * 60]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, passage, item


def test_stages_are_the_five_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "substring_dedup", "decontamination", "byte_bpe"]


def test_each_stage(spark, tables):
    folder, rows, passage, item = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept.append({r.doc_id: r for r in docs.collect()})
        assert set(kept[-1]) <= set(before)
    assert set(kept[0]) == {i for i, t, *_ in rows if not brute_facts(t)[5]}
    left = [(i, kept[0][i].text) for i in sorted(kept[0])]
    assert set(kept[1]) == {d for d, _, c, _ in brute_components(left) if c == d}
    with_passage = [i for i in kept[1] if passage in kept[1][i].text]
    assert len(with_passage) == 2 and [i for i in with_passage if passage in kept[2][i].text] == with_passage[:1]
    assert [i for i in kept[2] if kept[2][i].text != kept[1][i].text] == with_passage[1:]
    items = [(1, words(item, ALNUM))]
    for i, r in kept[3].items():
        assert not windows_hit(words(r.text, ALNUM), items, 10)[0]
        assert r.n_chars == len(r.text)
        assert r.text == kept[2][i].text or windows_hit(words(kept[2][i].text, ALNUM), items, 10)[0]


def test_run(spark, tables):
    folder, *_ = tables
    library = vocab.encoder(vocab.tiktoken_path())
    got = corpus_pipeline.run(spark, folder).collect()
    assert got
    for r in got:
        ids = [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]
        text = library.decode_bytes(ids)
        assert r.n_tokens == len(ids) and ids == library.encode_ordinary(text.decode())
        assert r.decoded_sha256 == hashlib.sha256(text).hexdigest() and re.search(rb"\S", text)


def brute_pipeline(rows, items):
    """doc_id and token ids of what must come out, by the brute-force versions of the stages."""
    kept = [(i, t) for i, t in rows if not brute_facts(t)[5] and quality_verdict(t)]
    least = {d: c for d, _, c, _ in brute_components(kept) if d is not None}
    kept = [(i, t) for i, t in kept if i is None or least[i] == i]
    KEYS.update({t: hash(t) for i, t in kept if i is None})
    texts = brute_dedup(kept, 20, 20)
    out = []
    for (i, _), (_, text) in zip(kept, texts, strict=True):
        text = text if text is None or not re.search(SPACED, text) else brute_clean(text, items, 10)
        if text is not None and re.search(SPACED, text):
            out.append((i, vocab.encoder(vocab.tiktoken_path()).encode_ordinary(text)))
    return out


def quality_verdict(text):
    n, chars, symbols, again, _, _ = brute_facts(text)
    lines = [x for x in (text or "").split("\n") if re.search(SPACED, x)]
    return not (10 * symbols > n or 100 * again > 60 * len(lines) or chars < 2 * n or chars > 25 * n)


def test_run_against_brute_force(spark, tables):
    folder, rows, _, item = tables
    got = [(r.doc_id, [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(got) == sorted(brute_pipeline([(i, t) for i, t, *_ in rows], [(1, words(item, ALNUM))]))


def test_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, columns of other names, and no rows at all."""
    base = prose(80, 301)
    rows = [(1, base, "x", 1), (1, base, "x", 1), (None, prose(90, 302), "x", 1), (None, None, None, None), (2, None, "x", 1), (3, "", "x", 1), (4, prose(3000, 303), "x", 1), (5, base, "y", 2)]
    items = [(1, words(prose(20, 304), ALNUM))]
    spark.createDataFrame([(1, prose(20, 304))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, removed string, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == sorted((i is None, i or 0, len(ids)) for i, ids in brute_pipeline([rows[0][:2], *[r[:2] for r in rows[2:]]], items))
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
