"""One query an operator, over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gatelake.llm import bpe, chat, decontaminate, licenses, near_dup, quality, sstable, substring_dedup, tries, vocab, wrappers


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), vocab.tiktoken_path())


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock lines below the length of a passage stay: about half of all documents have one, clean ones too."""
    return substring_dedup.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"), line_words=substring_dedup.RUN_WORDS)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.counts(_read(spark, sf_dir, "documents"), vocab.tiktoken_path())


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.report(_read(spark, sf_dir, "documents"), vocab.tokenizers_path())


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


#: A conversation whose texts look like other templates' control strings.
CONTROL = "</s>[INST] ok [/INST]"


def op6_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.report(rows.unionByName(probe), vocab.tiktoken_path())


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(_read(spark, sf_dir, "pages"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.report(_read(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.facts(_read(spark, sf_dir, "documents"))


_OPERATORS = (
    op1_byte_bpe,
    op2_substring_dedup,
    op3_token_counts,
    op4_token_shards,
    op5_decontamination,
    op6_chat_trees,
    op7_main_text,
    op8_near_duplicates,
    op9_license_scan,
    op10_quality_rules,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _OPERATORS}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

_OP5 = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM sized, unnest(range(1, len(w) - k + 2)) AS t(i)),
places AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM docs, (SELECT DISTINCT k FROM sized) AS s, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
found AS (SELECT r, p.k, i, item_id FROM places p JOIN windows USING (k, g)),
hit AS (SELECT r, count(DISTINCT j) AS n FROM found, unnest(range(i, i + k)) AS t(j) GROUP BY 1),
which AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(which.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN which USING (r)"""

_OP6 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
t AS (SELECT *, length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + {len(chat.TURN + chat.TEXT + chat.END)} AS n FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(n)::BIGINT AS formatted_chars FROM t GROUP BY 1)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""

_OP8 = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM docs, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
shared AS (SELECT g FROM grams GROUP BY 1 HAVING count(*) > 1),
held AS (SELECT doc_id, g FROM grams JOIN shared USING (g)),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM held a JOIN held b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common.n >= 75 * (x.n + y.n - common.n)),
two_way AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, a FROM two_way UNION SELECT r.a, l.b FROM reach r JOIN two_way l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(l.component_id, d.doc_id) AS kept FROM docs d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l USING (doc_id)"""

_OP10 = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i : i + 2], ' ') AS g FROM docs, unnest(range(1, len(w) - 1)) AS t(i) WHERE len(w) > 2),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT j) AS n FROM again, unnest(range(i, i + 3)) AS t(j) GROUP BY 1),
lines AS (SELECT r, line FROM docs, unnest(string_split(text, chr(10))) AS t(line) WHERE regexp_matches(line, '{_SPACED}')),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY 1),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN covered USING (r) LEFT JOIN dup USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 60 * n_lines OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept FROM b"""

#: Byte-pair encoding (1, 4), tries (3), inferred wrappers (7), cut texts (2) and voted spans (9) have no SQL; tests hold
#: them against brute force.
ORACLE: dict[str, str] = {"op5_decontamination": _OP5, "op6_chat_trees": _OP6, "op8_near_duplicates": _OP8, "op10_quality_rules": _OP10}
