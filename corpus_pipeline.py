"""The corpus pipeline: rejects poor documents, keeps one of near copies, cuts repeated passages and benchmark text,
and encodes what is left. Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.

Defined results: a document without words (null, empty or white space) is rejected by the first stage, and one that a
later stage leaves without words goes; a row with a null doc_id is no copy of another, ranks last in substring dedup and
keeps its null; of repeated rows one stays; very long texts are worked on whole, and must fit a worker; empty tables give
an empty table; other columns pass through unchanged whatever their names, and ``n_chars`` follows a text that was cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.llm import bpe, decontaminate, near_dup, quality, shared, substring_dedup, vocab


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars`` follows a text that was cut; a document of which nothing is left goes."""
    docs = docs.where(F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))
    return docs.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.cascade(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; stock lines below the length of a passage stay, as nearly half of
    all documents, and clean ones too, have one."""
    return _counted(substring_dedup.dedup(docs, line_words=substring_dedup.RUN_WORDS), docs.columns)


def benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that are mostly such passages go."""
    return _counted(decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the bytes decoded from them."""
    return bpe.round_trip(docs, vocab.tiktoken_path(), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_text),
    ("byte_bpe", encoded),
]

#: SQL has no byte-pair encoding; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; between them a table in the shared folder cuts the lineage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
