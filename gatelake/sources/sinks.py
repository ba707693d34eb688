"""Sinks: partitioned tables, result files by configuration, mask stores and documents, written by Spark's committers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.operators import sampling


def append_new(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows of which the key is not in the table yet; returns them."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates([key])
    if _there(spark, path):
        fresh = fresh.join(spark.read.schema(rows.schema).parquet(path).select(key), key, "left_anti").select(*rows.columns)
    fresh.write.mode("append").parquet(path)
    return fresh


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def by_algorithm(rows: DataFrame, path: str, column: str = "algorithm") -> None:
    """CSV files with a header, a folder for each algorithm."""
    rows.write.mode("overwrite").partitionBy(column).option("header", "true").csv(path)


def results(rows: DataFrame, path: str, keys: Sequence[str] = ("run_label", "eval_mode", "device", "split")) -> None:
    """Result rows in folders by configuration; only the configurations in ``rows`` are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def benchmarks(rows: DataFrame, path: str, cap: int = 0, seed: int = 0) -> None:
    """Benchmark rows a graph; a cap over 0 keeps a seeded sample of so many, as for predictions."""
    sampling.sample(rows, "graph_id", cap, seed).write.mode("overwrite").option("header", "true").csv(path)


def predictions(rows: DataFrame, path: str, cap: int = 0, seed: int = 0) -> None:
    """Predictions with their absolute errors; a cap over 0 keeps a seeded sample of so many."""
    out = rows.withColumn("abs_error", F.abs(F.col("prediction") - F.col("target")))
    sampling.sample(out, "graph_id", cap, seed).write.mode("overwrite").option("header", "true").csv(path)


def masks(rows: DataFrame, path: str) -> None:
    """Appends masks (algo, graph_id, item_id, keep) to a store in folders by algorithm."""
    rows.write.mode("append").partitionBy("algo").parquet(path)


def graphs(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Appends the graphs that the store does not have, nodes and edges clustered by graph."""
    spark = nodes.sparkSession
    for name, df in (("nodes", nodes), ("edges", edges)):
        at = f"{path}/{name}"
        fresh = df
        if _there(spark, at):
            fresh = df.join(spark.read.schema(df.schema).parquet(at).select("graph_id").distinct(), "graph_id", "left_anti").select(*df.columns)
        fresh.repartition("graph_id").sortWithinPartitions("graph_id").write.mode("append").parquet(at)


def issues(tables: dict[str, DataFrame], path: str) -> None:
    """One CSV folder for each kind of issue."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", "true").csv(f"{path}/{name}")


#: Paths that a document of one JSON value may have; more are written as lines.
DOCUMENT_PATHS = 1 << 20


def splits_document(splits: DataFrame, path: str) -> None:
    """A splits document, {"train": [..], "val": [..], "test": [..]}: one JSON value, as its readers expect, which is held by
    one task. So a table of more than DOCUMENT_PATHS paths is an error, and is for ``splits_lines``."""
    if splits.count() > DOCUMENT_PATHS:
        raise ValueError("too many paths for one document; write them as lines")
    lists = splits.groupBy().agg(*[F.array_sort(F.collect_list(F.when(F.col("split") == s, F.col("path")))).alias(s) for s in ("train", "val", "test")])
    lists.repartition(1).write.mode("overwrite").json(path)


def splits_lines(splits: DataFrame, path: str) -> None:
    """The same for any number of paths: a line of JSON a path, {"path": .., "split": ..}."""
    splits.select("path", "split").write.mode("overwrite").json(path)


def graph_lines(rows: DataFrame, path: str) -> None:
    """A manifest for any number of graphs: a line of JSON an entry."""
    rows.write.mode("overwrite").json(path)


def rewritten(spark: SparkSession, path: str, target: str, plan: DataFrame, columns: Sequence[str], dry_run: bool = False) -> int:
    """Writes a CSV table anew under ``target`` with planned renames in its path columns, and returns the number of values
    that change. A dry run only counts."""
    from gatelake.operators import audit

    held = spark.read.csv(path, header=True, inferSchema=False)
    change = plan.select("path").distinct()
    n = sum(held.join(change, held[c] == change.path, "left_semi").count() for c in columns)
    if not dry_run:
        audit.mapped(held, plan, *columns).write.mode("overwrite").option("header", "true").csv(target)
    return n
