"""Trivial predictors and least squares, fitted on train and scored by stratum."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelake.functions import scalars
from gatelake.operators import metrics
from gatelake.sources import scratch

LIVE_SHARE = 0.05


def usable(rows: DataFrame) -> DataFrame:
    """Rows with all that a predictor reads and a graph of some size; a missing level stays."""
    return rows.na.drop(subset=["graph_path", "target", "num_pi", "num_and", "num_po"]).where("num_nodes > 0 and num_edges > 0")


def constants(train: DataFrame) -> DataFrame:
    """One row: mean and median of the train target, and zero."""
    return train.agg(F.avg("target").alias("mean"), F.median("target").alias("median"), F.lit(0.0).alias("zero"))


def gram(rows: DataFrame, features: Sequence[Column], target: Column) -> tuple[np.ndarray, np.ndarray]:
    """Normal equations of least squares with an intercept, from one aggregate."""
    columns = [F.lit(1.0), *features, target]
    n = len(columns)
    sums = rows.agg(*[F.sum(columns[i] * columns[j]).alias(f"s{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    full = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)], float)
    return full[:-1, :-1], full[:-1, -1]


def least_squares(rows: DataFrame, features: Sequence[Column], target: Column) -> tuple[list[float], int, float]:
    """Coefficients (intercept first) of smallest norm, rank and condition number of the design."""
    a, b = gram(rows, features, target)
    singular = np.linalg.svd(a, compute_uv=False)
    rank = int((singular > singular[0] * 1e-12).sum()) if singular[0] > 0 else 0
    condition = float(np.sqrt(singular[0] / singular[-1])) if singular[-1] > 0 else float("inf")
    return (np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ b).tolist(), rank, condition


def linear(coefficients: Sequence[float], features: Sequence[Column]) -> Column:
    """A linear prediction, clipped to the range of the target."""
    out = F.lit(float(coefficients[0]))
    for c, x in zip(coefficients[1:], features, strict=True):
        out = out + F.lit(float(c)) * x
    return scalars.unit_clip(out)


def size_features() -> list[Column]:
    return [F.log10("num_nodes"), F.log10("num_edges")]


def count_features() -> list[Column]:
    return [F.log10(1 + F.col(c)) for c in ("num_pi", "num_and", "num_po")]


def edges_of(train: DataFrame, value: str, bins: int = 10) -> list[float]:
    """Interior quantiles without repeats, nulls left out."""
    found = train.agg(F.percentile(value, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("q")).first().q
    return sorted({float(q) for q in found or ()})


def cell(value: str, edges: Sequence[float]) -> Column:
    """Number of edges at or below a value; -1 for a null."""
    count = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(value))) if edges else F.lit(0)
    return F.when(F.col(value).isNull(), -1).otherwise(count).cast("int")


def cell_means(train: DataFrame, rows: DataFrame, bins: int = 10) -> DataFrame:
    """``rows`` with the train mean of their (size, level) cell; unseen cells get the train mean."""
    size, level = edges_of(train, "num_nodes", bins), edges_of(train, "level", bins)
    cells = lambda df: df.withColumn("_a", cell("num_nodes", size)).withColumn("_b", cell("level", level))
    means = cells(train).groupBy("_a", "_b").agg(F.avg("target").alias("_mean"))
    overall = train.agg(F.avg("target").alias("_all"))
    return cells(rows).join(means, ["_a", "_b"], "left").crossJoin(F.broadcast(overall)).withColumn("size_level", F.coalesce("_mean", "_all")).drop("_a", "_b", "_mean", "_all")


def group_means(train: DataFrame, rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with the train mean of their group, or of all."""
    means = train.groupBy(key).agg(F.avg("target").alias("_mean"))
    overall = train.agg(F.avg("target").alias("_all"))  # one row
    return rows.join(means, key, "left").crossJoin(F.broadcast(overall)).withColumn(name, F.coalesce("_mean", "_all")).drop("_mean", "_all")


FAIR = ("mean", "median", "zero", "size", "counts", "size_level")
ORACLE = ("source_script_mean",)


def predicted(train: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with a column for each predictor, all fitted on train."""
    out = rows.crossJoin(F.broadcast(constants(train)))  # one row
    out = out.withColumn("size", linear(least_squares(train, size_features(), F.col("target"))[0], size_features()))
    out = out.withColumn("counts", linear(least_squares(train, count_features(), F.col("target"))[0], count_features()))
    return group_means(train, cell_means(train, out), "source_script", "source_script_mean")


def strata(rows: DataFrame) -> DataFrame:
    """Each row once for each stratum that it is in: all, changed targets, designs that vary, both, and its design."""
    spread = rows.groupBy("design").agg(F.stddev_samp("target").alias("_spread"))
    pooled = rows.agg(F.stddev_samp("target").alias("_pooled"))
    known = rows.join(spread, "design").crossJoin(F.broadcast(pooled))  # one row
    changed, live = F.col("target") > 0, F.coalesce(F.col("_spread") >= LIVE_SHARE * F.col("_pooled"), F.lit(False))
    names = F.array_compact(F.array(F.lit("pooled"), F.when(changed, F.lit("nonzero")), F.when(live, F.lit("live_designs")), F.when(changed & live, F.lit("nonzero_live_designs")), F.concat(F.lit("design:"), "design")))
    return known.withColumn("stratum", F.explode(names)).drop("_spread", "_pooled")


def scores(rows: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """Errors and rank correlation of each predictor in each stratum."""
    held = strata(rows).select("stratum", "target", *predictors)
    long = scratch.kept(held.unpivot(["stratum", "target"], list(predictors), "predictor", "prediction"), "scores")
    by = ["predictor", "stratum"]
    ranks = metrics.spearman(long, by)
    return metrics.errors(long, by).join(ranks, by, "left")
