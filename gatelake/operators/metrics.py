"""Scores of predictions: errors, rank correlation, bootstrap intervals and signed-rank tests.

NaN marks an undefined value in inputs; it becomes null before it is aggregated, and an undefined score is null."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelake.sources import scratch

BETA = 0.01


def known(x: Column | str) -> Column:
    """A number, null for NaN."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(c), c)


def _flat(x: Column, digits: int = 8) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def errors(rows: DataFrame, by: Sequence[str], target: str = "target", prediction: str = "prediction") -> DataFrame:
    """n, mae, rmse, r2 and smooth_l1 by group; r2 is against the group's own mean, null where targets don't vary."""
    d = F.col(prediction) - F.col(target)
    smooth = F.when(F.abs(d) < BETA, 0.5 * d * d / BETA).otherwise(F.abs(d) - 0.5 * BETA)
    total = F.var_pop(target) * F.count("*")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        _flat(F.avg(F.abs(d))).alias("mae"),
        _flat(F.sqrt(F.avg(d * d))).alias("rmse"),
        _flat(F.when(total > 1e-15, 1 - F.sum(d * d) / total)).alias("r2"),
        _flat(F.avg(smooth)).alias("smooth_l1"),
    )


def _ranks(counts: DataFrame, by: Sequence[str], value: str, name: str, *also: str) -> DataFrame:
    """(by, value, name, also): midranks from counts ``_n`` of the distinct values. Values are dealt in ranges, which are written
    once, and each range adds the counts of those before it, so no group is sorted in one task."""
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.kept(counts.repartitionByRange(n, *by, value).withColumn("_cell", F.spark_partition_id()), "ranges")
    cells = dealt.groupBy(*by, "_cell").agg(F.sum("_n").alias("_m"))
    before = cells.select(*by, "_cell", (F.sum("_m").over(Window.partitionBy(*by).orderBy("_cell")) - F.col("_m")).alias("_before"))
    below = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_cell").orderBy(value)) - F.col("_n")
    return dealt.join(before, [*by, "_cell"]).select(*by, value, (below + (F.col("_n") + 1) / 2).alias(name), *also)


def midranks(rows: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Rows with the rank of a value in its group; equal values share the mean of their places.

    Ranks come from counts of the distinct values, so a group is sorted by value and not by row."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    return rows.join(_ranks(counts, by, value, name), [*by, value])


def spearman(rows: DataFrame, by: Sequence[str], target: str = "target", prediction: str = "prediction") -> DataFrame:
    """Correlation of midranks by group, null for one row or a constant side."""
    pairs = rows.groupBy(*by, target, prediction).agg(F.count("*").alias("w"))
    ranked = lambda value, name: _ranks(pairs.groupBy(*by, value).agg(F.sum("w").alias("_n")), by, value, name)
    held = pairs.join(ranked(target, "rt"), [*by, target]).join(ranked(prediction, "rp"), [*by, prediction])
    return weighted_pearson(held, by, "rt", "rp", "w").withColumnRenamed("pearson", "spearman")


def weighted_pearson(rows: DataFrame, by: Sequence[str], x: str, y: str, w: str) -> DataFrame:
    """Correlation with row weights by group; null where a side does not vary."""
    c = F.col
    n = F.sum(w)
    means = rows.groupBy(*by).agg((F.sum(c(w) * c(x)) / n).alias("_mx"), (F.sum(c(w) * c(y)) / n).alias("_my"))
    d = rows.join(means, list(by))
    dx, dy = c(x) - c("_mx"), c(y) - c("_my")
    sums = d.groupBy(*by).agg(F.sum(c(w) * dx * dy).alias("_xy"), F.sum(c(w) * dx * dx).alias("_xx"), F.sum(c(w) * dy * dy).alias("_yy"))
    varies = (c("_xx") > 1e-12) & (c("_yy") > 1e-12)
    return sums.select(*by, _flat(F.when(varies, c("_xy") / F.sqrt(c("_xx") * c("_yy")))).alias("pearson"))


def resampled(rows: DataFrame, times: int, seed: int, key: str) -> DataFrame:
    """Rows once for each resample ``b`` that draws them, with the weight ``w``: a Poisson(1) draw, up to 7, from a hash of
    seed, resample and key. The hash is a column of its own, so that it is taken once a row and resample."""
    drawn = rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(times))))
    drawn = drawn.withColumn("_u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "b", key), 11) / F.lit(float(1 << 53)))
    total, weight = 0.0, F.lit(0)
    for k in range(7):
        total += math.exp(-1) / math.factorial(k)
        weight = weight + F.when(F.col("_u") >= total, 1).otherwise(0)
    return drawn.withColumn("w", weight).where("w > 0")


def bootstrap(rows: DataFrame, by: Sequence[str], key: str, target: str = "target", prediction: str = "prediction", times: int = 200, seed: int = 0) -> DataFrame:
    """(by, metric, low, high): 95 % percentile intervals of mae, rmse and r2.

    Each resample weighs every row by a Poisson draw, and is summed within a task before the shuffle, so that a task sends
    one row a resample and group."""
    d = F.col(prediction) - F.col(target)
    drawn = resampled(rows.select(*by, F.col(target).alias("_y"), d.alias("_d"), F.col(key).alias("_k")), times, seed, "_k")
    sums = drawn.groupBy(*by, "b").agg(F.sum("w").alias("n"), F.sum(F.expr("w * abs(_d)")).alias("a"), F.sum(F.expr("w * _d * _d")).alias("s"), F.sum(F.expr("w * _y")).alias("y"), F.sum(F.expr("w * _y * _y")).alias("yy"))
    total = F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    each = sums.select(*by, (F.col("a") / F.col("n")).alias("mae"), F.sqrt(F.col("s") / F.col("n")).alias("rmse"), F.when(total > 1e-15, 1 - F.col("s") / total).alias("r2"))
    long = each.unpivot(list(by), ["mae", "rmse", "r2"], "metric", "value")
    return _interval(long.where("value is not null"), [*by, "metric"])


def _interval(long: DataFrame, by: Sequence[str]) -> DataFrame:
    ends = long.groupBy(*by).agg(F.percentile("value", F.array(F.lit(0.025), F.lit(0.975))).alias("e"))
    return ends.select(*by, _flat(F.col("e")[0]).alias("low"), _flat(F.col("e")[1]).alias("high"))


def mean_interval(rows: DataFrame, by: Sequence[str], key: str, value: str, times: int = 2000, seed: int = 0) -> DataFrame:
    """95 % percentile interval of a mean by group; null for fewer than two rows."""
    drawn = resampled(rows.select(*by, F.col(value).alias("_v"), F.col(key).alias("_k")), times, seed, "_k")
    each = drawn.groupBy(*by, "b").agg((F.sum(F.expr("w * _v")) / F.sum("w")).alias("value"))
    enough = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    out = enough.join(_interval(each, by), list(by), "left")
    keep = lambda c: F.when(F.col("_n") >= 2, F.col(c)).alias(c)
    return out.select(*by, keep("low"), keep("high"))


def _shifted(x: Column, places: Column) -> Column:
    """x times 2 to ``places``, in two steps, since the power alone may be beyond a double."""
    half = F.floor(places / 2)
    return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), places - half)


def exact_means(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(by, columns): means by group of numbers that are not null, which depend on no order of rows or tasks.

    A sum of doubles is rounded at every step, so copies of a group get means that differ in their last bits, are no ties any
    more, and aren't found again by a second pass. Here numbers of like size (8 binary places) are summed as integers, without
    rounding and partially before the shuffle; a group then adds at most 270 such sums, the smallest numbers first. NaN and
    infinite numbers are summed beside them, as for them order does not matter."""
    x = F.col("_x")
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    #: Next to a power of two the logarithm may fall on its other side; a scaled number is whole and below 2**63 either way.
    size = F.when(finite & (x != 0), F.floor(F.log2(F.abs(x)) / 8).cast("int")).otherwise(0)
    long = rows.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(by), list(columns), "_c", "_x").withColumn("_size", size)
    whole = F.when(finite, _shifted(x, 54 - 8 * F.col("_size"))).cast("long").cast("decimal(28,0)")
    sums = long.groupBy(*by, "_c", "_size").agg(F.sum(whole).alias("_whole"), F.sum(F.when(~finite, x)).alias("_other"), F.count("_x").alias("_n"))

    def mean(c: str) -> Column:
        here = F.col("_c") == c
        parts = F.array_sort(F.collect_list(F.when(here & F.col("_whole").isNotNull(), F.struct("_size", "_whole"))))
        total = F.aggregate(parts, F.lit(0.0), lambda t, p: t + _shifted(p["_whole"].cast("double"), 8 * p["_size"] - 54))
        n = F.sum(F.when(here, F.col("_n")))
        return F.when(n > 0, (total + F.coalesce(F.sum(F.when(here, F.col("_other"))), F.lit(0.0))) / n).alias(c)

    return sums.groupBy(*by).agg(*map(mean, columns))


def signed_ranks(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """By group of differences: n without zeros, sum of positive ranks, and the sum of t**3 - t over ties."""
    held = rows.where(F.col(value) != 0).groupBy(*by, F.abs(value).alias("_a")).agg(F.count("*").alias("_n"), F.count_if(F.col(value) > 0).alias("_up"))
    ranked = _ranks(held, by, "_a", "_r", "_n", "_up")
    return ranked.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(F.col("_up") * F.col("_r")).alias("w_plus"), F.sum(F.expr("_n * _n * _n - _n")).alias("ties"))


def wilcoxon(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Two-sided p by group from the normal approximation with ties; null for under 10 rows or equal differences."""
    ranks = signed_ranks(rows, by, value)
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = F.abs(F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(variance)
    size = rows.groupBy(*by).agg(F.count("*").alias("rows"), (F.max(value) - F.min(value)).alias("spread"))
    out = size.join(ranks.select(*by, (2 * (1 - normal_cdf(z))).alias("p")), list(by), "left")
    return out.select(*by, _flat(F.when((F.col("rows") >= 10) & (F.col("spread") > 1e-12), F.col("p"))).alias("p"))


def normal_cdf(z: Column) -> Column:
    """Distribution function of the normal law for z >= 0, to 1e-7 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    #: The coefficients of that approximation.
    series = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    poly = sum((F.lit(c) * F.pow(t, F.lit(i)) for i, c in enumerate(series[1:], 2)), F.lit(series[0]) * t)
    return 1 - F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def undefined_safe(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, maximum and 95th percentile of what is defined."""
    v = known(value)
    return rows.groupBy(*by).agg(_flat(F.avg(v)).alias("mean"), _flat(F.max(v)).alias("max"), _flat(F.percentile(v, F.lit(0.95))).alias("p95"), F.count_if(v.isNull()).alias("n_undefined"))


def benchmark(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Step times, throughput and memory of a run."""
    time = F.sum("step_time_s")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        _flat(F.avg("step_time_s")).alias("mean_time"),
        _flat(F.stddev_pop("step_time_s")).alias("std_time"),
        _flat(F.when(time > 0, F.count("*") / time)).alias("graphs_per_s"),
        _flat(F.avg("vram_mb"), 4).alias("mean_vram"),
        _flat(F.max("vram_mb"), 4).alias("max_vram"),
        _flat(F.percentile("vram_mb", F.lit(0.95)), 4).alias("p95_vram"),
        _flat(F.avg(known("reserved_mb")), 4).alias("mean_reserved"),
        _flat(F.avg("num_nodes"), 4).alias("mean_nodes"),
    )


def repeats(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Median and population deviation of repeated measurements."""
    return rows.groupBy(*by).agg(_flat(F.median("step_time_s")).alias("median_time"), _flat(F.stddev_pop("step_time_s")).alias("std_time"), F.count("*").alias("n"))


def weighted_mean(rows: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    return rows.groupBy(*by).agg(_flat(F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))
