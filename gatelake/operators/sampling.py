"""Seeded samples, leak-safe splits and node-budget batch plans."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelake.functions import rng
from gatelake.sources import scratch


def sample(rows: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows by hash order of their key, all if there are no more; ``k`` <= 0 means no limit."""
    if k <= 0:
        return rows
    return rows.withColumn("_u", rng.uniform(seed, key)).orderBy("_u", key).limit(k).drop("_u")


def pool_size(warmup: int, measured: int, times: int = 20) -> int:
    """Candidates to draw so that enough usable ones are among them."""
    return times * (warmup + measured)


def stratified(rows: DataFrame, key: str, size: str, k: int, seed: int, buckets: int = 10) -> DataFrame:
    """``k`` rows over equal-count size buckets: the first buckets get the remainder, a short bucket is topped up.

    Buckets are ranks over the whole table; the two-level rank (counts by size first) keeps it off a single task."""
    n_rows = rows.count()
    if k >= n_rows:
        return rows
    order = _ranked(rows, size, key).withColumn("bucket", _ntile(F.col("_rank"), n_rows, buckets))
    drawn = order.withColumn("_u", rng.uniform(seed, key)).withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("_u", key)))
    quota = F.lit(k // buckets) + F.when(F.col("bucket") < k % buckets, 1).otherwise(0)
    chosen = drawn.where(F.col("r") <= k // buckets + 1).where(F.col("r") <= quota)  # the literal bound lets tasks drop rows before the shuffle
    short = k - sum(min(k // buckets + (b < k % buckets), n_rows // buckets + (b < n_rows % buckets)) for b in range(buckets))
    if short > 0:
        rest = drawn.where(F.col("r") > quota).orderBy("_u", key).limit(short)
        chosen = chosen.unionByName(rest)
    return chosen.select(*rows.columns)


def _ranked(rows: DataFrame, size: str, key: str) -> DataFrame:
    """``_rank`` from 0 in the order of (size, key), by offsets of (size, cell): rows of a common size are dealt over cells
    by ranges of their keys, so no size is ranked in one task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once, since ranges made anew could have other bounds
    ordered = scratch.kept(rows.repartitionByRange(n, size, key).withColumn("_cell", F.spark_partition_id()), "ranks")
    cells = ordered.groupBy("_cell").agg(F.count("*").alias("_n"))
    before = cells.select("_cell", (F.sum("_n").over(Window.orderBy("_cell")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_cell").orderBy(size, key)) - 1
    return ordered.withColumn("_within", within).join(before, "_cell").withColumn("_rank", F.col("_before") + F.col("_within")).drop("_before", "_within", "_cell")


def _ntile(rank: Column, n: int, buckets: int) -> Column:
    """Bucket of a rank from 0 where the first n % buckets buckets hold one more."""
    small, more = divmod(n, buckets)
    edge = more * (small + 1)
    return F.when(rank < edge, F.floor(rank / F.lit(small + 1))).otherwise(F.lit(more) + F.floor((rank - edge) / F.lit(max(1, small)))).cast("int")


def size_buckets(rows: DataFrame, size: str, key: str, buckets: int = 10) -> DataFrame:
    return _ranked(rows, size, key).withColumn("bucket", _ntile(F.col("_rank"), rows.count(), buckets)).drop("_rank")


def grouped_split(rows: DataFrame, group: Column, path: str, seed: int, ratios: Sequence[float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """(path, split): whole groups go to train, val or test in hash order. Counts are cut down to whole groups, one at
    least is train and the rest is test; all rows of a path follow its group."""
    fractions = [r / sum(ratios) for r in ratios]
    paths = rows.select(F.col(path).alias("path"), group.alias("group")).groupBy("path").agg(F.min("group").alias("group"))
    groups = paths.select("group").distinct()
    n = groups.count()
    n_train, n_val = max(1, int(n * fractions[0])), int(n * fractions[1])
    rank = _hash_rank(groups.withColumn("_u", rng.uniform(seed, "group")))
    split = F.when(F.col("_rank") < n_train, "train").when(F.col("_rank") < n_train + n_val, "val").otherwise("test")
    return paths.join(rank.select("group", split.alias("split")), "group").select("path", "split")


def _hash_rank(groups: DataFrame) -> DataFrame:
    """``_rank`` of each group in the order of its hash, by 4096 equal ranges of the hash."""
    cells = groups.withColumn("_cell", F.floor(F.col("_u") * 4096).cast("int"))
    counts = cells.groupBy("_cell").agg(F.count("*").alias("_n"))
    before = counts.select("_cell", (F.sum("_n").over(Window.orderBy("_cell")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_cell").orderBy("_u", "group")) - 1
    return cells.withColumn("_within", within).join(before, "_cell").withColumn("_rank", F.col("_before") + F.col("_within"))


def members(rows: DataFrame, path: str, splits: DataFrame, split: str) -> DataFrame:
    """Rows of which the path is in a split."""
    return rows.join(splits.where(F.col("split") == split).select(F.col("path").alias(path)), path, "left_semi")


def held_out(rows: DataFrame, path: str, used: DataFrame) -> DataFrame:
    """Rows of which the path was not used for tuning."""
    return rows.join(used.select(F.col("path").alias(path)), path, "left_anti")


def assigned(rows: DataFrame, path: str, splits: DataFrame) -> DataFrame:
    """Rows with their split; rows without one keep a null, for the caller to count and drop."""
    return rows.join(splits.select(F.col("path").alias(path), "split"), path, "left")


def overlap(splits: DataFrame, a: str, b: str) -> DataFrame:
    """Paths that are in two splits, which must be none."""
    return splits.where(F.col("split") == a).select("path").intersect(splits.where(F.col("split") == b).select("path"))


def tuning_pools(rows: DataFrame, path: str, seed: int, sizes: Sequence[int]) -> DataFrame:
    """(path, pool): consecutive pools of distinct paths in hash order, each split 80/20 into train and val."""
    ranked = _hash_rank(rows.select(F.col(path).alias("group")).distinct().withColumn("_u", rng.uniform(seed, "group")))
    pool, start = None, 0
    for i, size in enumerate(sizes):
        at = F.col("_rank") - start
        name = F.when(at < int(size * 0.8), f"pool{i}:train").otherwise(f"pool{i}:val")
        within = (F.col("_rank") >= start) & (F.col("_rank") < start + size)
        pool = F.when(within, name) if pool is None else pool.when(within, name)
        start += size
    return ranked.select(F.col("group").alias("path"), pool.alias("pool")).where("pool is not null")


def plan(sizes: np.ndarray, budget: int) -> np.ndarray:
    """Batches of graphs given in ascending order of size: each takes the largest graph left and then as many of the smallest
    ones as fit the budget with it.

    So batch b leads with the b-th largest graph, and the small ones that it takes are the next run from the front. With
    prefix sums, the end of that run is one binary search. Returns the end of each batch's run."""
    sums = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    ends, front, back = [], 0, len(sizes)
    while front < back:
        back -= 1
        room = max(1, budget) - int(sizes[back])
        if room >= 0:
            front = min(back, int(np.searchsorted(sums, sums[front] + room, "right")) - 1)
        ends.append(front)
    return np.array(ends, np.int64)


def batch_plan(graphs: DataFrame, key: str, size: str, budget: int) -> DataFrame:
    """(batch_id, pos, idx, key, size): the plan over graphs in the order of (size, key).

    Which graphs share a batch depends on sizes alone. Graphs are counted by size, the counts (a row a size) make the plan,
    and each graph then finds its batch from its rank: the graphs themselves are ranked by size and range, in no single task."""
    ranked = _ranked(graphs.select(F.col(key).alias("_key"), F.col(size).cast("long").alias("_size")), "_size", "_key")
    counts = graphs.groupBy(F.col(size).cast("long").alias("_size")).agg(F.count("*").alias("_n"))

    def run(frames):
        frame = pd.concat(list(frames)).sort_values("_size")
        sizes = np.repeat(frame["_size"].to_numpy(np.int64), frame["_n"].to_numpy())
        ends = plan(sizes, budget)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        batches = np.arange(len(ends))
        yield pd.DataFrame({"batch_id": batches, "_first": starts, "_end": ends, "_lead": len(sizes) - 1 - batches})

    batches = counts.repartition(1).mapInPandas(run, "batch_id long, _first long, _end long, _lead long")
    members = batches.select("batch_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_end") - F.col("_first"))).alias("pos"), F.when(F.col("pos") == 0, F.col("_lead")).otherwise(F.col("_first") + F.col("pos") - 1).alias("idx"))
    return members.join(ranked, F.col("idx") == F.col("_rank")).select("batch_id", "pos", "idx", F.col("_key").alias(key), F.col("_size").alias(size))


def emitted(batches: DataFrame) -> DataFrame:
    """(batch_id, pos, .., at): the order in which items of batches come out. A batch whose places have gaps, as if it had
    been shuffled or cut, is an error."""
    sizes = batches.groupBy("batch_id").agg(F.count("*").alias("n"), F.max("pos").alias("_last"))
    whole = sizes.select("batch_id", F.when(F.col("_last") == F.col("n") - 1, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("places have gaps in batch "), F.col("batch_id").cast("string"))).cast("long")).alias("n"))
    start = offsets(whole.withColumn("_all", F.lit(0)), "_all", "batch_id", "n").select("batch_id", "offset")
    return batches.join(start, "batch_id").withColumn("at", F.col("offset") + F.col("pos")).drop("offset")


def shuffled(batches: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Batches with their place in an epoch's order."""
    ids = batches.select("batch_id").distinct().withColumn("_u", rng.uniform(seed + epoch, "batch_id")).withColumnRenamed("batch_id", "group")
    return _hash_rank(ids).select(F.col("group").alias("batch_id"), F.col("_rank").alias("at"))


def offsets(graphs: DataFrame, batch: str, order: str, count: str) -> DataFrame:
    """Graphs with the number of items before them in their batch."""
    w = Window.partitionBy(batch).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return graphs.withColumn("offset", F.coalesce(F.sum(count).over(w), F.lit(0)))


def guard(rows: DataFrame, tokens: str, cap: float) -> DataFrame:
    """The first graph of each batch at which its running total of tokens is over the cap."""
    running = rows.withColumn("total", F.sum(tokens).over(Window.partitionBy("batch_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    return running.where(F.col("total") > cap).groupBy("batch_id").agg(F.min("pos").alias("pos"), F.min("total").alias("total"))


def exclusions(*documents: DataFrame) -> DataFrame:
    """Distinct paths of several splits documents, in order of the document, then of the path."""
    out = None
    for i, df in enumerate(documents):
        part = df.select("path", F.lit(i).alias("document"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("path").agg(F.min("document").alias("document"))


def same_meta(held: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """(field, held, wanted) of what differs between a splits document's record and the wanted one; empty: reuse it."""
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), F.lit(v).alias("wanted")) for k, v in wanted.items()])
    long = held.select(F.col("meta"), F.explode(pairs).alias("p"))
    return long.select("p.field", F.col("meta")[F.col("p.field")].alias("held"), "p.wanted").where(~F.col("held").eqNullSafe(F.col("wanted")))
