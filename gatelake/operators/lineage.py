"""Corpus metadata: log parsing, lineage joins between tiers, imputation and the master report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.functions import names, scalars

#: A line of circuit statistics, and the recipe and step of a file name.
STATS = r"i/o\s*=\s*(\d+)/\s*(\d+).*?(?:and|nd)\s*=\s*(\d+).*?lev\s*=\s*(\d+)"
RECIPE_STEP = r"syn([0-9X]+)_step(\d+)"


def _blocks(logs: DataFrame) -> DataFrame:
    """Every statistics line of a log, as arrays of inputs, outputs, gates and depths."""
    part = lambda i: F.regexp_extract_all("content", F.lit(STATS), F.lit(i))
    return logs.select("*", part(1).alias("pi"), part(2).alias("po"), part(3).alias("gates"), part(4).alias("lev"))


def parse_logs(logs: DataFrame) -> DataFrame:
    """A row a log with at least two statistics lines: the last line's counts and the reductions from the first."""
    blocks = _blocks(logs).where(F.size("gates") >= 2)
    first = lambda c: F.element_at(c, 1).cast("long")
    last = lambda c: F.element_at(c, -1).cast("long")
    source = names.tier2_source(F.col("log_name"), F.col("design"))
    tier = F.col("tier_id").cast("string")
    return blocks.select(
        F.concat(F.lit("base_aigs/"), "design", F.lit("/tier"), tier, F.lit("/"), "algorithm", F.lit("/"), F.replace("log_name", F.lit(".log"), F.lit(".aig"))).alias("file_path"),
        F.when((F.col("tier_id") == 2) & source.isNotNull(), F.concat_ws("_", "design", source)).otherwise(F.col("design")).alias("design"),
        F.coalesce(names.recipe_number(F.regexp_extract("log_name", RECIPE_STEP, 1)), F.lit(0)).alias("recipe_id"),
        F.coalesce(F.nullif(F.regexp_extract("log_name", RECIPE_STEP, 2), F.lit("")).cast("int"), F.lit(0)).alias("step_id"),
        "tier_id",
        "algorithm",
        last("gates").alias("nodes"),
        F.lit(0).cast("long").alias("edges"),
        last("pi").alias("num_pi"),
        last("po").alias("num_po"),
        last("lev").alias("depth"),
        scalars.relative_reduction(first("gates"), last("gates")).alias("optimizability"),
        scalars.relative_reduction(first("lev"), last("lev")).alias("depth_optimizability"),
    )


def tier0_of_logs(logs: DataFrame) -> DataFrame:
    """The tier 0 rows that tier 1 logs show before optimizing, one a file."""
    path = names.tier0_path_of_log(F.col("log_name"), F.col("design"), F.col("algorithm"))
    first = lambda c: F.element_at(c, 1).cast("long")
    rows = _blocks(logs).where((F.col("tier_id") == 1) & (F.size("gates") >= 1)).select(path.alias("file_path"), "design", first("gates").alias("nodes"), first("pi").alias("num_pi"), first("po").alias("num_po"), first("lev").alias("depth"))
    least = F.min(F.struct("nodes", "num_pi", "num_po", "depth")).alias("row")  # which of several logs is taken must not depend on their order
    return rows.where("file_path is not null").groupBy("file_path", "design").agg(least).select("file_path", "design", "row.*")


def impute_edges(master: DataFrame) -> DataFrame:
    return master.withColumn("edges", scalars.imputed_edges(F.col("edges"), F.col("nodes"), F.col("num_po")))


KEYS = ["root_design", "recipe_id", "step_id"]


def _one_a_key(rows: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    """The row with the smallest path of each key."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.col("file_path")).alias("parent")).select(*keys, *[F.col(f"parent.{c}").alias(f"pre_{c}") for c in columns])


def _sample(rows: DataFrame, path, algorithm) -> DataFrame:
    return rows.select(
        path.alias("graph_path"),
        F.col("root_design").alias("design"),
        "recipe_id",
        "step_id",
        "tier_id",
        algorithm.alias("algorithm"),
        "pre_nodes",
        F.col("nodes").alias("post_nodes"),
        "edges",
        "pre_num_pi",
        F.col("num_pi").alias("post_num_pi"),
        "pre_num_po",
        F.col("num_po").alias("post_num_po"),
        "pre_depth",
        F.col("depth").alias("post_depth"),
        "optimizability",
        "depth_optimizability",
    )


STATISTICS = ("nodes", "num_pi", "num_po", "depth")


def tier1_samples(master: DataFrame, root: str = "") -> DataFrame:
    """Tier 1 rows beside the tier 0 circuit that they optimized."""
    parents = _one_a_key(master.where("tier_id = 0"), KEYS, *STATISTICS)
    rows = master.where((F.col("tier_id") == 1) & F.col("algorithm").isin(*names.ALGORITHMS)).join(parents, KEYS)
    path = F.concat_ws("/", F.lit(f"{root}graphs/tier0"), "root_design", F.concat("root_design", F.lit("_"), names.recipe_stem(F.col("recipe_id"), F.col("step_id")), F.lit(".pt")))
    return _sample(rows, path, F.col("algorithm"))


def tier2_samples(master: DataFrame, root: str = "") -> DataFrame:
    """Tier 2 rows beside the tier 1 circuit of their first optimizer; rows whose name tells none go."""
    rows = master.where((F.col("tier_id") == 2) & F.col("algorithm").isin(*names.ALGORITHMS)).withColumn("source", names.tier2_source(names.stem(F.col("file_path")), F.col("root_design")))
    parents = _one_a_key(master.where("tier_id = 1").withColumnRenamed("algorithm", "source"), [*KEYS, "source"], *STATISTICS)
    joined = rows.where("source is not null").join(parents, [*KEYS, "source"])
    stem = F.concat("root_design", F.lit("_"), "source", F.lit("_tier1_"), names.recipe_stem(F.col("recipe_id"), F.col("step_id")), F.lit(".pt"))
    return _sample(joined, F.concat_ws("/", F.lit(f"{root}graphs/tier1"), "source", "root_design", stem), F.col("algorithm"))


def samples(master: DataFrame) -> DataFrame:
    return tier1_samples(master).unionByName(tier2_samples(master))


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work that is not done yet, one row a key."""
    return wanted.join(done.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def per_algorithm(master: DataFrame) -> DataFrame:
    """(set, ..): for each optimizer all tier 0 rows and its own, the membership of the files written by optimizer."""
    algorithms = F.explode(F.array(*map(F.lit, names.ALGORITHMS)))
    return master.where("tier_id = 0").withColumn("set", algorithms).unionByName(master.where(F.col("algorithm").isin(*names.ALGORITHMS)).withColumn("set", F.col("algorithm")))


def steps(master: DataFrame, child: int) -> DataFrame:
    """Children with their parents' nodes and depth (null where the parent is missing) and the changes."""
    if child == 1:
        keys, rows, parents = KEYS, master.where("tier_id = 1"), master.where("tier_id = 0")
    else:
        keys = [*KEYS, "source"]
        rows = master.where("tier_id = 2").withColumn("source", names.tier2_source(names.stem(F.col("file_path")), F.col("root_design")))
        parents = master.where("tier_id = 1").withColumnRenamed("algorithm", "source")
    found = rows.join(_one_a_key(parents, keys, "nodes", "depth"), keys, "left")
    return found.select("root_design", "algorithm", "nodes", "depth", "pre_nodes", "pre_depth", (F.col("nodes") - F.col("pre_nodes")).alias("node_change"), (F.col("depth") - F.col("pre_depth")).alias("depth_change"))


def step_report(master: DataFrame, child: int) -> DataFrame:
    """By optimizer: children, missing parents, and how nodes and depth changed."""
    up = lambda c: F.count_if(F.col(c) > 0)
    return (
        steps(master, child)
        .groupBy("algorithm")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("pre_nodes").isNull()).alias("n_orphans"),
            up("node_change").alias("n_more_nodes"),
            F.count_if(F.col("node_change") == 0).alias("n_same_nodes"),
            F.coalesce(F.sum(F.when(F.col("node_change") > 0, F.col("node_change"))), F.lit(0)).alias("sum_more_nodes"),
            F.max("node_change").alias("max_node_change"),
            up("depth_change").alias("n_more_depth"),
            F.max("depth_change").alias("max_depth_change"),
        )
    )


def deeper_designs(master: DataFrame, child: int) -> DataFrame:
    """The designs that an optimizer made deeper, in order, as one text an optimizer."""
    worse = steps(master, child).where("depth_change > 0")
    return worse.groupBy("algorithm").agg(F.count_distinct("root_design").alias("n_designs"), F.array_join(F.array_sort(F.collect_set("root_design")), ",").alias("designs"))


def shrink_shares(master: DataFrame) -> DataFrame:
    """By tier: share of children with fewer nodes than their parent, and without."""
    both = steps(master, 1).withColumn("tier", F.lit(1)).unionByName(steps(master, 2).withColumn("tier", F.lit(2))).where("pre_nodes is not null")
    counts = both.groupBy("tier").agg(F.count("*").alias("n"), F.count_if(F.col("node_change") < 0).alias("n_shrunk"))
    total = counts.agg(F.lit(0).alias("tier"), F.sum("n").alias("n"), F.sum("n_shrunk").alias("n_shrunk"))
    share = F.round(scalars.percent(F.col("n_shrunk"), F.col("n")), 6)
    return counts.unionByName(total).select("tier", "n", "n_shrunk", share.alias("shrunk_pct"), F.round(scalars.percent(F.col("n") - F.col("n_shrunk"), F.col("n")), 6).alias("other_pct"))


def with_inputs(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows of which the input graph is in a listing of stored paths."""
    return rows.join(listing.select(F.col("path").alias("graph_path")).distinct(), "graph_path", "left_semi")


def unparsed_sources(master: DataFrame) -> DataFrame:
    """One row: tier 2 rows, and those of which the name tells no first optimizer."""
    source = names.tier2_source(names.stem(F.col("file_path")), F.col("design"))
    return master.where("tier_id = 2").agg(F.count("*").alias("n"), F.count_if(source.isNull()).alias("n_unparsed"))


def mismatched_designs(files: DataFrame) -> DataFrame:
    """Files (path, expected) of which the name gives another design than the folder they were looked for in."""
    found = names.artifact(names.basename(F.col("path")))
    return files.withColumn("found", found.design).where((F.col("expected") != "") & ~F.col("expected").eqNullSafe(F.col("found")))


def task_ids(files: DataFrame, *order: str) -> DataFrame:
    """Files numbered from 1 in an explicit order, by ranges of the first column so that no task numbers them all."""
    from pyspark.sql import Window

    first = order[0]
    counts = files.groupBy(first).agg(F.count("*").alias("_n"))
    before = counts.select(first, (F.sum("_n").over(Window.orderBy(first)) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(first).orderBy(*order))
    return files.withColumn("_within", within).join(before, first).withColumn("task_id", F.col("_before") + F.col("_within")).drop("_within", "_before")


def first_of_key(rows: DataFrame, keys: Sequence[str], order: str, *columns: str) -> DataFrame:
    """The first row of each key in the order of a column."""
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.col(order)).alias("_r"))
    return picked.select(*keys, "_r.*")
