"""Checks and counts over the master table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelake.functions import names


def composition(master: DataFrame) -> DataFrame:
    """Rows by tier, by algorithm, by both and by design and tier, in one pass; ``part`` names the grouping."""
    named = master.select(F.col("tier_id").alias("tier"), "algorithm", "root_design")
    sets = named.groupingSets([["tier"], ["algorithm"], ["tier", "algorithm"], ["tier", "root_design"]], "tier", "algorithm", "root_design")
    counts = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    part = F.when(F.col("g") == 3, "tier").when(F.col("g") == 5, "algorithm").when(F.col("g") == 1, "tier x algorithm").otherwise("design x tier")
    return counts.select(part.alias("part"), "tier", "algorithm", "root_design", "n")


def completeness(rows: DataFrame) -> DataFrame:
    """(name, filled): values of each column that are neither null nor blank."""
    counts = rows.agg(*[F.count_if(F.trim(F.col(c).cast("string")) != "").alias(c) for c in rows.columns])
    return counts.unpivot([], rows.columns, "name", "filled")


def tier_means(master: DataFrame) -> DataFrame:
    return master.groupBy("tier_id").agg(F.round(F.avg("nodes"), 6).alias("mean_nodes"), F.round(F.avg("depth"), 6).alias("mean_depth"))


def label_ranges(master: DataFrame) -> DataFrame:
    """By tier and optimizer: ranges of both labels, and counts of unchanged, better and worse depth."""
    return master.where("tier_id > 0").groupBy("tier_id", "algorithm").agg(
        F.min("optimizability").alias("min_opt"),
        F.max("optimizability").alias("max_opt"),
        F.min("depth_optimizability").alias("min_depth_opt"),
        F.max("depth_optimizability").alias("max_depth_opt"),
        F.count_if(F.abs("optimizability") <= 1e-12).alias("n_zero"),
        F.count_if(F.abs("depth_optimizability") > 1e-12).alias("n_depth_changed"),
        F.count_if(F.col("depth_optimizability") > 1e-12).alias("n_depth_better"),
        F.count_if(F.col("depth_optimizability") < -1e-12).alias("n_depth_worse"),
        F.count_if((F.abs("optimizability") <= 1e-12) & (F.col("depth_optimizability") > 0)).alias("n_depth_only"),
    )


def largest(master: DataFrame) -> DataFrame:
    """The rows with most nodes and with most depth of each tier; the smallest path wins a tie."""
    pick = lambda c: F.min_by(F.struct("file_path", F.col(c).alias("value")), F.struct((-F.col(c)).alias("a"), F.col("file_path").alias("b")))
    found = master.where("nodes is not null and depth is not null").groupBy("tier_id").agg(pick("nodes").alias("nodes"), pick("depth").alias("depth"))
    return found.select("tier_id", F.expr("stack(2, 'nodes', nodes, 'depth', depth) as (what, r)")).select("tier_id", "what", "r.file_path", "r.value")


def length_consistency(master: DataFrame) -> DataFrame:
    """By tier: fewest and most rows of an optimizer, their difference, and that in percent of the fewest."""
    counts = master.where("tier_id > 0").groupBy("tier_id", "algorithm").agg(F.count("*").alias("n"))
    out = counts.groupBy("tier_id").agg(F.min("n").alias("fewest"), F.max("n").alias("most"), F.min_by("algorithm", F.struct("n", "algorithm")).alias("fewest_of"), F.min_by("algorithm", F.struct(-F.col("n"), "algorithm")).alias("most_of"))
    return out.withColumn("delta", F.col("most") - F.col("fewest")).withColumn("delta_pct", F.round(100.0 * F.col("delta") / F.col("fewest"), 6))


def invariants(master: DataFrame) -> DataFrame:
    """Broken cardinalities by design: tier 1 is 4 times and tier 2 is 12 times tier 0, and optimizers have equal counts."""
    n = lambda t: F.count_if(F.col("tier_id") == t).alias(f"n{t}")
    base = master.groupBy("root_design").agg(n(0), n(1), n(2), *[F.count_if((F.col("tier_id") == 1) & (F.col("algorithm") == a)).alias(a) for a in names.ALGORITHMS])
    each = [F.col(a) for a in names.ALGORITHMS]
    broken = F.array_compact(
        F.array(
            F.when(F.col("n1") != 4 * F.col("n0"), F.lit("tier1 is not 4 x tier0")),
            F.when(F.col("n2") != 12 * F.col("n0"), F.lit("tier2 is not 12 x tier0")),
            F.when(F.greatest(*each) != F.least(*each), F.lit("tier1 differs by algorithm")),
        )
    )
    return base.select("root_design", "n0", "n1", "n2", F.explode(broken).alias("problem"))


def row_issues(master: DataFrame, keep: int = 20) -> DataFrame:
    """The first ``keep`` rows whose tier and algorithm contradict each other, by path."""
    known = F.col("algorithm").isin(*names.ALGORITHMS)
    issue = (
        F.when(~F.col("tier_id").isin(0, 1, 2), "unknown tier")
        .when((F.col("tier_id") == 0) & (F.col("algorithm") != ""), "tier 0 with an algorithm")
        .when((F.col("tier_id") > 0) & ~known, "no known algorithm")
        .when(F.col("depth").isNull(), "no depth")
    )
    return master.withColumn("issue", issue).where("issue is not null").select("file_path", "tier_id", "algorithm", "issue").orderBy("file_path").limit(keep)


def valid_numbers(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of which the columns parse as finite numbers."""
    for c in columns:
        value = F.col(c).cast("string").try_cast("double")
        rows = rows.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    return rows


def archive_gaps(master: DataFrame) -> DataFrame:
    """Designs that lack tier 0 or the tier 1 rows of an optimizer."""
    have = master.groupBy("root_design").agg(F.count_if(F.col("tier_id") == 0).alias("n0"), F.collect_set(F.when(F.col("tier_id") == 1, F.col("algorithm"))).alias("have"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, names.ALGORITHMS)), "have"))
    return have.select("root_design", (F.col("n0") > 0).alias("has_tier0"), F.array_join(missing, ",").alias("missing"))


def column_spread(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Each row's group deviation beside it."""
    return rows.withColumn("spread", F.stddev_samp(value).over(Window.partitionBy(key)))


def master_report(master: DataFrame) -> DataFrame:
    """The report on a master table as (section, item, metric, value), for a reader or a check to pick from."""
    from gatelake.operators import lineage

    def long(df: DataFrame, section: str, item, metrics: list[str]) -> DataFrame:
        held = df.select(item.cast("string").alias("item"), *[F.col(m).cast("double").alias(m) for m in metrics])
        return held.unpivot(["item"], metrics, "metric", "value").select(F.lit(section).alias("section"), "item", "metric", F.round("value", 6).alias("value"))

    steps = ["n", "n_orphans", "n_more_nodes", "n_same_nodes", "n_more_depth"]
    parts = [
        long(composition(master).withColumn("item", F.concat_ws("|", "part", "tier", "algorithm", "root_design")), "rows", F.col("item"), ["n"]),
        long(tier_means(master), "means", F.col("tier_id"), ["mean_nodes", "mean_depth"]),
        long(label_ranges(master).withColumn("item", F.concat_ws("|", "tier_id", "algorithm")), "labels", F.col("item"), ["min_opt", "max_opt", "n_zero", "n_depth_worse"]),
        long(lineage.step_report(master, 1), "tier1", F.col("algorithm"), steps),
        long(lineage.step_report(master, 2), "tier2", F.col("algorithm"), steps),
        long(invariants(master).groupBy("problem").agg(F.count("*").alias("n")), "invariants", F.col("problem"), ["n"]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def depth_only(master: DataFrame, epsilon: float = 1e-12) -> DataFrame:
    """Rows that lost depth and no nodes."""
    return master.where((F.abs("optimizability") <= epsilon) & (F.col("depth_optimizability") > 0))


def accounting(discovered: DataFrame, saved: DataFrame, skipped: DataFrame, by: str, key: str) -> DataFrame:
    """By group: items discovered, saved and skipped, and whether each discovered one is one of the others."""
    n = lambda df, name: df.select(by, key).distinct().groupBy(by).agg(F.count("*").alias(name))
    out = n(discovered, "discovered").join(n(saved, "saved"), by, "left").join(n(skipped, "skipped"), by, "left").na.fill(0, ["saved", "skipped"])
    return out.withColumn("completed", F.col("saved") + F.col("skipped")).withColumn("complete", F.col("discovered") == F.col("completed"))
