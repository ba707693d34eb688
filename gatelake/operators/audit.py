"""Reconciliation of artifact stores: canonical keys, set algebra, coverage and rename plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelake.functions import names, scalars

KEY = ["tier", "design", "src", "dst", "recipe", "step"]


def parse_stores(stores: DataFrame) -> DataFrame:
    """(store, path, key fields, state) of every stored path."""
    key = F.when(F.col("store") == "pt", names.artifact_of_graph_path(F.col("path"))).otherwise(names.artifact_of_csv_path(F.col("path")))
    return stores.select("store", "path", F.inline(F.array(key)))  # a generator, so that names are parsed once whatever reads the fields


def keys_of(parsed: DataFrame, store: str, clean_only: bool = False) -> DataFrame:
    """Distinct canonical keys of a store."""
    rows = parsed.where((F.col("store") == store) & (F.col("tier") >= 0))
    return (rows.where("state = 'clean'") if clean_only else rows).select(*KEY).distinct()


def set_report(parsed: DataFrame, clean_only: bool = False) -> DataFrame:
    """(tier, perfect, missing_pt, ghosts, orphans, unlisted): set algebra of the three stores by tier.

    One aggregate over the union of the stores' keys says for each key where it is; the sets are counts of that."""
    rows = parsed.where("tier >= 0")
    rows = rows.where("state = 'clean'") if clean_only else rows
    has = lambda s: F.max((F.col("store") == s).cast("int")).alias(s)
    where = rows.groupBy(*KEY).agg(has("aig"), has("pt"), has("csv"))
    n = lambda condition, name: F.count_if(F.expr(condition)).alias(name)
    return where.groupBy("tier").agg(
        n("aig = 1 and pt = 1 and csv = 1", "perfect"),
        n("aig = 1 and csv = 1 and pt = 0", "missing_pt"),
        n("csv = 1 and aig = 0", "csv_ghosts"),
        n("pt = 1 and aig = 0", "pt_orphans"),
        n("aig = 1 and csv = 0", "aig_unlisted"),
    )


def perfect(parsed: DataFrame) -> DataFrame:
    return keys_of(parsed, "aig").intersect(keys_of(parsed, "pt")).intersect(keys_of(parsed, "csv"))


def missing_graphs(parsed: DataFrame) -> DataFrame:
    return keys_of(parsed, "aig").intersect(keys_of(parsed, "csv")).subtract(keys_of(parsed, "pt"))


def difference(parsed: DataFrame, a: str, b: str) -> DataFrame:
    return keys_of(parsed, a).subtract(keys_of(parsed, b))


def tier2_links(parsed: DataFrame) -> DataFrame:
    """By store: tier 1 keys that tier 2 stands on, how many of them are there, and how many are not."""
    needed = parsed.where("tier = 2").select("store", "design", "src", "recipe", "step").distinct()
    there = parsed.where("tier = 1").select("store", "design", F.col("dst").alias("src"), "recipe", "step", F.lit(1).alias("there")).distinct()
    return needed.join(there, ["store", "design", "src", "recipe", "step"], "left").groupBy("store").agg(F.count("*").alias("needed"), F.count("there").alias("linked"), F.count_if(F.col("there").isNull()).alias("broken"))


def cleanup_preview(parsed: DataFrame) -> DataFrame:
    """(tier, metric, strict, simulated, delta): the set report on clean names only, and as if all were cleaned."""
    metrics = ["perfect", "missing_pt", "csv_ghosts", "pt_orphans", "aig_unlisted"]
    long = lambda df, name: df.unpivot(["tier"], metrics, "metric", name)
    strict, simulated = long(set_report(parsed, True), "strict"), long(set_report(parsed), "simulated")
    both = simulated.join(strict, ["tier", "metric"], "left").withColumn("strict", F.coalesce("strict", F.lit(0)))
    return both.select("tier", "metric", "strict", "simulated", (F.col("simulated") - F.col("strict")).alias("delta"))


def naming_states(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("store", "tier", "state").agg(F.count("*").alias("n"))


def store_diagnostics(parsed: DataFrame) -> DataFrame:
    """By store: members of each tier, and those not recognized."""
    n = lambda t, name: F.count_if(F.col("tier") == t).alias(name)
    return parsed.groupBy("store").agg(n(0, "tier0"), n(1, "tier1"), n(2, "tier2"), n(-1, "unrecognized"), F.count_if(F.col("state") == "messy").alias("messy"))


def expected_keys(parsed: DataFrame, tier: int) -> DataFrame:
    """Tier 1 keys from tier 0 and every optimizer, or tier 2 keys from tier 1 and every other optimizer."""
    algorithms = F.explode(F.array(*map(F.lit, names.ALGORITHMS)))
    base = keys_of(parsed, "aig").where(F.col("tier") == tier - 1)
    if tier == 1:
        return base.select("design", F.lit(None).cast("string").alias("src"), algorithms.alias("dst"), "recipe", "step")
    return base.select("design", F.col("dst").alias("src"), algorithms.alias("dst"), "recipe", "step").where("dst != src")


def generation_gaps(parsed: DataFrame, tier: int) -> DataFrame:
    """Expected keys that no circuit has."""
    have = keys_of(parsed, "aig").where(F.col("tier") == tier).drop("tier")
    want = expected_keys(parsed, tier)
    same = [want[c].eqNullSafe(have[c]) for c in KEY[1:]]
    return want.join(have, same, "left_anti")


def gap_rollups(gaps: DataFrame) -> DataFrame:
    """Gaps by design, optimizer, recipe, step and design with optimizer, in one pass."""
    sets = [["design"], ["algorithm"], ["recipe"], ["step"], ["design", "algorithm"]]
    rows = gaps.select("design", F.col("dst").alias("algorithm"), "recipe", "step")
    counts = rows.groupingSets(sets, "design", "algorithm", "recipe", "step").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    part = F.when(F.col("g") == 7, "design").when(F.col("g") == 11, "algorithm").when(F.col("g") == 13, "recipe").when(F.col("g") == 14, "step").otherwise("design x algorithm")
    return counts.select(part.alias("part"), F.concat_ws("|", "design", "algorithm", "recipe", "step").alias("item"), "n")


def coverage(parsed: DataFrame, tier: int) -> DataFrame:
    """By design: expected, found and missing keys and the covered percentage."""
    want = expected_keys(parsed, tier)
    have = keys_of(parsed, "aig").where(F.col("tier") == tier).select(*[F.col(c).alias("_" + c) for c in KEY[1:]])
    both = want.join(have, [want[c].eqNullSafe(have["_" + c]) for c in KEY[1:]], "left")
    counts = both.groupBy("design").agg(F.count("*").alias("expected"), F.count("_recipe").alias("found"))
    return counts.select("design", "expected", "found", (F.col("expected") - F.col("found")).alias("missing"), F.round(scalars.percent(F.col("found"), F.col("expected")), 6).alias("coverage_pct"))


def lowest_coverage(covered: DataFrame, k: int) -> DataFrame:
    """The ``k`` designs that are covered least; more missing keys first, then by name."""
    return covered.orderBy("coverage_pct", F.desc("missing"), "design").limit(k)


def examples(rows: DataFrame, group: Column, value: Column, k: int) -> DataFrame:
    """The first ``k`` values of each group, in order, as one text."""
    ranked = rows.select(group.alias("bucket"), value.alias("value")).withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("value"))).where(F.col("r") <= k)
    return ranked.groupBy("bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x.value), ";").alias("examples"))


def most_common(rows: DataFrame, item: Column, k: int) -> DataFrame:
    """The ``k`` most frequent items; ties by the item."""
    return rows.groupBy(item.alias("item")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(k)


def rename_plan(parsed: DataFrame, store: str) -> DataFrame:
    """(path, canonical_id, suggested): messy names of a store and the paths that they should have."""
    key = F.struct(*KEY)
    messy = parsed.where((F.col("store") == store) & (F.col("state") == "messy")).withColumn("key", key)
    suggested = names.replace_basename(F.col("path"), names.clean_basename(F.col("key"), ".pt" if store == "pt" else ".aig"))
    return messy.select("path", names.canonical_id(F.col("key")).alias("canonical_id"), suggested.alias("suggested")).where("path != suggested")


def rename_status(plan: DataFrame, there: DataFrame) -> DataFrame:
    """What applying a plan would do by which of the two paths exist: rename, already, skip or missing."""
    old = there.select(F.col("path"), F.lit(True).alias("has_old"))
    new = there.select(F.col("path").alias("suggested"), F.lit(True).alias("has_new"))
    both = plan.join(old, "path", "left").join(new, "suggested", "left")
    a, b = F.coalesce("has_old", F.lit(False)), F.coalesce("has_new", F.lit(False))
    return both.withColumn("status", F.when(a & ~b, "rename").when(~a & b, "already").when(a & b, "skip").otherwise("missing"))


def mapped(rows: DataFrame, plan: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with planned renames applied to path columns."""
    for c in columns:
        change = plan.select(F.col("path").alias("_old"), F.col("suggested").alias("_new")).dropDuplicates(["_old"])
        rows = rows.join(change, F.col(c) == F.col("_old"), "left").withColumn(c, F.coalesce("_new", c)).drop("_old", "_new")
    return rows


def done_keys(done: DataFrame, n_algorithms: int) -> DataFrame:
    """Graphs that every algorithm has processed."""
    return done.groupBy("graph_id").agg(F.count_distinct("algo").alias("n")).where(F.col("n") == n_algorithms).select("graph_id")


def reconciliation(parsed: DataFrame) -> DataFrame:
    """The audit's summary as (section, item, metric, value)."""

    def long(df: DataFrame, section: str, item: Column, metrics: list[str]) -> DataFrame:
        held = df.select(item.cast("string").alias("item"), *[F.col(m).cast("long").alias(m) for m in metrics])
        return held.unpivot(["item"], metrics, "metric", "value").select(F.lit(section).alias("section"), "item", "metric", "value")

    sets = long(set_report(parsed), "sets", F.col("tier"), ["perfect", "missing_pt", "csv_ghosts", "pt_orphans", "aig_unlisted"])
    stores = long(store_diagnostics(parsed), "stores", F.col("store"), ["tier0", "tier1", "tier2", "unrecognized", "messy"])
    links = long(tier2_links(parsed), "links", F.col("store"), ["needed", "linked", "broken"])
    gaps = long(generation_gaps(parsed, 2).groupBy("dst").agg(F.count("*").alias("missing")), "gaps", F.col("dst"), ["missing"])
    return sets.unionByName(stores).unionByName(links).unionByName(gaps)


def known_paths(rows: DataFrame, column: str, manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows whose path a manifest has, and of the others those that a listing has: only unknown paths are probed."""
    sure = rows.join(manifest.select(F.col("path").alias(column)).distinct(), column, "left_semi")
    open_ = rows.join(manifest.select(F.col("path").alias(column)).distinct(), column, "left_anti")
    return sure.unionByName(open_.join(listing.select(F.col("path").alias(column)).distinct(), column, "left_semi"))


def indexed_counts(rows: DataFrame, manifest: DataFrame, index: DataFrame, tag: str) -> DataFrame:
    """Node counts from a manifest, else from a global index where its tag is the wanted one."""
    m = manifest.select("graph_path", F.col("num_nodes").alias("_m"))
    i = index.where(F.col("tag") == tag).select("graph_path", F.col("num_nodes").alias("_i"))
    return rows.join(m, "graph_path", "left").join(i, "graph_path", "left").withColumn("num_nodes", F.coalesce("_m", "_i")).drop("_m", "_i")


def count_mismatches(listed: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """Items of which the listed number of nodes is not the counted one; one that was not counted is among them."""
    both = listed.select(key, F.col("num_nodes").alias("listed")).join(counted.select(key, F.col("num_nodes").alias("counted")), key, "left")
    return both.where(~F.col("listed").eqNullSafe(F.col("counted")))
