"""Queries of single rules on names, paths and numbers, each over all samples, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.functions import names, scalars
from gatelake.plans import fixtures as fx

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

C, L = F.col, F.lit
_SYN = "'syn' || recipe_id || '_step' || step_id"
#: Every sample seen as an artifact of tier 0, 1 or 2, or as none.
_KIND = "CASE WHEN sample_id % 17 = 0 THEN -1 WHEN tier_id = 0 THEN 0 WHEN sample_id % 2 = 0 THEN 1 ELSE 2 END"
_SECOND = "CASE WHEN algorithm = 'Syn4' THEN 'C2RS' ELSE 'Syn4' END"
_STEM = f"CASE {_KIND} WHEN -1 THEN 'odd-' || sample_id WHEN 0 THEN design || '_' || {_SYN} WHEN 1 THEN design || '_' || algorithm || '_tier1_' || {_SYN} ELSE design || '_' || algorithm || '_' || {_SECOND} || '_tier2_' || {_SYN} END"
#: A name of tier 0 without its design, or with another one.
_OTHER = f"CASE WHEN {_KIND} <> 0 OR sample_id % 4 = 1 THEN {_STEM} WHEN sample_id % 4 = 2 THEN {_SYN} WHEN sample_id % 4 = 3 THEN 'zz_' || {_SYN} ELSE {_STEM} END"
_AT = f"CASE {_KIND} WHEN -1 THEN 'tier0' ELSE 'tier' || ({_KIND}) END"
_TAIL = f"""CAST({_KIND} AS INT) AS tier, CASE WHEN {_KIND} >= 0 THEN design END AS design, CASE {_KIND} WHEN 2 THEN algorithm END AS src, CASE {_KIND} WHEN 2 THEN {_SECOND} WHEN 1 THEN algorithm END AS dst,
    CASE WHEN {_KIND} >= 0 THEN CAST(recipe_id AS VARCHAR) END AS recipe, CASE WHEN {_KIND} >= 0 THEN CAST(step_id AS VARCHAR) END AS step, CASE WHEN {_KIND} < 0 THEN 'unrecognized' WHEN {_KIND} = 0 AND sample_id % 4 IN (2, 3) THEN 'messy' ELSE 'clean' END AS state"""


def _spark(text: str) -> Column:
    return F.expr(text.replace("VARCHAR", "STRING"))


def rule(name: str, doc: str, **columns: tuple[Callable[[], Column], str]) -> None:
    """Adds a query of columns over the samples, each given as a Spark column and in SQL."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fx.samples(spark, sf).select("sample_id", *[make().alias(c) for c, (make, _) in columns.items()])

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    ORACLE[name] = fx.sql("SELECT sample_id, " + ", ".join(f"{sql} AS {c}" for c, (_, sql) in columns.items()) + " FROM fx_samples", "samples")


def fields(name: str, doc: str, make: Callable[[], Column], sql: str) -> None:
    """Adds a query of the fields of a struct over the samples."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fx.samples(spark, sf).select("sample_id", make().alias("f")).select("sample_id", "f.*")

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    ORACLE[name] = fx.sql(f"SELECT sample_id, {sql} FROM fx_samples", "samples")


def _key() -> Column:
    """The artifact key of a sample, as a struct."""
    parts = {"tier": f"CAST({_KIND} AS INT)", "design": "design", "src": f"CASE {_KIND} WHEN 2 THEN algorithm END", "dst": f"CASE {_KIND} WHEN 2 THEN {_SECOND} WHEN 1 THEN algorithm END", "recipe": "CAST(recipe_id AS VARCHAR)", "step": "CAST(step_id AS VARCHAR)"}
    return F.struct(*[_spark(v).alias(k) for k, v in parts.items()])


# Names and paths

fields(
    "scl01_stem_fields",
    "SCL-01: fields of a stem by the loose grammar of its tier.",
    lambda: names.stem_fields(_spark(_STEM)),
    f"CAST({_KIND} AS INT) AS tier, CASE WHEN {_KIND} >= 0 THEN design END AS design, CASE {_KIND} WHEN 2 THEN algorithm END AS src, CASE {_KIND} WHEN 2 THEN {_SECOND} WHEN 1 THEN algorithm END AS dst, CASE WHEN {_KIND} >= 0 THEN {_SYN} END AS tail",
)
fields("scl03_csv_paths", "SCL-03: keys of metadata paths, with hints from their folders.", lambda: names.artifact_of_csv_path(_spark(f"'x/base_aigs/' || design || '/' || {_AT} || '/' || {_OTHER} || '.aig'")), _TAIL)
fields("scl04_graph_paths", "SCL-04: keys of graph paths, with hints from their folders.", lambda: names.artifact_of_graph_path(_spark(f"'/r/graphs/' || {_AT} || '/' || CASE {_KIND} WHEN 1 THEN algorithm || '/' ELSE '' END || design || '/' || {_OTHER} || '.pt'")), _TAIL)

_CLEAN = f"CASE {_KIND} WHEN -1 THEN '' WHEN 0 THEN design || '_' || {_SYN} || '.pt' WHEN 1 THEN design || '_' || algorithm || '_tier1_' || {_SYN} || '.pt' ELSE design || '_' || algorithm || '_' || {_SECOND} || '_tier2_' || {_SYN} || '.pt' END"
rule("scl06_clean_basenames", "SCL-06: the name that an artifact should have.", clean=(lambda: names.clean_basename(_key(), ".pt"), _CLEAN))
rule("scl07_replaced_basenames", "SCL-07: a path with another last part.", renamed=(lambda: names.replace_basename(C("graph_path"), F.concat(L("n"), C("sample_id").cast("string"))), "regexp_replace(graph_path, '[^/]+$', 'n' || sample_id)"))
rule("scl08_expected_paths", "SCL-08: the path that a graph should have.", path=(lambda: names.expected_graph_path("root", _key()), f"CASE {_KIND} WHEN -1 THEN '' ELSE 'root/tier' || ({_KIND}) || '/' || CASE {_KIND} WHEN 1 THEN algorithm || '/' ELSE '' END || design || '/' || {_CLEAN} END"))
rule("scl10_recipe_ids", "SCL-10: the recipe of a stem, null for another grammar.", recipe=(lambda: names.recipe_of_stem(_spark(_STEM)), f"CASE WHEN {_KIND} >= 0 THEN 'syn' || recipe_id END"))
_ODD = "CASE WHEN sample_id % 5 = 0 THEN regexp_replace(graph_path, '[^/]+$', 'odd.pt') ELSE graph_path END"
rule("scl12_recipe_groups", "SCL-12: the recipe of a path, or its design.", recipe=(lambda: names.recipe_of_path(_spark(_ODD)), "CASE WHEN sample_id % 5 = 0 THEN design ELSE 'syn' || recipe_id END"))
rule("scl13_known_designs", "SCL-13: the design of a path, or that it is unknown.", design=(lambda: names.known_design(_spark("CASE WHEN sample_id % 5 = 0 THEN 'x/y.pt' ELSE graph_path END")), "CASE WHEN sample_id % 5 = 0 THEN 'unknown design' ELSE design END"))
rule("scl14_source_scripts", "SCL-14: the optimizer that made a graph, or that it is a base.", script=(lambda: names.source_script(C("graph_path")), "CASE tier_id WHEN 1 THEN algorithm ELSE 'tier0 base' END"))
rule("scl15_local_paths", "SCL-15: a path on this file system.", path=(lambda: names.normal_path(C("graph_path")), "'/scratch-shared' || substr(graph_path, length('/gpfs/scratch1/shared') + 1)"))
rule(
    "scl21_tier2_sources",
    "SCL-21: the first optimizer of a tier 2 name, null if none follows the design.",
    source=(lambda: names.tier2_source(_spark(f"CASE WHEN sample_id % 3 = 0 THEN design || '_none_' || {_SYN} WHEN sample_id % 3 = 1 THEN {_STEM} ELSE 'other_' || {_STEM} END"), C("design")), f"CASE WHEN sample_id % 3 = 1 AND {_KIND} > 0 THEN algorithm END"),
)
rule(
    "scl22_predicted_paths",
    "SCL-22: the circuit that a log optimized, null for a log of another name.",
    path=(lambda: names.tier0_path_of_log(_spark(f"design || '_' || algorithm || '_tier1_' || {_SYN} || CASE WHEN sample_id % 6 = 0 THEN '.txt' ELSE '.log' END"), C("design"), _spark("CASE WHEN sample_id % 7 = 0 THEN 'Other' ELSE algorithm END")), f"CASE WHEN sample_id % 6 <> 0 AND sample_id % 7 <> 0 THEN 'base_aigs/' || design || '/tier0/' || {_SYN} || '.aig' END"),
)
rule("scl19_recipe_numbers", "SCL-19: X is recipe 0, and what is no number is null.", recipe=(lambda: names.recipe_number(_spark("CASE sample_id % 3 WHEN 0 THEN 'X' WHEN 1 THEN CAST(recipe_id AS VARCHAR) ELSE 'q' END")), "CASE sample_id % 3 WHEN 0 THEN 0 WHEN 1 THEN recipe_id END"))

# Coercions

rule("scl17_algorithms", "SCL-17: an optimizer's name, null for empty or all.", algorithm=(lambda: scalars.algorithm(_spark("CASE sample_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' ALL ' WHEN 2 THEN NULL ELSE ' ' || algorithm || ' ' END"), names.ALGORITHMS), "CASE sample_id % 4 WHEN 3 THEN algorithm END"))
rule("scl18_tiers", "SCL-18: empty is tier 0, what is no number is -1.", tier=(lambda: scalars.to_tier(_spark("CASE sample_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN ' 2 ' WHEN 3 THEN 'x' ELSE '1.0' END")), "(CASE sample_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN -1 ELSE 1 END)::INT"))

# Numbers

_PI = "CASE WHEN sample_id % 13 <> 0 THEN num_pi END"
rule("scl24_node_counts", "SCL-24: constant, inputs, gates and outputs; null if one is unknown.", num_nodes=(lambda: scalars.num_nodes(_spark(_PI), C("pre_nodes"), C("num_po")), f"1 + ({_PI}) + pre_nodes + num_po"))
rule("scl25_edge_counts", "SCL-25: two fanins a gate, and the outputs.", num_edges=(lambda: scalars.num_edges(C("pre_nodes"), C("num_po")), "pre_nodes + pre_nodes + num_po"))
rule("scl27_log_counts", "SCL-27: log(1 + count) of small and huge counts.", log_count=(lambda: F.round(scalars.log1p_count(C("pre_nodes").cast("decimal(38,0)") * F.lit(10).cast("decimal(3,0)")), 8), "round(ln(1 + 10 * pre_nodes::DOUBLE), 8)"))
rule("scl28_part_counts", "SCL-28: parts that suit a size, between bounds.", k=(lambda: scalars.dynamic_k(C("pre_nodes") * C("num_pi")), "greatest(2, least(32, (pre_nodes * num_pi) // 10000))::INT"), one=(lambda: scalars.dynamic_k(C("pre_nodes"), 0, 1, 5000), "greatest(1, least(5000, pre_nodes))::INT"))
_RUN = "CASE sample_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'partition' ELSE 'sparsification' END"
_BY = "CASE WHEN sample_id % 6 = 0 THEN 'recipe' ELSE 'design' END"
rule(
    "scl29_run_labels",
    "SCL-29: the label of a run.",
    label=(lambda: scalars.run_label(C("algorithm"), _spark(_RUN), L("random"), _spark(_BY)), "algorithm || CASE sample_id % 3 WHEN 0 THEN CASE WHEN sample_id % 6 = 0 THEN '_none_recipe' ELSE '' END WHEN 1 THEN '_partition_random' ELSE '_sparsification_random' END"),
)
rule(
    "scl31_tracker_names",
    "SCL-31: names of tracked runs, batchings and splits files.",
    run=(lambda: scalars.tracker_name(C("algorithm"), _spark(_RUN), L("random"), L("cuda"), _spark(_BY)), "'test_' || algorithm || CASE sample_id % 3 WHEN 0 THEN '' WHEN 1 THEN '_partition_random' ELSE '_sparsification_random' END || '_cuda' || CASE WHEN sample_id % 6 = 0 THEN '_recipe' ELSE '' END"),
    batching=(lambda: scalars.batching_label(C("tier_id") == 1, C("num_po"), C("pre_nodes")), "CASE tier_id WHEN 1 THEN 'dynamic_nodes=' || pre_nodes ELSE 'fixed_graphs=' || num_po END"),
    splits=(lambda: scalars.splits_filename(F.array(C("design"), C("algorithm")), _spark("CASE WHEN tier_id = 1 THEN num_po END"), _spark(_BY)), "design || '_' || algorithm || '_' || CASE tier_id WHEN 1 THEN num_po::VARCHAR ELSE 'all' END || CASE WHEN sample_id % 6 = 0 THEN '_recipe' ELSE '' END || '_splits.json'"),
)
rule("scl33_cache_roots", "SCL-33: the cache that a graph belongs to.", root=(lambda: scalars.cache_root(_spark("CASE WHEN sample_id % 9 = 0 THEN 'g.pt' ELSE graph_path END")), "CASE WHEN sample_id % 9 = 0 THEN 'cache' ELSE 'cache_tier' || tier_id END"))
rule("scl34_log_features", "SCL-34: logarithms of sizes, and a number clipped to [0, 1].", size=(lambda: F.round(F.log10(C("pre_nodes")), 8), "round(log10(pre_nodes), 8)"), outputs=(lambda: F.round(F.log10(1 + C("num_po")), 8), "round(log10(1 + num_po), 8)"), clipped=(lambda: F.round(scalars.unit_clip(C("target") * 20 - 0.2), 8), "round(CASE WHEN target * 20 - 0.2::DOUBLE < 0 THEN 0.0::DOUBLE WHEN target * 20 - 0.2::DOUBLE > 1 THEN 1.0::DOUBLE ELSE target * 20 - 0.2::DOUBLE END, 8)"))
rule("scl35_coverage_shares", "SCL-35: a percentage, 0 of nothing.", pct=(lambda: F.round(scalars.percent(C("num_po"), C("sample_id") % 5), 6), "round(CASE WHEN sample_id % 5 = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * num_po / (sample_id % 5) END, 6)"))
rule("scl36_savings", "SCL-36: savings in percent, null against nothing.", saving=(lambda: F.round(scalars.saving(C("post_nodes").cast("double"), _spark("CASE WHEN sample_id % 8 = 0 THEN 0 ELSE pre_nodes END").cast("double")), 6) + F.lit(0.0), "round(CASE WHEN sample_id % 8 <> 0 THEN (1 - post_nodes::DOUBLE / pre_nodes) * 100 END, 6) + 0.0::DOUBLE"))
rule("scl39_output_widths", "SCL-39: the width of an encoder's output.", width=(lambda: scalars.output_dim(C("num_pi"), C("num_po"), _spark("CASE WHEN tier_id = 1 THEN 'cat' ELSE 'sum' END")), "CASE tier_id WHEN 1 THEN num_pi * num_po + num_pi ELSE num_pi END"))
rule("scl43_depth_slots", "SCL-43: a level in the range of an embedding.", slot=(lambda: scalars.clamped_level(C("level") - 10, 20).cast("long"), "(CASE WHEN level < 10 THEN 0 WHEN level > 29 THEN 19 ELSE level - 10 END)::BIGINT"))
rule("scl44_absolute_errors", "SCL-44: the stored error of a prediction.", abs_error=(lambda: F.round(F.abs(C("target") - C("num_po") / 100.0), 8), "round(CASE WHEN target < num_po / 100.0::DOUBLE THEN num_po / 100.0::DOUBLE - target ELSE target - num_po / 100.0::DOUBLE END, 8)"))
_JSON = """'{"entries":[{"graph_path":"' || graph_path || '","num_nodes":' || pre_nodes || '}],"__meta__":{"seed":' || recipe_id || ',"split_by":"' || design || '"}}'"""
rule(
    "scl42_json_fields",
    "SCL-42: scalars of a document.",
    seed=(lambda: F.get_json_object(_spark(_JSON), "$.__meta__.seed").cast("int"), "recipe_id"),
    split_by=(lambda: F.get_json_object(_spark(_JSON), "$.__meta__.split_by"), "design"),
    num_nodes=(lambda: F.get_json_object(_spark(_JSON), "$.entries[0].num_nodes").cast("long"), "pre_nodes"),
    absent=(lambda: F.get_json_object(_spark(_JSON), "$.none"), "NULL::VARCHAR"),
)

# Filters on rows

rule("flt12_untrusted", "FLT-12: the mark of the last step of a recipe in a path.", untrusted=(lambda: C("graph_path").contains("_step21."), "step_id = 21"))
