"""Queries over corpus metadata: names, logs, lineage, quality and audit, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.functions import names, scalars
from gatelake.operators import audit, lineage, quality
from gatelake.plans import fixtures as fx

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None, *parts: str):
    """Adds a query, and its SQL over the named fixtures."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = fx.sql(sql, *parts)
        return f

    return add


_ANY = "C2RS|Deepsyn|Orchestrate|Syn4"
#: Keys of stored paths, in DuckDB.
KEYS = rf""", k1 AS (SELECT store, path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') AS stem,
    CASE WHEN store = 'pt' THEN nullif(regexp_extract(path, '(?:^|/)graphs/(tier[^/]*)', 1), '') ELSE nullif(regexp_extract(path, '(?:^|/)base_aigs/[^/]+/(tier[^/]*)', 1), '') END AS tier_part,
    CASE WHEN store <> 'pt' THEN nullif(regexp_extract(path, '(?:^|/)base_aigs/([^/]+)', 1), '')
         WHEN regexp_extract(path, '(?:^|/)graphs/(tier[^/]*)', 1) = 'tier1' THEN nullif(regexp_extract(path, '(?:^|/)graphs/[^/]+/[^/]+/([^/]+)', 1), '')
         ELSE nullif(regexp_extract(path, '(?:^|/)graphs/[^/]+/([^/]+)', 1), '') END AS hint FROM fx_stores),
k2 AS (SELECT *, regexp_extract(stem, '^(.+?)_({_ANY})_({_ANY})_tier2_(?:(.+?)_)?syn([0-9X]+)_step(\d+)$', ['a','b','c','d','e','f']) AS m2,
    regexp_extract(stem, '^(.+?)_({_ANY})_tier1_(?:(.+?)_)?syn([0-9X]+)_step(\d+)$', ['a','b','d','e','f']) AS m1, regexp_extract(stem, '^(.+?)_syn([0-9X]+)_step(\d+)$', ['a','e','f']) AS m0,
    regexp_extract(stem, '^syn([0-9X]+)_step(\d+)$', ['e','f']) AS mb, tier_part = 'tier0' AND hint IS NOT NULL AS at0 FROM k1),
k3 AS (SELECT store, path, stem, m2, m1, m0, mb, hint, at0, CASE WHEN m2.a <> '' THEN 2 WHEN m1.a <> '' THEN 1 WHEN m0.a <> '' OR (at0 AND mb.e <> '') THEN 0 ELSE -1 END AS tier FROM k2),
fx_keys AS MATERIALIZED (SELECT store, path, tier,
    CASE tier WHEN 2 THEN m2.a WHEN 1 THEN m1.a WHEN 0 THEN CASE WHEN at0 THEN hint ELSE m0.a END END AS design, CASE tier WHEN 2 THEN m2.b END AS src, CASE tier WHEN 2 THEN m2.c WHEN 1 THEN m1.b END AS dst,
    CASE tier WHEN 2 THEN m2.e WHEN 1 THEN m1.e WHEN 0 THEN CASE WHEN m0.a <> '' THEN m0.e ELSE mb.e END END AS recipe, CASE tier WHEN 2 THEN m2.f WHEN 1 THEN m1.f WHEN 0 THEN CASE WHEN m0.a <> '' THEN m0.f ELSE mb.f END END AS step,
    CASE tier WHEN 2 THEN CASE WHEN m2.d <> '' THEN 'messy' ELSE 'clean' END WHEN 1 THEN CASE WHEN m1.d <> '' THEN 'messy' ELSE 'clean' END WHEN 0 THEN CASE WHEN at0 AND (m0.a = '' OR m0.a <> hint) THEN 'messy' ELSE 'clean' END ELSE 'unrecognized' END AS state FROM k3),
d AS (SELECT DISTINCT store, tier, design, src, dst, recipe, step FROM fx_keys WHERE tier >= 0)"""
_K = "tier, design, src, dst, recipe, step"


# Names


@register("scl02_artifact_names", KEYS + " SELECT store, path, tier, design, src, dst, recipe, step, state FROM fx_keys", "stores")
def scl02(spark: SparkSession, sf: str) -> DataFrame:
    return audit.parse_stores(fx.stores(spark, sf))


@register(
    "scl05_canonical_names",
    KEYS
    + """ SELECT store, path, 'T' || tier || '_' || concat_ws('_', design, src, dst) || '_syn' || recipe || '_step' || step AS canonical_id,
    concat_ws('_', design, src, dst) || CASE WHEN tier > 0 THEN '_tier' || tier ELSE '' END || '_syn' || recipe || '_step' || step || '.pt' AS clean_name,
    concat_ws('/', 'root/tier' || tier, CASE WHEN tier = 1 THEN dst END, design, concat_ws('_', design, src, dst) || CASE WHEN tier > 0 THEN '_tier' || tier ELSE '' END || '_syn' || recipe || '_step' || step || '.pt') AS expected_path
    FROM fx_keys WHERE tier >= 0""",
    "stores",
)
def scl05(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit.parse_stores(fx.stores(spark, sf)).where("tier >= 0").withColumn("key", F.struct(*audit.KEY))
    key = F.col("key")
    return rows.select("store", "path", names.canonical_id(key).alias("canonical_id"), names.clean_basename(key, ".pt").alias("clean_name"), names.expected_graph_path("root", key).alias("expected_path"))


@register(
    "scl09_input_graphs",
    r""", s AS (SELECT file_path, tier_id, root_design, recipe_id, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\.aig$', '') AS stem FROM fx_master)
    SELECT file_path, CASE tier_id WHEN 0 THEN 'root/graphs/tier0/' || root_design || '/' || stem || '.pt'
      WHEN 1 THEN 'root/graphs/tier0/' || root_design || '/' || regexp_replace(stem, '^(.+?)_(C2RS|Deepsyn|Orchestrate|Syn4)_tier1_', '\1_') || '.pt'
      ELSE 'root/graphs/tier1/' || regexp_extract(stem, '^(.+?)_(C2RS|Deepsyn|Orchestrate|Syn4)_', 2) || '/' || root_design || '/' || regexp_replace(stem, '^(.+?)_(C2RS|Deepsyn|Orchestrate|Syn4)_(C2RS|Deepsyn|Orchestrate|Syn4)_tier2_', '\1_\2_tier1_') || '.pt' END AS input_path,
      'syn' || recipe_id AS recipe FROM s""",
    "master",
)
def scl09(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.master(spark, sf)
    path = names.input_graph_path("root", F.col("file_path"), F.col("tier_id"), F.col("root_design"))
    return rows.select("file_path", path.alias("input_path"), names.recipe_of_stem(names.stem(F.col("file_path"))).alias("recipe"))


@register(
    "scl11_path_groups",
    r"""SELECT sample_id, design AS design_key, 'syn' || recipe_id AS recipe_key, design AS known_design, CASE tier_id WHEN 1 THEN algorithm ELSE 'tier0 base' END AS source_script,
      replace(graph_path, '/gpfs/scratch1/shared', '/scratch-shared') AS local_path, CASE tier_id WHEN 1 THEN 'cache_tier1' ELSE 'cache_tier0' END AS cache_root,
      regexp_replace(graph_path, '[^/]+$', 'x.pt') AS renamed, graph_path LIKE '%\_step21.%' ESCAPE '\' AS untrusted FROM fx_samples""",
    "samples",
)
def scl11(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("graph_path")
    return fx.samples(spark, sf).select(
        "sample_id",
        names.design_of_path(path).alias("design_key"),
        names.recipe_of_path(path).alias("recipe_key"),
        names.known_design(path).alias("known_design"),
        names.source_script(path).alias("source_script"),
        names.normal_path(path).alias("local_path"),
        scalars.cache_root(path).alias("cache_root"),
        names.replace_basename(path, F.lit("x.pt")).alias("renamed"),
        path.contains("_step21.").alias("untrusted"),
    )


@register(
    "scl16_coercions",
    """, t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN ' 2.9 ' WHEN 2 THEN 'x' WHEN 3 THEN NULL WHEN 4 THEN '1' ELSE round(value, 2)::VARCHAR END AS raw,
      CASE event_id % 3 WHEN 0 THEN 'all' WHEN 1 THEN ' Syn4 ' ELSE '' END AS algo FROM events)
    SELECT event_id, trim(coalesce(raw, '')) AS clean, coalesce(trunc(try_cast(nullif(trim(raw), '') AS DOUBLE))::INT, 7) AS as_int, coalesce(try_cast(nullif(trim(raw), '') AS DOUBLE), 0.5::DOUBLE) AS as_double,
      CASE WHEN trim(coalesce(raw, '')) = '' THEN 0 ELSE coalesce(trunc(try_cast(trim(raw) AS DOUBLE))::INT, -1) END AS as_tier, CASE WHEN trim(algo) IN ('', 'all') THEN NULL ELSE trim(algo) END AS algorithm FROM t""",
    "trials",
)
def scl16(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr("CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN ' 2.9 ' WHEN 2 THEN 'x' WHEN 3 THEN NULL WHEN 4 THEN '1' ELSE cast(round(value, 2) AS string) END")
    algo = F.expr("CASE event_id % 3 WHEN 0 THEN 'all' WHEN 1 THEN ' Syn4 ' ELSE '' END")
    return fx.read(spark, sf, "events").select("event_id", scalars.clean(raw).alias("clean"), scalars.to_int(raw, 7).alias("as_int"), scalars.to_double(raw, 0.5).alias("as_double"), scalars.to_tier(raw).alias("as_tier"), scalars.algorithm(algo, names.ALGORITHMS).alias("algorithm"))


@register(
    "scl20_recipe_stems",
    """SELECT DISTINCT recipe_id, step_id, CASE WHEN recipe_id = 0 AND step_id = 0 THEN 'synX_step0' ELSE 'syn' || recipe_id || '_step' || step_id END AS stem,
      CASE WHEN recipe_id = 0 THEN 0 ELSE recipe_id END AS recipe_number FROM (SELECT recipe_id, step_id FROM fx_samples UNION ALL SELECT 0, 0)""",
    "samples",
)
def scl20(spark: SparkSession, sf: str) -> DataFrame:
    pairs = fx.samples(spark, sf).select("recipe_id", "step_id").unionByName(spark.createDataFrame([(0, 0)], "recipe_id int, step_id int")).distinct()
    raw = F.when(F.col("recipe_id") == 0, "X").otherwise(F.col("recipe_id").cast("string"))
    return pairs.select("recipe_id", "step_id", names.recipe_stem(F.col("recipe_id"), F.col("step_id")).alias("stem"), names.recipe_number(raw).alias("recipe_number"))


@register(
    "scl23_labels_and_sizes",
    """SELECT sample_id, round((pre_nodes - post_nodes)::DOUBLE / pre_nodes, 4) AS optimizability, 1 + num_pi + pre_nodes + num_po AS num_nodes, 2 * pre_nodes + num_po AS num_edges,
      CASE WHEN sample_id % 5 < 2 THEN 2 * pre_nodes + num_po ELSE 7 END AS edges, greatest(2, least(32, (pre_nodes * num_pi) // 10000))::INT AS k, round(log10(1 + num_pi), 8) AS log_pi, greatest(0, least(24971, coalesce(level, 0))) AS level_slot,
      round(ln(1 + level), 8) AS log_level FROM fx_samples""",
    "samples",
)
def scl23(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    edges = F.expr("CASE sample_id % 5 WHEN 0 THEN null WHEN 1 THEN 0 ELSE 7 END")
    return fx.samples(spark, sf).select(
        "sample_id",
        scalars.relative_reduction(c("pre_nodes"), c("post_nodes")).alias("optimizability"),
        scalars.num_nodes(c("num_pi"), c("pre_nodes"), c("num_po")).alias("num_nodes"),
        scalars.num_edges(c("pre_nodes"), c("num_po")).alias("num_edges"),
        scalars.imputed_edges(edges, c("pre_nodes"), c("num_po")).alias("edges"),
        scalars.dynamic_k(c("pre_nodes") * c("num_pi")).alias("k"),
        F.round(F.log10(1 + c("num_pi")), 8).alias("log_pi"),
        scalars.clamped_level(F.coalesce(c("level"), F.lit(0)), 24972).alias("level_slot"),
        F.round(scalars.log1p_count(c("level")), 8).alias("log_level"),
    )


# Logs and lineage


@register(
    "src03_parse_logs",
    r""", b AS (SELECT *, regexp_extract_all(content, 'i/o\s*=\s*(\d+)/\s*(\d+).*?(?:and|nd)\s*=\s*(\d+).*?lev\s*=\s*(\d+)', 1) AS pi, regexp_extract_all(content, 'i/o\s*=\s*(\d+)/\s*(\d+).*?(?:and|nd)\s*=\s*(\d+).*?lev\s*=\s*(\d+)', 2) AS po,
      regexp_extract_all(content, 'i/o\s*=\s*(\d+)/\s*(\d+).*?(?:and|nd)\s*=\s*(\d+).*?lev\s*=\s*(\d+)', 3) AS g, regexp_extract_all(content, 'i/o\s*=\s*(\d+)/\s*(\d+).*?(?:and|nd)\s*=\s*(\d+).*?lev\s*=\s*(\d+)', 4) AS v FROM fx_logs)
    SELECT 'base_aigs/' || design || '/tier' || tier_id || '/' || algorithm || '/' || replace(log_name, '.log', '.aig') AS file_path, CASE WHEN tier_id = 2 THEN design || '_' || regexp_extract(substr(log_name, length(design) + 2), '^(Orchestrate|Deepsyn|Syn4|C2RS)_', 1) ELSE design END AS design,
      regexp_extract(log_name, 'syn([0-9X]+)_step(\d+)', 1)::INT AS recipe_id, regexp_extract(log_name, 'syn([0-9X]+)_step(\d+)', 2)::INT AS step_id, tier_id, algorithm, g[-1]::BIGINT AS nodes, 0::BIGINT AS edges, pi[-1]::BIGINT AS num_pi, po[-1]::BIGINT AS num_po, v[-1]::BIGINT AS depth,
      round((g[1]::DOUBLE - g[-1]::DOUBLE) / g[1]::DOUBLE, 4) AS optimizability, round(CASE WHEN v[1]::BIGINT > 0 THEN (v[1]::DOUBLE - v[-1]::DOUBLE) / v[1]::DOUBLE ELSE 0.0::DOUBLE END, 4) AS depth_optimizability FROM b WHERE len(g) >= 2""",
    "logs",
)
def src03(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.parse_logs(fx.logs(spark, sf))


@register(
    "src04_tier0_of_logs",
    r""", b AS (SELECT 'base_aigs/' || design || '/tier0/' || replace(substr(log_name, length(design || '_' || algorithm || '_tier1_') + 1), '.log', '.aig') AS file_path, design,
      regexp_extract(content, 'i/o\s*=\s*(\d+)/\s*(\d+).*?(?:and|nd)\s*=\s*(\d+).*?lev\s*=\s*(\d+)', ['pi', 'po', 'nodes', 'depth']) AS m FROM fx_logs WHERE tier_id = 1)
    SELECT file_path, design, nodes, num_pi, num_po, depth FROM (SELECT file_path, design, m.nodes::BIGINT AS nodes, m.pi::BIGINT AS num_pi, m.po::BIGINT AS num_po, m.depth::BIGINT AS depth, row_number() OVER (PARTITION BY file_path, design ORDER BY m.nodes::BIGINT, m.pi::BIGINT, m.po::BIGINT, m.depth::BIGINT) AS r FROM b) WHERE r = 1""",
    "logs",
)
def src04(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.tier0_of_logs(fx.logs(spark, sf))


_STEM = "CASE WHEN c.recipe_id = 0 AND c.step_id = 0 THEN 'synX_step0' ELSE 'syn' || c.recipe_id || '_step' || c.step_id END"
_COLUMNS = "c.root_design AS design, c.recipe_id, c.step_id, c.tier_id, c.algorithm, p.nodes AS pre_nodes, c.nodes AS post_nodes, c.edges, p.num_pi AS pre_num_pi, c.num_pi AS post_num_pi, p.num_po AS pre_num_po, c.num_po AS post_num_po, p.depth AS pre_depth, c.depth AS post_depth, c.optimizability, c.depth_optimizability"
_TIER1 = f"SELECT concat_ws('/', 'graphs/tier0', c.root_design, c.root_design || '_' || {_STEM} || '.pt') AS graph_path, {_COLUMNS} FROM fx_master c JOIN fx_master p ON p.tier_id = 0 AND c.tier_id = 1 AND p.root_design = c.root_design AND p.recipe_id = c.recipe_id AND p.step_id = c.step_id"
_SOURCE = "regexp_extract(substr(c.design, length(c.root_design) + 2), '(.*)', 1)"
_TIER2 = f"SELECT concat_ws('/', 'graphs/tier1', p.algorithm, c.root_design, c.root_design || '_' || p.algorithm || '_tier1_' || {_STEM} || '.pt') AS graph_path, {_COLUMNS} FROM fx_master c JOIN fx_master p ON p.tier_id = 1 AND c.tier_id = 2 AND p.root_design = c.root_design AND p.recipe_id = c.recipe_id AND p.step_id = c.step_id AND p.algorithm = {_SOURCE}"


@register("jon01_tier1_samples", _TIER1, "master")
def jon01(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.tier1_samples(fx.master(spark, sf))


@register("jon02_tier2_samples", _TIER2, "master")
def jon02(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.tier2_samples(fx.master(spark, sf))


@register("set06_all_samples", f", u AS ({_TIER1} UNION ALL {_TIER2}) SELECT algorithm, tier_id, count(*) AS n, count(DISTINCT graph_path) AS n_graphs, sum(post_nodes)::BIGINT AS nodes FROM u GROUP BY ALL", "master")
def set06(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.samples(fx.master(spark, sf)).groupBy("algorithm", "tier_id").agg(F.count("*").alias("n"), F.count_distinct("graph_path").alias("n_graphs"), F.sum("post_nodes").alias("nodes"))


_STEPS = f""", s1 AS (SELECT c.root_design, c.algorithm, c.nodes, c.depth, p.nodes AS pre_nodes, p.depth AS pre_depth, c.nodes - p.nodes AS node_change, c.depth - p.depth AS depth_change FROM (SELECT * FROM fx_master WHERE tier_id = 1) c LEFT JOIN (SELECT * FROM fx_master WHERE tier_id = 0) p ON p.root_design = c.root_design AND p.recipe_id = c.recipe_id AND p.step_id = c.step_id),
s2 AS (SELECT c.root_design, c.algorithm, c.nodes, c.depth, p.nodes AS pre_nodes, p.depth AS pre_depth, c.nodes - p.nodes AS node_change, c.depth - p.depth AS depth_change FROM (SELECT * FROM fx_master WHERE tier_id = 2) c LEFT JOIN (SELECT * FROM fx_master WHERE tier_id = 1) p ON p.root_design = c.root_design AND p.recipe_id = c.recipe_id AND p.step_id = c.step_id AND p.algorithm = {_SOURCE})"""
_REPORT = "SELECT algorithm, count(*) AS n, count(*) FILTER (pre_nodes IS NULL) AS n_orphans, count(*) FILTER (node_change > 0) AS n_more_nodes, count(*) FILTER (node_change = 0) AS n_same_nodes, coalesce(sum(node_change) FILTER (node_change > 0), 0)::BIGINT AS sum_more_nodes, max(node_change) AS max_node_change, count(*) FILTER (depth_change > 0) AS n_more_depth, max(depth_change) AS max_depth_change FROM {} GROUP BY algorithm"


@register("jon03_step_report_tier1", _STEPS + _REPORT.format("s1"), "master")
def jon03a(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.step_report(fx.master(spark, sf), 1)


@register("jon03_step_report_tier2", _STEPS + _REPORT.format("s2"), "master")
def jon03b(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.step_report(fx.master(spark, sf), 2)


@register("agg08_deeper_designs", _STEPS + " SELECT algorithm, count(DISTINCT root_design) AS n_designs, string_agg(DISTINCT root_design, ',' ORDER BY root_design) AS designs FROM s2 WHERE depth_change > 0 GROUP BY 1", "master")
def agg08(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.deeper_designs(fx.master(spark, sf), 2)


@register(
    "agg09_shrink_shares",
    _STEPS
    + """, c AS (SELECT 1 AS tier, * FROM s1 WHERE pre_nodes IS NOT NULL UNION ALL SELECT 2, * FROM s2 WHERE pre_nodes IS NOT NULL), t AS (SELECT tier, count(*) AS n, count(*) FILTER (node_change < 0) AS n_shrunk FROM c GROUP BY 1 UNION ALL SELECT 0, count(*), count(*) FILTER (node_change < 0) FROM c)
    SELECT tier, n, n_shrunk, round(100.0::DOUBLE * n_shrunk / n, 6) AS shrunk_pct, round(100.0::DOUBLE * (n - n_shrunk) / n, 6) AS other_pct FROM t""",
    "master",
)
def agg09(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.shrink_shares(fx.master(spark, sf))


@register("jon18_pending_work", "SELECT file_path FROM fx_master WHERE tier_id = 1 AND file_path NOT IN (SELECT file_path FROM fx_master WHERE nodes % 3 = 0)", "master")
def jon18(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.master(spark, sf)
    return lineage.pending(rows.where("tier_id = 1").select("file_path"), rows.where("nodes % 3 = 0"), "file_path")


@register("snk03_rows_by_algorithm", ", m AS (SELECT a.name AS \"set\", m.* FROM fx_master m CROSS JOIN fx_algos a WHERE tier_id = 0 UNION ALL SELECT algorithm, * FROM fx_master WHERE algorithm <> '') SELECT \"set\", tier_id, count(*) AS n, sum(nodes)::BIGINT AS nodes FROM m GROUP BY ALL", "master")
def snk03(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.per_algorithm(fx.master(spark, sf)).groupBy("set", "tier_id").agg(F.count("*").alias("n"), F.sum("nodes").alias("nodes"))


@register("scl26_imputed_edges", "SELECT file_path, CASE WHEN edges <= 0 THEN greatest(0, 2 * nodes + num_po) ELSE edges END AS edges FROM fx_master", "master")
def scl26(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.impute_edges(fx.master(spark, sf)).select("file_path", "edges")


# Quality


@register(
    "agg01_composition",
    """SELECT CASE grouping(tier_id, algorithm, root_design) WHEN 3 THEN 'tier' WHEN 5 THEN 'algorithm' WHEN 1 THEN 'tier x algorithm' ELSE 'design x tier' END AS part, tier_id AS tier, algorithm, root_design, count(*) AS n
    FROM fx_master GROUP BY GROUPING SETS ((tier_id), (algorithm), (tier_id, algorithm), (tier_id, root_design))""",
    "master",
)
def agg01(spark: SparkSession, sf: str) -> DataFrame:
    return quality.composition(fx.master(spark, sf))


@register("agg02_completeness", ", c AS (SELECT {} FROM fx_master) UNPIVOT c ON * INTO NAME name VALUE filled".format(", ".join(f"count(*) FILTER (trim({x}::VARCHAR) <> '') AS {x}" for x in ("file_path", "design", "algorithm", "nodes", "depth"))), "master")
def agg02(spark: SparkSession, sf: str) -> DataFrame:
    return quality.completeness(fx.master(spark, sf).select("file_path", "design", "algorithm", "nodes", "depth"))


@register("agg03_tier_means", "SELECT tier_id, round(avg(nodes), 6) AS mean_nodes, round(avg(depth), 6) AS mean_depth FROM fx_master GROUP BY 1", "master")
def agg03(spark: SparkSession, sf: str) -> DataFrame:
    return quality.tier_means(fx.master(spark, sf))


@register(
    "agg04_label_ranges",
    """SELECT tier_id, algorithm, min(optimizability) AS min_opt, max(optimizability) AS max_opt, min(depth_optimizability) AS min_depth_opt, max(depth_optimizability) AS max_depth_opt, count(*) FILTER (abs(optimizability) <= 1e-12) AS n_zero, count(*) FILTER (abs(depth_optimizability) > 1e-12) AS n_depth_changed,
    count(*) FILTER (depth_optimizability > 1e-12) AS n_depth_better, count(*) FILTER (depth_optimizability < -1e-12) AS n_depth_worse, count(*) FILTER (abs(optimizability) <= 1e-12 AND depth_optimizability > 0) AS n_depth_only FROM fx_master WHERE tier_id > 0 GROUP BY ALL""",
    "master",
)
def agg04(spark: SparkSession, sf: str) -> DataFrame:
    return quality.label_ranges(fx.master(spark, sf))


@register(
    "agg06_largest",
    """, v AS (SELECT * FROM fx_master WHERE nodes IS NOT NULL AND depth IS NOT NULL) SELECT tier_id, 'nodes' AS what, file_path, nodes AS value FROM (SELECT *, row_number() OVER (PARTITION BY tier_id ORDER BY nodes DESC, file_path) AS r FROM v) WHERE r = 1
    UNION ALL SELECT tier_id, 'depth', file_path, depth FROM (SELECT *, row_number() OVER (PARTITION BY tier_id ORDER BY depth DESC, file_path) AS r FROM v) WHERE r = 1""",
    "master",
)
def agg06(spark: SparkSession, sf: str) -> DataFrame:
    return quality.largest(fx.master(spark, sf))


@register(
    "agg10_length_consistency",
    """, n AS (SELECT tier_id, algorithm, count(*) AS n FROM fx_master WHERE tier_id > 0 GROUP BY ALL) SELECT tier_id, min(n) AS fewest, max(n) AS most, arg_min(algorithm, (n, algorithm)) AS fewest_of, arg_min(algorithm, (-n, algorithm)) AS most_of, max(n) - min(n) AS delta, round(100.0::DOUBLE * (max(n) - min(n)) / min(n), 6) AS delta_pct FROM n GROUP BY 1""",
    "master",
)
def agg10(spark: SparkSession, sf: str) -> DataFrame:
    return quality.length_consistency(fx.master(spark, sf))


@register(
    "agg42_invariants",
    """, c AS (SELECT root_design, count(*) FILTER (tier_id = 0) AS n0, count(*) FILTER (tier_id = 1) AS n1, count(*) FILTER (tier_id = 2) AS n2, {} FROM fx_master GROUP BY 1)
    SELECT root_design, n0, n1, n2, 'tier1 is not 4 x tier0' AS problem FROM c WHERE n1 <> 4 * n0 UNION ALL SELECT root_design, n0, n1, n2, 'tier2 is not 12 x tier0' FROM c WHERE n2 <> 12 * n0 UNION ALL SELECT root_design, n0, n1, n2, 'tier1 differs by algorithm' FROM c WHERE greatest(a0, a1, a2, a3) <> least(a0, a1, a2, a3)""".format(
        ", ".join(f"count(*) FILTER (tier_id = 1 AND algorithm = '{a}') AS a{i}" for i, a in enumerate(names.ALGORITHMS))
    ),
    "master",
)
def agg42(spark: SparkSession, sf: str) -> DataFrame:
    return quality.invariants(fx.master(spark, sf))


@register("dq01_row_issues", "SELECT file_path, tier_id, algorithm, 'no depth' AS issue FROM fx_master WHERE depth IS NULL ORDER BY file_path LIMIT 20", "master")
def dq01(spark: SparkSession, sf: str) -> DataFrame:
    return quality.row_issues(fx.master(spark, sf))


@register("dq06_archive_gaps", ", h AS (SELECT root_design, count(*) FILTER (tier_id = 0) > 0 AS has_tier0, list(DISTINCT algorithm) FILTER (tier_id = 1) AS have FROM fx_master GROUP BY 1) SELECT root_design, has_tier0, array_to_string(list_sort(list_filter(['Orchestrate', 'Deepsyn', 'Syn4', 'C2RS'], lambda a: NOT list_contains(coalesce(have, []), a))), ',') AS missing FROM h", "master")
def dq06(spark: SparkSession, sf: str) -> DataFrame:
    return quality.archive_gaps(fx.master(spark, sf))


@register("flt06_valid_numbers", "SELECT tier_id, count(*) AS n FROM fx_master WHERE isfinite(optimizability) AND isfinite(depth_optimizability) AND depth IS NOT NULL GROUP BY 1", "master")
def flt06(spark: SparkSession, sf: str) -> DataFrame:
    return quality.valid_numbers(fx.master(spark, sf), "nodes", "depth", "optimizability", "depth_optimizability").groupBy("tier_id").agg(F.count("*").alias("n"))


# Audit

_WHERE = """, w AS (SELECT tier, design, src, dst, recipe, step, max((store = 'aig')::INT) AS aig, max((store = 'pt')::INT) AS pt, max((store = 'csv')::INT) AS csv FROM {} GROUP BY ALL)"""
_SETS = "SELECT tier, count(*) FILTER (aig = 1 AND pt = 1 AND csv = 1) AS perfect, count(*) FILTER (aig = 1 AND csv = 1 AND pt = 0) AS missing_pt, count(*) FILTER (csv = 1 AND aig = 0) AS csv_ghosts, count(*) FILTER (pt = 1 AND aig = 0) AS pt_orphans, count(*) FILTER (aig = 1 AND csv = 0) AS aig_unlisted FROM {} GROUP BY 1"


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return audit.parse_stores(fx.stores(spark, sf))


@register("set01_perfect", KEYS + f" SELECT {_K} FROM d WHERE store = 'aig' INTERSECT SELECT {_K} FROM d WHERE store = 'pt' INTERSECT SELECT {_K} FROM d WHERE store = 'csv'", "stores")
def set01(spark: SparkSession, sf: str) -> DataFrame:
    return audit.perfect(_parsed(spark, sf))


@register("set02_missing_graphs", KEYS + f" (SELECT {_K} FROM d WHERE store = 'aig' INTERSECT SELECT {_K} FROM d WHERE store = 'csv') EXCEPT SELECT {_K} FROM d WHERE store = 'pt'", "stores")
def set02(spark: SparkSession, sf: str) -> DataFrame:
    return audit.missing_graphs(_parsed(spark, sf))


@register("set03_ghosts", KEYS + f" SELECT {_K} FROM d WHERE store = 'csv' EXCEPT SELECT {_K} FROM d WHERE store = 'aig'", "stores")
def set03(spark: SparkSession, sf: str) -> DataFrame:
    return audit.difference(_parsed(spark, sf), "csv", "aig")


@register("set03_set_report", KEYS + _WHERE.format("d") + _SETS.format("w"), "stores")
def set03r(spark: SparkSession, sf: str) -> DataFrame:
    return audit.set_report(_parsed(spark, sf))


@register(
    "set04_tier2_links",
    KEYS
    + """ SELECT n.store, count(*) AS needed, count(t.store) AS linked, count(*) FILTER (t.store IS NULL) AS broken FROM (SELECT DISTINCT store, design, src, recipe, step FROM d WHERE tier = 2) n
    LEFT JOIN (SELECT DISTINCT store, design, dst, recipe, step FROM d WHERE tier = 1) t ON t.store = n.store AND t.design = n.design AND t.dst = n.src AND t.recipe = n.recipe AND t.step = n.step GROUP BY 1""",
    "stores",
)
def set04(spark: SparkSession, sf: str) -> DataFrame:
    return audit.tier2_links(_parsed(spark, sf))


@register(
    "set05_cleanup_preview",
    KEYS
    + _WHERE.format("d")
    + ", c AS (SELECT DISTINCT store, tier, design, src, dst, recipe, step FROM fx_keys WHERE tier >= 0 AND state = 'clean')"
    + _WHERE.format("c").replace(", w AS", ", wc AS")
    + f", a AS (UNPIVOT ({_SETS.format('w')}) ON perfect, missing_pt, csv_ghosts, pt_orphans, aig_unlisted INTO NAME metric VALUE simulated), b AS (UNPIVOT ({_SETS.format('wc')}) ON perfect, missing_pt, csv_ghosts, pt_orphans, aig_unlisted INTO NAME metric VALUE strict)"
    + " SELECT tier, metric, coalesce(strict, 0) AS strict, simulated, simulated - coalesce(strict, 0) AS delta FROM a LEFT JOIN b USING (tier, metric)",
    "stores",
)
def set05(spark: SparkSession, sf: str) -> DataFrame:
    return audit.cleanup_preview(_parsed(spark, sf))


@register("agg12_naming_states", KEYS + " SELECT store, tier, state, count(*) AS n FROM fx_keys GROUP BY ALL", "stores")
def agg12(spark: SparkSession, sf: str) -> DataFrame:
    return audit.naming_states(_parsed(spark, sf))


@register("agg13_store_diagnostics", KEYS + " SELECT store, count(*) FILTER (tier = 0) AS tier0, count(*) FILTER (tier = 1) AS tier1, count(*) FILTER (tier = 2) AS tier2, count(*) FILTER (tier = -1) AS unrecognized, count(*) FILTER (state = 'messy') AS messy FROM fx_keys GROUP BY 1", "stores")
def agg13(spark: SparkSession, sf: str) -> DataFrame:
    return audit.store_diagnostics(_parsed(spark, sf))


_EXPECTED = KEYS + """, want AS (SELECT design, d.dst AS src, a.name AS dst, recipe, step FROM d JOIN fx_algos a ON a.name <> d.dst WHERE store = 'aig' AND tier = 1),
gaps AS (SELECT * FROM want w WHERE NOT EXISTS (SELECT 1 FROM d h WHERE h.store = 'aig' AND h.tier = 2 AND h.design = w.design AND h.src = w.src AND h.dst = w.dst AND h.recipe = w.recipe AND h.step = w.step))"""


@register("jon15_expected_keys", _EXPECTED + " SELECT design, src, dst, count(*) AS n FROM want GROUP BY ALL", "stores")
def jon15(spark: SparkSession, sf: str) -> DataFrame:
    return audit.expected_keys(_parsed(spark, sf), 2).groupBy("design", "src", "dst").agg(F.count("*").alias("n"))


@register("jon16_generation_gaps", _EXPECTED + " SELECT design, src, dst, recipe, step FROM gaps", "stores")
def jon16(spark: SparkSession, sf: str) -> DataFrame:
    return audit.generation_gaps(_parsed(spark, sf), 2)


@register(
    "agg14_gap_rollups",
    _EXPECTED
    + """ SELECT CASE grouping(design, dst, recipe, step) WHEN 7 THEN 'design' WHEN 11 THEN 'algorithm' WHEN 13 THEN 'recipe' WHEN 14 THEN 'step' ELSE 'design x algorithm' END AS part, concat_ws('|', design, dst, recipe, step) AS item, count(*) AS n
    FROM gaps GROUP BY GROUPING SETS ((design), (dst), (recipe), (step), (design, dst))""",
    "stores",
)
def agg14(spark: SparkSession, sf: str) -> DataFrame:
    return audit.gap_rollups(audit.generation_gaps(_parsed(spark, sf), 2))


_COVER = _EXPECTED + ", c AS (SELECT design, w.n AS expected, w.n - coalesce(g.n, 0) AS found, coalesce(g.n, 0) AS missing, round(100.0::DOUBLE * (w.n - coalesce(g.n, 0)) / w.n, 6) AS coverage_pct FROM (SELECT design, count(*) AS n FROM want GROUP BY 1) w LEFT JOIN (SELECT design, count(*) AS n FROM gaps GROUP BY 1) g USING (design))"


@register("agg15_coverage", _COVER + " SELECT * FROM c", "stores")
def agg15(spark: SparkSession, sf: str) -> DataFrame:
    return audit.coverage(_parsed(spark, sf), 2)


@register("top02_lowest_coverage", _COVER + " SELECT * FROM c ORDER BY coverage_pct, missing DESC, design LIMIT 5", "stores")
def top02(spark: SparkSession, sf: str) -> DataFrame:
    return audit.lowest_coverage(audit.coverage(_parsed(spark, sf), 2), 5)


@register("top01_most_common", KEYS + " SELECT recipe AS item, count(*) AS n FROM fx_keys WHERE state = 'messy' GROUP BY 1 ORDER BY n DESC, item LIMIT 10", "stores")
def top01(spark: SparkSession, sf: str) -> DataFrame:
    return audit.most_common(_parsed(spark, sf).where("state = 'messy'"), F.col("recipe"), 10)


@register("agg16_examples", KEYS + " SELECT store || ':' || tier AS bucket, string_agg(path, ';' ORDER BY path) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY store, tier ORDER BY path) AS r FROM fx_keys WHERE state = 'messy') WHERE r <= 3 GROUP BY 1", "stores")
def agg16(spark: SparkSession, sf: str) -> DataFrame:
    return audit.examples(_parsed(spark, sf).where("state = 'messy'"), F.concat_ws(":", "store", "tier"), F.col("path"), 3)


_PLAN = KEYS + """, plan AS (SELECT path, 'T' || tier || '_' || concat_ws('_', design, src, dst) || '_syn' || recipe || '_step' || step AS canonical_id, regexp_extract(path, '^(.*/)?[^/]*$', 1) || concat_ws('_', design, src, dst) || CASE WHEN tier > 0 THEN '_tier' || tier ELSE '' END || '_syn' || recipe || '_step' || step || '.pt' AS suggested
    FROM fx_keys WHERE store = 'pt' AND state = 'messy')"""


@register("src21_rename_plan", _PLAN + " SELECT * FROM plan WHERE path <> suggested", "stores")
def src21(spark: SparkSession, sf: str) -> DataFrame:
    return audit.rename_plan(_parsed(spark, sf), "pt")


@register(
    "dq09_rename_status",
    _PLAN
    + """, t AS (SELECT path FROM fx_stores WHERE store = 'pt' AND length(path) % 7 <> 0 UNION SELECT suggested FROM plan WHERE length(suggested) % 3 = 0), s AS (SELECT path IN (SELECT path FROM t) AS a, suggested IN (SELECT path FROM t) AS b FROM plan)
    SELECT CASE WHEN a AND NOT b THEN 'rename' WHEN NOT a AND b THEN 'already' WHEN a THEN 'skip' ELSE 'missing' END AS status, count(*) AS n FROM s GROUP BY 1""",
    "stores",
)
def dq09(spark: SparkSession, sf: str) -> DataFrame:
    parsed = _parsed(spark, sf)
    plan = audit.rename_plan(parsed, "pt")
    there = parsed.where("store = 'pt' and length(path) % 7 <> 0").select("path").union(plan.where("length(suggested) % 3 = 0").select("suggested")).distinct()
    return audit.rename_status(plan, there).groupBy("status").agg(F.count("*").alias("n"))


@register("jon17_mapped_paths", _PLAN + " SELECT coalesce(p.suggested, s.path) AS path, count(*) AS n FROM fx_stores s LEFT JOIN plan p ON p.path = s.path WHERE store = 'pt' GROUP BY 1", "stores")
def jon17(spark: SparkSession, sf: str) -> DataFrame:
    parsed = _parsed(spark, sf)
    return audit.mapped(parsed.where("store = 'pt'").select("path"), audit.rename_plan(parsed, "pt"), "path").groupBy("path").agg(F.count("*").alias("n"))


# Filters, orders and reports over the corpus


@register("flt02_existing_inputs", ", s AS (" + _TIER1 + ") SELECT graph_path, algorithm, count(*) AS n FROM s WHERE graph_path IN (SELECT concat_ws('/', 'graphs/tier0', root_design, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.aig$', '.pt')) FROM fx_master WHERE tier_id = 0 AND nodes % 2 = 0) GROUP BY ALL", "master")
def flt02(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.master(spark, sf)
    held = rows.where("tier_id = 0 and nodes % 2 = 0").select(F.concat_ws("/", F.lit("graphs/tier0"), "root_design", F.regexp_replace(names.basename(F.col("file_path")), r"\.aig$", ".pt")).alias("path"))
    return lineage.with_inputs(lineage.tier1_samples(rows), held).groupBy("graph_path", "algorithm").agg(F.count("*").alias("n"))


@register("flt03_unparsed_sources", "SELECT count(*) AS n, count(*) FILTER (NOT regexp_matches(substr(regexp_extract(file_path, '([^/]*)$', 1), length(design) + 2), '^(Orchestrate|Deepsyn|Syn4|C2RS)_')) AS n_unparsed FROM fx_master WHERE tier_id = 2", "master")
def flt03(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.unparsed_sources(fx.master(spark, sf))


@register("flt01_tier_and_algorithm", "SELECT tier_id, algorithm, count(*) AS n FROM fx_master WHERE tier_id = 1 AND algorithm IN ('Orchestrate', 'Deepsyn', 'Syn4', 'C2RS') GROUP BY ALL", "master")
def flt01(spark: SparkSession, sf: str) -> DataFrame:
    return fx.master(spark, sf).where((F.col("tier_id") == 1) & F.col("algorithm").isin(*names.ALGORITHMS)).groupBy("tier_id", "algorithm").agg(F.count("*").alias("n"))


@register("flt08_known_paths", ", m AS (SELECT path FROM fx_stores WHERE store = 'aig'), l AS (SELECT path FROM fx_stores WHERE store = 'csv' AND length(path) % 2 = 0) SELECT tier_id, count(*) AS n FROM fx_master WHERE file_path IN (SELECT path FROM m) OR file_path IN (SELECT path FROM l) GROUP BY 1", "stores")
def flt08(spark: SparkSession, sf: str) -> DataFrame:
    held = fx.stores(spark, sf)
    rows = fx.master(spark, sf).select("file_path", "tier_id")
    return audit.known_paths(rows, "file_path", held.where("store = 'aig'"), held.where("store = 'csv' and length(path) % 2 = 0")).groupBy("tier_id").agg(F.count("*").alias("n"))


@register("flt09_mismatched_designs", KEYS + ", f AS (SELECT path, CASE WHEN length(path) % 3 = 0 THEN '' WHEN length(path) % 5 = 0 THEN 'other' ELSE design END AS expected, design AS found FROM fx_keys WHERE store = 'aig') SELECT path, expected, found FROM f WHERE expected <> '' AND expected <> found", "stores")
def flt09(spark: SparkSession, sf: str) -> DataFrame:
    rows = _parsed(spark, sf).where("store = 'aig'")
    expected = F.when(F.length("path") % 3 == 0, "").when(F.length("path") % 5 == 0, "other").otherwise(F.col("design"))
    return lineage.mismatched_designs(rows.select("path", expected.alias("expected")))


@register("jon23_indexed_counts", ", r AS (SELECT graph_path, max(pre_nodes) AS n FROM fx_samples GROUP BY 1) SELECT graph_path, CASE WHEN length(graph_path) % 2 = 0 THEN n WHEN n % 3 = 0 THEN n + 1 END AS num_nodes FROM r", "samples")
def jon23(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.samples(spark, sf).groupBy("graph_path").agg(F.max("pre_nodes").alias("num_nodes"))
    held = rows.where(F.length("graph_path") % 2 == 0)
    index = rows.select("graph_path", (F.col("num_nodes") + 1).alias("num_nodes"), F.when(F.col("num_nodes") % 3 == 0, "v2").otherwise("v1").alias("tag"))
    return audit.indexed_counts(rows.select("graph_path"), held, index, "v2")


@register("win07_first_occurrence", "SELECT graph_path, arg_min(design, sample_id) AS design, arg_min(pre_nodes, sample_id) AS pre_nodes FROM fx_samples GROUP BY 1", "samples")
def win07(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.first_of_key(fx.samples(spark, sf), ["graph_path"], "sample_id", "design", "pre_nodes")


@register("win09_task_ids", "SELECT file_path, row_number() OVER (ORDER BY root_design, file_path) AS task_id FROM fx_master WHERE tier_id = 1", "master")
def win09(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.task_ids(fx.master(spark, sf).where("tier_id = 1"), "root_design", "file_path").select("file_path", "task_id")


@register("top03_ordered_gaps", _EXPECTED + " SELECT design, count(*) AS n FROM gaps GROUP BY 1 ORDER BY n DESC, design", "stores")
def top03(spark: SparkSession, sf: str) -> DataFrame:
    return audit.generation_gaps(_parsed(spark, sf), 2).groupBy("design").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "design")


@register("set07_done_keys", ", d AS (SELECT file_path AS graph_id, a.name AS algo FROM fx_master CROSS JOIN fx_algos a WHERE tier_id = 0 AND (nodes + a.i) % 5 <> 0) SELECT graph_id FROM d GROUP BY 1 HAVING count(DISTINCT algo) = 4", "master")
def set07(spark: SparkSession, sf: str) -> DataFrame:
    algorithms = F.explode(F.array(*[F.struct(F.lit(a).alias("algo"), F.lit(i).alias("i")) for i, a in enumerate(names.ALGORITHMS, 1)]))
    done = fx.master(spark, sf).where("tier_id = 0").select(F.col("file_path").alias("graph_id"), "nodes", algorithms.alias("a")).where("(nodes + a.i) % 5 != 0").select("graph_id", "a.algo")
    return audit.done_keys(done, 4)


@register("rep15_master_report", None)
def rep15(spark: SparkSession, sf: str) -> DataFrame:
    return quality.master_report(fx.master(spark, sf))


@register(
    "rep16_reconciliation",
    _EXPECTED
    + _WHERE.format("d")
    + f""", a AS (UNPIVOT ({_SETS.format('w')}) ON perfect, missing_pt, csv_ghosts, pt_orphans, aig_unlisted INTO NAME metric VALUE value),
    b AS (UNPIVOT (SELECT store, count(*) FILTER (tier = 0) AS tier0, count(*) FILTER (tier = 1) AS tier1, count(*) FILTER (tier = 2) AS tier2, count(*) FILTER (tier = -1) AS unrecognized, count(*) FILTER (state = 'messy') AS messy FROM fx_keys GROUP BY 1) ON tier0, tier1, tier2, unrecognized, messy INTO NAME metric VALUE value),
    t AS (SELECT n.store, count(*) AS needed, count(t.store) AS linked, count(*) FILTER (t.store IS NULL) AS broken FROM (SELECT DISTINCT store, design, src, recipe, step FROM d WHERE tier = 2) n LEFT JOIN (SELECT DISTINCT store, design, dst, recipe, step FROM d WHERE tier = 1) t ON t.store = n.store AND t.design = n.design AND t.dst = n.src AND t.recipe = n.recipe AND t.step = n.step GROUP BY 1),
    c AS (UNPIVOT (SELECT * FROM t) ON needed, linked, broken INTO NAME metric VALUE value)
    SELECT 'sets' AS section, tier::VARCHAR AS item, metric, value FROM a UNION ALL SELECT 'stores', store, metric, value FROM b UNION ALL SELECT 'links', store, metric, value FROM c UNION ALL SELECT 'gaps', dst, 'missing', count(*) FROM gaps GROUP BY dst""",
    "stores",
)
def rep16(spark: SparkSession, sf: str) -> DataFrame:
    return audit.reconciliation(_parsed(spark, sf))
