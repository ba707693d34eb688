"""The driver's tables seen as tables of the domain, each as DataFrames and as DuckDB SQL.

An order is a provenance row, its customer's nation a design; a supplier's line items are the gates of a graph. Gaps in
the stores and messy names are what the audit operators look for, so some keys are left out of a store on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelake.functions import names, rng, scalars


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    design = F.lower(F.replace("n_name", F.lit("_"), F.lit("")))
    algorithm = F.element_at(F.array(*map(F.lit, names.ALGORITHMS)), (F.col("o_custkey") % 4 + 1).cast("int"))
    key = rows.select(
        F.col("o_orderkey").alias("sample_id"),
        design.alias("design"),
        (F.col("o_custkey") % 200).cast("int").alias("recipe_id"),
        (F.col("o_orderkey") % 21 + 1).cast("int").alias("step_id"),
        algorithm.alias("algorithm"),
        (F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)).cast("int").alias("tier_id"),
        (1000 + F.col("o_custkey") % 500).alias("pre_nodes"),
        (1000 + F.col("o_custkey") % 500 - (F.col("o_orderkey") % 7) * 10).alias("post_nodes"),
        (8 + F.col("o_custkey") % 32).alias("num_pi"),
        (1 + F.col("o_orderkey") % 16).alias("num_po"),
        F.when(F.col("o_orderkey") % 97 != 0, 5 + F.col("o_orderkey") % 40).alias("level"),
    )
    tail = F.concat(F.lit("syn"), F.col("recipe_id").cast("string"), F.lit("_step"), F.col("step_id").cast("string"), F.lit(".pt"))
    root = F.lit("/gpfs/scratch1/shared/graphs/")
    path = F.when(F.col("tier_id") == 1, F.concat(root, F.lit("tier1/"), "algorithm", F.lit("/"), "design", F.lit("/"), "design", F.lit("_"), "algorithm", F.lit("_tier1_"), tail)).otherwise(
        F.concat(root, F.lit("tier0/"), "design", F.lit("/"), "design", F.lit("_"), tail)
    )
    return key.withColumn("graph_path", path).withColumn("target", scalars.relative_reduction(F.col("pre_nodes"), F.col("post_nodes")))


SAMPLES = """fx_samples AS MATERIALIZED (
  SELECT *, round(CASE WHEN pre_nodes > 0 THEN (pre_nodes - post_nodes)::DOUBLE / pre_nodes ELSE 0.0::DOUBLE END, 4) AS target,
    CASE WHEN tier_id = 1 THEN '/gpfs/scratch1/shared/graphs/tier1/' || algorithm || '/' || design || '/' || design || '_' || algorithm || '_tier1_syn' || recipe_id || '_step' || step_id || '.pt'
         ELSE '/gpfs/scratch1/shared/graphs/tier0/' || design || '/' || design || '_syn' || recipe_id || '_step' || step_id || '.pt' END AS graph_path
  FROM (SELECT o_orderkey AS sample_id, lower(replace(n_name, '_', '')) AS design, (o_custkey % 200)::INT AS recipe_id, (o_orderkey % 21 + 1)::INT AS step_id,
      ['Orchestrate', 'Deepsyn', 'Syn4', 'C2RS'][(o_custkey % 4 + 1)::INT] AS algorithm, (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END)::INT AS tier_id,
      1000 + o_custkey % 500 AS pre_nodes, 1000 + o_custkey % 500 - (o_orderkey % 7) * 10 AS post_nodes, 8 + o_custkey % 32 AS num_pi, 1 + o_orderkey % 16 AS num_po,
      CASE WHEN o_orderkey % 97 <> 0 THEN 5 + o_orderkey % 40 END AS level
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey))"""


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three tiers; about one in twenty is left out, so that parents are missing and counts don't agree."""
    base = samples(spark, sf_dir).groupBy("design", "recipe_id", "step_id").agg(F.max("pre_nodes").alias("n0"), F.max("num_pi").alias("num_pi"), F.max("num_po").alias("num_po"), F.max("level").alias("d0"))
    algorithms = F.array(*[F.struct(F.lit(a).alias("name"), F.lit(i).cast("long").alias("i")) for i, a in enumerate(names.ALGORITHMS, 1)])
    mix = F.col("recipe_id") * 31 + F.col("step_id") * 7
    one = base.withColumn("src", F.explode(algorithms))
    n1 = F.col("n0") - 10 * ((mix + F.col("src.i")) % 7)
    d1 = F.col("d0") + 1 - (mix + F.col("src.i")) % 5
    two = one.withColumn("dst", F.explode(algorithms)).where("src.name != dst.name")
    hop = mix + F.col("src.i") * 5 + F.col("dst.i")
    n2 = n1 - 5 * (hop % 4) + F.when(hop % 11 == 0, 30).otherwise(0)
    d2 = d1 + 1 - hop % 3
    stem = F.concat(F.lit("syn"), F.col("recipe_id").cast("string"), F.lit("_step"), F.col("step_id").cast("string"), F.lit(".aig"))

    def rows(df: DataFrame, tier: int, algorithm, design, nodes, depth, before, depth_before, path) -> DataFrame:
        return df.select(
            path.alias("file_path"),
            F.col("design").alias("root_design"),
            design.alias("design"),
            "recipe_id",
            "step_id",
            F.lit(tier).alias("tier_id"),
            algorithm.alias("algorithm"),
            nodes.cast("long").alias("nodes"),
            F.lit(0).cast("long").alias("edges"),
            "num_pi",
            "num_po",
            depth.cast("long").alias("depth"),
            scalars.relative_reduction(before, nodes).alias("optimizability"),
            scalars.relative_reduction(depth_before, depth).alias("depth_optimizability"),
        )

    d, lit = F.col("design"), F.lit
    t0 = rows(base, 0, lit(""), d, F.col("n0"), F.col("d0"), F.col("n0"), F.col("d0"), F.concat(lit("base_aigs/"), d, lit("/tier0/"), d, lit("_"), stem))
    t1 = rows(one, 1, F.col("src.name"), d, n1, d1, F.col("n0"), F.col("d0"), F.concat(lit("base_aigs/"), d, lit("/tier1/"), F.col("src.name"), lit("/"), d, lit("_"), F.col("src.name"), lit("_tier1_"), stem))
    t2 = rows(two, 2, F.col("dst.name"), F.concat(d, lit("_"), F.col("src.name")), n2, d2, n1, d1, F.concat(lit("base_aigs/"), d, lit("/tier2/"), F.col("dst.name"), lit("/"), d, lit("_"), F.col("src.name"), lit("_"), F.col("dst.name"), lit("_tier2_"), stem))
    return t0.unionByName(t1).unionByName(t2).where(rng.uniform("gap", "file_path") >= 0.05)


MASTER = """fx_base AS (SELECT design, recipe_id, step_id, max(pre_nodes) AS n0, max(num_pi) AS num_pi, max(num_po) AS num_po, max(level) AS d0 FROM fx_samples GROUP BY ALL),
fx_algos AS (SELECT * FROM (VALUES ('Orchestrate', 1::BIGINT), ('Deepsyn', 2::BIGINT), ('Syn4', 3::BIGINT), ('C2RS', 4::BIGINT)) t(name, i)),
fx_one AS (SELECT b.*, s.name AS src, s.i AS si, n0 - 10 * ((recipe_id * 31 + step_id * 7 + s.i) % 7) AS n1, d0 + 1 - (recipe_id * 31 + step_id * 7 + s.i) % 5 AS d1 FROM fx_base b CROSS JOIN fx_algos s),
fx_two AS (SELECT o.*, a.name AS dst, n1 - 5 * ((recipe_id * 31 + step_id * 7 + si * 5 + a.i) % 4) + CASE WHEN (recipe_id * 31 + step_id * 7 + si * 5 + a.i) % 11 = 0 THEN 30 ELSE 0 END AS n2,
    d1 + 1 - (recipe_id * 31 + step_id * 7 + si * 5 + a.i) % 3 AS d2 FROM fx_one o JOIN fx_algos a ON a.name <> o.src),
fx_every AS (
  SELECT 'base_aigs/' || design || '/tier0/' || design || '_syn' || recipe_id || '_step' || step_id || '.aig' AS file_path, design AS root_design, design, recipe_id, step_id, 0 AS tier_id, '' AS algorithm, n0 AS nodes, 0::BIGINT AS edges, num_pi, num_po, d0 AS depth, n0 AS before, d0 AS depth_before FROM fx_base
  UNION ALL SELECT 'base_aigs/' || design || '/tier1/' || src || '/' || design || '_' || src || '_tier1_syn' || recipe_id || '_step' || step_id || '.aig', design, design, recipe_id, step_id, 1, src, n1, 0, num_pi, num_po, d1, n0, d0 FROM fx_one
  UNION ALL SELECT 'base_aigs/' || design || '/tier2/' || dst || '/' || design || '_' || src || '_' || dst || '_tier2_syn' || recipe_id || '_step' || step_id || '.aig', design, design || '_' || src, recipe_id, step_id, 2, dst, n2, 0, num_pi, num_po, d2, n1, d1 FROM fx_two),
fx_master AS MATERIALIZED (SELECT * EXCLUDE (before, depth_before), round(CASE WHEN before > 0 THEN (before - nodes)::DOUBLE / before ELSE 0.0::DOUBLE END, 4) AS optimizability,
    round(CASE WHEN depth_before > 0 THEN (depth_before - depth)::DOUBLE / depth_before ELSE 0.0::DOUBLE END, 4) AS depth_optimizability
  FROM fx_every WHERE cast('0x' || substr(md5('gap:' || file_path), 1, 8) AS BIGINT) / 4294967296::DOUBLE >= 0.05)"""


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(store, path) of circuits, graphs and metadata: each lacks some keys, and some names carry junk."""
    rows = master(spark, sf_dir).select("file_path", "root_design", "tier_id", "algorithm")
    every = rows.withColumn("store", F.explode(F.array(*map(F.lit, ("aig", "pt", "csv")))))
    kept = every.where(rng.uniform("store", "store", "file_path") >= 0.03)
    messy = (rng.uniform("messy", "store", "file_path") < 0.02) & (F.col("tier_id") > 0)
    name = names.basename(F.col("file_path"))
    name = F.when(messy, F.regexp_replace(name, r"_tier([12])_", r"_tier$1_tmp_Qx7_")).otherwise(name)
    pt = F.concat_ws("/", F.lit("graphs"), F.concat(F.lit("tier"), F.col("tier_id").cast("string")), F.when(F.col("tier_id") == 1, F.col("algorithm")), F.col("root_design"), F.regexp_replace(name, r"\.aig$", ".pt"))
    return kept.select("store", F.when(F.col("store") == "pt", pt).otherwise(names.replace_basename(F.col("file_path"), name)).alias("path"))


STORES = r"""fx_names AS (SELECT *, store || ':' || file_path AS k FROM fx_master CROSS JOIN (VALUES ('aig'), ('pt'), ('csv')) t(store)),
fx_named AS (SELECT *, CASE WHEN tier_id > 0 AND cast('0x' || substr(md5('messy:' || k), 1, 8) AS BIGINT) / 4294967296::DOUBLE < 0.02
    THEN regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '_tier([12])_', '_tier\1_tmp_Qx7_') ELSE regexp_extract(file_path, '([^/]*)$', 1) END AS name
  FROM fx_names WHERE cast('0x' || substr(md5('store:' || k), 1, 8) AS BIGINT) / 4294967296::DOUBLE >= 0.03),
fx_stores AS MATERIALIZED (SELECT store, CASE WHEN store = 'pt' THEN concat_ws('/', 'graphs', 'tier' || tier_id, CASE WHEN tier_id = 1 THEN algorithm END, root_design, regexp_replace(name, '\.aig$', '.pt'))
    ELSE regexp_extract(file_path, '^(.*/)?[^/]*$', 1) || name END AS path FROM fx_named)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_name, design, algorithm, tier_id, content): optimizer logs of the master's tiers 1 and 2."""
    rows = master(spark, sf_dir).where("tier_id > 0 and depth is not null")
    line = lambda nodes, depth: F.format_string("x : i/o = %d/ %d  lat = 0  and = %d  lev = %d\n", F.col("num_pi"), F.col("num_po"), nodes, depth)
    broken = F.col("recipe_id") % 97 == 96
    content = F.concat(line(F.col("nodes") + 50, F.col("depth") + 3), F.when(broken, F.lit("")).otherwise(F.concat(F.lit("done\n"), line(F.col("nodes"), F.col("depth")))))
    return rows.select(F.regexp_replace(names.basename(F.col("file_path")), r"\.aig$", ".log").alias("log_name"), F.col("root_design").alias("design"), "algorithm", "tier_id", content.alias("content"))


LOGS = r"""fx_logs AS (SELECT regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\.aig$', '.log') AS log_name, root_design AS design, algorithm, tier_id,
    format(E'x : i/o = {}/ {}  lat = 0  and = {}  lev = {}\n', num_pi, num_po, nodes + 50, depth + 3) || CASE WHEN recipe_id % 97 = 96 THEN '' ELSE format(E'done\nx : i/o = {}/ {}  lat = 0  and = {}  lev = {}\n', num_pi, num_po, nodes, depth) END AS content
  FROM fx_master WHERE tier_id > 0 AND depth IS NOT NULL)"""

INPUTS, FIRST_GATE = 8, 8


def gates(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """(graph_id, gate, a, b, inv_a, inv_b): one graph a supplier, one AND a line item. Fanins have smaller ids. ``where``
    picks line items."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_quantity")
    every = read(spark, sf_dir, "lineitem")
    flags = (F.col("l_returnflag") == "R").alias("inv_a"), (F.col("l_linestatus") == "F").alias("inv_b")  # before the shuffle, where they are shorter
    rows = (every if where is None else every.where(where)).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_quantity", *flags).withColumn("g", F.row_number().over(order).cast("long"))
    fanin = lambda key: F.when(F.col(key) % F.col("g") == 0, 1 + F.col(key) % INPUTS).otherwise(FIRST_GATE + F.col(key) % F.col("g"))
    return rows.select(F.col("l_suppkey").alias("graph_id"), (FIRST_GATE + F.col("g")).alias("gate"), fanin("l_partkey").alias("a"), fanin("l_orderkey").alias("b"), "inv_a", "inv_b")


GATES = """fx_ordered AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate, l_quantity) AS g FROM lineitem),
fx_gates AS (SELECT l_suppkey AS graph_id, 8 + g AS gate, CASE WHEN l_partkey % g = 0 THEN 1 + l_partkey % 8 ELSE 8 + l_partkey % g END AS a, CASE WHEN l_orderkey % g = 0 THEN 1 + l_orderkey % 8 ELSE 8 + l_orderkey % g END AS b,
    l_returnflag = 'R' AS inv_a, l_linestatus = 'F' AS inv_b FROM fx_ordered)"""

TOPOLOGY = """fx_fanin AS (SELECT graph_id, a AS src, gate AS dst, inv_a AS inv, 0 AS port FROM fx_gates UNION ALL SELECT graph_id, b, gate, inv_b, 1 FROM fx_gates),
fx_sinks AS (SELECT g.graph_id, g.gate FROM fx_gates g WHERE NOT EXISTS (SELECT 1 FROM fx_fanin f WHERE f.graph_id = g.graph_id AND f.src = g.gate)),
fx_po AS (SELECT s.graph_id, s.gate, m.top + row_number() OVER (PARTITION BY s.graph_id ORDER BY s.gate) AS po FROM fx_sinks s JOIN (SELECT graph_id, max(gate) AS top FROM fx_gates GROUP BY 1) m USING (graph_id)),
fx_nodes AS (SELECT graph_id, gate AS node_id, 2 AS role FROM fx_gates UNION ALL SELECT graph_id, po, 3 FROM fx_po
  UNION ALL SELECT graph_id, n, CASE WHEN n = 0 THEN 0 ELSE 1 END FROM (SELECT DISTINCT graph_id FROM fx_gates), (SELECT range AS n FROM range(9))),
fx_edges AS (SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY dst, port) - 1 AS edge_id, src, dst, inv FROM (SELECT * FROM fx_fanin UNION ALL SELECT graph_id, gate, po, false, 0 FROM fx_po))"""

LEVELS = """fx_levels AS (WITH RECURSIVE walk(graph_id, node_id, level) AS (
    SELECT graph_id, node_id, 0 FROM fx_nodes WHERE role < 2
    UNION SELECT w.graph_id, e.dst, w.level + 1 FROM walk w JOIN fx_edges e ON e.graph_id = w.graph_id AND e.src = w.node_id)
  SELECT graph_id, node_id, max(level)::BIGINT AS level FROM walk GROUP BY ALL)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_returnflag").alias("run_label"), F.when(F.col("l_linestatus") == "O", "test").otherwise("val").alias("split"), F.col("l_orderkey").alias("graph_id"), F.col("l_partkey").alias("num_nodes"), (2 * F.col("l_partkey") + 1).alias("num_edges"), F.col("l_discount").alias("target"), F.col("l_tax").alias("prediction"))


PREDICTIONS = """fx_predictions AS (SELECT l_returnflag AS run_label, CASE WHEN l_linestatus = 'O' THEN 'test' ELSE 'val' END AS split, l_orderkey AS graph_id, l_partkey AS num_nodes, 2 * l_partkey + 1 AS num_edges, l_discount AS target, l_tax AS prediction FROM lineitem)"""


def per_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark rows of three runs; A is the run on whole graphs."""
    rows = read(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_returnflag") == "A", "Orchestrate").when(F.col("l_returnflag") == "N", "Orchestrate_partition_random").otherwise("Orchestrate_sparsification_pagerank")
    return rows.select(label.alias("run_label"), F.col("l_partkey").alias("graph_id"), (F.col("l_quantity") / 10.0).alias("step_time_s"), F.col("l_extendedprice").alias("vram_mb"), F.col("l_orderkey").alias("num_nodes"), (2 * F.col("l_orderkey")).alias("num_edges"), F.when(F.col("l_tax") > 0, F.col("l_extendedprice") * (1 + F.col("l_tax"))).otherwise(F.lit(float("nan"))).alias("reserved_mb"))


PER_GRAPH = """fx_per_graph AS (SELECT CASE l_returnflag WHEN 'A' THEN 'Orchestrate' WHEN 'N' THEN 'Orchestrate_partition_random' ELSE 'Orchestrate_sparsification_pagerank' END AS run_label, l_partkey AS graph_id, l_quantity / 10.0::DOUBLE AS step_time_s,
    l_extendedprice AS vram_mb, l_orderkey AS num_nodes, 2 * l_orderkey AS num_edges, CASE WHEN l_tax > 0 THEN l_extendedprice * (1 + l_tax) END AS reserved_mb FROM lineitem)"""


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training row a run: label, reduction and method (null for the run on whole graphs)."""
    runs = per_graph(spark, sf_dir).select("run_label").distinct()
    parsed = runs.withColumn("c", scalars.parsed_run_label(F.col("run_label")))
    return parsed.select("run_label", F.col("c.kind").alias("kind"), F.col("c.method").alias("method"))


CONFIGS = """fx_configs AS (SELECT DISTINCT run_label, CASE WHEN run_label LIKE '%\\_partition\\_%' ESCAPE '\\' THEN 'partition' WHEN run_label LIKE '%\\_sparsification\\_%' ESCAPE '\\' THEN 'sparsification' ELSE 'none' END AS kind,
    nullif(regexp_extract(run_label, '_(?:partition|sparsification)_(.*)$', 1), '') AS method FROM fx_per_graph)""".replace("\\\\", "\\")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events")
    state = F.when(F.col("event_type").isin("purchase", "signup", "view"), "COMPLETE").when(F.col("event_type") == "error", "FAIL").otherwise("PRUNED")
    texts = ["CUDA out of memory. Tried to allocate", "HP Memory Guard pruned batch", "unable to mmap 512 bytes", "DataLoader worker (pid 7) is killed by signal: Killed", "an illegal memory access was encountered", "worker oom", "shape mismatch", "CUDA oom while packing", "DataLoader worker exited unexpectedly", "std::bad_alloc: out of memory"]
    message = F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 10 + 1).cast("int"))
    return rows.select(F.col("event_id").alias("trial"), "user_id", state.alias("state"), F.col("value"), message.alias("message"))


TRIALS = """fx_trials AS (SELECT event_id AS trial, user_id, CASE WHEN event_type IN ('purchase', 'signup', 'view') THEN 'COMPLETE' WHEN event_type = 'error' THEN 'FAIL' ELSE 'PRUNED' END AS state, value,
    ['CUDA out of memory. Tried to allocate', 'HP Memory Guard pruned batch', 'unable to mmap 512 bytes', 'DataLoader worker (pid 7) is killed by signal: Killed', 'an illegal memory access was encountered', 'worker oom', 'shape mismatch', 'CUDA oom while packing', 'DataLoader worker exited unexpectedly', 'std::bad_alloc: out of memory'][(event_id % 10 + 1)::INT] AS message FROM events)"""

#: What each fixture's SQL stands on.
PARTS = {
    "samples": [SAMPLES],
    "master": [SAMPLES, MASTER],
    "stores": [SAMPLES, MASTER, STORES],
    "logs": [SAMPLES, MASTER, LOGS],
    "gates": [GATES],
    "topology": [GATES, TOPOLOGY],
    "levels": [GATES, TOPOLOGY, LEVELS],
    "predictions": [PREDICTIONS],
    "per_graph": [PER_GRAPH],
    "configs": [PER_GRAPH, CONFIGS],
    "trials": [TRIALS],
}


def sql(body: str, *parts: str) -> str:
    """DuckDB SQL of a query over fixtures; ``body`` may begin with further common table expressions (``, x AS ..``)."""
    ctes = list(dict.fromkeys(c for p in parts for c in PARTS[p]))
    body = body.strip()
    return ("WITH RECURSIVE " + ",\n".join(ctes) + ("\n" if body.startswith(",") or not ctes else "\n") + body) if ctes else body
