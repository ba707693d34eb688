"""Queries over graphs: topology, features, reductions, sampling and batching, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.functions import names, rng, scalars
from gatelake.operators import passes, reduction, sampling, topology
from gatelake.plans import fixtures as fx

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None, *parts: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = fx.sql(sql, *parts)
        return f

    return add


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    gates = fx.gates(spark, sf)
    return topology.nodes(gates), topology.edges(gates)


def _levelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = _graph(spark, sf)
    return nodes, edges, topology.levels(nodes, edges)


def _by_size(spark: SparkSession, sf: str, passed, joined) -> DataFrame:
    """``passed(gates)`` for graphs that a task holds whole, and ``joined(gates)`` for those too large for that."""
    size = fx.read(spark, sf, "lineitem").where("l_suppkey is not null").groupBy("l_suppkey").count()
    large = [r.l_suppkey for r in size.where(F.col("count") > passes.LARGE).collect()]
    if not large:
        return passed(fx.gates(spark, sf))
    there = F.coalesce(F.col("l_suppkey").isin(large), F.lit(False))
    return passed(fx.gates(spark, sf, ~there)).unionByName(joined(fx.gates(spark, sf, there)))


def _u(seed: str, *keys: str) -> str:
    return f"cast('0x' || substr(md5('{seed}:' || {' || chr(58) || '.join(keys)}), 1, 8) AS BIGINT)"


# Topology and features


@register("grf01_nodes", "SELECT graph_id, node_id, role FROM fx_nodes", "topology")
def grf01n(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf)[0]


@register("grf01_edges", "SELECT graph_id, edge_id, src, dst, inv FROM fx_edges", "topology")
def grf01e(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf)[1]


@register("grf02_levels", "SELECT graph_id, node_id, level FROM fx_levels", "levels")
def grf02(spark: SparkSession, sf: str) -> DataFrame:
    return _levelled(spark, sf)[2]


@register("grf02_depth_by_graph", "SELECT graph_id, max(level) AS depth, count(*) AS n, sum(level)::BIGINT AS total FROM fx_levels GROUP BY 1", "levels")
def grf02d(spark: SparkSession, sf: str) -> DataFrame:
    return _levelled(spark, sf)[2].groupBy("graph_id").agg(F.max("level").alias("depth"), F.count("*").alias("n"), F.sum("level").alias("total"))


@register("grf03_input_paths", None)
def grf03(spark: SparkSession, sf: str) -> DataFrame:
    return passes.input_paths(fx.gates(spark, sf))


_LOCAL = """, o AS (SELECT DISTINCT graph_id, src, dst FROM fx_edges WHERE src <> dst), t AS (SELECT DISTINCT a.graph_id, a.src, b.dst FROM o a JOIN o b ON a.graph_id = b.graph_id AND a.dst = b.src WHERE a.src <> b.dst),
r AS (SELECT graph_id, src, dst, min(d) AS d FROM (SELECT *, 1 AS d FROM o UNION ALL SELECT *, 2 FROM t) GROUP BY ALL), s AS (SELECT graph_id, src AS node_id, sum(d)::BIGINT AS local_sum FROM r GROUP BY ALL)"""


@register("grf04_local_sums", _LOCAL + " SELECT n.graph_id, n.node_id, coalesce(s.local_sum, 0)::BIGINT AS local_sum FROM fx_nodes n LEFT JOIN s USING (graph_id, node_id)", "topology")
def grf04(spark: SparkSession, sf: str) -> DataFrame:
    return _by_size(spark, sf, passes.local_sums, lambda gates: topology.local_sums(topology.nodes(gates), topology.edges(gates)))


@register("grf05_encodings", _LOCAL + " SELECT l.graph_id, l.node_id, round(ln(1 + l.level), 8) AS level, round(ln(1 + coalesce(s.local_sum, 0)), 8) AS local_sum FROM fx_levels l LEFT JOIN s USING (graph_id, node_id)", "levels")
def grf05(spark: SparkSession, sf: str) -> DataFrame:
    rows = passes.levels_and_sums(fx.gates(spark, sf))
    return rows.select("graph_id", "node_id", *[F.round(topology.encoded(c), 8).alias(c) for c in ("level", "local_sum")])


_DEGREE = ", g AS (SELECT graph_id, dst AS node_id, count(*) AS degree FROM fx_edges GROUP BY ALL)"


@register("agg38_in_degrees", _DEGREE + " SELECT * FROM g", "topology")
def agg38(spark: SparkSession, sf: str) -> DataFrame:
    return topology.in_degrees(_graph(spark, sf)[1])


@register("grf06_edge_weights", _DEGREE + " SELECT e.graph_id, e.edge_id, e.src, e.dst, round(coalesce(1 / sqrt(a.degree), 0.0::DOUBLE) * coalesce(1 / sqrt(b.degree), 0.0::DOUBLE), 8) AS weight FROM fx_edges e LEFT JOIN g a ON a.graph_id = e.graph_id AND a.node_id = e.src LEFT JOIN g b ON b.graph_id = e.graph_id AND b.node_id = e.dst", "topology")
def grf06(spark: SparkSession, sf: str) -> DataFrame:
    return topology.edge_weights(_graph(spark, sf)[1]).withColumn("weight", F.round("weight", 8))


@register("grf21_undirected", ", b AS (SELECT graph_id, src AS u, dst AS v FROM fx_edges WHERE src <> dst UNION ALL SELECT graph_id, dst, src FROM fx_edges WHERE src <> dst) SELECT graph_id, u, v, count(*) AS w FROM b GROUP BY ALL", "topology")
def grf21(spark: SparkSession, sf: str) -> DataFrame:
    return topology.undirected(_graph(spark, sf)[1])


# Sparsifiers

_KEEP = f", m AS (SELECT graph_id, edge_id, src, dst, inv, {_u('42', 'graph_id', 'edge_id')} / 4294967296::DOUBLE >= 0.3 AS keep FROM fx_edges)"


@register("grf07_edge_dropout", _KEEP + " SELECT graph_id, edge_id, keep FROM m", "topology")
def grf07(spark: SparkSession, sf: str) -> DataFrame:
    return reduction.dropped_edges(_graph(spark, sf)[1])


@register("grf08_spanning_forest", None)
def grf08(spark: SparkSession, sf: str) -> DataFrame:
    return passes.forest_mask(fx.gates(spark, sf))


@register("grf09_pagerank", None)
def grf09(spark: SparkSession, sf: str) -> DataFrame:
    return reduction.pagerank(*_graph(spark, sf))


def _rounds(n: int) -> str:
    out = ", lk AS (SELECT DISTINCT graph_id, src, dst FROM fx_edges), od AS (SELECT graph_id, src AS node_id, count(*) AS o FROM lk GROUP BY ALL), nn AS (SELECT graph_id, count(*) AS n FROM fx_nodes GROUP BY 1), r0 AS (SELECT v.graph_id, v.node_id, o, n, 1.0::DOUBLE / n AS rank FROM fx_nodes v JOIN nn USING (graph_id) LEFT JOIN od USING (graph_id, node_id))"
    for i in range(n):
        out += f""", r{i + 1} AS (SELECT r.graph_id, r.node_id, r.o, r.n, 0.85::DOUBLE * (coalesce(g.got, 0.0::DOUBLE) + coalesce(d.dead, 0.0::DOUBLE) / r.n) + (1 - 0.85::DOUBLE) / r.n AS rank FROM r{i} r
      LEFT JOIN (SELECT k.graph_id, k.dst AS node_id, sum(s.rank / s.o) AS got FROM lk k JOIN r{i} s ON s.graph_id = k.graph_id AND s.node_id = k.src GROUP BY ALL) g USING (graph_id, node_id) LEFT JOIN (SELECT graph_id, sum(rank) AS dead FROM r{i} WHERE o IS NULL GROUP BY 1) d USING (graph_id))"""
    return out + f" SELECT graph_id, node_id, round(rank, 10) AS rank FROM r{n}"


@register("grf09_pagerank_rounds", _rounds(3), "topology")
def grf09r(spark: SparkSession, sf: str) -> DataFrame:
    rows = _by_size(spark, sf, lambda gates: passes.pagerank_rounds(gates, 3), lambda gates: reduction.pagerank_rounds(topology.nodes(gates), topology.edges(gates), 3))
    return rows.withColumn("rank", F.round("rank", 10))


@register("win06_top_fraction", _DEGREE + ", w AS (SELECT n.graph_id, n.node_id, row_number() OVER (PARTITION BY n.graph_id ORDER BY coalesce(degree, 0) DESC, n.node_id) AS r, count(*) OVER (PARTITION BY n.graph_id) AS n FROM fx_nodes n LEFT JOIN g USING (graph_id, node_id)) SELECT graph_id, node_id, r <= greatest(1, floor(n * 0.8::DOUBLE)) AS keep FROM w", "topology")
def win06(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _graph(spark, sf)
    scores = nodes.join(topology.in_degrees(edges), ["graph_id", "node_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return reduction.top_fraction(scores, "degree")


@register("grf10_gates_only", "SELECT graph_id, node_id, role IN (0, 2) AS keep FROM fx_nodes", "topology")
def grf10(spark: SparkSession, sf: str) -> DataFrame:
    return reduction.gates_only(_graph(spark, sf)[0])


@register("grf11_kept_edges", _KEEP + " SELECT graph_id, edge_id, src, dst, inv FROM m WHERE keep", "topology")
def grf11(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _graph(spark, sf)
    return reduction.sparsify(nodes, edges, "random_edge_dropout")[1]


_INDUCED = ", k AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS new_id FROM fx_nodes WHERE role IN (0, 2))"


@register("grf12_induced_graph", _INDUCED + " SELECT e.graph_id, e.edge_id, a.new_id AS src, b.new_id AS dst, e.inv FROM fx_edges e JOIN k a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN k b ON b.graph_id = e.graph_id AND b.node_id = e.dst", "topology")
def grf12(spark: SparkSession, sf: str) -> DataFrame:
    return reduction.sparsify(*_graph(spark, sf), "and_gate_only")[1]


@register("win01_renumbered", _INDUCED + " SELECT graph_id, node_id, new_id FROM k", "topology")
def win01(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _graph(spark, sf)[0]
    return reduction.renumbered(nodes, reduction.gates_only(nodes)).select("graph_id", "node_id", "new_id")


@register(
    "grf13_batched_masks",
    _INDUCED + ", c AS (SELECT graph_id, graph_id % 4 AS batch, count(*) AS n FROM k GROUP BY ALL) SELECT batch, graph_id, n, coalesce(sum(n) OVER (PARTITION BY batch ORDER BY graph_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM c",
    "topology",
)
def grf13(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _graph(spark, sf)[0]
    kept = reduction.renumbered(nodes, reduction.gates_only(nodes)).groupBy("graph_id").agg(F.count("*").alias("n")).withColumn("batch", F.col("graph_id") % 4)
    return sampling.offsets(kept, "batch", "graph_id", "n")


@register("grf24_counts_after", ", c AS (SELECT graph_id, count(*) AS n, count(*) FILTER (role IN (0, 2)) AS kept FROM fx_nodes GROUP BY 1) SELECT graph_id, CASE WHEN graph_id % 2 = 0 THEN kept ELSE n END AS n_after FROM c", "topology")
def grf24(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _graph(spark, sf)[0]
    masked = reduction.gates_only(nodes).where("graph_id % 2 = 0").groupBy("graph_id").agg(F.count_if("keep").alias("kept"))
    return nodes.groupBy("graph_id").agg(F.count("*").alias("n")).join(masked, "graph_id", "left").select("graph_id", F.coalesce("kept", "n").alias("n_after"))


# Partitioners

_KS = ", n AS (SELECT graph_id, node_id, role, greatest(2, least(32, count(*) OVER (PARTITION BY graph_id) // 100))::INT AS k FROM fx_nodes)"
_RANDOM = _KS + f", p AS (SELECT graph_id, node_id, k, ({_u('42', 'graph_id', 'node_id')} % k)::INT AS part FROM n)"
_SLICES = ", n AS (SELECT graph_id, node_id, level, greatest(2, least(32, count(*) OVER (PARTITION BY graph_id) // 100))::INT AS k, count(*) OVER (PARTITION BY graph_id) AS c FROM fx_levels), p AS (SELECT graph_id, node_id, k, least(((row_number() OVER (PARTITION BY graph_id ORDER BY level, node_id) - 1) * k) // c, k - 1)::INT AS part FROM n)"


_TARGET = 100


def _with_k(nodes: DataFrame) -> DataFrame:
    return reduction.with_k(nodes, target=_TARGET)


@register("grf14_random_parts", _RANDOM + " SELECT graph_id, node_id, part, k FROM p", "topology")
def grf14(spark: SparkSession, sf: str) -> DataFrame:
    return reduction.random_parts(_with_k(_graph(spark, sf)[0]))


@register("grf15_level_slices", _SLICES + " SELECT graph_id, node_id, part, k FROM p", "levels")
def grf15(spark: SparkSession, sf: str) -> DataFrame:
    return reduction.level_slices(_with_k(_levelled(spark, sf)[2]))


@register("grf16_balanced_parts", None)
def grf16(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _graph(spark, sf)
    return reduction.balanced_parts(_with_k(nodes), edges)


@register("grf17_span_weights", "SELECT e.graph_id, e.edge_id, e.src, e.dst, floor(1 + 10 * abs(a.level - b.level))::BIGINT AS weight FROM fx_edges e JOIN fx_levels a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN fx_levels b ON b.graph_id = e.graph_id AND b.node_id = e.dst", "levels")
def grf17(spark: SparkSession, sf: str) -> DataFrame:
    return reduction.weighted(passes.level_spans(fx.gates(spark, sf)))


@register("grf17_span_parts", None)
def grf17p(spark: SparkSession, sf: str) -> DataFrame:
    return passes.span_parts(fx.gates(spark, sf), _TARGET)


@register("grf18_dynamic_k", "SELECT graph_id, greatest(2, least(32, count(*) // 100))::INT AS k, greatest(2, least(32, count(*) // 10000))::INT AS default_k FROM fx_nodes GROUP BY 1", "topology")
def grf18(spark: SparkSession, sf: str) -> DataFrame:
    n = _graph(spark, sf)[0].groupBy("graph_id").agg(F.count("*").alias("n"))
    return n.select("graph_id", scalars.dynamic_k(F.col("n"), 100).alias("k"), scalars.dynamic_k(F.col("n")).alias("default_k"))


_ENDS = ", e AS (SELECT e.*, a.part AS ps, b.part AS pd FROM fx_edges e JOIN p a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN p b ON b.graph_id = e.graph_id AND b.node_id = e.dst)"


@register("grf19_within_parts", _SLICES + _ENDS + " SELECT graph_id, edge_id, src, dst, inv, ps AS part FROM e WHERE ps = pd", "levels")
def grf19(spark: SparkSession, sf: str) -> DataFrame:
    return passes.within_slices(fx.gates(spark, sf), _TARGET)


@register("grf20_random_within", _RANDOM + _ENDS + " SELECT graph_id, edge_id, src, dst, inv, ps AS part FROM e WHERE ps = pd", "topology")
def grf20(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _graph(spark, sf)
    return reduction.within_parts(edges, reduction.random_parts(_with_k(nodes)))


_STATS = """, sl AS (SELECT graph_id, k, unnest(range(k))::INT AS part FROM (SELECT DISTINCT graph_id, k FROM p)), sz AS (SELECT graph_id, part, count(*) AS n FROM p GROUP BY ALL), fu AS (SELECT graph_id, k, coalesce(n, 0) AS n FROM sl LEFT JOIN sz USING (graph_id, part)),
st AS (SELECT graph_id, max(k) AS k, count(*) FILTER (n > 0) AS nonempty, round(avg(n), 6) AS mean_size, max(n) AS max_size, min(n) AS min_size, round(stddev_samp(n), 6) AS std_size FROM fu GROUP BY 1), cu AS (SELECT graph_id, round(count(*) FILTER (ps <> pd) / count(*)::DOUBLE, 6) AS edge_cut FROM e GROUP BY 1)"""


@register("agg35_partition_stats", _RANDOM + _ENDS + _STATS + " SELECT st.*, coalesce(edge_cut, 0.0::DOUBLE) AS edge_cut FROM st LEFT JOIN cu USING (graph_id)", "topology")
def agg35(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _graph(spark, sf)
    return reduction.partition_stats(reduction.random_parts(_with_k(nodes)), edges)


_RETAIN = ", q AS (SELECT graph_id, round(count(*) FILTER (role IN (0, 2)) / count(*)::DOUBLE, 6) AS node_retention FROM fx_nodes GROUP BY 1), qe AS (SELECT e.graph_id, round(count(*) FILTER (a.role IN (0, 2) AND b.role IN (0, 2)) / count(*)::DOUBLE, 6) AS edge_retention FROM fx_edges e JOIN fx_nodes a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN fx_nodes b ON b.graph_id = e.graph_id AND b.node_id = e.dst GROUP BY 1)"


def _retained(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _graph(spark, sf)
    return reduction.retention(nodes, edges, *reduction.sparsify(nodes, edges, "and_gate_only"))


@register("agg36_retention", _RETAIN + " SELECT graph_id, node_retention, edge_retention FROM q JOIN qe USING (graph_id)", "topology")
def agg36(spark: SparkSession, sf: str) -> DataFrame:
    return _retained(spark, sf)


@register("agg37_retention_summary", _RETAIN + ", l AS (SELECT 'node_retention' AS metric, node_retention AS value FROM q UNION ALL SELECT 'edge_retention', edge_retention FROM qe) SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max FROM l GROUP BY 1", "topology")
def agg37(spark: SparkSession, sf: str) -> DataFrame:
    return reduction.summary(_retained(spark, sf), "node_retention", "edge_retention")


@register("jon19_missing_masks", "SELECT DISTINCT graph_id FROM fx_nodes WHERE graph_id % 5 = 0", "topology")
def jon19(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _graph(spark, sf)[0]
    masks = reduction.gates_only(nodes).where("graph_id % 5 != 0").withColumn("algo", F.lit("and_gate_only"))
    return reduction.missing_masks(nodes, masks, "and_gate_only")


@register("src19_later_masks", "SELECT 'and_gate_only' AS algo, graph_id, node_id AS item_id, CASE WHEN node_id % 2 = 0 THEN NOT role IN (0, 2) ELSE role IN (0, 2) END AS keep FROM fx_nodes", "topology")
def src19(spark: SparkSession, sf: str) -> DataFrame:
    first = reduction.gates_only(_graph(spark, sf)[0]).select(F.lit("and_gate_only").alias("algo"), "graph_id", F.col("node_id").alias("item_id"), "keep", F.lit(1).alias("chunk"))
    second = first.where("item_id % 2 = 0").withColumn("keep", ~F.col("keep")).withColumn("chunk", F.lit(2))
    return reduction.later_masks(first.unionByName(second))


@register("win08_part_offsets", ", c AS (SELECT graph_id, graph_id % 4 AS batch, greatest(2, least(32, count(*) // 100))::INT AS k FROM fx_nodes GROUP BY ALL) SELECT batch, graph_id, k, coalesce(sum(k) OVER (PARTITION BY batch ORDER BY graph_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM c", "topology")
def win08(spark: SparkSession, sf: str) -> DataFrame:
    n = _graph(spark, sf)[0].groupBy("graph_id").agg(F.count("*").alias("n"))
    return sampling.offsets(n.select((F.col("graph_id") % 4).alias("batch"), "graph_id", scalars.dynamic_k(F.col("n"), 100).alias("k")), "batch", "graph_id", "k")


@register("ext_coarsened_nodes", _SLICES + ", r AS (SELECT p.*, v.role FROM p JOIN fx_nodes v USING (graph_id, node_id))" + _ENDS + " SELECT graph_id, part, count(*) AS size, count(*) FILTER (role = 0) AS n_const, count(*) FILTER (role = 1) AS n_pi, count(*) FILTER (role = 2) AS n_and, count(*) FILTER (role = 3) AS n_po, coalesce(any_value(l.n), 0) AS n_loops FROM r LEFT JOIN (SELECT graph_id, ps AS part, count(*) AS n FROM e WHERE ps = pd GROUP BY ALL) l USING (graph_id, part) GROUP BY ALL", "levels")
def ext_n(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges, levels = _levelled(spark, sf)
    return reduction.coarsened(nodes, edges, reduction.level_slices(_with_k(levels)))[0]


@register("ext_coarsened_edges", _SLICES + _ENDS + " SELECT graph_id, ps, pd, count(*) FILTER (NOT inv) AS n_plain, count(*) FILTER (inv) AS n_inverted FROM e WHERE ps <> pd GROUP BY ALL", "levels")
def ext_e(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges, levels = _levelled(spark, sf)
    return reduction.coarsened(nodes, edges, reduction.level_slices(_with_k(levels)))[1]


# Sampling, splitting, batching


@register("smp01_sample", f"SELECT sample_id, design FROM fx_samples ORDER BY {_u('42', 'sample_id')}, sample_id LIMIT 500", "samples")
def smp01(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample(fx.samples(spark, sf), "sample_id", 500, 42).select("sample_id", "design")


@register("win04_size_buckets", "SELECT sample_id, (ntile(10) OVER (ORDER BY pre_nodes, sample_id) - 1)::INT AS bucket FROM fx_samples", "samples")
def win04(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.size_buckets(fx.samples(spark, sf), "pre_nodes", "sample_id").select("sample_id", "bucket")


@register("smp02_stratified", f", b AS (SELECT sample_id, pre_nodes, ntile(10) OVER (ORDER BY pre_nodes, sample_id) - 1 AS bucket FROM fx_samples) SELECT sample_id, pre_nodes FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {_u('7', 'sample_id')}, sample_id) AS r FROM b) WHERE r <= 20 + CASE WHEN bucket < 5 THEN 1 ELSE 0 END", "samples")
def smp02(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified(fx.samples(spark, sf), "sample_id", "pre_nodes", 205, 7).select("sample_id", "pre_nodes")


def _split(name: str, group: str, seed: int = 42) -> str:
    return f""", pg AS (SELECT graph_path AS path, min({group}) AS grp FROM fx_samples GROUP BY 1), rk AS (SELECT grp, row_number() OVER (ORDER BY {_u(str(seed), 'grp')}, grp) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM pg)),
    {name} AS (SELECT path, CASE WHEN r < greatest(1, floor(n * 0.8::DOUBLE)) THEN 'train' WHEN r < greatest(1, floor(n * 0.8::DOUBLE)) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM pg JOIN rk USING (grp))"""


RATIOS = (0.8, 0.1, 0.1)


@register("spl01_design_split", _split("s", "design") + " SELECT path, split FROM s", "samples")
def spl01d(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.grouped_split(fx.samples(spark, sf), names.design_of_path(F.col("graph_path")), "graph_path", 42, RATIOS)


@register("spl01_recipe_split", _split("s", "'syn' || recipe_id") + " SELECT path, split FROM s", "samples")
def spl01r(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.grouped_split(fx.samples(spark, sf), names.recipe_of_path(F.col("graph_path")), "graph_path", 42, RATIOS)


@register("spl01_random_split", _split("s", "graph_path") + " SELECT path, split FROM s", "samples")
def spl01p(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.grouped_split(fx.samples(spark, sf), F.col("graph_path"), "graph_path", 42, RATIOS)


@register("jon04_members", _split("s", "design") + " SELECT sample_id, graph_path FROM fx_samples WHERE graph_path IN (SELECT path FROM s WHERE split = 'test')", "samples")
def jon04(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.samples(spark, sf)
    return sampling.members(rows, "graph_path", spl01d(spark, sf), "test").select("sample_id", "graph_path")


@register("jon06_assigned", _split("s", "design") + " SELECT coalesce(split, 'none') AS split, count(*) AS n, round(avg(target), 8) AS mean_target FROM fx_samples LEFT JOIN (SELECT * FROM s WHERE split <> 'val') ON path = graph_path GROUP BY 1", "samples")
def jon06(spark: SparkSession, sf: str) -> DataFrame:
    rows = sampling.assigned(fx.samples(spark, sf), "graph_path", spl01d(spark, sf).where("split != 'val'"))
    return rows.groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(F.count("*").alias("n"), F.round(F.avg("target"), 8).alias("mean_target"))


@register("set08_overlap", _split("s", "design") + ", b AS (SELECT path FROM s WHERE split = 'train' INTERSECT SELECT path FROM s WHERE split = 'test') SELECT count(*) AS n FROM b", "samples")
def set08(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.overlap(spl01d(spark, sf), "train", "test").agg(F.count("*").alias("n"))


_POOLS = f", rp AS (SELECT path, row_number() OVER (ORDER BY {_u('3', 'path')}, path) - 1 AS r FROM (SELECT DISTINCT graph_path AS path FROM fx_samples)), pl AS (SELECT path, CASE WHEN r < 80 THEN 'pool0:train' WHEN r < 100 THEN 'pool0:val' WHEN r < 260 THEN 'pool1:train' WHEN r < 300 THEN 'pool1:val' END AS pool FROM rp)"


@register("spl04_tuning_pools", _POOLS + " SELECT path, pool FROM pl WHERE pool IS NOT NULL", "samples")
def spl04(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.tuning_pools(fx.samples(spark, sf), "graph_path", 3, (100, 200))


@register("jon05_held_out", _POOLS + " SELECT design, count(*) AS n FROM fx_samples WHERE graph_path NOT IN (SELECT path FROM pl WHERE pool IS NOT NULL) GROUP BY 1", "samples")
def jon05(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.held_out(fx.samples(spark, sf), "graph_path", spl04(spark, sf)).groupBy("design").agg(F.count("*").alias("n"))


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    sizes = _graph(spark, sf)[0].groupBy("graph_id").agg(F.count("*").alias("n"))
    return sampling.batch_plan(sizes, "graph_id", "n", 2000)


@register("bat03_epoch_order", f"SELECT b AS batch_id, row_number() OVER (ORDER BY {_u('45', 'b')}, b) - 1 AS at FROM (SELECT DISTINCT sample_id % 37 AS b FROM fx_samples)", "samples")
def bat03(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.shuffled(fx.samples(spark, sf).select((F.col("sample_id") % 37).alias("batch_id")), 42, 3)


@register(
    "bat05_memory_guard",
    """, t AS (SELECT sample_id % 50 AS batch_id, sample_id AS pos, pre_nodes * 64.0::DOUBLE * 3 * 4 + (2 * pre_nodes + num_po) * 64.0::DOUBLE AS tokens FROM fx_samples), r AS (SELECT *, sum(tokens) OVER (PARTITION BY batch_id ORDER BY pos) AS total FROM t)
    SELECT batch_id, min(pos) AS pos, min(total) AS total FROM r WHERE total > 2e7 GROUP BY 1""",
    "samples",
)
def bat05(spark: SparkSession, sf: str) -> DataFrame:
    c, lit = F.col, F.lit
    tokens = scalars.memory_tokens(c("pre_nodes"), 2 * c("pre_nodes") + c("num_po"), lit(64), lit(3), lit("cat"), lit("gcn"), lit(4), lit(1.0))
    rows = fx.samples(spark, sf).select((c("sample_id") % 50).alias("batch_id"), c("sample_id").alias("pos"), tokens.alias("tokens"))
    return sampling.guard(rows, "tokens", 2e7)


@register("rng_uniform", "SELECT sample_id, round(" + _u("42", "sample_id") + " / 4294967296::DOUBLE, 9) AS u FROM fx_samples", "samples")
def rng_uniform(spark: SparkSession, sf: str) -> DataFrame:
    return fx.samples(spark, sf).select("sample_id", F.round(rng.uniform(42, "sample_id"), 9).alias("u"))


@register("agg34_graph_sizes", "SELECT n.graph_id, n.n AS n_nodes, e.n AS n_edges FROM (SELECT graph_id, count(*) AS n FROM fx_nodes GROUP BY 1) n JOIN (SELECT graph_id, count(*) AS n FROM fx_edges GROUP BY 1) e USING (graph_id)", "topology")
def agg34(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _graph(spark, sf)
    return nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes")).join(edges.groupBy("graph_id").agg(F.count("*").alias("n_edges")), "graph_id")


@register("win10_pointers", ", c AS (SELECT graph_id, count(*) AS n FROM fx_nodes GROUP BY 1) SELECT graph_id, sum(n) OVER (ORDER BY graph_id)::BIGINT AS ptr FROM c", "topology")
def win10(spark: SparkSession, sf: str) -> DataFrame:
    sizes = _graph(spark, sf)[0].groupBy("graph_id").agg(F.count("*").alias("n")).withColumn("batch", F.lit(0))
    return sampling.offsets(sizes, "batch", "graph_id", "n").select("graph_id", (F.col("offset") + F.col("n")).alias("ptr"))


@register("src20_levels_or_computed", "SELECT graph_id, node_id, CASE WHEN node_id % 3 = 0 THEN level + 100 ELSE level END AS level FROM fx_levels", "levels")
def src20(spark: SparkSession, sf: str) -> DataFrame:
    from gatelake.sources import readers

    levels = _levelled(spark, sf)[2]
    stored = levels.where("node_id % 3 = 0").withColumn("level", F.col("level") + 100)
    return readers.levels_or_computed(stored, levels)


@register("spl05_exclusions", _POOLS + ", x AS (SELECT path, 0 AS document FROM pl WHERE pool LIKE 'pool0%' UNION ALL SELECT path, 1 FROM pl WHERE pool LIKE '%:train') SELECT path, min(document)::INT AS document FROM x GROUP BY 1", "samples")
def spl05(spark: SparkSession, sf: str) -> DataFrame:
    pools = spl04(spark, sf)
    return sampling.exclusions(pools.where("pool like 'pool0%'"), pools.where("pool like '%:train'"))


@register("smp05_audit_sample", f", a AS (SELECT * FROM fx_samples ORDER BY {_u('0', 'sample_id')}, sample_id LIMIT 200), g AS (SELECT sample_id, pre_nodes + CASE WHEN step_id = 21 THEN 5 ELSE 0 END AS counted FROM fx_samples) SELECT step_id = 21 AS last_step, count(*) AS n, count(*) FILTER (pre_nodes <> counted) AS n_wrong FROM a JOIN g USING (sample_id) GROUP BY 1", "samples")
def smp05(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.samples(spark, sf)
    counted = rows.select("sample_id", (F.col("pre_nodes") + F.when(F.col("step_id") == 21, 5).otherwise(0)).alias("counted"))
    audited = sampling.sample(rows, "sample_id", 200, 0).join(counted, "sample_id")
    return audited.groupBy((F.col("step_id") == 21).alias("last_step")).agg(F.count("*").alias("n"), F.count_if(F.col("pre_nodes") != F.col("counted")).alias("n_wrong"))
