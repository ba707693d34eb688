"""Queries of the remaining joins, aggregates, predictors, samples and checks, with the SQL that checks them.

Where a report of ``plans/evaluation`` shows an operator among others, the query here shows it alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.functions import names, scalars
from gatelake.operators import audit, baselines, lineage, message_passing, metrics, passes, quality, reduction, reports, sampling, topology
from gatelake.plans import corpus, evaluation, graphs
from gatelake.plans import fixtures as fx
from gatelake.sources import readers, scratch, sinks
from gatelake.streaming import incremental

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
C, L = F.col, F.lit


def register(name: str, sql: str | None, *parts: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = fx.sql(sql, *parts)
        return f

    return add


# Filters


@register("flt05_test_rows", ", p AS (SELECT run_label, CASE WHEN graph_id % 7 <> 0 THEN split END AS split FROM fx_predictions) SELECT run_label, count(*) AS n FROM p WHERE split = 'test' OR split IS NULL GROUP BY 1", "predictions")
def flt05(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.predictions(spark, sf).withColumn("split", F.when(C("graph_id") % 7 != 0, C("split")))
    return reports.of_test(rows).groupBy("run_label").agg(F.count("*").alias("n"))


@register("flt07_depth_only", "SELECT tier_id, algorithm, count(*) AS n FROM fx_master WHERE optimizability BETWEEN -1e-12 AND 1e-12 AND depth_optimizability > 0 GROUP BY ALL", "master")
def flt07(spark: SparkSession, sf: str) -> DataFrame:
    return quality.depth_only(fx.master(spark, sf)).groupBy("tier_id", "algorithm").agg(F.count("*").alias("n"))


@register("flt10_chosen_runs", ", r AS (SELECT graph_id, kind, method, CASE WHEN graph_id % 2 = 0 THEN 'cuda' ELSE 'cpu' END AS device FROM fx_per_graph JOIN fx_configs USING (run_label)) SELECT graph_id, count(*) AS n FROM r WHERE device = 'cuda' AND kind = 'none' AND method IS NULL GROUP BY 1", "per_graph", "configs")
def flt10(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.per_graph(spark, sf).join(fx.configs(spark, sf), "run_label").withColumn("device", F.when(C("graph_id") % 2 == 0, "cuda").otherwise("cpu"))
    return reports.only(rows, device="cuda", kind="none", method="").groupBy("graph_id").agg(F.count("*").alias("n"))


@register("flt11_prediction_files", "SELECT run_label AS source, count(*) AS n, round(sum(target), 6) AS target, round(sum(prediction), 6) AS prediction FROM fx_predictions WHERE run_label = 'A' GROUP BY 1", "predictions")
def flt11(spark: SparkSession, sf: str) -> DataFrame:
    """One whole file, one without predictions, and one without rows."""
    rows, paths = fx.predictions(spark, sf), {n: scratch.folder(spark, f"predictions-{n}") for n in ("A", "N", "R")}
    rows.where("run_label = 'A'").select("target", "prediction").write.option("header", "true").csv(paths["A"])
    rows.where("run_label = 'N'").select("target", "graph_id").write.option("header", "true").csv(paths["N"])
    rows.where("run_label = 'none'").select("target", "prediction").coalesce(1).write.option("header", "true").csv(paths["R"])
    held = readers.prediction_files(spark, paths)
    return held.groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("target"), 6).alias("target"), F.round(F.sum("prediction"), 6).alias("prediction"))


@register("top05_top_trials", "SELECT trial, value FROM fx_trials WHERE state = 'COMPLETE' ORDER BY value DESC, trial LIMIT 7", "trials")
def top05(spark: SparkSession, sf: str) -> DataFrame:
    return fx.trials(spark, sf).where("state = 'COMPLETE'").select("trial", "value").orderBy(F.desc("value"), "trial").limit(7)


# Joins of reports


@register("jon08_first_rows", "SELECT run_label, graph_id, num_nodes, vram_mb FROM fx_per_graph QUALIFY row_number() OVER (PARTITION BY run_label, graph_id ORDER BY num_nodes, vram_mb, step_time_s) = 1", "per_graph")
def jon08(spark: SparkSession, sf: str) -> DataFrame:
    return reports.first_rows(fx.per_graph(spark, sf), ["run_label", "graph_id"], ["num_nodes", "vram_mb", "step_time_s"]).select("run_label", "graph_id", "num_nodes", "vram_mb")


_WITH_NONE = "SELECT CASE WHEN graph_id % 5 = 0 THEN 'unknown' ELSE run_label END AS run_label FROM fx_per_graph"


@register("jon09_run_methods", f", r AS ({_WITH_NONE}) SELECT run_label, coalesce(kind, '') AS kind, coalesce(method, '') AS method, count(*) AS n FROM r LEFT JOIN fx_configs USING (run_label) GROUP BY ALL", "per_graph", "configs")
def jon09(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.per_graph(spark, sf).select(F.when(C("graph_id") % 5 == 0, "unknown").otherwise(C("run_label")).alias("run_label"))
    return reports.with_config(rows, fx.configs(spark, sf)).groupBy("run_label", "kind", "method").agg(F.count("*").alias("n"))


@register("jon10_same_methods", "SELECT a.run_label AS a, b.run_label AS b FROM fx_configs a JOIN (SELECT run_label, coalesce(method, '') AS method FROM fx_configs) b ON coalesce(a.method, '') = b.method", "configs")
def jon10(spark: SparkSession, sf: str) -> DataFrame:
    a, b = fx.configs(spark, sf), fx.configs(spark, sf).select(C("run_label").alias("b"), F.coalesce("method", L("")).alias("other"))
    return a.join(b, reports.same_method(C("method"), C("other"))).select(C("run_label").alias("a"), "b")


_EFFICIENCY = evaluation._PAIRED + evaluation._SAVED + evaluation._COST + ", of AS (SELECT 'partition' AS kind, 'random' AS method, 0.25::DOUBLE AS edge_retention, 7.5::DOUBLE AS ms_per_graph) SELECT i.kind, i.method, i.graphs_per_s, edge_retention, ms_per_graph, mean_vram_saving FROM co i LEFT JOIN of o ON o.kind = i.kind AND o.method = i.method LEFT JOIN sv ON sv.run_label = i.run_label WHERE i.kind <> 'none'"


@register("jon11_run_facts", _EFFICIENCY, "per_graph", "configs")
def jon11(spark: SparkSession, sf: str) -> DataFrame:
    costs = evaluation._costs(spark, sf)
    offline = spark.createDataFrame([("partition", "random", 0.25, 7.5)], "kind string, method string, edge_retention double, ms_per_graph double")
    out = reports.efficiency(costs, costs, offline, reports.savings_table(fx.per_graph(spark, sf), fx.configs(spark, sf)))
    return out.select("kind", "method", "graphs_per_s", "edge_retention", "ms_per_graph", "mean_vram_saving")


_PAIRS = evaluation._SCORES + ", cs AS (SELECT m.kind, coalesce(m.method, '') AS method, m.rmse AS matched_rmse, f.rmse AS full_rmse FROM sc m JOIN sc f ON m.split = 'test' AND f.split = 'val' AND m.kind = f.kind AND coalesce(m.method, '') = coalesce(f.method, ''))"


def _states(spark: SparkSession, sf: str) -> DataFrame:
    scores = evaluation._scores(spark, sf)
    return reports.cross_state(scores.where("split = 'test'"), scores.where("split = 'val'"))


@register("jon12_state_pairs", _PAIRS + " SELECT * FROM cs", "predictions", "configs")
def jon12(spark: SparkSession, sf: str) -> DataFrame:
    return _states(spark, sf).select("kind", "method", "matched_rmse", "full_rmse")


@register("rep14_cross_state_bars", _PAIRS + " UNPIVOT cs ON matched_rmse, full_rmse INTO NAME state VALUE rmse", "predictions", "configs")
def rep14(spark: SparkSession, sf: str) -> DataFrame:
    return reports.cross_state_bars(_states(spark, sf))


@register("jon13_cost_pairs", evaluation._SCORES + evaluation._COST + " SELECT s.kind, coalesce(s.method, '') AS method, rmse, mean_time FROM sc s LEFT JOIN (SELECT * FROM co WHERE kind <> 'partition') c ON s.kind = c.kind AND coalesce(s.method, '') = coalesce(c.method, '') WHERE split = 'test'", "predictions", "configs")
def jon13(spark: SparkSession, sf: str) -> DataFrame:
    return reports.tradeoff(evaluation._scores(spark, sf).where("split = 'test'"), evaluation._costs(spark, sf).where("kind != 'partition'")).select("kind", "method", "rmse", "mean_time")


@register("jon14_group_lookup", evaluation._SPLIT + ", gm AS (SELECT num_po, avg(target) AS m FROM tr WHERE num_po <> 3 GROUP BY 1) SELECT num_po, round(coalesce(m, (SELECT avg(target) FROM tr WHERE num_po <> 3)), 6) AS prediction, count(*) AS n FROM te LEFT JOIN gm USING (num_po) GROUP BY ALL", "samples")
def jon14(spark: SparkSession, sf: str) -> DataFrame:
    train, test = evaluation._rows(spark, sf)
    return baselines.group_means(train.where("num_po != 3"), test, "num_po", "p").groupBy("num_po", F.round("p", 6).alias("prediction")).agg(F.count("*").alias("n"))


# Joins and sums over graphs


@register("jon20_kept_ends", "SELECT e.graph_id, a.role IN (0, 2) AND b.role IN (0, 2) AS keep, count(*) AS n FROM fx_edges e JOIN fx_nodes a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN fx_nodes b ON b.graph_id = e.graph_id AND b.node_id = e.dst GROUP BY ALL", "topology")
def jon20(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = graphs._graph(spark, sf)
    return reduction.ends_kept(edges, reduction.gates_only(nodes)).groupBy("graph_id", "keep").agg(F.count("*").alias("n"))


@register("jon21_part_pairs", graphs._RANDOM + graphs._ENDS + " SELECT graph_id, ps, pd, count(*) AS n FROM e GROUP BY ALL", "topology")
def jon21(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = graphs._graph(spark, sf)
    return reduction.part_pairs(edges, reduction.random_parts(graphs._with_k(nodes))).groupBy("graph_id", "ps", "pd").agg(F.count("*").alias("n"))


@register("jon22_level_spans", "SELECT e.graph_id, abs(a.level - b.level)::BIGINT AS span, count(*) AS n FROM fx_edges e JOIN fx_levels a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN fx_levels b ON b.graph_id = e.graph_id AND b.node_id = e.dst GROUP BY ALL", "levels")
def jon22(spark: SparkSession, sf: str) -> DataFrame:
    _, edges, levels = graphs._levelled(spark, sf)
    return reduction.level_spans(edges, levels).groupBy("graph_id", "span").agg(F.count("*").alias("n"))


@register("win02_level_slices", graphs._SLICES + " SELECT graph_id, part, min(level) AS lowest, max(level) AS highest, count(*) AS n FROM p JOIN fx_levels USING (graph_id, node_id) GROUP BY ALL", "levels")
def win02(spark: SparkSession, sf: str) -> DataFrame:
    parts = passes.level_slices(fx.gates(spark, sf), graphs._TARGET)
    return parts.groupBy("graph_id", "part").agg(F.min("level").alias("lowest"), F.max("level").alias("highest"), F.count("*").alias("n"))


_CUTS = graphs._RANDOM + graphs._ENDS + ", cu AS (SELECT graph_id, round(count(*) FILTER (ps <> pd) / count(*)::DOUBLE, 6) AS edge_cut FROM e GROUP BY 1)" + graphs._RETAIN


def _cuts(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = graphs._graph(spark, sf)
    cut = reduction.partition_stats(reduction.random_parts(graphs._with_k(nodes)), edges).select("graph_id", "edge_cut")
    return reduction.retention(nodes, edges, *reduction.sparsify(nodes, edges, "and_gate_only")).join(cut, "graph_id")


@register("grf22_cut_and_retention", _CUTS + " SELECT graph_id, edge_cut, node_retention, edge_retention FROM cu JOIN q USING (graph_id) JOIN qe USING (graph_id)", "topology")
def grf22(spark: SparkSession, sf: str) -> DataFrame:
    return _cuts(spark, sf)


@register("agg18_method_means", _CUTS + ", m AS (SELECT CASE WHEN graph_id % 2 = 0 THEN 'even' ELSE 'odd' END AS method, edge_cut, edge_retention FROM cu JOIN qe USING (graph_id)) SELECT method, round(avg(edge_cut), 6) AS edge_cut, round(avg(edge_retention), 6) AS edge_retention, count(*) AS n FROM m GROUP BY 1", "topology")
def agg18(spark: SparkSession, sf: str) -> DataFrame:
    rows = _cuts(spark, sf).withColumn("method", F.when(C("graph_id") % 2 == 0, "even").otherwise("odd"))
    return reports.method_means(rows, "edge_cut", "edge_retention")


@register("grf23_resumed_masks", "SELECT 'and_gate_only' AS algo, graph_id, count(*) AS n, count(*) FILTER (role IN (0, 2)) AS kept FROM fx_nodes GROUP BY ALL", "topology")
def grf23(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-08 too: masks of a third of the graphs are in the store; the others are computed and appended in a second turn."""
    nodes = graphs._graph(spark, sf)[0]
    path = scratch.folder(spark, "masks")
    mask = lambda part: reduction.gates_only(part).select(L("and_gate_only").alias("algo"), "graph_id", C("node_id").alias("item_id"), "keep")
    sinks.masks(mask(nodes.where("graph_id % 3 = 0")), path)
    done = readers.masks(spark, path, "and_gate_only").select("graph_id", "algo").distinct()
    left = incremental.remaining(nodes.select("graph_id").distinct(), done, "graph_id", ["and_gate_only"])
    sinks.masks(mask(nodes.join(left, "graph_id", "left_semi")), path)
    return readers.masks(spark, path, "and_gate_only").groupBy("algo", "graph_id").agg(F.count("*").alias("n"), F.count_if("keep").alias("kept"))


@register("scl41_log_encodings", "SELECT graph_id, node_id, round(ln(1 + level::DOUBLE), 8) AS level FROM fx_levels", "levels")
def scl41(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _, levels = graphs._levelled(spark, sf)
    return topology.encodings(nodes, levels).select("graph_id", "node_id", F.round("level", 8).alias("level"))


# Aggregates


@register("agg05_depth_counts", "SELECT algorithm, count(*) FILTER (optimizability BETWEEN -1e-12 AND 1e-12) AS n_zero, count(*) FILTER (depth_optimizability > 1e-12 OR depth_optimizability < -1e-12) AS n_depth_changed, count(*) FILTER (depth_optimizability > 1e-12) AS n_depth_better, count(*) FILTER (depth_optimizability < -1e-12) AS n_depth_worse FROM fx_master WHERE tier_id = 1 GROUP BY 1", "master")
def agg05(spark: SparkSession, sf: str) -> DataFrame:
    return quality.label_ranges(fx.master(spark, sf).where("tier_id = 1")).select("algorithm", "n_zero", "n_depth_changed", "n_depth_better", "n_depth_worse")


@register("agg07_step_changes", corpus._STEPS + " SELECT algorithm, count(*) FILTER (node_change > 0) AS n_more_nodes, count(*) FILTER (node_change = 0) AS n_same_nodes, coalesce(sum(node_change) FILTER (node_change > 0), 0)::BIGINT AS sum_more_nodes, max(node_change) AS max_node_change FROM s1 GROUP BY 1", "master")
def agg07(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.step_report(fx.master(spark, sf), 1).select("algorithm", "n_more_nodes", "n_same_nodes", "sum_more_nodes", "max_node_change")


@register("agg19_lines", "SELECT run_label, round(regr_slope(vram_mb, num_nodes) * 1000, 6) AS mb_per_1k_nodes, round(regr_intercept(vram_mb, num_nodes), 4) AS intercept, count(*) AS n FROM fx_per_graph WHERE run_label <> 'Orchestrate' OR graph_id = (SELECT min(graph_id) FROM fx_per_graph) GROUP BY 1 HAVING count(*) >= 2", "per_graph")
def agg19(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.per_graph(spark, sf)
    first = F.broadcast(rows.agg(F.min("graph_id").alias("_first")))  # one row
    return reports.vram_scaling(rows.crossJoin(first).where("run_label != 'Orchestrate' or graph_id = _first"))


@register("agg25_smooth_l1", "SELECT run_label, round(avg(CASE WHEN abs(prediction - target) < 0.01 THEN 50 * power(prediction - target, 2) ELSE abs(prediction - target) - 0.005::DOUBLE END), 6) AS smooth_l1 FROM fx_predictions GROUP BY 1", "predictions")
def agg25(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.errors(fx.predictions(spark, sf), ["run_label"]).select("run_label", F.round("smooth_l1", 6).alias("smooth_l1"))


# Samples, splits and batches


@register("smp03_candidate_pool", f"SELECT sample_id FROM fx_samples ORDER BY {graphs._u('42', 'sample_id')}, sample_id LIMIT 300", "samples")
def smp03(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample(fx.samples(spark, sf), "sample_id", sampling.pool_size(5, 10), 42).select("sample_id")


@register("smp04_sampled_files", f"SELECT graph_path FROM (SELECT DISTINCT graph_path FROM fx_samples) ORDER BY {graphs._u('42', 'graph_path')}, graph_path LIMIT 50", "samples")
def smp04(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample(fx.samples(spark, sf).select("graph_path").distinct(), "graph_path", 50, 42)


@register("spl02_scaled_ratios", graphs._split("s", "design") + " SELECT split, count(*) AS n FROM s GROUP BY 1", "samples")
def spl02(spark: SparkSession, sf: str) -> DataFrame:
    """Ratios are shares of their sum."""
    return sampling.grouped_split(fx.samples(spark, sf), names.design_of_path(C("graph_path")), "graph_path", 42, (16, 2, 2)).groupBy("split").agg(F.count("*").alias("n"))


@register("spl03_splits_record", "SELECT 'seed' AS field, '42' AS held, '7' AS wanted UNION ALL SELECT 'num_samples', (SELECT count(*) FROM orders)::VARCHAR, '-1' UNION ALL SELECT 'ratios', NULL, '8:1:1'")
def spl03(spark: SparkSession, sf: str) -> DataFrame:
    n = fx.samples(spark, sf).count()
    path = scratch.put(spark, scratch.folder(spark, "record") + ".json", f'{{"train":["a"],"val":[],"test":[],"__meta__":{{"version":"1","seed":"42","split_by":"design","num_samples":"{n}"}}}}'.encode())
    return sampling.same_meta(readers.splits_meta(spark, path), {"version": "1", "seed": "7", "split_by": "design", "num_samples": "-1", "ratios": "8:1:1"})


_PLAN = """, z AS (SELECT graph_id, n, row_number() OVER (ORDER BY n, graph_id) AS r, sum(n) OVER (ORDER BY n, graph_id)::BIGINT AS c FROM (SELECT graph_id, count(*) AS n FROM fx_nodes GROUP BY 1)),
l AS (SELECT list(n ORDER BY r) AS s, list_concat([0::BIGINT], list(c ORDER BY r)) AS q, count(*) AS m FROM z),
st(b, lo, hi, back) AS (SELECT -1::BIGINT, 0::BIGINT, 0::BIGINT, m FROM l UNION ALL
  SELECT b + 1, hi, CASE WHEN s[back] > 2000 THEN hi ELSE least(back - 1, len(list_filter(q, lambda x: x <= q[hi + 1] + 2000 - s[back])) - 1) END, back - 1 FROM st, l WHERE hi < back),
i AS (SELECT b AS batch_id, 0::BIGINT AS pos, back AS idx FROM st WHERE b >= 0 UNION ALL SELECT b, j - lo + 1, j FROM st, unnest(range(lo, hi)) AS t(j) WHERE b >= 0)"""


@register("bat01_batch_plan", _PLAN + " SELECT batch_id, pos, idx, graph_id, n FROM i JOIN z ON z.r = idx + 1", "topology")
def bat01(spark: SparkSession, sf: str) -> DataFrame:
    return graphs._plan(spark, sf)


@register("bat04_emitted_order", _PLAN + " SELECT batch_id, pos, graph_id, row_number() OVER (ORDER BY batch_id, pos) - 1 AS at FROM i JOIN z ON z.r = idx + 1", "topology")
def bat04(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.emitted(graphs._plan(spark, sf)).select("batch_id", "pos", "graph_id", "at")


@register("jon24_realigned", _PLAN + " SELECT idx, batch_id, pos, (2 * n)::DOUBLE AS value FROM i JOIN z ON z.r = idx + 1", "topology")
def jon24(spark: SparkSession, sf: str) -> DataFrame:
    order = scratch.kept(graphs._plan(spark, sf), "order")
    return reports.realigned(order, order.select("batch_id", "pos", (C("n") * 2).cast("double").alias("value")))


# Predictors


@register("mlx01_constants", evaluation._CONSTANT + " SELECT predictor, round(prediction, 8) AS prediction, count(*) AS n FROM pr GROUP BY ALL", "samples")
def mlx01(spark: SparkSession, sf: str) -> DataFrame:
    train, test = evaluation._rows(spark, sf)
    long = test.crossJoin(F.broadcast(baselines.constants(train))).unpivot([], ["mean", "median", "zero"], "predictor", "prediction")  # one row
    return long.groupBy("predictor", F.round("prediction", 8).alias("prediction")).agg(F.count("*").alias("n"))


def _solved(features: dict[str, str]) -> str:
    """Least squares by Cramer's rule on covariances: one row of coefficients b0, b1, .."""
    x = list(features)
    cov = lambda a, b: f"covar_pop({a}, {b}) AS s_{a}_{b}"
    pairs = [(a, b) for i, a in enumerate(x) for b in x[i:]]
    sums = ", ".join([cov(a, b) for a, b in pairs] + [cov(a, "y") for a in x] + [f"avg({a}) AS m_{a}" for a in [*x, "y"]])
    s = lambda a, b: f"s_{a}_{b}" if (a, b) in pairs else f"s_{b}_{a}"

    def det(m: list[list[str]]) -> str:
        if len(m) == 1:
            return m[0][0]
        return "(" + " ".join(f"{'+' if j % 2 == 0 else '-'} {m[0][j]} * {det([row[:j] + row[j + 1 :] for row in m[1:]])}" for j in range(len(m))) + ")"

    whole = [[s(a, b) for b in x] for a in x]
    slopes = [f"{det([[f's_{a}_y' if j == k else v for j, v in enumerate(row)] for a, row in zip(x, whole)])} / {det(whole)} AS b{k + 1}" for k in range(len(x))]
    b0 = "m_y - " + " - ".join(f"b{k + 1} * m_{a}" for k, a in enumerate(x)) + " AS b0"
    return f""", xy AS (SELECT {', '.join(f'{sql} AS {a}' for a, sql in features.items())}, target AS y FROM tr), cv AS (SELECT {sums} FROM xy), sl1 AS (SELECT cv.*, {', '.join(slopes)} FROM cv), fit AS (SELECT sl1.*, {b0} FROM sl1)"""


_SIZE = {"xa": "log10(num_nodes)", "xb": "log10(num_edges)"}
_COUNTS = {"xa": "log10(1 + num_pi)", "xb": "log10(1 + num_and)", "xc": "log10(1 + num_po)"}


def _line(features: dict[str, str]) -> str:
    total = "b0" + "".join(f" + b{k + 1} * {sql}" for k, sql in enumerate(features.values()))
    return f" SELECT graph_path, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {total})), 4) + 0.0::DOUBLE AS prediction, count(*) AS n FROM te, fit GROUP BY ALL"


def _predicted(spark: SparkSession, sf: str, features) -> DataFrame:
    train, test = evaluation._rows(spark, sf)
    prediction = baselines.linear(baselines.least_squares(train, features(), C("target"))[0], features())
    return test.groupBy("graph_path", (F.round(prediction, 4) + L(0.0)).alias("prediction")).agg(F.count("*").alias("n"))


@register("mlx02_size_line", evaluation._SPLIT + _solved(_SIZE) + _line(_SIZE), "samples")
def mlx02(spark: SparkSession, sf: str) -> DataFrame:
    return _predicted(spark, sf, baselines.size_features)


@register("mlx03_counts_line", evaluation._SPLIT + _solved(_COUNTS) + _line(_COUNTS), "samples")
def mlx03(spark: SparkSession, sf: str) -> DataFrame:
    return _predicted(spark, sf, baselines.count_features)


@register("agg20_coefficients", evaluation._SPLIT + _solved(_COUNTS) + ", r AS (SELECT unnest([0, 1, 2, 3]) AS term, unnest([b0, b1, b2, b3]) AS coefficient FROM fit) SELECT term, round(coefficient, 5) + 0.0::DOUBLE AS coefficient, 4 AS rank FROM r", "samples")
def agg20(spark: SparkSession, sf: str) -> DataFrame:
    coefficients, rank, _ = baselines.least_squares(evaluation._rows(spark, sf)[0], baselines.count_features(), C("target"))
    return spark.createDataFrame([(i, round(float(c), 5) + 0.0, rank) for i, c in enumerate(coefficients)], "term int, coefficient double, rank int")


_EMBED = [[0.5, -0.25], [0.125, 0.75], [1.0, 0.0], [-0.5, 0.25]]


@register(
    "mlx12_node_inputs",
    """, x AS (SELECT v.graph_id, v.node_id, v.node_id % 3 AS part, [0.5, 0.125, 1.0, -0.5][v.role + 1]::DOUBLE AS a, [-0.25, 0.75, 0.0, 0.25][v.role + 1]::DOUBLE AS b, ln(1 + l.level::DOUBLE) AS c FROM fx_nodes v JOIN fx_levels l USING (graph_id, node_id)),
    s AS (SELECT graph_id, part, avg(a) AS ma, var_pop(a) AS va, avg(b) AS mb, var_pop(b) AS vb, avg(c) AS mc, var_pop(c) AS vc FROM x GROUP BY ALL)
    SELECT graph_id, part, node_id, round((a - ma) / sqrt(va + 1e-5), 5) + 0.0::DOUBLE AS x0, round((b - mb) / sqrt(vb + 1e-5), 5) + 0.0::DOUBLE AS x1, round((c - mc) / sqrt(vc + 1e-5), 5) + 0.0::DOUBLE AS x2 FROM x JOIN s USING (graph_id, part)""",
    "levels",
)
def mlx12(spark: SparkSession, sf: str) -> DataFrame:
    out = passes.node_inputs(fx.gates(spark, sf), _EMBED, 3)
    return out.select("graph_id", "part", "node_id", *[(F.round(f"x{i}", 5) + 0.0).alias(f"x{i}") for i in range(3)])


@register("mlx13_head", "SELECT vec_id, round(1 / (1 + exp(-(1.5 * greatest(0.4 * embedding[1]::DOUBLE + 0.2 * embedding[2]::DOUBLE + 0.1, 0) - 0.7 * greatest(embedding[2]::DOUBLE - embedding[1]::DOUBLE, 0) + 0.05)::DOUBLE)), 6) AS prediction FROM embeddings")
def mlx13(spark: SparkSession, sf: str) -> DataFrame:
    x = F.slice(C("embedding").cast("array<double>"), 1, 2)
    out = message_passing.head(x, [[0.4, 0.2], [-1.0, 1.0]], [0.1, 0.0], [1.5, -0.7], 0.05)
    return fx.read(spark, sf, "embeddings").select("vec_id", F.round(out, 6).alias("prediction"))


@register("mlx15_trained", "SELECT round(regr_slope(target, log10(pre_nodes)), 4) + 0.0::DOUBLE AS slope, round(regr_intercept(target, log10(pre_nodes)), 4) + 0.0::DOUBLE AS intercept FROM fx_samples", "samples")
def mlx15(spark: SparkSession, sf: str) -> DataFrame:
    model = message_passing.fit(fx.samples(spark, sf).select(F.array(F.log10("pre_nodes")).alias("x"), "target"), "target", 0.0)
    return spark.createDataFrame([(round(float(model.coefficients[0]), 4) + 0.0, round(float(model.intercept), 4) + 0.0)], "slope double, intercept double")


@register("mlx16_search", None)
def mlx16(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.samples(spark, sf).select("sample_id", F.array(F.log10("pre_nodes"), F.log10("num_pi")).alias("x"), "target")
    return message_passing.search(rows, "target", [0.0, 0.01, 1.0], [0.0, 1.0], "sample_id")


# Checks


@register("dq02_cardinality", "SELECT root_design, count(*) FILTER (tier_id = 0) AS n0, count(*) FILTER (tier_id = 1) AS n1 FROM fx_master GROUP BY 1 HAVING count(*) FILTER (tier_id = 1) <> 4 * count(*) FILTER (tier_id = 0)", "master")
def dq02(spark: SparkSession, sf: str) -> DataFrame:
    return quality.invariants(fx.master(spark, sf)).where("problem like 'tier1 is not%'").select("root_design", "n0", "n1")


@register("dq03_growing_children", corpus._STEPS + " SELECT root_design, algorithm, count(*) AS n, max(node_change) AS most FROM s2 WHERE node_change > 0 GROUP BY ALL", "master")
def dq03(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.steps(fx.master(spark, sf), 2).where("node_change > 0").groupBy("root_design", "algorithm").agg(F.count("*").alias("n"), F.max("node_change").alias("most"))


@register("dq04_completeness", ", c AS (SELECT count(graph_path) AS graph_path, count(level) AS level, count(*) FILTER (algorithm <> '') AS algorithm FROM fx_samples) UNPIVOT c ON graph_path, level, algorithm INTO NAME name VALUE filled", "samples")
def dq04(spark: SparkSession, sf: str) -> DataFrame:
    return quality.completeness(fx.samples(spark, sf).select("graph_path", "level", "algorithm"))


@register("dq05_count_audit", "SELECT graph_id, count(*) + CASE WHEN graph_id % 5 = 0 THEN 1 ELSE 0 END AS listed, CASE WHEN graph_id % 7 <> 0 THEN count(*) END AS counted FROM fx_nodes GROUP BY 1 HAVING graph_id % 5 = 0 OR graph_id % 7 = 0", "topology")
def dq05(spark: SparkSession, sf: str) -> DataFrame:
    counted = graphs._graph(spark, sf)[0].groupBy("graph_id").agg(F.count("*").alias("num_nodes"))
    listed = counted.select("graph_id", (C("num_nodes") + F.when(C("graph_id") % 5 == 0, 1).otherwise(0)).alias("num_nodes"))
    return audit.count_mismatches(listed, counted.where("graph_id % 7 != 0"), "graph_id")


@register("dq07_accounting", "SELECT design, count(*) AS discovered, count(*) FILTER (sample_id % 3 = 0) AS saved, count(*) FILTER (sample_id % 3 = 1 AND sample_id % 50 <> 1) AS skipped, count(*) FILTER (sample_id % 3 = 0) + count(*) FILTER (sample_id % 3 = 1 AND sample_id % 50 <> 1) AS completed, count(*) = count(*) FILTER (sample_id % 3 = 0) + count(*) FILTER (sample_id % 3 = 1 AND sample_id % 50 <> 1) AS complete FROM fx_samples WHERE sample_id % 3 < 2 GROUP BY 1", "samples")
def dq07(spark: SparkSession, sf: str) -> DataFrame:
    found = fx.samples(spark, sf).where("sample_id % 3 < 2")
    return quality.accounting(found, found.where("sample_id % 3 = 0"), found.where("sample_id % 3 = 1 and sample_id % 50 != 1"), "design", "sample_id")


_FIRST = corpus.KEYS + """, want AS (SELECT design, a.name AS dst, recipe, step FROM d CROSS JOIN fx_algos a WHERE store = 'aig' AND tier = 0), have AS (SELECT design, dst, recipe, step FROM d WHERE store = 'aig' AND tier = 1)"""


@register("dq08_tier1_coverage", _FIRST + " SELECT w.design, count(*) AS expected, count(h.recipe) AS found, count(*) - count(h.recipe) AS missing, round(100.0::DOUBLE * count(h.recipe) / count(*), 6) AS coverage_pct FROM want w LEFT JOIN have h ON h.design = w.design AND h.dst = w.dst AND h.recipe = w.recipe AND h.step = w.step GROUP BY 1", "stores")
def dq08(spark: SparkSession, sf: str) -> DataFrame:
    return audit.coverage(audit.parse_stores(fx.stores(spark, sf)), 1)


@register("snk14_figure_points", evaluation._SCORES + evaluation._COST + """, t AS (SELECT *, kind || CASE WHEN method IS NOT NULL THEN '_' || method ELSE '' END AS series FROM sc WHERE split = 'test'), c2 AS (SELECT kind || CASE WHEN method IS NOT NULL THEN '_' || method ELSE '' END AS series, mean_vram FROM co)
    SELECT 'parity' AS figure, run_label AS series, target AS x, prediction AS y, count(*) AS n FROM fx_predictions GROUP BY ALL UNION ALL SELECT 'pareto', series, mean_vram, rmse, 1 FROM t JOIN c2 USING (series) UNION ALL SELECT 'accuracy', series, r2, rmse, n FROM t""", "predictions", "configs")
def snk14(spark: SparkSession, sf: str) -> DataFrame:
    return reports.figure_points(fx.predictions(spark, sf), evaluation._scores(spark, sf).where("split = 'test'"), evaluation._costs(spark, sf))
