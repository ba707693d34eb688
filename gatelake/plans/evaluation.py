"""Queries over predictions, benchmarks, baselines and reports, with the SQL that checks them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.functions import names, scalars
from gatelake.operators import baselines, message_passing, metrics, passes, reports, sampling, topology
from gatelake.plans import fixtures as fx
from gatelake.plans import graphs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None, *parts: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = fx.sql(sql, *parts)
        return f

    return add


_P = "fx_predictions"


def _errors(by: str, source: str) -> str:
    return f"""SELECT {by}, count(*) AS n, round(avg(abs(prediction - target)), 8) + 0.0::DOUBLE AS mae, round(sqrt(avg((prediction - target) * (prediction - target))), 8) + 0.0::DOUBLE AS rmse,
      round(CASE WHEN var_pop(target) * count(*) > 1e-15 THEN 1 - sum((prediction - target) * (prediction - target)) / (var_pop(target) * count(*)) END, 8) + 0.0::DOUBLE AS r2,
      round(avg(CASE WHEN abs(prediction - target) < 0.01 THEN 0.5::DOUBLE * (prediction - target) * (prediction - target) / 0.01::DOUBLE ELSE abs(prediction - target) - 0.005::DOUBLE END), 8) + 0.0::DOUBLE AS smooth_l1 FROM {source} GROUP BY {by}"""


@register("agg24_errors", _errors("run_label, split", _P), "predictions")
def agg24(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.errors(fx.predictions(spark, sf), ["run_label", "split"])


def _spearman(by: str, source: str) -> str:
    return f"""rk AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY target) + (count(*) OVER (PARTITION BY {by}, target) - 1) / 2.0::DOUBLE AS rt, rank() OVER (PARTITION BY {by} ORDER BY prediction) + (count(*) OVER (PARTITION BY {by}, prediction) - 1) / 2.0::DOUBLE AS rp FROM {source}),
    sp AS (SELECT {by}, round(CASE WHEN var_pop(rt) > 1e-12 AND var_pop(rp) > 1e-12 THEN corr(rt, rp) END, 8) + 0.0::DOUBLE AS spearman FROM rk GROUP BY {by})"""


@register("agg26_spearman", f", {_spearman('run_label, split', _P)} SELECT * FROM sp", "predictions")
def agg26(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.spearman(fx.predictions(spark, sf), ["run_label", "split"])


@register("win03_midranks", "SELECT run_label, target, round(rank() OVER (PARTITION BY run_label ORDER BY target) + (count(*) OVER (PARTITION BY run_label, target) - 1) / 2.0::DOUBLE, 1) AS midrank, count(*) AS n FROM fx_predictions GROUP BY run_label, target, graph_id, num_nodes, prediction, split, num_edges QUALIFY true", "predictions")
def win03(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.predictions(spark, sf).groupBy("run_label", "target", "graph_id", "num_nodes", "prediction", "split", "num_edges").agg(F.count("*").alias("n"))
    return metrics.midranks(rows, ["run_label"], "target", "midrank").select("run_label", "target", F.round("midrank", 1).alias("midrank"), "n")


@register("agg27_bootstrap", None)
def agg27(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.bootstrap(fx.predictions(spark, sf), ["run_label", "split"], "num_nodes")


@register("agg30_weighted_pearson", ", m AS (SELECT run_label, sum(num_nodes * target) / sum(num_nodes) AS mx, sum(num_nodes * prediction) / sum(num_nodes) AS my FROM fx_predictions GROUP BY 1) SELECT run_label, round(sum(num_nodes * (target - mx) * (prediction - my)) / sqrt(sum(num_nodes * (target - mx) * (target - mx)) * sum(num_nodes * (prediction - my) * (prediction - my))), 8) + 0.0::DOUBLE AS pearson FROM fx_predictions JOIN m USING (run_label) GROUP BY 1", "predictions")
def agg30(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.weighted_pearson(fx.predictions(spark, sf), ["run_label"], "target", "prediction", "num_nodes")


@register("snk05_abs_error", "SELECT run_label, graph_id, num_nodes, round(abs(prediction - target), 8) AS abs_error, count(*) AS n FROM fx_predictions GROUP BY ALL", "predictions")
def snk05(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.predictions(spark, sf).withColumn("abs_error", F.round(F.abs(F.col("prediction") - F.col("target")), 8))
    return rows.groupBy("run_label", "graph_id", "num_nodes", "abs_error").agg(F.count("*").alias("n"))


@register("agg41_weighted_mean", "SELECT run_label, round(sum(prediction * num_nodes) / sum(num_nodes), 8) + 0.0::DOUBLE AS mean FROM fx_predictions GROUP BY 1", "predictions")
def agg41(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.weighted_mean(fx.predictions(spark, sf), ["run_label"], "prediction", "num_nodes")


@register("rep08_parity_limits", "SELECT run_label, least(min(target), min(prediction)) AS low, greatest(max(target), max(prediction)) AS high, count(*) AS n FROM fx_predictions GROUP BY 1", "predictions")
def rep08(spark: SparkSession, sf: str) -> DataFrame:
    return reports.parity_limits(fx.predictions(spark, sf))


# Benchmarks and reports


@register("agg31_undefined_safe", "SELECT run_label, round(avg(reserved_mb), 8) + 0.0::DOUBLE AS mean, round(max(reserved_mb), 8) + 0.0::DOUBLE AS max, round(quantile_cont(reserved_mb, 0.95), 8) + 0.0::DOUBLE AS p95, count(*) FILTER (reserved_mb IS NULL) AS n_undefined FROM fx_per_graph GROUP BY 1", "per_graph")
def agg31(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.undefined_safe(fx.per_graph(spark, sf), ["run_label"], "reserved_mb")


_BENCH = """SELECT run_label, count(*) AS n, round(avg(step_time_s), 8) + 0.0::DOUBLE AS mean_time, round(stddev_pop(step_time_s), 8) + 0.0::DOUBLE AS std_time, round(count(*) / sum(step_time_s), 8) + 0.0::DOUBLE AS graphs_per_s, round(avg(vram_mb), 4) + 0.0::DOUBLE AS mean_vram, round(max(vram_mb), 4) + 0.0::DOUBLE AS max_vram,
  round(quantile_cont(vram_mb, 0.95), 4) + 0.0::DOUBLE AS p95_vram, round(avg(reserved_mb), 4) + 0.0::DOUBLE AS mean_reserved, round(avg(num_nodes), 4) + 0.0::DOUBLE AS mean_nodes FROM fx_per_graph GROUP BY 1"""


@register("agg32_benchmark", _BENCH, "per_graph")
def agg32(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.benchmark(fx.per_graph(spark, sf), ["run_label"])


@register("agg33_repeats", "SELECT run_label, graph_id, round(median(step_time_s), 8) + 0.0::DOUBLE AS median_time, round(stddev_pop(step_time_s), 8) + 0.0::DOUBLE AS std_time, count(*) AS n FROM fx_per_graph GROUP BY ALL", "per_graph")
def agg33(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.repeats(fx.per_graph(spark, sf), ["run_label", "graph_id"])


@register("agg17_repeat_means", "SELECT run_label, graph_id, round(avg(step_time_s), 8) AS time, round(avg(vram_mb), 6) AS vram FROM fx_per_graph GROUP BY ALL", "per_graph")
def agg17(spark: SparkSession, sf: str) -> DataFrame:
    return reports.per_graph_means(fx.per_graph(spark, sf)).select("run_label", "graph_id", F.round("time", 8).alias("time"), F.round("vram", 6).alias("vram"))


_PAIRED = ", pm AS (SELECT run_label, graph_id, avg(step_time_s) AS t, avg(vram_mb) AS v FROM fx_per_graph GROUP BY ALL), pb AS (SELECT graph_id, t, v FROM pm WHERE run_label = 'Orchestrate'), ps AS (SELECT pm.run_label, graph_id, (1 - pm.v / pb.v) * 100 AS vram_saving, (1 - pm.t / pb.t) * 100 AS time_saving FROM pm JOIN pb USING (graph_id) WHERE pm.run_label <> 'Orchestrate')"


@register("jon07_paired_savings", _PAIRED + " SELECT run_label, graph_id, round(vram_saving, 6) AS vram_saving, round(time_saving, 6) AS time_saving FROM ps", "per_graph")
def jon07(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.paired_savings(fx.per_graph(spark, sf), fx.configs(spark, sf))
    return rows.select("run_label", "graph_id", F.round("vram_saving", 6).alias("vram_saving"), F.round("time_saving", 6).alias("time_saving"))


_SAVED = ", sv AS (SELECT run_label, count(*) AS n_paired, round(avg(vram_saving), 6) AS mean_vram_saving, round(avg(time_saving), 6) AS mean_time_saving FROM ps GROUP BY 1)"


@register("rep02_savings", _PAIRED + _SAVED + " SELECT coalesce(kind, '') AS kind, coalesce(method, '') AS method, n_paired, mean_vram_saving, mean_time_saving FROM sv LEFT JOIN fx_configs USING (run_label)", "per_graph", "configs")
def rep02(spark: SparkSession, sf: str) -> DataFrame:
    return reports.savings_table(fx.per_graph(spark, sf), fx.configs(spark, sf))


@register("rep02_savings_tests", None)
def rep02t(spark: SparkSession, sf: str) -> DataFrame:
    return reports.savings_tests(fx.per_graph(spark, sf), fx.configs(spark, sf))


@register("agg29_signed_ranks", _PAIRED + """, a AS (SELECT run_label, vram_saving AS d, abs(vram_saving) AS a FROM ps WHERE vram_saving <> 0), r AS (SELECT *, rank() OVER (PARTITION BY run_label ORDER BY a) + (count(*) OVER (PARTITION BY run_label, a) - 1) / 2.0::DOUBLE AS r FROM a),
    t AS (SELECT run_label, sum(n * n * n - n)::BIGINT AS ties FROM (SELECT run_label, a, count(*)::BIGINT AS n FROM a GROUP BY ALL) GROUP BY 1) SELECT run_label, count(*) AS n, round(coalesce(sum(r) FILTER (d > 0), 0.0::DOUBLE), 1) AS w_plus, any_value(ties) AS ties FROM r JOIN t USING (run_label) GROUP BY 1""", "per_graph")
def agg29(spark: SparkSession, sf: str) -> DataFrame:
    paired = reports.paired_savings(fx.per_graph(spark, sf), fx.configs(spark, sf), exact=True)
    return metrics.signed_ranks(paired, ["run_label"], "vram_saving").withColumn("w_plus", F.round("w_plus", 1))


_FIRST = ", fr AS (SELECT * FROM fx_per_graph QUALIFY row_number() OVER (PARTITION BY run_label, graph_id ORDER BY num_nodes, vram_mb, step_time_s) = 1)"


@register("rep13_size_points", _FIRST + " SELECT a.run_label, a.graph_id, b.num_nodes AS full_nodes, round((1 - a.vram_mb / b.vram_mb) * 100, 6) AS vram_saving FROM fr a JOIN fr b ON b.graph_id = a.graph_id AND b.run_label = 'Orchestrate' WHERE a.run_label <> 'Orchestrate'", "per_graph")
def rep13(spark: SparkSession, sf: str) -> DataFrame:
    return reports.size_points(fx.per_graph(spark, sf), fx.configs(spark, sf))


@register("rep07_vram_scaling", "SELECT run_label, round(regr_slope(vram_mb, num_nodes) * 1000, 6) AS mb_per_1k_nodes, round(regr_intercept(vram_mb, num_nodes), 4) AS intercept, count(*) AS n FROM fx_per_graph GROUP BY 1 HAVING count(*) >= 2", "per_graph")
def rep07(spark: SparkSession, sf: str) -> DataFrame:
    return reports.vram_scaling(fx.per_graph(spark, sf))


@register("rep12_vram_points", "SELECT kind, coalesce(method, '') AS method, num_nodes, vram_mb, count(*) AS n FROM fx_per_graph JOIN fx_configs USING (run_label) GROUP BY ALL", "per_graph", "configs")
def rep12(spark: SparkSession, sf: str) -> DataFrame:
    return reports.with_config(fx.per_graph(spark, sf), fx.configs(spark, sf)).groupBy("kind", "method", "num_nodes", "vram_mb").agg(F.count("*").alias("n"))


_LABELS = "CASE run_label WHEN 'A' THEN 'Orchestrate' WHEN 'N' THEN 'Orchestrate_partition_random' ELSE 'Orchestrate_sparsification_pagerank' END"
_SCORES = f""", pl AS (SELECT * REPLACE ({_LABELS} AS run_label) FROM fx_predictions), {_spearman('run_label, split', 'pl')}, er AS ({_errors('run_label, split', 'pl')}),
sc AS (SELECT kind, method, split, er.run_label, rmse, r2, spearman, smooth_l1, n FROM er JOIN sp USING (run_label, split) JOIN fx_configs USING (run_label))"""


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.predictions(spark, sf)
    label = F.when(F.col("run_label") == "A", "Orchestrate").when(F.col("run_label") == "N", "Orchestrate_partition_random").otherwise("Orchestrate_sparsification_pagerank")
    rows, by = rows.withColumn("run_label", label), ["run_label", "split"]
    return metrics.errors(rows, by).join(metrics.spearman(rows, by), by).join(fx.configs(spark, sf), "run_label")


@register("rep01_baseline_accuracy", _SCORES + " SELECT run_label, n, smooth_l1, rmse, r2, spearman FROM sc WHERE kind = 'none' AND split = 'test'", "predictions", "configs")
def rep01(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).where("kind = 'none' and coalesce(split, 'test') = 'test'").select("run_label", "n", "smooth_l1", "rmse", "r2", "spearman")


@register("rep04_retention", _SCORES + ", t AS (SELECT * FROM sc WHERE split = 'test'), b AS (SELECT avg(rmse) AS a, avg(r2) AS b, avg(spearman) AS c FROM t WHERE kind = 'none') SELECT kind, coalesce(method, '') AS method, rmse, r2, spearman, round(rmse - a, 8) + 0.0::DOUBLE AS rmse_change, round(r2 - b, 8) + 0.0::DOUBLE AS r2_change, round(spearman - c, 8) + 0.0::DOUBLE AS spearman_change FROM t CROSS JOIN b", "predictions", "configs")
def rep04(spark: SparkSession, sf: str) -> DataFrame:
    return reports.retention_table(_scores(spark, sf).where("split = 'test'"))


@register("rep05_cross_state", _SCORES + " SELECT m.kind, coalesce(m.method, '') AS method, m.rmse AS matched_rmse, f.rmse AS full_rmse, round(f.rmse - m.rmse, 8) + 0.0::DOUBLE AS rmse_drop, round(m.r2 - f.r2, 8) + 0.0::DOUBLE AS r2_drop FROM sc m JOIN sc f ON m.split = 'test' AND f.split = 'val' AND m.kind = f.kind AND coalesce(m.method, '') = coalesce(f.method, '')", "predictions", "configs")
def rep05(spark: SparkSession, sf: str) -> DataFrame:
    scores = _scores(spark, sf)
    return reports.cross_state(scores.where("split = 'test'"), scores.where("split = 'val'"))


_COST = f", co AS (SELECT kind, method, b.* FROM ({_BENCH}) b JOIN fx_configs USING (run_label))"


def _costs(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.benchmark(fx.per_graph(spark, sf), ["run_label"]).join(fx.configs(spark, sf), "run_label")


@register("rep06_tradeoff", _SCORES + _COST + " SELECT s.kind, coalesce(s.method, '') AS method, rmse, r2, mean_time, mean_vram FROM sc s LEFT JOIN co c ON s.kind = c.kind AND coalesce(s.method, '') = coalesce(c.method, '') WHERE split = 'test'", "predictions", "configs")
def rep06(spark: SparkSession, sf: str) -> DataFrame:
    return reports.tradeoff(_scores(spark, sf).where("split = 'test'"), _costs(spark, sf))


@register(
    "rep03_efficiency",
    _PAIRED + _SAVED + _COST + ", of AS (SELECT 'partition' AS kind, 'random' AS method, 0.5::DOUBLE AS edge_retention, 12.5::DOUBLE AS ms_per_graph) SELECT i.kind, i.method, i.graphs_per_s, i.mean_time, i.mean_vram, edge_retention, ms_per_graph, mean_vram_saving, mean_time_saving FROM co i LEFT JOIN of o ON o.kind = i.kind AND o.method = i.method LEFT JOIN sv ON sv.run_label = i.run_label WHERE i.kind <> 'none'",
    "per_graph",
    "configs",
)
def rep03(spark: SparkSession, sf: str) -> DataFrame:
    costs = _costs(spark, sf)
    offline = spark.createDataFrame([("partition", "random", 0.5, 12.5)], "kind string, method string, edge_retention double, ms_per_graph double")
    return reports.efficiency(costs, costs, offline, reports.savings_table(fx.per_graph(spark, sf), fx.configs(spark, sf)))


@register(
    "rep17_eval_passes",
    """, p AS (SELECT run_label, 0 AS pos, 'test' AS split, 'full_graph' AS eval_mode FROM fx_configs UNION ALL SELECT run_label, 1, 'test', 'matched_reduction' FROM fx_configs WHERE kind <> 'none'
    UNION ALL SELECT run_label, CASE WHEN kind <> 'none' THEN 2 ELSE 1 END, 'val', CASE WHEN kind <> 'none' THEN 'matched_reduction' ELSE 'full_graph' END FROM fx_configs) SELECT run_label, pos::INT AS pos, split, eval_mode FROM p""",
    "configs",
)
def rep17(spark: SparkSession, sf: str) -> DataFrame:
    return reports.eval_passes(fx.configs(spark, sf))


@register("snk13_cells", f", b AS ({_BENCH}) SELECT replace(run_label, '_', '\\_') AS run_label, n::VARCHAR AS n, printf('%.3f', mean_time) AS mean_time, printf('%.3f', graphs_per_s) AS graphs_per_s FROM b", "per_graph")
def snk13(spark: SparkSession, sf: str) -> DataFrame:
    return reports.cells(metrics.benchmark(fx.per_graph(spark, sf), ["run_label"]).select("run_label", "n", "mean_time", "graphs_per_s"))


@register("scl30_run_labels", ", l AS (SELECT run_label, kind, method FROM fx_configs UNION ALL SELECT 'Orchestrate_none_random', 'none', NULL UNION ALL SELECT 'a_none_thing', 'none', NULL) SELECT run_label, CASE run_label WHEN 'a_none_thing' THEN run_label ELSE 'Orchestrate' END AS algorithm, kind, method, CASE run_label WHEN 'Orchestrate_none_random' THEN 'random' ELSE 'design' END AS split, run_label AS again, 'test_' || CASE run_label WHEN 'a_none_thing' THEN run_label ELSE 'Orchestrate' END || CASE WHEN kind <> 'none' THEN '_' || kind || '_' || method ELSE '' END || '_cuda' || CASE run_label WHEN 'Orchestrate_none_random' THEN '_random' ELSE '' END AS tracker FROM l", "configs")
def scl30(spark: SparkSession, sf: str) -> DataFrame:
    labels = fx.configs(spark, sf).select("run_label").union(spark.createDataFrame([("Orchestrate_none_random",), ("a_none_thing",)], "run_label string"))
    parsed = labels.select("run_label", scalars.parsed_run_label(F.col("run_label")).alias("p")).select("run_label", "p.*")
    a, k, m, s = (F.col(c) for c in ("algorithm", "kind", "method", "split"))
    return parsed.withColumn("again", scalars.run_label(a, k, m, s)).withColumn("tracker", scalars.tracker_name(a, k, m, F.lit("cuda"), s))


@register(
    "scl32_tokens_and_names",
    "SELECT trial, substr(sha256('v2|' || trial || '|' || state), 1, 16) AS token, CASE WHEN trial % 2 = 0 THEN 'dynamic_nodes=5000000' ELSE 'fixed_graphs=32' END AS batching, 'a_b_' || CASE WHEN trial % 3 = 0 THEN 'all' ELSE trial::VARCHAR END || CASE WHEN trial % 2 = 0 THEN '' ELSE '_recipe' END || '_splits.json' AS splits_file, CASE WHEN trial % 2 = 0 THEN 64 * 4 ELSE 64 END::INT AS out_dim FROM fx_trials",
    "trials",
)
def scl32(spark: SparkSession, sf: str) -> DataFrame:
    t, lit = F.col("trial"), F.lit
    even = t % 2 == 0
    return fx.trials(spark, sf).select(
        "trial",
        scalars.stable_token(lit("v2"), t.cast("string"), F.col("state")).alias("token"),
        scalars.batching_label(even, lit(32), lit(5000000)).alias("batching"),
        scalars.splits_filename(F.array(lit("a"), lit("b")), F.when(t % 3 != 0, t), F.when(even, "design").otherwise("recipe")).alias("splits_file"),
        scalars.output_dim(lit(64), lit(3), F.when(even, "cat").otherwise("max")).alias("out_dim"),
    )


@register(
    "scl37_trial_failures",
    """SELECT message, CASE WHEN lower(message) LIKE '%memory guard%' THEN 'guard' WHEN lower(message) LIKE '%unable to mmap%' OR lower(message) LIKE '%dataloader worker%' THEN 'host' WHEN lower(message) LIKE '%cuda out of memory%' OR lower(message) LIKE '%illegal memory access%' THEN 'cuda'
      WHEN lower(message) LIKE '%out of memory%' OR lower(message) LIKE '%oom%' THEN CASE WHEN lower(message) LIKE '%cuda%' THEN 'cuda' ELSE 'host' END END AS failure, count(*) AS n FROM fx_trials GROUP BY ALL""",
    "trials",
)
def scl37(spark: SparkSession, sf: str) -> DataFrame:
    return fx.trials(spark, sf).groupBy("message", scalars.memory_failure(F.col("message")).alias("failure")).agg(F.count("*").alias("n"))


@register(
    "scl38_trial_costs",
    """, p AS (SELECT trial, 1000 + trial AS n, 2000 + 2 * trial AS m, 32 * (1 + trial % 4) AS h, 1 + trial % 5 AS l, ['cat', 'max'][(trial % 2 + 1)::INT] AS jk, ['gcn', 'graphgps', 'transformer_conv'][(trial % 3 + 1)::INT] AS e FROM fx_trials)
    SELECT trial, round((n::DOUBLE * h * l * CASE WHEN jk = 'cat' THEN l + 1 ELSE 1 END + m::DOUBLE * h * CASE WHEN e <> 'gcn' THEN 4 ELSE 1 END) * 1.5 * CASE WHEN e = 'graphgps' THEN 1.5 ELSE 1.0 END, 2) AS tokens,
      round(8 * (n::DOUBLE * h * l * CASE WHEN jk = 'cat' THEN l + 1 ELSE 1 END * 1.125 + m::DOUBLE * h * CASE WHEN e <> 'gcn' THEN 4 ELSE 1 END) * CASE WHEN e = 'graphgps' THEN 1.5 ELSE 1.0 END, 2) AS risk FROM p""",
    "trials",
)
def scl38(spark: SparkSession, sf: str) -> DataFrame:
    c, lit, t = F.col, F.lit, F.col("trial")
    pick = lambda *v: F.element_at(F.array(*map(lit, v)), (t % len(v) + 1).cast("int"))
    args = (1000 + t, 2000 + 2 * t, 32 * (1 + t % 4), 1 + t % 5, pick("cat", "max"), pick("gcn", "graphgps", "transformer_conv"), lit(4))
    tokens = scalars.memory_tokens(*args, lit(1.5))
    risk = scalars.trial_risk(lit(8), *args, lit("sin"), lit(16))
    return fx.trials(spark, sf).select(c("trial"), F.round(tokens, 2).alias("tokens"), F.round(risk, 2).alias("risk"))


@register("flt13_eligible_trials", "SELECT trial, value FROM fx_trials WHERE state = 'COMPLETE' ORDER BY value, trial LIMIT 10", "trials")
def flt13(spark: SparkSession, sf: str) -> DataFrame:
    return fx.trials(spark, sf).where("state = 'COMPLETE'").select("trial", "value").orderBy("value", "trial").limit(10)


@register("agg43_status_counts", "SELECT state, count(*) AS n FROM fx_trials GROUP BY 1", "trials")
def agg43(spark: SparkSession, sf: str) -> DataFrame:
    return fx.trials(spark, sf).groupBy("state").agg(F.count("*").alias("n"))


@register(
    "top04_best_checkpoint",
    ", c AS (SELECT user_id, 'epoch=' || trial || '-val_loss=' || printf('%.2f', value) || '.ckpt' AS name FROM fx_trials), v AS (SELECT user_id, name, regexp_extract(name, 'val_loss=([0-9.]+[0-9])', 1)::DOUBLE AS loss FROM c) SELECT user_id, min(name) AS best, any_value(loss) AS loss, count(*) AS n_tied FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY loss) AS r FROM v) WHERE r = 1 GROUP BY 1",
    "trials",
)
def top04(spark: SparkSession, sf: str) -> DataFrame:
    name = F.format_string("epoch=%d-val_loss=%.2f.ckpt", F.col("trial"), F.col("value"))
    held = fx.trials(spark, sf).select("user_id", name.alias("name")).withColumn("loss", F.regexp_extract("name", r"val_loss=([0-9.]+[0-9])", 1).cast("double"))
    best = held.groupBy("user_id", "loss").agg(F.min("name").alias("best"), F.count("*").alias("n_tied"))
    return best.groupBy("user_id").agg(F.min_by(F.struct("best", "loss", "n_tied"), "loss").alias("b")).select("user_id", "b.best", "b.loss", "b.n_tied")


@register("scl40_sinusoidal", ", n AS (SELECT DISTINCT level AS p FROM fx_samples WHERE level IS NOT NULL) SELECT p, round(sin(p), 6) AS s0, round(cos(p), 6) AS c0, round(sin(p * exp(-2 * ln(10000.0::DOUBLE) / 4)), 6) AS s1, round(cos(p * exp(-2 * ln(10000.0::DOUBLE) / 4)), 6) AS c1 FROM n", "samples")
def scl40(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.samples(spark, sf).where("level is not null").select(F.col("level").alias("p")).distinct().withColumn("e", scalars.sinusoidal(F.col("p"), 4))
    return rows.select("p", *[F.round(F.col("e")[i], 6).alias(n) for i, n in enumerate(("s0", "c0", "s1", "c1"))])


# Baselines

_SPLIT = """, pg AS (SELECT graph_path AS path, min(design) AS grp FROM fx_samples GROUP BY 1), rk0 AS (SELECT grp, row_number() OVER (ORDER BY cast('0x' || substr(md5('42:' || grp), 1, 8) AS BIGINT), grp) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM pg)),
sl AS (SELECT path, CASE WHEN r < greatest(1, floor(n * 0.8::DOUBLE)) THEN 'train' WHEN r < greatest(1, floor(n * 0.8::DOUBLE)) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM pg JOIN rk0 USING (grp)),
br AS (SELECT graph_path, design, target, num_pi, pre_nodes AS num_and, num_po, 1 + num_pi + pre_nodes + num_po AS num_nodes, 2 * pre_nodes + num_po AS num_edges, level, CASE tier_id WHEN 1 THEN algorithm ELSE 'tier0 base' END AS source_script, split FROM fx_samples JOIN sl ON path = graph_path),
tr AS (SELECT * FROM br WHERE split = 'train'), te AS (SELECT * FROM br WHERE split = 'test')"""


def _rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = fx.samples(spark, sf)
    split = sampling.grouped_split(rows, names.design_of_path(F.col("graph_path")), "graph_path", 42)
    held = rows.select(
        "graph_path", "design", "target", "num_pi", F.col("pre_nodes").alias("num_and"), "num_po",
        scalars.num_nodes(F.col("num_pi"), F.col("pre_nodes"), F.col("num_po")).alias("num_nodes"), scalars.num_edges(F.col("pre_nodes"), F.col("num_po")).alias("num_edges"),
        "level", names.source_script(F.col("graph_path")).alias("source_script"),
    )
    every = sampling.assigned(baselines.usable(held), "graph_path", split)
    return every.where("split = 'train'"), every.where("split = 'test'")


_CONSTANT = _SPLIT + ", c AS (SELECT avg(target) AS mean, median(target) AS median FROM tr), pr AS (SELECT 'mean' AS predictor, te.*, mean AS prediction FROM te, c UNION ALL SELECT 'median', te.*, median FROM te, c UNION ALL SELECT 'zero', te.*, 0.0::DOUBLE FROM te, c)"


@register("rq1_trivial_baselines", _CONSTANT + " " + _errors("predictor", "pr"), "samples")
def rq1(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, median and zero of train, scored on the test designs."""
    train, test = _rows(spark, sf)
    long = test.crossJoin(F.broadcast(baselines.constants(train))).unpivot(["target"], ["mean", "median", "zero"], "predictor", "prediction")  # one row
    return metrics.errors(long, ["predictor"])


@register("agg21_train_constants", _SPLIT + " SELECT round(avg(target), 8) AS mean, round(median(target), 8) AS median, 0.0::DOUBLE AS zero FROM tr", "samples")
def agg21(spark: SparkSession, sf: str) -> DataFrame:
    return baselines.constants(_rows(spark, sf)[0]).select(F.round("mean", 8).alias("mean"), F.round("median", 8).alias("median"), F.lit(0.0).alias("zero"))


@register("agg22_quantile_edges", _SPLIT + ", q AS (SELECT unnest(quantile_cont(level, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM tr) SELECT DISTINCT round(edge, 8) AS edge FROM q", "samples")
def agg22(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(round(e, 8),) for e in baselines.edges_of(_rows(spark, sf)[0], "level")], "edge double")


@register("agg23_group_means", _SPLIT + " SELECT source_script, round(avg(target), 8) AS mean, count(*) AS n FROM tr GROUP BY 1", "samples")
def agg23(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf)[0].groupBy("source_script").agg(F.round(F.avg("target"), 8).alias("mean"), F.count("*").alias("n"))


_CELLS = _SPLIT + """, qs AS (SELECT list_distinct(quantile_cont(num_nodes, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS a, list_distinct(quantile_cont(level, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS b FROM tr),
ce AS (SELECT br.*, len(list_filter(a, lambda e: e <= num_nodes)) AS ca, CASE WHEN level IS NULL THEN -1 ELSE len(list_filter(b, lambda e: e <= level)) END AS cb FROM br, qs), cm AS (SELECT ca, cb, avg(target) AS m FROM ce WHERE split = 'train' GROUP BY ALL),
cp AS (SELECT ce.*, coalesce(m, (SELECT avg(target) FROM tr)) AS prediction FROM ce LEFT JOIN cm USING (ca, cb) WHERE split = 'test')"""


@register("mlx04_size_level", _CELLS + " SELECT graph_path, num_nodes, round(prediction, 8) AS size_level, count(*) AS n FROM cp GROUP BY ALL", "samples")
def mlx04(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _rows(spark, sf)
    return baselines.cell_means(train, test).groupBy("graph_path", "num_nodes", F.round("size_level", 8).alias("size_level")).agg(F.count("*").alias("n"))


_STRATA = """, gs AS (SELECT design, stddev_samp(target) AS s FROM {0} GROUP BY 1), st AS (SELECT t.*, target > 0 AS nz, coalesce(s >= 0.05 * (SELECT stddev_samp(target) FROM {0}), false) AS lv FROM {0} t JOIN gs USING (design)),
sx AS (SELECT *, unnest(list_filter(['pooled', CASE WHEN nz THEN 'nonzero' END, CASE WHEN lv THEN 'live_designs' END, CASE WHEN nz AND lv THEN 'nonzero_live_designs' END, 'design:' || design], lambda x: x IS NOT NULL)) AS stratum FROM st)"""


@register("mlx06_strata", _SPLIT + _STRATA.format("te") + " SELECT stratum, count(*) AS n, round(avg(target), 8) AS mean FROM sx GROUP BY 1", "samples")
def mlx06(spark: SparkSession, sf: str) -> DataFrame:
    return baselines.strata(_rows(spark, sf)[1]).groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.avg("target"), 8).alias("mean"))


_SOURCE = ", sm AS (SELECT source_script, avg(target) AS m FROM tr GROUP BY 1), pr AS (SELECT te.*, coalesce(m, (SELECT avg(target) FROM tr)) AS prediction FROM te LEFT JOIN sm USING (source_script))"


@register("mlx05_source_script_mean", _SPLIT + _SOURCE + _STRATA.format("pr") + f", {_spearman('stratum', 'sx')}, e AS ({_errors('stratum', 'sx')}) SELECT 'source_script_mean' AS predictor, e.*, spearman FROM e LEFT JOIN sp USING (stratum)", "samples")
def mlx05(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _rows(spark, sf)
    return baselines.scores(baselines.group_means(train, test, "source_script", "source_script_mean"), baselines.ORACLE)


_FAIR = _CELLS + """, c AS (SELECT avg(target) AS mean, median(target) AS median FROM tr), pr AS (SELECT 'mean' AS predictor, design, target, mean AS prediction FROM te, c UNION ALL SELECT 'median', design, target, median FROM te, c UNION ALL SELECT 'zero', design, target, 0.0::DOUBLE FROM te UNION ALL SELECT 'size_level', design, target, prediction FROM cp),
gs AS (SELECT design, stddev_samp(target) AS s FROM te GROUP BY 1), st AS (SELECT pr.*, target > 0 AS nz, coalesce(s >= 0.05 * (SELECT stddev_samp(target) FROM te), false) AS lv FROM pr JOIN gs USING (design)),
sx AS (SELECT *, unnest(list_filter(['pooled', CASE WHEN nz THEN 'nonzero' END, CASE WHEN lv THEN 'live_designs' END, CASE WHEN nz AND lv THEN 'nonzero_live_designs' END, 'design:' || design], lambda x: x IS NOT NULL)) AS stratum FROM st)"""


@register("rep18_fair_scores", _FAIR + f", {_spearman('predictor, stratum', 'sx')}, e AS ({_errors('predictor, stratum', 'sx')}) SELECT e.*, spearman FROM e LEFT JOIN sp USING (predictor, stratum)", "samples")
def rep18(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _rows(spark, sf)
    rows = baselines.cell_means(train, test.crossJoin(F.broadcast(baselines.constants(train))))  # one row
    return baselines.scores(rows, ["mean", "median", "zero", "size_level"])


@register("mlx07_all_scores", None)
def mlx07(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _rows(spark, sf)
    return baselines.scores(baselines.predicted(train, test), baselines.FAIR)


@register("agg20_gram_sums", _SPLIT + " SELECT count(*)::DOUBLE AS n, round(sum(log10(num_nodes)), 4) AS x, round(sum(log10(num_edges)), 4) AS z, round(sum(log10(num_nodes) * log10(num_edges)), 4) AS xz, round(sum(log10(num_nodes) * target), 6) AS xy FROM tr", "samples")
def agg20(spark: SparkSession, sf: str) -> DataFrame:
    a, b = baselines.gram(_rows(spark, sf)[0], baselines.size_features(), F.col("target"))
    return spark.createDataFrame([(float(a[0, 0]), round(float(a[0, 1]), 4), round(float(a[0, 2]), 4), round(float(a[1, 2]), 4), round(float(b[1]), 6))], "n double, x double, z double, xz double, xy double")


@register("agg20_least_squares", None)
def agg20f(spark: SparkSession, sf: str) -> DataFrame:
    train = _rows(spark, sf)[0]
    rows = []
    for name, features in (("size", baselines.size_features()), ("counts", baselines.count_features())):
        coefficients, rank, condition = baselines.least_squares(train, features, F.col("target"))
        rows.append((name, coefficients, rank, condition))
    return spark.createDataFrame(rows, "design string, coefficients array<double>, rank int, condition double")


@register("win05_column_spread", "SELECT sample_id, round(stddev_samp(target) OVER (PARTITION BY design), 8) AS spread FROM fx_samples", "samples")
def win05(spark: SparkSession, sf: str) -> DataFrame:
    from gatelake.operators import quality

    return quality.column_spread(fx.samples(spark, sf), "design", "target").select("sample_id", F.round("spread", 8).alias("spread"))


@register("agg11_distinct_designs", "SELECT count(DISTINCT design) AS n_designs, count(DISTINCT graph_path) AS n_graphs FROM fx_samples", "samples")
def agg11(spark: SparkSession, sf: str) -> DataFrame:
    return fx.samples(spark, sf).agg(F.count_distinct("design").alias("n_designs"), F.count_distinct("graph_path").alias("n_graphs"))


# Message passing

_WEIGHTS, _EDGE_WEIGHTS, _BIAS = [[0.5, -0.25], [0.125, 0.75]], [[0.1, -0.2], [0.3, 0.05]], [0.01, -0.02]
_GCN = """, nx AS (SELECT graph_id, node_id, (role / 2.0)::DOUBLE AS a, ((node_id % 5) / 4.0)::DOUBLE AS b FROM fx_nodes), wx AS (SELECT graph_id, node_id, 0.5 * a - 0.25 * b AS p, 0.125 * a + 0.75 * b AS q FROM nx),
ms AS (SELECT e.graph_id, e.dst, p + CASE WHEN inv THEN -0.2 ELSE 0.1 END AS p, q + CASE WHEN inv THEN 0.05 ELSE 0.3 END AS q FROM fx_edges e JOIN wx ON wx.graph_id = e.graph_id AND wx.node_id = e.src),
ag AS (SELECT graph_id, dst AS node_id, sum(CASE WHEN p >= 0 THEN p ELSE p * 0.01 END) AS p, sum(CASE WHEN q >= 0 THEN q ELSE q * 0.01 END) AS q FROM ms GROUP BY ALL),
ou AS (SELECT graph_id, node_id, coalesce(p, 0) + 0.01 AS x0, coalesce(q, 0) - 0.02 AS x1 FROM nx LEFT JOIN ag USING (graph_id, node_id))"""


def _features(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return _featured(fx.gates(spark, sf))


def _featured(gates: DataFrame) -> tuple[DataFrame, DataFrame]:
    x = F.array(F.col("role") / 2.0, (F.col("node_id") % 5) / 4.0)
    return topology.nodes(gates).select("graph_id", "node_id", x.alias("x")), topology.edges(gates)


@register("mlx08_gcn_layer", _GCN + " SELECT graph_id, node_id, round(x0::DOUBLE, 6) + 0.0::DOUBLE AS x0, round(x1::DOUBLE, 6) + 0.0::DOUBLE AS x1 FROM ou", "topology")
def mlx08(spark: SparkSession, sf: str) -> DataFrame:
    out = message_passing.gcn(*_features(spark, sf), _WEIGHTS, _EDGE_WEIGHTS, _BIAS)
    return out.select("graph_id", "node_id", *[(F.round(F.col("x")[i], 6) + 0.0).alias(f"x{i}") for i in range(2)])


@register("mlx14_forward", _GCN + ", po AS (SELECT graph_id, avg(x0) AS a, avg(x1) AS b FROM ou GROUP BY 1) SELECT graph_id, round(1 / (1 + exp(-(1.5 * greatest(0.4 * a + 0.2 * b + 0.1, 0) - 0.7 * greatest(b - a, 0) + 0.05)::DOUBLE)), 6) AS prediction FROM po", "topology")
def mlx14(spark: SparkSession, sf: str) -> DataFrame:
    layer = {"weights": _WEIGHTS, "edge_weights": _EDGE_WEIGHTS, "bias": _BIAS}
    final = {"first": [[0.4, 0.2], [-1.0, 1.0]], "bias": [0.1, 0.0], "second": [1.5, -0.7], "offset": 0.05}
    return message_passing.forward(*_features(spark, sf), [layer], final).withColumn("prediction", F.round("prediction", 6))


@register("mlx09_layer_block", None)
def mlx09(spark: SparkSession, sf: str) -> DataFrame:
    args = _WEIGHTS, _EDGE_WEIGHTS, _BIAS, [[0.3, 0.1], [-0.2, 0.4]]
    features = lambda roles, nodes: np.stack([roles / 2.0, nodes % 5 / 4.0], 1)
    return graphs._by_size(spark, sf, lambda gates: passes.layer_block(gates, features, *args), lambda gates: message_passing.block(*_featured(gates), *args))


@register("mlx11_graph_norm", ", nx AS (SELECT graph_id, node_id, (role / 2.0)::DOUBLE AS a FROM fx_nodes), s AS (SELECT graph_id, avg(a) AS m, var_pop(a) AS v FROM nx GROUP BY 1) SELECT graph_id, node_id, round((a - m) / sqrt(v + 1e-5), 6) + 0.0::DOUBLE AS x0 FROM nx JOIN s USING (graph_id)", "topology")
def mlx11(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _features(spark, sf)[0]
    return message_passing.graph_norm(nodes, ["graph_id"]).select("graph_id", "node_id", (F.round(F.col("x")[0], 6) + 0.0).alias("x0"))


@register("mlx10_jumping_knowledge", "SELECT vec_id, round((embedding[1]::DOUBLE + embedding[2]::DOUBLE), 6) + 0.0::DOUBLE AS s, round(greatest(embedding[1]::DOUBLE, embedding[2]::DOUBLE), 6) + 0.0::DOUBLE AS m FROM embeddings")
def mlx10(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    a, b = F.slice(x, 1, 1), F.slice(x, 2, 1)
    jk = message_passing.jumping_knowledge
    return fx.read(spark, sf, "embeddings").select("vec_id", (F.round(jk([a, b], "sum")[0], 6) + 0.0).alias("s"), (F.round(jk([a, b], "max")[0], 6) + 0.0).alias("m"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return fx.read(spark, sf, "embeddings").select(F.col("label").alias("graph_id"), (F.col("vec_id") % 3).cast("int").alias("part"), F.col("embedding").cast("array<double>").alias("x"))


_LONG = ", v AS (SELECT label AS graph_id, (vec_id % 3)::INT AS part, i - 1 AS dim, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"


@register("agg39_pooled", "WITH " + _LONG[2:] + " SELECT graph_id, dim::INT AS dim, round(avg(x), 6) + 0.0::DOUBLE AS mean, round(sum(x), 5) + 0.0::DOUBLE AS total, round(max(x), 6) + 0.0::DOUBLE AS top FROM v GROUP BY ALL")
def agg39(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf)
    one = lambda how, name, digits: message_passing.pool(rows, ["graph_id"], how).select("graph_id", F.posexplode("x").alias("dim", "v")).select("graph_id", "dim", (F.round("v", digits) + 0.0).alias(name))
    return one("mean", "mean", 6).join(one("sum", "total", 5), ["graph_id", "dim"]).join(one("max", "top", 6), ["graph_id", "dim"])


@register("agg40_hierarchical_pool", "WITH " + _LONG[2:] + ", p AS (SELECT graph_id, part, dim, avg(x) AS x FROM v GROUP BY ALL) SELECT graph_id, dim::INT AS dim, round(avg(x), 6) + 0.0::DOUBLE AS mean FROM p GROUP BY ALL")
def agg40(spark: SparkSession, sf: str) -> DataFrame:
    out = message_passing.hierarchical_pool(_vectors(spark, sf), "mean")
    return out.select("graph_id", F.posexplode("x").alias("dim", "v")).select("graph_id", "dim", (F.round("v", 6) + 0.0).alias("mean"))


@register("rep09_hardware_bars", _COST[0:0] + f", co AS (SELECT kind, method, b.* FROM ({_BENCH}) b JOIN fx_configs USING (run_label)), q AS (SELECT kind, coalesce(method, '') AS method, mean_time, graphs_per_s, mean_vram, max_vram, mean_reserved FROM co) UNPIVOT q ON mean_time, graphs_per_s, mean_vram, max_vram, mean_reserved INTO NAME measure VALUE value", "per_graph", "configs")
def rep09(spark: SparkSession, sf: str) -> DataFrame:
    return reports.hardware_bars(_costs(spark, sf))


@register("rep10_offline_bars", ", l AS (SELECT l_shipmode_like AS method, l_quantity AS ms, l_linestatus FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'x' ELSE 'y' END AS l_shipmode_like, l_quantity, l_linestatus FROM lineitem)) SELECT CASE l_linestatus WHEN 'O' THEN 'sparsification' ELSE 'partition' END AS kind, method, round(avg(ms), 6) AS ms_per_graph FROM l GROUP BY ALL", "trials")
def rep10(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.read(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "A", "x").otherwise("y").alias("method"), F.col("l_quantity").alias("ms"), "l_linestatus")
    return reports.offline_bars(("sparsification", rows.where("l_linestatus = 'O'")), ("partition", rows.where("l_linestatus != 'O'")))


@register("rep11_accuracy_bars", _SCORES + ", t AS (SELECT * FROM sc WHERE split = 'test') SELECT kind, coalesce(method, '') AS method, rmse, r2, (SELECT avg(rmse) FROM t WHERE kind = 'none') AS base_rmse, (SELECT avg(r2) FROM t WHERE kind = 'none') AS base_r2 FROM t WHERE kind <> 'none'", "predictions", "configs")
def rep11(spark: SparkSession, sf: str) -> DataFrame:
    return reports.accuracy_bars(_scores(spark, sf).where("split = 'test'"))


@register("agg28_mean_interval", None)
def agg28(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.mean_interval(fx.per_graph(spark, sf).where("run_label = 'Orchestrate'").groupBy("run_label", "graph_id").agg(F.avg("vram_mb").alias("v")), ["run_label"], "graph_id", "v", 200)


@register("agg44_split_sizes", _SPLIT + " SELECT split, count(*) AS n, round(avg(target), 8) AS mean FROM br WHERE split <> 'val' GROUP BY 1", "samples")
def agg44(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _rows(spark, sf)
    return train.unionByName(test).groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg("target"), 8).alias("mean"))


@register("flt04_usable_rows", "SELECT count(*) AS n, count(level) AS n_level FROM fx_samples WHERE 1 + num_pi + pre_nodes + num_po > 0", "samples")
def flt04(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    rows = fx.samples(spark, sf).withColumn("num_and", c("pre_nodes")).withColumn("num_nodes", scalars.num_nodes(c("num_pi"), c("pre_nodes"), c("num_po"))).withColumn("num_edges", scalars.num_edges(c("pre_nodes"), c("num_po")))
    return baselines.usable(rows).agg(F.count("*").alias("n"), F.count("level").alias("n_level"))


@register("src22_checkpoints", ", c AS (SELECT trial, 'm/epoch=' || trial || '-val_loss=' || printf('%.4f', value) || '.ckpt' AS path FROM fx_trials) SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(path, 'val_loss=([0-9]*\\.?[0-9]+)', 1)::DOUBLE AS val_loss FROM c", "trials")
def src22(spark: SparkSession, sf: str) -> DataFrame:
    from gatelake.sources import readers

    return readers.checkpoints(fx.trials(spark, sf).select(F.format_string("m/epoch=%d-val_loss=%.4f.ckpt", F.col("trial"), F.col("value")).alias("path")))
