"""Report tables: savings, efficiency, retention, cross-state and scaling, and their cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelake.functions import scalars
from gatelake.operators import metrics
from gatelake.sources import scratch


def same_method(a: Column, b: Column) -> Column:
    """Equality of methods; the run on whole graphs has none, stored as null or empty."""
    return F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))


def baseline_label(configs: DataFrame) -> DataFrame:
    return configs.where("kind = 'none'").agg(F.min("run_label").alias("base_label"))


def per_graph_means(rows: DataFrame, exact: bool = False) -> DataFrame:
    """Measurements averaged over the repeats of a graph in a run; ``exact``: like repeats in any order have the same means."""
    if exact:
        return metrics.exact_means(rows, ["run_label", "graph_id"], ["step_time_s", "vram_mb"]).withColumnsRenamed({"step_time_s": "time", "vram_mb": "vram"})
    return rows.groupBy("run_label", "graph_id").agg(F.avg("step_time_s").alias("time"), F.avg("vram_mb").alias("vram"))


def paired_savings(rows: DataFrame, configs: DataFrame, exact: bool = False) -> DataFrame:
    """(run_label, graph_id, vram_saving, time_saving): reduced graphs against themselves at full size, in percent. For
    ranks take ``exact`` means, so that equal savings are ties."""
    means = per_graph_means(rows, exact)
    if exact:
        means = scratch.kept(means, "means")  # both sides read it, and neither would take over the other's shuffle
    base = F.broadcast(baseline_label(configs))  # one row
    full = means.join(base, means.run_label == base.base_label).select("graph_id", F.col("time").alias("base_time"), F.col("vram").alias("base_vram"))
    reduced = means.join(base, means.run_label != base.base_label).drop("base_label")
    return reduced.join(full, "graph_id").select("run_label", "graph_id", scalars.saving(F.col("vram"), F.col("base_vram")).alias("vram_saving"), scalars.saving(F.col("time"), F.col("base_time")).alias("time_saving"))


def with_config(rows: DataFrame, configs: DataFrame) -> DataFrame:
    """Rows with the reduction and method of their run, empty where it is unknown."""
    found = rows.join(configs.select("run_label", "kind", "method"), "run_label", "left")
    return found.withColumn("kind", F.coalesce("kind", F.lit(""))).withColumn("method", F.coalesce("method", F.lit("")))


def savings_table(rows: DataFrame, configs: DataFrame) -> DataFrame:
    paired = paired_savings(rows, configs)
    means = paired.groupBy("run_label").agg(F.count("*").alias("n_paired"), F.round(F.avg("vram_saving"), 6).alias("mean_vram_saving"), F.round(F.avg("time_saving"), 6).alias("mean_time_saving"))
    return with_config(means, configs).select("kind", "method", "n_paired", "mean_vram_saving", "mean_time_saving")


def savings_tests(rows: DataFrame, configs: DataFrame, times: int = 200) -> DataFrame:
    """Interval of the mean VRAM saving and the signed-rank p of each reduced run."""
    paired = paired_savings(rows, configs, exact=True)
    interval = metrics.mean_interval(paired, ["run_label"], "graph_id", "vram_saving", times)
    return interval.join(metrics.wilcoxon(paired, ["run_label"], "vram_saving"), "run_label")


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in an explicit order."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_r = 1").drop("_r")


def efficiency(inference: DataFrame, training: DataFrame, offline: DataFrame, savings: DataFrame) -> DataFrame:
    """By reduced run: offline retention and ms, training cost, inference speed and savings, null where unknown."""
    base = inference.where("kind != 'none'").select("kind", "method", "graphs_per_s")
    out = base.alias("i")
    for name, df in (("t", training), ("o", offline), ("s", savings)):
        out = out.join(df.alias(name), (F.col("i.kind") == F.col(f"{name}.kind")) & same_method(F.col("i.method"), F.col(f"{name}.method")), "left")
    return out.select("i.kind", "i.method", "i.graphs_per_s", "t.mean_time", "t.mean_vram", "o.edge_retention", "o.ms_per_graph", "s.mean_vram_saving", "s.mean_time_saving")


def retention_table(scores: DataFrame) -> DataFrame:
    """Scores of each run and their differences from the run on whole graphs."""
    base = scores.where("kind = 'none'").agg(F.avg("rmse").alias("_rmse"), F.avg("r2").alias("_r2"), F.avg("spearman").alias("_rho"))
    both = scores.crossJoin(F.broadcast(base))  # one row
    d = lambda a, b: F.round(F.col(a) - F.col(b), 8) + F.lit(0.0)
    return both.select("kind", F.coalesce("method", F.lit("")).alias("method"), "rmse", "r2", "spearman", d("rmse", "_rmse").alias("rmse_change"), d("r2", "_r2").alias("r2_change"), d("spearman", "_rho").alias("spearman_change"))


def cross_state(matched: DataFrame, full: DataFrame) -> DataFrame:
    """Each run on graphs reduced as in training, and on whole graphs, with what the other state costs."""
    m, f = matched.alias("m"), full.alias("f")
    on = (F.col("m.kind") == F.col("f.kind")) & same_method(F.col("m.method"), F.col("f.method"))
    return m.join(f, on).select(
        "m.kind",
        F.coalesce("m.method", F.lit("")).alias("method"),
        F.col("m.rmse").alias("matched_rmse"),
        F.col("f.rmse").alias("full_rmse"),
        (F.round(F.col("f.rmse") - F.col("m.rmse"), 8) + F.lit(0.0)).alias("rmse_drop"),
        (F.round(F.col("m.r2") - F.col("f.r2"), 8) + F.lit(0.0)).alias("r2_drop"),
    )


def tradeoff(scores: DataFrame, costs: DataFrame) -> DataFrame:
    """Accuracy beside cost of each run."""
    s, c = scores.alias("s"), costs.alias("c")
    return s.join(c, (F.col("s.kind") == F.col("c.kind")) & same_method(F.col("s.method"), F.col("c.method")), "left").select("s.kind", F.coalesce("s.method", F.lit("")).alias("method"), "s.rmse", "s.r2", "c.mean_time", "c.mean_vram")


def vram_scaling(rows: DataFrame) -> DataFrame:
    """MB per 1000 nodes and intercept of a line through each run's graphs, two at least."""
    fit = rows.groupBy("run_label").agg(F.regr_slope("vram_mb", "num_nodes").alias("slope"), F.regr_intercept("vram_mb", "num_nodes").alias("intercept"), F.count("*").alias("n"))
    return fit.where("n >= 2").select("run_label", F.round(F.col("slope") * 1000, 6).alias("mb_per_1k_nodes"), F.round("intercept", 4).alias("intercept"), "n")


def parity_limits(rows: DataFrame) -> DataFrame:
    """Common axis limits of targets and predictions of each run."""
    return rows.groupBy("run_label").agg(F.least(F.min("target"), F.min("prediction")).alias("low"), F.greatest(F.max("target"), F.max("prediction")).alias("high"), F.count("*").alias("n"))


def size_points(rows: DataFrame, configs: DataFrame) -> DataFrame:
    """The first saving of each graph beside its full size, for a scatter plot."""
    base = F.broadcast(baseline_label(configs))  # one row
    order = ["num_nodes", "vram_mb", "step_time_s"]
    first = first_rows(rows, ["run_label", "graph_id"], order)
    full = first.join(base, first.run_label == base.base_label).select("graph_id", F.col("num_nodes").alias("full_nodes"), F.col("vram_mb").alias("full_vram"))
    reduced = first.join(base, first.run_label != base.base_label)
    return reduced.join(full, "graph_id").select("run_label", "graph_id", "full_nodes", F.round(scalars.saving(F.col("vram_mb"), F.col("full_vram")), 6).alias("vram_saving"))


def eval_passes(configs: DataFrame, split: str = "test", skip_val: bool = False, skip_full: bool = False) -> DataFrame:
    """(run_label, pos, split, eval_mode): passes over whole graphs and as in training, then one over val."""
    reduced = F.col("kind") != "none"
    one = lambda s, m: F.struct(F.lit(s).alias("split"), m.alias("eval_mode"))
    passes = [] if skip_full else [one(split, F.lit("full_graph"))]
    passes.append(F.when(reduced, one(split, F.lit("matched_reduction"))))
    if split == "test" and not skip_val:
        passes.append(one("val", F.when(reduced, "matched_reduction").otherwise("full_graph")))
    return configs.select("run_label", F.posexplode(F.array_compact(F.array(*passes))).alias("pos", "p")).select("run_label", "pos", "p.split", "p.eval_mode")


def cells(rows: DataFrame) -> DataFrame:
    """All columns as cells of a printed table: numbers to 3 places, -- for what is undefined, signs escaped."""
    out = []
    for name, kind in rows.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            out.append(F.when(c.isNull() | F.isnan(c), "--").otherwise(F.format_string("%.3f", c)).alias(name))
        elif kind == "string":
            out.append(F.replace(F.replace(c, F.lit("_"), F.lit("\\_")), F.lit("%"), F.lit("\\%")).alias(name))
        else:
            out.append(c.cast("string").alias(name))
    return rows.select(*out)


def booktabs(rows: DataFrame, caption: str, label: str) -> str:
    """A printed table of a report, which is small by its nature; empty for no rows."""
    numeric = [kind != "string" for _, kind in rows.dtypes]
    body = cells(rows).collect()
    if not body:
        return ""
    escape = lambda s: s.replace("_", r"\_").replace("%", r"\%")
    head = " & ".join(rf"\textbf{{{escape(c)}}}" for c in rows.columns) + r" \\"
    lines = [" & ".join(r) + r" \\" for r in body]
    frame = [r"\begin{table}[h]", r"\centering", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{''.join('r' if n else 'l' for n in numeric)}}}", r"\toprule", head, r"\midrule"]
    return "\n".join([*frame, *lines, r"\bottomrule", r"\end{tabular}", r"\end{table}", ""])


def hardware_bars(costs: DataFrame) -> DataFrame:
    """The bars of the hardware figure, long: one row a run and measure."""
    measures = ["mean_time", "graphs_per_s", "mean_vram", "max_vram", "mean_reserved"]
    return costs.withColumn("method", F.coalesce("method", F.lit(""))).unpivot(["kind", "method"], measures, "measure", "value")


def offline_bars(*families: tuple[str, DataFrame]) -> DataFrame:
    """Mean milliseconds a graph of every method of the given families."""
    out = None
    for kind, df in families:
        part = df.groupBy("method").agg(F.round(F.avg("ms"), 6).alias("ms_per_graph")).select(F.lit(kind).alias("kind"), "method", "ms_per_graph")
        out = part if out is None else out.unionByName(part)
    return out


def accuracy_bars(scores: DataFrame) -> DataFrame:
    """Scores of the reduced runs beside the lines of the run on whole graphs."""
    base = scores.where("kind = 'none'").agg(F.avg("rmse").alias("base_rmse"), F.avg("r2").alias("base_r2"))
    return scores.where("kind != 'none'").crossJoin(F.broadcast(base)).select("kind", F.coalesce("method", F.lit("")).alias("method"), "rmse", "r2", "base_rmse", "base_r2")  # one row


def realigned(order: DataFrame, values: DataFrame) -> DataFrame:
    """Values that a model gave in batch order, beside the sample each is of: ``order`` has (batch_id, pos, idx)."""
    return order.join(values, ["batch_id", "pos"]).select("idx", "batch_id", "pos", "value")


def only(rows: DataFrame, **wanted: str) -> DataFrame:
    """Rows of which every given column has the wanted value; null counts as empty."""
    for column, value in wanted.items():
        rows = rows.where(F.coalesce(F.col(column), F.lit("")) == value)
    return rows


def of_test(rows: DataFrame) -> DataFrame:
    """Rows of the test split; a row that does not say is one."""
    return rows.where(F.coalesce("split", F.lit("test")) == "test")


def method_means(rows: DataFrame, *columns: str) -> DataFrame:
    """Means of measurements by method."""
    return rows.groupBy("method").agg(*[F.round(F.avg(c), 6).alias(c) for c in columns], F.count("*").alias("n"))


def cross_state_bars(pairs: DataFrame) -> DataFrame:
    """The bars of the cross-state figure, long: a row a run and state."""
    return pairs.unpivot(["kind", "method"], ["matched_rmse", "full_rmse"], "state", "rmse")


def figure_points(predictions: DataFrame, scores: DataFrame, costs: DataFrame) -> DataFrame:
    """(figure, series, x, y, n): the points of the parity, bar and trade-off figures, for any plotting tool."""
    run = F.concat_ws("_", "kind", F.nullif(F.coalesce("method", F.lit("")), F.lit("")))
    parity = predictions.groupBy(F.col("run_label").alias("series"), F.col("target").alias("x"), F.col("prediction").alias("y")).agg(F.count("*").alias("n")).select(F.lit("parity").alias("figure"), "series", "x", "y", "n")
    pareto = tradeoff(scores, costs).select(F.lit("pareto").alias("figure"), run.alias("series"), F.col("mean_vram").alias("x"), F.col("rmse").alias("y"), F.lit(1).cast("long").alias("n"))
    bars = scores.select(F.lit("accuracy").alias("figure"), run.alias("series"), F.col("r2").alias("x"), F.col("rmse").alias("y"), F.col("n").cast("long").alias("n"))
    return parity.unionByName(pareto).unionByName(bars)
