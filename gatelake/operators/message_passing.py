"""Forward message passing and pooling over node and edge tables, with features as arrays of doubles.

Weights are small matrices given as lists, and become literals of the plan; sums over neighbours and graphs are grouped
sums by dimension. Training needs a gradient and is not here; ``fit`` and ``search`` offer Spark's
own regressors on pooled features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelake.functions import rng

Matrix = Sequence[Sequence[float]]


def _vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def matvec(weights: Matrix, x: Column, bias: Sequence[float] | None = None) -> Column:
    rows = [dot(_vector(row), x) for row in weights]
    return F.array(*[r + F.lit(float(b)) for r, b in zip(rows, bias, strict=True)] if bias is not None else rows)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def leaky_relu(x: Column, slope: float = 0.01) -> Column:
    return F.transform(x, lambda v: F.when(v >= 0, v).otherwise(v * slope))


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def sum_by(rows: DataFrame, by: Sequence[str], x: str, how=F.sum) -> DataFrame:
    """Arrays of a group combined dimension by dimension."""
    long = rows.select(*by, F.posexplode(x).alias("_i", "_v")).groupBy(*by, "_i").agg(how("_v").alias("_v"))
    return long.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"]).alias(x))


def gcn(nodes: DataFrame, edges: DataFrame, weights: Matrix, edge_weights: Matrix, bias: Sequence[float], scale: str | None = None) -> DataFrame:
    """One layer: the sum of leaky_relu(W x_src + E e) over incoming edges, plus a bias. ``nodes`` has x, ``edges`` has
    e = [regular, inverted] in ``inv``; ``scale`` names a column of edge weights."""
    sent = nodes.select("graph_id", F.col("node_id").alias("src"), matvec(weights, F.col("x")).alias("wx"))
    kind = F.when(F.col("inv"), _vector([r[1] for r in edge_weights])).otherwise(_vector([r[0] for r in edge_weights]))
    message = leaky_relu(plus(F.col("wx"), kind))
    if scale is not None:
        message = F.transform(message, lambda v: v * F.col(scale))
    got = sum_by(edges.join(sent, ["graph_id", "src"]).select("graph_id", F.col("dst").alias("node_id"), message.alias("got")), ["graph_id", "node_id"], "got")
    zero = _vector([0.0] * len(weights))
    return nodes.join(got, ["graph_id", "node_id"], "left").withColumn("x", plus(F.coalesce("got", zero), _vector(bias))).drop("got")


def graph_norm(nodes: DataFrame, by: Sequence[str], epsilon: float = 1e-5) -> DataFrame:
    """Features with the mean of their group taken off and divided by its deviation."""
    long = nodes.select(*by, F.posexplode("x").alias("_i", "_v")).groupBy(*by, "_i").agg(F.avg("_v").alias("_m"), F.var_pop("_v").alias("_s"))
    stats = long.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_i", "_m", "_s"))).alias("_t"))
    return nodes.join(stats, list(by)).withColumn("x", F.zip_with("x", "_t", lambda v, t: (v - t["_m"]) / F.sqrt(t["_s"] + epsilon))).drop("_t")


def jumping_knowledge(layers: Sequence[Column], mode: str) -> Column:
    """All layers' features: cat, max, sum or the last."""
    if mode == "cat":
        return F.concat(*layers)
    if mode == "last":
        return layers[-1]
    combine = {"sum": lambda a, b: a + b, "max": lambda a, b: F.greatest(a, b)}[mode]
    out = layers[0]
    for layer in layers[1:]:
        out = F.zip_with(out, layer, combine)
    return out


def block(nodes: DataFrame, edges: DataFrame, weights: Matrix, edge_weights: Matrix, bias: Sequence[float], feed: Matrix) -> DataFrame:
    """A layer with activation, residual, norm, feed-forward residual and norm, as at inference (no dropout)."""
    same = len(weights) == len(weights[0])
    before = nodes.withColumn("_x", F.col("x"))
    out = gcn(before, edges, weights, edge_weights, bias).withColumn("x", relu(F.col("x")))
    out = graph_norm(out.withColumn("x", plus(F.col("x"), F.col("_x"))) if same else out, ["graph_id"]).drop("_x")
    return graph_norm(out.withColumn("x", plus(F.col("x"), relu(matvec(feed, F.col("x"))))), ["graph_id"])


def pool(nodes: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """mean, sum or max of the features of a group."""
    return sum_by(nodes.select(*by, "x"), by, "x", {"mean": F.avg, "sum": F.sum, "max": F.max}[how])


def hierarchical_pool(nodes: DataFrame, how: str) -> DataFrame:
    """Nodes to parts, then parts to graphs."""
    return pool(pool(nodes, ["graph_id", "part"], how), ["graph_id"], how)


def head(x: Column, first: Matrix, bias: Sequence[float], second: Sequence[float], offset: float) -> Column:
    """Linear, relu, linear, sigmoid."""
    return sigmoid(dot(_vector(second), relu(matvec(first, x, bias))) + F.lit(float(offset)))


def forward(nodes: DataFrame, edges: DataFrame, layers: Sequence[dict], final: dict, how: str = "mean") -> DataFrame:
    """(graph_id, prediction): layers, pooling and head."""
    for layer in layers:
        nodes = gcn(nodes, edges, **layer)
    pooled = pool(nodes, ["graph_id"], how)
    return pooled.select("graph_id", head(F.col("x"), **final).alias("prediction"))


def node_inputs(nodes: DataFrame, table: Matrix, encodings: Sequence[str], by: Sequence[str] = ("graph_id",)) -> DataFrame:
    """What the first layer reads: a row of ``table`` by the node's role beside its encodings, normalised by graph, or by
    graph and part."""
    embedded = F.element_at(F.array(*[_vector(row) for row in table]), F.col("role") + 1)
    rows = nodes.select(*by, "node_id", F.concat(embedded, F.array(*[F.col(c).cast("double") for c in encodings])).alias("x"))
    return graph_norm(rows, list(by))


def _data(pooled: DataFrame, target: str, *more: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return pooled.select(array_to_vector("x").alias("features"), F.col(target).cast("double").alias("label"), *more)


def fit(pooled: DataFrame, target: str, penalty: float = 1e-6):
    """A linear regressor of Spark on pooled features: training that is native to Spark, in place of a network's."""
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(solver="normal", regParam=penalty).fit(_data(pooled, target))


def search(pooled: DataFrame, target: str, penalties: Sequence[float], mixes: Sequence[float], key: str, folds: int = 3, seed: int = 42) -> DataFrame:
    """(penalty, mix, rmse, best): a grid of settings of the regressor by cross-validation. A row's fold is a hash of its key,
    so the search gives the same result however the rows are dealt."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    model = LinearRegression(standardization=False)
    grid = ParamGridBuilder().addGrid(model.regParam, list(penalties)).addGrid(model.elasticNetParam, list(mixes)).build()
    dealt = _data(pooled.withColumn("fold", rng.bucket(seed, folds, key)), target, "fold")
    done = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=RegressionEvaluator(metricName="rmse"), numFolds=folds, foldCol="fold", seed=seed).fit(dealt)
    rows = [(float(p[model.regParam]), float(p[model.elasticNetParam]), float(m)) for p, m in zip(grid, done.avgMetrics, strict=True)]
    least = min(range(len(rows)), key=lambda i: (rows[i][2], i))
    return pooled.sparkSession.createDataFrame([(*r, i == least) for i, r in enumerate(rows)], "penalty double, mix double, rmse double, best boolean")


def offset_ids(nodes: DataFrame, batch: str) -> DataFrame:
    """Node ids made distinct within a batch of graphs."""
    sizes = nodes.groupBy(batch, "graph_id").agg(F.max("node_id").alias("_top"))
    w = Window.partitionBy(batch).orderBy("graph_id").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("graph_id", F.coalesce(F.sum(F.col("_top") + 1).over(w), F.lit(0)).alias("_start"))
    return nodes.join(start, "graph_id").withColumn("batch_node", F.col("node_id") + F.col("_start")).drop("_start")
