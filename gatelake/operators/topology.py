"""Graphs of AND gates: node and edge tables, levels, path counts, neighbourhood sums and degree weights.

Nodes are (graph_id, node_id, role): 0 constant, 1 primary input, 2 AND gate, 3 primary output. Edges are (graph_id,
edge_id, src, dst, inv). Fanins have smaller ids than their gate, so ascending ids are a topological order."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PATH_DEPTH = 10
N_INPUTS = 8


def fanins(gates: DataFrame) -> DataFrame:
    ports = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("inv_a").alias("inv"), F.lit(0).alias("port")), F.struct(F.col("b").alias("src"), F.col("inv_b").alias("inv"), F.lit(1).alias("port"))))
    return gates.select("graph_id", F.col("gate").alias("dst"), ports.alias("p")).select("graph_id", "p.src", "dst", "p.inv", "p.port")


def outputs(gates: DataFrame) -> DataFrame:
    """(graph_id, gate, po): a primary output of its own for each gate that feeds no other, numbered after the gates."""
    sinks = gates.select("graph_id", "gate").join(fanins(gates).select("graph_id", F.col("src").alias("gate")).distinct(), ["graph_id", "gate"], "left_anti")
    top = gates.groupBy("graph_id").agg(F.max("gate").alias("top"))
    order = Window.partitionBy("graph_id").orderBy("gate")
    return sinks.withColumn("n", F.row_number().over(order)).join(top, "graph_id").select("graph_id", "gate", (F.col("top") + F.col("n")).alias("po"))


def nodes(gates: DataFrame) -> DataFrame:
    base = gates.select("graph_id").distinct().select("graph_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(N_INPUTS).cast("long"))).alias("node_id"))
    fixed = base.select("graph_id", "node_id", F.when(F.col("node_id") == 0, 0).otherwise(1).alias("role"))
    ands = gates.select("graph_id", F.col("gate").alias("node_id"), F.lit(2).alias("role"))
    return fixed.unionByName(ands).unionByName(outputs(gates).select("graph_id", F.col("po").alias("node_id"), F.lit(3).alias("role")))


def edges(gates: DataFrame) -> DataFrame:
    out = outputs(gates).select("graph_id", F.col("gate").alias("src"), F.col("po").alias("dst"), F.lit(False).alias("inv"), F.lit(0).alias("port"))
    order = Window.partitionBy("graph_id").orderBy("dst", "port")
    every = fanins(gates).unionByName(out)
    return every.select("graph_id", (F.row_number().over(order) - 1).cast("long").alias("edge_id"), "src", "dst", "inv")


def _packed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row a graph, with its node and edge lists: the unit of the algorithms that need a whole graph at once."""
    n = nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "role"))).alias("nodes"))
    e = edges.groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    return n.join(e, "graph_id", "left")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest distance of each node from a constant or input, in one ascending pass over each graph."""

    def run(batches):
        for frame in batches:
            out = []
            for graph_id, held, links in zip(frame["graph_id"], frame["nodes"], frame["edges"], strict=True):
                level = {n["node_id"]: 0 for n in held}
                for e in sorted(() if links is None else links, key=lambda e: e["dst"]):
                    level[e["dst"]] = max(level[e["dst"]], level[e["src"]] + 1)
                out.append(pd.DataFrame({"graph_id": graph_id, "node_id": list(level), "level": list(level.values())}))
            yield pd.concat(out) if out else pd.DataFrame({"graph_id": [], "node_id": [], "level": []})

    return _packed(nodes, edges).mapInPandas(run, "graph_id long, node_id long, level long")


def input_paths(nodes: DataFrame, edges: DataFrame, levels: DataFrame, max_jump: int = MAX_PATH_DEPTH) -> DataFrame:
    """log(1 + number of paths from primary inputs); an edge over more than ``max_jump`` levels is not followed.

    Counts outgrow every integer type, so they are exact whole numbers inside a graph's pass and leave it as logs."""
    src = levels.select("graph_id", F.col("node_id").alias("src"), F.col("level").alias("ls"))
    dst = levels.select("graph_id", F.col("node_id").alias("dst"), F.col("level").alias("ld"))
    near = edges.join(src, ["graph_id", "src"]).join(dst, ["graph_id", "dst"]).where(F.col("ld") - F.col("ls") <= max_jump).select("graph_id", "src", "dst")

    def run(batches):
        for frame in batches:
            out = []
            for graph_id, held, links in zip(frame["graph_id"], frame["nodes"], frame["edges"], strict=True):
                paths = {n["node_id"]: int(n["role"] == 1) for n in held}
                for e in sorted(() if links is None else links, key=lambda e: e["dst"]):
                    paths[e["dst"]] += paths[e["src"]]
                out.append(pd.DataFrame({"graph_id": graph_id, "node_id": list(paths), "log_paths": [math.log(1 + v) for v in paths.values()]}))
            yield pd.concat(out) if out else pd.DataFrame({"graph_id": [], "node_id": [], "log_paths": []})

    return _packed(nodes, near).mapInPandas(run, "graph_id long, node_id long, log_paths double")


def local_sums(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Sum of the distances to the nodes one and two steps downstream."""
    one = edges.select("graph_id", "src", "dst").distinct().where("src != dst")
    hop = one.select("graph_id", F.col("src").alias("mid"), F.col("dst").alias("far"))
    two = one.withColumnRenamed("dst", "mid").join(hop, ["graph_id", "mid"]).select("graph_id", "src", F.col("far").alias("dst")).where("src != dst")
    reached = one.withColumn("d", F.lit(1)).unionByName(two.withColumn("d", F.lit(2))).groupBy("graph_id", "src", "dst").agg(F.min("d").alias("d"))
    sums = reached.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.sum("d").alias("local_sum"))
    return nodes.select("graph_id", "node_id").join(sums, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("local_sum", F.lit(0)).cast("long").alias("local_sum"))


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.count("*").alias("degree"))


def edge_weights(edges: DataFrame) -> DataFrame:
    """Symmetric normalisation by the in-degrees of both ends; 0 where an end has none."""
    degrees = in_degrees(edges)
    inverse = lambda c: F.when(F.col(c) > 0, 1 / F.sqrt(F.col(c))).otherwise(0.0)
    s = degrees.select("graph_id", F.col("node_id").alias("src"), F.col("degree").alias("ds"))
    d = degrees.select("graph_id", F.col("node_id").alias("dst"), F.col("degree").alias("dd"))
    both = edges.join(s, ["graph_id", "src"], "left").join(d, ["graph_id", "dst"], "left")
    return both.select("graph_id", "edge_id", "src", "dst", (inverse("ds") * inverse("dd")).alias("weight"))


def encoded(name: str) -> Column:
    return F.log1p(F.col(name).cast("double"))


def encodings(nodes: DataFrame, *features: DataFrame) -> DataFrame:
    """Nodes with their features on a log(1 + x) scale."""
    out = nodes.select("graph_id", "node_id")
    for feature in features:
        name = next(c for c in feature.columns if c not in ("graph_id", "node_id"))
        out = out.join(feature, ["graph_id", "node_id"], "left").withColumn(name, encoded(name))
    return out


def undirected(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """Each unordered pair in both directions, once, with its weights added up."""
    w = F.lit(1) if weight is None else F.col(weight)
    both = edges.select("graph_id", F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v"), w.alias("w")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v"), w.alias("w")))).alias("e"))
    return both.select("graph_id", "e.*").where("u != v").groupBy("graph_id", "u", "v").agg(F.sum("w").alias("w"))
