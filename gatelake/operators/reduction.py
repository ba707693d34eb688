"""Smaller graphs: sparsifiers, partitioners, applying their masks, and what was kept or cut.

Random choices come from md5 of (seed, graph, item), so a mask can be computed anywhere and again. Dropout, gates only,
level slicing and random parts are plain column expressions; PageRank, spanning forests and the balanced partitioner
need a whole graph and run as a pass a graph."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelake.functions import rng, scalars
from gatelake.sources import scratch

SEED, DROP_RATE, KEEP_RATIO, DAMPING, SPAN = 42, 0.3, 0.8, 0.85, 10.0


def dropped_edges(edges: DataFrame, rate: float = DROP_RATE, seed: int = SEED) -> DataFrame:
    """(graph_id, edge_id, keep): each edge stays with probability 1 - rate."""
    return edges.select("graph_id", "edge_id", (rng.uniform(seed, "graph_id", "edge_id") >= rate).alias("keep"))


def gates_only(nodes: DataFrame) -> DataFrame:
    """(graph_id, node_id, keep): inputs and outputs go, the constant stays."""
    return nodes.select("graph_id", "node_id", F.col("role").isin(0, 2).alias("keep"))


def top_fraction(scores: DataFrame, score: str, ratio: float = KEEP_RATIO) -> DataFrame:
    """The best int(n * ratio) nodes of each graph, one at least; ties by node_id."""
    w = Window.partitionBy("graph_id")
    ranked = scores.withColumn("r", F.row_number().over(w.orderBy(F.desc(score), "node_id"))).withColumn("n", F.count("*").over(w))
    return ranked.select("graph_id", "node_id", (F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") * ratio))).alias("keep"))


def _whole(nodes: DataFrame, edges: DataFrame, *more: Column) -> DataFrame:
    n = nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list("node_id")).alias("nodes"))
    e = edges.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst", *more))).alias("edges"))
    return n.join(e, "graph_id", "left")


def _each_graph(packed: DataFrame, schema: str, one) -> DataFrame:
    """Applies ``one(graph_id, nodes, edges)`` -> DataFrame to every graph."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for frame in frames:
            out = [one(g, np.asarray(n), [] if e is None else list(e)) for g, n, e in zip(frame["graph_id"], frame["nodes"], frame["edges"], strict=True)]
            yield pd.concat(out)[names] if out else pd.DataFrame({c: [] for c in names})

    return packed.mapInPandas(run, schema)


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Rank of each node by power iteration; parallel edges count once, mass of dead ends is spread evenly."""

    def one(graph_id, ids, links):
        place = {v: i for i, v in enumerate(ids.tolist())}
        pairs = np.array(sorted({(place[e["src"]], place[e["dst"]]) for e in links}), np.int64).reshape(-1, 2)
        n, src, dst = len(ids), pairs[:, 0], pairs[:, 1]
        out = np.bincount(src, minlength=n)
        rank = np.full(n, 1.0 / n)
        for _ in range(rounds):
            share = np.divide(rank, out, out=np.zeros(n), where=out > 0)
            new = damping * (np.bincount(dst, share[src], n) + rank[out == 0].sum() / n) + (1 - damping) / n
            done = np.abs(new - rank).sum() < n * tolerance
            rank = new
            if done:
                break
        return pd.DataFrame({"graph_id": graph_id, "node_id": ids, "rank": rank})

    return _each_graph(_whole(nodes, edges), "graph_id long, node_id long, rank double", one)


def pagerank_rounds(nodes: DataFrame, edges: DataFrame, rounds: int, damping: float = DAMPING) -> DataFrame:
    """A fixed number of PageRank rounds as joins and sums, for graphs too large for a task. A round reads the state
    more than once, so every third one is written down, or the plan would double with each."""
    links = edges.select("graph_id", "src", "dst").distinct()
    out = links.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count("*").alias("out"))
    w = Window.partitionBy("graph_id")
    state = nodes.select("graph_id", "node_id").join(out, ["graph_id", "node_id"], "left").withColumn("n", F.count("*").over(w)).withColumn("rank", 1.0 / F.col("n"))
    for i in range(rounds):
        if i and i % 3 == 0:
            state = scratch.kept(state, "pagerank")
        sent = state.where("out is not null").select("graph_id", F.col("node_id").alias("src"), (F.col("rank") / F.col("out")).alias("share"))
        got = links.join(sent, ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.sum("share").alias("got"))
        dead = F.sum(F.when(F.col("out").isNull(), F.col("rank")).otherwise(0.0)).over(w) / F.col("n")
        new = damping * (F.coalesce("got", F.lit(0.0)) + dead) + (1 - damping) / F.col("n")
        state = state.join(got, ["graph_id", "node_id"], "left").withColumn("rank", new).drop("got")
    return state.select("graph_id", "node_id", "rank")


class Sets:
    """Disjoint sets with path halving."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[a] = b
        return a != b


def spanning_forest(nodes: DataFrame, edges: DataFrame, seed: int = SEED) -> DataFrame:
    """(graph_id, u, v): the pairs of a random spanning forest. The graph counts as undirected; the smallest of the
    random weights of a pair's edges is its own."""
    weighted = edges.where("src != dst").select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), rng.uniform(seed, "graph_id", "edge_id").alias("w"))
    pairs = weighted.groupBy("graph_id", "src", "dst").agg(F.min("w").alias("w"))

    def one(graph_id, ids, links):
        sets = Sets()
        kept = [(e["src"], e["dst"]) for e in sorted(links, key=lambda e: (e["w"], e["src"], e["dst"])) if sets.join(e["src"], e["dst"])]
        return pd.DataFrame({"graph_id": graph_id, "u": [a for a, _ in kept], "v": [b for _, b in kept]}, columns=["graph_id", "u", "v"])

    return _each_graph(_whole(nodes, pairs, F.col("w")), "graph_id long, u long, v long", one)


def forest_mask(edges: DataFrame, forest: DataFrame) -> DataFrame:
    """(graph_id, edge_id, keep): all edges, parallel ones too, whose unordered pair is in the forest."""
    kept = forest.select("graph_id", F.col("u").alias("_u"), F.col("v").alias("_v"), F.lit(True).alias("keep"))
    pair = [edges.graph_id == kept.graph_id, F.least("src", "dst") == F.col("_u"), F.greatest("src", "dst") == F.col("_v")]
    return edges.join(kept, pair, "left").select(edges.graph_id, "edge_id", F.coalesce("keep", F.lit(False)).alias("keep"))


def keep_edges(edges: DataFrame, mask: DataFrame) -> DataFrame:
    return edges.join(mask.where("keep").select("graph_id", "edge_id"), ["graph_id", "edge_id"], "left_semi")


def renumbered(nodes: DataFrame, mask: DataFrame) -> DataFrame:
    """Kept nodes with ids from 0 in their old order (``new_id``); all other columns stay."""
    kept = nodes.join(mask.where("keep").select("graph_id", "node_id"), ["graph_id", "node_id"], "left_semi")
    return kept.withColumn("new_id", (F.row_number().over(Window.partitionBy("graph_id").orderBy("node_id")) - 1).cast("long"))


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges between kept nodes, with their new ids."""
    s = kept.select("graph_id", F.col("node_id").alias("src"), F.col("new_id").alias("new_src"))
    d = kept.select("graph_id", F.col("node_id").alias("dst"), F.col("new_id").alias("new_dst"))
    return edges.join(s, ["graph_id", "src"]).join(d, ["graph_id", "dst"]).select("graph_id", "edge_id", F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "inv")


def ends_kept(edges: DataFrame, mask: DataFrame) -> DataFrame:
    """Edges with ``keep``: whether a node mask keeps both ends."""
    s = mask.select("graph_id", F.col("node_id").alias("src"), F.col("keep").alias("_s"))
    d = mask.select("graph_id", F.col("node_id").alias("dst"), F.col("keep").alias("_d"))
    return edges.join(s, ["graph_id", "src"]).join(d, ["graph_id", "dst"]).select("graph_id", "edge_id", "src", "dst", (F.col("_s") & F.col("_d")).alias("keep"))


def level_spans(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """Edges with the number of levels between their ends."""
    s = levels.select("graph_id", F.col("node_id").alias("src"), F.col("level").alias("ls"))
    d = levels.select("graph_id", F.col("node_id").alias("dst"), F.col("level").alias("ld"))
    return edges.join(s, ["graph_id", "src"]).join(d, ["graph_id", "dst"]).select("graph_id", "edge_id", "src", "dst", F.abs(F.col("ls") - F.col("ld")).cast("long").alias("span"))


def with_k(nodes: DataFrame, target: int = scalars.TARGET_NODES, low: int = scalars.MIN_K, high: int = scalars.MAX_K) -> DataFrame:
    """Nodes with the number of parts that suits their graph's size."""
    return nodes.withColumn("n", F.count("*").over(Window.partitionBy("graph_id"))).withColumn("k", scalars.dynamic_k(F.col("n"), target, low, high))


def random_parts(nodes: DataFrame, seed: int = SEED) -> DataFrame:
    """``nodes`` (with k) and a part for each by hash."""
    return nodes.select("graph_id", "node_id", rng.bucket(seed, F.col("k"), "graph_id", "node_id").alias("part"), "k")


def level_slices(nodes: DataFrame) -> DataFrame:
    """``nodes`` (with level and k) cut into k equal runs of the order by level."""
    w = Window.partitionBy("graph_id")
    bad = F.when((F.col("k") < 1) | F.col("level").isNull(), F.raise_error(F.lit("a level and k >= 1 are needed")).cast("int"))
    at = F.row_number().over(w.orderBy("level", "node_id")) - 1
    part = F.least(F.floor(at * F.col("k") / F.count("*").over(w)), F.col("k") - 1).cast("int")
    return nodes.select("graph_id", "node_id", F.coalesce(bad, part).alias("part"), "k")


def span_weights(edges: DataFrame, levels: DataFrame, alpha: float = SPAN) -> DataFrame:
    """Edges with a weight that grows with the levels they span."""
    return weighted(level_spans(edges, levels), alpha)


def weighted(spans: DataFrame, alpha: float = SPAN) -> DataFrame:
    return spans.select("graph_id", "edge_id", "src", "dst", F.floor(1 + alpha * F.col("span")).cast("long").alias("weight"))


def balanced_parts(nodes: DataFrame, edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``nodes`` (with k) in k parts of nearly equal size with few edges between them: parts are grown breadth-first over
    the undirected graph and boundary nodes then move where that cuts less and keeps the balance."""
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    ks = nodes.groupBy("graph_id").agg(F.max("k").alias("k"))
    packed = _whole(nodes, edges, w.alias("w")).join(ks, "graph_id")

    def run(frames):
        for frame in frames:
            out = []
            for g, ids, links, k in zip(frame["graph_id"], frame["nodes"], frame["edges"], frame["k"], strict=True):
                part = _grow(np.asarray(ids).tolist(), [] if links is None else [(e["src"], e["dst"], e["w"]) for e in links], int(k))
                out.append(pd.DataFrame({"graph_id": g, "node_id": list(part), "part": list(part.values()), "k": int(k)}))
            yield pd.concat(out) if out else pd.DataFrame({"graph_id": [], "node_id": [], "part": [], "k": []})

    return packed.mapInPandas(run, "graph_id long, node_id long, part int, k int")


def _grow(ids: list[int], links: Iterable[tuple[int, int, int]], k: int) -> dict[int, int]:
    near: dict[int, dict[int, int]] = {v: {} for v in ids}
    for src, dst, w in links:
        if src != dst:
            for a, b in ((src, dst), (dst, src)):
                near[a][b] = near[a].get(b, 0) + w
    part: dict[int, int] = {}
    size, number, queue, left = len(ids) / k, 0, [], iter(ids)
    while len(part) < len(ids):
        v = queue.pop(0) if queue else next(x for x in left if x not in part)
        if v in part:
            continue
        if len(part) >= round((number + 1) * size) and number < k - 1:
            number, queue = number + 1, []
        part[v] = number
        queue += sorted(x for x in near[v] if x not in part)
    sizes = np.bincount(list(part.values()), minlength=k)
    for _ in range(4):
        moved = 0
        for v in ids:
            pull: dict[int, int] = {}
            for x, w in near[v].items():
                pull[part[x]] = pull.get(part[x], 0) + w
            best = max(pull, key=lambda p: (pull[p], -p), default=part[v])
            if pull.get(best, 0) > pull.get(part[v], 0) and sizes[best] + 1 <= np.ceil(size * 1.03) and sizes[part[v]] > 1:
                sizes[part[v]] -= 1
                sizes[best] += 1
                part[v] = best
                moved += 1
        if not moved:
            break
    return part


SPARSIFIERS = {"random_edge_dropout": "edge", "spanning_forest": "edge", "pagerank": "node", "and_gate_only": "node"}


def sparsify(nodes: DataFrame, edges: DataFrame, algorithm: str, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that an algorithm leaves: edges only for the edge maskers, else the induced graph."""
    if algorithm == "random_edge_dropout":
        return nodes, keep_edges(edges, dropped_edges(edges, seed=seed))
    if algorithm == "spanning_forest":
        return nodes, keep_edges(edges, forest_mask(edges, spanning_forest(nodes, edges, seed)))
    if algorithm not in SPARSIFIERS:
        raise ValueError(f"unknown sparsifier {algorithm}")
    mask = gates_only(nodes) if algorithm == "and_gate_only" else top_fraction(pagerank(nodes, edges), "rank")
    kept = renumbered(nodes, mask)
    return kept, induced(edges, kept)


def within_parts(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges whose ends are in one part."""
    return part_pairs(edges, parts).where("ps = pd").select("graph_id", "edge_id", "src", "dst", "inv", F.col("ps").alias("part"))


def part_pairs(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges with the parts of both ends."""
    s = parts.select("graph_id", F.col("node_id").alias("src"), F.col("part").alias("ps"))
    d = parts.select("graph_id", F.col("node_id").alias("dst"), F.col("part").alias("pd"))
    return edges.join(s, ["graph_id", "src"]).join(d, ["graph_id", "dst"])


def partition_stats(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """By graph: k, sizes of its k parts, empty ones included, and the share of edges between parts."""
    sizes = parts.groupBy("graph_id", "part").agg(F.count("*").alias("n"))
    slots = parts.groupBy("graph_id").agg(F.max("k").alias("k")).select("graph_id", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"))
    full = slots.join(sizes, ["graph_id", "part"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    stats = full.groupBy("graph_id").agg(F.max("k").alias("k"), F.count_if(F.col("n") > 0).alias("nonempty"), F.round(F.avg("n"), 6).alias("mean_size"), F.max("n").alias("max_size"), F.min("n").alias("min_size"), F.round(F.stddev_samp("n"), 6).alias("std_size"))
    cut = part_pairs(edges, parts).groupBy("graph_id").agg(F.round(F.count_if(F.col("ps") != F.col("pd")) / F.count("*"), 6).alias("edge_cut"))
    return stats.join(cut, "graph_id", "left").withColumn("edge_cut", F.coalesce("edge_cut", F.lit(0.0)))


def retention(nodes: DataFrame, edges: DataFrame, kept_nodes: DataFrame, kept_edges: DataFrame) -> DataFrame:
    """By graph: shares of nodes and edges that a reduction left."""
    n = lambda df, name: df.groupBy("graph_id").agg(F.count("*").alias(name))
    every = n(nodes, "n").join(n(edges, "m"), "graph_id", "left").join(n(kept_nodes, "kn"), "graph_id", "left").join(n(kept_edges, "km"), "graph_id", "left")
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.coalesce(a, F.lit(0)).cast("double"), F.col(b).cast("double")), F.lit(0.0)), 6)
    return every.select("graph_id", share("kn", "n").alias("node_retention"), share("km", "m").alias("edge_retention"))


def summary(stats: DataFrame, *columns: str) -> DataFrame:
    """(metric, mean, std, min, max) over graphs, with the population deviation."""
    long = stats.unpivot([], list(columns), "metric", "value")
    return long.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def missing_masks(graphs: DataFrame, masks: DataFrame, algorithm: str) -> DataFrame:
    """Graphs without a mask of an algorithm; strict users require it to be empty."""
    return graphs.select("graph_id").distinct().join(masks.where(F.col("algo") == algorithm).select("graph_id"), "graph_id", "left_anti")


def later_masks(masks: DataFrame) -> DataFrame:
    """One row an item of masks written in chunks: the last chunk wins."""
    return masks.groupBy("algo", "graph_id", "item_id").agg(F.max_by("keep", "chunk").alias("keep"))


def coarsened(nodes: DataFrame, edges: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An extension: clusters of nodes merged into one each. Super-nodes have counts by role and the lowest level,
    super-edges their numbers of plain and inverted edges; edges inside a cluster are counted and dropped."""
    held = nodes.join(clusters, ["graph_id", "node_id"])
    role = lambda r, name: F.count_if(F.col("role") == r).alias(name)
    supers = held.groupBy("graph_id", "part").agg(F.count("*").alias("size"), role(0, "n_const"), role(1, "n_pi"), role(2, "n_and"), role(3, "n_po"))
    ends = part_pairs(edges, clusters)
    loops = ends.where("ps = pd").groupBy("graph_id", F.col("ps").alias("part")).agg(F.count("*").alias("n_loops"))
    between = ends.where("ps != pd").groupBy("graph_id", "ps", "pd").agg(F.count_if(~F.col("inv")).alias("n_plain"), F.count_if(F.col("inv")).alias("n_inverted"))
    return supers.join(loops, ["graph_id", "part"], "left").withColumn("n_loops", F.coalesce("n_loops", F.lit(0))), between
