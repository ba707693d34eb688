"""Graph operators on small graphs drawn by hand, and invariants of the random ones."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelake.operators import message_passing, reduction, topology

NODES, EDGES = "graph_id long, node_id long, role int", "graph_id long, edge_id long, src long, dst long, inv boolean"


def graph(spark, pairs, roles):
    nodes = spark.createDataFrame([(1, i, r) for i, r in enumerate(roles)], NODES)
    edges = spark.createDataFrame([(1, i, a, b, False) for i, (a, b) in enumerate(pairs)], EDGES)
    return nodes, edges


@pytest.fixture(scope="module")
def simple(spark):
    return graph(spark, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (3, 5), (4, 5)], [0, 1, 2, 3, 0, 1])


@pytest.fixture(scope="module")
def aig(spark):
    return graph(spark, [(0, 2), (1, 2), (2, 3), (3, 4)], [1, 1, 2, 2, 3])


@pytest.fixture(scope="module")
def many(spark):
    draw = random.Random(1)
    nodes, edges = [], []
    for g in range(6):
        n = draw.randint(2, 60)
        nodes += [(g, i, 1 if i < 2 else 2) for i in range(n)]
        edges += [(g, k, *sorted(draw.sample(range(n), 2)), draw.random() < 0.5) for k in range(2 * n)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def pairs_of(edges):
    return sorted((r.src, r.dst) for r in edges.collect())


def test_topology_of_gates(spark):
    gates = spark.createDataFrame([(1, 9, 1, 2, True, False), (1, 10, 9, 9, False, True), (1, 11, 3, 9, False, False)], "graph_id long, gate long, a long, b long, inv_a boolean, inv_b boolean")
    nodes, edges = topology.nodes(gates), topology.edges(gates)
    roles = {r.node_id: r.role for r in nodes.collect()}
    assert roles == {0: 0} | {i: 1 for i in range(1, 9)} | {9: 2, 10: 2, 11: 2, 12: 3, 13: 3}
    assert pairs_of(edges) == sorted([(1, 9), (2, 9), (9, 10), (9, 10), (3, 11), (9, 11), (10, 12), (11, 13)])
    assert sorted(r.edge_id for r in edges.collect()) == list(range(8))
    assert {r.node_id: r.level for r in topology.levels(nodes, edges).collect() if r.node_id > 8} == {9: 1, 10: 2, 11: 2, 12: 3, 13: 3}


def test_levels_and_paths(aig, simple):
    nodes, edges = aig
    levels = topology.levels(nodes, edges)
    assert [r.level for r in levels.orderBy("node_id").collect()] == [0, 0, 1, 2, 3]
    paths = topology.input_paths(nodes, edges, levels)
    assert [round(np.expm1(r.log_paths)) for r in paths.orderBy("node_id").collect()] == [1, 1, 2, 2, 2]
    blocked = topology.input_paths(nodes, edges, levels, max_jump=0)
    assert [round(np.expm1(r.log_paths)) for r in blocked.orderBy("node_id").collect()] == [1, 1, 0, 0, 0]
    assert [r.local_sum for r in topology.local_sums(*simple).orderBy("node_id").collect()] == [1 + 1 + 2, 1 + 2 + 2, 1 + 2 + 2, 1 + 1, 1, 0]


def test_path_counts_beyond_integers(spark):
    n = 300
    nodes, edges = graph(spark, [(i, i + 1) for i in range(n) for _ in range(2)], [1] + [2] * n)
    top = topology.input_paths(nodes, edges, topology.levels(nodes, edges)).where(f"node_id = {n}").first().log_paths
    assert top == pytest.approx(n * np.log(2))


def test_dropout(simple, many):
    nodes, edges = simple
    assert reduction.keep_edges(edges, reduction.dropped_edges(edges, 0.0)).count() == 7
    assert reduction.keep_edges(edges, reduction.dropped_edges(edges, 1.0)).count() == 0
    a, b = (sorted(tuple(r) for r in reduction.dropped_edges(df, 0.3, 5).collect()) for df in (many[1], many[1].repartition(7)))
    assert a == b


def test_pagerank_keeps_a_share(simple, many):
    ranks = reduction.pagerank(*simple)
    assert sum(r["rank"] for r in ranks.collect()) == pytest.approx(1, abs=1e-6)
    for ratio, n in ((0.8, 4), (0.5, 3), (0.01, 1)):
        assert reduction.top_fraction(ranks, "rank", ratio).where("keep").count() == n
    joined = {(r.graph_id, r.node_id): r["rank"] for r in reduction.pagerank_rounds(*many, 10).collect()}
    for r in reduction.pagerank(*many, tolerance=1e-12).collect():
        assert joined[r.graph_id, r.node_id] == pytest.approx(r["rank"], abs=0.02)


def test_forest(simple, many, spark):
    nodes, edges = simple
    assert reduction.spanning_forest(nodes, edges).count() == 5
    double = edges.unionByName(edges.withColumn("edge_id", F.col("edge_id") + 7))
    mask = reduction.forest_mask(double, reduction.spanning_forest(nodes, double))
    assert mask.where("keep").count() == 10
    for g in range(6):
        n, e = many[0].where(f"graph_id = {g}"), many[1].where(f"graph_id = {g}")
        sets = reduction.Sets()
        components = n.count() - sum(sets.join(a, b) for a, b in pairs_of(e) if a != b)
        assert reduction.spanning_forest(n, e).count() == n.count() - components
    redundant = graph(spark, [(0, 1), (1, 3), (0, 2), (2, 3), (0, 3)], [0] * 4)
    assert reduction.spanning_forest(*redundant).count() == 3


def test_gates_only_renumbers(aig):
    nodes, edges = reduction.sparsify(*aig, "and_gate_only")
    assert [(r.node_id, r.new_id) for r in nodes.orderBy("node_id").collect()] == [(2, 0), (3, 1)]
    assert pairs_of(edges) == [(0, 1)]
    with pytest.raises(ValueError):
        reduction.sparsify(*aig, "unknown")


def test_all_true_mask_is_the_identity(many):
    kept = reduction.renumbered(many[0], many[0].withColumn("keep", F.lit(True)))
    assert kept.where("node_id != new_id").count() == 0
    assert pairs_of(reduction.induced(many[1], kept)) == pairs_of(many[1])


@pytest.mark.parametrize("levels, k, sizes", [([1, 4, 2, 5, 1, 2, 3, 3, 4, 5], 2, [5, 5]), ([5, 4, 3, 2, 1, 2, 3, 4, 5], 2, [5, 4]), (list(range(12)), 4, [3] * 4), ([3], 3, [1])])
def test_level_slices(spark, levels, k, sizes):
    nodes = spark.createDataFrame([(1, i, v, k) for i, v in enumerate(levels)], "graph_id long, node_id long, level long, k int")
    got = reduction.level_slices(nodes).groupBy("part").count().orderBy("part").collect()
    assert [r["count"] for r in got] == sizes


def test_bad_slices(spark):
    schema = "graph_id long, node_id long, level long, k int"
    assert reduction.level_slices(spark.createDataFrame([], schema)).collect() == []
    for row in ((1, 0, 1, 0), (1, 0, None, 2)):
        with pytest.raises(Exception, match="k >= 1"):
            reduction.level_slices(spark.createDataFrame([row], schema)).collect()


def test_balanced_parts(many, spark):
    nodes = reduction.with_k(many[0], target=15)
    parts = reduction.balanced_parts(nodes, many[1])
    assert parts.count() == nodes.count()
    stats = reduction.partition_stats(parts, many[1]).collect()
    chance = {r.graph_id: r.edge_cut for r in reduction.partition_stats(reduction.random_parts(nodes), many[1]).collect()}
    assert all(r.max_size <= r.mean_size * 1.5 + 2 for r in stats)
    assert sum(r.edge_cut for r in stats) < sum(chance.values())
    line = graph(spark, [(i, i + 1) for i in range(5)], [2] * 6)
    assert {r.part for r in reduction.balanced_parts(reduction.with_k(line[0]), line[1]).collect()} == {0, 1}


def test_parts_keep_inner_edges(spark):
    nodes, edges = graph(spark, [(0, 1), (1, 0), (0, 2), (2, 0), (2, 3), (3, 2)], [2] * 4)
    parts = spark.createDataFrame([(1, i, p, 2) for i, p in enumerate([0, 1, 0, 1])], "graph_id long, node_id long, part int, k int")
    assert pairs_of(reduction.within_parts(edges, parts)) == [(0, 2), (2, 0)]
    stats = reduction.partition_stats(parts, edges).first()
    assert (stats.k, stats.nonempty, stats.edge_cut) == (2, 2, round(4 / 6, 6))


def test_message_passing_does_not_depend_on_partitions(many):
    nodes = many[0].withColumn("x", F.array(F.col("role") * 1.0, F.col("node_id") * 0.1))
    args = ([[0.5, -0.25], [0.125, 0.75]], [[0.1, -0.2], [0.3, 0.05]], [0.01, -0.02])
    rows = lambda df: sorted((r.graph_id, r.node_id, *np.round(r.x, 9)) for r in df.collect())
    a = rows(message_passing.gcn(nodes, many[1], *args))
    assert a == rows(message_passing.gcn(nodes.repartition(5), many[1].repartition(3), *args))
    got = {(r[0], r[1]): r[2:] for r in a}
    x = {(r.graph_id, r.node_id): np.array(r.x) for r in nodes.collect()}
    want = {k: np.array(args[2]) for k in x}
    for e in many[1].collect():
        m = np.array(args[0]) @ x[e.graph_id, e.src] + np.array(args[1])[:, int(e.inv)]
        want[e.graph_id, e.dst] = want[e.graph_id, e.dst] + np.where(m >= 0, m, m * 0.01)
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_fit_recovers_a_line(spark):
    rows = spark.createDataFrame([([float(i), float(i * i % 7)], 2.0 * i - (i * i % 7) + 1) for i in range(30)], "x array<double>, y double")
    model = message_passing.fit(rows, "y")
    assert model.intercept == pytest.approx(1, abs=1e-3) and list(model.coefficients) == pytest.approx([2, -1], abs=1e-3)


def test_coarsening(aig):
    parts = aig[0].select("graph_id", "node_id", F.when(F.col("node_id") < 3, 0).otherwise(1).alias("part"))
    supers, between = reduction.coarsened(*aig, parts)
    assert {(r.part, r["size"], r.n_pi, r.n_and, r.n_po, r.n_loops) for r in supers.collect()} == {(0, 3, 2, 1, 0, 2), (1, 2, 0, 1, 1, 1)}
    assert [(r.ps, r.pd, r.n_plain, r.n_inverted) for r in between.collect()] == [(0, 1, 1, 0)]
