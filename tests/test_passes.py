"""Queries over whole graphs: one shuffle of the gates, and the rows of the SQL or the joins, on odd tables too."""

from __future__ import annotations

import datetime
import random

import duckdb
import pytest

import __spark_entry__
from gatelake.operators import message_passing, passes, reduction, topology
from gatelake.plans import evaluation, graphs
from gatelake.plans import fixtures as fx

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def lines(n, suppliers, odd, draw):
    day = datetime.datetime(2020, 1, 1)
    for i in range(n):
        low = -99 if odd else 1
        row = [i // 4, draw.randint(low, 999), draw.choice(suppliers), i % 4, float(i % 50), i + 0.5, draw.choice("RAN"), draw.choice("OF"), day]
        if odd and i % 11 == 0:
            row[draw.choice((1, 6, 7))] = None
        yield tuple(row)


def written(spark, folder, rows):
    spark.createDataFrame(list(rows), LINES).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    """Graphs of many sizes, one of them large."""
    return written(spark, tmp_path_factory.mktemp("plain"), lines(900, [1] * 20 + list(range(2, 20)), False, random.Random(3)))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null and negative keys, null flags, and a graph without an id."""
    return written(spark, tmp_path_factory.mktemp("odd"), lines(600, [1] * 9 + [None, None, -4, *range(2, 12)], True, random.Random(4)))


def by_sql(name, sf):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet/*.parquet'")
    return db.sql(__spark_entry__.oracle_sql()[name]).fetchall()


def rows(found, digits=9):
    return sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in found), key=repr)


def run(spark, name, sf):
    return __spark_entry__.queries()[name](spark, sf)


def ran(spark, name, sf):
    return rows(run(spark, name, sf).collect())


def gates(spark, sf):
    return fx.gates(spark, sf)


def levelled(spark, sf):
    return graphs._levelled(spark, sf)


#: Queries and their numbers of shuffles.
SHUFFLES = {
    "grf09_pagerank_rounds": 1,
    "grf05_encodings": 1,
    "grf03_input_paths": 1,
    "mlx09_layer_block": 1,
    "grf04_local_sums": 1,
    "grf17_span_parts": 1,
    "mlx12_node_inputs": 1,
    "grf08_spanning_forest": 1,
    "win02_level_slices": 2,
    "grf17_span_weights": 1,
    "grf19_within_parts": 1,
}


@pytest.mark.parametrize("name", SHUFFLES)
def test_shuffles(spark, plain, name):
    plan = run(spark, name, plain)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == SHUFFLES[name]


@pytest.mark.parametrize("name", [n for n in SHUFFLES if n in __spark_entry__.oracle_sql()])
@pytest.mark.parametrize("table", ["plain", "odd"])
def test_sql(spark, name, table, request):
    sf = request.getfixturevalue(table)
    assert ran(spark, name, sf) == rows(by_sql(name, sf))


@pytest.mark.parametrize("name", ["grf09_pagerank_rounds", "mlx09_layer_block", "grf04_local_sums"])
def test_large_graphs_take_joins(spark, plain, name, monkeypatch):
    whole = {r[:2]: r for r in map(tuple, run(spark, name, plain).collect())}
    monkeypatch.setattr(passes, "LARGE", 100)
    split = run(spark, name, plain)
    assert "Join" in split._jdf.queryExecution().executedPlan().toString()
    found = {r[:2]: r for r in map(tuple, split.collect())}
    assert found.keys() == whole.keys()
    assert all(found[k][2] == pytest.approx(whole[k][2], abs=1e-9) for k in whole)


def test_input_paths(spark, plain, odd):
    nodes, edges, levels = levelled(spark, plain)
    assert ran(spark, "grf03_input_paths", plain) == rows(topology.input_paths(nodes, edges, levels).collect())
    assert run(spark, "grf03_input_paths", odd).count() == graphs._graph(spark, odd)[0].count()


def test_layer_block(spark, plain):
    args = evaluation._WEIGHTS, evaluation._EDGE_WEIGHTS, evaluation._BIAS, [[0.3, 0.1], [-0.2, 0.4]]
    joined = message_passing.block(*evaluation._features(spark, plain), *args)
    flat = lambda df: rows(((r.graph_id, r.node_id, *r.x) for r in df.select("graph_id", "node_id", "x").collect()), 7)
    got, want = flat(run(spark, "mlx09_layer_block", plain)), flat(joined)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(a == pytest.approx(b, abs=1e-6) for a, b in zip(got, want, strict=True))


def test_span_parts(spark, plain):
    nodes, edges, levels = levelled(spark, plain)
    parts = reduction.balanced_parts(graphs._with_k(nodes), reduction.span_weights(edges, levels), "weight")
    assert ran(spark, "grf17_span_parts", plain) == rows(parts.collect())


def test_spanning_forest(spark, plain, odd):
    for sf in (plain, odd):
        nodes, edges = graphs._graph(spark, sf)
        assert ran(spark, "grf08_spanning_forest", sf) == rows(reduction.forest_mask(edges, reduction.spanning_forest(nodes, edges)).collect())
