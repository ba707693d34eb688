"""The driver's contract: every query runs on the smallest tables and has the SQL's columns."""

from __future__ import annotations

import __spark_entry__ as entry
import duckdb
import pytest

SF = "/root/testdata/sf0.001"
NAMES = ["rq1_trivial_baselines", "jon01_tier1_samples", "set03_set_report", "grf02_depth_by_graph", "grf15_level_slices", "spl01_design_split", "agg26_spearman", "rep02_savings"]


def test_names_match():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {r.predictor for r in rows} == {"mean", "median", "zero"}


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    key = lambda row: tuple(str(v) for v in row)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    assert got == sorted((tuple(dict(zip(want.columns, r, strict=True))[c] for c in columns) for r in want.fetchall()), key=key)
