"""Names, numbers, samples, plans, scores and files on small tables."""

from __future__ import annotations

import io
import json
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelake.functions import names, rng, scalars
from gatelake.operators import audit, baselines, lineage, metrics, reports, sampling
from gatelake.sources import readers, sinks
from gatelake.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "name, want",
    [
        ("adder_syn1_step0.aig", (0, "adder", None, None, "1", "0", "clean")),
        ("adder_Orchestrate_tier1_syn1_step0.aig", (1, "adder", None, "Orchestrate", "1", "0", "clean")),
        ("sqrt_Deepsyn_tier1_Deepsyn_sqrt_M7pRPw_syn81_step9.pt", (1, "sqrt", None, "Deepsyn", "81", "9", "messy")),
        ("1024_C2RS_tier1_C2RS_1024_1yHxJ4_synX_step0.aig", (1, "1024", None, "C2RS", "X", "0", "messy")),
        ("a_b_Syn4_C2RS_tier2_syn3_step21.pt", (2, "a_b", "Syn4", "C2RS", "3", "21", "clean")),
        ("nothing.pt", (-1, None, None, None, None, None, "unrecognized")),
    ],
)
def test_artifact_names(spark, name, want):
    assert tuple(one(spark, names.artifact(F.lit(name)))) == want


def test_clean_names_and_hints(spark):
    key = lambda n, *a: names.artifact(F.lit(n), *a)
    assert one(spark, names.clean_basename(key("sqrt_Deepsyn_tier1_Deepsyn_sqrt_M7pRPw_syn81_step9.pt"), ".pt")) == "sqrt_Deepsyn_tier1_syn81_step9.pt"
    hinted = one(spark, key("syn4_step2.aig", F.lit("adder"), F.lit(0)))
    assert (hinted.design, hinted.recipe, hinted.state) == ("adder", "4", "messy")
    assert one(spark, names.artifact_of_graph_path(F.lit("/r/graphs/tier1/Syn4/adder/adder_Syn4_tier1_syn1_step2.pt"))).design == "adder"
    assert one(spark, names.canonical_id(key("a_b_Syn4_C2RS_tier2_syn3_step21.pt"))) == "T2_a_b_Syn4_C2RS_syn3_step21"


def test_input_paths(spark):
    path = lambda f, t, d: one(spark, names.input_graph_path("/r", F.lit(f), F.lit(t), F.lit(d)))
    assert path("x/adder_syn1_step0.aig", 0, "") == "/r/graphs/tier0/adder/adder_syn1_step0.pt"
    assert path("x/adder_Syn4_tier1_syn1_step0.aig", 1, "") == "/r/graphs/tier0/adder/adder_syn1_step0.pt"
    assert path("x/adder_Syn4_C2RS_tier2_syn1_step0.aig", 2, "") == "/r/graphs/tier1/Syn4/adder/adder_Syn4_tier1_syn1_step0.pt"
    assert path("x/z.aig", 3, "d") == "/r/graphs/tier3/d/z.pt"
    for bad in (("x/nope.aig", 1, "d"), ("x/nope.aig", 2, "d"), ("", 0, "d"), ("x/nope.aig", 0, "")):
        with pytest.raises(Exception, match="tier 1|tier 2|file_path|design"):
            path(*bad)


def test_recipes(spark):
    found = {s: one(spark, names.recipe_of_stem(F.lit(s))) for s in ("a_syn5_step1", "a_Syn4_tier1_synX_step0", "a_Syn4_C2RS_tier2_syn9_step2", "a_Syn4_tier1_other", "b")}
    assert found == {"a_syn5_step1": "syn5", "a_Syn4_tier1_synX_step0": "synX", "a_Syn4_C2RS_tier2_syn9_step2": "syn9", "a_Syn4_tier1_other": None, "b": None}


def test_run_labels(spark):
    lit = F.lit
    assert one(spark, scalars.run_label(lit("O"), lit("partition"), lit("random"), lit("design"))) == "O_partition_random"
    assert one(spark, scalars.run_label(lit("O"), lit("none"), lit(None).cast("string"), lit("random"))) == "O_none_random"
    with pytest.raises(Exception, match="no label"):
        one(spark, scalars.run_label(lit("O"), lit("partition"), lit("random"), lit("recipe")))
    assert tuple(one(spark, scalars.parsed_run_label(lit("O_none_random")))) == ("O", "none", None, "random")
    assert tuple(one(spark, scalars.parsed_run_label(lit("O_partition_random")))) == ("O", "partition", "random", "design")
    assert tuple(one(spark, scalars.parsed_run_label(lit("a_none_thing")))) == ("a_none_thing", "none", None, "design")


def test_numbers(spark):
    ks = [one(spark, scalars.dynamic_k(F.lit(n))) for n in (5_000, 50_000, 1_000_000)]
    assert ks == [2, 5, 32]
    with pytest.raises(Exception, match="negative"):
        one(spark, scalars.log1p_count(F.lit(-1)))
    with pytest.raises(ValueError):
        scalars.sinusoidal(F.lit(1), 3)
    with pytest.raises(Exception, match="unknown algorithm"):
        one(spark, scalars.algorithm(F.lit("x"), names.ALGORITHMS))
    draws = [r.u for r in spark.range(2000).select(rng.uniform(1, "id").alias("u")).collect()]
    assert 0 <= min(draws) and max(draws) < 1 and abs(np.mean(draws) - 0.5) < 0.03


def test_logs_need_two_lines(spark):
    line = "i/o = 3/ 2 lat = 0 and = {} lev = {}\n"
    logs = spark.createDataFrame([("a_Syn4_tier1_synX_step0.log", "a", "Syn4", 1, line.format(10, 4) + "x\n" + line.format(8, 5)), ("a_Syn4_tier1_syn2_step1.log", "a", "Syn4", 1, line.format(7, 3))], "log_name string, design string, algorithm string, tier_id int, content string")
    row = lineage.parse_logs(logs).collect()
    assert [(r.recipe_id, r.nodes, r.depth, r.optimizability, r.depth_optimizability) for r in row] == [(0, 8, 5, 0.2, -0.25)]
    assert {r.file_path: r.nodes for r in lineage.tier0_of_logs(logs).collect()} == {"base_aigs/a/tier0/synX_step0.aig": 10, "base_aigs/a/tier0/syn2_step1.aig": 7}


def batches_of(sizes, budget):
    """The plan as lists of places in the sorted sizes."""
    ends = sampling.plan(np.array(sorted(sizes)), budget).tolist()
    return [[len(sizes) - 1 - b, *range(start, end)] for b, (start, end) in enumerate(zip([0, *ends], ends))]


def test_plans():
    plan = batches_of([1, 2, 3, 4, 100, 101, 102, 103], 105)
    assert len(plan) == 4 and all(len(b) == 2 for b in plan)
    assert batches_of([1] * 40, 100) == [[39, *range(39)]]
    alone = [b for b in batches_of([1, 2, 3, 4, 100, 101, 300, 350], 300) if b[0] in (6, 7)]
    assert alone == [[7], [6]]
    assert batches_of([0, 0, 5], 5) == [[2, 0, 1]] and batches_of([], 5) == []
    draw = random.Random(2)
    sizes = sorted(draw.randint(1, 500) for _ in range(300))
    plan = batches_of(sizes, 600)
    assert sorted(i for b in plan for i in b) == list(range(300)) and all(len(b) == 1 or sum(sizes[i] for i in b) <= 600 for b in plan)
    left = list(range(300))  # each batch could take no more
    for b in plan:
        assert b[0] == left[-1]
        left = [i for i in left if i not in b]
        assert not left or sum(sizes[i] for i in b) + sizes[left[0]] > 600


def test_emitted_order(spark):
    rows = spark.createDataFrame([(1, 0, "c"), (0, 1, "b"), (0, 0, "a")], "batch_id long, pos long, x string")
    assert [r.x for r in sampling.emitted(rows).orderBy("at").collect()] == ["a", "b", "c"]
    with pytest.raises(Exception, match="gaps"):
        sampling.emitted(rows.where("x != 'a'")).collect()


def test_batch_plan_of_a_table(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([1, 2, 3, 4, 100, 101, 102, 103])], "g long, n long")
    got = sampling.batch_plan(rows, "g", "n", 105).collect()
    assert len(got) == 8 and {r.batch_id for r in got} == {0, 1, 2, 3}


def test_splits_keep_groups_whole(spark):
    rows = spark.createDataFrame([(f"/d{i % 13}/p{i % 50}", f"g{i % 50 % 13}") for i in range(400)], "path string, g string")
    got = sampling.grouped_split(rows, F.col("g"), "path", 1).collect()
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.g, set()).add(next(x.split for x in got if x.path == r.path))
    assert all(len(s) == 1 for s in groups.values()) and {r.split for r in got} == {"train", "val", "test"}
    alone = sampling.grouped_split(rows.limit(1), F.col("g"), "path", 1).collect()
    assert [r.split for r in alone] == ["train"]


def test_samples(spark):
    rows = spark.range(30).select(F.col("id").alias("k"), (F.col("id") % 7).alias("n"))
    assert sampling.sample(rows, "k", 0, 1).count() == 30 and sampling.sample(rows, "k", 99, 1).count() == 30
    assert sampling.stratified(rows, "k", "n", 12, 1).count() == 12 and sampling.stratified(rows, "k", "n", 30, 1).count() == 30
    assert sampling.stratified(rows.limit(5), "k", "n", 4, 1).count() == 4


def test_scores_by_hand(spark):
    rows = spark.createDataFrame([("a", 0.0, 0.1), ("a", 1.0, 0.8), ("a", 0.5, 0.5), ("b", 2.0, 1.0), ("b", 2.0, 3.0)], "g string, target double, prediction double")
    got = {r.g: r for r in metrics.errors(rows, ["g"]).collect()}
    assert got["a"].mae == pytest.approx(0.1) and got["a"].rmse == pytest.approx(math.sqrt(0.05 / 3)) and got["a"].r2 == pytest.approx(1 - 0.05 / 0.5)
    assert got["b"].r2 is None
    ranks = {r.g: r.spearman for r in metrics.spearman(rows, ["g"]).collect()}
    assert ranks == {"a": 1.0, "b": None}


def test_bootstrap_is_near_resampling(spark):
    draw = np.random.default_rng(0)
    y = draw.normal(size=400)
    p = y + draw.normal(scale=0.3, size=400)
    rows = spark.createDataFrame([("x", i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p, strict=True))], "g string, k long, target double, prediction double")
    got = {r.metric: (r.low, r.high) for r in metrics.bootstrap(rows, ["g"], "k", times=300).collect()}
    naive = [np.abs(p[i] - y[i]).mean() for i in (draw.integers(0, 400, 400) for _ in range(2000))]
    assert got["mae"] == pytest.approx(tuple(np.percentile(naive, [2.5, 97.5])), abs=0.01)
    assert got["r2"][0] < 1 - ((p - y) ** 2).sum() / ((y - y.mean()) ** 2).sum() < got["r2"][1]


def test_signed_ranks(spark):
    values = [1.5, -0.5, 2.0, 2.0, -3.0, 0.0, 4.0, 1.0, 2.5, 3.5, 0.7, 5.0]
    rows = spark.createDataFrame([("x", v) for v in values] + [("few", 1.0)] * 3 + [("same", 2.0)] * 12, "g string, v double")
    ranks = {r.g: r for r in metrics.signed_ranks(rows, ["g"], "v").collect()}
    assert (ranks["x"].n, ranks["x"].w_plus) == (11, 66 - 1 - 8) and ranks["x"].ties == 6
    p = {r.g: r.p for r in metrics.wilcoxon(rows, ["g"], "v").collect()}
    assert p["few"] is None and p["same"] is None and 0.02 < p["x"] < 0.04


def test_equal_savings_are_ties_in_any_order(spark):
    parts, same = [0.1, 0.2, 0.3, 1e-9, 7e5], []
    draw = random.Random(3)
    for g in range(8):
        for run, scale in (("base", 2.0), ("red", 1.0)):
            same += [(run, g, scale * v, scale * v) for v in draw.sample(parts, len(parts))]
    even = [(run, 8, v, v) for run, order in (("base", (0.1, 0.2, 0.3)), ("red", (0.3, 0.2, 0.1))) for v in order]
    rows = spark.createDataFrame(same + even, "run_label string, graph_id long, step_time_s double, vram_mb double").coalesce(1)
    configs = spark.createDataFrame([("base", "none", None), ("red", "partition", "random")], "run_label string, kind string, method string")
    for table in (rows, rows.repartition(5)):
        got = metrics.signed_ranks(reports.paired_savings(table, configs, exact=True), ["run_label"], "vram_saving").first()
        assert (got.n, got.w_plus, got.ties) == (8, 36.0, 8**3 - 8)


def test_exact_means_of_odd_numbers(spark):
    inf, nan = float("inf"), float("nan")
    groups = {
        "cancel": [1e300, 1.0, -1e300, 1e-300],
        "tiny": [5e-324, 1e-323, -5e-324],
        "edges": [2.0**k for k in range(-1074, 1020, 8)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1020, 8)],
        "big": [1.5e307, 1.7e307, -3e306],
        "zero": [0.0, -0.0, 0.0],
        "missing": [None, None],
        "some": [None, 3.0, 4.0],
        "nan": [1.0, nan, inf],
        "inf": [1.0, inf],
        "both": [inf, -inf],
        "long": [(-1) ** i * 0.1 * i for i in range(500)],
    }
    rows = spark.createDataFrame([(g, v, 1.0) for g, vs in groups.items() for v in vs], "g string, v double, one double").repartition(7)
    got = {r.g: r for r in metrics.exact_means(rows, ["g"], ["v", "one"]).collect()}
    assert set(got) == set(groups) and all(r.one == 1.0 for r in got.values())
    for g, vs in groups.items():
        held = [v for v in vs if v is not None]
        if g in ("nan", "both"):
            assert math.isnan(got[g].v)
        elif not held:
            assert got[g].v is None
        else:
            assert got[g].v == pytest.approx(math.fsum(held) / len(held), rel=1e-15, abs=0)


def test_paired_savings_by_hand(spark):
    rows = spark.createDataFrame([("base", 1, 1.0, 100.0), ("base", 1, 2.0, 200.0), ("red", 1, 0.5, 50.0), ("red", 1, 1.5, 150.0)], "run_label string, graph_id long, step_time_s double, vram_mb double")
    configs = spark.createDataFrame([("base", "none", None), ("red", "partition", "random")], "run_label string, kind string, method string")
    got = reports.savings_table(rows, configs).first()
    assert got.mean_time_saving == pytest.approx((1 - 1 / 1.5) * 100, abs=1e-6) and got.mean_vram_saving == pytest.approx((1 - 100 / 150) * 100, abs=1e-6) and (got.kind, got.method, got.n_paired) == ("partition", "random", 1)


def test_scaling_line(spark):
    rows = spark.createDataFrame([("r", n, 2.0 * n + 10) for n in (10, 20, 30, 40)] + [("one", 1, 1.0)], "run_label string, num_nodes long, vram_mb double")
    got = reports.vram_scaling(rows).collect()
    assert [(r.run_label, r.mb_per_1k_nodes, r.intercept) for r in got] == [("r", 2000.0, 10.0)]


def test_printed_tables(spark):
    rows = spark.createDataFrame([("a_b%", 0.12345, 3), ("c", None, 4)], "name string, x double, n int")
    text = reports.booktabs(rows, "Caption", "tab:x")
    assert r"a\_b\% & 0.123 & 3 \\" in text and r"c & -- & 4 \\" in text and r"\begin{tabular}{lrr}" in text
    assert reports.booktabs(rows.limit(0), "Caption", "tab:x") == ""


def test_baselines_by_hand(spark):
    rows = spark.createDataFrame([(0.0,), (0.1,), (0.1,), (0.8,)], "target double")
    got = baselines.constants(rows).first()
    assert got.mean == pytest.approx(0.25) and got.median == pytest.approx(0.1)
    line = spark.createDataFrame([(float(x), 0.5 * x + 1, 2.0 * x) for x in range(5)], "x double, y double, z double")
    c, rank, _ = baselines.least_squares(line, [F.col("x")], F.col("y"))
    assert c == pytest.approx([1, 0.5]) and rank == 2
    c, rank, _ = baselines.least_squares(line, [F.col("x"), F.col("z")], F.col("y"))
    assert rank == 2 and c[1] + 2 * c[2] == pytest.approx(0.5)


def test_renames(spark):
    plan = spark.createDataFrame([("a", "T", "b"), ("c", "T", "d"), ("e", "T", "f"), ("g", "T", "h")], "path string, canonical_id string, suggested string")
    there = spark.createDataFrame([("a",), ("d",), ("e",), ("f",)], "path string")
    assert {r.path: r.status for r in audit.rename_status(plan, there).collect()} == {"a": "rename", "c": "already", "e": "skip", "g": "missing"}


def test_netlists(spark, tmp_path):
    folder = tmp_path / "designs"
    folder.mkdir()
    (folder / "toy_synX_step0.bench").write_text("# toy\nINPUT(a)\nINPUT(b)\nOUTPUT(z)\nz = BUFF(n3)\nn1 = AND(a, b)\nn2 = AND(b, a)\nn4 = NOT(n2)\nn3 = AND(n1, n4)\n")
    rows = readers.netlists(spark, str(folder))
    assert {r.design for r in rows.collect()} == {"toy"} and rows.count() == 8
    gates = readers.strash(rows).collect()
    assert [(r.a, r.b, r.inv_a, r.inv_b, r.level) for r in sorted(gates, key=lambda r: r.level)] == [("a", "b", False, False, 1), (gates[0].gate, gates[0].gate, False, True, 2)]


def test_aiger(spark):
    text = b"aag 3 2 0 2 1\n2\n4\n6\n7\n6 2 5\n"
    binary = b"aig 3 2 0 2 1\n6\n7\n" + bytes([1, 3])
    files = spark.createDataFrame([("t", text), ("b", binary)], "path string, content binary")
    nodes, edges = readers.circuits(files)
    for p in "tb":
        assert [(r.node_id, r.role) for r in nodes.where(f"path = '{p}'").orderBy("node_id").collect()] == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 3), (5, 3)]
        assert sorted((r.src, r.dst, r.inv) for r in edges.where(f"path = '{p}'").collect()) == [(1, 3, False), (2, 3, True), (3, 4, False), (3, 5, True)]


def test_archives_and_listing(spark, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("d/a.log", "one")
        z.writestr("d/b.txt", "two")
    (tmp_path / "x.zip").write_bytes(held.getvalue())
    (tmp_path / "_skip.zip").write_bytes(held.getvalue())
    files = spark.read.format("binaryFile").option("pathGlobFilter", "x.zip").load(str(tmp_path))
    assert [(r.member, r.size) for r in readers.archive_members(files).collect()] == [("d/a.log", 3)]
    assert bytes(readers.archive_members(files, contents=True).first().content) == b"one"
    listed = readers.listing(spark, str(tmp_path), "*.zip")
    done = spark.createDataFrame([], "path string")
    assert listed.count() == 1  # Spark's own listing leaves out names that begin with an underscore
    more = spark.createDataFrame([("/a/_skip.zip",), ("/a/x.zip",), ("/a/y.zip",)], "path string")
    assert [r.path for r in readers.unprocessed(more, done.union(spark.createDataFrame([("/a/y.zip",)], "path string"))).collect()] == ["/a/x.zip"]


def test_documents(spark, tmp_path):
    good, bad, short = (str(tmp_path / n) for n in ("good.json", "bad.json", "short.json"))
    json.dump({"train": ["a"], "val": ["b"], "test": ["c"], "__meta__": {"seed": "1"}}, open(good, "w"))
    json.dump({"train": ["a"], "val": ["b"], "test": ["a"]}, open(bad, "w"))
    json.dump({"train": ["a"]}, open(short, "w"))
    assert sorted((r.path, r.split) for r in readers.splits(spark, good, strict=True).collect()) == [("a", "train"), ("b", "val"), ("c", "test")]
    assert readers.splits_meta(spark, good).first().meta == {"seed": "1"}
    with pytest.raises(ValueError, match="overlap"):
        readers.splits(spark, bad, strict=True)
    with pytest.raises(ValueError, match="lacks"):
        readers.splits(spark, short)
    index = str(tmp_path / "index.json")
    open(index, "w").write('{"a": 5, "b": ["c/b", 7, "t"]}')
    assert sorted(tuple(r) for r in readers.node_index(spark, index).collect()) == [("a", None, 5, None), ("b", "c/b", 7, "t")]
    listed = str(tmp_path / "manifest.json")
    open(listed, "w").write('{"entries": [{"graph_path": "a", "cache_path": "x", "num_nodes": 3}]}')
    samples = spark.createDataFrame([(0, "a")], "pos int, graph_path string")
    assert readers.manifest(spark, listed, samples).first().num_nodes == 3
    with pytest.raises(ValueError, match="other samples"):
        readers.manifest(spark, listed, spark.createDataFrame([(0, "z")], "pos int, graph_path string"))


def test_csv_sources(spark, tmp_path):
    schema = T.StructType([T.StructField("run_label", T.StringType()), T.StructField("x", T.DoubleType())])
    assert readers.csv_folder(spark, str(tmp_path / "none"), schema).collect() == []
    (tmp_path / "p_one.csv").write_text("x\n1\nbad\n")
    assert sorted(((r.run_label, r.x) for r in readers.csv_folder(spark, str(tmp_path), schema, "p_", "run_label").collect()), key=str) == [("one", 1.0), ("one", None)]
    with pytest.raises(ValueError, match="lacks the columns run_label"):
        readers.csv_columns(spark, str(tmp_path / "p_one.csv"), schema)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "k string, v int")
    assert sinks.append_new(rows, str(tmp_path / "t"), "k").count() == 2
    sinks.append_new(rows.union(spark.createDataFrame([("c", 3)], "k string, v int")), str(tmp_path / "t"), "k")
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "b", "c"]
    predictions = spark.range(20).select(F.col("id").alias("graph_id"), F.lit(1.0).alias("target"), F.lit(0.25).alias("prediction"))
    sinks.predictions(predictions, str(tmp_path / "p"), cap=5)
    assert [r.abs_error for r in spark.read.csv(str(tmp_path / "p"), header=True).collect()] == ["0.75"] * 5


def test_work_resumes(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    go = lambda: incremental.process_new(spark, source, spark.range(1).schema, lambda b: b.withColumn("y", F.col("id") * 2), target, state)
    spark.range(5).write.mode("append").parquet(source)
    assert go() == 1 and go() == 0
    spark.range(5, 8).write.mode("append").parquet(source)
    go()
    assert sorted(r.y for r in spark.read.parquet(target).collect()) == [0, 2, 4, 6, 8, 10, 12, 14]
    items = spark.createDataFrame([("a",), ("b",)], "graph_id string")
    done = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "graph_id string, algo string")
    assert [r.graph_id for r in incremental.remaining(items, done, "graph_id", ["x", "y"]).collect()] == ["b"]


def test_search_takes_the_best_setting(spark):
    from gatelake.operators import message_passing

    draw = np.random.default_rng(3)
    x = draw.normal(size=(90, 2))
    y = 2 * x[:, 0] - x[:, 1] + 0.01 * draw.normal(size=90)
    rows = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k long, x array<double>, y double")
    got = message_passing.search(rows, "y", [0.0, 10.0], [0.0], "k").collect()
    assert [r.penalty for r in got if r.best] == [0.0] and len(got) == 2
    folds = {r.k: r.f for r in rows.select("k", rng.bucket(42, 3, "k").alias("f")).collect()}
    errors = []
    for f in range(3):
        test = np.array([folds[i] == f for i in range(90)])
        design = np.c_[np.ones(90), x]
        b, *_ = np.linalg.lstsq(design[~test], y[~test], rcond=None)
        errors.append(math.sqrt(np.mean((design[test] @ b - y[test]) ** 2)))
    assert abs(next(r.rmse for r in got if r.best) - np.mean(errors)) < 1e-6


def test_one_document_holds_a_bounded_table(spark, tmp_path, monkeypatch):
    splits = spark.createDataFrame([("a", "train"), ("b", "val"), ("c", "test")], "path string, split string")
    sinks.splits_lines(splits, f"{tmp_path}/lines")
    assert sorted(map(tuple, readers.splits_lines(spark, f"{tmp_path}/lines").collect())) == sorted(map(tuple, splits.collect()))
    monkeypatch.setattr(sinks, "DOCUMENT_PATHS", 2)
    with pytest.raises(ValueError, match="lines"):
        sinks.splits_document(splits, f"{tmp_path}/document")
