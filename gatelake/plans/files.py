"""Queries that write a fixture to files and read it with the library's sources, with the SQL that checks them."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelake.functions import names
from gatelake.operators import lineage, sampling, topology
from gatelake.plans import fixtures as fx
from gatelake.sources import readers, scratch, sinks

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None, *parts: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = fx.sql(sql, *parts)
        return f

    return add


def _csv(rows: DataFrame, name: str) -> str:
    path = scratch.folder(rows.sparkSession, name)
    rows.write.option("header", "true").csv(path)
    return path


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "int": T.IntegerType()}[k]) for n, k in (x.split() for x in text.split(", "))])


@register("src09_typed_csv", "SELECT graph_path, target, pre_nodes AS csv_num_nodes, NULL::INT AS absent FROM fx_samples", "samples")
def src09(spark: SparkSession, sf: str) -> DataFrame:
    path = _csv(fx.samples(spark, sf).select("graph_path", "target", F.col("pre_nodes").alias("csv_num_nodes"), "design"), "typed")
    return readers.csv_columns(spark, path, _schema("graph_path string, target double, csv_num_nodes long, absent int"), optional=["absent"])


@register("src10_text_csv", "SELECT file_path, tier_id::VARCHAR AS tier_id, coalesce(depth::VARCHAR, '') AS depth FROM fx_master", "master")
def src10(spark: SparkSession, sf: str) -> DataFrame:
    path = _csv(fx.master(spark, sf).select(F.concat(F.lit("  "), "file_path").alias("file_path"), "tier_id", "depth"), "text")
    return readers.csv_strings(spark, path, ["file_path"])


@register("src13_csv_folder", "SELECT run_label, target, count(*) AS n FROM fx_predictions GROUP BY ALL", "predictions")
def src13(spark: SparkSession, sf: str) -> DataFrame:
    path = _csv(fx.predictions(spark, sf).select("run_label", "target"), "folder")
    held = readers.csv_folder(spark, path, _schema("run_label string, target double"), "part-", "run_label")
    return held.groupBy("run_label", "target").agg(F.count("*").alias("n"))


_SPLIT = """, pg AS (SELECT graph_path AS path, min(design) AS grp FROM fx_samples GROUP BY 1), rk AS (SELECT grp, row_number() OVER (ORDER BY cast('0x' || substr(md5('42:' || grp), 1, 8) AS BIGINT), grp) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM pg))
SELECT path, CASE WHEN r < greatest(1, floor(n * 0.8::DOUBLE)) THEN 'train' WHEN r < greatest(1, floor(n * 0.8::DOUBLE)) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM pg JOIN rk USING (grp)"""


@register("src15_splits_document", _SPLIT, "samples")
def src15(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch.folder(spark, "splits")
    sinks.splits_document(sampling.grouped_split(fx.samples(spark, sf), names.design_of_path(F.col("graph_path")), "graph_path", 42), path)
    return readers.splits(spark, path, strict=True)


@register("src17_manifest", "SELECT (row_number() OVER (ORDER BY graph_path) - 1)::INT AS pos, graph_path, 'cache/' || graph_path AS cache_path, max(pre_nodes) AS num_nodes FROM fx_samples GROUP BY graph_path", "samples")
def src17(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.samples(spark, sf).groupBy("graph_path").agg(F.max("pre_nodes").alias("num_nodes"))
    path = scratch.folder(spark, "manifest")
    ranked = lineage.task_ids(rows, "graph_path")
    sinks.graph_lines(ranked.select((F.col("task_id") - 1).cast("int").alias("pos"), "graph_path", F.concat(F.lit("cache/"), "graph_path").alias("cache_path"), "num_nodes"), path)
    return readers.manifest_lines(spark, path)


@register("snk02_files_by_algorithm", "SELECT algorithm, count(*) AS n, sum(nodes)::BIGINT AS nodes FROM fx_master WHERE algorithm <> '' GROUP BY 1", "master")
def snk02(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch.folder(spark, "algorithms")
    sinks.by_algorithm(fx.master(spark, sf).where("algorithm != ''").select("algorithm", "nodes"), path)
    return spark.read.csv(path, header=True, schema="nodes long, algorithm string").groupBy("algorithm").agg(F.count("*").alias("n"), F.sum("nodes").alias("nodes"))


@register("snk04_replaced_results", "SELECT run_label, split, CASE WHEN run_label = 'A' THEN 2 ELSE 1 END::BIGINT AS version, count(*) AS n FROM fx_predictions GROUP BY ALL", "predictions")
def snk04(spark: SparkSession, sf: str) -> DataFrame:
    path, keys = scratch.folder(spark, "results"), ["run_label", "split"]
    rows = fx.predictions(spark, sf).groupBy(*keys).agg(F.count("*").alias("n"))
    sinks.results(rows.withColumn("version", F.lit(1).cast("long")), path, keys)
    sinks.results(rows.where("run_label = 'A'").withColumn("version", F.lit(2).cast("long")), path, keys)
    return spark.read.parquet(path).select("run_label", "split", "version", "n")


@register("src08_resumed_work", "SELECT l_suppkey AS graph_id, count(*) AS n FROM lineitem GROUP BY 1", "gates")
def src08(spark: SparkSession, sf: str) -> DataFrame:
    """Files that come in two turns are each taken up once."""
    from gatelake.streaming import incremental

    base = scratch.folder(spark, "stream")
    rows = fx.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("graph_id"))
    work = lambda batch: batch.groupBy("graph_id").agg(F.count("*").alias("n"))
    for odd in (0, 1):
        rows.where(F.col("graph_id") % 2 == odd).write.mode("append").parquet(f"{base}/in")
        incremental.process_new(spark, f"{base}/in", rows.schema, work, f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").groupBy("graph_id").agg(F.sum("n").alias("n"))


def _values(columns: str, *rows: tuple) -> str:
    """SQL of a few fixed rows."""
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    names_, casts = zip(*(c.split() for c in columns.split(", ")), strict=True)
    body = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    return "SELECT " + ", ".join(f"{n}::{c} AS {n}" for n, c in zip(names_, casts, strict=True)) + f" FROM (VALUES {body}) t({', '.join(names_)})"


#: Small files of each format, as tests of a reader need them.
BENCH = {
    "adder_syn1_step2.bench": b"# an adder\nINPUT(a)\nINPUT( b )\n\nOUTPUT(s)\nn1 = NOT(a)\nn2 = and(n1, b)\ns = BUFF(n2)\n",
    "mux.bench": b"INPUT(x)\nOUTPUT(x)\n",
}


def _folder(spark: SparkSession, name: str, files: dict[str, bytes]) -> str:
    path = scratch.folder(spark, name)
    for file, data in files.items():
        scratch.put(spark, f"{path}/{file}", data)
    return path


@register(
    "src01_bench_statements",
    _values("design VARCHAR, kind VARCHAR, out VARCHAR, ins VARCHAR", ("adder", "INPUT", "a", ""), ("adder", "INPUT", "b", ""), ("adder", "OUTPUT", "s", ""), ("adder", "NOT", "n1", "a"), ("adder", "AND", "n2", "n1,b"), ("adder", "BUFF", "s", "n2"), ("mux", "INPUT", "x", ""), ("mux", "OUTPUT", "x", "")),
)
def src01(spark: SparkSession, sf: str) -> DataFrame:
    return readers.netlists(spark, _folder(spark, "bench", BENCH)).select("design", "kind", "out", F.array_join("ins", ",").alias("ins"))


#: Two equal gates behind inverters, one of them folded.
_HASHED = {"twin.bench": b"INPUT(a)\nINPUT(b)\nn = NOT(a)\ng1 = AND(n, b)\ng2 = AND(b, n)\ng3 = AND(g1, g2)\nm = BUFF(g2)\ng4 = AND(m, a)\nOUTPUT(g4)\n"}


@register("src01_strashed", _values("design VARCHAR, gate VARCHAR, a VARCHAR, b VARCHAR, inv_a BOOLEAN, inv_b BOOLEAN, level INT", ("twin", "g1", "a", "b", True, False, 1), ("twin", "g3", "g1", "g1", False, False, 2), ("twin", "g4", "a", "g1", False, False, 2)))
def src01s(spark: SparkSession, sf: str) -> DataFrame:
    return readers.strash(readers.netlists(spark, _folder(spark, "twin", _HASHED)))


AIGER = {"half.aag": b"aag 3 2 0 1 1\n2\n4\n7\n6 2 5\n", "half.aig": b"aig 3 2 0 1 1\n7\n\x01\x03"}


@register(
    "src02_aiger_edges",
    _values("name VARCHAR, edge_id BIGINT, src BIGINT, dst BIGINT, inv BOOLEAN", *[row for name, (a, b) in {"half.aag": ((1, False), (2, True)), "half.aig": ((2, True), (1, False))}.items() for row in ((name, 0, a[0], 3, a[1]), (name, 1, b[0], 3, b[1]), (name, 2, 3, 4, True))]),
)
def src02(spark: SparkSession, sf: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(_folder(spark, "aiger", AIGER))
    return readers.circuits(files)[1].select(F.element_at(F.split("path", "/"), -1).alias("name"), "edge_id", "src", "dst", "inv")


def _zip(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in files.items():
            archive.writestr(name, data)
    return out.getvalue()


_MEMBERS = {"d/": b"", "d/a.aig": b"1234", "d/a.log": b"and = 5", "readme.txt": b"no", "b.log": b""}


def _archives(spark: SparkSession) -> DataFrame:
    return spark.read.format("binaryFile").load(_folder(spark, "zips", {"one.zip": _zip(_MEMBERS), "two.zip": _zip({"x.aig": b"12"})}))


@register("src05_archive_members", _values("archive VARCHAR, member VARCHAR, size BIGINT", ("one.zip", "d/a.aig", 4), ("one.zip", "d/a.log", 7), ("one.zip", "b.log", 0), ("two.zip", "x.aig", 2)))
def src05(spark: SparkSession, sf: str) -> DataFrame:
    return readers.archive_members(_archives(spark)).select(F.element_at(F.split("archive", "/"), -1).alias("archive"), "member", "size")


@register("src06_archived_logs", _values("log_name VARCHAR, design VARCHAR, algorithm VARCHAR, tier_id INT, content VARCHAR", ("a.log", "one", "Syn4", 1, "and = 5"), ("b.log", "one", "Syn4", 1, "")))
def src06(spark: SparkSession, sf: str) -> DataFrame:
    return readers.archived_logs(_archives(spark), F.regexp_extract("archive", r"([^/]*)\.zip$", 1), F.lit("Syn4"), 1)


@register("src07_found_files", _values("name VARCHAR, size BIGINT", ("half.aag", len(AIGER["half.aag"])), ("half.aig", len(AIGER["half.aig"])), ("third.aig", 3)))
def src07(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "found", {**{f"a/b/{n}": d for n, d in AIGER.items()}, "c/third.aig": b"xyz", "c/other.log": b"no"})
    return readers.listing(spark, path, "*.a[ai]g").select(F.element_at(F.split("path", "/"), -1).alias("name"), "size")


@register("src11_rows_with_bad_bytes", _values("path VARCHAR, note VARCHAR, n VARCHAR", ("a", "caf", "1"), ("b", "né", ""), ("c", "", "3")))
def src11(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "bytes", {"t.csv": b" path ,note,n\n a ,caf\xe9,1\nb,n\xc3\xa9,\nc,,3\n"})
    return readers.csv_rows(spark, path, ["path"])


_RUNS = {"results_random.csv": b"run_label,rmse\nown,0.5\n,0.25\n", "results_pagerank.csv": b"rmse\n0.125\n", "other.csv": b"run_label,rmse\nno,1\n"}


@register("src12_csv_folder", _values("run_label VARCHAR, rmse DOUBLE", ("own", "0.5"), (None, "0.25")))
def src12(spark: SparkSession, sf: str) -> DataFrame:
    """The files of a folder, and those of one that is not there."""
    schema = _schema("run_label string, rmse double")
    path = _folder(spark, "runs", {"results_random.csv": _RUNS["results_random.csv"]})
    return readers.csv_folder(spark, path, schema, "results_").unionByName(readers.csv_folder(spark, path + "-none", schema))


@register("src14_labels_of_files", _values("run_label VARCHAR, rmse DOUBLE", ("own", "0.5"), ("random", "0.25"), ("pagerank", "0.125")))
def src14(spark: SparkSession, sf: str) -> DataFrame:
    """A folder a kind of file, since files of one CSV table have its columns."""
    schema, out = _schema("run_label string, rmse double"), None
    for name in ("results_random.csv", "results_pagerank.csv"):
        part = readers.csv_folder(spark, _folder(spark, "labels", {name: _RUNS[name], "other.csv": _RUNS["other.csv"]}), schema, "results_", "run_label")
        out = part if out is None else out.unionByName(part)
    return out


_DOCUMENTS = {"whole": b'{"train":["a","b"],"val":["c"],"test":["d"]}', "empty": b'{"train":["a"],"val":[],"test":["d"]}', "missing": b'{"train":["a"],"test":["d"]}', "overlap": b'{"train":["a"],"val":["a"],"test":["d"]}'}


@register("src16_refused_splits", _values("document VARCHAR, strict BOOLEAN, outcome VARCHAR", *[(d, strict, "read" if d == "whole" or (not strict and d != "missing") else "refused") for d in _DOCUMENTS for strict in (False, True)]))
def src16(spark: SparkSession, sf: str) -> DataFrame:
    rows = []
    for name, data in _DOCUMENTS.items():
        path = _folder(spark, f"splits-{name}", {"splits.json": data})
        for strict in (False, True):
            try:
                readers.splits(spark, path, strict)
                rows.append((name, strict, "read"))
            except ValueError:
                rows.append((name, strict, "refused"))
    return spark.createDataFrame(rows, "document string, strict boolean, outcome string")


@register("snk01_appended_rows", "SELECT design, count(*) AS n, sum(pre_nodes)::BIGINT AS nodes FROM (SELECT graph_path, any_value(design) AS design, min(pre_nodes) AS pre_nodes FROM fx_samples GROUP BY 1) GROUP BY 1", "samples")
def snk01(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the rows are there when all are written."""
    rows = fx.samples(spark, sf).groupBy("graph_path").agg(F.first("design").alias("design"), F.min("pre_nodes").alias("pre_nodes"))
    path = scratch.folder(spark, "designs")
    sinks.append_new(rows.where("pre_nodes % 2 = 0"), path, "graph_path")
    sinks.append_new(rows, path, "graph_path")
    return spark.read.parquet(path).groupBy("design").agg(F.count("*").alias("n"), F.sum("pre_nodes").alias("nodes"))


@register("snk06_benchmark_file", "SELECT run_label, count(*) AS n, round(sum(step_time_s), 4) AS seconds FROM fx_per_graph GROUP BY 1", "per_graph")
def snk06(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch.folder(spark, "benchmark")
    sinks.benchmarks(fx.per_graph(spark, sf).select("run_label", "graph_id", "step_time_s"), path)
    return spark.read.csv(path, header=True, schema="run_label string, graph_id long, step_time_s double").groupBy("run_label").agg(F.count("*").alias("n"), F.round(F.sum("step_time_s"), 4).alias("seconds"))


@register("snk08_flushed_masks", "SELECT graph_id, count(*) AS n FROM fx_edges GROUP BY 1", "topology")
def snk08(spark: SparkSession, sf: str) -> DataFrame:
    """Masks of two algorithms in two chunks; one algorithm is read back."""
    from gatelake.operators import reduction

    edges, path = topology.edges(fx.gates(spark, sf)), scratch.folder(spark, "store")
    mask = reduction.dropped_edges(edges).select("graph_id", F.col("edge_id").alias("item_id"), "keep")
    for odd in (0, 1):
        part = mask.where(F.col("graph_id") % 2 == odd)
        sinks.masks(part.withColumn("algo", F.lit("random_edge_dropout")).unionByName(part.withColumn("algo", F.lit("other"))), path)
    return readers.masks(spark, path, "random_edge_dropout").groupBy("graph_id").agg(F.count("*").alias("n"))


@register("snk09_saved_graphs", "SELECT n.graph_id, n_nodes, n_edges FROM (SELECT graph_id, count(*) AS n_nodes FROM fx_nodes GROUP BY 1) n JOIN (SELECT graph_id, count(*) AS n_edges FROM fx_edges GROUP BY 1) e USING (graph_id)", "topology")
def snk09(spark: SparkSession, sf: str) -> DataFrame:
    """Graphs that the store has are not saved again."""
    gates, path = fx.gates(spark, sf), scratch.folder(spark, "graphs")
    nodes, edges = topology.nodes(gates), topology.edges(gates)
    sinks.graphs(nodes.where("graph_id % 2 = 0"), edges.where("graph_id % 2 = 0"), path)
    sinks.graphs(nodes, edges, path)
    count = lambda name: spark.read.parquet(f"{path}/{name}").groupBy("graph_id").agg(F.count("*").alias(f"n_{name}"))
    return count("nodes").join(count("edges"), "graph_id")


@register("snk10_issue_files", "SELECT 'no_level' AS issue, count(*) AS n FROM fx_samples WHERE level IS NULL UNION ALL SELECT 'grown', count(*) FROM fx_samples WHERE post_nodes >= pre_nodes", "samples")
def snk10(spark: SparkSession, sf: str) -> DataFrame:
    rows, path = fx.samples(spark, sf).select("sample_id", "pre_nodes", "post_nodes", "level"), scratch.folder(spark, "issues")
    sinks.issues({"no_level": rows.where("level is null"), "grown": rows.where("post_nodes >= pre_nodes")}, path)
    read = lambda name: spark.read.csv(f"{path}/{name}", header=True, schema="sample_id long, pre_nodes long, post_nodes long, level long").agg(F.lit(name).alias("issue"), F.count("*").alias("n"))
    return read("no_level").unionByName(read("grown"))


@register("snk11_rewritten_paths", "SELECT CASE WHEN sample_id % 3 = 0 THEN 'new/' || sample_id ELSE graph_path END AS graph_path, count(*) AS n, (SELECT count(*) FROM fx_samples WHERE sample_id % 3 = 0) AS changed FROM (SELECT sample_id, CASE WHEN sample_id % 3 = 0 THEN 'old/' || sample_id ELSE graph_path END AS graph_path FROM fx_samples) GROUP BY 1", "samples")
def snk11(spark: SparkSession, sf: str) -> DataFrame:
    """A dry run counts, the run writes."""
    third = F.col("sample_id") % 3 == 0
    name = lambda root: F.concat(F.lit(root), F.col("sample_id").cast("string"))
    rows = fx.samples(spark, sf)
    path, target = _csv(rows.select(F.when(third, name("old/")).otherwise(F.col("graph_path")).alias("graph_path")), "paths"), scratch.folder(spark, "rewritten")
    plan = rows.where(third).select(name("old/").alias("path"), name("new/").alias("suggested"))
    n = sinks.rewritten(spark, path, target, plan, ["graph_path"], dry_run=True)
    assert sinks.rewritten(spark, path, target, plan, ["graph_path"]) == n
    return readers.csv_strings(spark, target).groupBy("graph_path").agg(F.count("*").alias("n")).withColumn("changed", F.lit(n).cast("long"))
