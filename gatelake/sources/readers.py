"""Sources: netlists, AIGER circuits, archives, logs, metadata files, JSON documents and mask stores as DataFrames."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelake import schemas


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified) of the files below a folder, once each, without their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).dropDuplicates(["path"])


def unprocessed(files: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """Files of which the name does not begin with an underscore and that are not done yet."""
    own = ~F.regexp_extract(key, r"([^/]*)$", 1).startswith("_")
    return files.where(own).join(done.select(key), key, "left_anti")


def netlists(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(design, line, kind, out, ins) of BENCH files: inputs, outputs and gates; comments and blanks are left out."""
    text = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_b"), F.trim("value").alias("value"), F.monotonically_increasing_id().alias("line"))
    io_line, gate = r"^(INPUT|OUTPUT)\(\s*([^)\s]+)\s*\)$", r"^(\S+)\s*=\s*(\w+)\(\s*([^)]*)\)$"
    is_io, is_gate = F.col("value").rlike(io_line), F.col("value").rlike(gate)
    part = lambda p, i: F.regexp_extract("value", p, i)
    rows = text.where(is_io | is_gate).select(
        F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(_syn[0-9X]+_step\d+)?\.[^.]*$", "").alias("design"),
        "line",
        F.when(is_io, part(io_line, 1)).otherwise(F.upper(part(gate, 2))).alias("kind"),
        F.when(is_io, part(io_line, 2)).otherwise(part(gate, 1)).alias("out"),
        F.when(is_gate, F.split(F.trim(part(gate, 3)), r"\s*,\s*")).otherwise(F.array().cast("array<string>")).alias("ins"),
    )
    return rows


AIG_SCHEMA = "design string, gate string, a string, b string, inv_a boolean, inv_b boolean, level int"


def strash(statements: DataFrame) -> DataFrame:
    """(design, gate, a, b, inv_a, inv_b, level) of two-input ANDs: NOT and BUFF become inverted edges, and gates of
    equal fanins become one, which keeps its first name. A netlist is one unit, since its gates name one another."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("line")  # which of two equal gates keeps its name must not depend on the shuffle
        source = {r.out: (r.kind, list(r.ins)) for r in frame.itertuples() if r.kind not in ("INPUT", "OUTPUT")}
        found: dict[str, tuple[str, bool, int]] = {r.out: (r.out, False, 0) for r in frame.itertuples() if r.kind == "INPUT"}
        gates: dict[tuple, str] = {}
        rows = []
        for name in source:
            stack = [name]
            while stack:
                at = stack[-1]
                if at in found:
                    stack.pop()
                    continue
                kind, ins = source[at]
                missing = [x for x in ins if x not in found]
                if missing:
                    stack += missing
                    continue
                stack.pop()
                if kind in ("NOT", "BUFF", "BUF"):
                    base, inverted, level = found[ins[0]]
                    found[at] = (base, inverted != (kind == "NOT"), level)
                    continue
                (a, ia, la), (b, ib, lb) = sorted(found[x] for x in ins[:2])
                level = max(la, lb) + 1
                key = (a, ia, b, ib)
                if key not in gates:
                    gates[key] = at
                    rows.append((frame["design"].iloc[0], at, a, b, ia, ib, level))
                found[at] = (gates[key], False, level)
        return pd.DataFrame(rows, columns=["design", "gate", "a", "b", "inv_a", "inv_b", "level"])

    return statements.groupBy("design").applyInPandas(run, AIG_SCHEMA)


def _aiger(data: bytes) -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
    """Input literals, output literals and (gate, fanin, fanin) literals of an AIGER file, ASCII or binary."""
    head, _, rest = data.partition(b"\n")
    kind, _, n_in, n_latch, n_out, n_and = (head.split() + [b"0"] * 6)[:6]
    n_in, n_latch, n_out, n_and = map(int, (n_in, n_latch, n_out, n_and))
    if n_latch:
        raise ValueError("latches are not supported")
    if kind == b"aag":
        lines = rest.split(b"\n")
        number = lambda line: [int(x) for x in line.split()]
        ins = [number(x)[0] for x in lines[:n_in]]
        outs = [number(x)[0] for x in lines[n_in : n_in + n_out]]
        return ins, outs, [tuple(number(x)) for x in lines[n_in + n_out : n_in + n_out + n_and]]
    if kind != b"aig":
        raise ValueError("not an AIGER file")
    outs = []
    for _ in range(n_out):
        line, _, rest = rest.partition(b"\n")
        outs.append(int(line))
    at, ands = 0, []
    for i in range(n_and):
        gate, pair = 2 * (n_in + i + 1), []
        last = gate
        for _ in range(2):
            delta = shift = 0
            while True:
                byte = rest[at]
                at += 1
                delta |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    break
            last -= delta
            pair.append(last)
        ands.append((gate, *pair))
    return [2 * (i + 1) for i in range(n_in)], outs, ands


def circuits(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, node_id, role) and (path, edge_id, src, dst, inv) of AIGER files in ``content``: node 0 is the constant,
    each output is a node of its own after the others, and node ids ascend from fanins to gates."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                ins, outs, ands = _aiger(bytes(content))
                roles = {0: 0} | {x >> 1: 1 for x in ins} | {g >> 1: 2 for g, _, _ in ands}
                if sorted(roles) != list(range(len(roles))):
                    raise ValueError(f"node ids of {path} have gaps")
                edges = [(x >> 1, g >> 1, bool(x & 1)) for g, a, b in sorted(ands) for x in (a, b)]
                edges += [(x >> 1, len(roles) + i, bool(x & 1)) for i, x in enumerate(outs)]
                roles |= {len(roles) + i: 3 for i in range(len(outs))}
                out.append({"path": path, "nodes": [{"node_id": n, "role": r} for n, r in sorted(roles.items())], "edges": [{"src": s, "dst": d, "inv": i} for s, d, i in edges]})
            yield pd.DataFrame(out, columns=["path", "nodes", "edges"])

    whole = files.select("path", "content").mapInPandas(run, "path string, nodes array<struct<node_id:long,role:int>>, edges array<struct<src:long,dst:long,inv:boolean>>")
    nodes = whole.select("path", F.inline("nodes"))
    edges = whole.select("path", F.posexplode("edges").alias("edge_id", "e")).select("path", F.col("edge_id").cast("long"), "e.*")
    return nodes, edges


def archive_members(files: DataFrame, suffixes: Sequence[str] = (".aig", ".log"), contents: bool = False) -> DataFrame:
    """(archive, member, size[, content]) of ZIP files in ``content``; folders and other suffixes are left out."""
    wanted = tuple(suffixes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as archive:
                    for m in archive.infolist():
                        if not m.is_dir() and m.filename.endswith(wanted):
                            row = {"archive": [path], "member": [m.filename], "size": [m.file_size]}
                            yield pd.DataFrame(row | ({"content": [archive.read(m)]} if contents else {}))

    schema = "archive string, member string, size long" + ", content binary" * contents
    return files.select("path", "content").mapInPandas(run, schema)


def archived_logs(files: DataFrame, design, algorithm, tier: int) -> DataFrame:
    """Logs inside ZIP files in the layout that ``lineage.parse_logs`` reads."""
    held = archive_members(files, (".log",), contents=True)
    return held.select(F.regexp_extract("member", r"([^/]*)$", 1).alias("log_name"), design.alias("design"), algorithm.alias("algorithm"), F.lit(tier).alias("tier_id"), F.decode("content", "utf-8").alias("content"))


def csv_columns(spark: SparkSession, path, wanted: T.StructType, optional: Sequence[str] = ()) -> DataFrame:
    """The wanted columns of CSV files, typed; an absent optional one is null, another absent one is an error."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    schemas.require_columns(raw, [f.name for f in wanted if f.name not in optional], str(path))
    cast = lambda f: F.nullif(F.trim(f.name), F.lit("")).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)
    return raw.select(*[cast(f).alias(f.name) for f in wanted])


def csv_strings(spark: SparkSession, path, keys: Sequence[str] = ()) -> DataFrame:
    """All columns as text: headers and key columns trimmed, null as empty."""
    raw = spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE")
    raw = raw.toDF(*[c.strip() for c in raw.columns]).na.fill("")
    return raw.withColumns({k: F.trim(k) for k in keys if k in raw.columns})


def csv_rows(spark: SparkSession, path, keys: Sequence[str] = ()) -> DataFrame:
    """The same of files with bytes that are no UTF-8, which are left out."""
    raw = csv_strings(spark, path, keys)
    return raw.select(*[F.replace(c, F.lit("\ufffd"), F.lit("")).alias(c) for c in raw.columns])


def prediction_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(source, target, prediction) of CSV tables by name; one that lacks a column, or has no rows, is skipped."""
    out = spark.createDataFrame([], "source string, target double, prediction double")
    for name, path in sorted(paths.items()):
        raw = spark.read.csv(path, header=True, inferSchema=False)
        if schemas.has_columns(raw, ["target", "prediction"]) and not raw.isEmpty():
            out = out.unionByName(raw.select(F.lit(name).alias("source"), F.col("target").try_cast("double").alias("target"), F.col("prediction").try_cast("double").alias("prediction")))
    return out


def csv_folder(spark: SparkSession, folder: str, schema: T.StructType, prefix: str = "", column: str | None = None) -> DataFrame:
    """CSV files of a folder as one table, empty where there are none. ``column`` takes what a file's name has between
    ``prefix`` and ``.csv``, unless the file has that column itself."""
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.option("pathGlobFilter", f"{prefix}*.csv").csv(folder, header=True, inferSchema=False)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    named = F.regexp_extract("_metadata.file_name", rf"^{re.escape(prefix)}(.*)\.csv$", 1)
    out = []
    for f in schema:
        value = F.nullif(F.trim(f.name), F.lit("")).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(value, named) if f.name == column else value).alias(f.name))
    return raw.select(*out)


def splits_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema="path string, split string")


SPLITS = T.StructType([T.StructField(s, T.ArrayType(T.StringType())) for s in ("train", "val", "test")])


def splits(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(path, split) of a splits document. A split that is absent is an error; if ``strict``, one that is empty or shares
    paths with another is too."""
    held = spark.read.json(path, schema=SPLITS, multiLine=True)
    absent = [s for s in SPLITS.names if held.where(F.col(s).isNotNull()).isEmpty()]
    if absent:
        raise ValueError(f"{path} lacks {', '.join(absent)}")
    long = held.select(F.expr("stack(3, 'train', train, 'val', val, 'test', test) as (split, paths)")).select(F.explode("paths").alias("path"), "split")
    if strict:
        have = {r.split for r in long.select("split").distinct().collect()}
        if have != set(SPLITS.names):
            raise ValueError(f"{path} has an empty split")
        if not long.groupBy("path").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty():
            raise ValueError(f"splits of {path} overlap")
    return long


def splits_meta(spark: SparkSession, path: str) -> DataFrame:
    """The document's record of how it was made, as a map of texts."""
    return spark.read.text(path, wholetext=True).select(F.from_json(F.get_json_object("value", "$.__meta__"), "map<string,string>").alias("meta"))


ENTRY = "struct<graph_path:string,cache_path:string,num_nodes:long>"


def manifest(spark: SparkSession, path: str, samples: DataFrame | None = None) -> DataFrame:
    """(pos, graph_path, cache_path, num_nodes); an error if the paths are not those of ``samples`` in order."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json(F.get_json_object("value", "$.entries"), f"array<{ENTRY}>")).alias("pos", "e")).select("pos", "e.*")
    if samples is not None:
        other = samples.select(F.col("pos"), F.col("graph_path").alias("wanted"))
        if not rows.join(other, "pos", "full").where(~F.col("graph_path").eqNullSafe(F.col("wanted"))).isEmpty():
            raise ValueError(f"{path} is of other samples")
    return rows


def manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of a manifest with a line of JSON an entry, for any number of graphs."""
    return spark.read.json(path, schema="pos int, graph_path string, cache_path string, num_nodes long")


def node_index(spark: SparkSession, path: str) -> DataFrame:
    """(graph_path, cache_path, num_nodes, tag) of an index of which a value is a count or [path, count, tag]."""
    held = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("graph_path", "v"))
    item = F.from_json("v", "array<string>")
    listed = F.col("v").startswith("[")
    return held.select("graph_path", F.when(listed, F.get(item, F.lit(0))).alias("cache_path"), F.when(listed, F.get(item, F.lit(1))).otherwise(F.col("v")).cast("long").alias("num_nodes"), F.when(listed, F.get(item, F.lit(2))).alias("tag"))


def checkpoints(files: DataFrame) -> DataFrame:
    """(path, name, val_loss) of checkpoint files."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select("path", name.alias("name"), F.nullif(F.regexp_extract(name, r"val_loss=([0-9]*\.?[0-9]+)", 1), F.lit("")).cast("double").alias("val_loss"))


def rename_candidates(spark: SparkSession, path, source: str, target: str) -> DataFrame:
    """(path, suggested) pairs that differ."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    return raw.select(F.col(source).alias("path"), F.col(target).alias("suggested")).where("path != suggested").dropDuplicates(["path"])


def masks(spark: SparkSession, folder: str, algorithm: str) -> DataFrame:
    """Masks of an algorithm from a store partitioned by it; other partitions are not read."""
    return spark.read.parquet(folder).where(F.col("algo") == algorithm)


def levels_or_computed(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Stored levels, and computed ones where none are stored."""
    return computed.withColumnRenamed("level", "_level").join(stored, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("level", "_level").alias("level"))
