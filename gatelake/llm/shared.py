"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch at most: texts make long rows, and a batch is held by Spark and by its Python worker.
BATCH_ROWS = 1024
#: Bytes of a table's files for each range that is sorted in one task.
RANGE_BYTES = 1 << 30
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow(function, schema)`` in batches of at most BATCH_ROWS rows. A worker lives on into later stages, so
    it gives back what a task has freed."""

    def run(batches):
        yield from function(batches)
        _release()

    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ROWS)) <= BATCH_ROWS:
        conf.set(_ROWS, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def _release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def ranges(df: DataFrame) -> int:
    """How many ranges to sort ``df`` in: as many as shuffle partitions, or more where the tables that it is made of are large.
    A source that doesn't know its size counts as empty."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(n for n in sizes if n < int(df.sparkSession.conf.get("spark.sql.defaultSizeInBytes", str(2**63 - 1))))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // RANGE_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder: ``spark.checkpoint.dir``, or the context's checkpoint folder. Where neither is set (as in
    tests) a local session takes a new one; on a cluster, whose machines share no such folder, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gatelake-")
        spark.sparkContext.setCheckpointDir(found)
    # a path without a scheme is one of the cluster's default file system
    at = spark._jvm.org.apache.hadoop.fs.Path(found)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return re.sub(r"^file:/(?!/)", "file:///", whole).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_dir(spark)}/gatelake-{name}-{uuid.uuid4().hex}"
    for held in _scopes[-1:]:
        held.append(path)
    return path


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes ``df`` as Parquet into the shared folder; the table read back, and its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that operators wrote within, for callers that have their results by then."""
    _scopes.append([])
    try:
        yield
    finally:
        remove(spark, *_scopes.pop())


_scopes: list[list[str]] = []


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables in the shared folder that no later read needs."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
