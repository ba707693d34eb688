"""A folder of its own for files that a job writes and reads again, in the place that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base(spark: SparkSession) -> str:
    """URI of the shared folder: ``spark.checkpoint.dir``, or the context's checkpoint folder. Where neither is set a
    local session takes a temporary folder, and a cluster, whose machines share none, is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gatelake-")
        spark.sparkContext.setCheckpointDir(found)
    at = spark._jvm.org.apache.hadoop.fs.Path(found)  # a path without a scheme is one of the default file system
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    return f"{base(spark)}/gatelake-{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written down once and read back: for a table that several aggregates read, whatever it took to make."""
    path = folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def put(spark: SparkSession, path: str, data: bytes) -> str:
    """Writes one small file, such as an archive or a netlist, from the driver; returns its path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()
    return path
