"""Schemas of the library's tables, and checks of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The master table of all tiers.
MASTER = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("file_path", "design", "algorithm")]
    + [T.StructField(n, T.IntegerType()) for n in ("recipe_id", "step_id", "tier_id")]
    + [T.StructField(n, T.LongType()) for n in ("nodes", "edges", "num_pi", "num_po", "depth")]
    + [T.StructField(n, T.DoubleType()) for n in ("optimizability", "depth_optimizability")]
)
PREDICTIONS = T.StructType(
    [T.StructField("run_label", T.StringType())] + [T.StructField(n, T.LongType()) for n in ("graph_id", "num_nodes", "num_edges")] + [T.StructField(n, T.DoubleType()) for n in ("target", "prediction", "abs_error")]
)


def require_columns(rows: DataFrame, columns: Sequence[str], source: str) -> DataFrame:
    """``rows``, or an error that names the source and what it lacks."""
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"{source} lacks the columns {', '.join(missing)}")
    return rows


def has_columns(rows: DataFrame, columns: Sequence[str]) -> bool:
    """The lenient form: callers skip a source that lacks a column."""
    return set(columns) <= set(rows.columns)


def with_missing(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """``rows`` in a schema's columns, null where it has none."""
    from pyspark.sql import functions as F

    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
