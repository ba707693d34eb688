"""Connected components of links that stay distributed: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.llm import shared


def _is_star(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, and that has none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    other = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
    return other.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node of ``links`` (u, v); the root is the smallest node that can be reached.

    Each round writes its links to the shared folder, so lineage stays short and a lost executor costs a task. The least
    neighbours are written before they are joined back, so that Spark can split the links of a hub."""
    spark = links.sparkSession
    edges, path = shared.written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "links")
    while not _is_star(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        least, at_least = shared.written(least, "least")
        large = both.join(least, both.u == least.w).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        low, at_low = shared.written(low, "least")
        small = large.join(low, large.u == low.w).select(F.col("v").alias("a"), F.col("u").alias("b"), "m")
        out = small.select(F.col("a").alias("u"), F.col("m").alias("v")).unionByName(small.select(F.col("b").alias("u"), F.col("m").alias("v"))).where("u != v").distinct()
        old, (edges, path) = path, shared.written(out, "links")
        shared.remove(spark, old, at_least, at_low)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
