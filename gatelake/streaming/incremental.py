"""Work that resumes: new files of a folder are taken up once, processed, and appended with their keys.

There are no windows or late rows here; a stream is a batch that remembers what it has done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def process_new(spark: SparkSession, source: str, schema: T.StructType, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files_a_batch: int = 1000) -> int:
    """Applies ``work`` to the Parquet files of ``source`` that came since the last call and appends to ``target``.

    A batch that failed is run again from the checkpoint; its number is a folder of the target, which is overwritten, so
    a repeated batch leaves its rows once. Returns the number of batches run."""
    ran = []

    def append(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")
        ran.append(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(ran)


def remaining(items: DataFrame, done: DataFrame, key: str, algorithms: list[str]) -> DataFrame:
    """Items that some algorithm has not processed yet: the batch form of the same."""
    finished = done.where(F.col("algo").isin(*algorithms)).groupBy(key).agg(F.count_distinct("algo").alias("n")).where(F.col("n") == len(algorithms))
    return items.join(finished.select(key), key, "left_anti")
