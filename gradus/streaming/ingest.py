"""Restartable ingest with Structured Streaming: files become rows of results once each, whatever stops in between.

The checkpoint knows which files a batch took; a batch's rows go to a folder named by the batch, which
a repeat of the batch overwrites. So a restart neither loses nor repeats rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ingest(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, files_per_batch: int = 8) -> int:
    """Takes all files that aren't taken yet, in batches; returns the number of batches run."""

    def write(df: DataFrame, batch: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return len(q.recentProgress)


def ingested(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).drop("batch")


def complete(rows: DataFrame, key: str = "image_id", rows_needed: int = 31) -> DataFrame:
    """Keys with all their rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == rows_needed).select(key)
