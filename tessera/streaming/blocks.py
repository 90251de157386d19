"""Generated tables as bounded streams, and a monitor of event streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.generate import POSITION, rows_at, synthesize
from ..plans.model import Profile


def table_blocks(spark: SparkSession, profile: Profile, rows: int, seed: int, block_rows: int = 50_000) -> Iterator[DataFrame]:
    """Blocks of a table in order, at least one; together they equal the table that synthesize() makes, whatever the block size."""
    for start in range(0, max(rows, 1), block_rows):
        yield synthesize(spark, profile, min(block_rows, rows - start), seed, start=start).df


def generate_stream(spark: SparkSession, profile: Profile, seed: int, path: str, checkpoint: str, rows_per_batch: int = 1000) -> StreamingQuery:
    """An unbounded stream of the rows of synthesize() by position, written once each: batches are recovered from the checkpoint."""
    at = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).load().select(F.col("value").alias(POSITION))
    return rows_at(at, profile, seed).df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()


def event_monitor(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts, nulls, mean and spread of values by type and window; works on tables and, with late events up to the delay, on streams."""
    if events.isStreaming:
        events = events.withWatermark("ts", delay)
    x = F.col("value")
    return events.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.count_if(x.isNull()).alias("n_null"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")).select(F.col("w.start").alias("window_start"), "event_type", "n", "n_null", "mean", "std")
