"""Following the event log with Structured Streaming.

The log's total order is its index; a micro-batch is applied in that order, so rows that arrive late change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.log import COLUMNS


def follow(spark: SparkSession, path: str, after: int = -1, files: int = 100) -> DataFrame:
    """The log's events behind an offset as a stream."""
    return spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", files).parquet(path).where(F.col("log_index") > after)


def once_per_request(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Repeated request ids inside the watermark are dropped; events without one all pass, under their index."""
    keyed = events.withColumn("at", F.timestamp_seconds("ts")).withColumn("once", F.coalesce("request_id", F.concat(F.lit("#"), F.col("log_index").cast("string"))))
    return keyed.withWatermark("at", delay).dropDuplicatesWithinWatermark(["once"]).drop("once", "at")


def apply(events: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append the stream to a log table; replays of a micro-batch write the same directory again, so each is there once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_counts(events: DataFrame) -> DataFrame:
    """Running counts by event type."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"))
