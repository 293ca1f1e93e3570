"""Streaming ingestion (beyond the batch engine): new records as they arrive, review events without repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def record_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need timestamps of the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def distinct_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event_id once, within a watermark on ts."""
    return _timed(events).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    return _timed(events).withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def scan_new_records(stream: DataFrame, checkpoint: str, process: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run the batch operators on each micro-batch; process(rows, batch id) must overwrite what it wrote for that id."""
    return stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
