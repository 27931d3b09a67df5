"""Hourly aggregates and drift over an event stream; an extension, as the batch engine has no streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Event files of a folder as they arrive, time as a timestamp."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Count, total and errors per hour; an hour is final once the watermark has passed it."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"))
    sums = windows.agg(F.count("*").alias("transaction_count"), F.sum("value").alias("total_amount"), F.count_if(F.col("event_type") == "error").alias("fraud_count"))
    return sums.select(F.col("window.start").alias("hour"), "transaction_count", "total_amount", "fraud_count")


def each_batch(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``handle`` on what is there now, batch by batch, and return the query."""
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
