"""Traces as a stream: rates by window, and one row a query id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """``start, event_type, n, mean_value`` by event time; state older than the watermark is dropped."""
    grouped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")


def first_of_each(events: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
