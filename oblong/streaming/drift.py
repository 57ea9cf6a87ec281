"""Streaming extension: windowed summaries and drift of a value against a calibration, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_a_trigger: int = 1) -> DataFrame:
    """Events from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def windowed_drift(events: DataFrame, mean: float, spread: float, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Count, mean and standardised shift of the value in each window and type; a window closes when the watermark has passed it."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    sums = grouped.agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return sums.select(F.col("w.start").alias("start"), "event_type", "n", "mean", ((F.col("mean") - mean) / (spread / F.sqrt("n"))).alias("shift"))
