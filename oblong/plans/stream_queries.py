"""The streaming extension as a query: events run through a stream to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from oblong.plans.registry import query, rounded
from oblong.streaming.drift import EVENTS, windowed_drift


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, round((avg(value) - 245) / (141 / sqrt(count(*))), 6) AS shift FROM events GROUP BY 1, 2")
def streaming_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily drift by event type; complete output, as a finished stream has no later watermark to close its last windows."""
    name = f"drift_{uuid.uuid4().hex}"
    events = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    run = windowed_drift(events, 245.0, 141.0).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    found = rounded(spark.table(name))
    return found.withColumn("start", found["start"].cast("timestamp_ntz"))
