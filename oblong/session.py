"""Session builder for local work; on a cluster the submitted configuration wins."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

LOCAL = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "12g",
}


def local_session(cpus: int | None = None, partitions: int = 8, app: str = "oblong") -> SparkSession:
    """A local[cpus] session with UTC timestamps and few shuffle partitions."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app).config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.config(map=LOCAL).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
