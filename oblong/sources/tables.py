"""Parquet tables of one scale directory, on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; the scan is lazy, so filters and column choices reach the files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Make the named tables visible to spark.sql()."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
