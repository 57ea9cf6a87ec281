"""Connected components of links between rows, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oblong.sources.scratch import folder


def kept(rows: DataFrame, name: str) -> DataFrame:
    """Written and read again: lineage ends there."""
    path = folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(id, component) of every id that stands in a link; the component is its smallest id.

    In turn each id hands the smallest id that it knows to its larger and to its smaller neighbours, until nothing changes. That takes
    rounds in the logarithm of a component's size and never more links than there were. No id's links meet in one task to be listed:
    both steps are aggregations and joins on ids, which Spark splits where an id has very many.
    """
    edges = kept(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # Larger neighbours, then smaller ones and the id itself, are linked to the smallest one known.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = kept(small, "edges")
        same = small.count() == edges.count() and not small.join(edges, ["u", "v"], "left_anti").limit(1).count()
        edges = small
        if same:
            break
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
