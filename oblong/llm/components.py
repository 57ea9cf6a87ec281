"""Connected components of a graph given by its links, by hooking and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oblong.llm.shared import discard, looked_up, most_frequent, stored


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, hub: int = 10_000, broadcast_rows: int = 50_000) -> DataFrame:
    """(id, component) for every vertex that has a link; the component is its smallest id.

    Each round a vertex takes the smallest label of its neighbours, hands it to the vertex it was labelled with, and then
    follows its label one step, so the number of rounds grows with the logarithm of a component's width. Labels are
    written to the shared folder after each round; nothing is collected but counts. No vertex with more than ``hub`` links
    and no label of many vertices meets its rows in one task: the labels of both are broadcast, ``broadcast_rows`` at most.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = stored(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = stored(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("links")).select("u", F.least("u", "m").alias("label"), "links"), "labels")
    hubs = labels.where(F.col("links") > hub).select("u", "links")
    held = hubs.limit(1).count() > 0
    if held:
        hubs = stored(most_frequent(hubs, "links", broadcast_rows).select("u"), "hubs")
    for _ in range(rounds):
        known = labels.select(F.col("u").alias("v"), "label")
        if held:
            names = F.broadcast(hubs.withColumnRenamed("u", "v"))
            near = edges.join(F.broadcast(known.join(names, "v", "left_semi")), "v").unionByName(edges.join(names, "v", "left_anti").join(known, "v"))
        else:
            near = edges.join(known, "v")
        lowest = near.select("u", "label").unionByName(labels.select("u", "label")).groupBy("u").agg(F.min("label").alias("low"))
        hooked = labels.select("u", "label").join(lowest, "u")
        handed = hooked.select(F.col("label").alias("u"), F.col("low").alias("label")).unionByName(hooked.select("u", F.col("low").alias("label")))
        new = stored(handed.groupBy("u").agg(F.min("label").alias("label")), "hooked")
        ahead = new.groupBy("label").agg(F.count("*").alias("n")).join(new.select(F.col("u").alias("label"), F.col("label").alias("far")), "label")
        ahead = stored(ahead.where("far <> label").select("label", "far", "n"), "ahead")
        after = looked_up(new, ahead, ["label"], "n", broadcast_rows).select("u", F.least("label", F.coalesce("far", "label")).alias("label"))
        after = stored(after.join(labels.select("u", F.col("label").alias("was")), "u"), "labels")
        changed = after.where("label <> was").limit(1).count()
        discard(labels, new, ahead)
        labels = after
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    discard(edges)
    if held:
        discard(hubs)
    return labels.select(F.col("u").alias("id"), F.col("label").alias("component"))
