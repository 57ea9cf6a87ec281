"""Joins and sweeps over rooms, walls and openings. Every join has the plan as an equality key, so none is a cross join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tolerances in metres and square metres.
CONTACT, SNAP, OVERLAP = 1e-9, 1e-7, 1e-9


def both(rooms: DataFrame, columns: tuple[str, ...] = ("room_id", "x", "y", "w", "h"), key: str = "plan_id", id_: str = "room_id") -> DataFrame:
    """Each pair of different rooms of a plan once, the smaller id first, with columns a_* and b_*."""
    a = rooms.select(key, *[F.col(c).alias(f"a_{c}") for c in columns])
    b = rooms.select(key, *[F.col(c).alias(f"b_{c}") for c in columns])
    return a.join(b, key).where(F.col(f"a_{id_}") < F.col(f"b_{id_}"))


def span(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Length that two intervals share, at least 0."""
    return F.greatest(F.lit(0.0), F.least(a_high, b_high) - F.greatest(a_low, b_low))


def _side(axis: str, size: str, who: str) -> tuple[Column, Column]:
    return F.col(f"{who}_{axis}"), F.col(f"{who}_{axis}") + F.col(f"{who}_{size}")


def pair_spans(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("dx", span(*_side("x", "w", "a"), *_side("x", "w", "b"))).withColumn("dy", span(*_side("y", "h", "a"), *_side("y", "h", "b")))


def overlaps(rooms: DataFrame) -> DataFrame:
    """(plan_id, a_room_id, b_room_id, area) of room pairs that overlap."""
    return pair_spans(both(rooms)).withColumn("area", F.col("dx") * F.col("dy")).where(F.col("area") > OVERLAP).select("plan_id", "a_room_id", "b_room_id", "area")


def shared_walls(rooms: DataFrame) -> DataFrame:
    """Length of the side that two rooms share, for pairs that touch; vertical sides first."""
    ax, ay = _side("x", "w", "a"), _side("y", "h", "a")
    bx, by = _side("x", "w", "b"), _side("y", "h", "b")
    touch = lambda a, b: (F.abs(a[1] - b[0]) < SNAP) | (F.abs(b[1] - a[0]) < SNAP)
    length = F.when(touch(ax, bx), F.col("dy")).when(touch(ay, by), F.col("dx"))
    return pair_spans(both(rooms)).withColumn("length", length).where("length > 0").select("plan_id", "a_room_id", "b_room_id", "length")


def facades(rooms: DataFrame) -> DataFrame:
    """Length of each room's sides on the box around its plan."""
    box = rooms.groupBy("plan_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    on = lambda a, b: (F.abs(a - b) < SNAP).cast("double")
    x, y, w, h = map(F.col, "xywh")
    length = h * (on(x, F.col("x0")) + on(x + w, F.col("x1"))) + w * (on(y, F.col("y0")) + on(y + h, F.col("y1")))
    return rooms.join(box, "plan_id").select("plan_id", "room_id", length.alias("facade"))


def pairwise_order(rooms: DataFrame) -> DataFrame:
    """One edge for each room pair: axis and direction, by the wider gap, or by centres where rooms overlap on both axes."""
    c = lambda who, axis, size: F.col(f"{who}_{axis}") + F.col(f"{who}_{size}") / 2
    gap = lambda axis, size: F.greatest(F.col(f"b_{axis}") - F.col(f"a_{axis}") - F.col(f"a_{size}"), F.col(f"a_{axis}") - F.col(f"b_{axis}") - F.col(f"b_{size}"))
    gx, gy = gap("x", "w"), gap("y", "h")
    apart = (gx >= -CONTACT) | (gy >= -CONTACT)
    far = lambda axis, size: F.abs(c("b", axis, size) - c("a", axis, size))
    across = F.when(apart, gx >= gy).otherwise(far("x", "w") >= far("y", "h"))
    forward = F.when(across, c("a", "x", "w") <= c("b", "x", "w")).otherwise(c("a", "y", "h") <= c("b", "y", "h"))
    a, b = F.col("a_room_id"), F.col("b_room_id")
    return both(rooms).select("plan_id", F.when(across, "x").otherwise("y").alias("axis"), F.when(forward, a).otherwise(b).alias("src"), F.when(forward, b).otherwise(a).alias("dst"))


def crossings(rooms: DataFrame, walls: DataFrame) -> DataFrame:
    """Length of load-bearing walls strictly inside rooms."""
    bearing = walls.where("load_bearing").select("plan_id", "wall_id", "horizontal", "place", "low", "high")
    x, y, w, h = map(F.col, "xywh")
    inside = F.when(F.col("horizontal"), (F.col("place") > y + SNAP) & (F.col("place") < y + h - SNAP)).otherwise((F.col("place") > x + SNAP) & (F.col("place") < x + w - SNAP))
    length = F.when(F.col("horizontal"), span(x + SNAP, x + w - SNAP, F.col("low"), F.col("high"))).otherwise(span(y + SNAP, y + h - SNAP, F.col("low"), F.col("high")))
    return rooms.join(bearing, "plan_id").where(inside).withColumn("length", length).where(F.col("length") > SNAP).select("plan_id", "room_id", "wall_id", "length")


def opening_extents(openings: DataFrame, walls: DataFrame) -> DataFrame:
    """Absolute start and end of each opening along its wall, and how far it hangs over; only on walls that exist."""
    length = F.col("high") - F.col("low")
    placed = openings.join(walls.select("plan_id", "wall_id", "low", "high"), ["plan_id", "wall_id"])
    start = F.col("s") * length - F.col("relative_width") * length / 2
    out = placed.withColumn("length", length).withColumn("start", start).withColumn("stop", start + F.col("relative_width") * length)
    return out.withColumn("overhang", F.greatest(F.lit(0.0), -F.col("start"), F.col("stop") - F.col("length")))


def opening_conflicts(extents: DataFrame) -> DataFrame:
    """Pairs of openings of one wall whose extents overlap."""
    cols = ("opening_id", "start", "stop")
    a = extents.select("plan_id", "wall_id", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = extents.select("plan_id", "wall_id", *[F.col(c).alias(f"b_{c}") for c in cols])
    pairs = a.join(b, ["plan_id", "wall_id"]).where(F.col("a_opening_id") < F.col("b_opening_id"))
    shared = span(F.col("a_start"), F.col("a_stop"), F.col("b_start"), F.col("b_stop"))
    return pairs.withColumn("shared", shared).where(F.col("shared") > SNAP).select("plan_id", "wall_id", "a_opening_id", "b_opening_id", "shared")


def room_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rooms of two states side by side, with nulls where a room is missing in one."""
    b = before.select("plan_id", "room_id", *[F.col(c).alias(f"{c}0") for c in "xywh"])
    a = after.select("plan_id", "room_id", *[F.col(c).alias(f"{c}1") for c in "xywh"])
    return b.join(a, ["plan_id", "room_id"], "full_outer")


def displacement(changes: DataFrame) -> DataFrame:
    """Largest and total move of shared rooms of each plan, and how many rooms are on one side only."""
    moves = [F.abs(F.col(f"{c}1") - F.col(f"{c}0")) for c in "xywh"]
    one_sided = F.col("x0").isNull() | F.col("x1").isNull()
    return changes.groupBy("plan_id").agg(
        F.coalesce(F.max(F.greatest(*moves)), F.lit(0.0)).alias("largest"),
        F.coalesce(F.sum(reduce(lambda a, b: a + b, moves)), F.lit(0.0)).alias("total"),
        F.count_if(one_sided).alias("unpaired"),
    )


def grid_lines(values: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Chained groups of distinct values: a new line begins where the gap to the previous value is over the tolerance; a line is its mean."""
    w = Window.partitionBy(*keys).orderBy(value)
    opened = (F.col(value) - F.lag(value).over(w) > tolerance).cast("int")
    lines = values.select(*keys, value).distinct().withColumn("line", F.sum(F.coalesce(opened, F.lit(0))).over(w))
    return lines.groupBy(*keys, "line").agg(F.avg(value).alias("coord"), F.count("*").alias("support"))


def anchored_groups(values: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Number of groups where each is anchored at its first value: a sequential fold over the sorted values."""
    start = F.struct(F.lit(0).alias("n"), F.lit(float("-inf")).alias("anchor"))
    step = lambda acc, v: F.when(v - acc["anchor"] > tolerance, F.struct((acc["n"] + 1).alias("n"), v.alias("anchor"))).otherwise(acc)
    return values.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_set(value)), start, step, lambda acc: acc["n"]).cast("long").alias("n_groups"))


def union_length(intervals: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Length of the union of each key's intervals: islands by the running maximum of earlier ends."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    before = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = (before.isNull() | (F.col(low) > before)).cast("int")
    marked = intervals.withColumn("opened", opened).withColumn("island", F.sum("opened").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = marked.groupBy(*keys, "island").agg(F.min(low).alias("a"), F.max(high).alias("b"))
    return islands.groupBy(*keys).agg(F.sum(F.col("b") - F.col("a")).alias("covered"))


def coverage(rooms: DataFrame) -> DataFrame:
    """Area of the union of each plan's rooms: slabs between neighbouring x, and the interval union in each."""
    cuts = rooms.select("plan_id", F.explode(F.array("x", F.col("x") + F.col("w"))).alias("x0")).distinct()
    slabs = cuts.withColumn("x1", F.lead("x0").over(Window.partitionBy("plan_id").orderBy("x0"))).where("x1 IS NOT NULL")
    inside = slabs.join(rooms, "plan_id").where((F.col("x") <= F.col("x0")) & (F.col("x") + F.col("w") >= F.col("x1")))
    strips = inside.select("plan_id", "x0", "x1", F.col("y").alias("low"), (F.col("y") + F.col("h")).alias("high"))
    return union_length(strips, ["plan_id", "x0", "x1"], "low", "high").groupBy("plan_id").agg(F.sum((F.col("x1") - F.col("x0")) * F.col("covered")).alias("covered"))


def repeated_ids(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def filter_log(rows: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Rows before and after each of some filters in turn, in one pass over the data."""
    passed, counts = F.lit(True), [F.count("*").alias("n0")]
    for i, condition in enumerate(steps.values(), 1):
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed).alias(f"n{i}"))
    entries = [F.struct(F.lit(i).cast("long").alias("step"), F.lit(name).alias("name"), F.col(f"n{i - 1}").alias("before"), F.col(f"n{i}").alias("after")) for i, name in enumerate(steps, 1)]
    return rows.agg(*counts).select(F.explode(F.array(*entries)).alias("e")).select("e.*").withColumn("dropped", 1 - F.col("after") / F.nullif(F.col("before"), F.lit(0)))


def checks(rooms: DataFrame, overlapping: DataFrame) -> DataFrame:
    """Long table of verdicts: (plan_id, check, status, measure). A check that can't be computed is unknown, never satisfied."""

    def verdict(ok: Column) -> Column:
        return F.when(ok.isNull(), "unknown").when(ok, "satisfied").otherwise("violated")

    x, y, w, h = map(F.col, "xywh")
    finite = F.bool_and(~F.isnan(x) & ~F.isnan(y) & (w > 0) & (h > 0))
    smallest = F.min(F.least(w, h))
    margin = F.min(w * h - F.col("least_area"))
    per_plan = rooms.groupBy("plan_id").agg(finite.alias("finite"), smallest.alias("side"), margin.alias("margin"), (F.count("*") == F.count_distinct("room_id")).alias("unique"))
    worst = overlapping.groupBy("plan_id").agg(F.max("area").alias("worst"))
    joined = per_plan.join(worst, "plan_id", "left").withColumn("worst", F.coalesce("worst", F.lit(0.0)))
    entry = lambda name, ok, measure: F.struct(F.lit(name).alias("check"), verdict(ok).alias("status"), measure.cast("double").alias("measure"))
    rows = F.array(
        entry("finite", F.col("finite"), F.lit(None)),
        entry("unique_ids", F.col("unique"), F.lit(None)),
        entry("not_degenerate", F.col("side") > SNAP, F.col("side")),
        entry("least_area", F.col("margin") >= -CONTACT, F.col("margin")),
        entry("least_width", F.col("side") >= F.col("least_width") - SNAP, F.col("side")),
        entry("no_overlap", F.col("worst") <= OVERLAP, F.col("worst")),
    )
    return joined.withColumn("least_width", F.lit(2.0)).select("plan_id", F.explode(rows).alias("c")).select("plan_id", "c.*")
