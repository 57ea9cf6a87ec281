"""Grids, tilings, fused rooms and constraint rows of layouts, as joins and windows keyed by the plan."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oblong.operators.graphs import components, kept
from oblong.operators.layouts import SNAP, both, coverage, pair_spans
from oblong.operators.plans import alike
from oblong.operators.polygons import corners_of, outline_distances

#: The sides of a room by axis, and its fields as columns of a decision vector.
SIDES = (("x", "left"), ("x", "right"), ("y", "low"), ("y", "high"))
FIELDS = ("x", "y", "w", "h")


def incidences(rooms: DataFrame) -> DataFrame:
    """(plan_id, axis, room_id, side, value): where each side of each room lies."""
    place = {"left": F.col("x"), "right": F.col("x") + F.col("w"), "low": F.col("y"), "high": F.col("y") + F.col("h")}
    entries = [F.struct(F.lit(axis).alias("axis"), F.lit(side).alias("side"), place[side].alias("value")) for axis, side in SIDES]
    return rooms.select("plan_id", "room_id", F.explode(F.array(*entries)).alias("i")).select("plan_id", "room_id", "i.*")


def tiling_rows(rooms: DataFrame) -> DataFrame:
    """One equality for each side that shares a grid line with an earlier one: it equals the line's first side."""
    w = Window.partitionBy("plan_id", "axis", "value").orderBy("room_id", "side")
    first = incidences(rooms).select("plan_id", "axis", "value", "room_id", "side", F.first("room_id").over(w).alias("ref_room_id"), F.first("side").over(w).alias("ref_side"), F.row_number().over(w).alias("i"))
    return first.where("i > 1").drop("i")


def snapped_to_lines(rooms: DataFrame, tolerance: float) -> DataFrame:
    """Rooms whose sides are moved to the grid lines that chained groups of sides form; a line is the mean of its distinct values."""
    sides = incidences(rooms)
    w = Window.partitionBy("plan_id", "axis").orderBy("value")
    opened = F.coalesce((F.col("value") - F.lag("value").over(w) > tolerance).cast("int"), F.lit(0))
    values = sides.select("plan_id", "axis", "value").distinct().withColumn("line", F.sum(opened).over(w))
    line = F.avg("value").over(Window.partitionBy("plan_id", "axis", "line"))
    moved = sides.join(values.withColumn("to", line).drop("line"), ["plan_id", "axis", "value"])
    at = {side: F.max(F.when(F.col("side") == side, F.col("to"))) for _, side in SIDES}
    return moved.groupBy("plan_id", "room_id").agg(at["left"].alias("x"), at["low"].alias("y"), (at["right"] - at["left"]).alias("w"), (at["high"] - at["low"]).alias("h"))


def cell_counts(rooms: DataFrame) -> DataFrame:
    """How many rooms cover each cell between neighbouring grid lines of a plan."""
    slabs = {}
    for axis in "xy":
        lines = incidences(rooms).where(F.col("axis") == axis).select("plan_id", F.col("value").alias(f"{axis}0")).distinct()
        slabs[axis] = lines.withColumn(f"{axis}1", F.lead(f"{axis}0").over(Window.partitionBy("plan_id").orderBy(f"{axis}0"))).where(f"{axis}1 IS NOT NULL")
    cells = slabs["x"].join(slabs["y"], "plan_id")
    over = rooms.select(F.col("plan_id").alias("p"), F.col("x").alias("rx"), F.col("y").alias("ry"), (F.col("x") + F.col("w")).alias("sx"), (F.col("y") + F.col("h")).alias("sy"))
    on = (F.col("plan_id") == F.col("p")) & (F.col("rx") <= F.col("x0")) & (F.col("sx") >= F.col("x1")) & (F.col("ry") <= F.col("y0")) & (F.col("sy") >= F.col("y1"))
    return cells.join(over, on, "left").groupBy("plan_id", "x0", "x1", "y0", "y1").agg(F.count("p").alias("n"))


def cells_of(rooms: np.ndarray) -> np.ndarray:
    """How many of a plan's rooms, rows x, y, w, h, cover each cell between its neighbouring grid lines; as ``cell_counts`` for one plan."""
    far = rooms[:, :2] + rooms[:, 2:]
    xs, ys = (np.unique(np.concatenate((rooms[:, k], far[:, k]))) for k in (0, 1))
    across = (rooms[:, 0, None] <= xs[:-1]) & (far[:, 0, None] >= xs[1:])
    along = (rooms[:, 1, None] <= ys[:-1]) & (far[:, 1, None] >= ys[1:])
    return across.T.astype(int) @ along.astype(int)


def outline_gaps(rooms: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Area of a rectangular outline that no room covers, and area of rooms outside of it."""
    left, low = F.greatest("x", F.lit(x0)), F.greatest("y", F.lit(y0))
    inside = rooms.select("plan_id", left.alias("x"), low.alias("y"), (F.least(F.col("x") + F.col("w"), F.lit(x1)) - left).alias("w"), (F.least(F.col("y") + F.col("h"), F.lit(y1)) - low).alias("h"))
    covered = coverage(rooms).join(coverage(inside.where("w > 0 AND h > 0")).withColumnRenamed("covered", "inside"), "plan_id", "left")
    within = F.coalesce("inside", F.lit(0.0))
    return covered.select("plan_id", ((x1 - x0) * (y1 - y0) - within).alias("gap"), (F.col("covered") - within).alias("overhang"))


def merges(rooms: DataFrame) -> DataFrame:
    """Seams between rooms that touch along more than a point: (plan_id, i, j, axis), i before j on the axis."""
    a, b = F.col("a_room_id"), F.col("b_room_id")
    meets = lambda p, q, axis, size: F.abs(F.col(f"{p}_{axis}") + F.col(f"{p}_{size}") - F.col(f"{q}_{axis}")) < SNAP
    seam = lambda i, j, axis: F.struct(i.alias("i"), j.alias("j"), F.lit(axis).alias("axis"))
    wide, high = F.col("dy") > SNAP, F.col("dx") > SNAP
    found = F.when(wide & meets("a", "b", "x", "w"), seam(a, b, "x")).when(wide & meets("b", "a", "x", "w"), seam(b, a, "x")).when(high & meets("a", "b", "y", "h"), seam(a, b, "y")).when(high & meets("b", "a", "y", "h"), seam(b, a, "y"))
    return pair_spans(both(rooms)).select("plan_id", found.alias("s")).where("s IS NOT NULL").select("plan_id", "s.*")


def fusion_rows(seams: DataFrame, contact: float) -> DataFrame:
    """Coefficients of the rows that keep seams closed: far side of i = near side of j, and a common length of ``contact`` at least.

    (plan_id, i, j, axis, row, room_id, field, coefficient, bound, kind): the terms of a row add up to its bound, or to it at most.
    """
    size = F.when(F.col("axis") == "x", "w").otherwise("h")
    other, length = F.when(F.col("axis") == "x", "y").otherwise("x"), F.when(F.col("axis") == "x", "h").otherwise("w")

    def term(row: str, room: str, field: Column, coefficient: float, bound: float, kind: str) -> Column:
        return F.struct(F.lit(row).alias("row"), F.col(room).alias("room_id"), field.alias("field"), F.lit(coefficient).alias("coefficient"), F.lit(bound).alias("bound"), F.lit(kind).alias("kind"))

    terms = [
        term("seam", "i", F.col("axis"), 1.0, 0.0, "eq"), term("seam", "i", size, 1.0, 0.0, "eq"), term("seam", "j", F.col("axis"), -1.0, 0.0, "eq"),
        term("contact_i", "i", other, 1.0, -contact, "le"), term("contact_i", "j", other, -1.0, -contact, "le"), term("contact_i", "j", length, -1.0, -contact, "le"),
        term("contact_j", "j", other, 1.0, -contact, "le"), term("contact_j", "i", other, -1.0, -contact, "le"), term("contact_j", "i", length, -1.0, -contact, "le"),
    ]
    return seams.select("plan_id", "i", "j", "axis", F.explode(F.array(*terms)).alias("t")).select("plan_id", "i", "j", "axis", "t.*")


def straightened(corners: DataFrame, angle: DataFrame) -> DataFrame:
    """Boxes of polygons (plan_id, room_id, px, py) turned back by each plan's angle (theta, degrees), to the micrometre."""
    s, c = F.sin(F.radians(F.col("theta"))), F.cos(F.radians(F.col("theta")))
    turned = corners.join(angle, "plan_id").select("plan_id", "room_id", F.round(F.col("px") * c + F.col("py") * s, 6).alias("u"), F.round(F.col("py") * c - F.col("px") * s, 6).alias("v"))
    box = turned.groupBy("plan_id", "room_id").agg(F.min("u").alias("x"), F.min("v").alias("y"), (F.max("u") - F.min("u")).alias("w"), (F.max("v") - F.min("v")).alias("h"))
    return box


def polygon_edges(corners: DataFrame) -> DataFrame:
    """Angle (0 to 180 degrees) and length of each edge of polygons given by ordered corners (plan_id, room_id, k, px, py)."""
    w = Window.partitionBy("plan_id", "room_id").orderBy("k")
    whole = Window.partitionBy("plan_id", "room_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) - F.col(c)
    moved = corners.select("plan_id", "room_id", "k", nxt("px").alias("dx"), nxt("py").alias("dy"))
    return moved.select("plan_id", "room_id", "k", F.pmod(F.degrees(F.atan2("dy", "dx")) + 180.0, F.lit(180.0)).alias("angle"), F.hypot("dx", "dy").alias("length"))


def cell_keys(values: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the unit cells that rows of numbers are in, and (row, name), by row, of all cells that rows within ``reach`` could be in.

    Names are hashes: rows that are near share one, others may. Cells are much wider than ``reach``, so a row mostly has one.
    """

    def mixed(name: np.ndarray, cell: np.ndarray) -> np.ndarray:
        name = (name ^ cell.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return name ^ (name >> np.uint64(32))

    own, row = np.zeros(len(values), dtype=np.uint64), np.arange(len(values))
    choices = own
    for v in values.T:
        own = mixed(own, np.floor(v + 0.5))
        low, high = np.floor(v - reach + 0.5)[row], np.floor(v + reach + 0.5)[row]
        two = low != high
        row, choices = np.concatenate((row, row[two])), np.concatenate((mixed(choices, low), mixed(choices[two], high[two])))
    order = np.argsort(row, kind="stable")
    return own.view(np.int64), row[order], choices[order].view(np.int64)


def outline_links(rooms: DataFrame, sizes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Near duplicates among plans whose rooms have different ids, so that only their outlines can be compared.

    ``rooms``: of the plans to compare; ``sizes``: (plan_id, copies). Returns (plan_id, met): how many other plans with other ids have an
    outline within the threshold, copies included; and links (a, b) that connect all these plans, one for each plan and near outline
    instead of all pairs. Equal outlines are one; different ones are compared, on either's corners, where they reach equally far, within
    the threshold, in eight directions and their opposites.
    """
    packed = rooms.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("room_id", *FIELDS))).alias("r"))
    packed = packed.select("plan_id", F.xxhash64(F.transform("r", lambda r: r["room_id"])).alias("ids"), F.flatten(F.transform("r", lambda r: F.array(*[r[f] for f in FIELDS]))).alias("v"))

    turn = np.radians([0, 90, 45, 135, 22.5, 112.5, 67.5, 157.5])
    directions = np.stack((np.cos(turn), np.sin(turn)))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column("v").offsets.to_numpy()
            matrix = batch.column("v").values.to_numpy(zero_copy_only=False).reshape(-1, 4)
            names, reach = np.full(batch.num_rows, None, dtype=object), np.zeros((batch.num_rows, 16))
            for all_, rooms in alike(matrix, ends // 4):
                most = max(1, 400_000 // rooms.shape[1] ** 2)
                for k in range(0, len(all_), most):
                    plan, corners = corners_of(rooms[k : k + most])
                    own, starts = np.unique(plan, return_index=True)  # rooms without an area have no outline
                    own, cuts = all_[k + own], [*starts.tolist(), len(plan)]
                    rounded = np.ascontiguousarray(np.round(corners, 9) + 0.0)
                    names[own] = [hashlib.sha256(rounded[p:q].tobytes()).hexdigest() for p, q in zip(cuts, cuts[1:], strict=False)]
                    along = corners[:, :2] @ directions
                    if len(own):
                        reach[own] = np.stack((np.minimum.reduceat(along, starts), np.maximum.reduceat(along, starts)), axis=2).reshape(len(own), -1)
            key, row, choices = cell_keys(reach, threshold * (1 + 1e-9))
            upto = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            told = [pa.array(names, type=pa.string()), pa.array(list(reach), type=pa.list_(pa.float64())), pa.array(key), pa.ListArray.from_arrays(pa.array(upto), pa.array(choices))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], names=[*batch.schema.names, "print", "reach", "key", "choices"])

    facts = kept(packed.mapInArrow(measured, "plan_id long, ids long, v array<double>, print string, reach array<double>, key long, choices array<long>").where("print IS NOT NULL").join(sizes, "plan_id"), "outlines")
    counts = facts.groupBy("print", "ids").agg(F.sum("copies").alias("c"), F.min("plan_id").alias("head"))
    first, last = F.min(F.struct("ids", "head")), F.max(F.struct("ids", "head"))
    totals = counts.groupBy("print").agg(F.sum("c").alias("t"), first.alias("first"), last.alias("last"))
    heads = facts.join(facts.groupBy("print").agg(F.min("plan_id").alias("plan_id")), ["print", "plan_id"]).select("plan_id", "reach", "print", "v", "key", "choices")
    other = heads.select(F.col("plan_id").alias("other"), F.col("reach").alias("reach2"), F.explode("choices").alias("key"))
    gap = F.array_max(F.zip_with("reach", "reach2", lambda p, q: F.abs(p - q)))
    boxes = heads.select("plan_id", "reach", "key").join(other, "key").where((F.col("plan_id") < F.col("other")) & (gap <= threshold * (1 + 1e-9)))
    side = lambda own, name: heads.select(F.col("plan_id").alias(own), F.col("print").alias(f"print{name}"), F.col("v").alias(f"v{name}"))
    candidates = boxes.select("plan_id", "other").join(side("plan_id", "1"), "plan_id").join(side("other", "2"), "other").select("print1", "print2", "v1", "v2")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [(batch.column(v).values.to_numpy(zero_copy_only=False).reshape(-1, 4), batch.column(v).offsets.to_numpy() // 4) for v in ("v1", "v2")]
            yield batch.select(["print1", "print2"]).filter(pa.array(outline_distances(*held[0], *held[1]) <= threshold * (1 + 1e-9)))

    near = kept(candidates.mapInArrow(compared, "print1 string, print2 string"), "near-outlines")
    both = near.unionByName(near.select(F.col("print2").alias("print1"), F.col("print1").alias("print2"))).unionByName(totals.select(F.col("print").alias("print1"), F.col("print").alias("print2")))
    met = facts.select("plan_id", "ids", F.col("print").alias("print1")).join(both, "print1").join(totals.withColumnRenamed("print", "print2"), "print2")
    met = met.join(counts.select(F.col("print").alias("print2"), "ids", "c"), ["print2", "ids"], "left").withColumn("others", F.col("t") - F.coalesce("c", F.lit(0)))
    met = kept(met.where("others > 0").select("plan_id", "others", F.when(F.col("first.ids") != F.col("ids"), F.col("first.head")).otherwise(F.col("last.head")).alias("to")), "met")
    return met.groupBy("plan_id").agg(F.sum("others").alias("met")), met.select(F.col("plan_id").alias("a"), F.col("to").alias("b"))


def near_duplicate_groups(rooms: DataFrame, threshold: float, cell: float = 1.0, leading: int = 8, outlines: bool = False) -> DataFrame:
    """(plan_id, class_id, copies, n_links, group_id) of every plan: near duplicates as classes of equal plans and groups of linked ones.

    Plans whose rooms have equal ids and numbers are one class, named by its smallest plan; only classes are compared, so m copies cost
    m rows and no pairs. ``n_links`` counts the other plans within the threshold, copies included; ``group_id`` is the smallest plan that
    links lead to. Every link between different plans is found, and none is written out for its copies. With ``outlines`` plans whose rooms
    have different ids are compared, too, by how far their outlines are from each other.
    """
    held = F.array_sort(F.collect_list(F.struct("room_id", *FIELDS)))
    plans = rooms.groupBy("plan_id").agg(F.sha2(F.to_json(held), 256).alias("print"))
    # A class may hold a third of all plans: its smallest plan comes from an aggregation, and plans get it back by a join that Spark may split.
    classes = plans.groupBy("print").agg(F.min("plan_id").alias("class_id"), F.count("*").alias("copies"))
    members = kept(plans.join(classes, "print").select("plan_id", "class_id", "copies"), "members")
    heads = members.where("plan_id = class_id")
    links = kept(near_duplicates(rooms.join(heads.select("plan_id"), "plan_id", "left_semi"), threshold, cell, leading).select(F.col("plan_id").alias("a"), F.col("other").alias("b")), "links")
    sizes = heads.select("class_id", "copies")
    side = lambda own, far: links.select(F.col(own).alias("class_id"), F.col(far).alias("far"))
    met = side("a", "b").unionByName(side("b", "a")).join(sizes.select(F.col("class_id").alias("far"), F.col("copies").alias("far_copies")), "far")
    met = met.groupBy("class_id").agg(F.sum("far_copies").alias("met"))
    if outlines:
        more, further = outline_links(rooms.join(heads.select("plan_id"), "plan_id", "left_semi"), heads.select("plan_id", "copies"), threshold)
        met = met.unionByName(more.select(F.col("plan_id").alias("class_id"), "met")).groupBy("class_id").agg(F.sum("met").alias("met"))
        links = links.unionByName(further)
    facts = sizes.join(met, "class_id", "left").join(components(links, "a", "b").withColumnRenamed("id", "class_id"), "class_id", "left")
    facts = facts.select("class_id", (F.col("copies") - 1 + F.coalesce("met", F.lit(0))).alias("n_links"), F.coalesce("component", "class_id").alias("group_id"))
    return members.join(facts, "class_id").select("plan_id", "class_id", "copies", "n_links", "group_id")


def near_duplicates(rooms: DataFrame, threshold: float, cell: float = 1.0, leading: int = 8) -> DataFrame:
    """(plan_id, other, distance) of plans with rooms of equal ids, none of whose numbers differs by more than the threshold.

    Plans meet on the cells of their first ``leading`` numbers. One side has a key for its own cells, the other a key for each
    choice of the cells that a number within the threshold could be in: mostly one, as cells are much wider than it.
    """
    held = F.array_sort(F.collect_list(F.struct("room_id", F.array(*FIELDS).alias("v"))))
    plans = rooms.groupBy("plan_id").agg(held.alias("rooms")).select("plan_id", F.transform("rooms", lambda r: r["room_id"]).alias("ids"), F.flatten(F.transform("rooms", lambda r: r["v"])).alias("v"))
    reach = threshold * (1 + 1e-9)
    at = lambda v: F.floor(v / cell + 0.5)
    first = F.slice("v", 1, leading)
    own = plans.withColumn("key", F.xxhash64("ids", F.transform(first, at)))
    choose = lambda keys, v: F.flatten(F.transform(keys, lambda k: F.transform(F.array_distinct(F.array(at(v - reach), at(v + reach))), lambda c: F.concat(k, F.array(c)))))
    choices = F.aggregate(first, F.expr("array(cast(array() as array<bigint>))"), choose)
    other = plans.select(F.col("plan_id").alias("other"), F.col("ids").alias("ids2"), F.col("v").alias("v2"), F.explode(F.transform(choices, lambda k: F.xxhash64("ids", k))).alias("key"))
    gap = F.array_max(F.zip_with("v", "v2", lambda a, b: F.abs(a - b)))
    return own.join(other, "key").where((F.col("plan_id") < F.col("other")) & (F.col("ids") == F.col("ids2"))).withColumn("distance", gap).where(F.col("distance") <= threshold).select("plan_id", "other", "distance")
