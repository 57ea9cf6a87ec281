"""Drawn polygons: stitching on a common grid, axes of walls, distances between outlines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oblong.operators.plans import alike

#: Fixed value: metres above which a drawn wall is none.
THICKEST = 1.0


def stitched(corners: DataFrame, tolerance: float) -> DataFrame:
    """Corners (plan_id, room_id, k, px, py) on lines that all polygons of a plan share, without those that fall on the one before.

    Coordinates that chains of gaps within the tolerance connect become one line, the mean of its distinct values. Plans with a
    polygon that keeps fewer than four corners are left out whole; ``collapsed`` counts them.
    """
    return _kept(corners, tolerance).where("fewest >= 4").select("plan_id", "room_id", "k", "px", "py")


def collapsed(corners: DataFrame, tolerance: float) -> DataFrame:
    """(plan_id, fewest) of plans that ``stitched`` leaves out."""
    return _all_corners(corners, tolerance).groupBy("plan_id").agg(F.min("n").alias("fewest")).where("fewest < 4")


def _kept(corners: DataFrame, tolerance: float) -> DataFrame:
    fewest = F.min("n").over(Window.partitionBy("plan_id"))
    return _all_corners(corners, tolerance).withColumn("fewest", fewest).where("new")


def _all_corners(corners: DataFrame, tolerance: float) -> DataFrame:
    moved = corners
    for c in ("px", "py"):
        w = Window.partitionBy("plan_id").orderBy(c)
        opened = F.coalesce((F.col(c) - F.lag(c).over(w) > tolerance).cast("int"), F.lit(0))
        values = corners.select("plan_id", c).distinct().withColumn("line", F.sum(opened).over(w))
        lines = values.withColumn("to", F.avg(c).over(Window.partitionBy("plan_id", "line"))).select("plan_id", c, "to")
        moved = moved.join(lines, ["plan_id", c]).drop(c).withColumnRenamed("to", c)
    order = Window.partitionBy("plan_id", "room_id").orderBy("k")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.struct("px", "py")
    before = F.coalesce(F.lag(at).over(order), F.last(at).over(whole))
    told = moved.withColumn("new", ~before.eqNullSafe(at))
    return told.withColumn("n", F.count_if("new").over(Window.partitionBy("plan_id", "room_id")))


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise; points on its edges are left out."""
    held = sorted(set(map(tuple, points.tolist())))
    if len(held) < 3:
        return np.array(held).reshape(-1, 2)

    def chain(row: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in row:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(held) + chain(held[::-1]))


def least_rectangle(points: np.ndarray) -> tuple[float, float, np.ndarray] | None:
    """Short side, long side and direction of the long side of the smallest rectangle around points; None where they lie on a line."""
    h = hull(points)
    if len(h) < 3:
        return None
    edges = np.roll(h, -1, axis=0) - h
    along = edges / np.hypot(edges[:, 0], edges[:, 1])[:, None]
    across = np.stack((-along[:, 1], along[:, 0]), axis=1)
    a, b = (np.ptp(h @ d.T, axis=0) for d in (along, across))
    i = int(np.argmin(a * b))
    return (float(b[i]), float(a[i]), along[i]) if a[i] >= b[i] else (float(a[i]), float(b[i]), across[i])


def centroid(points: np.ndarray) -> np.ndarray:
    """Centre of mass of a polygon given by ordered corners; the corners' mean where it has no area."""
    p = points - points[0]
    q = np.roll(p, -1, axis=0)
    cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    area = cross.sum()
    return points[0] + ((p + q) * cross[:, None]).sum(axis=0) / (3 * area) if abs(area) > 1e-12 else points.mean(axis=0)


def wall_axis(points: np.ndarray, thickest: float = THICKEST) -> tuple[float, float, float, float, float] | None:
    """Both ends of a drawn wall's axis, the smaller first, and its thickness; None where it is too thick or has no area."""
    found = least_rectangle(points)
    if found is None or found[0] > thickest:
        return None
    thick, length, along = found
    half, centre = along * length / 2, centroid(points)
    near, far = sorted((tuple((centre - half).tolist()), tuple((centre + half).tolist())))
    return (*near, *far, thick)


def outline(rooms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners and edges (x0, y0, x1, y1) of the union of rooms given as rows x, y, w, h."""
    near, far = rooms[:, :2], rooms[:, :2] + rooms[:, 2:]
    xs, ys = (np.unique(np.concatenate((near[:, k], far[:, k]))) for k in (0, 1))
    filled = np.zeros((len(xs) + 1, len(ys) + 1), dtype=bool)
    for (x0, y0), (x1, y1) in zip(near, far, strict=True):
        filled[1 + np.searchsorted(xs, x0) : 1 + np.searchsorted(xs, x1), 1 + np.searchsorted(ys, y0) : 1 + np.searchsorted(ys, y1)] = True
    upright, level = filled[1:] != filled[:-1], filled[:, 1:] != filled[:, :-1]
    i, j = np.nonzero(upright[:, 1:-1])
    standing = np.stack((xs[i], ys[j], xs[i], ys[j + 1]), axis=1)
    i, j = np.nonzero(level[1:-1])
    lying = np.stack((xs[i], ys[j], xs[i + 1], ys[j]), axis=1)
    turns = (upright[:, 1:] | upright[:, :-1]) & (level[1:] | level[:-1])
    i, j = np.nonzero(turns)
    return np.stack((xs[i], ys[j]), axis=1), np.concatenate((standing, lying))


def _turns(rooms: np.ndarray, apart: float) -> tuple[list[np.ndarray], np.ndarray]:
    """For many plans of equally many rooms the lines of both axes, ascending, and what turns where two of them cross, as in ``corners_of``."""
    lines, _, cells = _cells(rooms, apart)
    return lines, cells[:, 1:, 1:] - cells[:, :-1, 1:] - cells[:, 1:, :-1] + cells[:, :-1, :-1]


def _cells(rooms: np.ndarray, apart: float) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For many plans of equally many rooms the lines of both axes, ascending, which of them are each room's sides (the near ones of all
    rooms, then the far ones), and whether the cells between lines are covered, with a rim of empty ones."""
    count, n, _ = rooms.shape
    lines, places, spans = [], [], []
    for k in (0, 1):
        near = rooms[:, :, k]
        sides = np.concatenate((near, near + rooms[:, :, k + 2]), axis=1)
        ordered = np.sort(sides, axis=1)
        new = np.hstack((np.ones((count, 1), dtype=bool), np.diff(ordered, axis=1) > apart))
        held = np.full((count, 2 * n), np.inf)
        plan, at = np.nonzero(new)
        held[plan, (np.cumsum(new, axis=1) - 1)[plan, at]] = ordered[plan, at]
        place = np.abs(held[:, None, :] - sides[:, :, None]).argmin(axis=2)
        slab = np.arange(2 * n - 1)
        lines.append(held)
        places.append(place)
        spans.append((place[:, :n, None] <= slab) & (place[:, n:, None] > slab))
    across, along = (v.astype(np.float32) for v in spans)
    cells = np.zeros((count, 2 * n + 1, 2 * n + 1), dtype=np.int8)
    cells[:, 1:-1, 1:-1] = across.transpose(0, 2, 1) @ along > 0
    return lines, places, cells


def ring_counts(rooms: np.ndarray, apart: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(outer rings, holes, their corners, area) of the unions of many plans of equally many rooms, as ``conversion.outline_of`` traces them.

    Rooms that share a side or more hang together; holes follow from Euler's formula on the cells.
    """
    count, n, _ = rooms.shape
    (xs, ys), places, cells = _cells(rooms, apart)
    f = cells > 0
    turn = cells[:, 1:, 1:] - cells[:, :-1, 1:] - cells[:, 1:, :-1] + cells[:, :-1, :-1]
    right, up = f[:, 1:] & f[:, :-1], f[:, :, 1:] & f[:, :, :-1]
    total = lambda v: v.sum(axis=(1, 2), dtype=np.int64)
    euler = total(f) - total(right) - total(up) + total(right[:, :, 1:] & right[:, :, :-1])
    near, far = ([p[:, own] for p in places] for own in (slice(None, n), slice(n, None)))
    shared = [np.minimum(b[:, :, None], b[:, None]) - np.maximum(a[:, :, None], a[:, None]) for a, b in zip(near, far, strict=True)]
    held = (far[0] > near[0]) & (far[1] > near[1])
    reach = (np.minimum(*shared) >= 0) & (np.maximum(*shared) > 0) & held[:, :, None] & held[:, None]
    for k in range(n):
        reach |= reach[:, :, k, None] & reach[:, k, None, :]
    fragments = (held & (reach.argmax(axis=2) == np.arange(n))).sum(axis=1)
    width, height = (np.diff(v, axis=1, append=np.inf) for v in (np.where(np.isinf(v), np.nan, v) for v in (xs, ys)))
    width, height = (np.where(np.isfinite(v), v, 0.0)[:, :-1] for v in (width, height))
    area = np.einsum("pi,pij,pj->p", width, f[:, 1:-1, 1:-1].astype(float), height)
    return fragments, fragments - euler, np.abs(turn).sum(axis=(1, 2), dtype=np.int64), area


def corners_of(rooms: np.ndarray, apart: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Corners of the unions of many plans of equally many rooms, given by plan, room and x, y, w, h: (plan, (x, y, turn)), in order.

    ``turn`` counts the filled quarters around a corner by turns with plus and minus. A union follows from its corners and turns, so unions
    are equal where these are. Lines that a rounding separates are one, as in ``conversion.filled``.
    """
    lines, turn = _turns(rooms, apart)
    plan, i, j = np.nonzero(turn)
    return plan, np.stack((lines[0][plan, i], lines[1][plan, j], turn[plan, i, j]), axis=1)


def _outlines(matrix: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners and edges as ``outline`` gives them, of all plans, filled up by a plan's first corner and by edges that are nowhere."""
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    for own, rooms in alike(matrix, ends):
        (xs, ys), turn = _turns(rooms, 0.0)
        plan, i, j = np.nonzero(turn)
        found[0].append((own[plan], np.stack((xs[plan, i], ys[plan, j]), axis=1)))
        # Along a line an edge goes from one corner to the next; where parts of the union touch it goes on.
        p, i, j = np.nonzero(turn % 2)
        found[1].append((own[p[::2]], np.stack((xs[p, i][::2], ys[p, j][::2], xs[p, i][1::2], ys[p, j][1::2]), axis=1)))
        p, j, i = np.nonzero(turn.transpose(0, 2, 1) % 2)
        found[1].append((own[p[::2]], np.stack((xs[p, i][::2], ys[p, j][::2], xs[p, i][1::2], ys[p, j][1::2]), axis=1)))
    out = []
    for parts in found:
        plan, values = (np.concatenate(v) for v in zip(*parts, strict=True))
        order = np.argsort(plan, kind="stable")
        plan, values = plan[order], values[order]
        held = np.bincount(plan, minlength=len(ends) - 1)
        first = np.cumsum(held) - held
        full = np.full((len(held), held.max(), values.shape[1]), np.inf)
        full[plan, np.arange(len(plan)) - first[plan]] = values
        out.append(full)
    corners, edges = out
    return np.where(np.isinf(corners), corners[:, :1], corners), edges


def outline_distances(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """``outline_distance`` of many pairs whose unions have an area: rooms of all first and of all second plans, and where each plan begins."""
    out = np.zeros(len(ends_a) - 1)
    size = np.maximum(np.diff(ends_a), np.diff(ends_b))
    order, k = np.argsort(size, kind="stable"), 0

    def furthest(corners: np.ndarray, edges: np.ndarray) -> np.ndarray:
        x, y, (x0, y0, x1, y1) = corners[:, :, :1], corners[:, :, 1:], np.ascontiguousarray(np.moveaxis(edges[:, None], -1, 0))
        dx, dy = np.maximum(0, np.maximum(x0 - x, x - x1)), np.maximum(0, np.maximum(y0 - y, y - y1))
        return np.sqrt((dx * dx + dy * dy).min(axis=2).max(axis=1))

    def chosen(matrix: np.ndarray, ends: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = ends[own + 1] - ends[own]
        upto = np.concatenate(([0], np.cumsum(held)))
        return matrix[np.repeat(ends[own] - upto[:-1], held) + np.arange(upto[-1])], upto

    while k < len(order):
        # Corners times edges grow with the square of the rooms or faster: fewer pairs of large plans at a time.
        own = order[k : k + 512]
        own = own[: max(1, 200_000 // int(size[own[-1]]) ** 2)]
        k += len(own)
        (corners_a, edges_a), (corners_b, edges_b) = _outlines(*chosen(a, ends_a, own)), _outlines(*chosen(b, ends_b, own))
        out[own] = np.maximum(furthest(corners_a, edges_b), furthest(corners_b, edges_a))
    return out


def outline_distance(a: np.ndarray, b: np.ndarray) -> float | None:
    """The furthest that a corner of one union's outline lies from the other's outline, either way; None where one has no rooms."""
    if not len(a) or not len(b):
        return 0.0 if len(a) == len(b) else None
    (corners_a, edges_a), (corners_b, edges_b) = outline(a), outline(b)

    def furthest(corners: np.ndarray, edges: np.ndarray) -> float:
        x, y = corners[:, :1], corners[:, 1:]
        dx = np.maximum(0, np.maximum(edges[:, 0] - x, x - edges[:, 2]))
        dy = np.maximum(0, np.maximum(edges[:, 1] - y, y - edges[:, 3]))
        return float(np.hypot(dx, dy).min(axis=1).max())

    return max(furthest(corners_a, edges_b), furthest(corners_b, edges_a))


def side_distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """(plan_id, distance): the largest difference of any number of rooms with equal ids; plans whose ids differ are left out."""
    rows = a.select("plan_id", "room_id", F.array("x", "y", "w", "h").alias("v")).join(b.select("plan_id", "room_id", F.array("x", "y", "w", "h").alias("u")), ["plan_id", "room_id"], "full")
    gap = F.array_max(F.zip_with("v", "u", lambda p, q: F.abs(p - q)))
    found = rows.groupBy("plan_id").agg(F.max(gap).alias("distance"), F.count_if(F.col("v").isNull() | F.col("u").isNull()).alias("odd"))
    return found.where("odd = 0").select("plan_id", "distance")


def both_sides(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rooms of the first and of the second plan of a pair, told apart by ``side``."""
    matrix, side = rows[["x", "y", "w", "h"]].to_numpy(float), rows["side"].to_numpy()
    return matrix[side == 0], matrix[side == 1]
