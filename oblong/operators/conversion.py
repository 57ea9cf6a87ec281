"""From the drawn polygons of an apartment to a plan of rectangles, or to the first reason why not; functions of one apartment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from oblong.operators.linear import decompose
from oblong.operators.polygons import centroid, least_rectangle, wall_axis
from oblong.operators.repair import inside_cells

_EPS = 1e-9

#: Reasons of rejection, in the order in which they are looked for.
REASONS = (
    "unreadable wkt", "no habitable room", "too many rooms before decomposition", "no usable edge", "no dominant direction", "room degenerate after snapping to axes", "degenerate re-snapping",
    "room degenerate after re-snapping", "room not axis-aligned", "room over-fragmented", "too many sub-rectangles after decomposition", "outline not simple",
)


class Rejected(Exception):
    """One of ``REASONS``."""


# Polygons


def area(points: np.ndarray) -> float:
    """Signed: positive where the corners run counter-clockwise."""
    q = np.roll(points, -1, axis=0)
    return float((points[:, 0] * q[:, 1] - q[:, 0] * points[:, 1]).sum() / 2)


def is_simple(points: np.ndarray) -> bool:
    """Whether a ring encloses one area: no two edges meet but neighbours in their common corner."""
    p = points[(points != np.roll(points, 1, axis=0)).any(axis=1)]
    n = len(p)
    if n < 3 or abs(area(p)) <= _EPS:
        return False
    q = np.roll(p, -1, axis=0)
    side = lambda a, b, c: np.sign(np.round((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0]), 12))
    i, j = np.triu_indices(n, 1)
    a, b, c, d = p[i], q[i], p[j], q[j]
    crossing = (side(a, b, c) * side(a, b, d) <= 0) & (side(c, d, a) * side(c, d, b) <= 0)
    crossing &= (np.minimum(a, b) <= np.maximum(c, d)).all(axis=1) & (np.minimum(c, d) <= np.maximum(a, b)).all(axis=1)
    after, around = j == i + 1, (i == 0) & (j == n - 1)
    # Neighbours share a corner; they must not lie on each other.
    back = ((b - a) * (d - c)).sum(axis=1) < 0
    folded = (after | around) & (side(a, b, c) == 0) & (side(a, b, d) == 0) & back
    return not (crossing & ~after & ~around).any() and not folded.any()


def turned(points: np.ndarray, degrees: float) -> np.ndarray:
    """About the origin, counter-clockwise."""
    s, c = np.sin(np.radians(degrees)), np.cos(np.radians(degrees))
    return points @ np.array([[c, s], [-s, c]])


def dominant(polygons: list[np.ndarray], period: float = 90.0) -> float:
    """The direction of the edges, weighted by length, as an angle modulo ``period``."""
    edges = np.concatenate([np.roll(p, -1, axis=0) - p for p in polygons] or [np.zeros((0, 2))])
    length = np.hypot(edges[:, 0], edges[:, 1])
    edges, length = edges[length > _EPS], length[length > _EPS]
    if not len(length):
        raise Rejected("no usable edge")
    phase = np.arctan2(edges[:, 1], edges[:, 0]) * (360.0 / period)
    total = complex((length * np.cos(phase)).sum(), (length * np.sin(phase)).sum())
    if abs(total) <= 1e-9 * length.sum():
        raise Rejected("no dominant direction")
    angle = float(np.degrees(np.angle(total)) * (period / 360.0) % period)
    return 0.0 if period - angle < 1e-9 else angle


def straightened(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Edges that are nearly upright or level made exactly so: corner by corner, each takes what its predecessor, already moved, has, and
    the last hands it on to the first, so that the ring closes without a slanted rest."""
    out = points.astype(float).copy()
    for here in range(len(out)):
        nxt = (here + 1) % len(out)
        gap = np.abs(out[nxt] - out[here])
        axis = 0 if gap[0] <= min(tolerance, gap[1]) else 1 if gap[1] <= tolerance else None
        if axis is not None:
            out[nxt, axis] = out[here, axis]
    return out


def stitched(polygons: list[np.ndarray], tolerance: float) -> list[np.ndarray]:
    """Polygons on common lines: coordinates that chains of gaps within the tolerance connect become their distinct values' mean.
    Corners that fall on the one before go; a polygon that keeps fewer than four is a rejection."""
    out = [p.copy() for p in polygons]
    for axis in (0, 1):
        values = np.unique(np.concatenate([p[:, axis] for p in polygons]))
        group = np.concatenate(([0], np.cumsum(np.diff(values) > tolerance)))
        lines = (np.bincount(group, values) / np.bincount(group))[group]
        for p in out:
            p[:, axis] = lines[np.searchsorted(values, p[:, axis])]
    out = [p[(p != np.roll(p, 1, axis=0)).any(axis=1)] for p in out]
    if any(len(p) < 4 for p in out):
        raise Rejected("degenerate re-snapping")
    return out


# Rectilinear rooms and outlines


def pieces(points: np.ndarray, most: int) -> list[tuple[float, float, float, float]]:
    """A rectilinear polygon as rectangles x, y, w, h, cut upright at its inner corners."""
    step = np.roll(points, -1, axis=0) - points
    if ((np.abs(step) > _EPS).sum(axis=1) > 1).any():
        raise Rejected("room not axis-aligned")
    xs, ys = np.unique(points[:, 0]), np.unique(points[:, 1])
    found = decompose(inside_cells(points, xs, ys), xs, ys)
    if len(found) > most:
        raise Rejected("room over-fragmented")
    return found


def filled(rectangles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells that rectangles x, y, w, h cover, and the lines between cells."""
    near, far = rectangles[:, :2], rectangles[:, :2] + rectangles[:, 2:]
    # Lines a rounding apart are one.
    xs, ys = (v[np.concatenate(([True], np.diff(v) > 1e-9))] for v in (np.unique(np.concatenate((near[:, k], far[:, k]))) for k in (0, 1)))
    cells = np.zeros((len(xs) - 1, len(ys) - 1), dtype=bool)
    place = lambda lines, v: np.abs(lines[None] - v[:, None]).argmin(axis=1)
    for a, b, c, d in zip(place(xs, near[:, 0]), place(xs, far[:, 0]), place(ys, near[:, 1]), place(ys, far[:, 1]), strict=True):
        cells[a:b, c:d] = True
    return cells, xs, ys


def rings(cells: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> list[np.ndarray]:
    """The closed outlines of a region of cells, its inside to the left: outer rings run counter-clockwise, holes clockwise.

    Half-edges between a filled and an empty cell are followed from corner to corner. Where two filled cells touch in a corner only the
    left turn is taken, so that the region falls apart there. Corners on straight lines are left out; a ring begins at its lowest corner of
    the leftmost ones, and outer rings come before holes, larger ones first.
    """
    f = np.pad(cells, 1)
    leaving: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for axis, forward, backward in ((0, f[1:-1, 1:] & ~f[1:-1, :-1], ~f[1:-1, 1:] & f[1:-1, :-1]), (1, f[:-1, 1:-1] & ~f[1:, 1:-1], ~f[:-1, 1:-1] & f[1:, 1:-1])):
        step = (1, 0) if axis == 0 else (0, 1)
        for i, j in zip(*np.nonzero(forward), strict=True):  # below a filled cell to the right; right of one upwards
            leaving.setdefault((int(i), int(j)), []).append(step)
        for i, j in zip(*np.nonzero(backward), strict=True):
            leaving.setdefault((int(i) + step[0], int(j) + step[1]), []).append((-step[0], -step[1]))
    out = []
    while leaving:
        start = at = min(leaving)
        heading, ring = (0, 0), []
        while True:
            choices = leaving[at]
            left = (-heading[1], heading[0])
            step = left if left in choices else choices[0]
            choices.remove(step)
            if not choices:
                del leaving[at]
            if step != heading:
                ring.append(at)
            heading, at = step, (at[0] + step[0], at[1] + step[1])
            if at == start and (start not in leaving or not ring or _closes(heading, leaving.get(start, []))):
                break
        out.append(np.array([(xs[i], ys[j]) for i, j in ring]))
    return sorted(out, key=lambda r: (area(r) < 0, -abs(area(r)), r.tolist()))


def _closes(heading: tuple[int, int], choices: list[tuple[int, int]]) -> bool:
    """At a corner where two parts of the region touch: whether the ring ends here, as its left turn was the way it began."""
    return (-heading[1], heading[0]) not in choices


def outline_of(rectangles: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Outer rings and holes of the union of rectangles."""
    found = rings(*filled(rectangles))
    return [r for r in found if area(r) > 0], [r for r in found if area(r) < 0]


# Walls and windows


def on_wall(window: np.ndarray, walls: list[tuple[float, float, float, float, float]]) -> tuple[int, float, float] | None:
    """(wall, place, relative width) of a window on the nearest wall's axis; None where it does not fit onto it."""
    if not walls or (box := least_rectangle(window)) is None:
        return None
    axes = np.array(walls)[:, :4]
    start, along = axes[:, :2], axes[:, 2:] - axes[:, :2]
    length = np.hypot(along[:, 0], along[:, 1])
    centre = centroid(window)
    share = np.clip(((centre - start) * along).sum(axis=1) / np.maximum(length**2, _EPS), 0.0, 1.0)
    far = np.hypot(*(start + share[:, None] * along - centre).T)
    k = int(far.argmin())
    if length[k] <= _EPS:
        return None
    s, width = float(share[k]), float(box[1] / length[k])
    fits = 0.0 < width <= 1.0 and s - width / 2 >= -_EPS and s + width / 2 <= 1.0 + _EPS
    return (k, s, width) if fits else None


# Apartments


@dataclass(frozen=True)
class Apartment:
    """``rooms``: (x, y, w, h, type, source), rectangles of one source being one room. ``openings``: (wall, place, relative width)."""

    rooms: list[tuple[float, float, float, float, str, int]]
    outline: np.ndarray
    walls: list[tuple[float, float, float, float, float]]
    openings: list[tuple[int, float, float]]
    columns: list[tuple[float, float]]
    angle: float


def convert(entities: list[tuple[str, str, np.ndarray | None]], most_rooms: int = 15, most_rectangles: int = 8, snap: float = 0.05, stitch: float = 0.20) -> Apartment:
    """An apartment's plan from (kind, subtype, corners), or ``Rejected`` with the first reason there is; corners None: unreadable."""
    if any(points is None for _, _, points in entities):
        raise Rejected("unreadable wkt")
    open_ = [(kind, sub, p[:-1] if len(p) > 1 and (p[0] == p[-1]).all() else p) for kind, sub, p in entities]
    areas = [(sub, p) for kind, sub, p in open_ if kind == "area"]
    of = lambda name: [p for kind, sub, p in open_ if kind != "area" and sub == name]
    if not areas:
        raise Rejected("no habitable room")
    if len(areas) > most_rooms:
        raise Rejected("too many rooms before decomposition")
    angle = dominant(of("WALL") or [p for _, p in areas])
    level = lambda p: straightened(turned(p, -angle), snap)
    straight = [level(p) for _, p in areas]
    if not all(map(is_simple, straight)):
        raise Rejected("room degenerate after snapping to axes")
    joined = stitched(straight, stitch)
    if not all(map(is_simple, joined)):
        raise Rejected("room degenerate after re-snapping")
    rooms = [(*r, sub.lower(), i) for i, ((sub, _), p) in enumerate(zip(areas, joined, strict=True)) for r in pieces(p, most_rectangles)]
    if len(rooms) > most_rooms:
        raise Rejected("too many sub-rectangles after decomposition")
    outer, holes = outline_of(np.array([r[:4] for r in rooms]))
    if len(outer) != 1 or holes or not is_simple(outer[0]):  # a hole may touch the ring from within
        raise Rejected("outline not simple")
    walls = [w for p in of("WALL") if (w := wall_axis(level(p))) is not None]
    openings = [o for p in of("WINDOW") if (o := on_wall(level(p), walls)) is not None]
    return Apartment(rooms, outer[0], walls, openings, [tuple(centroid(level(p)).tolist()) for p in of("COLUMN")], angle)


def statistics(reasons: Iterator[str | None]) -> tuple[int, int, dict[str, int]]:
    """Read, kept, and rejections by reason."""
    counts: dict[str, int] = {}
    read = kept = 0
    for reason in reasons:
        read, kept = read + 1, kept + (reason is None)
        if reason is not None:
            counts[reason] = counts.get(reason, 0) + 1
    return read, kept, counts
