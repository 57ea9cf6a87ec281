"""Layouts of many plans of equally many rooms as arrays with the plans on the first axis: built, repaired and improved at once.

Each function does what its namesake in ``linear`` does for one plan, by the same steps. Rows that other plans have more of are
filled up by empty ones, which never leave the basis.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np

from oblong.functions.scoring import DEPTH_FACTOR, EXPOSURE, HEAD_HEIGHT, SOUTHWARD
from oblong.operators.linear import _Together

#: A program's status as ``_Together.solve`` tells it.
STATUSES = np.array(["limit", "optimal", "infeasible"])


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, None, :] @ b[:, :, None])[:, 0, 0]


def _times(a: np.ndarray, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """a x by plan, of its first ``rows`` only: a library may add up in another order where there are more."""
    out = np.zeros(a.shape[:2])
    for i, k in enumerate(rows.tolist()):
        out[i, :k] = a[i, :k] @ x[i]
    return out


def layouts(rooms: np.ndarray, box: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows a x <= b of ``linear.layout`` for rooms by plan, room and x, y, w, h, and how many of them are not empty."""
    count, n, _ = rooms.shape
    i, j = np.triu_indices(n, 1)
    (ax, ay, aw, ah), (bx, by, bw, bh) = np.moveaxis(rooms[:, i], -1, 0), np.moveaxis(rooms[:, j], -1, 0)
    gap_x, gap_y = np.maximum(bx - ax - aw, ax - bx - bw), np.maximum(by - ay - ah, ay - by - bh)
    centre_x, centre_y = bx + bw / 2 - ax - aw / 2, by + bh / 2 - ay - ah / 2
    axis = np.where(np.maximum(gap_x, gap_y) >= -1e-9, gap_x < gap_y, np.abs(centre_x) < np.abs(centre_y)).astype(int)
    ahead = np.where(axis == 1, centre_y, centre_x) >= 0
    src, dst = np.where(ahead, i, j), np.where(ahead, j, i)
    reach, plan = np.zeros((count, 2, n, n), dtype=bool), np.arange(count)[:, None]
    reach[plan, axis, src, dst] = True
    for k in range(n):
        reach |= reach[:, :, :, k, None] & reach[:, :, None, k, :]
    longer = reach.astype(np.float32)
    kept = ~(longer @ longer > 0)[plan, axis, src, dst]
    edges = kept.sum(axis=1)
    own, edge = np.nonzero(kept)
    at = (np.cumsum(kept, axis=1) - 1)[own, edge]
    axis, src, dst = axis[own, edge], src[own, edge], dst[own, edge]
    most = int(edges.max(initial=0)) + 2 * n
    a, b = np.zeros((count, most, 4 * n)), np.zeros((count, most))
    a[own, at, 4 * src + axis] = a[own, at, 4 * src + axis + 2] = 1.0
    a[own, at, 4 * dst + axis] = -1.0
    sides = np.arange(2 * n)
    near, row = sides + sides // 2 * 2, edges[:, None] + sides
    a[plan, row, near] = a[plan, row, near + 2] = 1.0
    b[plan, row] = np.tile(np.array(box, dtype=float), n)
    return a, b, edges + 2 * n


def nearest_with_areas(a: np.ndarray, b: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, given: np.ndarray, areas: np.ndarray, rounds: int = 12, margin: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(status, points); only those points count whose status is ``optimal``. No lower bound is above its upper one."""
    (count, most, n), start = a.shape, np.clip(given, low, high)
    table = np.concatenate((a, -a, np.broadcast_to(np.eye(most), (count, most, most))), axis=2)
    upper = np.hstack((high - start, start - low, np.full((count, most), np.inf)))
    cost = np.tile(np.concatenate((np.ones(2 * n), np.zeros(most))), (count, 1))
    all_ = _Together(table, b - _times(a, start, rows), cost, upper, np.zeros(upper.shape, dtype=bool), np.tile(np.arange(2 * n, 2 * n + most), (count, 1)))
    status, points, live = np.full(count, "limit", dtype="<U10"), start.copy(), np.arange(count)
    for done in range(rounds + 1):
        told, _ = all_.solve()
        x = _values(all_)[:, : 2 * n]
        at = start[live] + x[:, :n] - x[:, n:]
        small = (told == 1)[:, None] & (at[:, 2::4] * at[:, 3::4] < areas[live] - 1e-9)
        again = small.any(axis=1)
        status[live[~again]], points[live[~again]] = STATUSES[told[~again]], at[~again]
        live, at, small = live[again], at[again], small[again]
        if done == rounds or not len(live):
            break
        all_.keep(again)
        while small.any():
            own, room = np.flatnonzero(small.any(axis=1)), small.argmax(axis=1)
            room = room[own]
            k, w, h, least = live[own], at[own, 4 * room + 2], at[own, 4 * room + 3], areas[live[own], room] + margin
            t = np.sqrt(least / np.maximum(w * h, 1e-12))
            new = np.zeros((len(own), 2 * n))
            new[np.arange(len(own)), 4 * room + 2], new[np.arange(len(own)), 4 * room + 3] = -h * t, -w * t
            bound = -2 * least - _dot(new[:, :n], start[k])
            new[:, n:] = -new[:, :n]
            all_.add(own, new, bound)
            small[own, room] = False
    return status, points


def _values(all_: _Together) -> np.ndarray:
    x = np.zeros(all_.upper.shape)
    np.put_along_axis(x, all_.basis, all_.rhs, axis=1)
    return np.where(all_.flipped, all_.upper - x, x)


def minimum(a: np.ndarray, b: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(status, points) that minimise c x; columns of negative cost count from their upper bounds, as in ``linear.Oracle``."""
    count, most, n = a.shape
    sign, start = np.where(c >= 0, 1.0, -1.0), np.where(c >= 0, low, high)
    table = np.concatenate((a * sign[:, None, :], np.broadcast_to(np.eye(most), (count, most, most))), axis=2)
    upper, cost = np.hstack((high - low, np.full((count, most), np.inf))), np.hstack((np.abs(c), np.zeros((count, most))))
    all_ = _Together(table, b - _times(a, start, rows), cost, upper, np.zeros(upper.shape, dtype=bool), np.tile(np.arange(n, n + most), (count, 1)))
    told, _ = all_.solve()
    return told, start + sign * _values(all_)[:, :n]


def contains(a: np.ndarray, b: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray, slack: float = 1e-6) -> np.ndarray:
    """Whether each point is within its layout."""
    return (_times(a, x, rows) - b <= slack).all(axis=1) & (x >= low - slack).all(axis=1) & (x <= high + slack).all(axis=1)


def proved(rooms: np.ndarray, box: tuple[float, float], least_width: float, least_area: float) -> np.ndarray:
    """Whether all of ``linear.proof`` holds, for plans of ``linear.snapped`` rooms, whose sides are integers over 2^24 below 2^7.

    They are compared as such, so verdicts are exact; thresholds are rounded up to the next integer.
    """
    d, slack = 2**24, 10**6
    q = (rooms * d).astype(np.int64)
    (x, y, w, h), n = np.moveaxis(q, -1, 0), rooms.shape[1]
    right, top = x + w, y + h
    most = [math.floor(Fraction(v) * d) for v in box]
    inside = ((x >= 0) & (y >= 0) & (right <= most[0]) & (top <= most[1])).all(axis=1)
    wide = (np.minimum(w, h) >= math.ceil((Fraction(least_width) - Fraction(1, slack)) * d)).all(axis=1)
    large = (w * h >= math.ceil((Fraction(least_area) - Fraction(1, slack)) * d * d)).all(axis=1)
    i, j = np.triu_indices(n, 1)
    apart = (right[:, i] <= x[:, j]) | (right[:, j] <= x[:, i]) | (top[:, i] <= y[:, j]) | (top[:, j] <= y[:, i])
    return inside & wide & large & apart.all(axis=1)


def only_gaps(rooms: np.ndarray, box: tuple[float, float], least_width: float, least_area: float, budget: float) -> np.ndarray:
    """Whether ``repair.legalize`` would refuse a plan for gaps and for nothing else, exactly proved; what is not sure counts as no.

    Repaired rooms that neither overlap nor leave the box cover it if, and only if, their areas add up to that of the box.
    """
    count, n, _ = rooms.shape
    given = rooms.reshape(count, -1)
    low = np.maximum(np.tile([0.0, 0.0, least_width, least_width], n), given - budget)
    high = np.minimum(np.tile([*box, *box], n), given + budget)
    out, bounded = np.zeros(count, dtype=bool), np.flatnonzero(np.isfinite(given).all(axis=1) & (low <= high).all(axis=1) & (rooms[:, :, 2:] > 0).all(axis=(1, 2)))
    if not len(bounded) or max(box) >= 128:
        return out
    rooms, given, low, high = rooms[bounded], given[bounded], low[bounded], high[bounded]
    a, b, rows = layouts(rooms, box)
    status, points = nearest_with_areas(a, b, rows, low, high, given, np.full((len(rooms), n), least_area))
    x, y, w, h = np.moveaxis(points.reshape(-1, n, 4), -1, 0)
    sides = np.stack((x, x + w, y, y + h), axis=2)  # as in repair.exact_sides
    exact = np.round(sides * 2**24) / 2**24
    for axis in (0, 1):
        for value in (0.0, box[axis]):
            own = slice(2 * axis, 2 * axis + 2)
            exact[:, :, own] = np.where(np.abs(sides[:, :, own] - value) <= 1e-6, value, exact[:, :, own])
    left, right, bottom, top = np.moveaxis(exact, -1, 0)
    after = np.stack((left, bottom, right - left, top - bottom), axis=2)
    near = np.abs(after - rooms).max(axis=(1, 2)) <= budget + 9e-7  # of a millionth that is allowed
    cells = (after[:, :, 2:] * 2**24).astype(np.int64).prod(axis=2)
    # Sums that doubles tell apart by far: rooms of a sure gap lack more than rounding takes.
    short = (cells / 2.0**48).sum(axis=1) < box[0] * box[1] - 1e-6
    out[bounded] = (status == "optimal") & proved(after, box, least_width, least_area) & near & short
    return out


def daylight(x: np.ndarray, deg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The analytic daylight scores of plans and their gradients, by plan and column."""
    value, facade, lit, pull, shallow, s, c = _daylight(x, deg)
    slope = np.stack((-SOUTHWARD * s * value, -SOUTHWARD * c * value, pull * (c * c * lit + facade * shallow * s * s), pull * (s * s * lit + facade * shallow * c * c)), axis=2)
    return value.sum(axis=1), slope.reshape(len(x), -1)


def _daylight(x: np.ndarray, deg: np.ndarray) -> tuple:
    s, c = np.sin(np.radians(deg))[:, None], np.cos(np.radians(deg))[:, None]
    px, py, w, h = np.moveaxis(x.reshape(len(x), -1, 4), -1, 0)
    facade, depth = w * c * c + h * s * s, w * s * s + h * c * c
    limit = (DEPTH_FACTOR * HEAD_HEIGHT * np.array(EXPOSURE)[((deg + 22.5) % 360 // 45).astype(int) % 8])[:, None]
    shallow = depth <= limit
    lit, pull = np.where(shallow, depth, limit), np.exp(SOUTHWARD * (-px * s - py * c))
    return facade * lit * pull, facade, lit, pull, shallow, s, c


def frank_wolfe(a: np.ndarray, b: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, deg: np.ndarray, radius: np.ndarray, most: int = 40, gap_limit: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(points, values, gaps, iterations, status): ``values`` and ``gaps`` of each iteration by plan, nan after the last.

    An atom's place is the iteration that found it; one without weight is gone. Plans that have ended are worked on no more.
    """
    count = len(start)
    low, high = np.minimum(np.maximum(low, start - radius[:, None]), start), np.maximum(np.minimum(high, start + radius[:, None]), start)
    points, values, gaps = start.copy(), np.full((count, most), np.nan), np.full((count, most), np.nan)
    iterations, status = np.zeros(count, dtype=int), np.full(count, "limit", dtype="<U10")
    live, x, atoms, weights = np.arange(count), start.copy(), start[:, None], np.ones((count, 1))

    for k in range(most):
        value, slope = daylight(x, deg)
        told, vertex = minimum(a, b, rows, low, high, -slope)
        gap = _dot(slope, vertex - x)
        failed = told != 1
        done = ~failed & (gap <= gap_limit)
        values[live[~failed], k], gaps[live[~failed], k] = value[~failed], gap[~failed]
        iterations[live[~failed]] = k + 1
        status[live[failed]], status[live[done]] = STATUSES[told[failed]], "converged"
        points[live] = x
        go = ~failed & ~done
        live, x, atoms, weights, value, slope, vertex, gap, a, b, rows, low, high, deg = (v[go] for v in (live, x, atoms, weights, value, slope, vertex, gap, a, b, rows, low, high, deg))
        if not len(live):
            break
        at = np.arange(len(live))
        worst = np.where(weights > 0, (atoms[:, :, None, :] @ slope[:, None, :, None])[:, :, 0, 0], np.inf).argmin(axis=1)
        weight, off = weights[at, worst], x - atoms[at, worst]
        away = (weight < 1.0) & (_dot(slope, off) > gap)
        move = np.where(away[:, None], off, vertex - x)
        step = np.where(away, weight / np.where(away, 1 - weight, 1.0), 1.0)
        rise = _dot(slope, move)
        open_, tries = np.flatnonzero(step > 1e-10), 1
        while len(open_):
            # Few are halved often: several steps are tried at once, of which the first good one counts.
            short = step[open_][:, None] * 0.5 ** np.arange(tries)
            reached = _daylight((x[open_][:, None] + short[:, :, None] * move[open_][:, None]).reshape(-1, x.shape[1]), np.repeat(deg[open_], tries))[0].sum(axis=1).reshape(-1, tries)
            ends = (short <= 1e-10) | (reached >= value[open_][:, None] + 1e-4 * short * rise[open_][:, None])
            ended, first = ends.any(axis=1), ends.argmax(axis=1)
            step[open_] = np.where(ended, short[np.arange(len(open_)), first], short[:, -1] / 2)
            open_, tries = open_[~ended], 12
        weights = np.where(away[:, None], weights * (1 + step[:, None]), weights * (1 - step[:, None]))
        weights[at[away], worst[away]] -= step[away]
        weights = np.hstack((weights, np.where(away, 0.0, step)[:, None]))
        weights[weights <= 1e-12] = 0.0
        atoms = np.concatenate((atoms, vertex[:, None]), axis=1)
        go = step > 1e-10
        status[live[~go]] = "stalled"
        x = x + step[:, None] * move
        live, x, atoms, weights, a, b, rows, low, high, deg = (v[go] for v in (live, x, atoms, weights, a, b, rows, low, high, deg))
        points[live] = x
        if not len(live):
            break
    return points, values, gaps, iterations, status
