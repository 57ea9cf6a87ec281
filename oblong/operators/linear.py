"""Linear programs in numpy: a dual simplex method with certificates, and the polytopes of room layouts."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_EPS = 1e-9


@dataclass(frozen=True)
class Solution:
    """``duals``: prices of the rows. ``certificate``: where infeasible, weights y >= 0 of the rows with y A >= 0 and y b < 0."""

    status: str  # optimal, infeasible or limit
    x: np.ndarray | None
    value: float
    duals: np.ndarray | None
    certificate: np.ndarray | None


class Program:
    """min c x for rows a x <= b (or = b) and 0 <= x <= upper, where c >= 0: a dual simplex that goes on where it stopped.

    Bounds are no rows: a variable that would leave at its upper bound is counted from there (``flipped``). The slack of an
    equality is bounded by zero and never comes back. With c >= 0 the slack basis is dual feasible, so no first phase is needed,
    and so is the last basis after rows were added: a cut costs the few pivots that it changes.
    """

    def __init__(self, c: np.ndarray, a: np.ndarray, b: np.ndarray, upper: np.ndarray | None = None, equal: np.ndarray | None = None):
        rows, self.columns = a.shape
        self.table, self.rhs = np.hstack((a, np.eye(rows))).astype(float), b.astype(float).copy()
        self.given = c.astype(float)
        self.cost = np.concatenate((self.given, np.zeros(rows)))
        slack = np.full(rows, np.inf) if equal is None else np.where(equal, 0.0, np.inf)
        self.upper = np.concatenate((np.full(self.columns, np.inf) if upper is None else upper, slack)).astype(float)
        self.flipped = np.zeros(len(self.upper), dtype=bool)
        self.basis = np.arange(self.columns, self.columns + rows)

    def add(self, row: np.ndarray, bound: float, equal: bool = False) -> None:
        """One more row, written in the variables that the present basis leaves free."""
        full = np.concatenate((row, np.zeros(len(self.upper) - self.columns)))
        if self.flipped.any():
            bound -= float(full[self.flipped] @ self.upper[self.flipped])
            full = np.where(self.flipped, -full, full)
        weight = full[self.basis]
        full, bound = full - weight @ self.table, bound - float(weight @ self.rhs)
        self.table = np.vstack((np.hstack((self.table, np.zeros((len(self.table), 1)))), np.append(full, 1.0)))
        self.rhs = np.append(self.rhs, bound)
        self.basis = np.append(self.basis, len(self.upper))
        self.upper = np.append(self.upper, 0.0 if equal else np.inf)
        self.flipped, self.cost = np.append(self.flipped, False), np.append(self.cost, 0.0)

    def _turned(self) -> np.ndarray:
        return np.where(self.flipped[self.columns :], -1.0, 1.0)

    def solve(self, most: int = 5000) -> Solution:
        free = self.upper > 0
        for done in range(most):
            low, over = self.rhs, self.rhs - self.upper[self.basis]
            worst = np.maximum(-low, over)
            if not (worst > _EPS).any():
                x = np.zeros(len(self.upper))
                x[self.basis] = self.rhs
                x = np.where(self.flipped, self.upper - x, x)[: self.columns]
                return Solution("optimal", x, float(self.given @ x), self.cost[self.columns :] * self._turned(), None)
            leaving = int(worst.argmax()) if done < most // 2 else int((worst > _EPS).argmax())  # the lowest index ends cycles
            if over[leaving] > -low[leaving]:
                out = self.basis[leaving]
                self.rhs[leaving] = self.upper[out] - self.rhs[leaving]
                self.table[leaving] *= -1
                self.table[leaving, out] = 1.0
                self.flipped[out] = not self.flipped[out]
            line = self.table[leaving]
            open_ = np.flatnonzero((line < -_EPS) & free)
            if not len(open_):
                return Solution("infeasible", None, np.inf, None, line[self.columns :] * self._turned())
            ratio = self.cost[open_] / -line[open_]
            tied = open_[ratio <= ratio.min() + 1e-12]
            entering = int(tied[line[tied].argmin()] if done < most // 2 else tied[0])
            pivot = line[entering]
            self.table[leaving] /= pivot
            self.rhs[leaving] /= pivot
            factor = self.table[:, entering].copy()
            factor[leaving] = 0.0
            self.table -= factor[:, None] * self.table[leaving]
            self.rhs -= factor * self.rhs[leaving]
            self.cost -= self.cost[entering] * self.table[leaving]
            self.basis[leaving] = entering
        return Solution("limit", None, np.nan, None, None)


def minimise(c: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = 5000) -> Solution:
    """min c x for a x <= b, x >= 0, where c >= 0."""
    return Program(c, a, b).solve(most)


#: A row of a layout: its terms by column, its bound, where it comes from, and whether it is an equality.
Row = tuple[dict[int, float], float, str, bool]


@dataclass
class Layout:
    """a x <= b, a x = b in the rows of ``equal``, and low <= x <= high, with columns x, y, w, h of each room."""

    a: np.ndarray
    b: np.ndarray
    low: np.ndarray
    high: np.ndarray
    origins: list[str]
    equal: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=bool))

    def __post_init__(self) -> None:
        if len(self.equal) < len(self.b):
            self.equal = np.concatenate((self.equal, np.zeros(len(self.b) - len(self.equal), dtype=bool)))

    def extend(self, rows: list[Row]) -> None:
        """Several rows at once: (terms, bound, origin, equal)."""
        if not rows:
            return
        block = np.zeros((len(rows), len(self.low)))
        for i, (terms, *_) in enumerate(rows):
            for k, v in terms.items():
                block[i, k] += v
        self.a, self.b = np.vstack((self.a, block)), np.concatenate((self.b, [r[1] for r in rows]))
        self.equal = np.concatenate((self.equal, np.array([r[3] for r in rows], dtype=bool)))
        self.origins += [r[2] for r in rows]

    def add(self, terms: dict[int, float], bound: float, origin: str, equal: bool = False) -> None:
        self.extend([(terms, bound, origin, equal)])

    def contains(self, x: np.ndarray, slack: float = 1e-6) -> bool:
        rest = self.a @ x - self.b
        return bool((rest <= slack).all() and (rest[self.equal] >= -slack).all() and (x >= self.low - slack).all() and (x <= self.high + slack).all())


def pairwise_edges(rooms: np.ndarray) -> list[tuple[int, int, int]]:
    """(axis, before, after) for each pair: along the wider gap, or the wider centre distance where rooms overlap on both axes."""
    out, rows = [], np.asarray(rooms, dtype=float).tolist()
    for i, (ax, ay, aw, ah) in enumerate(rows):
        for j in range(i + 1, len(rows)):
            bx, by, bw, bh = rows[j]
            gap_x, gap_y = max(bx - ax - aw, ax - bx - bw), max(by - ay - ah, ay - by - bh)
            centre_x, centre_y = bx + bw / 2 - ax - aw / 2, by + bh / 2 - ay - ah / 2
            apart = max(gap_x, gap_y) >= -1e-9
            axis = int(gap_x < gap_y if apart else abs(centre_x) < abs(centre_y))
            out.append((axis, i, j) if (centre_y if axis else centre_x) >= 0 else (axis, j, i))
    return out


def _reached(n: int, edges: list[tuple[int, int, int]]) -> list[list[int]]:
    """The transitive closure (Warshall): for each axis and item the items after it, as bits."""
    after = [[0] * n, [0] * n]
    for axis, a, b in edges:
        after[axis][a] |= 1 << b
    for own in after:
        for k in range(n):
            for a in range(n):
                if own[a] >> k & 1:
                    own[a] |= own[k]
    return after


def reached_pairs(n: int, edges: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(axis, a, b) of the transitive closure, in order."""
    return [(axis, a, b) for axis, own in enumerate(_reached(n, edges)) for a in range(n) for b in range(n) if own[a] >> b & 1]


def closure(n: int, edges: list[tuple[int, int, int]]) -> np.ndarray:
    """reach[axis, a, b] of the transitive closure."""
    reach = np.zeros((2, n, n), dtype=bool)
    for axis, a, b in reached_pairs(n, edges):
        reach[axis, a, b] = True
    return reach


def reduction(n: int, edges: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The edges that no longer path implies."""
    after = _reached(n, edges)
    before = [[0] * n, [0] * n]
    for own, back in zip(after, before, strict=True):
        for a in range(n):
            for b in range(n):
                back[b] |= (own[a] >> b & 1) << a
    return [(axis, a, b) for axis, a, b in edges if not after[axis][a] & before[axis][b]]


def layout(rooms: np.ndarray, box: tuple[float, float], least_width: float) -> Layout:
    """Separation along a relative order and the box (0, 0) to ``box`` for rooms given as rows x, y, w, h."""
    n = len(rooms)
    low = np.tile([0.0, 0.0, least_width, least_width], n)
    high = np.tile([box[0], box[1], box[0], box[1]], n).astype(float)
    edges = reduction(n, pairwise_edges(rooms))
    a = np.zeros((len(edges) + 2 * n, 4 * n))
    for k, (axis, i, j) in enumerate(edges):
        a[k, 4 * i + axis] = a[k, 4 * i + axis + 2] = 1.0
        a[k, 4 * j + axis] = -1.0
    sides = np.arange(2 * n)
    near = sides + sides // 2 * 2  # x and y of each room in turn
    a[len(edges) + sides, near] = a[len(edges) + sides, near + 2] = 1.0
    origins = [f"separation {'xy'[axis]} {i}|{j}" for axis, i, j in edges] + [f"box {'xy'[axis]} {i}" for i in range(n) for axis in (0, 1)]
    return Layout(a, np.concatenate((np.zeros(len(edges)), np.tile(np.array(box, dtype=float), n))), low, high, origins)


class Nearest:
    """The point of a layout with the least L1 distance from a reference: x = start + up - down, where the start is the reference
    brought within the bounds. Cuts may be added and the program solved again from where it stands."""

    def __init__(self, p: Layout, reference: np.ndarray):
        self.p, self.crossed = p, np.flatnonzero(p.low > p.high)
        self.start = np.clip(reference, p.low, p.high)
        self.away = float(np.abs(self.start - reference).sum())
        if not len(self.crossed):
            upper = np.concatenate((p.high - self.start, self.start - p.low))
            self.program = Program(np.ones(2 * len(reference)), np.hstack((p.a, -p.a)), p.b - p.a @ self.start, upper, p.equal)

    def cut(self, terms: dict[int, float], bound: float, origin: str) -> None:
        self.p.add(terms, bound, origin)
        row = self.p.a[-1]
        self.program.add(np.concatenate((row, -row)), bound - float(row @ self.start))

    def solve(self) -> Solution:
        """Its duals are those of the rows; its certificate has weights of the rows, then of the upper and of the lower bounds."""
        n = len(self.start)
        if len(self.crossed):  # an upper bound below the lower one is a proof by itself
            y = np.zeros(len(self.p.b) + 2 * n)
            y[len(self.p.b) + self.crossed[0]] = y[len(self.p.b) + n + self.crossed[0]] = 1.0
            return Solution("infeasible", None, np.inf, None, y)
        s = self.program.solve()
        if s.x is None:
            return s if s.certificate is None else Solution(s.status, None, np.inf, None, np.concatenate((s.certificate, np.zeros(2 * n))))
        return Solution(s.status, self.start + s.x[:n] - s.x[n:], s.value + self.away, s.duals, None)


def nearest(p: Layout, reference: np.ndarray) -> Solution:
    """The point of the layout with the least L1 distance."""
    return Nearest(p, reference).solve()


class Oracle:
    """Minimises one linear cost after another over a layout. Equalities are solved once: what they leave free are a few columns, and
    the bounds of the others become rows, of which equal ones are kept once."""

    def __init__(self, p: Layout):
        e, rest = p.a[p.equal].astype(float), p.b[p.equal].astype(float)
        taken: list[int] = []
        self.feasible, done = True, 0
        for i in range(len(e)):
            pivot = int(np.abs(e[i]).argmax()) if e.shape[1] else 0
            if not e.shape[1] or abs(e[i, pivot]) < 1e-9:
                self.feasible &= abs(rest[i]) < 1e-6
                continue
            rest[i] /= e[i, pivot]
            e[i] /= e[i, pivot]
            factor = e[:, pivot].copy()
            factor[i] = 0.0
            e -= factor[:, None] * e[i]
            rest -= factor * rest[i]
            e[[done, i]], rest[[done, i]] = e[[i, done]], rest[[i, done]]
            taken.append(pivot)
            done += 1
        self.free = np.setdiff1d(np.arange(len(p.low)), taken)
        self.base, self.map = np.zeros(len(p.low)), np.zeros((len(p.low), len(self.free)))
        self.map[self.free, np.arange(len(self.free))] = 1.0
        self.base[taken], self.map[taken] = rest[:done], -e[:done][:, self.free]
        self.low, self.high = p.low[self.free], p.high[self.free]
        loose, own = p.a[~p.equal], np.array(taken, dtype=int)
        rows = np.vstack((loose @ self.map, self.map[own], -self.map[own]))
        bound = np.concatenate((p.b[~p.equal] - loose @ self.base, p.high[own] - self.base[own], self.base[own] - p.low[own]))
        telling = np.abs(rows).max(axis=1, initial=0.0) > 1e-9
        self.feasible &= bool((bound[~telling] >= -1e-6).all())
        best: dict[bytes, int] = {}
        for i in np.flatnonzero(telling).tolist():
            name = (np.round(rows[i], 9) + 0.0).tobytes()
            if name not in best or bound[i] < bound[best[name]]:
                best[name] = i
        kept = sorted(best.values())
        self.rows, self.bound = rows[kept], bound[kept]

    def minimum(self, c: np.ndarray) -> Solution:
        """Columns of negative cost count from their upper bounds."""
        if not self.feasible:
            return Solution("infeasible", None, np.inf, None, None)
        cost = c @ self.map
        sign, start = np.where(cost >= 0, 1.0, -1.0), np.where(cost >= 0, self.low, self.high)
        s = Program(np.abs(cost), self.rows * sign, self.bound - self.rows @ start, self.high - self.low).solve()
        if s.x is None:
            return Solution(s.status, None, s.value, None, None)
        x = self.base + self.map @ (start + sign * s.x)
        return Solution(s.status, x, float(c @ x), None, None)


def linear_oracle(p: Layout, c: np.ndarray) -> Solution:
    """The point of the layout that minimises c x."""
    return Oracle(p).minimum(c)


def area_cut(w: float, h: float, area: float) -> tuple[float, float]:
    """Weights u, v of the tangent u w + v h >= 2 area of the curve w h = area at the point in the direction of (w, h)."""
    t = np.sqrt(area / max(w * h, 1e-12))
    return h * t, w * t


def nearest_with_areas(p: Layout, reference: np.ndarray, areas: np.ndarray, rounds: int = 12, margin: float = 1e-6) -> Solution:
    """``nearest`` with least areas, by tangents that are added where a room is too small; status ``limit`` if some still are after all rounds."""
    program = Nearest(p, reference)
    s = program.solve()
    for _ in range(rounds):
        if s.x is None:
            return s
        w, h = s.x[2::4], s.x[3::4]
        short = np.flatnonzero(w * h < areas - 1e-9)
        if not len(short):
            return s
        for i in short:
            u, v = area_cut(w[i], h[i], areas[i] + margin)
            program.cut({4 * int(i) + 2: -u, 4 * int(i) + 3: -v}, -2 * (areas[i] + margin), f"area {i}")
        s = program.solve()
    if s.x is not None and (s.x[2::4] * s.x[3::4] < areas - 1e-9).any():
        return Solution("limit", None, np.nan, None, None)
    return s


@dataclass
class _Together:
    """Programs of one shape, solved at once by the steps of ``Program.solve``: arrays as there, with the programs on the first axis.

    What is added and multiplied, and in which order, is the same, so results are too.
    """

    table: np.ndarray
    rhs: np.ndarray
    cost: np.ndarray
    upper: np.ndarray
    flipped: np.ndarray
    basis: np.ndarray

    def keep(self, mask: np.ndarray) -> None:
        """Lets the other programs go."""
        for name in ("table", "rhs", "cost", "upper", "flipped", "basis"):
            setattr(self, name, getattr(self, name)[mask])

    def add(self, own: np.ndarray, rows: np.ndarray, bounds: np.ndarray) -> None:
        """One more row for the programs ``own``, as in ``Program.add``, and an empty one for the others."""
        count, m, size = self.table.shape
        full, bound = np.zeros((count, size)), np.zeros(count)
        full[own, : rows.shape[1]], bound[own] = rows, bounds
        bound -= np.multiply(full, self.upper, out=np.zeros(full.shape), where=self.flipped & (full != 0)).sum(axis=1)
        full = np.where(self.flipped, -full, full)
        weight = np.take_along_axis(full, self.basis, axis=1)[own][:, None]
        full[own] -= (weight @ self.table[own])[:, 0]
        bound[own] -= (weight @ self.rhs[own][:, :, None])[:, 0, 0]
        table = np.zeros((count, m + 1, size + 1))
        table[:, :m, :size], table[:, m, :size], table[:, m, size] = self.table, full, 1.0
        last = lambda v, x: np.hstack((v, np.full((count, 1), x, dtype=v.dtype)))
        self.table, self.rhs, self.basis = table, np.hstack((self.rhs, bound[:, None])), last(self.basis, size)
        self.upper, self.flipped, self.cost = last(self.upper, np.inf), last(self.flipped, False), last(self.cost, 0.0)

    def solve(self, most: int = 5000) -> tuple[np.ndarray, np.ndarray]:
        """(status, line) of each: 0 limit, 1 optimal, 2 infeasible, with the row that tells so. The arrays end as ``Program``'s would."""
        names = ("table", "rhs", "cost", "upper", "flipped", "basis")
        held = [getattr(self, name) for name in names]
        status, lines = np.zeros(len(self.rhs), dtype=int), np.zeros(self.upper.shape)
        live = np.arange(len(self.rhs))
        work = [v.copy() for v in held]

        def ended(mask: np.ndarray, code: int) -> None:
            status[live[mask]] = code
            for whole, v in zip(held, work, strict=True):
                whole[live[mask]] = v[mask]

        for done in range(most):
            table, rhs, cost, upper, flipped, basis = work
            over = rhs - np.take_along_axis(upper, basis, axis=1)
            worst = np.maximum(-rhs, over)
            good = ~(worst > _EPS).any(axis=1)
            if good.any():
                ended(good, 1)
                left = ~good
                live, over, worst = live[left], over[left], worst[left]
                work = [v[left] for v in work]
                table, rhs, cost, upper, flipped, basis = work
            if not len(live):
                break
            at = np.arange(len(live))
            leaving = worst.argmax(axis=1) if done < most // 2 else (worst > _EPS).argmax(axis=1)
            turned = np.flatnonzero(over[at, leaving] > -rhs[at, leaving])
            if len(turned):
                row = leaving[turned]
                out = basis[turned, row]
                rhs[turned, row] = upper[turned, out] - rhs[turned, row]
                table[turned, row] *= -1
                table[turned, row, out] = 1.0
                flipped[turned, out] ^= True
            line = table[at, leaving]
            open_ = (line < -_EPS) & (upper > 0)
            stuck = ~open_.any(axis=1)
            if stuck.any():
                lines[live[stuck]] = line[stuck]
                ended(stuck, 2)
                left = ~stuck
                live, line, open_, leaving = live[left], line[left], open_[left], leaving[left]
                work = [v[left] for v in work]
                table, rhs, cost, upper, flipped, basis = work
                if not len(live):
                    break
                at = np.arange(len(live))
            ratio = np.full(line.shape, np.inf)
            np.divide(cost, -line, out=ratio, where=open_)
            tied = ratio <= ratio.min(axis=1)[:, None] + 1e-12
            entering = np.where(tied, line, np.inf).argmin(axis=1) if done < most // 2 else tied.argmax(axis=1)
            pivot = line[at, entering]
            line = line / pivot[:, None]
            table[at, leaving] = line
            rhs[at, leaving] /= pivot
            factor = table[at, :, entering]
            factor[at, leaving] = 0.0
            table -= factor[:, :, None] * line[:, None, :]
            rhs -= factor * rhs[at, leaving][:, None]
            cost -= cost[at, entering][:, None] * line
            basis[at, leaving] = entering
        for whole, v in zip(held, work, strict=True):
            whole[live] = v
        return status, lines


def nearest_many(layouts: list[Layout], references: list[np.ndarray], areas: list[np.ndarray] | None = None, rounds: int = 12, margin: float = 1e-6) -> list[Solution]:
    """``nearest`` of many layouts, or ``nearest_with_areas`` where areas are given; those of about one shape are solved at once.

    Rows that others have more are filled up by empty ones, which never leave the basis.
    """
    out: list[Solution | None] = [None] * len(layouts)
    shapes: dict[tuple[int, int], list[int]] = {}
    for k, p in enumerate(layouts):
        if (p.low > p.high).any() or not p.a.size:
            out[k] = nearest(p, references[k]) if areas is None else nearest_with_areas(p, references[k], areas[k], rounds, margin)
        else:
            shapes.setdefault((p.a.shape[1], -(-len(p.b) // 4)), []).append(k)
    for own in shapes.values():
        for k, s in zip(own, _nearest_alike([layouts[k] for k in own], [references[k] for k in own], None if areas is None else np.stack([areas[k] for k in own]), rounds, margin), strict=True):
            out[k] = s
    return out


def _nearest_alike(layouts: list[Layout], references: list[np.ndarray], areas: np.ndarray | None, rounds: int, margin: float) -> list[Solution]:
    """``nearest_many`` for layouts of equally many rooms."""
    count, n, rows = len(layouts), len(layouts[0].low), max(len(p.b) for p in layouts)
    low, high, given = np.stack([p.low for p in layouts]), np.stack([p.high for p in layouts]), np.stack(references)
    start, size = np.clip(given, low, high), 2 * n + rows
    table, upper, cost, rhs = np.zeros((count, rows, size)), np.full((count, size), np.inf), np.zeros((count, size)), np.zeros((count, rows))
    real = np.zeros((count, rows), dtype=bool)
    for i, p in enumerate(layouts):
        m = len(p.b)
        table[i, :m, :n], table[i, :m, n : 2 * n] = p.a, -p.a
        rhs[i, :m], real[i, :m] = p.b - p.a @ start[i], True
        upper[i, 2 * n : size - rows + m][p.equal] = 0.0
    table[:, np.arange(rows), 2 * n + np.arange(rows)] = 1.0
    upper[:, :n], upper[:, n : 2 * n], cost[:, : 2 * n] = high - start, start - low, 1.0
    all_ = _Together(table, rhs, cost, upper, np.zeros(upper.shape, dtype=bool), np.tile(np.arange(2 * n, size), (count, 1)))
    away, ones, live = np.abs(start - given).sum(axis=1), np.ones(2 * n), np.arange(count)
    out: list[Solution | None] = [None] * count
    cuts: list[list[Row]] = [[] for _ in layouts]
    for done in range(rounds + 1):
        status, lines = all_.solve()
        x = np.zeros(all_.upper.shape)
        np.put_along_axis(x, all_.basis, all_.rhs, axis=1)
        x = np.where(all_.flipped, all_.upper - x, x)[:, : 2 * n]
        at = start[live] + x[:, :n] - x[:, n:]
        small = np.zeros((len(live), n // 4), dtype=bool) if areas is None else (status == 1)[:, None] & (at[:, 2::4] * at[:, 3::4] < areas[live] - 1e-9)
        again = small.any(axis=1)
        sign = np.where(all_.flipped[:, 2 * n :], -1.0, 1.0)
        for i in np.flatnonzero(~again).tolist():
            k = live[i]
            if status[i] == 1:
                out[k] = Solution("optimal", at[i], float(ones @ x[i]) + float(away[k]), (all_.cost[i, 2 * n :] * sign[i])[real[i]], None)
            elif status[i] == 2:
                out[k] = Solution("infeasible", None, np.inf, None, np.concatenate(((lines[i, 2 * n :] * sign[i])[real[i]], np.zeros(2 * n))))
        live, at, small, real = live[again], at[again], small[again], real[again]
        if done == rounds or not len(live):
            break
        all_.keep(again)
        while small.any():
            own, room = np.flatnonzero(small.any(axis=1)), small.argmax(axis=1)
            new, bound = np.zeros((len(own), 2 * n)), np.zeros(len(own))
            for j, i in enumerate(own.tolist()):
                k, r = live[i], int(room[i])
                u, v = area_cut(at[i, 4 * r + 2], at[i, 4 * r + 3], areas[k, r] + margin)
                new[j, 4 * r + 2], new[j, 4 * r + 3] = -u, -v
                least = -2 * (areas[k, r] + margin)
                cuts[k].append(({4 * r + 2: -u, 4 * r + 3: -v}, least, f"area {r}", False))
                bound[j] = least - float(new[j, :n] @ start[k])
            new[:, n:] = -new[:, :n]
            all_.add(own, new, bound)
            added = np.zeros((len(live), 1), dtype=bool)
            added[own] = True
            real = np.hstack((real, added))
            small[own, room[own]] = False
    for p, more in zip(layouts, cuts, strict=True):
        p.extend(more)
    return [Solution("limit", None, np.nan, None, None) if s is None else s for s in out]


def integers(*groups: np.ndarray) -> tuple[int, list[list[int]]]:
    """(d, integers): doubles exactly, as integers over one power of two."""
    ratios = [[float(v).as_integer_ratio() for v in group] for group in groups]
    d = max((q for group in ratios for _, q in group), default=1)
    return d, [[p * (d // q) for p, q in group] for group in ratios]


def proves_infeasible(p: Layout, y: np.ndarray) -> bool:
    """Whether weights of the rows, upper and lower bounds add up to 0 x <= something negative, in rational arithmetic.

    Weights of equalities may be negative. What rounding leaves in a column is paid for by its bounds, so that the check is exact.
    """
    rows, n = p.a.shape
    either = np.concatenate((p.equal, np.zeros(2 * n, dtype=bool)))
    _, (weights,) = integers(np.where(either, y, np.maximum(y, 0.0)).tolist())
    d, (bounds, low, high) = integers(np.concatenate((p.b, p.high, -p.low)).tolist(), p.low.tolist(), p.high.tolist())
    at, where = np.nonzero(p.a)
    c, (terms,) = integers(p.a[at, where].tolist())
    columns = [c * (weights[rows + k] - weights[rows + n + k]) for k in range(n)]
    for i, k, v in zip(at.tolist(), where.tolist(), terms, strict=True):
        columns[k] += weights[i] * v
    total = c * sum(w * b for w, b in zip(weights, bounds, strict=True))
    return total - sum(min(v * low[k], v * high[k]) for k, v in enumerate(columns)) < 0


def snapped(x: np.ndarray, grid: float = 2.0**-24) -> np.ndarray:
    """Rooms whose sides are moved to a fine binary grid, so that sides that should meet do.

    The grid is far coarser than the error of a solution, and so fine that areas stay within the margin of ``nearest_with_areas``.
    """
    r = x.reshape(-1, 4)
    near = np.round(r[:, :2] / grid) * grid
    far = np.round((r[:, :2] + r[:, 2:]) / grid) * grid
    return np.hstack((near, far - near))


def proof(rooms: np.ndarray, box: tuple[float, float], least_width: float, areas: np.ndarray) -> dict[str, bool]:
    """Exact verdicts on rooms: inside the box, disjoint, wide enough, large enough. Doubles count as the rationals they are."""
    d, (flat, (right, top, least)) = integers(np.asarray(rooms, dtype=float).ravel().tolist(), (*box, least_width))
    q = [flat[k : k + 4] for k in range(0, len(flat), 4)]
    inside = all(r[0] >= 0 and r[1] >= 0 and r[0] + r[2] <= right and r[1] + r[3] <= top for r in q)
    slack = 10**6  # a millionth
    wide = all(slack * min(r[2], r[3]) >= slack * least - d for r in q)
    scale, (given,) = integers(np.asarray(areas, dtype=float).tolist())
    large = all(slack * scale * r[2] * r[3] >= (slack * a - scale) * d * d for r, a in zip(q, given, strict=True))
    return {"inside": inside, "disjoint": disjoint_rooms(q), "wide": wide, "large": large}


def disjoint_rooms(q: list[list[int]]) -> bool:
    """Whether no two rooms x, y, w, h, given as integers over one denominator, share more than their sides."""
    sides = [(x, y, x + w, y + h) for x, y, w, h in q]
    return all(a[2] <= b[0] or b[2] <= a[0] or a[3] <= b[1] or b[3] <= a[1] for i, a in enumerate(sides) for b in sides[i + 1 :])


def whole_proof(rooms: np.ndarray, before: np.ndarray, outline: tuple[float, float, float, float], walls: list[tuple[bool, float, float, float]], budget: float) -> dict[str, bool]:
    """Exact verdicts beyond ``proof``: no gaps and no overhang in a rectangular outline, no load-bearing wall (horizontal, place, low, high)
    inside a room, no side moved further than the budget."""
    # All but the moves only compares doubles, which is exact.
    q = [(x, y, x + w, y + h) for x, y, w, h in np.asarray(rooms, dtype=float).tolist()]
    x0, y0, x1, y1 = map(float, outline)
    xs, ys = (sorted({a, b, *(v for r in q for v in (r[k], r[k + 2]) if a < v < b)}) for k, a, b in ((0, x0, x1), (1, y0, y1)))
    covered = all(any(r[0] <= a and r[2] >= b and r[1] <= c and r[3] >= d for r in q) for a, b in zip(xs, xs[1:], strict=False) for c, d in zip(ys, ys[1:], strict=False))
    held = all(r[0] >= x0 and r[1] >= y0 and r[2] <= x1 and r[3] <= y1 for r in q)

    def crossed(r, wall) -> bool:
        along, across = (0, 1) if wall[0] else (1, 0)
        place, low, high = map(float, wall[1:])
        return r[across] < place < r[across + 2] and low < r[along + 2] and high > r[along]

    clear = not any(crossed(r, w) for r in q for w in walls)
    _, (after, given, (most,)) = integers(np.ravel(rooms).tolist(), np.ravel(before).tolist(), (budget,))
    return {"no_gaps": covered, "no_overhang": held, "walls_clear": clear, "within_budget": max((abs(a - b) for a, b in zip(after, given, strict=True)), default=0) <= most}


def daylight_value(x: np.ndarray, deg: float) -> float:
    """The analytic daylight score of rooms."""
    return float(_daylight(x, deg)[0].sum())


def daylights(rooms: np.ndarray, deg: np.ndarray) -> np.ndarray:
    """The analytic daylight scores of many plans of equally many rooms: ``rooms`` by plan, room and x, y, w, h; ``deg`` by plan."""
    from oblong.functions.scoring import DEPTH_FACTOR, EXPOSURE, HEAD_HEIGHT, SOUTHWARD

    s, c = np.sin(np.radians(deg))[:, None], np.cos(np.radians(deg))[:, None]
    px, py, w, h = np.moveaxis(rooms, -1, 0)
    facade, depth = w * c * c + h * s * s, w * s * s + h * c * c
    sector = ((np.asarray(deg) + 22.5) % 360 // 45).astype(int) % 8
    limit = DEPTH_FACTOR * HEAD_HEIGHT * np.array([EXPOSURE[k] for k in range(8)])[sector][:, None]
    return (facade * np.where(depth <= limit, depth, limit) * np.exp(SOUTHWARD * (-px * s - py * c))).sum(axis=1)


def daylight(x: np.ndarray, deg: float) -> tuple[float, np.ndarray]:
    """The analytic daylight score of rooms and its gradient (the left one where the lit depth has its kink)."""
    from oblong.functions.scoring import SOUTHWARD

    value, facade, lit, pull, shallow, s, c = _daylight(x, deg)
    slope = np.stack((-SOUTHWARD * s * value, -SOUTHWARD * c * value, pull * (c * c * lit + facade * shallow * s * s), pull * (s * s * lit + facade * shallow * c * c)), axis=1)
    return float(value.sum()), slope.ravel()


def _daylight(x: np.ndarray, deg: float) -> tuple:
    """Each room's score, facade, lit depth and preference, whether it is lit throughout, and the azimuth's sine and cosine."""
    from oblong.functions.scoring import DEPTH_FACTOR, EXPOSURE, HEAD_HEIGHT, SOUTHWARD

    s, c = np.sin(np.radians(deg)), np.cos(np.radians(deg))
    px, py, w, h = x.reshape(-1, 4).T
    facade, depth = w * c * c + h * s * s, w * s * s + h * c * c
    limit = DEPTH_FACTOR * HEAD_HEIGHT * EXPOSURE[int(((deg + 22.5) % 360) // 45) % 8]
    shallow = depth <= limit
    lit = np.where(shallow, depth, limit)
    pull = np.exp(SOUTHWARD * (-px * s - py * c))
    return facade * lit * pull, facade, lit, pull, shallow, s, c


def frank_wolfe(p: Layout, start: np.ndarray, deg: float, radius: float, most: int = 40, gap_limit: float = 1e-4) -> tuple[np.ndarray, list[tuple[float, float, float]], str]:
    """Raises the daylight score inside the layout and a box around the start; conditional gradients with away steps.

    Returns the point, (value, gap, step) of each iteration and why it ended.
    """
    box = Layout(p.a, p.b, np.maximum(p.low, start - radius), np.minimum(p.high, start + radius), p.origins, p.equal)
    box.low, box.high = np.minimum(box.low, start), np.maximum(box.high, start)
    oracle = Oracle(box)
    x, atoms, weights, trace = start.copy(), [start.copy()], [1.0], []
    for _ in range(most):
        value, slope = daylight(x, deg)
        s = oracle.minimum(-slope)
        if s.x is None:
            return x, trace, s.status
        gap = float(slope @ (s.x - x))
        if gap <= gap_limit:
            trace.append((value, gap, 0.0))
            return x, trace, "converged"
        worst = min(range(len(atoms)), key=lambda k: slope @ atoms[k])
        away = weights[worst] < 1.0 and slope @ (x - atoms[worst]) > gap
        move, longest = (x - atoms[worst], weights[worst] / (1 - weights[worst])) if away else (s.x - x, 1.0)
        step, rise = min(longest, 1.0) if not away else longest, float(slope @ move)
        while step > 1e-10 and daylight_value(x + step * move, deg) < value + 1e-4 * step * rise:
            step /= 2
        if step <= 1e-10:
            trace.append((value, gap, 0.0))
            return x, trace, "stalled"
        if away:
            weights = [v * (1 + step) for v in weights]
            weights[worst] -= step
        else:
            weights = [v * (1 - step) for v in weights] + [step]
            atoms.append(s.x)
        kept = [k for k, v in enumerate(weights) if v > 1e-12]
        atoms, weights = [atoms[k] for k in kept], [weights[k] for k in kept]
        x = x + step * move
        trace.append((value, gap, step))
    return x, trace, "limit"


def components(n: int, links: list[tuple[int, int]]) -> list[int]:
    """The smallest member of each item's component."""
    own = list(range(n))

    def root(i: int) -> int:
        while own[i] != i:
            own[i] = own[own[i]]
            i = own[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        own[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def naive_repair(rooms: np.ndarray, box: tuple[float, float], step: float = 1.0) -> np.ndarray:
    """Rooms in turn, each moved to the nearest free place of a grid; a room that fits nowhere stays."""
    placed: list[list[float]] = []
    for x, y, w, h in np.asarray(rooms, dtype=float).tolist():
        xs, ys = np.arange(0, box[0] - w + 1e-9, step), np.arange(0, box[1] - h + 1e-9, step)
        gaps = np.abs(xs - x)[:, None] + np.abs(ys - y)[None]
        for qx, qy, qw, qh in placed:
            beside, above = (xs + w <= qx) | (qx + qw <= xs), (ys + h <= qy) | (qy + qh <= ys)
            gaps[~beside[:, None] & ~above[None]] = np.inf
        spot = int(gaps.argmin()) if gaps.size else 0
        if gaps.size and gaps.flat[spot] < np.inf:
            x, y = float(xs[spot // len(ys)]), float(ys[spot % len(ys)])
        placed.append([x, y, w, h])
    return np.array(placed)


def decompose(cells: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Rectangles of a rectilinear region given by the filled cells of a grid: vertical strips, joined while they are alike."""
    out: list[tuple[float, float, float, float]] = []
    open_: dict[tuple[int, int], int] = {}
    columns, xs, ys = np.asarray(cells, dtype=bool).tolist(), np.asarray(xs, dtype=float).tolist(), np.asarray(ys, dtype=float).tolist()
    for i in range(len(xs)):
        runs, start = set(), None
        for j, full in enumerate([*(columns[i] if i < len(columns) else ()), False]):
            if full and start is None:
                start = j
            elif not full and start is not None:
                runs.add((start, j))
                start = None
        for run in [r for r in open_ if r not in runs]:
            a = open_.pop(run)
            out.append((xs[a], ys[run[0]], xs[i] - xs[a], ys[run[1]] - ys[run[0]]))
        for run in runs:
            open_.setdefault(run, i)
    return sorted(out)
