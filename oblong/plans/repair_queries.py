"""Whole repairs of tilings with one fault each: the cascade, its rungs as runs, touch-ups, residuals, walls, and the optimizer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oblong.functions import scoring
from oblong.operators import repair, together
from oblong.operators.optimizer import AwaySteps, Daylight, Differences, Guarded, PairwiseSteps
from oblong.operators.plans import alike, per_matrix, per_plan
from oblong.plans import derived
from oblong.plans.derived import ROOMS, WALLS
from oblong.plans.plan_queries import BOX, TOGETHER
from oblong.plans.registry import query
from oblong.sources.tables import table

#: One plan an order: columns times rows of rooms, that tile a rectangle but for one fault. 0: none. 1: the first room lacks half a
#: metre. 2: it has half a metre too much. 3: the last room is missing. 4: rooms must be wider than there is space for. 5: a further
#: room lies inside the first one.
FAULTY = """base AS (
  SELECT o_orderkey AS plan_id, o_custkey AS c, CAST(2 + o_orderkey % 3 AS BIGINT) AS nx, CAST(2 + o_custkey % 2 AS BIGINT) AS ny, CAST(o_orderkey % 6 AS BIGINT) AS fault,
         CASE WHEN o_orderkey % 6 = 4 THEN 6.0 ELSE 1.0 END AS least FROM orders
), sizes AS (SELECT *, CAST(3 + plan_id % 3 AS DOUBLE) AS w0, CAST(3 + c % 2 AS DOUBLE) AS h0, CAST(3 + (c + ny - 1) % 2 AS DOUBLE) AS h_last, CAST(3 + (plan_id + nx - 1) % 3 AS DOUBLE) AS w_last FROM base)"""


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan_id, room_id, i, j, x, y, w, h, width, height, least, fault) of the plans above; room_id counts rooms row by row."""
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    plans = table(spark, sf_dir, "orders").select(order, customer, (2 + order % 3).cast("int").alias("nx"), (2 + customer % 2).cast("int").alias("ny"), (order % 6).alias("fault"))
    column = lambda i: (3 + (order + i) % 3).cast("double")
    row = lambda j: (3 + (customer + j) % 2).cast("double")
    upto = lambda n, size: F.aggregate(F.sequence(F.lit(0), n), F.lit(0.0), lambda t, i: t + F.when(i < n, size(i)).otherwise(0.0))
    last = F.col("nx") * F.col("ny") - 1
    ids = F.sequence(F.lit(0), F.when(F.col("fault") == 3, last - 1).when(F.col("fault") == 5, last + 1).otherwise(last))
    rooms = plans.withColumn("k", F.explode(ids)).withColumn("extra", F.col("k") > last).withColumn("i", F.when(F.col("extra"), 0).otherwise(F.col("k") % F.col("nx")).cast("int")).withColumn("j", F.when(F.col("extra"), 0).otherwise(F.floor(F.col("k") / F.col("nx"))).cast("int"))
    first = F.col("k") == 0
    wrong = F.when(first & (F.col("fault") == 1), -0.5).when(first & (F.col("fault") == 2), 0.5).otherwise(0.0)
    inner = F.col("extra")
    return rooms.select(
        order.alias("plan_id"), (F.col("k") + 1).cast("long").alias("room_id"), "i", "j", upto(F.col("i"), column).alias("x"), upto(F.col("j"), row).alias("y"),
        F.when(inner, 1.5).otherwise(column(F.col("i")) + wrong).alias("w"), F.when(inner, 1.5).otherwise(row(F.col("j"))).alias("h"),
        upto(F.col("nx"), column).alias("width"), upto(F.col("ny"), row).alias("height"), F.when(F.col("fault") == 4, 6.0).otherwise(1.0).alias("least"), F.col("fault").cast("double").alias("fault"),
    )


_COLUMNS = ("x", "y", "w", "h", "width", "height", "least", "fault")


def case_of(rows: pd.DataFrame, area: float = 0.0) -> repair.Case:
    first = rows.iloc[0]
    return repair.Case(rows[["x", "y", "w", "h"]].to_numpy(float), repair.rectangle(0.0, 0.0, float(first["width"]), float(first["height"])), float(first["least"]), np.full(len(rows), area))


@query(f"""WITH {FAULTY}
SELECT plan_id, CASE fault WHEN 0 THEN 'plain' WHEN 2 THEN 'plain' WHEN 1 THEN 'tiling' WHEN 3 THEN 'tiling' END AS strategy,
       CASE fault WHEN 4 THEN 'infeasible' WHEN 5 THEN 'grid_not_recoverable' ELSE 'ok' END AS status,
       CASE fault WHEN 0 THEN '' WHEN 2 THEN '' WHEN 4 THEN 'plain:infeasible,tiling:infeasible,fallback:rejected' WHEN 5 THEN 'plain:gap_needs_tiling,tiling:grid_not_recoverable,fallback:rejected' ELSE 'plain:gap_needs_tiling' END AS refusals,
       fault < 4 AS valid, fault = 4 AS infeasibility_proved, CAST(CASE WHEN fault = 0 THEN 0.0 WHEN fault IN (1, 2) THEN 0.5 WHEN fault = 3 THEN h_last END AS DOUBLE) AS total FROM sizes""")
def repair_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rung that gives a proved plan, or the refusals of all; refusals for want of room carry an exactly checked certificate."""

    def run(plan: int, rows: pd.DataFrame) -> list[tuple]:
        o = repair.cascade(case_of(rows))
        said = ",".join(f"{rung}:{status}" for rung, status, _ in o.refusals)
        return [(plan, o.strategy, o.status, said, o.sides is not None and all(o.verdicts.values()), bool(o.proved), None if o.total is None else round(o.total, 6) + 0.0)]

    return per_plan(faulty(spark, sf_dir), run, "plan_id long, strategy string, status string, refusals string, valid boolean, infeasibility_proved boolean, total double", _COLUMNS, period=1)


@query(f"""WITH {FAULTY}
SELECT plan_id, run, CASE WHEN fault = 4 THEN 'infeasible' WHEN fault = 5 THEN CASE run WHEN 'plain' THEN 'gap_needs_tiling' ELSE 'grid_not_recoverable' END WHEN fault IN (1, 3) AND run = 'plain' THEN 'gap_needs_tiling'
            WHEN fault = 3 AND run = 'untouched' THEN 'grid_not_recoverable' ELSE 'ok' END AS status,
       nx * ny + CASE fault WHEN 3 THEN -1 WHEN 5 THEN 1 ELSE 0 END AS rooms FROM sizes, (SELECT unnest(['plain', 'tiling', 'untouched']) AS run)""")
def generated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every plan under every run, a refusal of one leaving the others alone: plain, tiling, and tiling without touch-ups."""

    def run(plan: int, rows: pd.DataFrame) -> list[tuple]:
        case, out = case_of(rows), []
        for name, options in (("plain", {}), ("tiling", {"tiling": True}), ("untouched", {"tiling": True, "repair_budget": 0})):
            try:
                status = repair.legalize(case, **options).status
            except repair.Refusal as refusal:
                status = refusal.status
            out.append((plan, name, status, len(case.rooms)))
        return out

    return per_plan(faulty(spark, sf_dir), run, "plan_id long, run string, status string, rooms long", _COLUMNS, period=1)


@query(f"""WITH {FAULTY}, r AS (SELECT *, unnest(range(nx * ny)) AS k FROM sizes), p AS (SELECT *, k % nx AS i, k // nx AS j FROM r WHERE NOT (fault IN (3, 4) AND k = nx * ny - 1) AND NOT (fault = 4 AND k = nx * ny - 2))
SELECT plan_id, k + 1 AS room_id, i AS "left", i + 1 AS "right", j AS low, j + 1 + CAST(fault IN (3, 4) AND j = ny - 2 AND (i = nx - 1 OR fault = 4 AND i = nx - 2) AS BIGINT) AS high FROM p WHERE fault <> 5""")
def grid_touch_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms as cells of a grid, mended by steps of one line. Under fault 2 the first room covers its neighbour, too; under 3 and 4 one
    and two rooms of the last row are missing; under 5 all of that row are and no step is granted, so nothing comes back."""
    rooms = faulty(spark, sf_dir).where("NOT (fault = 5 AND w = 1.5)").select("plan_id", "room_id", "i", "j", "fault", "width", "height")

    def mend(plan: int, rows: pd.DataFrame) -> list[tuple]:
        i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
        fault, nx, ny = int(rows["fault"].iloc[0]), int(i.max()) + 1, int(j.max()) + 1
        cells = np.stack((i, i + 1, j, j + 1), axis=1)
        ids = rows["room_id"].to_numpy()
        if fault == 2:
            cells[0, 1] += 1
        kept = np.ones(len(cells), dtype=bool)
        if fault == 4:
            kept[nx * ny - 2 :] = False
        if fault == 5:
            kept &= j < ny - 1
        found = repair.touched_up(cells[kept], np.ones((nx, ny), dtype=bool), 0 if fault == 5 else 4)
        return [] if found is None else [(plan, int(r), *map(int, c)) for r, c in zip(ids[kept], found, strict=True)]

    return per_plan(rooms, mend, "plan_id long, room_id long, left long, right long, low long, high long", ("i", "j", "fault"), period=1)


@query(f"""WITH {FAULTY}
SELECT plan_id, CAST(CASE fault WHEN 2 THEN 0.5 * h0 WHEN 5 THEN 2.25 ELSE 0.0 END AS DOUBLE) AS overlap, CAST(CASE fault WHEN 1 THEN 0.5 * h0 WHEN 3 THEN w_last * h_last ELSE 0.0 END AS DOUBLE) AS gap, CAST(0 AS DOUBLE) AS overhang,
       CAST(CASE WHEN fault = 4 THEN 6.0 - 3.0 ELSE 0.0 END AS DOUBLE) AS narrow, fault = 0 AS exact FROM sizes""")
def raw_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the plans as given, exactly: a proof of a snapped plan speaks of the given one only where all are zero."""

    def measure(plan: int, rows: pd.DataFrame) -> list[tuple]:
        found = repair.residuals(case_of(rows))
        return [(plan, *(float(found[k]) for k in ("overlap", "gap", "overhang", "narrow")), not any(found.values()))]

    return per_plan(faulty(spark, sf_dir), measure, "plan_id long, overlap double, gap double, overhang double, narrow double, exact boolean", _COLUMNS, period=1)


@query(f"WITH {FAULTY} SELECT plan_id, fault IN (0, 2) AS plain_again, CAST(0 AS DOUBLE) AS total FROM sizes WHERE fault < 4")
def repair_idempotence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired plans repaired again: nothing moves. ``plain_again``: whether the first repair took no tiling."""

    def again(plan: int, rows: pd.DataFrame) -> list[tuple]:
        case = case_of(rows)
        once = repair.cascade(case)
        if once.sides is None:
            return []
        twice = repair.cascade(repair.Case(once.rooms(), case.outline, case.least_width, case.areas))
        return [(plan, once.strategy == "plain", round(twice.total, 6) + 0.0)]

    return per_plan(faulty(spark, sf_dir), again, "plan_id long, plain_again boolean, total double", _COLUMNS, period=1)


@query(f"""WITH {ROOMS}, {WALLS}, m AS (SELECT plan_id, room_id, x, y, w, h FROM rooms WHERE room_id <= 2), l AS (SELECT *, CASE WHEN horizontal THEN low ELSE place END AS x0, CASE WHEN horizontal THEN high ELSE place END AS x1, CASE WHEN horizontal THEN place ELSE low END AS y0, CASE WHEN horizontal THEN place ELSE high END AS y1 FROM walls WHERE wall_id < 2),
b AS (SELECT m.plan_id, wall_id, room_id, CASE WHEN x0 - 0 >= 1 THEN x + w - x0 ELSE CAST('infinity' AS DOUBLE) END AS by_left, CASE WHEN 24 - x1 >= 1 THEN x1 - x ELSE CAST('infinity' AS DOUBLE) END AS by_right, CASE WHEN y0 - 0 >= 1 THEN y + h - y0 ELSE CAST('infinity' AS DOUBLE) END AS by_below, CASE WHEN 18 - y1 >= 1 THEN y1 - y ELSE CAST('infinity' AS DOUBLE) END AS by_above FROM m JOIN l USING (plan_id)),
o AS (SELECT *, k, CASE WHEN k < 2 THEN by_left ELSE by_right END AS bx, CASE WHEN k % 2 = 0 THEN by_below ELSE by_above END AS by_ FROM b, (SELECT unnest([0, 1, 2, 3]) AS k)),
t AS (SELECT plan_id, wall_id, k, sum(greatest(least(bx, by_), 0)) AS move, sum(least(bx, by_)) AS total FROM o GROUP BY ALL),
c AS (SELECT plan_id, wall_id, k FROM t QUALIFY row_number() OVER (PARTITION BY plan_id, wall_id ORDER BY move, total, k) = 1)
SELECT o.plan_id, o.wall_id, o.room_id, CASE WHEN bx <= by_ THEN CASE WHEN o.k < 2 THEN 'left' ELSE 'right' END ELSE CASE WHEN o.k % 2 = 0 THEN 'below' ELSE 'above' END END AS side FROM o JOIN c ON c.plan_id = o.plan_id AND c.wall_id = o.wall_id AND c.k = o.k""")
def wall_side_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two rooms of each plan as one fused room beside two load-bearing walls: sides without two opposite ones, by least move."""
    walls = derived.walls(spark, sf_dir).where("wall_id < 2")
    packed = walls.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("wall_id", F.col("horizontal").cast("double").alias("flat"), "place", "low", "high"))).alias("walls"))
    pick = lambda k, f: F.col("walls")[k][f].cast("double").alias(f"{f}{k}")
    rooms = derived.rooms(spark, sf_dir).where("room_id <= 2").join(packed, "plan_id").select("plan_id", "room_id", "x", "y", "w", "h", *[pick(k, f) for k in (0, 1) for f in ("flat", "place", "low", "high")])

    names = np.array(repair.SIDES, dtype=object)

    def assign(plans: np.ndarray, ids: np.ndarray, matrix: np.ndarray, ends: np.ndarray) -> tuple:
        sides = np.zeros((2, len(ids)), dtype=int)
        for own, held in alike(matrix, ends):
            at = ends[own][:, None] + np.arange(held.shape[1])
            for k in (0, 1):
                sides[k, at] = repair.compatible_sides_many(held[..., :4], held[:, 0, 4 + 4 * k : 8 + 4 * k], (0.0, 0.0, *BOX), 1.0)
        return np.tile(np.repeat(plans, np.diff(ends)), 2), np.repeat([0, 1], len(ids)), np.tile(ids, 2), names[sides.ravel()]

    return per_matrix(rooms, assign, "plan_id long, wall_id long, room_id long, side string", ("x", "y", "w", "h", *[f"{f}{k}" for k in (0, 1) for f in ("flat", "place", "low", "high")]), many=True)


def _optimised(rows: pd.DataFrame, plan: int, **options: object) -> repair.Outcome | None:
    """A plan with least areas of half of what its rooms have now, improved by daylight; None where it is refused."""
    case = case_of(rows, area=4.0)
    try:
        return repair.legalize(case, tiling=True, scorer=options.pop("scorer", None) or Daylight(float(plan * 7 % 360)), **options)
    except repair.Refusal:
        return None


@query()
def optimizer_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The iterations of each run beside its plan, from one solution: value, gap, step and kind."""

    def trace(plan: int, rows: pd.DataFrame) -> list[tuple]:
        o = _optimised(rows, plan, most=20)
        return [] if o is None else [(plan, o.improvement.status, i.k, i.value, i.gap, i.step, i.kind) for i in o.improvement.trace]

    return per_plan(faulty(spark, sf_dir).where("fault < 4"), trace, "plan_id long, status string, k long, value double, gap double, step double, kind string", _COLUMNS, period=360)


@query(f"WITH {FAULTY} SELECT plan_id, TRUE AS never_falls, TRUE AS gaps_hold, TRUE AS numbered, TRUE AS known_end FROM sizes WHERE fault < 4")
def optimizer_trace_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every trace: values never fall, gaps are never negative, iterations are numbered without holes."""
    traces = optimizer_traces(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct("k", "value")))
    whole = traces.groupBy("plan_id").agg(ordered.alias("t"), F.min("gap").alias("least"), F.max("k").alias("last"), F.count("*").alias("n"), F.first("status").alias("status"))
    falls = F.exists(F.zip_with(F.slice("t", F.lit(2), F.size("t")), F.slice("t", F.lit(1), F.size("t") - 1), lambda b, a: b["value"] < a["value"] - 1e-9), lambda v: v)
    return whole.select("plan_id", (~falls).alias("never_falls"), (F.col("least") >= 0).alias("gaps_hold"), (F.col("n") == F.col("last") + 1).alias("numbered"), F.col("status").isin("converged", "stalled", "limit").alias("known_end"))


class _Misled:
    """A scorer whose gradient points the wrong way."""

    def __init__(self, deg: float):
        self.true = Daylight(deg)

    def value(self, x: np.ndarray) -> float:
        return self.true.value(x)

    def gradient(self, x: np.ndarray) -> np.ndarray:
        return -self.true.gradient(x)


@query(f"WITH {FAULTY} SELECT plan_id, plan_id % 5 < 2 AS refused, TRUE AS stays_if_refused, CAST(CASE WHEN plan_id % 5 < 2 THEN 1 END AS BIGINT) AS first_refusal FROM sizes WHERE fault < 4")
def guarded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose gradients are compared with differences of an independent value; those of two plans in five point the wrong way and
    are refused at once, and the plan stays at the nearest valid one."""

    def run(plan: int, rows: pd.DataFrame) -> list[tuple]:
        deg = float(plan * 7 % 360)
        scorer = Guarded(_Misled(deg) if plan % 5 < 2 else Differences(Daylight(deg).value), Daylight(deg).value, threshold=0.6, h=0.01)
        o = _optimised(rows, plan, scorer=scorer, most=5)
        refused = o.improvement.status == "refused"
        start = repair.legalize(case_of(rows, area=4.0), tiling=True)
        return [(plan, refused, not refused or bool((o.sides == start.sides).all()), len(scorer.history) if refused else None)]

    return per_plan(faulty(spark, sf_dir).where("fault < 4"), run, "plan_id long, refused boolean, stays_if_refused boolean, first_refusal long", _COLUMNS, period=360)


@query(f"WITH {FAULTY} SELECT plan_id, setting, TRUE AS valid, TRUE AS gains, setting IN ('held', 'no budget') AS held FROM sizes, (SELECT unnest(['away', 'plain', 'pairwise', 'penalised', 'held', 'no budget']) AS setting) WHERE fault = 0")
def optimizer_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps, penalties and budgets: all end in proved plans that score no less; a penalty without bounds and a budget of nothing hold the plan."""
    settings = {"away": {}, "plain": {"steps": AwaySteps(False)}, "pairwise": {"steps": PairwiseSteps()}, "penalised": {"penalty": 1.0, "stall": 3}, "held": {"penalty": 1e9}, "no budget": {}}

    def run(plan: int, rows: pd.DataFrame) -> list[tuple]:
        out, scorer = [], Daylight(float(plan * 7 % 360))
        for name, options in settings.items():
            case = case_of(rows, area=4.0)
            if name == "no budget":
                case = repair.Case(case.rooms, case.outline, case.least_width, case.areas, budget=0.0)
            o = repair.legalize(case, tiling=True, scorer=scorer, most=12, **options)
            before = scorer.value(case.rooms.ravel())
            out.append((plan, name, all(o.verdicts.values()), o.improvement.trace[-1].value >= before - 1e-6, o.largest < 1e-6 if name in ("held", "no budget") else False))
        return out

    return per_plan(faulty(spark, sf_dir).where("fault = 0"), run, "plan_id long, setting string, valid boolean, gains boolean, held boolean", _COLUMNS, period=360)


@query()
def infeasible_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans in a box with a budget: which rows stand in the way, whether the certificate holds exactly, and what may be dropped."""

    least_width, least_area, budget = 1.0, 2.0, 1.0

    def alone(plan: int, rooms: np.ndarray) -> tuple:
        case = repair.Case(rooms, repair.rectangle(0.0, 0.0, *BOX), least_width, np.full(len(rooms), least_area), budget=budget)
        try:
            o = repair.legalize(case)
            return plan, o.status, "", None, ""
        except repair.Refusal as refusal:
            return plan, refusal.status, refusal.reason, refusal.proved, ",".join(refusal.relaxable)

    def run(plans: np.ndarray, ids: np.ndarray, matrix: np.ndarray, ends: np.ndarray) -> list[tuple]:
        out = []
        for own, held in alike(matrix, ends):
            most = min(1024, max(1, TOGETHER // held.shape[1] ** 2))
            for k in range(0, len(own), most):
                rooms, keys = held[k : k + most], plans[own[k : k + most]].tolist()
                # Most can be repaired but leave gaps, and are told at once; whatever else there is to say is said one by one.
                gaps = together.only_gaps(rooms, BOX, least_width, least_area, budget)
                out += [(plan, "gap_needs_tiling", "no_gaps", None, "") if gap else alone(plan, r) for plan, gap, r in zip(keys, gaps.tolist(), rooms, strict=True)]
        return out

    return per_matrix(derived.rooms(spark, sf_dir), run, "plan_id long, status string, reason string, proved boolean, relaxable string", many=True, least=60_000)


_STATES = ("initial", "classic", "optimized")


@query()
def three_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each plan as given, repaired and optimized, scored by the model that the optimizer followed and by an independent closed form.

    One run gives the rooms of all three states; both scores are column expressions over them. Plans that cannot be repaired have no
    reference. ``status``: what the reference says about the gain that the model promises from the repaired to the optimized state.
    """

    def states(plan: int, rows: pd.DataFrame) -> list[tuple]:
        case = case_of(rows, area=4.0)
        found = [case.rooms]
        try:
            found.append(repair.legalize(case, tiling=True).rooms())
            found.append(repair.legalize(case, tiling=True, scorer=Daylight(float(plan * 7 % 360)), most=12).rooms())
        except repair.Refusal:
            pass
        return [(plan, state, float(plan * 7 % 360), *map(float, r)) for state, rooms in zip(_STATES, found, strict=False) for r in rooms]

    rooms = per_plan(faulty(spark, sf_dir), states, "plan_id long, state string, deg double, x double, y double, w double, h double", _COLUMNS, period=360)
    sizes = [F.col(c) for c in ("x", "y", "w", "h", "deg")]
    value = lambda score, state: F.sum(F.when(F.col("state") == state, score))
    measured, predicted = scoring.split_flux(*sizes), scoring.analytic(*sizes)
    t = rooms.groupBy("plan_id").agg(*[value(measured, s).alias(f"reference_{s}") for s in _STATES], *[value(predicted, s).alias(f"predicted_{s}") for s in _STATES])
    gain = lambda kind: F.col(f"{kind}_optimized") - F.col(f"{kind}_classic")
    known = F.col("reference_optimized").isNotNull()
    status = F.when(~known, "unmeasured").when(F.abs(gain("predicted")) <= 1e-9, "unchanged").when(gain("reference") > 0, "agrees").otherwise("contradicted")
    return t.select("plan_id", F.when(known, "closed_form").otherwise("unavailable").alias("reference_kind"), *[f"reference_{s}" for s in _STATES], "predicted_initial", gain("predicted").alias("predicted_gain"), gain("reference").alias("reference_gain"), status.alias("status"))


@query(f"WITH {FAULTY} SELECT plan_id, CASE WHEN fault < 4 THEN 'closed_form' ELSE 'unavailable' END AS reference_kind, TRUE AS never_loses, TRUE AS unmoved, fault >= 4 AS unmeasured FROM sizes")
def three_state_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the three states: no promised loss, and a sound plan is the same repaired as given."""
    t = three_states(spark, sf_dir).join(faulty(spark, sf_dir).select("plan_id", "fault").distinct(), "plan_id")
    return t.select("plan_id", "reference_kind", F.coalesce(F.col("predicted_gain") >= -1e-6, F.lit(True)).alias("never_loses"), ((F.col("fault") != 0) | (F.abs(F.col("reference_initial") - F.col("reference_classic")) <= 1e-5)).alias("unmoved"), (F.col("status") == "unmeasured").alias("unmeasured"))
