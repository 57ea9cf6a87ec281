"""Users' own checks, scorers, constraints, strategies, policies and steps; whole repairs with their reports; paired bootstraps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oblong.operators import distributions, extension, linear
from oblong.operators.plans import per_matrix
from oblong.plans import derived
from oblong.plans.derived import MEASURES, ROOMS, RUNS
from oblong.plans.plan_queries import BOX, LEAST_WIDTH, repaired
from oblong.plans.registry import query, rounded


@query(f"""WITH {ROOMS}, s AS (SELECT plan_id, sum(w * h) AS area, sum(least(w, h)) AS narrow, sum(w * h * 0.9 + 1) AS rough FROM rooms GROUP BY 1)
SELECT plan_id, 'area' AS method, area AS score, round(area - area, 6) AS error FROM s UNION ALL SELECT plan_id, 'narrow', narrow, round(narrow - area, 6) FROM s UNION ALL SELECT plan_id, 'rough', round(rough, 6), round(rough - area, 6) FROM s""")
def custom_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = F.col("w") * F.col("h")
    return rounded(extension.plan_scores(derived.rooms(spark, sf_dir), {"area": area, "narrow": F.least("w", "h"), "rough": area * 0.9 + 1}, "area"))


@query(f"WITH {ROOMS} SELECT plan_id, room_id, w * h AS area, least(w, h) / greatest(w, h) AS shape FROM rooms")
def custom_room_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extension.room_scores(derived.rooms(spark, sf_dir), {"area": F.col("w") * F.col("h"), "shape": F.least("w", "h") / F.greatest("w", "h")})


@query(f"""WITH {ROOMS}, p AS (SELECT plan_id, max(x + w) AS far, max(w / h) AS slim, count(*) AS n FROM rooms GROUP BY 1)
SELECT plan_id, 'inside' AS "check", CASE WHEN far <= 14 THEN 'satisfied' ELSE 'violated' END AS status, far AS measure FROM p
UNION ALL SELECT plan_id, 'slim', CASE WHEN n < 2 THEN 'unknown' WHEN slim <= 4 THEN 'satisfied' ELSE 'violated' END, slim FROM p""")
def custom_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    far, slim = F.max(F.col("x") + F.col("w")), F.max(F.col("w") / F.col("h"))
    return extension.extra_checks(derived.rooms(spark, sf_dir), {"inside": (far <= 14, far), "slim": (F.when(F.count("*") > 1, slim <= 4), slim)})


@query(f"""WITH {ROOMS}, v AS (SELECT plan_id, max(x) FILTER (room_id = 1) AS x1, max(w) FILTER (room_id = 1) AS w1, max(x) FILTER (room_id = 2) AS x2, max(h) FILTER (room_id = 1) AS h1 FROM rooms GROUP BY 1)
SELECT plan_id, 'first_before_second' AS "constraint", x1 + w1 - x2 AS value, CAST(0 AS DOUBLE) AS bound, x1 + w1 - x2 <= 1e-7 AS satisfied FROM v WHERE x2 IS NOT NULL UNION ALL SELECT plan_id, 'low_first', 2 * h1, 5, 2 * h1 <= 5 + 1e-7 FROM v""")
def custom_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([("first_before_second", 1, "x", 1.0), ("first_before_second", 1, "w", 1.0), ("first_before_second", 2, "x", -1.0), ("low_first", 1, "h", 2.0)], "constraint string, room_id long, field string, coefficient double")
    bounds = spark.createDataFrame([("first_before_second", 0.0), ("low_first", 5.0)], "constraint string, bound double")
    return extension.linear_constraints(derived.rooms(spark, sf_dir), terms, bounds)


@query(f"WITH {MEASURES} SELECT plan_id, part_id, line, round(prediction, 4) AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY prediction - 0.5 * spread DESC, line) AS i FROM measures) q WHERE i = 1")
def custom_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = extension.chosen_by_policy(derived.measures(spark, sf_dir), F.col("prediction") - 0.5 * F.col("spread"), "plan_id", "line")
    return best.select("plan_id", "part_id", "line", F.round("prediction", 4).alias("prediction"))


@query(f"WITH {RUNS} SELECT run_id, round(cost * moved, 4) AS score FROM runs WHERE run_id NOT IN (SELECT run_id FROM runs WHERE status = 'ok') ORDER BY cost * moved DESC, run_id LIMIT 15")
def custom_acquisition(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = derived.runs(spark, sf_dir)
    return extension.acquired(runs, F.col("cost") * F.col("moved"), 15, "run_id", runs.where("status = 'ok'")).select("run_id", F.round("score", 4).alias("score"))


@query(f"WITH {RUNS} SELECT run_id, round(moved * 0.5 * 0.5 * 0.5 + 0.1 * (1 + 0.5 + 0.25), 9) AS moved FROM runs")
def custom_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps halfway to a common value."""
    return extension.stepped(derived.runs(spark, sf_dir).select("run_id", "moved"), lambda v: v * 0.5 + 0.1, 3, "moved").select("run_id", F.round("moved", 9).alias("moved"))


@query()
def repair_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole repairs of all plans, never failing: L1 first, then the nearest free places; each with its exact proofs and its outcome.

    ``proved`` is inside, disjoint, wide and large enough; gaps, overhang, load-bearing walls and the budget are verdicts of their own.
    """
    rooms = derived.rooms(spark, sf_dir)
    # A plan's load-bearing wall travels with its rooms.
    walls = derived.walls(spark, sf_dir).where("load_bearing").select("plan_id", F.col("horizontal").cast("int").alias("flat"), "place", F.col("low").alias("wall_low"), F.col("high").alias("wall_high"))
    columns = ("x", "y", "w", "h", "flat", "place", "wall_low", "wall_high")

    def report(plan: int, first: list[float], before: np.ndarray, solved: linear.Solution, areas: np.ndarray) -> tuple:
        strategy, after = ("plain", linear.snapped(solved.x)) if solved.x is not None else ("fallback", linear.naive_repair(before, BOX))
        proof = linear.proof(after, BOX, LEAST_WIDTH, areas)
        flat, place, low, high = first
        wall = [] if np.isnan(place) else [(bool(flat), place, low, high)]
        outline = (*after[:, :2].min(axis=0), *(after[:, :2] + after[:, 2:]).max(axis=0))
        more = linear.whole_proof(after, before, outline, wall, 2.0)
        moved = float(np.abs(after - before).max())
        status = "ok" if all(proof.values()) else "refused" if solved.x is not None else solved.status
        return (plan, strategy, status, all(proof.values()), *more.values(), moved)

    def reports(plans: np.ndarray, ids: np.ndarray, matrix: np.ndarray, ends: np.ndarray) -> list[tuple]:
        return [report(plan, first, before, s, areas) for plan, first, (before, _, s, areas) in zip(plans.tolist(), matrix[ends[:-1], 4:].tolist(), repaired(matrix, ends), strict=True)]

    return per_matrix(rooms.join(walls, "plan_id", "left"), reports, "plan_id long, strategy string, status string, proved boolean, no_gaps boolean, no_overhang boolean, walls_clear boolean, within_budget boolean, moved double", columns, many=True)


@query()
def paired_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of two strategies by amplitude over the sources that have both, with bootstrap intervals (10,000 draws)."""
    side = lambda s: F.avg(F.when(F.col("strategy") == s, F.col("moved")))
    pairs = derived.runs(spark, sf_dir).groupBy("amplitude", "source").agg(side("plain").alias("a"), side("tiling").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source")
        mean, low, high = distributions.paired_bootstrap(rows["a"].to_numpy(float), rows["b"].to_numpy(float), seed=23)
        return pd.DataFrame({"amplitude": [rows["amplitude"].iloc[0]], "pairs": [len(rows)], "mean": [mean], "low": [low], "high": [high]})

    return pairs.groupBy("amplitude").applyInPandas(draw, "amplitude long, pairs long, mean double, low double, high double")
