"""Queries on drawn polygons, on distances between plans, and the protocol of coverage by room type and sector."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oblong.operators import polygons, tables
from oblong.operators.plans import per_matrix, per_plan
from oblong.plans import derived
from oblong.plans.derived import MEASURES, ROOMS, WALLS
from oblong.plans.registry import query, rounded

#: Half a partition, in metres: drawn rooms are inner surfaces.
INSET, TOLERANCE = 0.1, 0.3
REPETITIONS = 10

CORNERS = f"""corners AS (SELECT plan_id, room_id, CAST(k AS BIGINT) AS k, CASE WHEN k IN (0, 3) THEN x + {INSET} ELSE x + w - {INSET} END AS px,
  CASE WHEN k IN (0, 1) THEN y + {INSET} ELSE y + h - {INSET} END AS py FROM rooms, (SELECT unnest([0, 1, 2, 3]) AS k) c)"""


def _lines(c: str) -> str:
    return f"""v{c} AS (SELECT plan_id, {c}, CASE WHEN {c} - lag({c}) OVER w > {TOLERANCE} THEN 1 ELSE 0 END AS o FROM (SELECT DISTINCT plan_id, {c} FROM corners) WINDOW w AS (PARTITION BY plan_id ORDER BY {c})),
l{c} AS (SELECT plan_id, {c}, sum(o) OVER (PARTITION BY plan_id ORDER BY {c}) AS line FROM v{c}), t{c} AS (SELECT plan_id, {c}, avg({c}) OVER (PARTITION BY plan_id, line) AS a{c} FROM l{c})"""


@query(f"""WITH {ROOMS}, {CORNERS}, {_lines('px')}, {_lines('py')}
SELECT plan_id, room_id, k, round(apx, 6) AS px, round(apy, 6) AS py FROM corners JOIN tpx USING (plan_id, px) JOIN tpy USING (plan_id, py)""")
def stitched_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner surfaces of rooms, stitched where only a partition lies between them. No room is as narrow as to collapse."""
    inner = [(F.col("x") + INSET, F.col("y") + INSET), (F.col("x") + F.col("w") - INSET, F.col("y") + INSET), (F.col("x") + F.col("w") - INSET, F.col("y") + F.col("h") - INSET), (F.col("x") + INSET, F.col("y") + F.col("h") - INSET)]
    at = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), a.alias("px"), b.alias("py")) for k, (a, b) in enumerate(inner)])
    corners = derived.rooms(spark, sf_dir).select("plan_id", "room_id", F.explode(at).alias("c")).select("plan_id", "room_id", "c.*")
    return rounded(polygons.stitched(corners, TOLERANCE))


@query(f"""WITH {WALLS}, w AS (SELECT *, radians(CAST(15 + plan_id * 7 % 60 AS DOUBLE)) AS t, CASE WHEN wall_id = 0 THEN 0.4 ELSE 0.2 END AS thickness FROM walls WHERE wall_id < 3),
e AS (SELECT *, CASE WHEN horizontal THEN low ELSE place END AS ax, CASE WHEN horizontal THEN place ELSE low END AS ay, CASE WHEN horizontal THEN high ELSE place END AS bx, CASE WHEN horizontal THEN place ELSE high END AS b_y FROM w),
p AS (SELECT plan_id, wall_id, thickness, ax * cos(t) - ay * sin(t) AS x0, ax * sin(t) + ay * cos(t) AS y0, bx * cos(t) - b_y * sin(t) AS x1, bx * sin(t) + b_y * cos(t) AS y1 FROM e)
SELECT plan_id, wall_id, round(least(x0, x1), 4) AS x0, round(CASE WHEN x0 < x1 THEN y0 ELSE y1 END, 4) AS y0, round(greatest(x0, x1), 4) AS x1, round(CASE WHEN x0 < x1 THEN y1 ELSE y0 END, 4) AS y1, round(thickness, 4) AS thickness FROM p""")
def wall_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes and thickness of walls drawn as turned polygons, from the smallest rectangle around each; the fourth of a plan is too thick to be one."""
    walls = derived.walls(spark, sf_dir).select("plan_id", "wall_id", F.col("horizontal").cast("int").alias("flat"), "place", "low", "high")

    def axes(plan: int, rows: pd.DataFrame) -> list[tuple]:
        t, out = np.radians(15 + plan * 7 % 60), []
        turn = np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])
        for r in rows.itertuples():
            half = {0: 0.2, 3: 0.6}.get(r.wall_id, 0.1)
            corners = np.array([(r.low, r.place - half), (r.high, r.place - half), (r.high, r.place + half), (r.low, r.place + half)])
            found = polygons.wall_axis((corners if r.flat else corners[:, ::-1]) @ turn)
            out += [] if found is None else [(plan, r.wall_id, *found)]
        return out

    schema = "plan_id long, wall_id long, x0 double, y0 double, x1 double, y1 double, thickness double"
    return rounded(per_plan(walls, axes, schema, ("flat", "place", "low", "high"), order="wall_id", period=60), 4)


@query(f"""WITH {ROOMS}, j AS (SELECT coalesce(a.plan_id, b.plan_id - 1) AS plan_id, a.room_id AS i, b.room_id AS j, greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.w - b.w), abs(a.h - b.h)) AS gap FROM rooms a FULL JOIN rooms b ON a.plan_id = b.plan_id - 1 AND a.room_id = b.room_id)
SELECT plan_id, max(gap) AS distance FROM j GROUP BY 1 HAVING count(*) = count(i) AND count(*) = count(j)""")
def side_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each plan against the one with the next id."""
    rooms = derived.rooms(spark, sf_dir)
    return polygons.side_distances(rooms, rooms.withColumn("plan_id", F.col("plan_id") - 1))


@query()
def outline_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance between the outlines of each plan and of the one with the next id, for all plans that have one."""
    rooms = derived.rooms(spark, sf_dir).select("plan_id", "room_id", "x", "y", "w", "h")
    paired = rooms.withColumn("side", F.lit(0)).unionByName(rooms.withColumn("plan_id", F.col("plan_id") - 1).withColumn("side", F.lit(1)))

    def distance(plans: np.ndarray, ids: np.ndarray, matrix: np.ndarray, ends: np.ndarray) -> tuple:
        plan, second = np.repeat(np.arange(len(plans)), np.diff(ends)), matrix[:, 4] == 1
        counts = lambda mask: np.bincount(plan[mask], minlength=len(plans))
        held = [counts(~second), counts(second)]
        both = (held[0] > 0) & (held[1] > 0)
        sides = [(matrix[own & both[plan], :4], np.concatenate(([0], np.cumsum(n[both])))) for own, n in zip((~second, second), held, strict=True)]
        return plans[both], polygons.outline_distances(*sides[0], *sides[1])

    return per_matrix(paired, distance, "plan_id long, distance double", ("x", "y", "w", "h", "side"), many=True)


@query(f"""WITH {MEASURES}, s AS (SELECT r, kind, deg, abs(truth - prediction) / spread AS score, spread, substr(md5(CAST(r AS VARCHAR) || ':' || CAST(cluster AS VARCHAR)), 1, 1) < '8' AS cal FROM measures, (SELECT unnest(range({REPETITIONS})) AS r)),
ranked AS (SELECT r, kind, score, row_number() OVER (PARTITION BY r, kind ORDER BY score) AS i, count(*) OVER (PARTITION BY r, kind) AS n FROM s WHERE cal),
q AS (SELECT r, kind, max(CASE WHEN i = ceil((n + 1) * 90 / 100.0) THEN score END) AS q FROM ranked GROUP BY 1, 2)
SELECT r AS repetition, kind, CAST(floor(((deg + 22.5) % 360) / 45) AS BIGINT) % 8 AS sector, count(*) AS n, count(*) FILTER (score <= q) AS covered, round(avg(2 * q * spread), 4) AS width FROM s JOIN q USING (r, kind) WHERE NOT cal GROUP BY 1, 2, 3""")
def room_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten fresh splits by source: a conformal level a type on one half, its coverage and width by type and sector on the other."""
    score = F.abs(F.col("truth") - F.col("prediction")) / F.col("spread")
    sector = F.floor(((F.col("deg") + 22.5) % 360) / 45) % 8
    each = derived.measures(spark, sf_dir).select("kind", "cluster", "spread", score.alias("score"), sector.alias("sector"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(REPETITIONS - 1).cast("long"))).alias("repetition"))
    cal = F.substring(F.md5(F.concat(F.col("repetition").cast("string"), F.lit(":"), F.col("cluster").cast("string"))), 1, 1) < "8"
    split = each.withColumn("cal", cal)
    levels = tables.conformal_quantile(split.where("cal"), ["repetition", "kind"], "score", 10).select("repetition", "kind", "q")
    tested = split.where("NOT cal").join(levels, ["repetition", "kind"]).groupBy("repetition", "kind", "sector")
    return rounded(tested.agg(F.count("*").alias("n"), F.count_if(F.col("score") <= F.col("q")).alias("covered"), F.avg(2 * F.col("q") * F.col("spread")).alias("width")), 4)
