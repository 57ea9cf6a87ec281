"""Queries on grids, tilings, seams, outlines and the further checks of plans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oblong.functions import circular
from oblong.operators import layouts, linear, tiling
from oblong.operators.plans import per_matrix
from oblong.plans import derived
from oblong.plans.derived import OPENINGS, ROOMS, TYPED, WALLS
from oblong.plans.layout_queries import PAIRS, UNION_SQL
from oblong.plans.registry import SQL, query, rounded

SIDES = """sides AS (SELECT plan_id, room_id, 'x' AS axis, 'left' AS side, x AS value FROM rooms UNION ALL SELECT plan_id, room_id, 'x', 'right', x + w FROM rooms
  UNION ALL SELECT plan_id, room_id, 'y', 'low', y FROM rooms UNION ALL SELECT plan_id, room_id, 'y', 'high', y + h FROM rooms)"""


@query(f"WITH {ROOMS}, {SIDES}, r AS (SELECT *, first_value(room_id) OVER w AS ref_room_id, first_value(side) OVER w AS ref_side, row_number() OVER w AS i FROM sides WINDOW w AS (PARTITION BY plan_id, axis, value ORDER BY room_id, side)) SELECT * EXCLUDE (i) FROM r WHERE i > 1")
def tiling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tiling_rows(derived.rooms(spark, sf_dir))


@query(f"""WITH {ROOMS}, {SIDES}, v AS (SELECT DISTINCT plan_id, axis, value FROM sides), f AS (SELECT *, CASE WHEN value - lag(value) OVER (PARTITION BY plan_id, axis ORDER BY value) > 1.5 THEN 1 ELSE 0 END AS o FROM v),
l AS (SELECT *, sum(o) OVER (PARTITION BY plan_id, axis ORDER BY value) AS line FROM f), t AS (SELECT *, avg(value) OVER (PARTITION BY plan_id, axis, line) AS moved FROM l),
m AS (SELECT s.plan_id, room_id, max(moved) FILTER (side = 'left') a, max(moved) FILTER (side = 'right') b, max(moved) FILTER (side = 'low') c, max(moved) FILTER (side = 'high') d FROM sides s JOIN t USING (plan_id, axis, value) GROUP BY 1, 2)
SELECT plan_id, room_id, round(a, 6) AS x, round(c, 6) AS y, round(b - a, 6) AS w, round(d - c, 6) AS h FROM m""")
def snapped_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tiling.snapped_to_lines(derived.rooms(spark, sf_dir), 1.5))


@query(f"""WITH {ROOMS}, {SIDES}, l AS (SELECT DISTINCT plan_id, axis, value FROM sides), s AS (SELECT plan_id, axis, value AS a, lead(value) OVER (PARTITION BY plan_id, axis ORDER BY value) AS b FROM l),
c AS (SELECT p.plan_id, p.a AS x0, p.b AS x1, q.a AS y0, q.b AS y1 FROM s p JOIN s q ON p.plan_id = q.plan_id AND p.axis = 'x' AND q.axis = 'y' WHERE p.b IS NOT NULL AND q.b IS NOT NULL),
n AS (SELECT c.*, (SELECT count(*) FROM rooms r WHERE r.plan_id = c.plan_id AND r.x <= c.x0 AND r.x + r.w >= c.x1 AND r.y <= c.y0 AND r.y + r.h >= c.y1) AS n FROM c)
SELECT plan_id, count(*) AS cells, count(*) FILTER (n = 0) AS uncovered, count(*) FILTER (n > 1) AS overlapped, bool_and(n = 1) AS is_partition FROM n GROUP BY 1""")
def grid_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the cells of each plan's grid are covered once each."""

    def count(plan: int, ids: np.ndarray, rooms: np.ndarray) -> list[tuple]:
        n = tiling.cells_of(rooms)
        return [(plan, n.size, int((n == 0).sum()), int((n > 1).sum()), bool((n == 1).all()))] if n.size else []

    return per_matrix(derived.rooms(spark, sf_dir), count, "plan_id long, cells long, uncovered long, overlapped long, is_partition boolean")


def covered_sql(name: str, source: str) -> str:
    return f"""{name}_cuts AS (SELECT DISTINCT plan_id, x AS x0 FROM {source} UNION SELECT plan_id, x + w FROM {source}), {name}_slabs AS (SELECT *, lead(x0) OVER (PARTITION BY plan_id ORDER BY x0) AS x1 FROM {name}_cuts),
{name}_s AS (SELECT c.plan_id, x0, x1, y AS low, y + h AS high FROM {name}_slabs c JOIN {source} r ON r.plan_id = c.plan_id AND r.x <= c.x0 AND r.x + r.w >= c.x1), {name}_i AS ({UNION_SQL.format(keys="plan_id, x0, x1", source=name + "_s")}),
{name}_j AS (SELECT plan_id, x0, x1, island, min(low) a, max(high) b FROM {name}_i GROUP BY 1, 2, 3, 4), {name} AS (SELECT plan_id, sum((x1 - x0) * (b - a)) AS covered FROM {name}_j GROUP BY 1)"""


@query(f"""WITH {ROOMS}, clipped AS (SELECT plan_id, greatest(x, 1) AS x, greatest(y, 1) AS y, least(x + w, 11) - greatest(x, 1) AS w, least(y + h, 8) - greatest(y, 1) AS h FROM rooms), kept AS (SELECT * FROM clipped WHERE w > 0 AND h > 0),
{covered_sql("whole", "rooms")}, {covered_sql("inside", "kept")} SELECT plan_id, 70 - coalesce(i.covered, 0) AS gap, w.covered - coalesce(i.covered, 0) AS overhang FROM whole w LEFT JOIN inside i USING (plan_id)""")
def outline_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.outline_gaps(derived.rooms(spark, sf_dir), 1.0, 1.0, 11.0, 8.0)


@query(f"""WITH {PAIRS}, o AS (SELECT DISTINCT plan_id FROM pairs WHERE dx > 0 AND dy > 0), b AS (SELECT plan_id, (max(x + w) - min(x)) * (max(y + h) - min(y)) AS outline, sum(w * h) AS area FROM rooms GROUP BY 1)
SELECT plan_id, o.plan_id IS NULL AS disjoint, area = outline AS full, o.plan_id IS NULL AND area = outline AS tiles FROM b LEFT JOIN o USING (plan_id)""")
def tiling_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rational proofs that rooms tile the box around them: disjoint, with areas that add up to the box's."""

    def prove(plan: int, ids: np.ndarray, rooms: np.ndarray) -> list[tuple]:
        _, (flat,) = linear.integers(rooms.ravel().tolist())
        q = [flat[k : k + 4] for k in range(0, len(flat), 4)]
        disjoint = linear.disjoint_rooms(q)
        box = [max(r[k] + r[k + 2] for r in q) - min(r[k] for r in q) for k in (0, 1)]
        full = sum(r[2] * r[3] for r in q) == box[0] * box[1]
        return [(plan, disjoint, full, disjoint and full)]

    return per_matrix(derived.rooms(spark, sf_dir), prove, "plan_id long, disjoint boolean, full boolean, tiles boolean")


MERGES = f"""{PAIRS}, merges AS (SELECT plan_id, CASE WHEN (dy > 1e-7 AND abs(ax + aw - bx) < 1e-7) OR (NOT (dy > 1e-7 AND abs(bx + bw - ax) < 1e-7) AND dx > 1e-7 AND abs(ay + ah - "by") < 1e-7) THEN a_room_id ELSE b_room_id END AS i,
  CASE WHEN (dy > 1e-7 AND abs(ax + aw - bx) < 1e-7) OR (NOT (dy > 1e-7 AND abs(bx + bw - ax) < 1e-7) AND dx > 1e-7 AND abs(ay + ah - "by") < 1e-7) THEN b_room_id ELSE a_room_id END AS j,
  CASE WHEN dy > 1e-7 AND (abs(ax + aw - bx) < 1e-7 OR abs(bx + bw - ax) < 1e-7) THEN 'x' ELSE 'y' END AS axis FROM pairs
  WHERE (dy > 1e-7 AND (abs(ax + aw - bx) < 1e-7 OR abs(bx + bw - ax) < 1e-7)) OR (dx > 1e-7 AND (abs(ay + ah - "by") < 1e-7 OR abs("by" + bh - ay) < 1e-7)))"""


@query(f"WITH {MERGES} SELECT * FROM merges")
def detected_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.merges(derived.rooms(spark, sf_dir))


FUSION = f"""{MERGES}, fusion AS (
  SELECT plan_id, i, j, axis, 'seam' AS "row", i AS room_id, axis AS field, 1.0::DOUBLE AS coefficient, 0.0::DOUBLE AS bound, 'eq' AS kind FROM merges
  UNION ALL SELECT plan_id, i, j, axis, 'seam', i, CASE axis WHEN 'x' THEN 'w' ELSE 'h' END, 1, 0, 'eq' FROM merges UNION ALL SELECT plan_id, i, j, axis, 'seam', j, axis, -1, 0, 'eq' FROM merges
  UNION ALL SELECT plan_id, i, j, axis, 'contact_i', i, CASE axis WHEN 'x' THEN 'y' ELSE 'x' END, 1, -0.8, 'le' FROM merges UNION ALL SELECT plan_id, i, j, axis, 'contact_i', j, CASE axis WHEN 'x' THEN 'y' ELSE 'x' END, -1, -0.8, 'le' FROM merges
  UNION ALL SELECT plan_id, i, j, axis, 'contact_i', j, CASE axis WHEN 'x' THEN 'h' ELSE 'w' END, -1, -0.8, 'le' FROM merges UNION ALL SELECT plan_id, i, j, axis, 'contact_j', j, CASE axis WHEN 'x' THEN 'y' ELSE 'x' END, 1, -0.8, 'le' FROM merges
  UNION ALL SELECT plan_id, i, j, axis, 'contact_j', i, CASE axis WHEN 'x' THEN 'y' ELSE 'x' END, -1, -0.8, 'le' FROM merges UNION ALL SELECT plan_id, i, j, axis, 'contact_j', i, CASE axis WHEN 'x' THEN 'h' ELSE 'w' END, -1, -0.8, 'le' FROM merges)"""


@query(f"WITH {FUSION} SELECT * FROM fusion")
def fusion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.fusion_rows(tiling.merges(derived.rooms(spark, sf_dir)), 0.8)


@query(f"""WITH {FUSION}, f AS (SELECT f.plan_id, f.i, f.j, f."row", any_value(kind) AS kind, sum(coefficient * CASE field WHEN 'x' THEN x WHEN 'y' THEN y WHEN 'w' THEN w ELSE h END) AS value, any_value(bound) AS bound FROM fusion f JOIN rooms r ON r.plan_id = f.plan_id AND r.room_id = f.room_id GROUP BY 1, 2, 3, 4)
SELECT plan_id, count(*) AS n_rows, count(*) FILTER (kind = 'eq') AS equalities, count(*) FILTER (CASE kind WHEN 'eq' THEN abs(value - bound) > 1e-7 ELSE value > bound + 1e-7 END) AS violated FROM f GROUP BY 1""")
def fused_polytopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fusion rows of each plan as rows of its polytope, evaluated at the plan itself."""
    rooms = derived.rooms(spark, sf_dir)
    rows = tiling.fusion_rows(tiling.merges(rooms), 0.8)
    fields = rooms.select("plan_id", "room_id", F.explode(F.create_map(*[v for f in tiling.FIELDS for v in (F.lit(f), F.col(f))])).alias("field", "value"))
    sums = rows.join(fields, ["plan_id", "room_id", "field"]).groupBy("plan_id", "i", "j", "row").agg(F.first("kind").alias("kind"), F.sum(F.col("coefficient") * F.col("value")).alias("value"), F.first("bound").alias("bound"))
    broken = F.when(F.col("kind") == "eq", F.abs(F.col("value") - F.col("bound")) > 1e-7).otherwise(F.col("value") > F.col("bound") + 1e-7)
    return sums.groupBy("plan_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("kind") == "eq").alias("equalities"), F.count_if(broken).alias("violated"))


def _corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of rooms turned by 15 to 74 degrees, plan by plan, as drawings come."""
    x, y, w, h = map(F.col, "xywh")
    theta = F.radians((15 + F.col("plan_id") * 7 % 60).cast("double"))
    at = [F.struct(F.lit(k).alias("k"), a.alias("a"), b.alias("b")) for k, (a, b) in enumerate(((x, y), (x + w, y), (x + w, y + h), (x, y + h)))]
    rooms = derived.rooms(spark, sf_dir).select("plan_id", "room_id", theta.alias("t"), F.explode(F.array(*at)).alias("c"))
    return rooms.select("plan_id", "room_id", F.col("c.k").alias("k"), (F.col("c.a") * F.cos("t") - F.col("c.b") * F.sin("t")).alias("px"), (F.col("c.a") * F.sin("t") + F.col("c.b") * F.cos("t")).alias("py"))


@query(f"WITH {ROOMS} SELECT plan_id, room_id, CAST(k AS BIGINT) AS k, round(CAST(15 + plan_id * 7 % 60 + 90 * (k % 2) AS DOUBLE), 4) AS angle, round(CASE WHEN k % 2 = 0 THEN w ELSE h END, 6) AS length FROM rooms, (SELECT unnest([0, 1, 2, 3]) AS k) q")
def polygon_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tiling.polygon_edges(_corners(spark, sf_dir))
    return e.select("plan_id", "room_id", F.col("k").cast("long").alias("k"), F.round("angle", 4).alias("angle"), F.round("length", 6).alias("length"))


@query(f"WITH {ROOMS} SELECT plan_id, room_id, x, y, w, h FROM rooms")
def straightened_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turned drawings back on their axes: the dominant direction of all edges, weighted by length, then boxes. They must be the rooms."""
    corners = _corners(spark, sf_dir)
    c, s = circular.resultant(F.col("angle"), F.col("length"), 90.0)
    angle = tiling.polygon_edges(corners).groupBy("plan_id").agg(c.alias("c"), s.alias("s")).select("plan_id", circular.direction(F.col("c"), F.col("s"), 90.0).alias("theta"))
    return rounded(tiling.straightened(corners, angle), 4)


@query(f"WITH {TYPED} SELECT plan_id, room_id, room_type || '_' || CAST(row_number() OVER (PARTITION BY plan_id, room_type ORDER BY y, x, room_id) AS VARCHAR) AS name FROM typed")
def reading_order_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms numbered by type in reading order, from the bottom left."""
    i = F.row_number().over(Window.partitionBy("plan_id", "room_type").orderBy("y", "x", "room_id"))
    return derived.typed_rooms(spark, sf_dir).select("plan_id", "room_id", F.concat_ws("_", "room_type", i.cast("string")).alias("name"))


VECTOR = "string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(y AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(w AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(h AS BIGINT) AS VARCHAR), ',' ORDER BY {order})"


@query(f"WITH {ROOMS} SELECT plan_id, count(*) * 4 AS n, {VECTOR.format(order='room_id')} AS vector, {VECTOR.format(order='w * h DESC, room_id')} AS permuted FROM rooms GROUP BY 1")
def decision_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each plan as one vector of numbers, in the order of its rooms and in a given other order (here: by falling area)."""
    row = F.struct("room_id", F.array(*"xywh").alias("v"))
    plans = derived.rooms(spark, sf_dir).groupBy("plan_id").agg(F.array_sort(F.collect_list(row)).alias("rooms"), F.array_sort(F.collect_list(F.struct((-F.col("w") * F.col("h")).alias("rank"), "room_id"))).alias("order"))
    text = lambda values: F.concat_ws(",", F.transform(F.flatten(values), lambda v: v.cast("long").cast("string")))
    at = F.transform("order", lambda o: F.get(F.filter("rooms", lambda r: r["room_id"] == o["room_id"]), F.lit(0))["v"])
    vector = F.transform("rooms", lambda r: r["v"])
    return plans.select("plan_id", F.size(F.flatten(vector)).cast("long").alias("n"), text(vector).alias("vector"), text(at).alias("permuted"))


@query(f"WITH {ROOMS} SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY room_id) - 1 AS room_index, x, y, w, h FROM rooms")
def rooms_of_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors back to rooms: place // 4 is the room, place % 4 the field."""
    held = F.array_sort(F.collect_list(F.struct("room_id", F.array(*"xywh").alias("v"))))
    vectors = derived.rooms(spark, sf_dir).groupBy("plan_id").agg(F.flatten(F.transform(held, lambda r: r["v"])).alias("vector"))
    cells = vectors.select("plan_id", F.posexplode("vector").alias("pos", "v"))
    fields = [F.max(F.when(F.col("pos") % 4 == k, F.col("v"))).alias(f) for k, f in enumerate(tiling.FIELDS)]
    return cells.groupBy("plan_id", F.floor(F.col("pos") / 4).alias("room_index")).agg(*fields)


@query(f"""WITH {OPENINGS}, counts AS (SELECT plan_id, count(*) AS n, sum(w * h) AS area FROM rooms GROUP BY 1)
SELECT o.plan_id, opening_id, CAST(CASE WHEN horizontal THEN 0 ELSE 1 END AS DOUBLE) AS azimuth_sin, CAST(CASE WHEN horizontal THEN 1 ELSE 0 END AS DOUBLE) AS azimuth_cos, s, relative_width * (high - low) AS width, sill, head, CAST(1 AS DOUBLE) / n AS per_room, round(relative_width * (high - low) / area, 6) AS share
FROM openings o JOIN walls w ON w.plan_id = o.plan_id AND w.wall_id = o.wall_id JOIN counts c ON c.plan_id = o.plan_id""")
def opening_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of each opening that stands on a wall of its plan."""
    counts = derived.rooms(spark, sf_dir).groupBy("plan_id").agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("h")).alias("area"))
    placed = derived.openings(spark, sf_dir).join(derived.walls(spark, sf_dir), ["plan_id", "wall_id"]).join(counts, "plan_id")
    width, azimuth = F.col("relative_width") * (F.col("high") - F.col("low")), F.radians(F.when(F.col("horizontal"), 0.0).otherwise(90.0))
    return placed.select("plan_id", "opening_id", F.round(F.sin(azimuth), 9).alias("azimuth_sin"), F.round(F.cos(azimuth), 9).alias("azimuth_cos"), "s", width.alias("width"), "sill", "head", (1.0 / F.col("n")).alias("per_room"), F.round(width / F.col("area"), 6).alias("share"))


@query(f"""WITH {ROOMS}, b AS (SELECT plan_id, min(x) x0, min(y) y0, max(x + w) x1, max(y + h) y1 FROM rooms GROUP BY 1), e AS (
  SELECT plan_id, CAST(0 AS BIGINT) AS edge, x0 ax, y0 ay, x1 bx, y0 "by" FROM b UNION ALL SELECT plan_id, 1, x1, y0, x1, y1 FROM b UNION ALL SELECT plan_id, 2, x1, y1, x0, y1 FROM b UNION ALL SELECT plan_id, 3, x0, y1, x0, y0 FROM b)
SELECT plan_id, edge, round(ax + 0.2 * (bx - ax), 6) AS x_from, round(ay + 0.2 * ("by" - ay), 6) AS y_from, round(ax + 0.8 * (bx - ax), 6) AS x_to, round(ay + 0.8 * ("by" - ay), 6) AS y_to, round(0.6 * sqrt((bx - ax) ** 2 + ("by" - ay) ** 2) * 1.15, 6) AS glazing FROM e""")
def facade_glazing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One window centred on each edge of a plan's outline, of 0.6 of its length, from 1.00 to 2.15 m."""
    far = lambda c, s: F.max(F.col(c) + F.col(s))
    box = derived.rooms(spark, sf_dir).groupBy("plan_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), far("x", "w").alias("x1"), far("y", "h").alias("y1"))
    vertex = [F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]
    edges = box.select("plan_id", F.array(*vertex).alias("o")).select("plan_id", "o", F.posexplode("o").alias("edge", "a")).withColumn("b", F.get("o", (F.col("edge") + 1) % F.size("o")))
    at = lambda c, s: F.round(F.col(f"a.{c}") + s * (F.col(f"b.{c}") - F.col(f"a.{c}")), 6)
    length = F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))
    return edges.select("plan_id", F.col("edge").cast("long").alias("edge"), at("x", 0.2).alias("x_from"), at("y", 0.2).alias("y_from"), at("x", 0.8).alias("x_to"), at("y", 0.8).alias("y_to"), F.round(0.6 * length * 1.15, 6).alias("glazing"))


@query(f"""WITH {WALLS}, d AS (SELECT *, place + CASE WHEN (plan_id + wall_id) % 5 = 0 THEN 0.25 ELSE 0 END AS declared, high - low AS length FROM walls)
SELECT plan_id, count(*) AS walls, min(length) AS shortest, count(*) FILTER (abs(declared - place) > 1e-7) AS moved, count(*) FILTER (load_bearing AND abs(declared - place) > 1e-7) AS bearing_moved, bool_and(length > 1e-7) AS long_enough FROM d GROUP BY 1""")
def structure_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walls as declared against the structure: length, and which ones, load-bearing or not, have moved."""
    walls = derived.walls(spark, sf_dir)
    declared = walls.select("plan_id", "wall_id", (F.col("place") + F.when((F.col("plan_id") + F.col("wall_id")) % 5 == 0, 0.25).otherwise(0.0)).alias("declared"))
    d = walls.join(declared, ["plan_id", "wall_id"]).withColumn("length", F.col("high") - F.col("low")).withColumn("off", F.abs(F.col("declared") - F.col("place")) > layouts.SNAP)
    return d.groupBy("plan_id").agg(F.count("*").alias("walls"), F.min("length").alias("shortest"), F.count_if("off").alias("moved"), F.count_if(F.col("load_bearing") & F.col("off")).alias("bearing_moved"), F.bool_and(F.col("length") > layouts.SNAP).alias("long_enough"))


@query(f"""WITH {TYPED}, box AS (SELECT plan_id, min(x) x0, min(y) y0, max(x + w) x1, max(y + h) y1 FROM rooms GROUP BY 1),
f AS (SELECT t.plan_id, t.room_type, h * (CASE WHEN abs(x - x0) < 1e-7 THEN 1 ELSE 0 END + CASE WHEN abs(x + w - x1) < 1e-7 THEN 1 ELSE 0 END) + w * (CASE WHEN abs(y - y0) < 1e-7 THEN 1 ELSE 0 END + CASE WHEN abs(y + h - y1) < 1e-7 THEN 1 ELSE 0 END) AS facade FROM typed t JOIN box USING (plan_id)),
p AS (SELECT plan_id, count(*) FILTER (room_type IN ('bedroom', 'living_room') AND facade < 1e-7) AS dark, list_sort(list_distinct(list(room_type))) AS types FROM f GROUP BY 1)
SELECT plan_id, dark, array_to_string(list_filter(['bathroom', 'bedroom', 'kitchen'], lambda t: NOT list_contains(types, t)), ',') AS missing, dark = 0 AND list_has_all(types, ['bathroom', 'bedroom', 'kitchen']) AS functional FROM p""")
def functional_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Habitable rooms without a facade, and room types that the programme asks for and a plan lacks."""
    rooms = derived.typed_rooms(spark, sf_dir)
    facade = layouts.facades(derived.rooms(spark, sf_dir))
    dark = F.count_if(F.col("room_type").isin("bedroom", "living_room") & (F.col("facade") < layouts.SNAP))
    p = rooms.join(facade, ["plan_id", "room_id"]).groupBy("plan_id").agg(dark.alias("dark"), F.collect_set("room_type").alias("types"))
    missing = F.array_except(F.array(*map(F.lit, ("bathroom", "bedroom", "kitchen"))), F.col("types"))
    return p.select("plan_id", "dark", F.array_join(missing, ",").alias("missing"), ((F.col("dark") == 0) & (F.size(missing) == 0)).alias("functional"))


@query(f"""WITH {OPENINGS}, b AS (SELECT plan_id, min(x) x0, min(y) y0, max(x + w) x1, max(y + h) y1 FROM rooms GROUP BY 1),
j AS (SELECT o.plan_id, CASE WHEN w.wall_id IS NULL THEN 'missing' WHEN greatest(-(s - relative_width / 2), s + relative_width / 2 - 1) > 1e-7 THEN 'overhang' WHEN CASE WHEN horizontal THEN place > y0 + 1e-7 AND place < y1 - 1e-7 ELSE place > x0 + 1e-7 AND place < x1 - 1e-7 END THEN 'interior' ELSE 'facade' END AS class
  FROM openings o JOIN b ON b.plan_id = o.plan_id LEFT JOIN walls w ON w.plan_id = o.plan_id AND w.wall_id = o.wall_id) SELECT class, count(*) AS n, count(DISTINCT plan_id) AS plans FROM j GROUP BY 1""")
def opening_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings on no wall, beyond their wall's end, on a wall inside the outline, or on the facade."""
    far = lambda c, s: F.max(F.col(c) + F.col(s))
    box = derived.rooms(spark, sf_dir).groupBy("plan_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), far("x", "w").alias("x1"), far("y", "h").alias("y1"))
    walls = derived.walls(spark, sf_dir).select("plan_id", "wall_id", "horizontal", "place", F.lit(True).alias("there"))
    j = derived.openings(spark, sf_dir).join(box, "plan_id").join(walls, ["plan_id", "wall_id"], "left")
    half, tol = F.col("relative_width") / 2, layouts.SNAP
    within = lambda a, b: (F.col("place") > F.col(a) + tol) & (F.col("place") < F.col(b) - tol)
    inner = F.when(F.col("horizontal"), within("y0", "y1")).otherwise(within("x0", "x1"))
    kind = F.when(F.col("there").isNull(), "missing").when(F.greatest(half - F.col("s"), F.col("s") + half - 1) > tol, "overhang").when(inner, "interior").otherwise("facade")
    return j.groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.count_distinct("plan_id").alias("plans"))


@query(f"""WITH {ROOMS}, v AS (SELECT plan_id, x AS vx, y AS vy FROM rooms UNION ALL SELECT plan_id, x + w, y FROM rooms UNION ALL SELECT plan_id, x + w, y + h FROM rooms UNION ALL SELECT plan_id, x, y + h FROM rooms)
SELECT plan_id, round_even(vx, 9) AS vx, round_even(vy, 9) AS vy, count(*) AS n FROM v GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def duplicate_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners that coincide after rounding to nine digits."""
    x, y, w, h = map(F.col, "xywh")
    corners = F.array(*[F.struct(a.alias("vx"), b.alias("vy")) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))])
    v = derived.rooms(spark, sf_dir).select("plan_id", F.explode(corners).alias("v")).select("plan_id", F.bround("v.vx", 9).alias("vx"), F.bround("v.vy", 9).alias("vy"))
    return v.groupBy("plan_id", "vx", "vy").agg(F.count("*").alias("n")).where("n > 1")


@query(f"""WITH {ROOMS}, p AS (SELECT plan_id, count(*) AS n, bool_and(w > 0 AND h > 0) AS sound, max(x + w) - min(x) AS own FROM rooms GROUP BY 1), c AS (SELECT o_orderkey AS plan_id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 7 + 10 AS DOUBLE) END AS given, CAST(o_orderkey % 4 AS DOUBLE) / 4 - 0.25 AS budget FROM orders)
SELECT plan_id, coalesce(given, own) AS outline, array_to_string(list_filter([CASE WHEN NOT sound THEN 'rooms' END, CASE WHEN n < 2 THEN 'single' END, CASE WHEN budget < 0 THEN 'budget' END, CASE WHEN coalesce(given, own) < own THEN 'outline' END], lambda r: r IS NOT NULL), ',') AS refusals FROM p JOIN c USING (plan_id)""")
def input_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a plan and its context are refused for before anything is solved; the context's outline comes before the plan's own."""
    from oblong.sources.tables import table

    p = derived.rooms(spark, sf_dir).groupBy("plan_id").agg(F.count("*").alias("n"), F.bool_and((F.col("w") > 0) & (F.col("h") > 0)).alias("sound"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("own"))
    k = F.col("o_orderkey")
    c = table(spark, sf_dir, "orders").select(k.alias("plan_id"), F.when(k % 3 == 0, (k % 7 + 10).cast("double")).alias("given"), ((k % 4).cast("double") / 4 - 0.25).alias("budget"))
    outline = F.coalesce("given", "own")
    reasons = F.array_compact(F.array(F.when(~F.col("sound"), "rooms"), F.when(F.col("n") < 2, "single"), F.when(F.col("budget") < 0, "budget"), F.when(outline < F.col("own"), "outline")))
    return p.join(c, "plan_id").select("plan_id", outline.alias("outline"), F.array_join(reasons, ",").alias("refusals"))


@query(f"""WITH {ROOMS}, {WALLS}, d AS (SELECT r.plan_id, room_id, wall_id, CASE WHEN horizontal THEN abs(y + h / 2 - place) + greatest(0, low - x - w / 2, x + w / 2 - high) ELSE abs(x + w / 2 - place) + greatest(0, low - y - h / 2, y + h / 2 - high) END AS dist FROM rooms r JOIN walls v ON v.plan_id = r.plan_id)
SELECT plan_id, room_id, wall_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, room_id ORDER BY dist, wall_id) AS i FROM d) q WHERE i = 1""")
def nearest_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wall nearest to the middle of each room, as windows are given to walls."""
    walls = derived.walls(spark, sf_dir)
    j = derived.rooms(spark, sf_dir).join(walls, "plan_id")
    cx, cy, zero = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, F.lit(0.0)
    off = lambda along: F.greatest(zero, F.col("low") - along, along - F.col("high"))
    dist = F.when(F.col("horizontal"), F.abs(cy - F.col("place")) + off(cx)).otherwise(F.abs(cx - F.col("place")) + off(cy))
    best = j.groupBy("plan_id", "room_id").agg(F.min(F.struct(dist.alias("dist"), "wall_id")).alias("m"))
    return best.select("plan_id", "room_id", "m.wall_id", "m.dist")


@query(f"""WITH {ROOMS}, {WALLS}, c AS (SELECT r.*, wall_id, horizontal, place, low, high FROM rooms r JOIN walls v ON v.plan_id = r.plan_id WHERE load_bearing AND CASE WHEN horizontal THEN place > y AND place < y + h AND low < x + w AND high > x ELSE place > x AND place < x + w AND low < y + h AND high > y END),
s AS (SELECT plan_id, room_id, wall_id, CASE WHEN horizontal THEN 'below' ELSE 'left' END AS side, CASE WHEN horizontal THEN y + h - place ELSE x + w - place END AS penetration FROM c UNION ALL SELECT plan_id, room_id, wall_id, CASE WHEN horizontal THEN 'above' ELSE 'right' END, CASE WHEN horizontal THEN place - y ELSE place - x END FROM c)
SELECT plan_id, room_id, wall_id, side, penetration, rank() OVER (PARTITION BY plan_id, room_id, wall_id ORDER BY penetration) AS rank FROM s""")
def wall_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On which side of a load-bearing wall that crosses it a room could stay, by how far it would have to move."""
    x, y, w, h, place = map(F.col, ("x", "y", "w", "h", "place"))
    c = derived.rooms(spark, sf_dir).join(derived.walls(spark, sf_dir).where("load_bearing"), "plan_id")
    meets = F.when(F.col("horizontal"), (place > y) & (place < y + h) & (F.col("low") < x + w) & (F.col("high") > x)).otherwise((place > x) & (place < x + w) & (F.col("low") < y + h) & (F.col("high") > y))
    flat = F.col("horizontal")
    sides = F.array(F.struct(F.when(flat, "below").otherwise("left").alias("side"), F.when(flat, y + h - place).otherwise(x + w - place).alias("penetration")), F.struct(F.when(flat, "above").otherwise("right").alias("side"), F.when(flat, place - y).otherwise(place - x).alias("penetration")))
    s = c.where(meets).select("plan_id", "room_id", "wall_id", F.explode(sides).alias("s")).select("plan_id", "room_id", "wall_id", "s.*")
    return s.withColumn("rank", F.rank().over(Window.partitionBy("plan_id", "room_id", "wall_id").orderBy("penetration")).cast("long"))


@query(SQL["pairwise_order"].replace("SELECT plan_id, CASE WHEN across THEN 'x'", ", q AS (SELECT plan_id, CASE WHEN across THEN 'x'") + """)
SELECT q.plan_id, axis, src, dst, round(CASE axis WHEN 'x' THEN b.x - a.x - a.w ELSE b.y - a.y - a.h END, 6) AS slack, CASE WHEN abs(CASE axis WHEN 'x' THEN b.x - a.x - a.w ELSE b.y - a.y - a.h END) <= 1e-6 THEN 'eq' ELSE 'le' END AS kind FROM q JOIN rooms a ON a.plan_id = q.plan_id AND a.room_id = src JOIN rooms b ON b.plan_id = q.plan_id AND b.room_id = dst""")
def frozen_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separation rows of each plan with their slack; those without any become equalities."""
    rooms = derived.rooms(spark, sf_dir)
    side = lambda who: rooms.select("plan_id", F.col("room_id").alias(who), *[F.col(c).alias(f"{who}_{c}") for c in "xywh"])
    j = layouts.pairwise_order(rooms).join(side("src"), ["plan_id", "src"]).join(side("dst"), ["plan_id", "dst"])
    slack = F.when(F.col("axis") == "x", F.col("dst_x") - F.col("src_x") - F.col("src_w")).otherwise(F.col("dst_y") - F.col("src_y") - F.col("src_h"))
    return j.select("plan_id", "axis", "src", "dst", F.round(slack, 6).alias("slack"), F.when(F.abs(slack) <= 1e-6, "eq").otherwise("le").alias("kind"))


@query(f"""WITH {TYPED}, q AS (SELECT plan_id, room_id, w, h, least_area AS a, (w * h / least_area + 1) / 2 + 1 AS rest FROM typed JOIN regulation USING (room_type) WHERE w * h >= least_area), t AS (SELECT *, (rest + sqrt(greatest(rest * rest - 4, 0))) / 2 AS t FROM q)
SELECT plan_id, room_id, round(w / t, 6) AS from_w, round(w * t, 6) AS to_w, round(a / (w * w), 6) AS slope, round(a * t / w + a / (w * w) * (w / t), 6) AS bound, a / (w * w) * w + h >= a * t / w + a / (w * w) * (w / t) - 1e-9 AS inside FROM t""")
def inner_area_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every large enough room the chord h + slope w >= bound of its least area's curve between two widths about its own: all rooms
    inside of it are large enough, and half of what the room has to spare is left above it."""
    area = derived.least_area(F.col("room_type"))
    rooms = derived.typed_rooms(spark, sf_dir).withColumn("a", area).where("a IS NOT NULL AND w * h >= a")
    rest = (F.col("w") * F.col("h") / F.col("a") + 1) / 2 + 1
    t = (rest + F.sqrt(F.greatest(rest * rest - 4, F.lit(0.0)))) / 2
    c = rooms.select("plan_id", "room_id", "w", "h", "a", (F.col("w") / t).alias("from_w"), (F.col("w") * t).alias("to_w"))
    slope = F.col("a") / (F.col("from_w") * F.col("to_w"))
    bound = F.col("a") / F.col("from_w") + slope * F.col("from_w")
    return c.select("plan_id", "room_id", F.round("from_w", 6).alias("from_w"), F.round("to_w", 6).alias("to_w"), F.round(slope, 6).alias("slope"), F.round(bound, 6).alias("bound"), (slope * F.col("w") + F.col("h") >= bound - 1e-9).alias("inside"))


@query(f"""WITH {TYPED}, p AS (SELECT t.plan_id, sum(coalesce(least_area, 0)) AS wanted, max(x + w) - min(x) AS wide, max(y + h) - min(y) AS high, count(*) AS n FROM typed t LEFT JOIN regulation USING (room_type) GROUP BY 1)
SELECT plan_id, wanted, wide * high AS outline, CASE WHEN wanted > wide * high + 1e-9 THEN 'infeasible' WHEN least(wide, high) < 2 THEN 'infeasible' WHEN n * 4 > wide * high THEN 'unknown' ELSE 'feasible' END AS verdict,
CASE WHEN wanted > wide * high + 1e-9 THEN 'least areas exceed the outline' WHEN least(wide, high) < 2 THEN 'the outline is narrower than a room' WHEN n * 4 > wide * high THEN 'widths leave no certain place' ELSE '' END AS explanation FROM p""")
def feasibility_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a programme can fit into a plan's box, by areas and widths, and why not."""
    rooms = derived.typed_rooms(spark, sf_dir).withColumn("least", F.coalesce(derived.least_area(F.col("room_type")), F.lit(0.0)))
    p = rooms.groupBy("plan_id").agg(F.sum("least").alias("wanted"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("wide"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("high"), F.count("*").alias("n"))
    outline = F.col("wide") * F.col("high")
    cases = [(F.col("wanted") > outline + 1e-9, "infeasible", "least areas exceed the outline"), (F.least("wide", "high") < 2, "infeasible", "the outline is narrower than a room"), (F.col("n") * 4 > outline, "unknown", "widths leave no certain place")]
    verdict, text = F.lit("feasible"), F.lit("")
    for test, v, t in reversed(cases):
        verdict, text = F.when(test, v).otherwise(verdict), F.when(test, t).otherwise(text)
    return p.select("plan_id", "wanted", outline.alias("outline"), verdict.alias("verdict"), text.alias("explanation"))


NEAR = f"""{ROOMS}, j AS (SELECT plan_id, room_id, x + CAST(part_id % 3 AS DOUBLE) * 0.009 AS x, y, w, h FROM rooms), c AS (SELECT plan_id, count(*) AS n FROM j GROUP BY 1),
near AS (SELECT a.plan_id, b.plan_id AS other, max(greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.w - b.w), abs(a.h - b.h))) AS distance, count(*) AS k, any_value(ca.n) AS n FROM j a JOIN c ca ON ca.plan_id = a.plan_id JOIN j b ON b.room_id = a.room_id AND b.plan_id > a.plan_id
  AND abs(a.x - b.x) <= 0.02 AND a.y = b.y AND a.w = b.w AND a.h = b.h JOIN c cb ON cb.plan_id = b.plan_id AND cb.n = ca.n GROUP BY 1, 2)"""


def _near_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooms = derived.rooms(spark, sf_dir).withColumn("x", F.col("x") + (F.col("part_id") % 3).cast("double") * 0.009)
    return tiling.near_duplicates(rooms, 0.02)


@query(f"WITH {NEAR} SELECT plan_id, other, round(distance, 6) AS distance FROM near WHERE k = n")
def near_duplicate_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_near_plans(spark, sf_dir))


@query(f"""WITH {NEAR}, s AS (SELECT plan_id, CASE WHEN substr(md5('3:' || CAST(plan_id AS VARCHAR)), 1, 1) < 'a' THEN 'train' ELSE 'test' END AS part FROM c)
SELECT m.plan_id, other, a.part AS part, b.part AS other_part FROM near m JOIN s a ON a.plan_id = m.plan_id JOIN s b ON b.plan_id = m.other WHERE k = n AND a.part <> b.part""")
def cross_split_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates whose plans are in different sets."""
    part = lambda c: F.when(F.substring(F.md5(F.concat(F.lit("3:"), F.col(c).cast("string"))), 1, 1) < "a", "train").otherwise("test")
    return _near_plans(spark, sf_dir).select("plan_id", "other", part("plan_id").alias("part"), part("other").alias("other_part")).where("part <> other_part")


@query(f"""WITH RECURSIVE {NEAR}, pairs AS (SELECT plan_id AS a, other AS b FROM near WHERE k = n), twoway AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT plan_id AS a, plan_id AS b FROM c UNION SELECT r.a, s.b FROM reach r JOIN twoway s ON s.a = r.b), g AS (SELECT a AS plan_id, min(b) AS group_id FROM reach GROUP BY 1),
f AS (SELECT plan_id, string_agg(room_id || '|' || x || '|' || y || '|' || w || '|' || h, ';' ORDER BY room_id) AS f FROM j GROUP BY 1), e AS (SELECT plan_id, min(plan_id) OVER (PARTITION BY f) AS class_id, count(*) OVER (PARTITION BY f) AS copies FROM f)
SELECT plan_id, class_id, copies, coalesce(n_links, 0) AS n_links, group_id FROM e JOIN g USING (plan_id) LEFT JOIN (SELECT a AS plan_id, count(*) AS n_links FROM twoway GROUP BY 1) USING (plan_id)""")
def near_duplicate_plan_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates as classes of equal plans and groups of linked ones: a row a plan, whatever the number of copies."""
    rooms = derived.rooms(spark, sf_dir).withColumn("x", F.col("x") + (F.col("part_id") % 3).cast("double") * 0.009)
    return tiling.near_duplicate_groups(rooms, 0.02)


@query()
def near_duplicate_outline_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates in which plans of different rooms are compared, too, by their outlines."""
    rooms = derived.rooms(spark, sf_dir).withColumn("x", F.col("x") + (F.col("part_id") % 3).cast("double") * 0.009)
    return tiling.near_duplicate_groups(rooms, 0.02, outlines=True)
