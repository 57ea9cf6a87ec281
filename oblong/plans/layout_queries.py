"""Queries over rooms, walls and openings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oblong.functions import scoring
from oblong.operators import layouts
from oblong.plans import derived
from oblong.plans.derived import OPENINGS, ROOMS, TYPED, WALLS
from oblong.plans.registry import query, rounded

PAIRS = f"""{ROOMS}, pairs AS (
  SELECT a.plan_id, a.room_id AS a_room_id, b.room_id AS b_room_id, a.x ax, a.y ay, a.w aw, a.h ah, b.x bx, b.y "by", b.w bw, b.h bh,
         greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) AS dx, greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS dy
  FROM rooms a JOIN rooms b ON a.plan_id = b.plan_id AND a.room_id < b.room_id)"""


@query(f"WITH {PAIRS} SELECT plan_id, a_room_id, b_room_id, dx * dy AS area FROM pairs WHERE dx * dy > 1e-9")
def room_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.overlaps(derived.rooms(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT plan_id, count(*) AS n_pairs, round(sum(dx * dy), 6) AS area, max(dx * dy) AS worst FROM pairs WHERE dx * dy > 1e-9 GROUP BY plan_id")
def overlap_per_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layouts.overlaps(derived.rooms(spark, sf_dir))
    return rounded(found.groupBy("plan_id").agg(F.count("*").alias("n_pairs"), F.sum("area").alias("area"), F.max("area").alias("worst")))


@query(f"""WITH {PAIRS}, s AS (SELECT plan_id, a_room_id, b_room_id,
  CASE WHEN abs(ax + aw - bx) < 1e-7 OR abs(bx + bw - ax) < 1e-7 THEN dy WHEN abs(ay + ah - "by") < 1e-7 OR abs("by" + bh - ay) < 1e-7 THEN dx END AS length FROM pairs)
SELECT * FROM s WHERE length > 0""")
def adjacency_shared_wall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.shared_walls(derived.rooms(spark, sf_dir))


@query(f"""WITH {PAIRS} SELECT plan_id, a_room_id, b_room_id FROM pairs
WHERE ((abs(ax + aw - bx) < 1e-7 OR abs(bx + bw - ax) < 1e-7) AND dy > 1e-7) OR ((abs(ay + ah - "by") < 1e-7 OR abs("by" + bh - ay) < 1e-7) AND dx > 1e-7)""")
def shared_edge_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = layouts.pair_spans(layouts.both(derived.rooms(spark, sf_dir)))
    touch = lambda axis, size: (F.abs(F.col(f"a_{axis}") + F.col(f"a_{size}") - F.col(f"b_{axis}")) < 1e-7) | (F.abs(F.col(f"b_{axis}") + F.col(f"b_{size}") - F.col(f"a_{axis}")) < 1e-7)
    return a.where((touch("x", "w") & (F.col("dy") > 1e-7)) | (touch("y", "h") & (F.col("dx") > 1e-7))).select("plan_id", "a_room_id", "b_room_id")


REQUIRED = "(VALUES ('kitchen', 'living_room'), ('bathroom', 'bedroom'))"


@query(f"""WITH {TYPED}, plans AS (SELECT DISTINCT plan_id FROM typed), required AS (SELECT * FROM {REQUIRED} r(type_a, type_b)),
found AS (SELECT DISTINCT a.plan_id, least(a.room_type, b.room_type) AS type_a, greatest(a.room_type, b.room_type) AS type_b FROM typed a JOIN typed b ON a.plan_id = b.plan_id AND a.room_id < b.room_id
  WHERE CASE WHEN abs(a.x + a.w - b.x) < 1e-7 OR abs(b.x + b.w - a.x) < 1e-7 THEN least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)
             WHEN abs(a.y + a.h - b.y) < 1e-7 OR abs(b.y + b.h - a.y) < 1e-7 THEN least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) END >= 0.8)
SELECT type_a, type_b, count(*) AS missing FROM (SELECT * FROM plans CROSS JOIN required) q WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.plan_id = q.plan_id AND f.type_a = q.type_a AND f.type_b = q.type_b) GROUP BY 1, 2""")
def required_adjacency_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many plans lack each required adjacency, at a door's width of 0.8."""
    rooms = derived.typed_rooms(spark, sf_dir)
    types = rooms.select("plan_id", "room_id", "room_type")
    links = layouts.shared_walls(rooms).where("length >= 0.8")
    named = links.join(types.select("plan_id", F.col("room_id").alias("a_room_id"), F.col("room_type").alias("a")), ["plan_id", "a_room_id"]).join(types.select("plan_id", F.col("room_id").alias("b_room_id"), F.col("room_type").alias("b")), ["plan_id", "b_room_id"])
    found = named.select("plan_id", F.least("a", "b").alias("type_a"), F.greatest("a", "b").alias("type_b")).distinct()
    required = F.array(*[F.struct(F.lit(a).alias("type_a"), F.lit(b).alias("type_b")) for a, b in (("kitchen", "living_room"), ("bathroom", "bedroom"))])
    wanted = rooms.select("plan_id").distinct().select("plan_id", F.explode(required).alias("r")).select("plan_id", "r.*")
    return wanted.join(found, ["plan_id", "type_a", "type_b"], "left_anti").groupBy("type_a", "type_b").agg(F.count("*").alias("missing"))


@query(f"""WITH {ROOMS}, box AS (SELECT plan_id, min(x) x0, min(y) y0, max(x + w) x1, max(y + h) y1 FROM rooms GROUP BY plan_id)
SELECT r.plan_id, room_id, h * (CASE WHEN abs(x - x0) < 1e-7 THEN 1 ELSE 0 END + CASE WHEN abs(x + w - x1) < 1e-7 THEN 1 ELSE 0 END) + w * (CASE WHEN abs(y - y0) < 1e-7 THEN 1 ELSE 0 END + CASE WHEN abs(y + h - y1) < 1e-7 THEN 1 ELSE 0 END) AS facade
FROM rooms r JOIN box b ON r.plan_id = b.plan_id""")
def facade_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.facades(derived.rooms(spark, sf_dir))


@query(f"""WITH {PAIRS}, g AS (SELECT *, greatest(bx - ax - aw, ax - bx - bw) AS gx, greatest("by" - ay - ah, ay - "by" - bh) AS gy, ax + aw / 2 AS cax, bx + bw / 2 AS cbx, ay + ah / 2 AS cay, "by" + bh / 2 AS cby FROM pairs),
e AS (SELECT *, CASE WHEN gx >= -1e-9 OR gy >= -1e-9 THEN gx >= gy ELSE abs(cbx - cax) >= abs(cby - cay) END AS across FROM g)
SELECT plan_id, CASE WHEN across THEN 'x' ELSE 'y' END AS axis, CASE WHEN (across AND cax <= cbx) OR (NOT across AND cay <= cby) THEN a_room_id ELSE b_room_id END AS src,
       CASE WHEN (across AND cax <= cbx) OR (NOT across AND cay <= cby) THEN b_room_id ELSE a_room_id END AS dst FROM e""")
def pairwise_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.pairwise_order(derived.rooms(spark, sf_dir))


@query(f"""WITH {ROOMS}, {WALLS}, c AS (SELECT r.plan_id, room_id, wall_id,
  CASE WHEN horizontal AND place > y + 1e-7 AND place < y + h - 1e-7 THEN least(x + w - 1e-7, high) - greatest(x + 1e-7, low)
       WHEN NOT horizontal AND place > x + 1e-7 AND place < x + w - 1e-7 THEN least(y + h - 1e-7, high) - greatest(y + 1e-7, low) END AS length
  FROM rooms r JOIN walls w2 ON r.plan_id = w2.plan_id WHERE load_bearing) SELECT plan_id, room_id, wall_id, round(length, 6) AS length FROM c WHERE length > 1e-7""")
def wall_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(layouts.crossings(derived.rooms(spark, sf_dir), derived.walls(spark, sf_dir)))


@query(f"WITH {OPENINGS} SELECT plan_id, opening_id, wall_id FROM openings o WHERE NOT EXISTS (SELECT 1 FROM walls w WHERE w.plan_id = o.plan_id AND w.wall_id = o.wall_id AND w.high - w.low > 1e-7)")
def orphan_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = derived.walls(spark, sf_dir).where(F.col("high") - F.col("low") > layouts.SNAP)
    return derived.openings(spark, sf_dir).join(real, ["plan_id", "wall_id"], "left_anti").select("plan_id", "opening_id", "wall_id")


EXTENTS = f"{OPENINGS}, extents AS (SELECT o.*, w.high - w.low AS length, s * (w.high - w.low) - relative_width * (w.high - w.low) / 2 AS start, s * (w.high - w.low) - relative_width * (w.high - w.low) / 2 + relative_width * (w.high - w.low) AS stop FROM openings o JOIN walls w ON w.plan_id = o.plan_id AND w.wall_id = o.wall_id)"


@query(f"WITH {EXTENTS} SELECT plan_id, opening_id, round(greatest(0, -start, stop - length), 6) AS overhang, sill >= 0 AND sill < head AS sill_ok FROM extents")
def openings_within_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layouts.opening_extents(derived.openings(spark, sf_dir), derived.walls(spark, sf_dir))
    return rounded(found.select("plan_id", "opening_id", "overhang", ((F.col("sill") >= 0) & (F.col("sill") < F.col("head"))).alias("sill_ok")))


@query(f"""WITH {EXTENTS} SELECT a.plan_id, a.wall_id, a.opening_id AS a_opening_id, b.opening_id AS b_opening_id, round(least(a.stop, b.stop) - greatest(a.start, b.start), 6) AS shared
FROM extents a JOIN extents b ON a.plan_id = b.plan_id AND a.wall_id = b.wall_id AND a.opening_id < b.opening_id WHERE least(a.stop, b.stop) - greatest(a.start, b.start) > 1e-7""")
def interval_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(layouts.opening_conflicts(layouts.opening_extents(derived.openings(spark, sf_dir), derived.walls(spark, sf_dir))))


AFTER = "after_ AS (SELECT plan_id, room_id, x + CASE WHEN part_id % 4 = 0 THEN 0.25 ELSE 0 END AS x, y, w + CASE WHEN supp_id % 6 = 0 THEN 0.5 ELSE 0 END AS w, h FROM rooms WHERE part_id % 7 <> 0)"


def _after(rooms: DataFrame) -> DataFrame:
    moved = rooms.where(F.col("part_id") % 7 != 0)
    return moved.select("plan_id", "room_id", (F.col("x") + F.when(F.col("part_id") % 4 == 0, 0.25).otherwise(0.0)).alias("x"), "y", (F.col("w") + F.when(F.col("supp_id") % 6 == 0, 0.5).otherwise(0.0)).alias("w"), "h")


CHANGES = f"{ROOMS}, {AFTER}, changes AS (SELECT coalesce(b.plan_id, a.plan_id) plan_id, coalesce(b.room_id, a.room_id) room_id, b.x x0, b.y y0, b.w w0, b.h h0, a.x x1, a.y y1, a.w w1, a.h h1 FROM rooms b FULL JOIN after_ a ON a.plan_id = b.plan_id AND a.room_id = b.room_id)"


@query(f"WITH {CHANGES} SELECT * FROM changes")
def room_changes_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooms = derived.rooms(spark, sf_dir)
    return layouts.room_changes(rooms, _after(rooms))


@query(f"""WITH {CHANGES} SELECT plan_id, coalesce(max(greatest(abs(x1 - x0), abs(y1 - y0), abs(w1 - w0), abs(h1 - h0))), 0) AS largest, coalesce(sum(abs(x1 - x0) + abs(y1 - y0) + abs(w1 - w0) + abs(h1 - h0)), 0) AS total,
count(*) FILTER (x0 IS NULL OR x1 IS NULL) AS unpaired FROM changes GROUP BY plan_id""")
def displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooms = derived.rooms(spark, sf_dir)
    return layouts.displacement(layouts.room_changes(rooms, _after(rooms)))


@query(f"""WITH {CHANGES}, d AS (SELECT plan_id, coalesce(max(greatest(abs(x1 - x0), abs(y1 - y0), abs(w1 - w0), abs(h1 - h0))), 0) AS largest FROM changes GROUP BY plan_id)
SELECT count(*) AS plans, count(*) FILTER (largest <= 0.25 + 1e-7) AS within_budget, count(*) FILTER (largest >= 0.25 - 1e-6) AS saturated FROM d""")
def budget_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooms = derived.rooms(spark, sf_dir)
    moved = layouts.displacement(layouts.room_changes(rooms, _after(rooms)))
    return moved.agg(F.count("*").alias("plans"), F.count_if(F.col("largest") <= 0.25 + 1e-7).alias("within_budget"), F.count_if(F.col("largest") >= 0.25 - 1e-6).alias("saturated"))


@query(f"""WITH {ROOMS}, v AS (SELECT DISTINCT plan_id, x FROM rooms), f AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY plan_id ORDER BY x) > 1.5 THEN 1 ELSE 0 END AS o FROM v),
g AS (SELECT plan_id, x, CAST(sum(o) OVER (PARTITION BY plan_id ORDER BY x) AS BIGINT) AS line FROM f) SELECT plan_id, line, round(avg(x), 6) AS coord, count(*) AS support FROM g GROUP BY 1, 2""")
def grid_lines_gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(layouts.grid_lines(derived.rooms(spark, sf_dir), ["plan_id"], "x", 1.5))


@query(f"""WITH RECURSIVE {ROOMS}, v AS (SELECT DISTINCT plan_id, x FROM rooms), n AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY x) i FROM v),
f AS (SELECT plan_id, i, x AS anchor, 1 AS n_groups FROM n WHERE i = 1 UNION ALL SELECT n.plan_id, n.i, CASE WHEN n.x - f.anchor > 2 THEN n.x ELSE f.anchor END, CASE WHEN n.x - f.anchor > 2 THEN f.n_groups + 1 ELSE f.n_groups END FROM f JOIN n ON n.plan_id = f.plan_id AND n.i = f.i + 1)
SELECT plan_id, CAST(max(n_groups) AS BIGINT) AS n_groups FROM f GROUP BY plan_id""")
def anchored_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.anchored_groups(derived.rooms(spark, sf_dir), ["plan_id"], "x", 2.0)


UNION_SQL = """SELECT *, CAST(sum(CASE WHEN high0 IS NULL OR low > high0 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island
  FROM (SELECT *, max(high) OVER (PARTITION BY {keys} ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high0 FROM {source}) q"""


@query(f"""WITH {ROOMS}, s AS (SELECT plan_id, x AS low, x + w AS high FROM rooms), i AS ({UNION_SQL.format(keys="plan_id", source="s")}),
j AS (SELECT plan_id, island, min(low) a, max(high) b FROM i GROUP BY 1, 2) SELECT plan_id, sum(b - a) AS covered FROM j GROUP BY 1""")
def interval_union_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.union_length(derived.rooms(spark, sf_dir).select("plan_id", F.col("x").alias("low"), (F.col("x") + F.col("w")).alias("high")), ["plan_id"], "low", "high")


@query(f"""WITH {ROOMS}, cuts AS (SELECT DISTINCT plan_id, x AS x0 FROM rooms UNION SELECT plan_id, x + w FROM rooms), slabs AS (SELECT *, lead(x0) OVER (PARTITION BY plan_id ORDER BY x0) AS x1 FROM cuts),
s AS (SELECT c.plan_id, x0, x1, y AS low, y + h AS high FROM slabs c JOIN rooms r ON r.plan_id = c.plan_id AND r.x <= c.x0 AND r.x + r.w >= c.x1), i AS ({UNION_SQL.format(keys="plan_id, x0, x1", source="s")}),
j AS (SELECT plan_id, x0, x1, island, min(low) a, max(high) b FROM i GROUP BY 1, 2, 3, 4) SELECT plan_id, sum((x1 - x0) * (b - a)) AS covered FROM j GROUP BY 1""")
def coverage_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.coverage(derived.rooms(spark, sf_dir))


@query(f"""WITH {TYPED}, m AS (SELECT t.*, coalesce(g.least_area, 0) AS least_area FROM typed t LEFT JOIN regulation g USING (room_type))
SELECT room_type, count(*) AS n, count(*) FILTER (w * h < least_area - 1e-9) AS too_small, round(min(w * h - least_area), 6) AS margin FROM m GROUP BY room_type""")
def min_area_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooms = derived.typed_rooms(spark, sf_dir).withColumn("least_area", F.coalesce(derived.least_area(F.col("room_type")), F.lit(0.0)))
    area = F.col("w") * F.col("h")
    return rounded(rooms.groupBy("room_type").agg(F.count("*").alias("n"), F.count_if(area < F.col("least_area") - 1e-9).alias("too_small"), F.min(area - F.col("least_area")).alias("margin")))


@query(f"WITH {TYPED} SELECT DISTINCT room_type FROM typed t WHERE NOT EXISTS (SELECT 1 FROM regulation g WHERE g.room_type = t.room_type)")
def unregulated_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.typed_rooms(spark, sf_dir).where(derived.least_area(F.col("room_type")).isNull()).select("room_type").distinct()


@query("SELECT l_orderkey AS plan_id, l_linenumber AS line, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.repeated_ids(derived.rooms(spark, sf_dir), ["plan_id", "line"])


CHECKS = f"""{TYPED}, p AS (SELECT t.plan_id, bool_and(w > 0 AND h > 0) AS finite, min(least(w, h)) AS side, min(w * h - g.least_area) AS margin, count(*) = count(DISTINCT room_id) AS uniq FROM typed t LEFT JOIN regulation g USING (room_type) GROUP BY 1),
o AS (SELECT a.plan_id, max(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))) AS worst FROM typed a JOIN typed b ON a.plan_id = b.plan_id AND a.room_id < b.room_id GROUP BY 1),
q AS (SELECT p.*, coalesce(o.worst, 0) AS worst FROM p LEFT JOIN o USING (plan_id)),
c AS (SELECT plan_id, 'finite' AS "check", finite AS ok, CAST(NULL AS DOUBLE) AS measure FROM q UNION ALL SELECT plan_id, 'unique_ids', uniq, NULL FROM q UNION ALL SELECT plan_id, 'not_degenerate', side > 1e-7, side FROM q
  UNION ALL SELECT plan_id, 'least_area', margin >= -1e-9, margin FROM q UNION ALL SELECT plan_id, 'least_width', side >= 2 - 1e-7, side FROM q UNION ALL SELECT plan_id, 'no_overlap', worst <= 1e-9, worst FROM q),
checks AS (SELECT plan_id, "check", CASE WHEN ok IS NULL THEN 'unknown' WHEN ok THEN 'satisfied' ELSE 'violated' END AS status, measure FROM c)"""


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooms = derived.typed_rooms(spark, sf_dir).withColumn("least_area", derived.least_area(F.col("room_type")))
    return layouts.checks(rooms, layouts.overlaps(rooms))


@query(f"WITH {CHECKS} SELECT * FROM checks")
def room_validity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir)


@query(f"""WITH {CHECKS}, v AS (SELECT plan_id, bool_and(status = 'satisfied') AS valid FROM checks GROUP BY 1) SELECT valid, count(*) AS plans FROM v GROUP BY 1""")
def plan_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir).groupBy("plan_id").agg(F.bool_and(F.col("status") == "satisfied").alias("valid")).groupBy("valid").agg(F.count("*").alias("plans"))


@query(f"""WITH {CHECKS}, r AS (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY plan_id) AS i, count(*) OVER (PARTITION BY "check") AS n FROM checks WHERE status = 'violated')
SELECT "check", max(n) AS n, string_agg(CAST(plan_id AS VARCHAR), ',' ORDER BY plan_id) FILTER (i <= 5) || CASE WHEN max(n) > 5 THEN ' (+' || CAST(max(n) - 5 AS VARCHAR) || ' more)' ELSE '' END AS listing FROM r GROUP BY 1""")
def offender_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five offenders of each check and how many more there are; only their ids are kept in each partial aggregate."""
    from oblong.operators import tables

    violated = _checks(spark, sf_dir).where("status = 'violated'")
    first = tables.top(violated, "check", [F.col("plan_id")], 5).groupBy("check").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("plan_id")), lambda v: v.cast("string"))).alias("ids"))
    counts = violated.groupBy("check").agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > 5, F.concat(F.lit(" (+"), (F.col("n") - 5).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    return counts.join(first, "check").select("check", "n", F.concat("ids", more).alias("listing"))


@query(f"""WITH {ROOMS}, c AS (SELECT count(*) n0, count(*) FILTER (w >= 2) n1, count(*) FILTER (w >= 2 AND h >= 2) n2, count(*) FILTER (w >= 2 AND h >= 2 AND x + w <= 12) n3 FROM rooms),
l AS (SELECT CAST(1 AS BIGINT) AS step, 'wide' AS name, n0 AS before, n1 AS after FROM c UNION ALL SELECT 2, 'high', n1, n2 FROM c UNION ALL SELECT 3, 'inside', n2, n3 FROM c) SELECT *, round(1 - after / before, 6) AS dropped FROM l""")
def filter_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(layouts.filter_log(derived.rooms(spark, sf_dir), {"wide": F.col("w") >= 2, "high": F.col("h") >= 2, "inside": F.col("x") + F.col("w") <= 12}))


SIN, COS = "sin(radians(deg))", "cos(radians(deg))"
EXPOSED = "list_extract([0.45, 0.55, 0.70, 0.90, 1.00, 0.90, 0.70, 0.55], CAST(floor(((deg + 22.5) % 360) / 45) AS BIGINT) % 8 + 1)"
SCORED = f"""{ROOMS}, d AS (SELECT *, CAST((plan_id * 7) % 360 AS DOUBLE) AS deg FROM rooms),
s AS (SELECT *, w * {COS} ** 2 + h * {SIN} ** 2 AS facade, w * {SIN} ** 2 + h * {COS} ** 2 AS depth, CAST({EXPOSED} AS DOUBLE) AS e FROM d),
a AS (SELECT *, facade * least(depth, 2.5 * 2.15 * e) * exp(0.15 * (-x * {SIN} - y * {COS})) AS analytic, 0.70 * 0.30 * 1.15 * facade * 65 * e / ((2 * w * h + 2 * (w + h) * 2.70) * 0.75) AS df FROM s)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooms = derived.rooms(spark, sf_dir).withColumn("deg", ((F.col("plan_id") * 7) % 360).cast("double"))
    columns = [F.col(c) for c in ("x", "y", "w", "h", "deg")]
    return rooms.withColumn("analytic", scoring.analytic(*columns)).withColumn("df", scoring.daylight_factor(*columns[2:])).withColumn("split_flux", scoring.split_flux(*columns))


@query(f"WITH {SCORED} SELECT plan_id, round(sum(analytic), 4) AS score FROM a GROUP BY plan_id")
def analytic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scored(spark, sf_dir).groupBy("plan_id").agg(F.sum("analytic").alias("score")), 4)


@query(f"WITH {SCORED} SELECT plan_id, round(sum(analytic + df * w * h), 4) AS score FROM a GROUP BY plan_id")
def split_flux_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scored(spark, sf_dir).groupBy("plan_id").agg(F.sum("split_flux").alias("score")), 4)


@query(f"WITH {SCORED} SELECT plan_id, room_id, round(analytic, 6) AS analytic, round(df, 6) AS daylight FROM a")
def room_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scored(spark, sf_dir).select("plan_id", "room_id", "analytic", F.col("df").alias("daylight")))


@query(f"WITH {SCORED}, p AS (SELECT plan_id, sum(analytic) v, 0.08 * sqrt(count(*)) sd FROM a GROUP BY 1) SELECT plan_id, round(v - 1.5 * sd, 4) AS pessimistic, round(2 + 0.5 * v, 4) AS affine FROM p")
def pessimistic_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _scored(spark, sf_dir).groupBy("plan_id").agg(F.sum("analytic").alias("v"), (0.08 * F.sqrt(F.count("*"))).alias("sd"))
    return rounded(p.select("plan_id", (F.col("v") - 1.5 * F.col("sd")).alias("pessimistic"), (2 + 0.5 * F.col("v")).alias("affine")), 4)
