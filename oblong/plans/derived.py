"""Layout tables derived from the star-schema tables, the same in Spark and in SQL.

rooms: one axis-aligned rectangle a line item, plans are orders. walls: four segments a plan. openings: one a room, on a wall of
its plan that may not exist. runs: one repair attempt an order. measures: a prediction, a truth and a spread for each line item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oblong.sources.tables import table

#: Room types by part type, and the least area of each.
ROOM_TYPES = {"ECONOMY": "bathroom", "STANDARD": "bedroom", "SMALL": "toilet", "MEDIUM": "kitchen", "LARGE": "living_room", "PROMO": "corridor"}
LEAST_AREA = {"bathroom": 3.0, "bedroom": 6.0, "toilet": 1.0, "kitchen": 5.0, "living_room": 9.0}
LEAST_WIDTH = 2.0
#: Statuses of repair runs by order priority.
STATUSES = {"1-URGENT": "ok", "2-HIGH": "ok", "3-MEDIUM": "infeasible", "4-NOT SPECIFIED": "grid", "5-LOW": "refused"}

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]

ROOMS = """rooms AS (
  SELECT l_orderkey AS plan_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS room_id,
         l_partkey AS part_id, l_suppkey AS supp_id, l_linenumber AS line,
         CAST(l_partkey % 12 AS DOUBLE) AS x, CAST(l_suppkey % 9 AS DOUBLE) AS y,
         CAST(1 + l_partkey % 5 AS DOUBLE) AS w, CAST(1 + l_suppkey % 4 AS DOUBLE) AS h
  FROM lineitem)"""

TYPES = "types AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in ROOM_TYPES.items()) + ") v(p_type, room_type))"
REGULATION = "regulation AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in LEAST_AREA.items()) + ") v(room_type, least_area))"
TYPED = f"""{ROOMS}, {TYPES}, {REGULATION},
typed AS (SELECT r.*, t.room_type FROM rooms r JOIN part p ON p.p_partkey = r.part_id JOIN types t ON t.p_type = split_part(p.p_type, ' ', 1))"""

WALLS = """walls AS (
  SELECT o_orderkey AS plan_id, CAST(k AS BIGINT) AS wall_id, k % 2 = 0 AS horizontal, CAST((o_orderkey + 3 * k) % 12 AS DOUBLE) AS place,
         CAST(o_custkey % 3 AS DOUBLE) AS low, CAST(o_custkey % 3 + 3 + o_orderkey % 5 AS DOUBLE) AS high, k = 0 AS load_bearing
  FROM orders, (SELECT unnest([0, 1, 2, 3]) AS k))"""

OPENINGS = f"""{ROOMS}, {WALLS}, openings AS (
  SELECT plan_id, room_id AS opening_id, supp_id % 5 AS wall_id, CAST(part_id % 10 AS DOUBLE) / 10 AS s,
         CAST(1 + line % 5 AS DOUBLE) / 10 AS relative_width, CAST(supp_id % 3 AS DOUBLE) / 2 AS sill, 1 + CAST(part_id % 3 AS DOUBLE) / 2 AS head
  FROM rooms)"""

RUNS = """statuses AS (SELECT * FROM (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in STATUSES.items()) + """) v(o_orderpriority, status)),
runs AS (
  SELECT o_orderkey AS run_id, o_custkey AS source, CASE o_orderstatus WHEN 'F' THEN 'plain' WHEN 'O' THEN 'tiling' ELSE 'fallback' END AS strategy,
         CAST(o_orderkey % 4 AS BIGINT) AS amplitude, s.status, CAST(o_orderkey % 100 AS DOUBLE) / 200 AS moved, o_totalprice AS cost
  FROM orders o JOIN statuses s USING (o_orderpriority))"""

MEASURES = f"""{ROOMS}, measures AS (
  SELECT l_orderkey AS plan_id, l_suppkey AS cluster, l_returnflag AS kind, l_linestatus AS state, CAST((l_partkey * 7) % 360 AS DOUBLE) AS deg,
         l_extendedprice * (1 - l_discount) AS prediction, l_extendedprice AS truth, 1 + l_quantity AS spread,
         l_linenumber AS line, l_partkey AS part_id, l_quantity AS quantity
  FROM lineitem)"""


def _mapped(column: F.Column, values: dict) -> F.Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("plan_id"), number.alias("room_id"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supp_id"), F.col("l_linenumber").alias("line"),
        (F.col("l_partkey") % 12).cast("double").alias("x"), (F.col("l_suppkey") % 9).cast("double").alias("y"),
        (1 + F.col("l_partkey") % 5).cast("double").alias("w"), (1 + F.col("l_suppkey") % 4).cast("double").alias("h"),
    )


def typed_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms with their type; the part table joins on its key, and Spark broadcasts it only while it is small."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), _mapped(F.split("p_type", " ")[0], ROOM_TYPES).alias("room_type"))
    return rooms(spark, sf_dir).join(parts.where("room_type IS NOT NULL"), "part_id")


def least_area(room_type: F.Column) -> F.Column:
    """The regulation's least area of a type, or null where it names none."""
    return _mapped(room_type, LEAST_AREA)


def walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k"))
    return orders.select(
        F.col("o_orderkey").alias("plan_id"), F.col("k").cast("long").alias("wall_id"), (F.col("k") % 2 == 0).alias("horizontal"), ((F.col("o_orderkey") + 3 * F.col("k")) % 12).cast("double").alias("place"),
        (F.col("o_custkey") % 3).cast("double").alias("low"), (F.col("o_custkey") % 3 + 3 + F.col("o_orderkey") % 5).cast("double").alias("high"), (F.col("k") == 0).alias("load_bearing"),
    )


def openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rooms(spark, sf_dir).select(
        "plan_id", F.col("room_id").alias("opening_id"), (F.col("supp_id") % 5).alias("wall_id"), ((F.col("part_id") % 10).cast("double") / 10).alias("s"),
        ((1 + F.col("line") % 5).cast("double") / 10).alias("relative_width"), ((F.col("supp_id") % 3).cast("double") / 2).alias("sill"), (1 + (F.col("part_id") % 3).cast("double") / 2).alias("head"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    strategy = F.when(F.col("o_orderstatus") == "F", "plain").when(F.col("o_orderstatus") == "O", "tiling").otherwise("fallback")
    out = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("source"), strategy.alias("strategy"), (F.col("o_orderkey") % 4).alias("amplitude"),
        _mapped(F.col("o_orderpriority"), STATUSES).alias("status"), ((F.col("o_orderkey") % 100).cast("double") / 200).alias("moved"), F.col("o_totalprice").alias("cost"),
    )
    return out.where("status IS NOT NULL")


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("plan_id"), F.col("l_suppkey").alias("cluster"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("state"), ((F.col("l_partkey") * 7) % 360).cast("double").alias("deg"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("prediction"), F.col("l_extendedprice").alias("truth"), (1 + F.col("l_quantity")).alias("spread"),
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_id"), F.col("l_quantity").alias("quantity"),
    )
