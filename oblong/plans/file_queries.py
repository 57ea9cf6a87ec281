"""Files written from the given tables and read again: corpora with their conversion, plan documents, splits, generated plans, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oblong.plans import derived
from oblong.plans.derived import ROOMS, RUNS, WALLS
from oblong.plans.registry import query
from oblong.sources import exports, layout_files, sinks
from oblong.sources.scratch import folder
from oblong.sources.tables import table

#: One apartment an order, turned by a multiple of five degrees, its rooms a tenth of a metre apart. Of nine, three are sound, the second
#: of them with an L-shaped room; the others have one fault each.
DRAWN = """drawn AS (
  SELECT o_orderkey AS plan_id, CAST(o_orderkey % 9 AS BIGINT) AS fault, CAST(2 + o_orderkey % 3 AS BIGINT) AS nx, CAST(2 + o_custkey % 2 AS BIGINT) AS ny,
         list_sum(list_transform(range(2 + o_orderkey % 3), lambda i: 3 + (o_orderkey + i) % 3)) AS width, list_sum(list_transform(range(2 + o_custkey % 2), lambda j: 3 + (o_custkey + j) % 2)) AS height FROM orders)"""
REASON = "CASE fault WHEN 3 THEN 'unreadable wkt' WHEN 4 THEN 'no habitable room' WHEN 5 THEN 'room not axis-aligned' WHEN 6 THEN 'outline not simple' WHEN 7 THEN 'degenerate re-snapping' WHEN 8 THEN 'room degenerate after snapping to axes' END"


def _polygon(corners: list[tuple[Column, Column]], degrees: Column) -> Column:
    """WKT of a ring turned about the origin."""
    s, c = F.sin(F.radians(degrees)), F.cos(F.radians(degrees))
    at = [F.format_string("%.9f %.9f", x * c - y * s, x * s + y * c) for x, y in [*corners, corners[0]]]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *at), F.lit("))"))


def _box(x0: Column, y0: Column, x1: Column, y1: Column) -> list[tuple[Column, Column]]:
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def drawn_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a corpus file for the apartments above."""
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    plans = table(spark, sf_dir, "orders").select(order, customer, (2 + order % 3).cast("int").alias("nx"), (2 + customer % 2).cast("int").alias("ny"), (order % 9).alias("fault"), ((order % 9) * 5).cast("double").alias("deg"))
    wide = lambda i: (3 + (order + i) % 3).cast("double")
    high = lambda j: (3 + (customer + j) % 2).cast("double")
    upto = lambda n, size: F.aggregate(F.sequence(F.lit(0), n), F.lit(0.0), lambda t, i: t + F.when(i < n, size(i)).otherwise(0.0))
    number = lambda v: F.lit(float(v))
    base = plans.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("nx") * F.col("ny") - 1))).withColumn("i", (F.col("k") % F.col("nx")).cast("int")).withColumn("j", F.floor(F.col("k") / F.col("nx")).cast("int"))
    x, y = upto(F.col("i"), wide), upto(F.col("j"), high)
    room = _polygon(_box(x + 0.05, y + 0.05, x + wide(F.col("i")) - 0.05, y + high(F.col("j")) - 0.05), F.col("deg"))
    zero, one = F.lit(0), F.lit(1)
    bend = [(number(0.05), number(0.05)), (wide(zero) + wide(one) - 0.05, number(0.05)), (wide(zero) + wide(one) - 0.05, high(zero) - 0.05), (wide(zero) - 0.05, high(zero) - 0.05), (wide(zero) - 0.05, high(zero) + high(one) - 0.05), (number(0.05), high(zero) + high(one) - 0.05)]
    first, bent = F.col("k") == 0, F.col("fault") == 1
    shape = F.when(first & bent, _polygon(bend, F.col("deg"))).when(first & (F.col("fault") == 3), "POLYGON ((0 0, 1").otherwise(room)
    rooms = base.where(~(bent & (((F.col("i") == 1) & (F.col("j") == 0)) | ((F.col("i") == 0) & (F.col("j") == 1))))).select(order, customer, "k", F.lit("area").alias("kind"), F.when(F.col("fault") == 4, "BALCONY").otherwise("ROOM").alias("sub"), shape.alias("geom"))
    far = {
        5: [(number(-9), number(-9)), (number(-5), number(-9)), (number(-5), number(-6)), (number(-7), number(-4.5)), (number(-9), number(-6))], 6: _box(number(-40), number(-40), number(-36), number(-37)),
        7: _box(number(-9), number(1), number(-8.96), number(4)), 8: [(number(-9), number(0)), (number(-6), number(3)), (number(-6), number(0)), (number(-9), number(3))],
    }
    more = F.lit(None).cast("string")
    for fault, ring in far.items():
        more = F.when(F.col("fault") == fault, _polygon(ring, F.col("deg"))).otherwise(more)
    width = upto(F.col("nx"), wide)
    fixed = [("area", "KITCHEN", more), ("separator", "WALL", _polygon(_box(number(0), number(-0.2), width, number(0)), F.col("deg"))), ("opening", "WINDOW", _polygon(_box(number(0.5), number(-0.2), number(1.5), number(0)), F.col("deg"))), ("opening", "DOOR", F.lit("POINT (0 0)"))]
    others = plans.select(order, customer, F.explode(F.array(*[F.struct(F.lit(100 + n).alias("k"), F.lit(kind).alias("kind"), F.lit(sub).alias("sub"), geom.alias("geom")) for n, (kind, sub, geom) in enumerate(fixed)])).alias("e")).select(order, customer, "e.*").where("geom IS NOT NULL")
    entities = rooms.unionByName(others)
    return entities.select(order.cast("string").alias("apartment_id"), F.col("kind").alias("entity_type"), F.col("sub").alias("entity_subtype"), "geom", F.format_string("%d.0", F.col("k")).alias("area_id"), customer.cast("string").alias("site_id"))


def _converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "corpus")
    sinks.write_rows(drawn_corpus(spark, sf_dir), path)
    return layout_files.converted(layout_files.read_corpus(spark, path))


@query(f"""WITH {DRAWN}
SELECT CAST(plan_id AS VARCHAR) AS apartment_id, {REASON} AS reason, CASE WHEN fault < 3 THEN CAST(fault * 5 AS DOUBLE) END AS angle,
       CASE WHEN fault < 3 THEN nx * ny - CASE WHEN fault = 1 THEN 1 ELSE 0 END END AS rectangles, CASE WHEN fault < 3 THEN nx * ny - CASE WHEN fault = 1 THEN 2 ELSE 0 END END AS rooms,
       CAST(CASE WHEN fault < 3 THEN 4 END AS BIGINT) AS corners, CASE WHEN fault < 3 THEN round((CAST(width AS DOUBLE) - 0.1) * (CAST(height AS DOUBLE) - 0.1), 4) END AS area, CASE WHEN fault < 3 THEN round(1 / width, 4) END AS place FROM drawn""")
def corpus_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus file written and read again, and every apartment turned back, straightened, stitched and cut into rectangles, or rejected."""
    found = _converted(spark, sf_dir)
    size = F.aggregate("rooms", F.lit(0.0), lambda t, r: t + r["w"] * r["h"])
    count = lambda c, by=1: F.when(F.col("reason").isNull(), F.floor(F.size(c) / by))
    angle = F.pmod(F.round("angle", 4), F.lit(90.0))
    return found.select("apartment_id", "reason", angle.alias("angle"), count("rooms").alias("rectangles"), count(F.array_distinct(F.transform("rooms", lambda r: r["source"]))).alias("rooms"), count("outline", 2).alias("corners"), F.round(size, 4).alias("area"), F.round(F.col("openings")[0]["s"], 4).alias("place"))


@query(f"WITH {DRAWN} SELECT {REASON} AS reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM drawn GROUP BY 1")
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many apartments were kept, and the others by the first reason against them."""
    return layout_files.conversion_statistics(_converted(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query(f"WITH {ROOMS} SELECT plan_id, room_id, 'bedroom' AS room_type, x, y, w, h FROM rooms")
def plan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan documents written, one a line, and read again, and their rooms as a long table; rooms are named by plan and number."""
    one = F.struct(F.format_string("%d:%d", "plan_id", "room_id").alias("id"), F.lit("bedroom").alias("type"), "x", "y", "w", "h")
    plans = derived.rooms(spark, sf_dir).groupBy("plan_id").agg(F.array_sort(F.collect_list(one)).alias("rooms"))
    corner = F.expr("array(named_struct('x', 0.0D, 'y', 0.0D), named_struct('x', 24.0D, 'y', 0.0D), named_struct('x', 24.0D, 'y', 18.0D), named_struct('x', 0.0D, 'y', 18.0D))")
    walls = F.expr("cast(array() as array<struct<id:string,a:array<double>,b:array<double>,load_bearing:boolean,thickness:double>>)")
    openings = F.expr("cast(array() as array<struct<id:string,wall_id:string,s:double,relative_width:double,sill_height:double,head_height:double>>)")
    path = folder(spark, "plans")
    sinks.write_plans(plans.withColumns({"outline": corner, "walls": walls, "openings": openings}), path)
    rooms = layout_files.plan_rooms(layout_files.range_violations(layout_files.read_plans(spark, path, lines=True)).where("problem IS NULL AND size(violations) = 0"))
    name = F.split("room_id", ":")
    return rooms.select(name[0].cast("long").alias("plan_id"), name[1].cast("long").alias("room_id"), "room_type", "x", "y", "w", "h")


@query(f"WITH {RUNS} SELECT CAST(run_id AS VARCHAR) AS id, CASE run_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'calibration' ELSE 'train' END AS part FROM runs")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split written as three id lists, with comments and blank lines, and read again."""
    path, ids = folder(spark, "split"), derived.runs(spark, sf_dir).select("run_id")
    part = F.when(F.col("run_id") % 5 == 0, "test").when(F.col("run_id") % 5 == 1, "calibration").otherwise("train")
    lines = ids.select(part.alias("part"), F.when(F.col("run_id") % 7 == 0, F.format_string("# next\n\n %d ", F.col("run_id"))).otherwise(F.col("run_id").cast("string")).alias("value"))
    for name in ("train", "calibration", "test"):
        lines.where(F.col("part") == name).select("value").write.text(f"{path}/{name}.txt")
    return layout_files.read_split(spark, path)


@query(f"WITH {ROOMS} SELECT CAST(plan_id AS VARCHAR) AS plan_id, room_id, 'room' AS room_type, x / 4 AS x, y / 4 AS y, w / 4 AS w, h / 4 AS h FROM rooms")
def generated_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated plans written as JSON lines with polygons, and read again as boxes at a scale."""
    x, y, w, h = (F.col(c) for c in "xywh")
    piece = F.struct("room_id", F.lit("room").alias("type"), F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y + h)).alias("coins"))
    plans = derived.rooms(spark, sf_dir).groupBy("plan_id").agg(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p.dropFields("room_id")).alias("pieces"))
    path = folder(spark, "generated")
    plans.select(F.col("plan_id").cast("string").alias("id"), F.array(F.lit("room")).alias("programme"), "pieces").write.json(path)
    return layout_files.read_generated(spark, path, 0.25)


def _wall_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.col("horizontal")
    end = lambda c: (F.when(flat, F.col(c)).otherwise(F.col("place")), F.when(flat, F.col("place")).otherwise(F.col(c)))
    (ax, ay), (bx, by) = end("low"), end("high")
    return derived.walls(spark, sf_dir).select("plan_id", "wall_id", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))


_LINES = f"{ROOMS}, {WALLS}, l AS (SELECT plan_id, wall_id, CASE WHEN horizontal THEN low ELSE place END AS ax, CASE WHEN horizontal THEN place ELSE low END AS ay, CASE WHEN horizontal THEN high ELSE place END AS bx, CASE WHEN horizontal THEN place ELSE high END AS by_ FROM walls)"
_BAD = "bad AS (SELECT a.plan_id, list_sort(list(DISTINCT 'overlap:' || a.room_id || '|' || b.room_id)) AS p FROM rooms a JOIN rooms b ON a.plan_id = b.plan_id AND a.room_id < b.room_id AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h GROUP BY 1)"


@query(f"""WITH {_LINES}, {_BAD},
r AS (SELECT plan_id, string_agg(concat_ws(chr(10), '0', 'LWPOLYLINE', '8', room_id, '90', '4', '70', '1', '10', printf('%.6f', x), '20', printf('%.6f', y), '10', printf('%.6f', x + w), '20', printf('%.6f', y), '10', printf('%.6f', x + w), '20', printf('%.6f', y + h), '10', printf('%.6f', x), '20', printf('%.6f', y + h)), chr(10) ORDER BY room_id) AS t FROM rooms GROUP BY 1),
w AS (SELECT plan_id, string_agg(concat_ws(chr(10), '0', 'LINE', '8', wall_id, '10', printf('%.6f', ax), '20', printf('%.6f', ay), '11', printf('%.6f', bx), '21', printf('%.6f', by_)), chr(10) ORDER BY wall_id) AS t FROM l GROUP BY 1)
SELECT plan_id, coalesce(len(p), 0) AS pathologies, CASE WHEN p IS NULL THEN md5(concat_ws(chr(10), '0', 'SECTION', '2', 'HEADER', '0', 'ENDSEC', '0', 'SECTION', '2', 'ENTITIES', r.t, w.t, '0', 'ENDSEC', '0', 'EOF') || chr(10)) END AS digest FROM r JOIN w USING (plan_id) LEFT JOIN bad USING (plan_id)""")
def dxf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The DXF text of every plan that may be exported, by its digest; overlapping rooms are refused."""
    return exports.dxf(derived.rooms(spark, sf_dir), _wall_lines(spark, sf_dir)).select("plan_id", F.size("pathologies").cast("long").alias("pathologies"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"""WITH {_LINES}, {_BAD}, s AS (SELECT plan_id, count(*) AS spaces, first(x + w / 2 ORDER BY room_id) AS cx FROM rooms GROUP BY 1)
SELECT plan_id, CASE WHEN p IS NULL THEN spaces END AS spaces, CAST(CASE WHEN p IS NULL THEN 4 END AS BIGINT) AS walls, CASE WHEN p IS NULL THEN printf('%.6f', cx) END AS first_x,
       CASE WHEN p IS NULL THEN '0' || left(translate(to_base64(unhex(md5(plan_id || ':room:1'))), '+/=', '_$'), 21) END AS first_id FROM s LEFT JOIN bad USING (plan_id)""")
def ifc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in the IFC text of every plan that may be exported: spaces, walls, and the first room's place and identifier."""
    texts = exports.ifc(derived.rooms(spark, sf_dir), _wall_lines(spark, sf_dir))
    found = lambda p: F.when(F.col("text").isNotNull(), F.regexp_count("text", F.lit(p)).cast("long"))
    told = lambda p: F.when(F.col("text").isNotNull(), F.regexp_extract("text", p, 1))
    return texts.select("plan_id", found("=IFCSPACE").alias("spaces"), found("=IFCWALL").alias("walls"), told(r"#100=IFCCARTESIANPOINT\(\(([^,]*),").alias("first_x"), told(r"#104=IFCSPACE\('([^']*)'").alias("first_id"))


@query(f"WITH {ROOMS} SELECT plan_id, room_id, x, y, w, h FROM rooms")
def row_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms written as CSV rows with a header and read again."""
    path = folder(spark, "rows")
    sinks.write_rows(derived.rooms(spark, sf_dir).select("plan_id", "room_id", "x", "y", "w", "h"), path)
    return spark.read.option("header", True).schema("plan_id long, room_id long, x double, y double, w double, h double").csv(path)


@query(f"""WITH {ROOMS}, v AS (SELECT CAST(plan_id AS VARCHAR) AS apartment_id, CAST(part_id AS VARCHAR) AS area_id, w * 2 + room_id AS value, w * h AS area, room_id FROM rooms WHERE room_id % 5 <> 0)
SELECT apartment_id, area_id, max_by(value, room_id) AS value, max_by(area, room_id) AS area FROM v GROUP BY 1, 2""")
def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated labels of areas written as CSV and read again: rows that are no numbers go, the last row of an area wins."""
    rooms = derived.rooms(spark, sf_dir)
    odd = F.col("room_id") % 5 == 0
    rows = rooms.select(F.col("plan_id").cast("string").alias("apartment_id"), F.format_string("%d.0", "part_id").alias("area_id"), F.when(odd, "none").otherwise((F.col("w") * 2 + F.col("room_id")).cast("string")).alias("sun_mean"), (F.col("w") * F.col("h")).alias("layout_area"), "plan_id", "room_id")
    path = folder(spark, "labels")
    # One plan's rows stand in one file, in the order of its rooms: which is the last is told by the file.
    rows.repartition(4, "plan_id").sortWithinPartitions("plan_id", "room_id").drop("plan_id", "room_id").write.option("header", True).csv(path)
    return layout_files.read_labels(spark, path, "sun_mean")


@query(f"WITH {ROOMS} SELECT CAST(plan_id AS VARCHAR) AS apartment_id, CAST(room_id AS VARCHAR) AS area_id, printf('%.3f', w / 3) AS sun, CASE WHEN part_id % 2 = 0 THEN 'a, \"b\"' ELSE 'é' END AS note FROM rooms")
def simulation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulations written as CSV, with quotes, commas and letters beyond ASCII, and read again as texts."""
    note = F.when(F.col("part_id") % 2 == 0, 'a, "b"').otherwise("é")
    rows = derived.rooms(spark, sf_dir).select(F.col("plan_id").cast("string").alias("apartment_id"), F.col("room_id").cast("string").alias("area_id"), F.format_string("%.3f", F.col("w") / 3).alias("sun"), note.alias("note"))
    path = folder(spark, "simulations")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return layout_files.read_simulations(spark, path)


@query(f"""WITH {ROOMS}, p AS (SELECT plan_id, CAST(max(x + w) AS BIGINT) AS wide, CAST(max(y + h) AS BIGINT) AS high FROM rooms GROUP BY 1),
b AS (SELECT plan_id, string_agg('<rect x="' || CAST(40 * x AS BIGINT) || '" y="' || CAST(40 * (high - y - h) AS BIGINT) || '" width="' || CAST(40 * w AS BIGINT) || '" height="' || CAST(40 * h AS BIGINT) || '" fill="none" stroke="black"><title>' || room_id || '</title></rect>', '' ORDER BY room_id) AS boxes FROM rooms JOIN p USING (plan_id) GROUP BY 1)
SELECT plan_id, md5('<svg xmlns="http://www.w3.org/2000/svg" width="' || 40 * wide || '" height="' || 40 * high || '">' || boxes || '</svg>') AS digest FROM b JOIN p USING (plan_id)""")
def svg_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawing of every plan, by its digest."""
    return sinks.svg(derived.rooms(spark, sf_dir)).select("plan_id", F.md5(F.col("svg").cast("binary")).alias("digest"))


@query(f"""WITH {ROOMS} SELECT plan_id, CAST(2 * count(*) AS BIGINT) AS boxes, CAST(80 * (max(x + w) + 1) AS BIGINT) AS width, CAST(40 * (max(y + h) + 1) AS BIGINT) AS height FROM rooms GROUP BY 1""")
def svg_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every plan beside itself a metre narrower, at one scale: boxes and size of the drawing."""
    rooms = derived.rooms(spark, sf_dir)
    drawn = sinks.svg_compare(rooms, rooms.withColumn("w", F.greatest(F.col("w") - 1, F.lit(0.5))))
    size = lambda name: F.regexp_extract("svg", f'^<svg[^>]* {name}="([0-9]+)"', 1).cast("long")
    return drawn.select("plan_id", F.regexp_count("svg", F.lit("<rect")).cast("long").alias("boxes"), size("width").alias("width"), size("height").alias("height"))


@query(f"WITH {ROOMS} SELECT count(DISTINCT plan_id) AS plans, count(*) AS rooms, sum(w * h) AS area FROM rooms")
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of a run, written as one line of sorted JSON and read again."""
    found = derived.rooms(spark, sf_dir).agg(F.countDistinct("plan_id").alias("plans"), F.count("*").alias("rooms"), F.sum(F.col("w") * F.col("h")).alias("area")).first()
    path = folder(spark, "record")
    sinks.write_record(spark, path, found.asDict())
    return spark.read.schema("plans long, rooms long, area double").json(path)
