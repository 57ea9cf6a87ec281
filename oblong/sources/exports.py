"""Plans as DXF and IFC text, one text a plan, and a sink that writes a file for each; pathological plans are refused.

Both formats are plain text, so a plan's text is put together by column expressions; identifiers are derived from names and the same
in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oblong.operators.layouts import overlaps


def pathologies(rooms: DataFrame, slack: float = 1e-7) -> DataFrame:
    """(plan_id, pathologies) of plans that must not be exported: flat rooms and overlapping ones, sorted."""
    flat = rooms.where((F.col("w") <= slack) | (F.col("h") <= slack)).select("plan_id", F.format_string("zero_edge:%s", F.col("room_id").cast("string")).alias("p"))
    pairs = overlaps(rooms).select("plan_id", F.format_string("overlap:%s|%s", F.col("a_room_id").cast("string"), F.col("b_room_id").cast("string")).alias("p"))
    return flat.unionByName(pairs).groupBy("plan_id").agg(F.array_sort(F.collect_set("p")).alias("pathologies"))


def _number(value: Column) -> Column:
    return F.format_string("%.6f", value)


def _in_order(rows: DataFrame, order: str, text: Column) -> DataFrame:
    """A plan's texts joined by line ends, in the order of a column."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), text.alias("t"))))
    return rows.groupBy("plan_id").agg(F.array_join(F.transform(held, lambda s: s["t"]), "\n").alias("t"))


def _assembled(rooms: DataFrame, walls: DataFrame, room: Column, wall: Column, head: Column, tail: Column) -> DataFrame:
    """(plan_id, pathologies, text): null text where the plan is refused."""
    of_rooms = _in_order(rooms, "room_id", room).withColumnRenamed("t", "rooms")
    of_walls = _in_order(walls, "wall_id", wall).withColumnRenamed("t", "walls")
    found = of_rooms.join(of_walls, "plan_id", "left").join(pathologies(rooms), "plan_id", "left")
    text = F.concat(F.concat_ws("\n", head, "rooms", "walls", tail), F.lit("\n"))
    bad = F.coalesce("pathologies", F.array().cast("array<string>"))
    return found.select("plan_id", bad.alias("pathologies"), F.when(F.size(bad) == 0, text).alias("text"))


def dxf(rooms: DataFrame, walls: DataFrame) -> DataFrame:
    """Rooms as closed polylines and walls as lines, each on a layer of its own name.

    ``rooms``: plan_id, room_id, x, y, w, h. ``walls``: plan_id, wall_id, ax, ay, bx, by.
    """
    x0, y0, x1, y1 = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    corners = [v for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1)) for v in (F.lit("10"), _number(x), F.lit("20"), _number(y))]
    room = F.concat_ws("\n", F.lit("0\nLWPOLYLINE\n8"), F.col("room_id").cast("string"), F.lit("90\n4\n70\n1"), *corners)
    ends = [v for code, c in (("10", "ax"), ("20", "ay"), ("11", "bx"), ("21", "by")) for v in (F.lit(code), _number(F.col(c)))]
    wall = F.concat_ws("\n", F.lit("0\nLINE\n8"), F.col("wall_id").cast("string"), *ends)
    return _assembled(rooms, walls, room, wall, F.lit("0\nSECTION\n2\nHEADER\n0\nENDSEC\n0\nSECTION\n2\nENTITIES"), F.lit("0\nENDSEC\n0\nEOF"))


def global_id(name: Column) -> Column:
    """22 characters of the alphabet of IFC, derived from a name."""
    return F.concat(F.lit("0"), F.substring(F.translate(F.base64(F.unhex(F.md5(name.cast("binary")))), "+/=", "_$"), 1, 21))


#: Entities are numbered in hundreds: a room's from 100 times its number on, a wall's from ten million on.
_WALLS = 10_000_000


def ifc(rooms: DataFrame, walls: DataFrame, height: float = 2.5) -> DataFrame:
    """Rooms as spaces with a rectangular profile, and walls with an axis, as IFC4 text. ``rooms`` and ``walls`` as for ``dxf``."""
    plan = F.col("plan_id").cast("string")
    at = lambda k: F.concat(F.lit("#"), (100 * F.col("room_id") + k).cast("string"))
    point = lambda x, y: F.concat(F.lit("=IFCCARTESIANPOINT(("), _number(x), F.lit(","), _number(y), F.lit("));"))
    middle = (F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2)
    room = F.concat_ws(
        "\n", F.concat(at(0), point(*middle)), F.concat(at(1), F.lit("=IFCAXIS2PLACEMENT2D("), at(0), F.lit(",$);")),
        F.concat(at(2), F.lit("=IFCRECTANGLEPROFILEDEF(.AREA.,$,"), at(1), F.lit(","), _number(F.col("w")), F.lit(","), _number(F.col("h")), F.lit(");")),
        F.concat(at(3), F.lit("=IFCEXTRUDEDAREASOLID("), at(2), F.lit(f",$,#9,{height:.6f});")),
        F.concat(at(4), F.lit("=IFCSPACE('"), global_id(F.concat(plan, F.lit(":room:"), F.col("room_id").cast("string"))), F.lit("',$,'"), F.col("room_id").cast("string"), F.lit("',$,$,$,$,$,.ELEMENT.,.INTERNAL.,$);")),
    )
    on = lambda k: F.concat(F.lit("#"), (_WALLS + 100 * F.col("wall_id") + k).cast("string"))
    wall = F.concat_ws(
        "\n", F.concat(on(0), point(F.col("ax"), F.col("ay"))), F.concat(on(1), point(F.col("bx"), F.col("by"))), F.concat(on(2), F.lit("=IFCPOLYLINE(("), on(0), F.lit(","), on(1), F.lit("));")),
        F.concat(on(3), F.lit("=IFCWALL('"), global_id(F.concat(plan, F.lit(":wall:"), F.col("wall_id").cast("string"))), F.lit("',$,'"), F.col("wall_id").cast("string"), F.lit("',$,$,$,$,$,.STANDARD.);")),
    )
    head = F.concat(F.lit("ISO-10303-21;\nHEADER;\nFILE_DESCRIPTION((''),'2;1');\nFILE_NAME('"), plan, F.lit("','',(''),(''),'','','');\nFILE_SCHEMA(('IFC4'));\nENDSEC;\nDATA;\n#1=IFCPROJECT('"), global_id(F.concat(plan, F.lit(":project"))), F.lit("',$,'"), plan, F.lit("',$,$,$,$,$,$);\n#9=IFCDIRECTION((0.,0.,1.));"))
    return _assembled(rooms, walls, room, wall, head, F.lit("ENDSEC;\nEND-ISO-10303-21;"))


def write_texts(texts: DataFrame, path: str) -> None:
    """A folder for each plan (``plan_id=...``) with its text as one file; refused plans, without a text, get none.

    Plans are dealt over tasks by id, so that a task writes whole files and none is written twice.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = texts.where("text IS NOT NULL").select("plan_id", F.regexp_replace("text", "\n$", "").alias("text"))
    lines.repartition(parts, "plan_id").write.partitionBy("plan_id").text(path)
