"""Layout files: plans as JSON documents, corpora as CSV with WKT polygons, generated plans as JSON lines, splits as id lists."""

from __future__ import annotations

import contextlib
import csv
import io
import itertools
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oblong.operators import conversion
from oblong.operators.plans import per_plan

#: Names of both versions of the plan document. Version 1 has French keys and room types.
ROOM_TYPES_V1 = {"sejour": "living_room", "chambre": "bedroom", "cuisine": "kitchen", "sdb": "bathroom", "wc": "toilet", "couloir": "corridor"}

_ROOM = "array<struct<id:string,type:string,x:double,y:double,w:double,h:double>>"
PLAN = (
    f"schema string, outline array<array<double>>, rooms {_ROOM}, walls array<struct<id:string,a:array<double>,b:array<double>,load_bearing:boolean,thickness:double>>, "
    "openings array<struct<id:string,wall_id:string,s:double,relative_width:double,sill_height:double,head_height:double>>, "
    f"contour array<array<double>>, pieces {_ROOM}, murs array<struct<id:string,a:array<double>,b:array<double>,porteur:boolean,epaisseur:double>>, "
    "ouvertures array<struct<id:string,mur_id:string,s:double,largeur_rel:double,hauteur_allege:double,hauteur_linteau:double>>, _corrupt_record string"
)


def _renamed(name: str, fields: dict[str, str]) -> Column:
    """An array of structs with fields renamed."""
    return F.transform(name, lambda e: F.struct(*[e[old].alias(new) for old, new in fields.items()]))


def read_plans(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row for each plan document, version 1 upgraded: (plan_id, schema, outline, rooms, walls, openings, problem).

    ``problem`` says why a document can't be read; null where it can. The plan's id is its file's name. With ``lines`` a file holds one
    document a line, as ``sinks.write_plans`` writes them, and such a file can be split among tasks.
    """
    raw = spark.read.schema(PLAN).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("plan_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.json)?$", 1))
    types = F.create_map(*[F.lit(x) for kv in ROOM_TYPES_V1.items() for x in kv])
    rooms = F.transform("pieces", lambda r: r.withField("type", F.coalesce(F.try_element_at(types, r["type"]), r["type"])))
    walls = _renamed("murs", {"id": "id", "a": "a", "b": "b", "porteur": "load_bearing", "epaisseur": "thickness"})
    openings = _renamed("ouvertures", {"id": "id", "mur_id": "wall_id", "s": "s", "largeur_rel": "relative_width", "hauteur_allege": "sill_height", "hauteur_linteau": "head_height"})
    old = F.col("schema") == "1"
    known = F.when(F.col("_corrupt_record").isNotNull(), "not a plan document").when(F.col("schema").isNull(), "no schema version").when(~F.col("schema").isin("1", "2"), F.concat(F.lit("unknown schema version "), "schema"))
    return raw.select(
        "plan_id",
        F.when(known.isNull(), F.lit("2")).alias("schema"),
        F.transform(F.when(old, F.col("contour")).otherwise(F.col("outline")), lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("outline"),
        F.when(old, rooms).otherwise(F.col("rooms")).alias("rooms"),
        F.when(old, walls).otherwise(F.col("walls")).alias("walls"),
        F.when(old, openings).otherwise(F.col("openings")).alias("openings"),
        known.alias("problem"),
    )


def range_violations(plans: DataFrame) -> DataFrame:
    """All values of each plan that are out of their range, as a list of messages; the list is empty for a sound plan."""

    def out(elements: str, kind: str, field: str, wrong) -> Column:
        say = lambda e: F.concat(F.lit(f"{kind} "), e["id"], F.lit(f": {field} = "), e[field].cast("string"))
        return F.transform(F.filter(F.coalesce(F.col(elements), F.array()), lambda e: wrong(e[field])), say)

    return plans.withColumn("violations", F.concat(
        out("rooms", "room", "w", lambda v: v <= 0), out("rooms", "room", "h", lambda v: v <= 0), out("walls", "wall", "thickness", lambda v: v <= 0),
        out("openings", "opening", "s", lambda v: (v < 0) | (v > 1)), out("openings", "opening", "relative_width", lambda v: (v <= 0) | (v > 1)),
    ))


def plan_rooms(plans: DataFrame) -> DataFrame:
    """Rooms as a long table."""
    return plans.select("plan_id", F.explode("rooms").alias("r")).select("plan_id", F.col("r.id").alias("room_id"), F.col("r.type").alias("room_type"), "r.x", "r.y", "r.w", "r.h")


def wkt_points(geometry: Column) -> Column:
    """The points of a WKT polygon; null where there are fewer than four."""
    number = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"
    xs = F.regexp_extract_all(geometry, F.lit(number + r"\s+" + number), F.lit(1))
    ys = F.regexp_extract_all(geometry, F.lit(number + r"\s+" + number), F.lit(2))
    points = F.zip_with(xs, ys, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    return F.when(F.upper(geometry).startswith("POLYGON") & (F.size(xs) >= 4), points)


def identifier(text: Column) -> Column:
    """Whole numbers written as decimals without their fraction; other texts trimmed."""
    number = F.trim(text).try_cast("double")
    whole = number.isNotNull() & (F.abs(number) < 1e15) & (number == F.floor(number))
    return F.when(whole, number.cast("long").cast("string")).otherwise(F.trim(text))


def read_corpus(spark: SparkSession, path: str, excluded: tuple[str, ...] = ("BALCONY", "LOGGIA", "TERRACE")) -> DataFrame:
    """Areas, walls, columns and windows of apartments from a CSV corpus, with their points and bounding boxes, numbered by ``at`` in the
    order of the files."""
    rows = spark.read.option("header", True).csv(path).select("apartment_id", "entity_type", "entity_subtype", "geom", "area_id", "site_id")
    kept = (F.col("entity_type") == "area") & ~F.col("entity_subtype").isin(*excluded) | F.col("entity_subtype").isin("WALL", "COLUMN", "WINDOW")
    points = rows.withColumn("at", F.monotonically_increasing_id()).where(kept).withColumn("points", wkt_points(F.col("geom")))
    x, y = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    return points.select("apartment_id", "entity_type", "entity_subtype", identifier(F.col("area_id")).alias("area_id"), identifier(F.col("site_id")).alias("site_id"), "points", F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"), "at")


_APARTMENT = (
    "apartment_id string, reason string, angle double, rooms array<struct<x:double,y:double,w:double,h:double,type:string,source:int>>, outline array<double>, "
    "walls array<array<double>>, openings array<struct<wall:int,s:double,relative_width:double>>, columns array<array<double>>"
)


def converted(corpus: DataFrame, **options: float) -> DataFrame:
    """One row an apartment of ``read_corpus``: its plan as rectangles, outline (x and y in turn), walls, openings and columns, in the frame
    that ``angle`` was turned back to; or the first reason why there is none. ``options``: most_rooms, most_rectangles, snap, stitch."""
    flat = F.flatten(F.transform("points", lambda p: F.array(p["x"], p["y"])))
    named = corpus.where("apartment_id IS NOT NULL")
    # The place in the file only orders an apartment's entities, and the site is only handed on: equal drawings are converted once.
    place = F.row_number().over(Window.partitionBy("apartment_id").orderBy("at"))
    rows = named.select("apartment_id", place.alias("k"), "entity_type", "entity_subtype", flat.alias("corners"))
    sites = named.groupBy("apartment_id").agg(F.min_by("site_id", F.when(F.col("site_id") != "", F.col("at"))).alias("site_id"))

    def run(apartment: str, entities: pd.DataFrame) -> list[tuple]:
        given = [(k, s, None if c is None else np.asarray(c, dtype=float).reshape(-1, 2)) for k, s, c in zip(entities["entity_type"], entities["entity_subtype"], entities["corners"], strict=True)]
        try:
            a = conversion.convert(given, **options)
        except conversion.Rejected as rejected:
            return [(apartment, str(rejected), None, None, None, None, None, None)]
        rooms = [dict(zip(("x", "y", "w", "h", "type", "source"), r, strict=True)) for r in a.rooms]
        openings = [dict(zip(("wall", "s", "relative_width"), o, strict=True)) for o in a.openings]
        return [(apartment, None, a.angle, rooms, a.outline.ravel().tolist(), [list(w) for w in a.walls], openings, [list(c) for c in a.columns])]

    found = per_plan(rows, run, _APARTMENT, ("entity_type", "entity_subtype", "corners"), "apartment_id", "k", period=1)
    first, *others = found.columns
    return found.join(sites, "apartment_id").select(first, "site_id", *others)


def conversion_statistics(apartments: DataFrame) -> DataFrame:
    """(reason, n, share) of ``converted``: how many apartments were kept (reason null) and why the others were not."""
    counts = apartments.groupBy("reason").agg(F.count("*").alias("n"))
    read = F.sum("n").over(Window.partitionBy())  # over one row a reason
    return counts.select("reason", "n", (F.col("n") / read).alias("share"))


def unreadable_apartments(corpus: DataFrame) -> DataFrame:
    """Apartments with an entity whose geometry can't be read: these are rejected whole."""
    return corpus.groupBy("apartment_id").agg(F.count_if(F.col("points").isNull()).alias("unreadable"), F.count("*").alias("entities")).where("unreadable > 0")


def read_labels(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One simulated value and the area of each (apartment, area); uncastable rows are left out and the last row wins."""
    rows = spark.read.option("header", True).csv(path).withColumn("at", F.monotonically_increasing_id())
    cast = rows.select(F.col("apartment_id"), identifier(F.col("area_id")).alias("area_id"), F.col(column).try_cast("double").alias("value"), F.col("layout_area").try_cast("double").alias("area"), "at")
    return cast.where("value IS NOT NULL AND area IS NOT NULL").groupBy("apartment_id", "area_id").agg(F.max_by(F.struct("value", "area"), "at").alias("v")).select("apartment_id", "area_id", "v.*")


def read_generated(spark: SparkSession, path: str, scale: float = 1.0) -> DataFrame:
    """Boxes around the rooms of generated plans (JSON lines), in metres; degenerate ones are left out."""
    rows = spark.read.schema("id string, programme array<string>, pieces array<struct<type:string,coins:array<array<double>>>>").json(path)
    each = rows.select(F.col("id").alias("plan_id"), F.posexplode("pieces").alias("i", "p"))
    x, y = F.transform("p.coins", lambda c: c[0] * scale), F.transform("p.coins", lambda c: c[1] * scale)
    boxes = each.select("plan_id", (F.col("i") + 1).cast("long").alias("room_id"), F.col("p.type").alias("room_type"), F.array_min(x).alias("x"), F.array_min(y).alias("y"), (F.array_max(x) - F.array_min(x)).alias("w"), (F.array_max(y) - F.array_min(y)).alias("h"))
    return boxes.where("w > 0 AND h > 0")


def read_split(spark: SparkSession, folder: str) -> DataFrame:
    """(id, part) from train.txt, calibration.txt and test.txt; blank lines and comments are skipped, a repeated id is refused."""
    parts = [spark.read.text(f"{folder}/{part}.txt").select(F.trim("value").alias("id"), F.lit(part).alias("part")) for part in ("train", "calibration", "test")]
    ids = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("id <> '' AND NOT startswith(id, '#')")
    twice = [r["id"] for r in ids.groupBy("id").count().where("count > 1").orderBy("id").limit(5).collect()]
    if twice:
        raise ValueError(f"ids in more than one place of the split: {', '.join(twice)}")
    return ids


def _simulation_lines(path: str, rows: int) -> Iterator[list[dict[str, str | None]]]:
    """Rows of simulations.csv, from the file itself or from its ZIP archive, ``rows`` at a time; bytes that are no UTF-8 are replaced.

    The first item holds one row with the names of the columns only.
    """
    with contextlib.ExitStack() as opened:
        if path.lower().endswith(".zip"):
            archive = opened.enter_context(zipfile.ZipFile(path))
            names = [n for n in archive.namelist() if n.lower().endswith("simulations.csv")]
            if not names:
                raise ValueError(f"no simulations.csv in {path}")
            text = io.TextIOWrapper(opened.enter_context(archive.open(names[0])), encoding="utf-8", errors="replace", newline="")
        else:
            text = opened.enter_context(open(path, encoding="utf-8", errors="replace", newline=""))
        reader = csv.DictReader(text)
        yield [dict.fromkeys(reader.fieldnames or [])]
        while held := [{k: r[k] for k in reader.fieldnames} for r in itertools.islice(reader, rows)]:
            yield held


def read_simulations(spark: SparkSession, path: str, rows: int = 10_000) -> DataFrame:
    """All columns of simulations.csv as texts, from its ZIP archive or from the bare file, which Spark reads in parallel.

    An archive's member can only be read from its beginning, so one task reads it, ``rows`` rows at a time, and deals them out; its path
    must be one that every worker can open. Missing fields of a short line are null.
    """
    if not path.lower().endswith(".zip"):
        return spark.read.option("header", True).option("escape", '"').option("nullValue", None).option("emptyValue", "").csv(path)
    with contextlib.closing(_simulation_lines(path, rows)) as lines:
        columns = list(next(lines)[0])
    if not columns:
        raise ValueError(f"no header in {path}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one in batch["path"]:
                for held in itertools.islice(_simulation_lines(one, rows), 1, None):
                    yield pd.DataFrame(held, columns=columns)

    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.createDataFrame([(path,)], "path string").coalesce(1).mapInPandas(run, schema).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
