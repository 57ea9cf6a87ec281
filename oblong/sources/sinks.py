"""Writers: plan documents as sorted JSON, rows as CSV, tables as Markdown, drawings as SVG."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oblong.operators.plans import per_matrix


def plan_json(plans: DataFrame) -> DataFrame:
    """(plan_id, json): documents of schema 2 with sorted keys and explicit nulls. Plans with a NaN or infinite number are refused by a null."""
    room = lambda r: F.struct(r["h"].alias("h"), r["id"].alias("id"), r["type"].alias("type"), r["w"].alias("w"), r["x"].alias("x"), r["y"].alias("y"))
    wall = lambda w: F.struct(w["a"].alias("a"), w["b"].alias("b"), w["id"].alias("id"), w["load_bearing"].alias("load_bearing"), w["thickness"].alias("thickness"))
    opening = lambda o: F.struct(o["head_height"].alias("head_height"), o["id"].alias("id"), o["relative_width"].alias("relative_width"), o["s"].alias("s"), o["sill_height"].alias("sill_height"), o["wall_id"].alias("wall_id"))
    empty = lambda name, f: F.coalesce(F.transform(name, f), F.transform(F.slice(name, 1, 0), f))
    document = F.struct(F.transform("openings", opening).alias("openings"), F.transform("outline", lambda p: F.array(p["x"], p["y"])).alias("outline"), empty("rooms", room).alias("rooms"), F.lit("2").alias("schema"), F.transform("walls", wall).alias("walls"))
    strange: Column = F.exists("rooms", lambda r: F.isnan(r["x"]) | F.isnan(r["y"]) | F.isnan(r["w"]) | F.isnan(r["h"]) | (F.abs(r["x"] + r["y"] + r["w"] + r["h"]) == float("inf")))
    return plans.select("plan_id", F.when(~F.coalesce(strange, F.lit(False)), F.to_json(document, {"ignoreNullFields": "false"})).alias("json"))


def write_plans(plans: DataFrame, path: str) -> None:
    """Documents as text, one a line. A plan that ``plan_json`` refuses is an error: none is left out in silence."""
    refused = F.raise_error(F.concat(F.lit("plan with a NaN or infinite number: "), F.col("plan_id").cast("string"))).cast("string")
    plan_json(plans).select(F.coalesce("json", refused).alias("json")).write.text(path)


def write_record(spark: SparkSession, path: str, content: dict) -> None:
    """A small document (a manifest, a record of a run) as one line of sorted JSON; NaN is refused."""
    spark.createDataFrame([(json.dumps(content, sort_keys=True, allow_nan=False, ensure_ascii=False),)], "value string").coalesce(1).write.text(path)


def write_rows(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header; nulls are empty."""
    rows.write.option("header", True).option("nullValue", "").csv(path)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; a larger one than ``most`` rows is refused, not cut."""
    held = rows.limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"more than {most} rows")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in held]) + "\n"


def svg(rooms: DataFrame, pixels: int = 40) -> DataFrame:
    """(plan_id, svg): a drawing of each plan, y upwards."""

    def draw(plan: int, ids: np.ndarray, numbers: np.ndarray) -> list[tuple]:
        rows = numbers.tolist()
        top, right = max(y + h for _, y, _, h in rows), max(x + w for x, _, w, _ in rows)
        boxes = "".join(f'<rect x="{pixels * x:g}" y="{pixels * (top - y - h):g}" width="{pixels * w:g}" height="{pixels * h:g}" fill="none" stroke="black"><title>{name}</title></rect>' for name, (x, y, w, h) in zip(ids.tolist(), rows, strict=True))
        return [(plan, f'<svg xmlns="http://www.w3.org/2000/svg" width="{pixels * right:g}" height="{pixels * top:g}">{boxes}</svg>')]

    return per_matrix(rooms, draw, "plan_id long, svg string")


def svg_sheet(panels: DataFrame, columns: int = 2, pixels: int = 40, gap: float = 1.0) -> DataFrame:
    """(plan_id, svg): the states of each plan (column ``panel``: 0, 1, …) side by side at one scale, ``columns`` in a row, each with its number."""

    def draw(plan: int, ids: np.ndarray, numbers: np.ndarray) -> list[tuple]:
        rows = numbers.tolist()
        wide, high = max(x + w for _, x, _, w, _ in rows) + gap, max(y + h for _, _, y, _, h in rows) + gap
        parts, n = [], int(max(r[0] for r in rows)) + 1
        for name, (panel, x, y, w, h) in zip(ids.tolist(), rows, strict=True):
            left, top = (panel % columns) * wide, (panel // columns) * high
            parts.append(f'<rect x="{pixels * (left + x):g}" y="{pixels * (top + high - gap - y - h):g}" width="{pixels * w:g}" height="{pixels * h:g}" fill="none" stroke="black"><title>{int(panel)}:{name}</title></rect>')
        return [(plan, f'<svg xmlns="http://www.w3.org/2000/svg" width="{pixels * wide * min(columns, n):g}" height="{pixels * high * -(-n // columns):g}">{"".join(parts)}</svg>')]

    return per_matrix(panels, draw, "plan_id long, svg string", ("panel", "x", "y", "w", "h"))


def svg_compare(before: DataFrame, after: DataFrame, pixels: int = 40) -> DataFrame:
    """(plan_id, svg): each plan before and after, side by side at one scale."""
    side = lambda rooms, k: rooms.select("plan_id", "room_id", F.lit(k).alias("panel"), "x", "y", "w", "h")
    return svg_sheet(side(before, 0).unionByName(side(after, 1)), 2, pixels)
