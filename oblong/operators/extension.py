"""Where users put their own: checks, scorers, references, constraints, strategies and policies, given as column expressions or functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oblong.operators.layouts import SNAP


def room_scores(rooms: DataFrame, scorers: dict[str, Column]) -> DataFrame:
    """(plan_id, room_id, one column a scorer): any expression of a room's columns scores it."""
    return rooms.select("plan_id", "room_id", *[c.alias(name) for name, c in scorers.items()])


def plan_scores(rooms: DataFrame, scorers: dict[str, Column], reference: str | None = None) -> DataFrame:
    """(plan_id, method, score, error): each scorer's sum over a plan's rooms, and how far it is from that of the one named ``reference``."""
    sums = rooms.groupBy("plan_id").agg(*[F.sum(c).alias(name) for name, c in scorers.items()])
    off = (lambda name: F.col(name) - F.col(reference)) if reference else (lambda name: F.lit(None).cast("double"))
    rows = F.array(*[F.struct(F.lit(name).alias("method"), F.col(name).cast("double").alias("score"), off(name).alias("error")) for name in scorers])
    return sums.select("plan_id", F.explode(rows).alias("r")).select("plan_id", "r.*")


def extra_checks(rooms: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(plan_id, check, status, measure) of users' own checks, each given by an aggregate verdict and an aggregate measure.

    A verdict that can't be computed (null) is unknown, never satisfied.
    """
    verdicts = [a for name, (ok, measure) in checks.items() for a in (ok.alias(f"ok_{name}"), measure.cast("double").alias(f"by_{name}"))]
    found = rooms.groupBy("plan_id").agg(*verdicts)
    status = lambda name: F.when(F.col(f"ok_{name}").isNull(), "unknown").when(F.col(f"ok_{name}"), "satisfied").otherwise("violated")
    rows = F.array(*[F.struct(F.lit(name).alias("check"), status(name).alias("status"), F.col(f"by_{name}").alias("measure")) for name in checks])
    return found.select("plan_id", F.explode(rows).alias("r")).select("plan_id", "r.*")


def linear_constraints(rooms: DataFrame, terms: DataFrame, bounds: DataFrame) -> DataFrame:
    """(plan_id, constraint, value, bound, satisfied) of users' sums of coefficient x field over rooms; a constraint whose rooms a plan lacks is absent.

    ``terms``: constraint, room_id, field, coefficient. ``bounds``: constraint, bound. Both are what a user writes down and go to all
    tasks: room ids and fields are few, so a shuffle by them would send all rooms to a few tasks.
    """
    value = F.create_map(*[v for f in "xywh" for v in (F.lit(f), F.col(f))])
    sizes = terms.groupBy("constraint").agg(F.count("*").alias("n_terms"))
    each = rooms.join(F.broadcast(terms.where(F.col("field").isin(*"xywh"))), "room_id").select("plan_id", "constraint", "coefficient", F.element_at(value, F.col("field")).alias("value"))
    sums = each.groupBy("plan_id", "constraint").agg(F.sum(F.col("coefficient") * F.col("value")).alias("value"), F.count("*").alias("n"))
    whole = sums.join(F.broadcast(sizes), "constraint").where("n = n_terms").join(F.broadcast(bounds), "constraint")
    return whole.select("plan_id", "constraint", "value", "bound", (F.col("value") <= F.col("bound") + SNAP).alias("satisfied"))


def acquired(pool: DataFrame, strategy: Column, n: int, id_: str, excluded: DataFrame | None = None) -> DataFrame:
    """The ``n`` candidates that a strategy, any expression of their columns, ranks first; ties by id. The limit is the operator."""
    left = pool.join(excluded.select(id_), id_, "left_anti") if excluded is not None else pool
    return left.withColumn("score", strategy).orderBy(F.desc("score"), id_).limit(n)


def chosen_by_policy(candidates: DataFrame, policy: Column, key: str, id_: str) -> DataFrame:
    """One candidate of each key: the one that the policy's expression puts highest; ties by id."""
    first = Window.partitionBy(key).orderBy(F.desc(policy), id_)
    return candidates.withColumn("i_", F.row_number().over(first)).where("i_ = 1").drop("i_")


def stepped(values: DataFrame, step: Callable[[Column], Column], rounds: int, column: str) -> DataFrame:
    """A column moved ``rounds`` times by a user's step, an expression of it; the plan holds all steps and runs in one pass."""
    moved = F.col(column)
    for _ in range(rounds):
        moved = step(moved)
    return values.withColumn(column, moved)
