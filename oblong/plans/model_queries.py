"""Learned scores of plans, their gradients and guards, sweeps and ablations of the optimizer, the active loop, tokens."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oblong.operators import linear, together
from oblong.operators import surrogates as sg
from oblong.operators.plans import alike, per_matrix, per_plan
from oblong.plans import derived
from oblong.plans.plan_queries import BOX, LEAST_AREA, LEAST_WIDTH, TOGETHER, repaired_alike
from oblong.plans.registry import query

#: Training plans at most; the others are only scored.
TRAINING_PLANS = 1500
SEED = 29


def _vector(rooms: pd.DataFrame) -> np.ndarray:
    return rooms[["x", "y", "w", "h"]].to_numpy(float).ravel()


def _azimuth(plan: int) -> float:
    return float(plan * 7 % 360)


def _described(rooms: DataFrame) -> DataFrame:
    """(plan_id, descriptors, truth) of each plan."""

    def describe(plans: np.ndarray, ids: np.ndarray, matrix: np.ndarray, ends: np.ndarray) -> tuple:
        features, truths = np.zeros((len(plans), len(sg.DESCRIPTORS))), np.zeros(len(plans))
        for own, held in alike(matrix, ends):
            deg = plans[own] * 7 % 360.0
            features[own], truths[own] = sg.described(held, deg), sg.simulated_many(held, deg)
        return plans, list(features), truths

    return per_matrix(rooms, describe, "plan_id long, features array<double>, truth double", many=True)


def _order(column: str = "plan_id"):
    return F.sha2(F.col(column).cast("string"), 256)


def _sample(rooms: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Descriptors and truths of ``most`` plans drawn by a hash of their ids; only their rooms are described."""
    drawn = rooms.select("plan_id").distinct().orderBy(_order(), "plan_id").limit(most)
    rows = _described(rooms.join(drawn, "plan_id", "left_semi")).orderBy("plan_id").toPandas()
    return np.array(rows["features"].tolist(), dtype=float).reshape(-1, len(sg.DESCRIPTORS)), rows["truth"].to_numpy(float)


def _scored(described: DataFrame, members: list[sg.Dense]) -> DataFrame:
    """(plan_id, features, truth, predicted, spread) by an ensemble, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                mean, spread = sg.ensemble_values(members, np.array(batch["features"].tolist(), dtype=float))
                yield batch.assign(predicted=mean, spread=spread)

    return described.mapInPandas(run, "plan_id long, features array<double>, truth double, predicted double, spread double")


@query()
def dense_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One network, trained on a drawn sample, scores all plans."""
    rooms = derived.rooms(spark, sf_dir)
    features, truths = _sample(rooms, TRAINING_PLANS)
    if len(features) < 2:
        return spark.createDataFrame([], "plan_id long, truth double, predicted double")
    net = sg.fit(features, truths, SEED)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch[["plan_id", "truth"]].assign(predicted=net.values(np.array(batch["features"].tolist(), dtype=float)))

    return _described(rooms).mapInPandas(run, "plan_id long, truth double, predicted double")


@query()
def ensemble_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five networks on resamples of one sample: their mean and spread for all plans."""
    rooms = derived.rooms(spark, sf_dir)
    features, truths = _sample(rooms, TRAINING_PLANS)
    if len(features) < 2:
        return spark.createDataFrame([], "plan_id long, truth double, predicted double, spread double")
    return _scored(_described(rooms), sg.fit_ensemble(features, truths, 5, SEED)).drop("features")


@query()
def gradient_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each plan: the network's declared gradient against its own differences, and by signs against the simulator's slopes.

    ``status`` says whether a guard that trusts the simulator lets the gradient through.
    """
    rooms = derived.rooms(spark, sf_dir)
    features, truths = _sample(rooms, TRAINING_PLANS)
    schema = "plan_id long, own_error double, own_cosine double, cosine double, signs double, status string"
    if len(features) < 2:
        return spark.createDataFrame([], schema)
    net = sg.fit(features, truths, SEED)

    def report(plans: np.ndarray, ids: np.ndarray, matrix: np.ndarray, ends: np.ndarray) -> list[tuple]:
        out = []
        for at, held in alike(matrix, ends):
            deg = plans[at] * 7 % 360.0
            measured = sg.differences_many(lambda v, d: net.values(sg.described(v, d)), held, deg, 1e-5)
            simulator = sg.differences_many(sg.simulated_many, held, deg, 0.1)
            for plan, x, d, own_slopes, slopes in zip(plans[at].tolist(), held, deg.tolist(), measured, simulator, strict=True):
                declared = net.gradient(x.ravel(), d)
                own = sg.agreement(declared, own_slopes)
                _, cosine, signs = sg.agreement(declared, slopes)
                out.append((plan, own[0], own[1], cosine, signs, sg.guarded(declared, slopes)[1]))
        return out

    return per_matrix(rooms, report, schema, many=True)


@query()
def optimizer_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repaired plan under each budget of metres and of iterations: why the run ended, its value, gain and gap.

    A run of fewer iterations is the beginning of a longer one, so each budget of metres is run once.
    """

    budgets, mosts = np.array([0.25, 0.5]), np.array([5, 10, 25, 50])

    def runs(plans: np.ndarray, ids: np.ndarray, matrix: np.ndarray, ends: np.ndarray) -> tuple:
        found = [swept(*of) for of in repaired_alike(plans, matrix, ends)]
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def swept(plans: np.ndarray, a: np.ndarray, b: np.ndarray, held: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray) -> tuple:
        count = len(plans)
        deg = plans * 7 % 360.0
        twice = lambda v: np.concatenate((v, v))
        x, values, gaps, steps, status = together.frank_wolfe(twice(a), twice(b), twice(held), twice(low), twice(high), twice(start), twice(deg), np.repeat(budgets, count), most=50)
        last = together.daylight(x, twice(deg))[0][:, None]
        cut, taken = steps[:, None] > mosts, np.minimum(steps[:, None], mosts)
        value = np.where(cut, values[:, np.minimum(mosts, values.shape[1] - 1)], last)
        gap = np.where(taken > 0, np.take_along_axis(gaps, np.maximum(taken - 1, 0), axis=1), None)
        spread = lambda v: np.repeat(v, len(mosts))
        gain = value - twice(together.daylight(start, deg)[0])[:, None]
        return spread(twice(plans)), spread(np.repeat(budgets, count)), np.tile(mosts, 2 * count), np.where(cut, "limit", status[:, None]).astype(object).ravel(), taken.ravel(), value.ravel(), gain.ravel(), gap.ravel()

    schema = "plan_id long, budget double, most long, status string, iterations long, value double, gain double, gap double"
    return per_matrix(derived.rooms(spark, sf_dir), runs, schema, many=True, least=120_000)


@query()
def ablation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two seeded disturbances of each plan, repaired in full and with one part at a time left out."""

    def runs(plans: np.ndarray, ids: np.ndarray, matrix: np.ndarray, ends: np.ndarray) -> tuple:
        found = []
        for own, held in alike(matrix, ends):
            most = min(1024, max(1, TOGETHER // held.shape[1] ** 2)) // 2 + 1  # two starts a plan
            found += [ablated(plans[own[k : k + most]], held[k : k + most]) for k in range(0, len(own), most)]
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def disturbance(plan: int, start: int, rooms: int) -> np.ndarray:
        seed = int.from_bytes(hashlib.sha256(f"{SEED}:{plan}:{start}".encode()).digest()[:8], "little")
        return np.random.default_rng(seed).normal(0, 0.3, (rooms, 4))

    def ablated(plans: np.ndarray, rooms: np.ndarray) -> tuple:
        n, count, starts = rooms.shape[1], 2 * len(plans), np.tile([0, 1], len(plans))
        keys = np.repeat(plans, 2)
        cases = np.repeat(rooms, 2, axis=0) + np.stack([disturbance(p, s, n) for p, s in zip(keys.tolist(), starts.tolist(), strict=True)])
        cases[:, :, 2:] = np.maximum(cases[:, :, 2:], 0.1)
        a, b, rows = together.layouts(cases, BOX)
        low, high = np.tile([0.0, 0.0, LEAST_WIDTH, LEAST_WIDTH], (count, n)), np.tile([*BOX, *BOX], (count, n)).astype(float)
        bare, whole = (together.nearest_with_areas(a, b, rows, low, high, cases.reshape(count, -1), np.full((count, n), least)) for least in (0.0, LEAST_AREA))
        deg, placed, out = np.array([_azimuth(p) for p in keys.tolist()]), {}, []
        for name, (status, points), fall in (("full", whole, True), ("no areas", bare, True), ("no fallback", whole, False)):
            solved = status == "optimal"
            after = linear.snapped(points).reshape(count, n, 4)
            valid = together.proved(after, BOX, LEAST_WIDTH, LEAST_AREA)
            for k in np.flatnonzero(~solved).tolist() if fall else ():
                if k not in placed:
                    own = linear.naive_repair(cases[k], BOX)
                    placed[k] = own, all(linear.proof(own, BOX, LEAST_WIDTH, np.full(n, LEAST_AREA)).values())
                after[k], valid[k] = placed[k]
            told = solved | fall
            moved, score = np.abs(after - cases).max(axis=(1, 2)), together.daylight(after.reshape(count, -1), deg)[0]
            out.append((keys, starts, np.full(count, name, dtype=object), status.astype(object), valid & told, np.where(told, moved, None), np.where(told, score, None)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    schema = "plan_id long, start long, config string, status string, valid boolean, moved double, score double"
    return per_matrix(derived.rooms(spark, sf_dir), runs, schema, many=True, least=60_000)


@query()
def active_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of labelling under a budget of 90: each asks for the 30 plans where spread times density is highest, trains on all
    labels so far, and is calibrated on 40 plans of its own that it never learns from. One row a cycle.

    The density is that of 64 repaired plans, the kind that the optimizer makes. Labels and these samples are all that is
    collected; the pool is scored where it lies.
    """
    batch, cycles, n_calibration, n_reference, alpha = 30, 3, 40, 64, 0.1
    schema = "cycle long, labelled long, calibrated long, level double, width double, coverage double"
    rooms = derived.rooms(spark, sf_dir)
    described = _described(rooms).persist()
    drawn = described.orderBy(_order(), "plan_id").limit(n_calibration + n_reference + batch).toPandas()
    if len(drawn) < n_calibration + n_reference + 2:
        described.unpersist()
        return spark.createDataFrame([], schema)
    matrix = lambda rows: np.array(rows["features"].tolist(), dtype=float)
    held, seen, labels = drawn[:n_calibration], drawn[n_calibration : n_calibration + n_reference], drawn[n_calibration + n_reference :]
    chosen = [int(p) for p in seen["plan_id"]]

    def repaired(plan: int, rows: pd.DataFrame) -> list[tuple]:
        before = _vector(rows)
        s = linear.nearest_with_areas(linear.layout(before.reshape(-1, 4), BOX, LEAST_WIDTH), before, np.full(len(rows), LEAST_AREA))
        return [] if s.x is None else [(plan, sg.descriptors(s.x, _azimuth(plan))[0].tolist())]

    made = per_plan(rooms.where(F.col("plan_id").isin(chosen)), repaired, "plan_id long, features array<double>").orderBy("plan_id").toPandas()
    points = matrix(made) if len(made) else matrix(seen)
    scale = np.maximum(points.std(axis=0), 1e-8)
    calibration = [int(p) for p in held["plan_id"]]
    rows = []
    for cycle in range(cycles):
        members = sg.fit_ensemble(matrix(labels), labels["truth"].to_numpy(float), 5, SEED + cycle)
        mean, spread = sg.ensemble_values(members, matrix(held))
        level = sg.conformal_level(np.abs(held["truth"].to_numpy(float) - mean) / spread, alpha)
        pool = _scored(described.where(~F.col("plan_id").isin(calibration)), members)
        inside = (F.abs(F.col("truth") - F.col("predicted")) <= level * F.col("spread")).cast("double")
        unseen = pool.where(~F.col("plan_id").isin([int(p) for p in labels["plan_id"]]))  # no plan that the networks learnt from
        seen_by = unseen.agg(F.avg("spread").alias("spread"), F.avg(inside).alias("coverage")).first()
        rows.append((cycle, len(labels), len(held), level, 2 * level * seen_by["spread"], seen_by["coverage"]))
        if cycle == cycles - 1:
            break

        def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                if len(part):
                    gaps = (matrix(part)[:, None, :] - points[None, :, :]) / scale
                    near = np.exp(-0.5 * (gaps**2).mean(axis=2)).mean(axis=1)
                    yield part[["plan_id", "features", "truth"]].assign(score=near * part["spread"])

        best = unseen.mapInPandas(dense, "plan_id long, features array<double>, truth double, score double").orderBy(F.desc("score"), "plan_id").limit(batch)
        labels = pd.concat([labels, best.toPandas()[["plan_id", "features", "truth"]]], ignore_index=True)
    described.unpersist()
    return spark.createDataFrame(rows, schema)


@query()
def calibration_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each plan the fingerprint of its predictions, truths and spreads, and the token that freezes it."""
    measures = derived.measures(spark, sf_dir)

    def sign(plan: int, lines: np.ndarray, numbers: np.ndarray) -> list[tuple]:
        rows = numbers[np.lexsort((*numbers.T[::-1], lines))]
        digest = sg.data_fingerprint(dict(zip(("prediction", "truth", "spread"), rows.T[2:], strict=True)))
        return [(plan, len(rows), digest, sg.signed_token(digest, "2024-01-01T00:00:00Z"))]

    return per_matrix(measures, sign, "plan_id long, n long, fingerprint string, token string", ("part_id", "quantity", "prediction", "truth", "spread"), order="line")
