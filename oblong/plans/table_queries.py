"""Queries over experiment rows: aggregations, ordered computations, statistics, circular statistics and conformal calibration."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oblong.functions import circular, intervals
from oblong.operators import distributions, tables
from oblong.plans import derived
from oblong.plans.derived import MEASURES, RUNS, STATUSES
from oblong.plans.registry import query, rounded
from oblong.sources.tables import table

ALL_STATUSES = [*dict.fromkeys(STATUSES.values()), "computation_failure"]


@query(f"WITH {RUNS}, s AS (SELECT unnest({ALL_STATUSES}) AS status) SELECT s.status, count(run_id) AS n FROM s LEFT JOIN runs USING (status) GROUP BY 1")
def outcome_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.tally(derived.runs(spark, sf_dir), "status", ALL_STATUSES)


def wilson_sql(k: str, n: str) -> str:
    p = f"({k} / CAST({n} AS DOUBLE))"
    half = f"1.96 * sqrt({p} * (1 - {p}) / {n} + 1.96 * 1.96 / (4.0 * {n} * {n})) / (1 + 1.96 * 1.96 / {n})"
    mid = f"({p} + 1.96 * 1.96 / (2.0 * {n})) / (1 + 1.96 * 1.96 / {n})"
    return f"round(CASE WHEN {k} = 0 THEN 0 ELSE greatest(0, {mid} - {half}) END, 6) AS low, round(CASE WHEN {k} = {n} THEN 1 ELSE least(1, {mid} + {half}) END, 6) AS high"


CLASSES = ["repaired", "strong", "infeasible", "grid", "other"]
CLASSED = f"{RUNS}, classed AS (SELECT *, CASE WHEN status = 'ok' THEN CASE WHEN moved > 0.25 THEN 'strong' ELSE 'repaired' END WHEN status IN ('infeasible', 'grid') THEN status ELSE 'other' END AS class FROM runs)"


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.when(F.coalesce("moved", F.lit(0.0)) > 0.25, "strong").otherwise("repaired")
    return derived.runs(spark, sf_dir).withColumn("class", F.when(F.col("status") == "ok", done).when(F.col("status").isin("infeasible", "grid"), F.col("status")).otherwise("other"))


@query(f"""WITH {CLASSED}, t AS (SELECT strategy, count(*) AS n, {', '.join(f"count(*) FILTER (class = '{c}') AS {c}" for c in CLASSES)} FROM classed GROUP BY 1) SELECT *, {wilson_sql('repaired', 'n')} FROM t""")
def failure_table_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tables.contingency(_classed(spark, sf_dir), "strategy", "class", CLASSES, "repaired"))


@query(f"WITH {RUNS}, t AS (SELECT amplitude, count(*) AS n, count(*) FILTER (status = 'ok') AS k FROM runs GROUP BY 1) SELECT *, {wilson_sql('k', 'n')} FROM t")
def wilson_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived.runs(spark, sf_dir).groupBy("amplitude").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("k"))
    low, high = intervals.wilson(F.col("k"), F.col("n"))
    return rounded(t.select("*", low.alias("low"), high.alias("high")))


@query(f"""WITH {CLASSED} SELECT coalesce(strategy, 'total') AS strategy, {', '.join(f"count(*) FILTER (class = '{c}') AS {c}" for c in CLASSES)}, count(*) AS total FROM classed GROUP BY ROLLUP (strategy)""")
def outcome_table_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.count_if(F.col("class") == c).alias(c) for c in CLASSES]
    return _classed(spark, sf_dir).rollup("strategy").agg(*counts, F.count("*").alias("total")).withColumn("strategy", F.coalesce("strategy", F.lit("total")))


@query(f"""WITH {MEASURES} SELECT CASE WHEN grouping(kind) = 0 THEN 'kind' WHEN grouping(state) = 0 THEN 'state' ELSE '' END AS grouping, kind, state, count(*) AS n, count(DISTINCT cluster) AS clusters,
round(avg(abs(prediction - truth)), 4) AS mae, round(avg(prediction - truth), 4) AS bias, round(sum(abs(prediction - truth)) / sum(abs(truth)), 6) AS relative FROM measures GROUP BY GROUPING SETS ((), (kind), (state))""")
def error_breakdown_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("prediction") - F.col("truth")
    found = tables.grouping_sets(derived.measures(spark, sf_dir), [[], ["kind"], ["state"]], ["kind", "state"], {"n": F.count("*"), "clusters": F.count_distinct("cluster"), "mae": F.round(F.avg(F.abs(error)), 4), "bias": F.round(F.avg(error), 4), "relative": F.round(F.sum(F.abs(error)) / F.sum(F.abs("truth")), 6)})
    return found


@query(f"WITH {RUNS} SELECT strategy, round(quantile_cont(cost, 0.5), 4) AS p50, round(quantile_cont(cost, 0.1), 4) AS p10, round(quantile_cont(cost, 0.9), 4) AS p90, round(quantile_cont(cost, 0.95), 4) AS p95, round(quantile_cont(cost, 0.75) - quantile_cont(cost, 0.25), 4) AS iqr, round(avg(cost), 4) AS mean, min(cost) AS low, max(cost) AS high FROM runs GROUP BY 1")
def percentile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.percentile("cost", F.array(*map(F.lit, (0.5, 0.1, 0.9, 0.95, 0.25, 0.75)))).alias("q")
    t = derived.runs(spark, sf_dir).groupBy("strategy").agg(q, F.avg("cost").alias("mean"), F.min("cost").alias("low"), F.max("cost").alias("high"))
    return rounded(t.select("strategy", *[F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p10", "p90", "p95"))], (F.col("q")[5] - F.col("q")[4]).alias("iqr"), "mean", "low", "high"), 4)


@query("WITH e AS (SELECT min(value) a, max(value) b FROM events) SELECT CAST(least(9, floor((value - a) / ((b - a) / 10))) AS BIGINT) AS bin, count(*) AS n FROM events, e GROUP BY 1")
def histogram_equal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.histogram(table(spark, sf_dir, "events"), "value", 10)


@query(f"WITH {RUNS}, s AS (SELECT strategy, source, stddev_samp(cost) sd FROM runs GROUP BY 1, 2 HAVING count(*) > 1) SELECT strategy, count(*) AS sources, round(quantile_cont(sd, 0.5), 4) AS stability FROM s GROUP BY 1")
def stability_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived.runs(spark, sf_dir).groupBy("strategy", "source").agg(F.stddev_samp("cost").alias("sd"), F.count("*").alias("n")).where("n > 1")
    return rounded(s.groupBy("strategy").agg(F.count("*").alias("sources"), F.percentile("sd", 0.5).alias("stability")), 4)


@query(f"WITH {RUNS} SELECT status AS reason, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM runs WHERE status <> 'ok' GROUP BY 1")
def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived.runs(spark, sf_dir).where("status <> 'ok'").groupBy(F.col("status").alias("reason")).agg(F.count("*").alias("n"))
    return rounded(t.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())))


@query("""WITH a AS (SELECT o.o_custkey AS apartment, l.l_quantity AS area, CASE WHEN l.l_partkey % 5 <> 0 THEN l.l_extendedprice END AS value FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey)
SELECT apartment, count(value) / CAST(count(*) AS DOUBLE) AS coverage, round(sum(value * area) / sum(area) FILTER (value IS NOT NULL), 4) AS label FROM a GROUP BY 1 HAVING count(value) / CAST(count(*) AS DOUBLE) >= 0.5""")
def label_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area-weighted labels of apartments whose labelled share is at least one half; both sides join on the order's key."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("apartment"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("area"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_extendedprice")).alias("value"))
    held = F.sum(F.when(F.col("value").isNotNull(), F.col("area")))
    t = orders.join(lines, "k").groupBy("apartment").agg((F.count("value") / F.count("*")).alias("coverage"), (F.sum(F.col("value") * F.col("area")) / F.nullif(held, F.lit(0.0))).alias("label"))
    return t.where("coverage >= 0.5").withColumn("label", F.round("label", 4))


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def last_row_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.last_row_wins(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["event_id"], "value")


@query(f"WITH {RUNS} SELECT strategy, arg_max(run_id, cost * 1e9 + run_id) AS run_id, max(cost) AS cost FROM runs GROUP BY 1")
def largest_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived.runs(spark, sf_dir).groupBy("strategy").agg(F.max_by(F.struct("run_id", "cost"), F.struct("cost", "run_id")).alias("m"))
    return t.select("strategy", "m.run_id", "m.cost")


@query(f"""WITH {RUNS}, c AS (SELECT source, amplitude, max(CASE WHEN strategy = 'plain' AND status = 'ok' THEN 1 WHEN strategy = 'plain' THEN 0 END) a, max(CASE WHEN strategy = 'tiling' AND status = 'ok' THEN 1 WHEN strategy = 'tiling' THEN 0 END) b FROM runs GROUP BY 1, 2)
SELECT count(*) AS pairs, count(*) FILTER (a = 1 AND b = 0) AS only_a, count(*) FILTER (a = 0 AND b = 1) AS only_b, count(*) FILTER (a = 1 AND b = 1) AS both_ok FROM c WHERE a IS NOT NULL AND b IS NOT NULL""")
def paired_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that were tried with both strategies, and those in which only one succeeded (McNemar's counts)."""
    ok = lambda s: F.max(F.when(F.col("strategy") == s, (F.col("status") == "ok").cast("int")))
    c = derived.runs(spark, sf_dir).groupBy("source", "amplitude").agg(ok("plain").alias("a"), ok("tiling").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return c.agg(F.count("*").alias("pairs"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both_ok"))


@query(f"""WITH {RUNS}, b AS (SELECT source, amplitude, min(cost) AS base FROM runs WHERE strategy = 'plain' GROUP BY 1, 2)
SELECT strategy, count(*) AS n, count(*) FILTER (r.status = 'ok') AS ok, round(quantile_cont((cost - base) / base, 0.5), 6) AS median_gain, round(avg(CASE WHEN cost < base THEN 1.0 ELSE 0 END), 6) AS contradicted FROM runs r JOIN b USING (source, amplitude) GROUP BY 1""")
def ablation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = derived.runs(spark, sf_dir)
    base = runs.where("strategy = 'plain'").groupBy("source", "amplitude").agg(F.min("cost").alias("base"))
    gain = (F.col("cost") - F.col("base")) / F.col("base")
    t = runs.join(base, ["source", "amplitude"]).groupBy("strategy")
    return rounded(t.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.percentile(gain, 0.5).alias("median_gain"), F.avg((F.col("cost") < F.col("base")).cast("double")).alias("contradicted")))


@query(f"""WITH {MEASURES}, r AS (SELECT kind, rank() OVER (PARTITION BY kind ORDER BY prediction) + (count(*) OVER (PARTITION BY kind, prediction) - 1) / 2.0 AS a, rank() OVER (PARTITION BY kind ORDER BY spread) + (count(*) OVER (PARTITION BY kind, spread) - 1) / 2.0 AS b FROM measures)
SELECT kind, count(*) AS n, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1""")
def average_rank_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tables.spearman(derived.measures(spark, sf_dir), ["kind"], "prediction", "spread"))


TESTS = "tests AS (SELECT event_type, event_id, pow(value / 500, 3) * 0.01 AS p FROM events)"


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One test an event; its type's tests are one family."""
    return table(spark, sf_dir, "events").select("event_type", "event_id", (F.pow(F.col("value") / 500, F.lit(3.0)) * 0.01).alias("p"))


@query(f"WITH {TESTS}, r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY event_type) AS m FROM tests WINDOW w AS (PARTITION BY event_type ORDER BY p, event_id)), o AS (SELECT *, bool_and(p <= 0.05 / (m - i + 1)) OVER (PARTITION BY event_type ORDER BY p, event_id ROWS UNBOUNDED PRECEDING) AS rejected FROM r) SELECT event_type, event_id, round(p, 9) AS p, rejected FROM o")
def holm_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tables.holm(_tests(spark, sf_dir), ["event_type"], "p", "event_id", 0.05), 9)


@query(f"WITH {TESTS}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS m FROM tests), l AS (SELECT *, max(CASE WHEN p <= 0.001 * i / m THEN i END) OVER (PARTITION BY event_type) AS last FROM r) SELECT event_type, event_id, round(p, 9) AS p, coalesce(i <= last, false) AS rejected FROM l")
def bh_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tables.benjamini_hochberg(_tests(spark, sf_dir), ["event_type"], "p", "event_id", 0.001), 9)


@query("WITH s AS (SELECT user_id, event_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) - value AS step FROM events) SELECT user_id, count(step) AS steps, count(*) FILTER (step > 0) AS gains, round(sum(step), 4) AS total FROM s GROUP BY 1")
def step_gain_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.lead("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - F.col("value")
    s = table(spark, sf_dir, "events").select("user_id", step.alias("step"))
    return rounded(s.groupBy("user_id").agg(F.count("step").alias("steps"), F.count_if(F.col("step") > 0).alias("gains"), F.sum("step").alias("total")), 4)


@query("WITH s AS (SELECT user_id, ts, event_id, max(value) OVER w AS top, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT user_id, event_id FROM s WHERE n = 3 AND top < 100")
def stalled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    s = table(spark, sf_dir, "events").select("user_id", "event_id", F.max("value").over(w).alias("top"), F.count("*").over(w).alias("n"))
    return s.where("n = 3 AND top < 100").select("user_id", "event_id")


@query("WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) SELECT user_id, count(*) AS n, round(avg(value), 4) AS mean, round(CASE WHEN count(*) < 3 THEN 0 ELSE regr_slope(value, i) END, 6) AS slope FROM s GROUP BY 1")
def trend_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    s = table(spark, sf_dir, "events").select("user_id", "value", i.alias("i")).groupBy("user_id")
    t = s.agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.regr_slope("value", "i").alias("slope_"))
    return t.select("user_id", "n", "mean", F.round(F.when(F.col("n") < 3, 0.0).otherwise(F.col("slope_")), 6).alias("slope"))


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('7:' || CAST(event_id AS VARCHAR)), event_id) i FROM events) q WHERE i = 1")
def one_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.md5(F.concat(F.lit("7:"), F.col("event_id").cast("string")))
    return tables.first_per_group(table(spark, sf_dir, "events"), "event_type", [h, F.col("event_id")]).select("event_type", "event_id", "value")


@query("SELECT user_id, event_id, price, rank FROM (SELECT user_id, event_id, value - 245 AS price, row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 245) DESC, event_id) AS rank FROM events WHERE abs(value - 245) > 1e-6) q WHERE rank <= 10")
def top_k_duals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") - 245).alias("price")).where(F.abs("price") > 1e-6)
    return tables.top(rows, "user_id", [F.desc(F.abs("price")), F.col("event_id")], 10)


@query("SELECT vec_id, round(uncertainty * density, 9) AS score FROM (SELECT vec_id, list_max(list_transform(embedding, lambda v: abs(v::DOUBLE))) AS uncertainty, 1 / (1 + list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS density FROM embeddings) q WHERE vec_id % 3 <> 0 ORDER BY uncertainty * density DESC, vec_id LIMIT 20")
def acquisition_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best candidates outside those excluded: the limit is the operator."""
    e = F.col("embedding").cast("array<double>")
    uncertainty, square = F.array_max(F.transform(e, F.abs)), F.aggregate(e, F.lit(0.0), lambda s, v: s + v * v)
    pool = table(spark, sf_dir, "embeddings").select("vec_id", (uncertainty / (1 + square)).alias("score"))
    excluded = pool.where(F.col("vec_id") % 3 == 0).select("vec_id")
    return rounded(pool.join(excluded, "vec_id", "left_anti").orderBy(F.desc("score"), "vec_id").limit(20), 9)


SPLIT = """groups AS (SELECT DISTINCT source FROM runs), ranked AS (SELECT source, row_number() OVER (ORDER BY md5('11:' || CAST(source AS VARCHAR)), source) AS i, count(*) OVER () AS n FROM groups),
split AS (SELECT source, CASE WHEN i <= round_even(n * 0.6, 0) THEN 'train' WHEN i <= round_even(n * 0.8, 0) THEN 'calibration' ELSE 'test' END AS part FROM ranked)"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.stable_split(derived.runs(spark, sf_dir), "source", (0.6, 0.2, 0.2), ("train", "calibration", "test"), "11")


@query(f"WITH {RUNS}, {SPLIT} SELECT * FROM split")
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)


@query(f"WITH {RUNS}, {SPLIT}, a AS (SELECT r.source, s.part FROM runs r JOIN split s USING (source) UNION ALL SELECT source, 'test' FROM runs WHERE run_id % 50 = 0) SELECT source, count(DISTINCT part) AS parts FROM a GROUP BY 1 HAVING count(DISTINCT part) > 1")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split with some sources put into the test set by mistake: those that are in two sets."""
    runs, split = derived.runs(spark, sf_dir), _split(spark, sf_dir)
    wrong = runs.where(F.col("run_id") % 50 == 0).select("source", F.lit("test").alias("part"))
    return tables.leaking(runs.join(split, "source").select("source", "part").unionByName(wrong), "source", "part")


SETS = "a AS (SELECT DISTINCT source FROM runs WHERE strategy = 'plain'), b AS (SELECT DISTINCT source FROM runs WHERE strategy = 'fallback')"


@query(f"""WITH {RUNS}, {SETS} SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both_, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either""")
def split_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = derived.runs(spark, sf_dir)
    sides = runs.groupBy("source").agg(F.bool_or(F.col("strategy") == "plain").alias("a"), F.bool_or(F.col("strategy") == "fallback").alias("b"))
    return sides.agg(F.count_if(F.col("a") & F.col("b")).alias("both_"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"), F.count_if(F.col("a") | F.col("b")).alias("either"))


@query(f"""WITH {RUNS}, k AS (SELECT source, amplitude FROM runs WHERE strategy = 'plain' INTERSECT SELECT source, amplitude FROM runs WHERE strategy = 'tiling') SELECT amplitude, count(*) AS n FROM k GROUP BY 1""")
def paired_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = lambda s: derived.runs(spark, sf_dir).where(F.col("strategy") == s).select("source", "amplitude")
    return keys("plain").intersect(keys("tiling")).groupBy("amplitude").agg(F.count("*").alias("n"))


@query(f"WITH {MEASURES}, r AS (SELECT kind, sum(cos(radians(deg))) c, sum(sin(radians(deg))) s, count(*) n FROM measures GROUP BY 1) SELECT kind, n, round((degrees(atan2(s, c)) + 360) % 360, 4) AS mean, round(sqrt(c * c + s * s) / n, 6) AS r, round(1 - sqrt(c * c + s * s) / n, 6) AS variance, round(exp(-n * (c * c + s * s) / n / n), 6) AS p FROM r")
def circular_mean_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = circular.resultant(F.col("deg"))
    t = derived.measures(spark, sf_dir).groupBy("kind").agg(c.alias("c"), s.alias("s"), F.count("*").alias("n")).withColumn("r", circular.concentration(F.col("c"), F.col("s"), F.col("n")))
    return t.select("kind", "n", F.round(circular.direction(F.col("c"), F.col("s")), 4).alias("mean"), F.round("r", 6).alias("r"), F.round(1 - F.col("r"), 6).alias("variance"), F.round(circular.rayleigh_p(F.col("r"), F.col("n")), 6).alias("p"))


@query(f"WITH {MEASURES}, r AS (SELECT kind, sum(spread * cos(radians(deg * 4))) c, sum(spread * sin(radians(deg * 4))) s FROM measures GROUP BY 1) SELECT kind, round((degrees(atan2(s, c)) / 4 + 90) % 90, 4) AS dominant FROM r")
def dominant_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = circular.resultant(F.col("deg"), F.col("spread"), 90.0)
    t = derived.measures(spark, sf_dir).groupBy("kind").agg(c.alias("c"), s.alias("s"))
    return t.select("kind", F.round(circular.direction(F.col("c"), F.col("s"), 90.0), 4).alias("dominant"))


@query(f"""WITH {MEASURES} SELECT CAST(floor(((deg + 22.5) % 360) / 45) AS BIGINT) % 8 AS centred, CAST(floor(deg / 45) AS BIGINT) % 8 AS edged, (round_even(deg / 45, 0) * 45) % 360 AS nearest,
substr('NESW', CAST(floor(((deg + 45) % 360) / 90) AS INT) % 4 + 1, 1) AS quadrant, count(*) AS n FROM measures GROUP BY 1, 2, 3, 4""")
def sector_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four conventions side by side; they are kept apart on purpose."""
    d = F.col("deg")
    return derived.measures(spark, sf_dir).groupBy(circular.sector_centred(d, 8).alias("centred"), circular.sector_edged(d, 8).alias("edged"), circular.sector_nearest(d, 45.0).alias("nearest"), circular.quadrant(d).alias("quadrant")).agg(F.count("*").alias("n"))


@query(f"WITH {MEASURES}, s AS (SELECT unnest(range(12)) AS sector), c AS (SELECT CAST(floor(((deg + 15) % 360) / 30) AS BIGINT) % 12 AS sector, avg(prediction) AS mean, count(*) AS n FROM measures WHERE deg < 200 GROUP BY 1) SELECT s.sector, coalesce(n, 0) AS n, round(mean, 4) AS mean FROM s LEFT JOIN c USING (sector)")
def stratified_with_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by sector in which empty sectors stay."""
    found = derived.measures(spark, sf_dir).where("deg < 200").groupBy(circular.sector_centred(F.col("deg"), 12).alias("sector")).agg(F.count("*").alias("n"), F.avg("prediction").alias("mean"))
    return spark.range(12).withColumnRenamed("id", "sector").join(found, "sector", "left").select("sector", F.coalesce("n", F.lit(0)).alias("n"), F.round("mean", 4).alias("mean"))


@query(f"WITH {MEASURES} SELECT deg, round(CASE WHEN ((deg - 350 + 540) % 360) - 180 <= -180 THEN 180 ELSE ((deg - 350 + 540) % 360) - 180 END, 6) AS difference, round(cos(radians(deg)), 6) AS c1, round(sin(radians(2 * deg)), 6) AS s2 FROM (SELECT DISTINCT deg FROM measures) q")
def angular_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("deg")
    h = circular.harmonics(d, 2)
    return rounded(derived.measures(spark, sf_dir).select("deg").distinct().select("deg", circular.angular_difference(d, F.lit(350.0)).alias("difference"), h[0].alias("c1"), h[3].alias("s2")))


SCORES = f"{MEASURES}, scores AS (SELECT kind, part_id, prediction, truth, spread, abs(truth - prediction) / greatest(spread, 1e-12) AS score FROM measures)"
QUANTILE = "ranked AS (SELECT kind, score, row_number() OVER (PARTITION BY kind ORDER BY score) AS i, count(*) OVER (PARTITION BY kind) AS n FROM scores WHERE part_id % 2 = 0), q AS (SELECT kind, n, max(CASE WHEN i = ceil((n + 1) * 90 / 100.0) THEN score END) AS q FROM ranked GROUP BY 1, 2)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.measures(spark, sf_dir).withColumn("score", F.abs(F.col("truth") - F.col("prediction")) / F.greatest("spread", F.lit(1e-12)))


@query(f"WITH {SCORES}, {QUANTILE} SELECT kind, n, round(q, 4) AS q FROM q")
def conformal_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tables.conformal_quantile(_scores(spark, sf_dir).where("part_id % 2 = 0"), ["kind"], "score", 10), 4)


@query(f"WITH {SCORES}, {QUANTILE} SELECT s.kind, count(*) AS n, count(*) FILTER (score <= q) AS covered, round(avg(2 * q * spread), 4) AS width, round(stddev_samp(truth), 4) AS sd, count(*) FILTER (score <= q) / CAST(count(*) AS DOUBLE) BETWEEN 0.86 AND 0.94 AS in_band FROM scores s JOIN q USING (kind) WHERE part_id % 2 = 1 GROUP BY 1")
def conformal_bounds_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir)
    q = tables.conformal_quantile(scores.where("part_id % 2 = 0"), ["kind"], "score", 10).select("kind", "q")
    t = scores.where("part_id % 2 = 1").join(q, "kind").groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("score") <= F.col("q")).alias("covered"), F.avg(2 * F.col("q") * F.col("spread")).alias("width"), F.stddev_samp("truth").alias("sd"))
    return rounded(t.withColumn("in_band", (F.col("covered") / F.col("n")).between(0.86, 0.94)), 4)


@query(f"""WITH {SCORES}, l AS (SELECT unnest([50, 70, 80, 90, 95]) AS level), c AS (SELECT score, row_number() OVER (ORDER BY score) AS i, count(*) OVER () AS n FROM scores WHERE part_id % 2 = 0),
t AS (SELECT level, max(CASE WHEN i = ceil((n + 1) * level / 100.0) THEN score END) AS q FROM c, l GROUP BY 1) SELECT CAST(level AS BIGINT) AS level, round(count(*) FILTER (score <= q) / CAST(count(*) AS DOUBLE), 6) AS empirical FROM scores, t WHERE part_id % 2 = 1 GROUP BY 1""")
def reliability_diagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empirical coverage at nominal levels. The k-th smallest score is found by its place, from counts over ranges of values, never by one sort."""
    scores = _scores(spark, sf_dir).withColumn("all_", F.lit(0))
    placed = tables.ranked(scores.where("part_id % 2 = 0").select("all_", "score"), ["all_"], "score")
    levels = [50, 70, 80, 90, 95]
    k = lambda level: F.ceil((F.col("m_") + 1) * F.lit(level) / 100)
    limit = lambda level: F.max(F.when((F.col("i_") <= k(level)) & (k(level) <= F.col("m_")), F.col("score")))
    limits = placed.agg(*[limit(level).alias(f"q{level}") for level in levels])  # one row
    test = scores.where("part_id % 2 = 1").select("score").crossJoin(F.broadcast(limits))
    counts = test.agg(F.count("*").alias("n"), *[F.count_if(F.col("score") <= F.col(f"q{level}")).alias(f"c{level}") for level in levels])
    found = [F.struct(F.lit(level).cast("long").alias("level"), (F.col(f"c{level}") / F.nullif(F.col("n"), F.lit(0))).alias("empirical")) for level in levels]
    return rounded(counts.select(F.explode(F.array(*found)).alias("r")).select("r.*"))


@query(f"WITH {MEASURES} SELECT kind, count(*) AS n, round(regr_slope(truth, prediction), 6) AS slope, round(regr_intercept(truth, prediction), 3) AS intercept, round(corr(truth, prediction), 6) AS pearson FROM measures GROUP BY 1")
def affine_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived.measures(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.regr_slope("truth", "prediction"), 6).alias("slope"), F.round(F.regr_intercept("truth", "prediction"), 3).alias("intercept"), F.round(F.corr("truth", "prediction"), 6).alias("pearson"))
    return t


@query(f"WITH {MEASURES}, c AS (SELECT quantile_cont(truth, 0.3333333333333333) a, quantile_cont(truth, 0.6666666666666666) b FROM measures) SELECT CASE WHEN a = b THEN 'constant' WHEN truth < a THEN 'low' WHEN truth < b THEN 'mid' ELSE 'high' END AS level, count(*) AS n FROM measures, c GROUP BY 1")
def terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = derived.measures(spark, sf_dir)
    cuts = m.agg(F.percentile("truth", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("c"))
    a, b = F.col("c")[0], F.col("c")[1]
    level = F.when(a == b, "constant").when(F.col("truth") < a, "low").when(F.col("truth") < b, "mid").otherwise("high")
    return m.crossJoin(F.broadcast(cuts)).groupBy(level.alias("level")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings)
SELECT a.label, CAST(a.k - 1 AS BIGINT) AS i, CAST(b.k - 1 AS BIGINT) AS j, count(*) AS n, round(covar_samp(a.v, b.v), 6) AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.k <= b.k GROUP BY 1, 2, 3""")
def feature_envelope_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariances of all pairs of features by label; tasks hand on sums of products, never rows."""
    return rounded(tables.covariances(table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v")), "label", "v"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL)
SELECT a.vec_id, round(greatest(avg(exp(-pow(list_distance(a.v, b.v), 2) / (2 * 2.0 * 2.0))), 1e-12), 6) AS density FROM e a, e b GROUP BY 1""")
def kde_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian kernel density of all vectors, in all dimensions, over all of them, tile by tile."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rounded(tables.kernel_densities(rows, rows, "vec_id", "embedding", 2.0))


@query()
def crps_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian CRPS, in a vectorised function as Spark has no error function."""

    @F.pandas_udf("double")
    def score(prediction: pd.Series, truth: pd.Series, spread: pd.Series) -> pd.Series:
        return pd.Series(distributions.crps(prediction.to_numpy(), truth.to_numpy(), spread.to_numpy()))

    m = derived.measures(spark, sf_dir).withColumn("crps", score("prediction", "truth", "spread"))
    return rounded(m.groupBy("kind").agg(F.count("*").alias("n"), F.avg("crps").alias("crps")), 4)


@query()
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of success rates when whole sources are drawn: sums per source in Spark, draws on the sums of one strategy."""

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source")
        low, high = distributions.cluster_bootstrap(rows["k"].to_numpy(float), rows["n"].to_numpy(float), seed=17)
        return pd.DataFrame({"strategy": [rows["strategy"].iloc[0]], "clusters": [len(rows)], "rate": [rows["k"].sum() / rows["n"].sum()], "low": [low], "high": [high]})

    sums = derived.runs(spark, sf_dir).groupBy("strategy", "source").agg(F.count_if(F.col("status") == "ok").alias("k"), F.count("*").alias("n"))
    return sums.groupBy("strategy").applyInPandas(draw, "strategy string, clusters long, rate double, low double, high double")


@query()
def equivalence_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOST, the corrected resampled t test and the power of a t test from each group's moments."""
    error = F.col("prediction") / F.col("truth") - 0.95

    def tests(batches):
        for rows in batches:
            rows["tost_p"] = [distributions.tost(m, s, int(n), 0.01) for m, s, n in zip(rows["mean"], rows["sd"], rows["n"], strict=True)]
            both = [distributions.nadeau_bengio(m, s, int(n), 80, 20) for m, s, n in zip(rows["mean"], rows["sd"], rows["n"], strict=True)]
            rows["t"], rows["p"] = [x[0] for x in both], [x[1] for x in both]
            rows["power"] = [distributions.power(0.01, s, 30) for s in rows["sd"]]
            yield rows

    moments = derived.measures(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.avg(error).alias("mean"), F.stddev_samp(error).alias("sd"))
    return moments.mapInPandas(tests, "kind string, n long, mean double, sd double, tost_p double, t double, p double, power double")


@query()
def exact_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clopper-Pearson intervals and exact McNemar tests on counts."""

    @F.pandas_udf("low double, high double, mcnemar double")
    def exact(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = [(*distributions.clopper_pearson(int(a), int(b)), distributions.binomial_two_sided(int(a), int(b))) for a, b in zip(k, n, strict=True)]
        return pd.DataFrame(rows, columns=["low", "high", "mcnemar"])

    counts = derived.runs(spark, sf_dir).groupBy("amplitude").agg(F.count_if(F.col("status") == "ok").alias("k"), F.count("*").alias("n"))
    return counts.withColumn("e", exact("k", "n")).select("amplitude", "k", "n", "e.*")


@query(f"""WITH {MEASURES}, r AS (SELECT truth / 1000 AS v, state = 'F' AS f FROM measures), c AS (SELECT v, sum(CASE WHEN f THEN 1 ELSE 0 END) a, sum(CASE WHEN f THEN 0 ELSE 1 END) b FROM r GROUP BY 1),
e AS (SELECT v, sum(a) OVER (ORDER BY v) / CAST(sum(a) OVER () AS DOUBLE) fa, sum(b) OVER (ORDER BY v) / CAST(sum(b) OVER () AS DOUBLE) fb FROM c) SELECT round(max(abs(fa - fb)), 6) AS ks FROM e""")
def ks_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance: running counts within value ranges, on top of the ranges' totals."""
    rows = derived.measures(spark, sf_dir).select((F.col("truth") / 1000).alias("v"), (F.col("state") == "F").alias("f"))
    counts = rows.groupBy("v").agg(F.count_if(F.col("f")).alias("a"), F.count_if(~F.col("f")).alias("b")).withColumn("bin", F.floor("v"))
    bins = counts.groupBy("bin").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = Window.partitionBy()
    bins = bins.select("bin", F.coalesce(F.sum("sa").over(before), F.lit(0)).alias("pa"), F.coalesce(F.sum("sb").over(before), F.lit(0)).alias("pb"), F.sum("sa").over(totals).alias("na"), F.sum("sb").over(totals).alias("nb"))
    inside = Window.partitionBy("bin").orderBy("v")
    fa, fb = (F.sum("a").over(inside) + F.col("pa")) / F.col("na"), (F.sum("b").over(inside) + F.col("pb")) / F.col("nb")
    return rounded(counts.join(bins, "bin").select(F.abs(fa - fb).alias("gap")).agg(F.max("gap").alias("ks")))
