"""Queries of the experiments: cases, published claims computed again, generation tables, bounds, models' spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oblong.functions import intervals
from oblong.operators import layouts, resampling, tables
from oblong.plans import derived
from oblong.plans.derived import MEASURES, ROOMS, RUNS
from oblong.plans.geometry_queries import covered_sql
from oblong.plans.hashing import digits, digits_sql
from oblong.plans.layout_queries import CHANGES, PAIRS, _after
from oblong.plans.registry import query, rounded
from oblong.plans.table_queries import wilson_sql
from oblong.sources.tables import table


@query("WITH o AS (SELECT o_orderkey AS plan_id, CAST(o_orderkey * 7 % 360 AS DOUBLE) AS deg FROM orders) SELECT plan_id, CAST(k AS BIGINT) AS variant, (deg + k * 45) % 360 AS azimuth FROM o, (SELECT unnest(range(8)) AS k) q")
def azimuth_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each plan at eight azimuths."""
    plans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), (F.col("o_orderkey") * 7 % 360).cast("double").alias("deg"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("variant"))
    return plans.select("plan_id", "variant", F.pmod(F.col("deg") + F.col("variant") * 45, F.lit(360.0)).alias("azimuth"))


@query("""WITH p AS (SELECT CASE WHEN o_orderkey % 90 = 53 THEN 0 ELSE o_orderkey % 90 END AS seed, o_orderkey AS plan_id FROM orders), c AS (SELECT plan_id, 3.0 + seed % 9 * 0.25 AS cx, 3.0 + seed // 9 * 0.3 AS cy FROM p),
r AS (SELECT plan_id, unnest([{'room_id': 0, 'x': 0, 'y': 0, 'w': cx, 'h': cy}, {'room_id': 1, 'x': cx, 'y': 0, 'w': 8 - cx, 'h': cy}, {'room_id': 2, 'x': 0, 'y': cy, 'w': cx, 'h': 8 - cy}, {'room_id': 3, 'x': cx, 'y': cy, 'w': 8 - cx, 'h': 8 - cy}]) AS r FROM c)
SELECT CAST(plan_id AS BIGINT) AS plan_id, CAST(r.room_id AS BIGINT) AS room_id, ['living_room', 'bedroom', 'kitchen', 'bathroom'][r.room_id + 1] AS room_type, CAST(r.x AS DOUBLE) AS x, CAST(r.y AS DOUBLE) AS y, CAST(r.w AS DOUBLE) AS w, CAST(r.h AS DOUBLE) AS h FROM r""")
def generated_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan an order, of four typed rooms that tile a square, of one of ninety kinds of which the 54th is a copy of the first."""
    key = F.col("o_orderkey") % 90
    seed = F.when(key == 53, F.lit(0)).otherwise(key)
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), (3.0 + seed % 9 * 0.25).alias("cx"), (3.0 + F.floor(seed / 9) * 0.3).alias("cy"))
    zero, cx, cy = F.lit(0.0), F.col("cx"), F.col("cy")
    cells = [("living_room", zero, zero, cx, cy), ("bedroom", cx, zero, 8 - cx, cy), ("kitchen", zero, cy, cx, 8 - cy), ("bathroom", cx, cy, 8 - cx, 8 - cy)]
    rooms = [F.struct(F.lit(i).cast("long").alias("room_id"), F.lit(t).alias("room_type"), *[v.cast("double").alias(k) for k, v in zip("xywh", vs, strict=True)]) for i, (t, *vs) in enumerate(cells)]
    return c.select("plan_id", F.explode(F.array(*rooms)).alias("r")).select("plan_id", "r.*")


HIT = f"""n AS (SELECT plan_id, count(*) AS n FROM rooms GROUP BY 1), hit AS (SELECT plan_id, k AS init, {digits_sql('17', 'plan_id', 'k')} % n + 1 AS hit, {digits_sql('18', 'plan_id', 'k')} % 4 AS field, CASE WHEN {digits_sql('19', 'plan_id', 'k')} % 2 = 0 THEN 0.25 ELSE -0.25 END AS fault FROM n, (SELECT unnest(range(3)) AS k) q)"""


@query(f"""WITH {ROOMS}, {HIT} SELECT r.plan_id, CAST(init AS BIGINT) AS init, room_id, x + CASE WHEN room_id = hit AND field = 0 THEN fault ELSE 0 END AS x, y + CASE WHEN room_id = hit AND field = 1 THEN fault ELSE 0 END AS y,
w + CASE WHEN room_id = hit AND field = 2 THEN abs(fault) ELSE 0 END AS w, h + CASE WHEN room_id = hit AND field = 3 THEN abs(fault) ELSE 0 END AS h FROM rooms r JOIN hit USING (plan_id)""")
def seeded_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three corrupted copies of each plan: one room is moved or enlarged by 0.25 m, drawn by a hash."""
    rooms = derived.rooms(spark, sf_dir)
    n = rooms.groupBy("plan_id").agg(F.count("*").alias("n")).withColumn("init", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    hit = n.select("plan_id", "init", (digits("17", "plan_id", "init") % F.col("n") + 1).alias("hit"), (digits("18", "plan_id", "init") % 4).alias("field"), F.when(digits("19", "plan_id", "init") % 2 == 0, 0.25).otherwise(-0.25).alias("fault"))
    off = lambda k: F.when((F.col("room_id") == F.col("hit")) & (F.col("field") == k), F.col("fault") if k < 2 else F.abs("fault")).otherwise(0.0)
    return rooms.join(hit, "plan_id").select("plan_id", "init", "room_id", *[(F.col(c) + off(k)).alias(c) for k, c in enumerate("xywh")])


@query(f"SELECT event_id, round(value, 6) AS value FROM events ORDER BY {digits_sql('5', 'event_id')}, event_id LIMIT 20")
def random_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rows without replacement by a seeded hash: the limit is the operator."""
    return rounded(table(spark, sf_dir, "events").orderBy(digits("5", "event_id"), "event_id").limit(20).select("event_id", "value"))


@query(f"""WITH {RUNS}, k AS (SELECT run_id, CAST(source AS VARCHAR) || '/' || strategy || '/' || CAST(amplitude AS VARCHAR) || '/' || CAST(run_id AS VARCHAR) AS key FROM runs), p AS (SELECT *, string_split(CASE WHEN run_id % 7 = 0 THEN replace(key, '/plain/', '//') ELSE key END, '/') AS parts FROM k)
SELECT run_id, parts[1] AS source, parts[2] AS corruption, parts[3] AS variant, len(parts) = 4 AND list_min(list_transform(parts, lambda v: length(v))) > 0 AS valid FROM p""")
def sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of four parts written, some of them damaged, and parsed again."""
    key = F.concat_ws("/", F.col("source").cast("string"), "strategy", F.col("amplitude").cast("string"), F.col("run_id").cast("string"))
    damaged = F.when(F.col("run_id") % 7 == 0, F.replace(key, F.lit("/plain/"), F.lit("//"))).otherwise(key)
    p = derived.runs(spark, sf_dir).select("run_id", F.split(damaged, "/").alias("p"))
    valid = (F.size("p") == 4) & (F.array_min(F.transform("p", F.length)) > 0)
    return p.select("run_id", F.get("p", F.lit(0)).alias("source"), F.get("p", F.lit(1)).alias("corruption"), F.get("p", F.lit(2)).alias("variant"), valid.alias("valid"))


@query(f"WITH {RUNS} SELECT run_id, strategy, status, moved, CASE WHEN strategy = 'plain' THEN -1 ELSE 1 END AS sign FROM runs")
def parsed_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a Markdown table written and read back by a pattern; the sign says whether less is better."""
    line = F.format_string("| %d | %s | %s | %s |", "run_id", "strategy", "status", F.col("moved").cast("string"))
    cells = F.regexp_extract_all(line, F.lit(r"\|\s*([^|]+?)\s*(?=\|)"), F.lit(1))
    c = derived.runs(spark, sf_dir).select(cells.alias("c"))
    return c.select(F.col("c")[0].cast("long").alias("run_id"), F.col("c")[1].alias("strategy"), F.col("c")[2].alias("status"), F.col("c")[3].cast("double").alias("moved"), F.when(F.col("c")[1] == "plain", -1).otherwise(1).alias("sign"))


@query("SELECT event_type, event_id, printf('%s: a step of 0.10 m gains %.2f', event_type, value) AS sentence FROM events")
def dual_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", "event_id", F.format_string("%s: a step of 0.10 m gains %.2f", "event_type", "value").alias("sentence"))


@query("WITH o AS (SELECT lower(split_part(p_type, ' ', 1)) || '=' || CAST(p_size AS VARCHAR) AS option FROM part) SELECT split_part(option, '=', 1) AS type, min(CAST(split_part(option, '=', 2) AS DOUBLE)) AS least_area, count(*) AS n FROM o GROUP BY 1")
def parsed_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of the form type=area; of repeated ones the smallest area counts."""
    option = F.concat_ws("=", F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))), F.col("p_size").cast("string"))
    o = table(spark, sf_dir, "part").select(F.split(option, "=").alias("o"))
    return o.groupBy(F.col("o")[0].alias("type")).agg(F.min(F.col("o")[1].cast("double")).alias("least_area"), F.count("*").alias("n"))


@query(f"WITH {RUNS} SELECT run_id, 'amplitude=' || CAST(amplitude AS VARCHAR) || ';source=' || CAST(source AS VARCHAR) || ';strategy=' || strategy AS settings FROM runs")
def policy_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings as text in the order of their names, whatever order they come in."""
    held = F.create_map(F.lit("strategy"), F.col("strategy"), F.lit("source"), F.col("source").cast("string"), F.lit("amplitude"), F.col("amplitude").cast("string"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(held)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return derived.runs(spark, sf_dir).select("run_id", text.alias("settings"))


SCORES = f"{MEASURES}, m AS (SELECT *, CASE WHEN quantity = 7 THEN -1 ELSE spread END AS sigma FROM measures), s AS (SELECT kind, abs(truth - prediction) / spread AS score FROM m WHERE sigma > 0), k AS (SELECT kind, score, row_number() OVER (PARTITION BY kind ORDER BY score) AS i, count(*) OVER (PARTITION BY kind) AS n FROM s), q AS (SELECT kind, max(CASE WHEN i = ceil((n + 1) * 90 / 100.0) THEN score END) AS q FROM k GROUP BY 1)"


@query(f"""WITH {SCORES} SELECT kind, CASE state WHEN 'F' THEN 'selected' ELSE 'policy_calibrated' END AS regime, count(*) AS n, count(*) FILTER (sigma <= 0) AS refused, round(min(prediction - q * sigma) FILTER (sigma > 0), 4) AS lowest, round(max(prediction + q * sigma) FILTER (sigma > 0), 4) AS highest FROM m JOIN q USING (kind) GROUP BY 1, 2""")
def selected_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of selected plans and of a calibrated policy; without a valid spread there is none."""
    m = derived.measures(spark, sf_dir).withColumn("sigma", F.when(F.col("quantity") == 7, F.lit(-1.0)).otherwise(F.col("spread")))
    q = tables.conformal_quantile(m.where("sigma > 0").withColumn("score", F.abs(F.col("truth") - F.col("prediction")) / F.col("spread")), ["kind"], "score", 10).select("kind", "q")
    sound, half = F.col("sigma") > 0, F.col("q") * F.col("sigma")
    regime = F.when(F.col("state") == "F", "selected").otherwise("policy_calibrated")
    return rounded(m.join(q, "kind").groupBy("kind", regime.alias("regime")).agg(F.count("*").alias("n"), F.count_if(~sound).alias("refused"), F.min(F.when(sound, F.col("prediction") - half)).alias("lowest"), F.max(F.when(sound, F.col("prediction") + half)).alias("highest")), 4)


@query(f"""WITH {CHANGES}, d AS (SELECT plan_id, coalesce(max(greatest(abs(x1 - x0), abs(y1 - y0), abs(w1 - w0), abs(h1 - h0))), 0) AS largest FROM changes GROUP BY 1), k AS (SELECT largest, row_number() OVER (ORDER BY largest) AS i, count(*) OVER () AS n FROM d)
SELECT max(n) AS n, max(CASE WHEN i = ceil((n + 1) * 90 / 100.0) THEN largest END) AS radius FROM k""")
def trust_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conformal quantile of displacements: how far a plan may move and stay within what was calibrated."""
    rooms = derived.rooms(spark, sf_dir)
    moved = layouts.displacement(layouts.room_changes(rooms, _after(rooms))).withColumn("all_", F.lit(0))
    return tables.conformal_quantile(moved, ["all_"], "largest", 10).select("n", F.col("q").alias("radius"))


def low_high(k: str, n: str, low: str) -> str:
    return wilson_sql(k, n).replace("AS low", f"AS {low}_low").replace("AS high", f"AS {low}_high")


#: The uniform number of a source and a draw, as in ``cluster_intervals``.
WEIGHTS = "[" + ", ".join(repr(t) for t in resampling.poisson_thresholds()) + "]"
UNIFORM = f"({digits_sql('29', 'source', 'draw')} / 4294967296.0)"


@query(f"""WITH {RUNS}, e AS (SELECT coalesce(CAST(amplitude AS VARCHAR), 'all') AS amplitude, source, count(*) AS n, count(*) FILTER (status = 'ok') AS k FROM runs GROUP BY GROUPING SETS ((source), (amplitude, source))),
d AS (SELECT *, len(list_filter({WEIGHTS}, lambda t: t <= {UNIFORM})) AS w FROM e, (SELECT unnest(range(200)) AS draw)), r AS (SELECT amplitude, draw, sum(w * k) / nullif(sum(w * n), 0) AS r FROM d GROUP BY ALL),
q AS (SELECT amplitude, quantile_cont(r, 0.025) AS cluster_low, quantile_cont(r, 0.975) AS cluster_high FROM r GROUP BY 1), t AS (SELECT amplitude, sum(n) AS n, sum(k) AS k, count(DISTINCT source) AS clusters FROM e GROUP BY 1)
SELECT amplitude, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, clusters, {wilson_sql('k', 'n')}, round(cluster_low, 6) AS cluster_low, round(cluster_high, 6) AS cluster_high, k <> n AS below_one FROM t JOIN q USING (amplitude)""")
def claims_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair rates, overall and by amplitude, with Wilson's interval, which takes a source's runs as independent, and one by clusters of sources."""
    runs = derived.runs(spark, sf_dir)
    each = runs.groupingSets([[F.col("source")], [F.col("amplitude"), F.col("source")]], "amplitude", "source").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("k"))
    each = each.withColumn("amplitude", F.coalesce(F.col("amplitude").cast("string"), F.lit("all")))
    drawn = resampling.cluster_intervals(each, ["amplitude"], ["source"], "k", "n", digits("29", "source", "draw") / 4294967296.0)
    t = each.groupBy("amplitude").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(drawn.select("amplitude", "clusters", F.col("low").alias("cluster_low"), F.col("high").alias("cluster_high")), "amplitude")
    low, high = intervals.wilson(F.col("k"), F.col("n"))
    return rounded(t.select("amplitude", "n", "k", "clusters", low.alias("low"), high.alias("high"), "cluster_low", "cluster_high", (F.col("k") != F.col("n")).alias("below_one")))


@query(f"WITH {MEASURES} SELECT kind IN ('A', 'R') AS regulated, min(prediction) AS least, max(prediction) AS most, round(quantile_cont(prediction, 0.5), 4) AS median FROM measures GROUP BY 1")
def claims_regulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = derived.measures(spark, sf_dir).groupBy(F.col("kind").isin("A", "R").alias("regulated")).agg(F.min("prediction").alias("least"), F.max("prediction").alias("most"), F.percentile("prediction", 0.5).alias("median"))
    return t.select("regulated", "least", "most", F.round("median", 4).alias("median"))


@query(f"WITH {MEASURES}, c AS (SELECT kind, cluster, count(*) AS n, avg(abs(truth - prediction)) AS mae, avg(CASE WHEN abs(truth - prediction) <= 0.06 * truth THEN 1.0 ELSE 0.0 END) AS share FROM measures GROUP BY 1, 2), b AS (SELECT avg(abs(truth - prediction)) AS mae FROM measures) SELECT kind, count(*) AS clusters, count(*) FILTER (share >= 0.6) AS reliable, round(avg(c.mae) / any_value(b.mae), 6) AS ratio FROM c, b GROUP BY 1")
def claims_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters in which a model is right often enough, and its error against that of all."""
    error = F.abs(F.col("truth") - F.col("prediction"))
    m = derived.measures(spark, sf_dir)
    c = m.groupBy("kind", "cluster").agg(F.avg(error).alias("mae"), F.avg((error <= 0.06 * F.col("truth")).cast("double")).alias("share"))
    return rounded(c.crossJoin(F.broadcast(m.agg(F.avg(error).alias("all_mae")))).groupBy("kind").agg(F.count("*").alias("clusters"), F.count_if(F.col("share") >= 0.6).alias("reliable"), (F.avg("mae") / F.first("all_mae")).alias("ratio")))


@query(f"WITH {MEASURES}, c AS (SELECT cluster, avg(CASE WHEN abs(truth - prediction) <= 0.09 * truth THEN 1.0 ELSE 0.0 END) AS coverage FROM measures GROUP BY 1) SELECT round(avg(coverage), 6) AS mean, round(quantile_cont(coverage, 0.5), 6) AS median, round(min(coverage), 6) AS least, round(max(coverage), 6) AS most, round(stddev_samp(coverage), 6) AS sd, count(*) FILTER (coverage BETWEEN 0.86 AND 0.94) AS in_band, count(*) AS draws, avg(coverage) < 0.9 AS below_target FROM c")
def claims_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = derived.measures(spark, sf_dir).groupBy("cluster").agg(F.avg((F.abs(F.col("truth") - F.col("prediction")) <= 0.09 * F.col("truth")).cast("double")).alias("coverage"))
    v = F.col("coverage")
    return rounded(c.agg(F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.min(v).alias("least"), F.max(v).alias("most"), F.stddev_samp(v).alias("sd"), F.count_if(v.between(0.86, 0.94)).alias("in_band"), F.count("*").alias("draws"), (F.avg(v) < 0.9).alias("below_target")))


PAIRED = "p AS (SELECT source, avg(moved) FILTER (strategy = 'plain') AS a, avg(moved) FILTER (strategy = 'tiling') AS b FROM runs GROUP BY 1)"


@query(f"""WITH {RUNS}, {PAIRED}, d AS (SELECT a - b AS d, abs(a - b) AS s FROM p WHERE a - b <> 0), c AS (SELECT s, count(*) AS c FROM d GROUP BY 1), r AS (SELECT d, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM d),
w AS (SELECT count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0) AS w_minus FROM r), t AS (SELECT sum(c * c * c - c) AS tie FROM c)
SELECT wins, losses, pairs, round(median, 6) AS median, w_plus, w_minus, round((w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tie / 48.0), 6) AS z
FROM (SELECT count(*) FILTER (a < b) AS wins, count(*) FILTER (a > b) AS losses, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS pairs, quantile_cont(a - b, 0.5) AS median FROM p), w, t""")
def claims_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired comparison of two strategies by source, with Wilcoxon's signed ranks."""
    side = lambda s: F.avg(F.when(F.col("strategy") == s, F.col("moved")))
    p = derived.runs(spark, sf_dir).groupBy("source").agg(side("plain").alias("a"), side("tiling").alias("b"))
    a, b = F.col("a"), F.col("b")
    counts = p.agg(F.count_if(a < b).alias("wins"), F.count_if(a > b).alias("losses"), F.count_if(a.isNotNull() & b.isNotNull()).alias("pairs"), F.percentile(a - b, 0.5).alias("median"))
    return rounded(counts.crossJoin(F.broadcast(resampling.signed_ranks(p, "a", "b").drop("pairs"))))  # one row each


@query(f"""WITH {RUNS}, m AS (SELECT source, strategy, avg(moved) AS v FROM runs GROUP BY 1, 2), f AS (SELECT * FROM m WHERE source IN (SELECT source FROM m GROUP BY 1 HAVING count(*) = 3)),
r AS (SELECT source, strategy, rank() OVER (PARTITION BY source ORDER BY v) + (count(*) OVER (PARTITION BY source, v) - 1) / 2.0 AS r, pow(count(*) OVER (PARTITION BY source, v), 2) - 1 AS tie FROM f),
s AS (SELECT strategy, sum(r) AS s, count(*) AS n, sum(tie) AS tie FROM r GROUP BY 1), t AS (SELECT max(n) AS n, sum(s * s) AS q, sum(tie) AS tie FROM s), x AS (SELECT n, (12.0 / (n * 12) * q - 12 * n) / (1 - tie / (n * 24.0)) AS x FROM t)
SELECT n AS blocks, round(x, 6) AS statistic, round(exp(-x / 2), 6) AS p FROM x""")
def strategy_friedman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the three strategies move rooms differently far, sources being the blocks: Friedman's test on rank sums."""
    return rounded(resampling.friedman_test(derived.runs(spark, sf_dir), "source", "strategy", "moved", ["plain", "tiling", "fallback"]))


CASES = "cases AS (SELECT source, amplitude, bool_or(status = 'ok') FILTER (strategy = 'plain') AS plain, bool_or(status = 'ok') FILTER (strategy = 'tiling') AS tiling, bool_or(status = 'ok') FILTER (strategy = 'fallback') AS fallback FROM runs GROUP BY 1, 2)"


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = [F.bool_or(F.when(F.col("strategy") == s, F.col("status") == "ok")).alias(s) for s in ("plain", "tiling", "fallback")]
    return derived.runs(spark, sf_dir).groupBy("source", "amplitude").agg(*done)


@query(f"WITH {RUNS}, {CASES} SELECT * FROM cases")
def strategy_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each source and amplitude, with every strategy's outcome."""
    return _cases(spark, sf_dir)


@query(f"WITH {RUNS}, {CASES} SELECT count(*) FILTER (plain) AS plain, count(*) FILTER (tiling) AS tiling, count(*) FILTER (fallback) AS fallback, count(*) FILTER (plain AND NOT tiling) AS only_plain, count(*) FILTER (tiling AND NOT plain) AS only_tiling, count(*) AS n FROM cases")
def claims_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that each strategy repairs, and those that only one of two does."""
    a, b = F.col("plain"), F.col("tiling")
    return _cases(spark, sf_dir).agg(F.count_if(a).alias("plain"), F.count_if(b).alias("tiling"), F.count_if("fallback").alias("fallback"), F.count_if(a & ~b).alias("only_plain"), F.count_if(b & ~a).alias("only_tiling"), F.count("*").alias("n"))


@query(f"WITH {RUNS}, t AS (SELECT strategy, amplitude, count(*) AS n, count(*) FILTER (status = 'ok') AS k, count(*) FILTER (status = 'grid') AS grid, round(quantile_cont(cost, 0.5), 4) AS median_cost, round(quantile_cont(CASE WHEN status = 'ok' THEN moved END, 0.5), 6) AS median_move FROM runs GROUP BY 1, 2) SELECT *, {wilson_sql('k', 'n')} FROM t")
def claims_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and medians by mode and budget; moves count only where the repair went well."""
    ok = F.col("status") == "ok"
    t = derived.runs(spark, sf_dir).groupBy("strategy", "amplitude").agg(F.count("*").alias("n"), F.count_if(ok).alias("k"), F.count_if(F.col("status") == "grid").alias("grid"), F.round(F.percentile("cost", 0.5), 4).alias("median_cost"), F.percentile(F.when(ok, F.col("moved")), 0.5).alias("median_move"))
    low, high = intervals.wilson(F.col("k"), F.col("n"))
    return rounded(t.select("*", low.alias("low"), high.alias("high")))


@query(f"WITH {RUNS} SELECT strategy, round(quantile_cont(moved, 0.75) - quantile_cont(moved, 0.25), 6) AS iqr, max(moved) - min(moved) AS extent, count(*) FILTER (moved >= 0.3 - 1e-6) AS saturated, count(*) AS n FROM runs GROUP BY 1")
def claims_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.percentile("moved", F.array(F.lit(0.25), F.lit(0.75)))
    t = derived.runs(spark, sf_dir).groupBy("strategy").agg(q.alias("q"), (F.max("moved") - F.min("moved")).alias("extent"), F.count_if(F.col("moved") >= 0.3 - 1e-6).alias("saturated"), F.count("*").alias("n"))
    return t.select("strategy", F.round(F.col("q")[1] - F.col("q")[0], 6).alias("iqr"), "extent", "saturated", "n")


@query(f"WITH {RUNS}, t AS (SELECT amplitude AS width, count(*) AS n, count(*) FILTER (status = 'ok') AS valid, count(*) FILTER (status = 'ok' AND moved <= 0.05) AS intact, round(quantile_cont(moved, 0.5), 6) AS median_side FROM runs GROUP BY 1) SELECT *, {low_high('valid', 'n', 'valid')}, {low_high('intact', 'n', 'intact')} FROM t")
def width_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid and intact shares for each least width."""
    ok = F.col("status") == "ok"
    t = derived.runs(spark, sf_dir).groupBy(F.col("amplitude").alias("width")).agg(F.count("*").alias("n"), F.count_if(ok).alias("valid"), F.count_if(ok & (F.col("moved") <= 0.05)).alias("intact"), F.percentile("moved", 0.5).alias("median_side"))
    ends = [e.alias(f"{c}_{name}") for c in ("valid", "intact") for e, name in zip(intervals.wilson(F.col(c), F.col("n")), ("low", "high"), strict=True)]
    return rounded(t.select("*", *ends))


DIAGNOSED = f"""{PAIRS}, {covered_sql("whole", "rooms")}, o AS (SELECT plan_id, sum(dx * dy) FILTER (dx * dy > 1e-6) AS overlap, count(*) FILTER ((abs(ax + aw - bx) < 1e-7 OR abs(bx + bw - ax) < 1e-7) AND dy > 1e-7 OR (abs(ay + ah - "by") < 1e-7 OR abs("by" + bh - ay) < 1e-7) AND dx > 1e-7) AS links FROM pairs GROUP BY 1),
b AS (SELECT plan_id, count(*) AS n_rooms, (max(x + w) - min(x)) * (max(y + h) - min(y)) AS box FROM rooms GROUP BY 1), l AS (SELECT plan_id, x AS vx, y AS vy FROM rooms UNION ALL SELECT plan_id, x + w, y + h FROM rooms), c AS (SELECT plan_id, (count(DISTINCT vx) - 1) * (count(DISTINCT vy) - 1) AS cells FROM l GROUP BY 1),
diagnosed AS (SELECT plan_id, n_rooms, coalesce(overlap, 0) / n_rooms AS overlap_per_room, 1 - covered / box AS gap_share, cells, coalesce(links, 0) AS links, CASE WHEN coalesce(links, 0) = 0 THEN 'apart' WHEN links < n_rooms - 1 THEN 'sparse' WHEN links = n_rooms - 1 THEN 'tree' ELSE 'cyclic' END AS topology FROM b JOIN whole USING (plan_id) JOIN c USING (plan_id) LEFT JOIN o USING (plan_id))"""


def _diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap, gaps, cells and the graph of seams of each plan as it came out of a generator."""
    from oblong.operators import tiling

    rooms = derived.rooms(spark, sf_dir)
    pairs = layouts.pair_spans(layouts.both(rooms)).withColumn("area", F.col("dx") * F.col("dy")).where("area > 1e-6")
    overlap = pairs.groupBy("plan_id").agg(F.sum("area").alias("overlap"))
    links = tiling.merges(rooms).groupBy("plan_id").agg(F.count("*").alias("links"))
    far = lambda c, s: F.max(F.col(c) + F.col(s)) - F.min(c)
    box = rooms.groupBy("plan_id").agg(F.count("*").alias("n_rooms"), (far("x", "w") * far("y", "h")).alias("box"))
    ends = rooms.select("plan_id", F.explode(F.array(F.struct(F.col("x").alias("vx"), F.col("y").alias("vy")), F.struct((F.col("x") + F.col("w")).alias("vx"), (F.col("y") + F.col("h")).alias("vy")))).alias("e"))
    cells = ends.groupBy("plan_id").agg(((F.count_distinct("e.vx") - 1) * (F.count_distinct("e.vy") - 1)).alias("cells"))
    j = box.join(layouts.coverage(rooms), "plan_id").join(cells, "plan_id").join(overlap, "plan_id", "left").join(links, "plan_id", "left")
    n = F.coalesce("links", F.lit(0))
    kind = F.when(n == 0, "apart").when(n < F.col("n_rooms") - 1, "sparse").when(n == F.col("n_rooms") - 1, "tree").otherwise("cyclic")
    return j.select("plan_id", "n_rooms", (F.coalesce("overlap", F.lit(0.0)) / F.col("n_rooms")).alias("overlap_per_room"), (1 - F.col("covered") / F.col("box")).alias("gap_share"), "cells", n.alias("links"), kind.alias("topology"))


@query(f"WITH {DIAGNOSED} SELECT plan_id, n_rooms, round(overlap_per_room, 6) AS overlap_per_room, round(gap_share, 6) AS gap_share, cells, links, topology FROM diagnosed")
def plan_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_diagnosed(spark, sf_dir))


@query(f"WITH {DIAGNOSED}, t AS (SELECT topology, count(*) AS n, count(*) FILTER (overlap_per_room <= 1e-6) AS k, round(quantile_cont(CAST(cells AS DOUBLE), 0.5), 6) AS median_cells FROM diagnosed GROUP BY 1) SELECT *, {wilson_sql('k', 'n')} FROM t")
def topology_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans without overlaps by the kind of their graph, which is also the share that survives export."""
    t = _diagnosed(spark, sf_dir).groupBy("topology").agg(F.count("*").alias("n"), F.count_if(F.col("overlap_per_room") <= 1e-6).alias("k"), F.percentile("cells", 0.5).alias("median_cells"))
    low, high = intervals.wilson(F.col("k"), F.col("n"))
    return rounded(t.select("*", low.alias("low"), high.alias("high")))


@query(f"WITH {DIAGNOSED} SELECT round(quantile_cont(overlap_per_room, 0.5), 6) AS overlap_median, round(avg(overlap_per_room), 6) AS overlap_mean, round(quantile_cont(overlap_per_room, 0.95), 6) AS overlap_p95, round(quantile_cont(gap_share, 0.5), 6) AS gap_median, round(avg(gap_share), 6) AS gap_mean, round(quantile_cont(gap_share, 0.95), 6) AS gap_p95, count(*) AS n FROM diagnosed")
def output_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = []
    for name, c in (("overlap", "overlap_per_room"), ("gap", "gap_share")):
        columns += [F.percentile(c, 0.5).alias(f"{name}_median"), F.avg(c).alias(f"{name}_mean"), F.percentile(c, 0.95).alias(f"{name}_p95")]
    return rounded(_diagnosed(spark, sf_dir).agg(*columns, F.count("*").alias("n")))


@query(f"WITH {MEASURES} SELECT plan_id, count(*) AS members, round(avg(prediction), 6) AS mean, round(greatest(coalesce(stddev_samp(prediction), 0), 1e-6), 6) AS sigma FROM measures GROUP BY 1")
def ensemble_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of an ensemble's members for each plan, and their spread, which has a floor."""
    t = derived.measures(spark, sf_dir).groupBy("plan_id").agg(F.count("*").alias("members"), F.avg("prediction").alias("mean"), F.greatest(F.coalesce(F.stddev_samp("prediction"), F.lit(0.0)), F.lit(1e-6)).alias("sigma"))
    return rounded(t)


@query(f"""WITH {MEASURES}, u AS (SELECT *, CASE WHEN line = 7 THEN NULL ELSE truth END AS measured, CAST(floor(deg / 90) AS BIGINT) AS sector FROM measures)
SELECT CASE WHEN grouping(kind) = 0 THEN 'kind' WHEN grouping(sector) = 0 THEN 'sector' WHEN grouping(state) = 0 THEN 'state' ELSE 'all' END AS grouping, coalesce(kind, CAST(sector AS VARCHAR), state, '') AS value, count(measured) AS n, count(*) - count(measured) AS unmeasured, round(avg(abs(prediction - measured)), 4) AS mae, round(corr(prediction, measured), 6) AS pearson FROM u GROUP BY GROUPING SETS ((), (kind), (sector), (state))""")
def surrogate_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors over all measured cases and by three groupings; cases without a measurement are counted, not scored."""
    u = derived.measures(spark, sf_dir).withColumn("measured", F.when(F.col("line") != 7, F.col("truth"))).withColumn("sector", F.floor(F.col("deg") / 90))
    g = u.groupingSets([[], [F.col("kind")], [F.col("sector")], [F.col("state")]], "kind", "sector", "state")
    name = F.when(F.grouping("kind") == 0, "kind").when(F.grouping("sector") == 0, "sector").when(F.grouping("state") == 0, "state").otherwise("all")
    t = g.agg(name.alias("grouping"), F.count("measured").alias("n"), (F.count("*") - F.count("measured")).alias("unmeasured"), F.avg(F.abs(F.col("prediction") - F.col("measured"))).alias("mae_"), F.corr(F.when(F.col("measured").isNotNull(), F.col("prediction")), F.col("measured")).alias("pearson_"))
    return t.select("grouping", F.coalesce("kind", F.col("sector").cast("string"), "state", F.lit("")).alias("value"), "n", "unmeasured", F.round("mae_", 4).alias("mae"), F.round("pearson_", 6).alias("pearson"))


@query(f"""WITH {MEASURES}, e AS (SELECT coalesce(kind, 'all') AS kind, cluster AS source, sum(abs(prediction - truth)) AS err, count(*) AS n FROM measures GROUP BY GROUPING SETS ((cluster), (kind, cluster))),
d AS (SELECT *, len(list_filter({WEIGHTS}, lambda t: t <= {UNIFORM})) AS w FROM e, (SELECT unnest(range(200)) AS draw)), r AS (SELECT kind, draw, sum(w * err) / nullif(sum(w * n), 0) AS r FROM d GROUP BY ALL)
SELECT kind, (SELECT count(DISTINCT source) FROM e x WHERE x.kind = r.kind) AS clusters, (SELECT round(sum(err) / sum(n), 4) FROM e x WHERE x.kind = r.kind) AS mae, round(quantile_cont(r, 0.025), 4) AS low, round(quantile_cont(r, 0.975), 4) AS high FROM r GROUP BY 1""")
def surrogate_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute errors by kind and overall, with intervals when whole clusters are drawn."""
    m = derived.measures(spark, sf_dir)
    error = F.sum(F.abs(F.col("prediction") - F.col("truth"))).alias("err")
    each = m.groupingSets([[F.col("cluster")], [F.col("kind"), F.col("cluster")]], "kind", "cluster").agg(error, F.count("*").alias("n")).select(F.coalesce("kind", F.lit("all")).alias("kind"), F.col("cluster").alias("source"), "err", "n")
    found = resampling.cluster_intervals(each, ["kind"], ["source"], "err", "n", digits("29", "source", "draw") / 4294967296.0)
    return rounded(found.withColumnRenamed("rate", "mae"), 4)
