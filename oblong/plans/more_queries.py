"""Further queries: features, envelopes, shares, imputation, variants, agreement, sparse products, gains and reconciled claims."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oblong.functions import circular
from oblong.operators import layouts, tables
from oblong.plans import derived
from oblong.plans.derived import MEASURES, OPENINGS, ROOMS, RUNS, TYPED
from oblong.plans.layout_queries import CHANGES, SCORED, _after, _scored
from oblong.plans.registry import SQL, query, rounded
from oblong.plans.table_queries import wilson_sql
from oblong.sources.tables import table


@query(f"""WITH {TYPED}, t AS (SELECT *, w * h AS area, 2 * (w + h) AS perimeter, CAST((plan_id * 7) % 360 AS DOUBLE) AS deg FROM typed),
u AS (SELECT *, sum(area) OVER (PARTITION BY plan_id) AS total, count(*) OVER (PARTITION BY plan_id) AS n FROM t)
SELECT plan_id, room_id, area, perimeter, round(12.566370614359172 * area / (perimeter * perimeter), 6) AS compactness, round(area / total, 6) AS share, n AS n_rooms, CASE WHEN room_type = 'bedroom' THEN 1 ELSE 0 END AS is_bedroom, round(cos(radians(deg)), 6) AS c1, round(sin(radians(deg)), 6) AS s1 FROM u""")
def room_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each room for a learned model: shape, share of the plan, type and azimuth."""
    rooms = derived.typed_rooms(spark, sf_dir).withColumn("area", F.col("w") * F.col("h")).withColumn("perimeter", 2 * (F.col("w") + F.col("h")))
    totals = rooms.groupBy("plan_id").agg(F.sum("area").alias("total"), F.count("*").alias("n_rooms"))
    h = circular.harmonics(((F.col("plan_id") * 7) % 360).cast("double"), 1)
    return rounded(rooms.join(totals, "plan_id").select("plan_id", "room_id", "area", "perimeter", (4 * np.pi * F.col("area") / (F.col("perimeter") * F.col("perimeter"))).alias("compactness"), (F.col("area") / F.col("total")).alias("share"), "n_rooms", (F.col("room_type") == "bedroom").cast("int").alias("is_bedroom"), h[0].alias("c1"), h[1].alias("s1")))


@query("""WITH RECURSIVE e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings), m AS (SELECT list(x ORDER BY k) AS m FROM (SELECT k, avg(v) AS x FROM e GROUP BY k)),
c AS (SELECT a.k AS i, b.k AS j, covar_samp(a.v, b.v) + CASE WHEN a.k = b.k THEN 1e-6 ELSE 0 END AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id GROUP BY 1, 2), r AS (SELECT i, list(cov ORDER BY j) AS r FROM c GROUP BY i),
s AS (SELECT 1 AS k, list(r ORDER BY i) AS t FROM r UNION ALL
  SELECT k + 1, list_transform(t, lambda row, i: list_transform(row, lambda x, j: CASE WHEN i = k AND j = k THEN -1 / x WHEN i = k OR j = k THEN x / t[k][k] ELSE x - t[i][k] * t[k][j] / t[k][k] END)) FROM s WHERE k <= len(t)),
inv AS (SELECT t FROM s WHERE k = len(t) + 1), d AS (SELECT vec_id, list_transform(list_zip(embedding, m), lambda z: CAST(z[1] AS DOUBLE) - z[2]) AS d FROM embeddings, m WHERE embedding IS NOT NULL)
SELECT vec_id, round(sqrt(greatest(-list_dot_product(d, list_transform(t, lambda row: list_dot_product(row, d))), 0)), 5) AS distance FROM d, inv""")
def mahalanobis_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every vector from the table's ridge-regularised envelope, in all dimensions."""
    return rounded(tables.envelope_distances(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), 5)


@query(f"WITH {TYPED} SELECT plan_id, room_id, round(g.least_area * w * h / sum(w * h) OVER (PARTITION BY plan_id, room_type) + 1e-9, 6) AS least FROM typed JOIN regulation g USING (room_type)")
def minimum_area_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type's least area dealt to the plan's rooms of that type by their areas."""
    rooms = derived.typed_rooms(spark, sf_dir).withColumn("least", derived.least_area(F.col("room_type"))).where("least IS NOT NULL").withColumn("area", F.col("w") * F.col("h"))
    sums = rooms.groupBy("plan_id", "room_type").agg(F.sum("area").alias("total"))
    return rounded(rooms.join(sums, ["plan_id", "room_type"]).select("plan_id", "room_id", (F.col("least") * F.col("area") / F.col("total") + 1e-9).alias("least")))


@query(f"WITH {OPENINGS}, added AS (SELECT plan_id, wall_id, 0.5 AS s, 0.3 AS relative_width FROM walls w WHERE NOT EXISTS (SELECT 1 FROM openings o WHERE o.plan_id = w.plan_id AND o.wall_id = w.wall_id)) SELECT plan_id, wall_id, CAST(s AS DOUBLE) AS s, CAST(relative_width AS DOUBLE) AS relative_width FROM added")
def imputed_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A centred opening for every wall that has none."""
    bare = derived.walls(spark, sf_dir).join(derived.openings(spark, sf_dir).select("plan_id", "wall_id"), ["plan_id", "wall_id"], "left_anti")
    return bare.select("plan_id", "wall_id", F.lit(0.5).alias("s"), F.lit(0.3).alias("relative_width"))


@query(SQL["coverage_sweep"].replace("SELECT plan_id, sum(", ", areas AS (SELECT plan_id, sum(").replace("FROM j GROUP BY 1", "FROM j GROUP BY 1) SELECT round(sqrt(60 / quantile_cont(covered, 0.5)), 6) AS scale, count(*) AS plans FROM areas"))
def generated_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor that gives plans a median area of 60."""
    areas = layouts.coverage(derived.rooms(spark, sf_dir))
    return rounded(areas.agg(F.percentile("covered", 0.5).alias("m"), F.count("*").alias("plans")).select(F.sqrt(60 / F.col("m")).alias("scale"), "plans"))


@query(f"""WITH {ROOMS}, a AS (SELECT unnest([0, 45, 90, 135, 180, 225, 270, 315]) AS turn), v AS (SELECT DISTINCT plan_id FROM rooms) SELECT turn AS azimuth, count(*) AS n, round(avg(((plan_id * 7) % 360 + turn) % 360), 6) AS mean_deg FROM v, a GROUP BY 1""")
def azimuth_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each plan turned to eight azimuths."""
    plans = derived.rooms(spark, sf_dir).select("plan_id").distinct().select("plan_id", F.explode(F.sequence(F.lit(0), F.lit(315), F.lit(45))).alias("azimuth"))
    return rounded(plans.groupBy("azimuth").agg(F.count("*").alias("n"), F.avg(F.pmod((F.col("plan_id") * 7) % 360 + F.col("azimuth"), F.lit(360))).alias("mean_deg")))


@query("""WITH p AS (SELECT a.label, a.vec_id, a.embedding x, b.embedding y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), c AS (SELECT label, vec_id, unnest(x) u, unnest(y) v FROM p),
s AS (SELECT label, vec_id, avg(CASE WHEN sign(u) = sign(v) THEN 1.0 ELSE 0 END) FILTER (abs(u) > 0.01 AND abs(v) > 0.01) AS agree, sum(CAST(u AS DOUBLE) * v) / sqrt(sum(CAST(u AS DOUBLE) * u) * sum(CAST(v AS DOUBLE) * v)) AS cosine FROM c GROUP BY 1, 2)
SELECT label, count(*) AS n, round(avg(agree), 5) AS sign_agreement, round(avg(cosine), 5) AS mean_cosine FROM s GROUP BY 1""")
def gradient_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign agreement on coordinates that are not flat, and mean cosine, of each vector and the next."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    both = F.filter(F.zip_with("x", "y", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: (F.abs(p["a"]) > 0.01) & (F.abs(p["b"]) > 0.01))
    agree = F.size(F.filter(both, lambda p: F.signum(p["a"]) == F.signum(p["b"]))) / F.size(both)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda s, t: s * t), F.lit(0.0), lambda u, w: u + w)
    return rounded(pairs.groupBy("label").agg(F.count("*").alias("n"), F.avg(agree).alias("sign_agreement"), F.avg(dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y"))).alias("mean_cosine")), 5)


@query(f"""WITH {ROOMS}, v AS (SELECT plan_id, room_id, 'x' AS field, x AS value FROM rooms UNION ALL SELECT plan_id, room_id, 'w', w FROM rooms UNION ALL SELECT plan_id, room_id, 'y', y FROM rooms UNION ALL SELECT plan_id, room_id, 'h', h FROM rooms),
coo AS (SELECT plan_id, 'right ' || room_id AS r, room_id, f AS field, 1.0 AS coefficient, 14.0 AS rhs FROM rooms, (SELECT unnest(['x', 'w']) f) UNION ALL SELECT plan_id, 'top ' || room_id, room_id, f, 1.0, 11.0 FROM rooms, (SELECT unnest(['y', 'h']) f)),
s AS (SELECT plan_id, r, sum(coefficient * value) AS lhs, max(rhs) AS rhs FROM coo JOIN v USING (plan_id, room_id, field) GROUP BY 1, 2) SELECT plan_id, count(*) AS n_rows, count(*) FILTER (lhs > rhs + 1e-6) AS violated FROM s GROUP BY 1""")
def polytope_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feasibility of each plan in its outline's half-planes, as a sparse product: coefficients joined with values and summed."""
    rooms = derived.rooms(spark, sf_dir)
    value = lambda c: F.struct(F.lit(c).alias("field"), F.col(c).alias("value"))
    values = rooms.select("plan_id", "room_id", F.explode(F.array(*map(value, "xywh"))).alias("v")).select("plan_id", "room_id", "v.*")
    entry = lambda side, field, rhs: F.struct(F.lit(side).alias("side"), F.lit(field).alias("field"), F.lit(1.0).alias("coefficient"), F.lit(rhs).alias("rhs"))
    entries = F.array(entry("right", "x", 14.0), entry("right", "w", 14.0), entry("top", "y", 11.0), entry("top", "h", 11.0))
    coefficients = rooms.select("plan_id", "room_id", F.explode(entries).alias("e")).select("plan_id", "room_id", "e.*")
    lhs = coefficients.join(values, ["plan_id", "room_id", "field"]).groupBy("plan_id", "room_id", "side").agg(F.sum(F.col("coefficient") * F.col("value")).alias("lhs"), F.max("rhs").alias("rhs"))
    return lhs.groupBy("plan_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("lhs") > F.col("rhs") + 1e-6).alias("violated"))


@query(f"""WITH {ROOMS}, s AS (SELECT plan_id, room_id, w, h, sqrt(6 / (w * h)) AS t FROM rooms WHERE w * h < 6 - 1e-9) SELECT plan_id, room_id, round(h * t, 6) AS u, round(w * t, 6) AS v, CAST(12 AS DOUBLE) AS rhs FROM s""")
def area_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tangent u w + v h >= rhs for every room under an area of six."""
    short = derived.rooms(spark, sf_dir).where(F.col("w") * F.col("h") < 6 - 1e-9).withColumn("t", F.sqrt(6 / (F.col("w") * F.col("h"))))
    return rounded(short.select("plan_id", "room_id", (F.col("h") * F.col("t")).alias("u"), (F.col("w") * F.col("t")).alias("v"), F.lit(12.0).alias("rhs")))


GAINS = f"""{SCORED}, b AS (SELECT plan_id, sum(analytic) AS before, sum(analytic + df * w * h) AS after FROM a GROUP BY 1)"""


@query(f"""WITH {GAINS} SELECT plan_id, round(100 * (after - before) / abs(before), 3) AS gain_percent, CASE WHEN after > before THEN 'confirmed' WHEN after < before THEN 'contradicted' ELSE 'unchanged' END AS status FROM b""")
def before_after_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _scored(spark, sf_dir).groupBy("plan_id").agg(F.sum("analytic").alias("before"), F.sum("split_flux").alias("after"))
    status = F.when(F.col("after") > F.col("before"), "confirmed").when(F.col("after") < F.col("before"), "contradicted").otherwise("unchanged")
    return rounded(b.select("plan_id", (100 * (F.col("after") - F.col("before")) / F.abs("before")).alias("gain_percent"), status.alias("status")), 3)


@query(f"""WITH {SCORED}, p AS (SELECT plan_id, sum(analytic) AS analytic, sum(df) AS daylight, sum(w * h) AS area FROM a GROUP BY 1) SELECT method, count(*) AS n, round(avg(score), 4) AS mean FROM p UNPIVOT (score FOR method IN (analytic, daylight, area)) GROUP BY 1""")
def compare_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of plans under several methods."""
    p = _scored(spark, sf_dir).groupBy("plan_id").agg(F.sum("analytic").alias("analytic"), F.sum("df").alias("daylight"), F.sum(F.col("w") * F.col("h")).alias("area"))
    return rounded(p.unpivot("plan_id", ["analytic", "daylight", "area"], "method", "score").groupBy("method").agg(F.count("*").alias("n"), F.avg("score").alias("mean")), 4)


@query(f"""WITH {RUNS}, t AS (SELECT 'repair' AS bench, 'rate ' || strategy AS quantity, count(*) FILTER (status = 'ok') / CAST(count(*) AS DOUBLE) AS value FROM runs GROUP BY strategy
UNION ALL SELECT 'cost', 'median', quantile_cont(cost, 0.5) FROM runs UNION ALL SELECT 'cost', 'range', max(cost) - min(cost) FROM runs UNION ALL SELECT 'move', 'strong share', avg(CASE WHEN moved > 0.25 THEN 1.0 ELSE 0 END) FROM runs) SELECT bench, quantity, round(value, 6) AS value FROM t""")
def reconciled_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published figures computed again from the raw rows, one row for each."""
    runs = derived.runs(spark, sf_dir)
    rates = runs.groupBy("strategy").agg((F.count_if(F.col("status") == "ok") / F.count("*")).alias("value")).select(F.lit("repair").alias("bench"), F.concat(F.lit("rate "), "strategy").alias("quantity"), "value")
    whole = runs.agg(F.percentile("cost", 0.5).alias("m"), (F.max("cost") - F.min("cost")).alias("r"), F.avg((F.col("moved") > 0.25).cast("double")).alias("s"))
    claim = lambda bench, quantity, column: F.struct(F.lit(bench).alias("bench"), F.lit(quantity).alias("quantity"), F.col(column).alias("value"))
    rest = whole.select(F.explode(F.array(claim("cost", "median", "m"), claim("cost", "range", "r"), claim("move", "strong share", "s"))).alias("c")).select("c.*")
    return rounded(rates.unionByName(rest))


@query(f"""WITH {ROOMS}, d AS (SELECT plan_id, count(*) AS n_rooms, (count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) AS cells, min(least(w, h)) AS side FROM rooms GROUP BY 1), t AS (SELECT n_rooms, count(*) AS n, count(*) FILTER (cells <= 16) AS k, quantile_cont(cells, 0.5) AS median_cells FROM d GROUP BY 1) SELECT n_rooms, n, k, median_cells, {wilson_sql('k', 'n')} FROM t""")
def size_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans by number of rooms: how many have a small grid, and the median number of its cells; distinct counts are exact."""
    from oblong.functions.intervals import wilson

    cells = (F.count_distinct("x") - 1) * (F.count_distinct("y") - 1)
    d = derived.rooms(spark, sf_dir).groupBy("plan_id").agg(F.count("*").alias("n_rooms"), cells.alias("cells"))
    t = d.groupBy("n_rooms").agg(F.count("*").alias("n"), F.count_if(F.col("cells") <= 16).alias("k"), F.percentile("cells", 0.5).alias("median_cells"))
    low, high = wilson(F.col("k"), F.col("n"))
    return rounded(t.select("*", low.alias("low"), high.alias("high")))


@query(f"""WITH {CHANGES}, d AS (SELECT plan_id, max(abs(x1 - x0) + abs(w1 - w0)) AS wall_shift, max(abs(w1 * h1 - w0 * h0)) AS area_change, count(x0) <> count(x1) AS refused FROM changes GROUP BY 1) SELECT refused, count(*) AS n, round(avg(wall_shift), 6) AS mean_shift, round(max(area_change), 6) AS worst_area FROM d GROUP BY 1""")
def measured_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall shifts and area changes of rooms; a plan whose states have different rooms is refused by the strict distance."""
    rooms = derived.rooms(spark, sf_dir)
    c = layouts.room_changes(rooms, _after(rooms))
    shift, area = F.abs(F.col("x1") - F.col("x0")) + F.abs(F.col("w1") - F.col("w0")), F.abs(F.col("w1") * F.col("h1") - F.col("w0") * F.col("h0"))
    d = c.groupBy("plan_id").agg(F.max(shift).alias("wall_shift"), F.max(area).alias("area_change"), (F.count("x0") != F.count("x1")).alias("refused"))
    return rounded(d.groupBy("refused").agg(F.count("*").alias("n"), F.avg("wall_shift").alias("mean_shift"), F.max("area_change").alias("worst_area")))


@query(f"""WITH {MEASURES}, m AS (SELECT kind, cos(radians(deg)) AS c, sin(radians(deg)) AS s, prediction AS y FROM measures), t AS (SELECT kind, sum(c * c) cc, sum(c * s) cs, sum(c) co, sum(s * s) ss, sum(s) so, count(*) oo, sum(c * y) cy, sum(s * y) sy, sum(y) oy FROM m GROUP BY 1),
d AS (SELECT *, cc * (ss * oo - so * so) - cs * (cs * oo - so * co) + co * (cs * so - ss * co) AS det FROM t)
SELECT kind, round((cy * (ss * oo - so * so) - cs * (sy * oo - so * oy) + co * (sy * so - ss * oy)) / det, 4) AS a, round((cc * (sy * oo - so * oy) - cy * (cs * oo - so * co) + co * (cs * oy - sy * co)) / det, 4) AS b, round((cc * (ss * oy - sy * so) - cs * (cs * oy - sy * co) + cy * (cs * so - ss * co)) / det, 4) AS c FROM d""")
def circular_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares on cosine, sine and a constant: nine sums a group in Spark, a 3 x 3 system for each group."""
    m = derived.measures(spark, sf_dir).select("kind", F.cos(F.radians("deg")).alias("c"), F.sin(F.radians("deg")).alias("s"), F.lit(1.0).alias("o"), "prediction")
    names = ("c", "s", "o")
    sums = m.groupBy("kind").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for i, a in enumerate(names) for b in names[i:]], *[F.sum(F.col(a) * F.col("prediction")).alias(f"{a}y") for a in names])

    def solve(batches):
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                left = np.array([[r["".join(sorted((a, b), key=names.index))] for b in names] for a in names])
                out.append((r["kind"], *np.linalg.solve(left, [r[f"{a}y"] for a in names])))
            yield pd.DataFrame(out, columns=["kind", "a", "b", "c"])

    return rounded(sums.mapInPandas(solve, "kind string, a double, b double, c double"), 4)


@query(f"WITH {MEASURES} SELECT CASE WHEN kind = 'A' THEN 'exchangeable' WHEN kind = 'N' THEN 'selected' ELSE 'policy_calibrated' END AS regime, count(*) AS n, round(avg(prediction - 1.5 * spread), 4) AS lower, round(avg(prediction + 1.5 * spread), 4) AS upper FROM measures WHERE spread > 0 GROUP BY 1")
def bounds_by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals around predictions, named by the regime under which they hold; rows without a positive spread have none."""
    m = derived.measures(spark, sf_dir).where("spread > 0")
    regime = F.when(F.col("kind") == "A", "exchangeable").when(F.col("kind") == "N", "selected").otherwise("policy_calibrated")
    return rounded(m.groupBy(regime.alias("regime")).agg(F.count("*").alias("n"), F.avg(F.col("prediction") - 1.5 * F.col("spread")).alias("lower"), F.avg(F.col("prediction") + 1.5 * F.col("spread")).alias("upper")), 4)


@query(f"""WITH {MEASURES}, d AS (SELECT kind, sha256(concat_ws('|', plan_id, line, CAST(round(deg) AS BIGINT), CAST(round(truth * 100) AS BIGINT))) AS h FROM measures),
s AS (SELECT kind, count(*) AS n, sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) AS a, sum(CAST('0x' || substr(h, 16, 15) AS HUGEINT)) AS b, sum(CAST('0x' || substr(h, 31, 15) AS HUGEINT)) AS c FROM d GROUP BY 1)
SELECT kind, n, sha256(concat_ws('|', n, a, b, c)) AS fingerprint FROM s""")
def training_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of each kind's training rows, the same in whatever order and partitions they lie: sums of their digests' parts."""
    return fingerprints(derived.measures(spark, sf_dir), "kind", [F.col("plan_id"), F.col("line"), F.round("deg").cast("long"), F.round(F.col("truth") * 100).cast("long")])


def fingerprints(rows: DataFrame, group: str, values: list) -> DataFrame:
    """(group, n, fingerprint). A row is digested whole; three sums of sixty bits of the digests, and the count, name the multiset of rows."""
    digest = F.sha2(F.concat_ws("|", *[v.cast("string") for v in values]), 256)
    part = lambda k: F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)"))
    sums = rows.select(group, digest.alias("h")).groupBy(group).agg(F.count("*").alias("n"), *[part(k).cast("decimal(38,0)").alias(f"s{k}") for k in range(3)])
    return sums.select(group, "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[F.col(f"s{k}").cast("string") for k in range(3)]), 256).alias("fingerprint"))
