"""Tests and intervals over blocks and clusters as aggregations: rank sums, signed ranks, bootstraps by weights; no group meets in one task."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oblong.operators import tables
from oblong.operators.distributions import chi2_sf


def friedman_test(rows: DataFrame, block: str, treatment: str, value: str, treatments: list[str]) -> DataFrame:
    """(blocks, statistic, p): whether treatments differ, by their ranks within blocks, ties sharing their mean and corrected for.

    Only blocks with one value or more of every treatment count; several are averaged. Ranks are found within a block, whose rows are as
    many as there are treatments; what is summed up are rank sums and tie terms.
    """
    means = rows.where(F.col(treatment).isin(treatments) & F.col(value).isNotNull()).groupBy(block, treatment).agg(F.avg(value).alias("v"))
    k = len(treatments)
    own = F.array_sort(F.collect_list(F.struct("v", F.col(treatment).alias("t"))))
    whole = means.groupBy(block).agg(own.alias("r")).where(F.size("r") == k)
    below = lambda x: F.size(F.filter("r", lambda y: y["v"] < x["v"]))
    equal = lambda x: F.size(F.filter("r", lambda y: y["v"] == x["v"]))
    ranks = whole.select(F.explode(F.transform("r", lambda x: F.struct(x["t"].alias("t"), (below(x) + (1 + equal(x)) / 2.0).alias("rank"), (equal(x) * equal(x) - 1).alias("tie")))).alias("x")).select("x.*")
    # Each of c equal values adds c^2 - 1, together c^3 - c.
    sums = ranks.groupBy("t").agg(F.sum("rank").alias("s"), F.count("*").alias("n"), F.sum("tie").alias("tie"))
    total = sums.agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("squares"), F.sum("tie").alias("tie")).where("n IS NOT NULL")
    scale = 1 - F.col("tie") / (F.col("n") * k * (k * k - 1))
    statistic = F.when(scale > 0, (12 / (F.col("n") * k * (k + 1)) * F.col("squares") - 3 * F.col("n") * (k + 1)) / scale).otherwise(0.0)

    @F.pandas_udf("double")
    def upper(values: pd.Series) -> pd.Series:
        return values.map(lambda v: chi2_sf(float(v), k - 1))

    return total.select(F.col("n").alias("blocks"), statistic.alias("statistic")).withColumn("p", upper("statistic"))


def signed_ranks(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(pairs, w_plus, w_minus, z) of Wilcoxon's signed ranks of a - b; equal pairs are left out, ties share their mean and are corrected for.

    ``z`` is the normal deviate without a correction for continuity, null where no pair differs.
    """
    gaps = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").select("d", F.abs("d").alias("size"), F.lit(0).alias("all_"))
    ranked = tables.average_ranks(gaps, ["all_"], {"size": "rank"})
    ties = gaps.groupBy("size").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("tie"))
    sums = ranked.agg(F.count("*").alias("pairs"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"))
    n = F.col("pairs")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48)
    both = sums.crossJoin(F.broadcast(ties))  # one row each
    return both.select("pairs", F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), F.coalesce("w_minus", F.lit(0.0)).alias("w_minus"), ((F.col("w_plus") - n * (n + 1) / 4) / spread).alias("z"))


#: Up to this number of times a cluster is drawn; more has a probability below 1e-9.
_MOST = 12


def poisson_thresholds() -> list[float]:
    """Probabilities that a Poisson number of mean one is at most 0, 1, 2, ..."""
    return [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(_MOST)]


def cluster_intervals(sums: DataFrame, group: list[str], cluster: list[str], hits: str, total: str, uniform: Column, draws: int = 200, level: float = 0.95) -> DataFrame:
    """(group, clusters, rate, low, high): percentile intervals of sum(hits) / sum(total) when whole clusters are drawn with replacement.

    ``sums``: a row a cluster of each group. In each draw a cluster counts as often as a Poisson number of mean one says, which for many
    clusters is how often it is drawn. ``uniform`` is a number from 0 to 1 of a cluster and of the column ``draw``, so draws are the same
    in every run and on every task, and are sums over the clusters, added up where these lie: what is shuffled is a row a draw.
    """
    weight = functools.reduce(lambda a, b: a + b, [(F.lit(t) <= F.col("u_")).cast("int") for t in poisson_thresholds()])
    # A cluster's number is drawn once for all of its groups; one that is not drawn adds nothing.
    whole_clusters = sums.groupBy(*cluster).agg(F.collect_list(F.struct(*group, hits, total)).alias("rows_"))
    every = whole_clusters.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    # Exploded, the number is evaluated once; as a plain column, once for every threshold.
    drawn = every.withColumn("u_", F.explode(F.array(uniform))).withColumn("w_", weight).where("w_ > 0").select("draw", "w_", F.explode("rows_").alias("row_")).select("row_.*", "draw", "w_")
    rates = drawn.groupBy(*group, "draw").agg((F.sum(F.col("w_") * F.col(hits)) / F.nullif(F.sum(F.col("w_") * F.col(total)), F.lit(0))).alias("r_"))
    tail = (1 - level) / 2
    ends = rates.groupBy(*group).agg(F.percentile("r_", tail).alias("low"), F.percentile("r_", 1 - tail).alias("high")).select(*[F.col(g).alias(f"g_{g}") for g in group], "low", "high")
    whole = sums.groupBy(*group).agg(F.countDistinct(*cluster).alias("clusters"), (F.sum(hits) / F.sum(total)).alias("rate"))
    same = [F.col(g).eqNullSafe(F.col(f"g_{g}")) for g in group]
    return whole.join(ends, same, "left").select(*group, "clusters", "rate", "low", "high")
