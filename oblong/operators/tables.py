"""Aggregations, ordered computations, sets and samples over experiment rows."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oblong.functions.intervals import wilson
from oblong.operators.graphs import kept


def tally(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts of all listed values, 0 where there is none."""
    all_values = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return all_values.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def contingency(rows: DataFrame, by: str, column: str, values: list[str], success: str) -> DataFrame:
    """Counts of each value by group, with the Wilson interval of one of them."""
    table = rows.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(F.col(column) == v).alias(v) for v in values])
    low, high = wilson(F.col(success), F.col("n"))
    return table.select("*", low.alias("low"), high.alias("high"))


def grouping_sets(rows: DataFrame, sets: list[list[str]], keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over several groupings at once; keys outside a grouping are null and ``grouping`` names it."""
    grouped = rows.groupingSets([[F.col(k) for k in s] for s in sets], *keys)
    names = F.concat_ws("+", *[F.when(F.grouping(k) == 0, F.lit(k)) for k in keys])
    return grouped.agg(names.alias("grouping"), *[v.alias(k) for k, v in aggregates.items()])


def histogram(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in equal bins between the smallest and the largest value, which is in the last bin."""
    ends = rows.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    which = F.least(F.lit(bins - 1), F.coalesce(F.floor((F.col(column) - F.col("low")) / F.nullif(width, F.lit(0.0))), F.lit(0)))
    return rows.where(F.col(column).isNotNull()).select(column).crossJoin(F.broadcast(ends)).groupBy(which.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def last_row_wins(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def first_per_group(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """One row of each group: the first in the given order."""
    return rows.withColumn("rank_", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("rank_ = 1").drop("rank_")


def top(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def _same(names: list[str], other: str = "g_") -> Column:
    """Groups are equal, null ones too."""
    return functools.reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"{other}{g}")) for g in names])


def placed(rows: DataFrame, group: list[str], values: list[str], total: str = "m_", ranges: int = 64) -> DataFrame:
    """The rows with their group's size and, for each of ``values``, the range of values that they are in (``range_<value>``) and how many
    rows of the group are in the ranges before (``before_<value>``). Null values are in a last range of their own, null groups are groups.

    Approximate quantiles cut a group into ranges, so no task needs a whole group; counts are exact wherever the cuts are. But these
    depend on the order in which rows and shuffled blocks come, so they are found once and kept: counts and rows must be cut alike. The
    rows are read three times, for cuts, for counts and for themselves, however many values are ranked.
    """
    inner = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    named = [F.col(g).alias(f"g_{g}") for g in group]
    cuts = rows.groupBy(*group).agg(F.count("*").alias(total), *[F.percentile_approx(v, inner, F.lit(2000)).alias(f"cuts_{v}") for v in values]).select(*named, total, *[f"cuts_{v}" for v in values])
    cuts = kept(cuts, "cuts")
    # Cuts ascend: how many lie below a value is found by halving, in a few steps instead of one a cut.
    halves = F.array(*[F.lit(2**k) for k in reversed(range(max(1, (ranges - 1).bit_length())))])
    below = lambda v: F.aggregate(halves, F.lit(0), lambda i, s: i + F.when(F.get(F.col(f"cuts_{v}"), i + s - 1) < F.col(v), s).otherwise(0))
    at = lambda v: F.when(F.col(v).isNull(), F.lit(ranges)).otherwise(below(v))
    both = rows.join(cuts, _same(group)).select(*[rows[c] for c in rows.columns], total, *[at(v).alias(f"range_{v}") for v in values])
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("k_"), F.col(f"range_{v}").alias("range_")) for k, v in enumerate(values)]))
    counts = both.select(*group, entries.alias("e_")).groupBy(*group, "e_.k_", "e_.range_").agg(F.count("*").alias("held_"))
    own = Window.partitionBy(*group, "k_").orderBy("range_")
    upto = counts.withColumn("before_", F.sum("held_").over(own) - F.col("held_"))
    maps = upto.groupBy(*group).agg(*[F.map_from_entries(F.collect_list(F.when(F.col("k_") == k, F.struct("range_", "before_")))).alias(f"map_{v}") for k, v in enumerate(values)])
    found = both.join(maps.select(*named, *[f"map_{v}" for v in values]), _same(group))
    return found.select(*both.columns, *[F.try_element_at(f"map_{v}", F.col(f"range_{v}")).alias(f"before_{v}") for v in values])


def ranked(rows: DataFrame, group: list[str], value: str, order: list[str] | None = None, name: str = "i_", total: str = "m_", ranges: int = 64) -> DataFrame:
    """The rows with their place within their group (``name``, ties by ``order``; without it, the place of the first of equals) and the
    group's size (``total``). Null values come last; rows of null groups are ranked among themselves."""
    w = Window.partitionBy(*group, f"range_{value}").orderBy(F.asc_nulls_last(value), *(order or []))
    within = F.row_number().over(w) if order else F.rank().over(w)
    return placed(rows, group, [value], total, ranges).withColumn(name, (F.col(f"before_{value}") + within).cast("long")).drop(f"range_{value}", f"before_{value}")


def average_ranks(rows: DataFrame, group: list[str], columns: dict[str, str]) -> DataFrame:
    """Ranks in which ties share their mean, for each column under its name in ``columns``; null values have no rank."""
    out = placed(rows, group, list(columns))
    for value, name in columns.items():
        range_ = Window.partitionBy(*group, f"range_{value}")
        ties = F.count("*").over(Window.partitionBy(*group, f"range_{value}", value))  # equal values are in one range, so this needs no further shuffle
        rank = F.col(f"before_{value}") + F.rank().over(range_.orderBy(F.asc_nulls_last(value))) + (ties - 1) / 2.0
        out = out.withColumn(name, F.when(F.col(value).isNotNull(), rank))
    return out.drop("m_", *[f"{k}_{v}" for v in columns for k in ("range", "before")])


def spearman(rows: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Correlation of average ranks; null for fewer than three rows or a constant column. Rows that lack a value are left out."""
    held = average_ranks(rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*group, a, b), group, {a: "ra_", b: "rb_"})
    flat = (F.stddev_pop("ra_") == 0) | (F.stddev_pop("rb_") == 0) | (F.count("*") < 3)
    return held.groupBy(*group).agg(F.count("*").alias("n"), F.when(~flat, F.corr("ra_", "rb_")).alias("spearman"))


def holm(tests: DataFrame, group: list[str], p: str, id_: str, alpha: float) -> DataFrame:
    """Step-down: the i-th smallest p of m against alpha / (m - i + 1), until one fails."""
    places = ranked(tests, group, p, [id_])
    fails = F.when(F.col(p) > alpha / (F.col("m_") - F.col("i_") + 1), F.col("i_"))
    first = places.groupBy(*group).agg(F.min(fails).alias("first_")).select(*[F.col(g).alias(f"g_{g}") for g in group], "first_")
    return places.join(first, _same(group)).drop(*[f"g_{g}" for g in group]).withColumn("rejected", F.coalesce(F.col("i_") < F.col("first_"), F.lit(True))).drop("i_", "m_", "first_")


def benjamini_hochberg(tests: DataFrame, group: list[str], p: str, id_: str, q: float) -> DataFrame:
    """Step-up: all tests up to the last whose p is at most q i / m."""
    places = ranked(tests, group, p, [id_])
    last = places.groupBy(*group).agg(F.max(F.when(F.col(p) <= q * F.col("i_") / F.col("m_"), F.col("i_"))).alias("last_")).select(*[F.col(g).alias(f"g_{g}") for g in group], "last_")
    return places.join(last, _same(group)).drop(*[f"g_{g}" for g in group]).withColumn("rejected", F.coalesce(F.col("i_") <= F.col("last_"), F.lit(False))).drop("i_", "m_", "last_")


def conformal_quantile(scores: DataFrame, group: list[str], score: str, alpha_percent: int) -> DataFrame:
    """The k-th smallest score, k = ceil((n + 1)(1 - alpha)), a rank and not an interpolation; null where k > n."""
    k = F.ceil((F.col("m_") + 1) * F.lit(100 - alpha_percent) / 100)
    places = ranked(scores, group, score)  # equal scores share the place of the first: the k-th is the last whose place is at most k
    return places.groupBy(*group).agg(F.first("m_").alias("n"), F.max(F.when((F.col("i_") <= k) & (k <= F.col("m_")), F.col(score))).alias("q"))


def stable_split(rows: DataFrame, group: str, fractions: tuple[float, ...], names: tuple[str, ...], seed: str) -> DataFrame:
    """Each group in one set: groups ordered by a seeded hash, cut at the rounded cumulative fractions.

    A group's rank is its rank among hashes with the same first two digits, plus the count of hashes before these; so no task
    sorts all groups.
    """
    groups = rows.select(group).distinct().withColumn("h_", F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")))).withColumn("b_", F.substring("h_", 1, 2))
    sizes = groups.groupBy("b_").agg(F.count("*").alias("held_"))
    before = sizes.select("b_", F.sum("held_").over(Window.orderBy("b_")).alias("upto_"), "held_", F.sum("held_").over(Window.partitionBy()).alias("n_"))
    own = F.row_number().over(Window.partitionBy("b_").orderBy("h_", group))
    ranked = groups.withColumn("own_", own).join(F.broadcast(before), "b_").withColumn("i_", F.col("upto_") - F.col("held_") + F.col("own_"))
    out = F.lit(names[-1])
    for i in range(len(names) - 2, -1, -1):
        out = F.when(F.col("i_") <= F.bround(F.col("n_") * sum(fractions[: i + 1])), F.lit(names[i])).otherwise(out)
    return ranked.select(group, out.alias("part"))


def leaking(assignment: DataFrame, source: str, part: str) -> DataFrame:
    """Sources that are in more than one set."""
    return assignment.groupBy(source).agg(F.count_distinct(part).alias("parts")).where("parts > 1")


def kernel_densities(rows: DataFrame, reference: DataFrame, id_: str, vector: str, bandwidth: float, tile_rows: int | None = None) -> DataFrame:
    """(id, density) of every row: the mean Gaussian kernel to all rows of ``reference``, whole vectors, at least 1e-12.

    Rows and reference are cut into tiles by a hash, and a task is given one tile of either at a time; only sums leave it. Comparing all
    with all is what the density is, so the work grows with the product of both sizes, but no task's share does. Null vectors have none.
    Each side travels once for every tile of the other: tiles are an eighth of their side, but of 2,048 rows at least and 65,536 at most.
    """
    own, other = rows.where(F.col(vector).isNotNull()), reference.where(F.col(vector).isNotNull())
    tiles = lambda n: max(1, -(-n // (tile_rows or min(max(-(-n // 8), 2048), 65536))))
    n_own, n_other = (tiles(d.count()) for d in (own, other))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tile = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), F.col(id_), F.col(vector)), F.lit(n)).cast("int")
    left = own.select(F.col(id_).alias("id"), F.col(vector).alias("v"), tile(n_own, 1).alias("tile"), every(n_other).alias("block"), F.lit(True).alias("own"))
    right = other.select(F.lit(None).cast(own.schema[id_].dataType).alias("id"), F.col(vector).alias("v"), every(n_own).alias("tile"), tile(n_other, 2).alias("block"), F.lit(False).alias("own"))

    def sums(table: pa.Table) -> pa.Table:
        a, b = (table.filter(pa.array(table.column("own").to_numpy() == side)) for side in (True, False))
        total = np.zeros(a.num_rows)
        if a.num_rows and b.num_rows:
            x, y = (t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1) for t in (a, b))
            size = (y**2).sum(axis=1)[None]
            step = max(1, 2**19 // len(y))  # few megabytes at a time
            for at in range(0, len(x), step):
                part = x[at : at + step]
                far = ((part**2).sum(axis=1)[:, None] + size - 2 * part @ y.T).clip(min=0)
                total[at : at + step] = np.exp(-far / (2 * bandwidth**2)).sum(axis=1)
        return pa.Table.from_arrays([a.column("id"), pa.array(total), pa.array([b.num_rows] * a.num_rows, pa.int64())], names=["id", "s", "n"])

    kind = own.schema[id_].dataType.simpleString()
    parts = left.unionByName(right).groupBy("tile", "block").applyInArrow(sums, f"id {kind}, s double, n bigint")
    return parts.groupBy("id").agg(F.greatest(F.sum("s") / F.sum("n"), F.lit(1e-12)).alias("density")).withColumnRenamed("id", id_)


def envelope_distances(rows: DataFrame, id_: str, vector: str, ridge: float = 1e-6) -> DataFrame:
    """(id, distance) of every vector from the table's mean, in the metric of its ridge-regularised covariance: all dimensions.

    The moments are sums over all rows; what reaches the driver is one number a pair of dimensions, and what goes to tasks likewise.
    """
    held = rows.where(F.col(vector).isNotNull()).select(id_, F.col(vector).cast("array<double>").alias("v"))
    cells = covariances(held.select(F.lit(0).alias("all_"), "v"), "all_", "v").select("i", "j", "cov").collect()
    if not cells:
        return held.select(id_, F.lit(None).cast("double").alias("distance"))
    size = 1 + max(c.i for c in cells)
    table = np.zeros((size, size))
    for c in cells:
        table[c.i, c.j] = table[c.j, c.i] = c.cov
    inverse = np.linalg.inv(table + ridge * np.eye(size))
    means = held.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m")).collect()
    mean = np.zeros(size)
    for r in means:
        mean[r.k] = r.m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gap = np.array(batch.column(1).to_pylist(), dtype=float) - mean
                far = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", gap, inverse, gap, optimize=True), 0.0))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(far)], [id_, "distance"])

    return held.mapInArrow(run, f"{id_} {held.schema[id_].dataType.simpleString()}, distance double")


def covariances(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, i, j, n, cov) of the vectors' components, i <= j, for vectors of one length in each group.

    Each task adds up its vectors' products about its own first vector, which keeps digits; only these sums are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            labels = np.array(batch.column(0).to_pylist(), dtype=object)
            vectors = batch.column(1).to_pylist()
            for label in set(labels):
                x = np.array([v for v, k in zip(vectors, labels, strict=True) if k == label and v], dtype=float)
                if len(x):
                    n, mean, product = held.get(label, (0, np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))))
                    own = x.mean(axis=0)
                    off = own - mean
                    held[label] = (n + len(x), mean + off * len(x) / (n + len(x)), product + (x - own).T @ (x - own) + np.outer(off, off) * n * len(x) / (n + len(x)))
        rows = [(label, i, n, float(mean[i]), mean[i:].tolist(), product[i, i:].tolist()) for label, (n, mean, product) in held.items() for i in range(len(mean))]
        yield pa.RecordBatch.from_pylist([dict(zip(("label", "i", "n", "m", "ms", "ps"), r, strict=True)) for r in rows], schema=_PARTS)

    kind = rows.schema[group].dataType.simpleString()
    parts = rows.select(F.col(group).cast("string"), vector).mapInArrow(run, "label string, i int, n long, m double, ms array<double>, ps array<double>")
    cells = parts.select("label", "i", "n", "m", F.posexplode(F.arrays_zip("ms", "ps")).alias("at", "c"))
    sums = cells.groupBy("label", "i", (F.col("i") + F.col("at")).alias("j")).agg(
        F.sum("n").alias("n"), F.sum("c.ps").alias("p"), F.sum(F.col("n") * F.col("m")).alias("a"), F.sum(F.col("n") * F.col("c.ms")).alias("b"), F.sum(F.col("n") * F.col("m") * F.col("c.ms")).alias("ab")
    )
    between = F.col("ab") - F.col("a") * F.col("b") / F.col("n")
    return sums.where("n > 1").select(F.col("label").cast(kind).alias(group), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "n", ((F.col("p") + between) / (F.col("n") - 1)).alias("cov"))


_PARTS = pa.schema([("label", pa.string()), ("i", pa.int32()), ("n", pa.int64()), ("m", pa.float64()), ("ms", pa.list_(pa.float64())), ("ps", pa.list_(pa.float64()))])
