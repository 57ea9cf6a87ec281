"""Exact top-k inner products by the three-phase uniform threshold.

Each vector is cut into parts of consecutive components, and each part gives every query a list: the products with all
vectors on that part. A score is the sum of its entries in all lists, and no task ever holds more than one list's share.

1. From each share of each list the best entries are gathered; the best of those are completed with their entries in the
   other lists, and the k-th best complete score of a query is a safe cutoff: its k best rows reach it.
2. The cutoff goes to all shares. A score that reaches it has an entry of at least the cutoff divided by the number of lists
   in some list, so those entries are sufficient, and only they are collected.
3. Of what is collected, sums that could not reach the cutoff with the most that their missing entries can have are dropped;
   the missing entries of the others are resolved exactly, and the k best are taken.

A share is a tile of vectors by a block of queries, both bounded in rows, and a task is given its shares' rows only: nothing
is broadcast. Equal vectors are one vector with several ids and equal queries one query, so neither a third of all rows with
one vector nor ties among copies make more entries.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oblong.llm.integer_vectors import integers, matrix, products
from oblong.llm.shared import discard, looked_up, stored

_SHARE = ["size", "tile", "block", "part"]
#: Products that are held at once.
_CELLS = 1 << 21
_NONE = -(1 << 62)


def _few(rows: DataFrame, k: int) -> DataFrame:
    """Of each distinct vector, with how many rows it has, its k smallest ids (with repetitions)."""
    counts = rows.groupBy("v").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.max("asks").alias("asks"))
    counts = stored(counts.withColumn("uid", F.monotonically_increasing_id()), "distinct")
    several = counts.where("copies > 1").select("v", "uid", "copies")
    # Only rows of repeated vectors meet here; each task hands on k ids a vector at most.
    again = looked_up(rows.select("id", "v"), several, ["v"], "copies").where("uid is not null")
    first = again.withColumn("r", F.row_number().over(Window.partitionBy("uid").orderBy("id"))).where(F.col("r") <= k)
    ids = first.groupBy("uid").agg(F.array_sort(F.collect_list("id")).alias("more"))
    return counts.join(ids, "uid", "left").select("uid", "v", "copies", "asks", F.size("v").alias("size"), F.coalesce("more", F.array("least")).alias("ids"))


def _scores(table: pa.Table, width: Callable[[int, int], int]) -> tuple[pa.Table, pa.Table, pa.Table, np.ndarray, np.ndarray]:
    """A share's queries, vectors and pairs, and the matrices of the first two."""
    side = table.column("side").to_numpy()
    asked, held, pairs = (table.filter(pa.array(side == s)) for s in (0, 1, 2))
    w = width(table.column("size")[0].as_py(), table.column("part")[0].as_py()) if table.num_rows else 0
    return asked, held, pairs, matrix(asked.column("v"), w), matrix(held.column("v"), w)


def top_products(vectors: DataFrame, asks: Column, k: int = 5, scale: int = 256, parts: int = 2, local: int = 8, gathered: int = 32, tile_rows: int = 32_768, block_rows: int = 16_384, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``asks`` is true its ``k`` rows of highest score, ties to the smaller id.

    The score is the integer inner product of floor(scale * component). Candidates are all rows but the query's own: of repeated
    rows the others stay candidates, and each of them that asks gets its own answers. Rows without an id, and vectors that are
    null or hold null or non-finite components, take no part; vectors of different lengths do not meet, and those of length 0
    score 0 with each other. Fewer candidates than ``k`` are all returned; an empty table gives no rows. Other columns of any
    name are left out. Integers beyond 2^24 raise an error.
    """
    rows = stored(integers(vectors.where(F.col(id_column).isNotNull()), scale, vector_column, id=F.col(id_column).cast("long"), asks=F.coalesce(asks, F.lit(False))), "integers")
    held = stored(_few(rows, k + 1), "vectors")
    n, n_queries = held.count(), held.where("asks").count()
    tiles = max(1, math.ceil(n / min(tile_rows, max(1024, n // 64))))
    blocks = max(1, math.ceil(n_queries / block_rows))

    width = lambda size, part: max(0, min(-(-size // parts), size - part * -(-size // parts)))
    step = F.ceil(F.col("size") / parts).cast("int")
    of_part = F.when(F.col("part") * step < F.col("size"), F.slice("v", F.col("part") * step + 1, step)).otherwise(F.array().cast("array<int>"))
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    own_tile = F.pmod(F.xxhash64("uid"), F.lit(tiles)).cast("int").alias("tile")
    own_block = F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block")
    empty = {"cut": F.lit(None).cast("long"), "ids": F.lit(None).cast("array<bigint>"), "query": F.lit(None).cast("long"), "v": F.lit(None).cast("array<int>")}

    def side(number: int, rows: DataFrame) -> DataFrame:
        return rows.select(*_SHARE, F.lit(number).alias("side"), "uid", *[(F.col(c) if c in rows.columns else e).alias(c) for c, e in empty.items()])

    shares = held.select("size", own_tile, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "uid", "v", "ids")
    shares = side(1, shares.withColumn("part", every_part).withColumn("v", of_part))
    queries = held.where("asks").select("uid", "size", "v", own_block)

    def dealt(cuts: DataFrame | None) -> DataFrame:
        """The queries at every tile of vectors, with their cutoffs."""
        known = queries if cuts is None else queries.join(cuts.select(F.col("query").alias("uid"), "cut"), "uid", "left")
        return side(0, known.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumn("part", every_part).withColumn("v", of_part))

    entry = "query long, uid long, size int, tile int, block int, part int, s long, cut long, ids array<bigint>"
    names = ["query", "uid", "size", "tile", "block", "part", "s", "cut", "ids"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def entries(found: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Callable[[pa.Table], pa.Table]:
        """From a share the entries that ``found`` chooses by rows of products and the queries' cutoffs; a query never meets its own vector."""

        def run(table: pa.Table) -> pa.Table:
            asked, held, _, a, b = _scores(table, width)
            own = {u: j for j, u in enumerate(held.column("uid").to_pylist())}
            uids = asked.column("uid").to_numpy()
            cuts = asked.column("cut").fill_null(_NONE).to_numpy()
            i_all, j_all, s_all = [], [], []
            each = max(1, _CELLS // max(1, len(b)))
            for at in range(0, len(a) if len(b) else 0, each):
                s = products(a[at : at + each], b)
                mine = [(r, own[u]) for r, u in enumerate(uids[at : at + each].tolist()) if u in own]
                keep = np.ones(s.shape, dtype=bool)
                if mine:
                    keep[tuple(np.array(mine).T)] = False
                i, j = found(np.where(keep, s, 2 * _NONE), cuts[at : at + each])
                ok = keep[i, j]
                i, j = i[ok], j[ok]
                i_all.append(i + at), j_all.append(j), s_all.append(s[i, j])
            none = np.zeros(0, dtype=np.int64)
            i, j, s = (np.concatenate([none, *x]) for x in (i_all, j_all, s_all))
            key = [table.column(c)[0].as_py() if table.num_rows else 0 for c in _SHARE]
            ids = held.column("ids").combine_chunks().take(pa.array(j)) if len(j) else pa.array([], pa.list_(pa.int64()))
            columns = [uids[i], held.column("uid").to_numpy()[j], *[np.full(len(i), x, dtype=np.int32) for x in key], s, cuts[i]]
            return pa.Table.from_arrays([*[pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], ids.cast(kinds[-1])], names=names)

        return run

    def best(s: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = np.argpartition(-s, min(local, s.shape[1]) - 1, axis=1)[:, :local]
        return np.repeat(np.arange(len(s)), top.shape[1]), top.ravel()

    def sufficient(s: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(s >= (-(-cuts // parts))[:, None])

    def missing(table: pa.Table) -> pa.Table:
        """The entries of a share's pairs."""
        asked, held, pairs, a, b = _scores(table, width)
        if not pairs.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 3, names=["query", "uid", "s"])
        row = {u: i for i, u in enumerate(asked.column("uid").to_pylist())}
        column = {u: j for j, u in enumerate(held.column("uid").to_pylist())}
        q, u = pairs.column("query").to_pylist(), pairs.column("uid").to_pylist()
        i, j = np.array([row[x] for x in q], dtype=np.int64), np.array([column[x] for x in u], dtype=np.int64)
        s = np.zeros(len(i), dtype=np.int64)
        for at in range(0, len(i), 1 << 16):
            s[at : at + (1 << 16)] = np.einsum("ij,ij->i", a[i[at : at + (1 << 16)]].astype(np.int64), b[j[at : at + (1 << 16)]].astype(np.int64))
        return pa.Table.from_arrays([pa.array(q, pa.int64()), pa.array(u, pa.int64()), pa.array(s)], names=["query", "uid", "s"])

    def completed(pairs: DataFrame) -> DataFrame:
        """Whole scores: the seen entries' sums and, from the shares of the lists that a pair was not seen in, the missing entries."""
        unseen = pairs.where("lists < " + str(parts)).withColumn("part", every_part).where("(seen & shiftleft(1, part)) = 0")
        work = side(2, unseen).unionByName(shares).unionByName(dealt(None))
        rest = work.groupBy(*_SHARE).applyInArrow(missing, "query long, uid long, s long")
        both = pairs.select("query", "uid", "s", "ids").unionByName(rest.withColumn("ids", F.lit(None).cast("array<bigint>")))
        return both.groupBy("query", "uid").agg(F.sum("s").alias("s"), F.first("ids", ignorenulls=True).alias("ids"))

    def seen(found: DataFrame) -> DataFrame:
        return found.groupBy("query", "uid", "size", "tile", "block").agg(F.sum("s").alias("s"), F.sum(F.expr("shiftleft(1, part)")).cast("int").alias("seen"), F.count("*").alias("lists"), F.first("cut").alias("cut"), F.first("ids").alias("ids"))

    # Phase 1.
    lists = shares.unionByName(dealt(None)).groupBy(*_SHARE).applyInArrow(entries(best), entry)
    order = Window.partitionBy("query", "part").orderBy(F.desc("s"), "uid")
    leading = stored(lists.withColumn("r", F.row_number().over(order)).where(F.col("r") <= gathered).drop("r"), "lists")
    complete = completed(seen(leading))
    kth = complete.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s"), "uid"))).where(F.col("r") == k)
    cuts = stored(kth.select("query", F.col("s").alias("cut")), "cutoffs")
    # Phase 2. A query without a cutoff has fewer than k other vectors: all its entries are collected.
    collected = stored(shares.unionByName(dealt(cuts)).groupBy(*_SHARE).applyInArrow(entries(sufficient), entry), "sufficient")
    # Phase 3.
    share = F.expr(f"cut div {parts} + if(cut % {parts} > 0, 1, 0)")
    most = F.col("s") + (F.lit(parts) - F.col("lists")) * (share - 1)
    hopeful = seen(collected).where((F.col("cut") == _NONE) | (F.col("lists") == parts) | (most >= F.col("cut")))
    best_rows = Window.partitionBy("query").orderBy(F.desc("s"), F.element_at("ids", 1))
    winners = completed(stored(hopeful, "hopeful")).withColumn("r", F.row_number().over(best_rows)).where(F.col("r") <= k)
    per_query = winners.groupBy("query").agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("s")).alias("low"), i.alias("id"))))).alias("others"))
    # Every row that asks: the others' rows and the copies of its own vector but for itself.
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda t, x: t + x.cast("long") * x.cast("long"))
    answers = held.where("asks").join(per_query.withColumnRenamed("query", "uid"), "uid", "left").select("v", "copies", "others", "ids", (-norm).alias("low"))
    nothing = F.array().cast("array<struct<low:bigint,id:bigint>>")
    asked = looked_up(rows.where("asks").select("id", "v"), stored(answers, "answers"), ["v"], "copies")
    at = F.array_position("ids", F.col("id")).cast("int")
    rest = F.when(at > 0, F.concat(F.slice("ids", F.lit(1), at - 1), F.slice("ids", at + 1, F.lit(k + 1)))).otherwise(F.col("ids"))
    own = F.transform(rest, lambda i: F.struct(F.col("low").alias("low"), i.alias("id")))
    ranked = F.slice(F.array_sort(F.concat(F.coalesce("others", nothing), own)), 1, k)
    out = asked.select(F.col("id").alias("query_id"), F.posexplode(ranked).alias("place", "hit"))
    out = out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.low")).alias("score"))
    discard(leading)
    return out
