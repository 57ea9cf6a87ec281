"""Near duplicates among vectors by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned onto the principal axes of the whole table, which keeps every product and puts
most of it into the leading dimensions. Those of one label are ordered along a curve through the cells of their leading axes
and cut into tiles; each tile knows the box that its vectors fill on its leading axes. Tiles are gathered into blocks, and a
unit of work is a pair of blocks: the tiles of one are held while those of the other pass by. Two tiles, or blocks, are
compared if the gaps between their boxes let some pair reach the threshold. Inside, products are summed over the leading
dimensions first; what the rest can add is at most the product of both rests' lengths, and a pair is dropped as soon as its
sum and this bound stay below the threshold. What is left is decided by the full product in the given coordinates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oblong.llm.components import components
from oblong.llm.shared import discard, lean, looked_up, stored

_SLACK = 1e-9  # for rounding in the turned coordinates; the deciding product has none
#: Leading axes of the curve, and bits of a cell's number on each.
_CURVE, _BITS = 8, 2
#: Leading axes of the boxes.
_BOX = 16


def _classes(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """Each row with its label, number of dimensions and a digest of its vector; the digest is null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, rows, sizes = [], [], []
            for label, vector in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ok = label is not None and vector and None not in vector
                x = np.array(vector, dtype=float) + 0.0 if ok else np.zeros(0)
                ok = len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
                digests.append(hashlib.sha256(x.tobytes()).digest() if ok else None)
                rows.append(x.tobytes() if ok else None)
                sizes.append(len(x) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(rows, pa.binary())], ["vec_id", "label", "size", "digest", "x"])

    chosen = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("string").alias("label"), F.col(vector_column).cast("array<double>").alias("v"))
    return chosen.mapInArrow(lean(run), "vec_id long, label string, size int, digest binary, x binary")


def _units(data: list[bytes]) -> np.ndarray:
    """Rows of length one; a first division by the largest component keeps squares within range."""
    x = np.stack([np.frombuffer(d) for d in data])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def principal_axes(distinct: DataFrame) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """For each number of dimensions the axes as columns, by falling share, and the spread of vectors of length one along each.
    Only sums of products reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.array(batch.column(0).to_pylist(), dtype=int)
            data = batch.column(1).to_pylist()
            for size in set(sizes.tolist()):
                x = _units([d for d, s in zip(data, sizes, strict=True) if s == size])
                sums[size] = sums.get(size, 0) + x.T @ x
        rows = [(size, i, row.tolist()) for size, table in sums.items() for i, row in enumerate(table)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["size", "i", "row"])

    parts = distinct.select("size", "x").mapInArrow(lean(run), "size int, i int, row array<double>")
    cells = parts.select("size", "i", F.posexplode("row").alias("j", "v")).groupBy("size", "i", "j").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for size, i, j, v in cells.collect():
        out.setdefault(size, np.zeros((size, size)))[i, j] = v
    axes, spread = {}, {}
    for size, table in out.items():
        value, vector = np.linalg.eigh((table + table.T) / 2)
        axes[size] = vector[:, ::-1].copy()
        spread[size] = np.sqrt(np.maximum(value[::-1], 0) / max(np.trace(table), 1e-12))  # the trace is the number of vectors
    return axes, spread


def _local_components(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each of n items' components under the links (i, j)."""
    own = np.arange(n)
    while True:
        new = own.copy()
        low = np.minimum(own[i], own[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, own, new)
        new = new[new]
        if (new == own).all():
            return own
        own = new


def linked(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of x and j of y (all of length one) whose product is at least the threshold."""
    a, b = x @ axes, y @ axes
    dims = a.shape[1]
    rest = lambda z: np.sqrt(np.maximum(np.cumsum(z[:, ::-1] ** 2, axis=1)[:, ::-1], 0))
    rest_a, rest_b = np.pad(rest(a), ((0, 0), (0, 1))), np.pad(rest(b), ((0, 0), (0, 1)))
    found_i, found_j = [], []
    for at in range(0, len(a), 512):
        end = min(step, dims)
        total = a[at : at + 512, :end] @ b[:, :end].T
        i, j = np.nonzero(total + np.outer(rest_a[at : at + 512, end], rest_b[:, end]) >= threshold - _SLACK)
        total = total[i, j]
        i = i + at
        while end < dims and len(i):
            nxt = min(end + step, dims)
            for k in range(0, len(i), 200_000):
                total[k : k + 200_000] += np.einsum("ij,ij->i", a[i[k : k + 200_000], end:nxt], b[j[k : k + 200_000], end:nxt])
            end = nxt
            keep = total + rest_a[i, end] * rest_b[j, end] >= threshold - _SLACK
            i, j, total = i[keep], j[keep], total[keep]
        full = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", x[i[k : k + 200_000]], y[j[k : k + 200_000]]) for k in range(0, len(i), 200_000)]])
        found_i.append(i[full >= threshold])
        found_j.append(j[full >= threshold])
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *found_i]), np.concatenate([empty, *found_j])


def curve(turned: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Places of vectors on a curve through the cells of their leading axes (bits of the axes' cell numbers in turn).

    Cells are as wide as the axis is spread, so that each bit parts the vectors.
    """
    k = min(_CURVE, turned.shape[1])
    cells = np.clip(np.floor(turned[:, :k] / np.maximum(spread[:k], 1e-12)) + (1 << (_BITS - 1)), 0, (1 << _BITS) - 1).astype(np.int64)
    out = np.zeros(len(turned), dtype=np.int64)
    for bit in range(_BITS - 1, -1, -1):
        for axis in range(k):
            out = out << 1 | cells[:, axis] >> bit & 1
    return out


def apart(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray, threshold: float) -> bool:
    """Whether no two vectors of length one in these boxes reach the threshold: their squared distance would be 2 - 2 threshold at most."""
    gap = np.maximum(np.maximum(low - high2, low2 - high), 0.0)
    return float(gap @ gap) > 2 - 2 * threshold + 1e-6


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tile_rows: int = 1024, block_tiles: int = 8, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Links and component of every vector among those with an equal label.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
    different lengths do not link. Equal vectors are compared once and counted as many times as they occur; rows with null
    ids take part, but their component is that of the others. A null id is never kept. Products equal to the threshold
    link. Blocks of tiles are the unit of work: a hot label only makes more of them, a tile travels once for each block that
    its own is compared with, and from each unit come at most one count for a vector and the links of a spanning forest,
    never all linked pairs.
    """
    rows = stored(_classes(vectors, id_column, vector_column, label_column), "vectors")
    valid = rows.where("digest is not null")
    distinct = valid.groupBy("label", "size", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("x").alias("x"))
    distinct = stored(distinct, "distinct")
    axes, spread = principal_axes(distinct)

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, place = np.array(batch.column("size").to_pylist(), dtype=int), np.zeros(batch.num_rows, dtype=np.int64)
            data = batch.column("x").to_pylist()
            for size in set(sizes.tolist()):
                own = np.flatnonzero(sizes == size)
                place[own] = curve(_units([data[i] for i in own]) @ axes[size], spread[size])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "p"])

    placed = distinct.mapInArrow(lean(leading), "label string, size int, digest binary, rep long, copies long, x binary, p long")
    sorted_rows = placed.repartitionByRange("label", "size", "p", "digest").sortWithinPartitions("label", "size", "p", "digest")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        block: list = [None, 0, b""]  # label and size, tiles so far, name

        def tile() -> pa.RecordBatch:
            label, size, digest, _, copies, x, _ = zip(*held, strict=True)
            turned = _units(list(x)) @ axes[size[0]][:, : min(_BOX, size[0])]
            if block[0] != (label[0], size[0]) or block[1] == block_tiles:
                block[:] = [(label[0], size[0]), 0, hashlib.sha256(label[0].encode() + b"\0" + digest[0] + digest[-1]).digest()]
            block[1] += 1
            box = [(turned.min(axis=0) - _SLACK).tolist(), (turned.max(axis=0) + _SLACK).tolist()]
            values = [block[2], block[1], label[0], size[0], *box, b"".join(digest), list(copies), b"".join(x)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TILE, strict=True)], _TILE_NAMES)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (row[:2] != held[0][:2] or len(held) >= max(1, min(tile_rows, (1 << 20) // (8 * row[1])))):
                    yield tile()
                    held = []
                held.append(row)
        if held:
            yield tile()

    cut = stored(sorted_rows.mapInArrow(lean(tiles), "block binary, tile int, label string, size int, low array<double>, high array<double>, digests binary, copies array<long>, xs binary"), "tiles")
    bound = lambda least, column: F.array(*[least(F.get(column, F.lit(k))) for k in range(_BOX)])  # noqa: E731  null beyond the vectors' own dimensions
    facts = stored(cut.groupBy("label", "size", "block").agg(bound(F.min, "low").alias("low"), bound(F.max, "high").alias("high")), "blocks")
    # One side of the pairs of a label's blocks is dealt out over tasks, whose number grows with the blocks; the other goes to each of them.
    parts = facts.groupBy("label", "size").agg(F.greatest(F.lit(_PARTS), F.ceil(F.count("*") / _PART_BLOCKS)).cast("int").alias("parts"))
    counted = facts.join(parts, ["label", "size"])
    ours = counted.withColumn("part", F.pmod(F.xxhash64("block"), "parts").cast("int")).drop("parts")
    theirs = counted.select("label", "size", *[F.col(c).alias(f"{c}2") for c in ("block", "low", "high")], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    gaps = F.zip_with(F.zip_with("low", "high2", lambda a, b: F.greatest(a - b, F.lit(0.0))), F.zip_with("low2", "high", lambda a, b: F.greatest(a - b, F.lit(0.0))), lambda a, b: F.greatest(a, b))
    square = F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + F.coalesce(gap * gap, F.lit(0.0)))
    pairs = ours.join(theirs, ["label", "size", "part"]).where((F.col("block") <= F.col("block2")) & (square <= 2 - 2 * threshold + 1e-6))
    units = pairs.select(F.xxhash64("block", "block2").alias("unit"), "block", "block2")
    held_side = units.select("unit", "block", F.col("block2").alias("other"), F.lit(0).alias("side"))
    passing = units.select("unit", F.col("block2").alias("block"), F.col("block").alias("other"), F.lit(1).alias("side"))
    work = cut.join(held_side.unionByName(passing), "block")
    # The same two blocks stand next to each other: first the tiles to be held, then those that pass.
    first, second = F.when(F.col("side") == 0, F.col("block")).otherwise(F.col("other")), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("block"))
    work = work.withColumn("first", first).withColumn("second", second).drop("block", "other").repartition("unit").sortWithinPartitions("unit", "first", "second", "side", "tile")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, holding = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                if (row["first"], row["second"]) != now:
                    now, holding = (row["first"], row["second"]), []
                width = 8 * row["size"]
                unpacked = (
                    row["tile"], np.array(row["low"]), np.array(row["high"]), [row["digests"][i : i + 32] for i in range(0, len(row["digests"]), 32)],
                    np.array(row["copies"], dtype=np.int64), _units([row["xs"][i : i + width] for i in range(0, len(row["xs"]), width)]),
                )
                if row["side"] == 0:
                    holding.append(unpacked)
                    continue
                tile2, low2, high2, names2, copies2, y = unpacked
                for tile, low, high, names, copies, x in holding:
                    same = row["first"] == row["second"] and tile == tile2
                    if row["first"] == row["second"] and tile > tile2 or apart(low, high, low2, high2, threshold):
                        continue
                    i, j = linked(x, y, axes[row["size"]], threshold)
                    if same:
                        i, j = i[i < j], j[i < j]
                        every, many = names, copies
                    else:
                        j = j + len(x)
                        every, many = names + names2, np.concatenate((copies, copies2))
                    if not len(i):
                        continue
                    count = np.bincount(i, weights=many[j], minlength=len(every)) + np.bincount(j, weights=many[i], minlength=len(every))
                    root = _local_components(i, j, len(every))
                    touched = np.flatnonzero(count)
                    yield pa.RecordBatch.from_arrays([pa.array([every[t] for t in touched], pa.binary()), pa.array(count[touched].astype(np.int64)), pa.array([every[root[t]] for t in touched], pa.binary()), pa.array([row["label"]] * len(touched), pa.string())], ["digest", "links", "root", "label"])

    # A digest may occur under several labels, so vertices are named by label and digest.
    found = stored(work.mapInArrow(lean(compare), "digest binary, links long, root binary, label string"), "links")
    name = lambda c: F.concat(F.hex(F.col(c)), F.lit("@"), F.col("label"))
    degree = found.groupBy("label", "digest").agg(F.sum("links").alias("links"))
    spanning = found.select(name("digest").alias("a"), name("root").alias("b")).where("a <> b")
    grouped = components(spanning)
    named = distinct.select("label", "digest", "rep", "copies").withColumn("name", name("digest")).join(grouped.select(F.col("id").alias("name"), F.col("component").alias("group")), "name", "left")
    named = stored(named.join(degree, ["label", "digest"], "left"), "named")
    lowest = stored(named.where("group is not null").groupBy("group").agg(F.min("rep").alias("component_id"), F.count("*").alias("members")), "lowest")
    classes = looked_up(named, lowest, ["group"], "members")
    # Vectors without copies and links need no row here.
    classes = classes.where("copies > 1 or links is not null")
    classes = stored(classes.select("label", "digest", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "classes")
    discard(distinct, cut, facts, found, grouped, named, lowest)
    out = looked_up(rows.select("vec_id", F.when(F.col("digest").isNotNull(), F.col("label")).alias("label"), "digest"), classes, ["label", "digest"], "copies")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


#: Over how many tasks at least the pairs of one label's blocks are dealt, and how many blocks a task is given at most on one side.
_PARTS, _PART_BLOCKS = 16, 256
_TILE_NAMES = ["block", "tile", "label", "size", "low", "high", "digests", "copies", "xs"]
_TILE = [pa.binary(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.list_(pa.int64()), pa.binary()]
