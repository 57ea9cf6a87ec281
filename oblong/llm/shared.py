"""What several operators share: word and shingle hashing, deterministic splits, tables kept between steps."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and \t to \r. All are ASCII, so UTF-8 bytes can be split at them.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_PLACE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def join_texts(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes, A-Z lower-cased, each followed by a line feed, and the place after each line feed."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8) if raw else np.zeros(0, dtype=np.uint8)
    return LOWER[data] if lower else data, np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and for each text the number of words up to its end."""
    inside = ~IS_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    starts, stops = edge[0::2], edge[1::2]
    return starts, stops, np.searchsorted(starts, ends)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each word's bytes; it depends on nothing else. About ``step`` bytes of words are hashed at once."""
    out = np.empty(len(starts), dtype=np.uint64)
    upto = np.cumsum(stops - starts)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + step, side="right")))
        out[at:end] = _hashed(data, starts[at:end], stops[at:end])
        at = end
    return out


def _hashed(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Words are cut into lanes of eight bytes; each lane is mixed with its place before lanes are added, so no structure of a word cancels out."""
    low, high = int(starts.min()), int(stops.max())
    near = np.concatenate((data[low:high], np.zeros(8, dtype=np.uint8)))
    eight = np.ndarray((high - low + 1,), dtype="<u8", buffer=near.data, strides=(1,))  # the eight bytes from each byte on
    sizes = stops - starts
    lanes = (sizes + 7) >> 3
    first = np.cumsum(lanes) - lanes
    place = np.arange(int(lanes.sum()), dtype=np.int64) - np.repeat(first, lanes)
    rest = np.repeat(sizes, lanes) - 8 * place
    held = eight[np.repeat(starts - low, lanes) + 8 * place]
    held &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * (8 - np.minimum(rest, 8))).astype(np.uint64)
    mixed = mix(mix(held + _PLACE) + mix((place + 1).astype(np.uint64) * _PLACE))
    return mix(np.add.reduceat(mixed, first) + sizes.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` successive values, in order; shorter input gives none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n + k])
    return out


def spread(bounds: np.ndarray) -> np.ndarray:
    """For each item the number of the text it is in, from the texts' item counts added up."""
    return np.repeat(np.arange(len(bounds)), np.diff(bounds, prepend=0))


def per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each text's bytes or words."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return np.diff(total[ends], prepend=0) if len(ends) else np.zeros(0, dtype=np.int64)


def remainder(id_column: Column, by: int) -> Column:
    """crc32 of the id written in decimal, modulo ``by``; null ids count as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % by


@functools.cache
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow; when a task ends, its memory goes back to the system, as the worker may serve other tasks next."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if libc := _libc():
                libc.malloc_trim(0)

    return whole


def by_block(decide: Callable[[list[str | None]], pa.Array], kind: pa.DataType) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """An Arrow UDF's function of a column of texts from a function of a few of them: the other columns never leave the JVM."""
    from oblong.llm.tokens import blocks, strings

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            parts = [decide(strings(part.column(0))) for part in blocks(batch, 0)]
            yield pa.concat_arrays(parts) if parts else pa.nulls(0, kind)

    return lean(run)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``rows``, but for the last: for tables of numbers."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


#: Rows of texts that cross to Python at once. Ten thousand, Spark's own number, are hundreds of megabytes where texts are long.
BATCH_ROWS = 2000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lets at most BATCH_ROWS rows cross to Python at once, unless the session already has a smaller number."""
    held = int(spark.conf.get(_BATCH_CONF))
    if held <= 0 or held > BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave it unset; it gets a temporary one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = context._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='oblong-')}"
        context.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/oblong-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove the files of ``stored`` tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def without(rows: DataFrame, ids: DataFrame, column: str, broadcast_rows: int = 200_000) -> DataFrame:
    """The rows whose id is not among ``ids``; rows with a null id stay. Up to ``broadcast_rows`` ids are broadcast, more are joined by a shuffle."""
    return rows.join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, column, "left_anti")


def looked_up(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, broadcast_rows: int = 50_000) -> DataFrame:
    """Left join of ``rows`` with ``facts``, stored, with one row a key and in ``count`` how many rows have that key.

    Facts are broadcast while there are at most ``broadcast_rows``. Beyond that only those of the most frequent keys are, so
    that no such key meets in one task, and the others are joined by a shuffle. Rows with a null key meet nothing and stay
    where they are.
    """
    plain = facts.drop(count)
    if facts.count() <= broadcast_rows:
        return rows.join(F.broadcast(plain), keys, "left")
    hot = F.broadcast(most_frequent(facts.where(F.col(count) >= 1000), count, broadcast_rows).drop(count))
    null = F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull()
    more = [F.lit(None).cast(plain.schema[c].dataType).alias(c) for c in plain.columns if c not in keys]
    named = rows.where(~null)
    met = named.join(hot, keys)
    others = named.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(plain, keys, "left")
    return met.unionByName(others).unionByName(rows.where(null).select("*", *more))


def hubs_of(pairs: DataFrame, each: int = 4096, broadcast_rows: int = 50_000) -> DataFrame | None:
    """(id, salts) of the ids that stand in more than ``each`` of the pairs (a, b), the most frequent at least; None where there are none."""
    counts = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > each)
    counts = stored(counts, "hubs")
    if not counts.limit(1).count():
        discard(counts)
        return None
    return most_frequent(counts, "n", broadcast_rows).select("id", F.ceil(F.col("n") / each).cast("int").alias("salts"))


def with_both(pairs: DataFrame, facts: DataFrame, key: str, hubs: DataFrame | None) -> DataFrame:
    """``pairs`` (a, b) with the facts of either id, their columns ending in _a and _b. The pairs of a hub are dealt out over several
    tasks, and its facts with them."""
    out = pairs
    for side, other in (("a", "b"), ("b", "a")):
        own = facts.select(F.col(key).alias(side), *[F.col(c).alias(f"{c}_{side}") for c in facts.columns if c != key])
        if hubs is None:
            out = out.join(own, side)
            continue
        salts = F.broadcast(hubs.withColumnRenamed("id", side))
        n = F.coalesce("salts", F.lit(1))
        dealt = out.join(salts, side, "left").withColumn("salt", F.pmod(F.xxhash64(other), n).cast("int")).drop("salts")
        own = own.join(salts, side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("salts")
        out = dealt.join(own, [side, "salt"]).drop("salt")
    return out


def most_frequent(rows: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the highest counts, at most ``most`` of them, found without sorting: the rows at or above the lowest count
    that few enough rows reach. Counts beyond 2**16 are compared by powers of two."""
    level = F.when(F.col(count) < 1 << 16, F.col(count).cast("double")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.col(count).cast("double")))))
    reached, least = 0, float("inf")
    for at, n in sorted(rows.groupBy(level.alias("level")).count().collect(), reverse=True):
        if reached + n > most:
            break
        reached, least = reached + n, at
    return rows.where(F.col(count) >= least) if reached else rows.limit(0)
