"""Jaccard join of documents on word shingles by prefix filtering under several global token orders.

Two sets of shingles whose Jaccard index reaches the threshold share a token in their prefixes under every order of all
tokens, if a prefix is long enough: all but ceil(threshold * n) of n tokens, plus one. Here each order puts frequent tokens
last and is random among tokens of like frequency. Under the first order prefixes are joined on their tokens; positions,
sizes and the number of shared prefix tokens then bound the overlap of each pair, and pairs that can't reach the threshold
go. What is left must share prefix tokens under each of the other orders too; only the pairs that pass them all meet their
whole sets and are verified.

Sets that are equal are one vertex. In a group of many near copies not all pairs are formed: the holders of a token are
first compared with a few leaders, in rounds; of the remaining pairs only those between different components are formed,
as others can't change a component.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oblong.llm.components import components
from oblong.llm.shared import discard, gathered, hubs_of, join_texts, lean, looked_up, mix, most_frequent, stored, windows, with_both, without, word_hashes, words_of
from oblong.llm.tokens import blocks, strings

WORDS = 5
#: The threshold as a fraction: SHARED / ALL of the union must be shared.
SHARED, ALL = 3, 4
ORDERS = 3
#: One in so many single sightings of a token is counted.
SAMPLED = 64
#: Bits of an order's keys that hold the frequency's rank, and the rank from which a token's holders are dealt out over several tasks.
_RANK_AT, _DEALT = 58, 13
#: The rounds' numbers of leaders for each token and band of sizes.
LEADERS = (4, 32, 256)
_SEEDS = [mix(np.array([k + 1], dtype=np.uint64))[0] for k in range(ORDERS)]


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; a text with fewer words has its whole sequence as one."""
    data, ends = join_texts(texts)
    starts, stops, upto = words_of(data, ends)
    hashes = word_hashes(data, starts, stops)
    runs = windows(hashes, words)
    out, a = [], 0
    for b in upto.tolist():
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            out.append(mix(windows(hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        a = b
    return out


def set_id(tokens: np.ndarray) -> int:
    """64 bits of a digest of the set."""
    return int.from_bytes(hashlib.sha256(tokens.tobytes()).digest()[:8], "little", signed=True)


def needed(n: int) -> int:
    """The least overlap of a set of n tokens with any set that reaches the threshold."""
    return -(-SHARED * n // ALL)


def order_keys(tokens: np.ndarray, order: int, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of tokens in an order: rare tokens before frequent ones, else by a hash that differs from order to order."""
    hashed = mix(tokens ^ _SEEDS[order]) >> np.uint64(6)
    if not len(frequent) or not len(tokens):
        return hashed
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    return hashed | np.where(frequent[at] == tokens, rank[at], 0).astype(np.uint64) << np.uint64(58)


def further_prefixes(tokens: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> list[bytes]:
    """The prefixes of a set under the orders after the first: the prefix's last place, the set's size, and a 32-bit name for each token.

    Equal tokens have equal names; that others may share one only lets more pairs through.
    """
    n = len(tokens)
    if not n:
        return [b""] * (ORDERS - 1)
    size, out = n - needed(n) + 1, []
    for order in range(1, ORDERS):
        prefix = np.partition(order_keys(tokens, order, frequent, rank), size - 1)[:size]
        out.append(np.array([prefix.max(), n], dtype=np.uint64).tobytes() + prefix.astype(np.uint32).tobytes())
    return out


def meet(x: bytes, y: bytes) -> bool:
    """Whether two prefixes share names, and enough of them for the threshold: what they share and all that stands after the one that
    ends first bounds the overlap."""
    (last_x, n_x), (last_y, n_y) = (np.frombuffer(s, dtype=np.uint64, count=2).tolist() for s in (x, y))
    if ALL * min(n_x, n_y) < SHARED * max(n_x, n_y):
        return False
    shared = int(np.isin(np.frombuffer(x, dtype=np.uint32, offset=16), np.frombuffer(y, dtype=np.uint32, offset=16)).sum())
    most = shared + needed(n_x if last_x <= last_y else n_y) - 1
    return shared > 0 and (SHARED + ALL) * most >= SHARED * (n_x + n_y)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two whole sets reach the threshold."""
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return ALL * shared >= SHARED * (len(x) + len(y) - shared)


def survey(docs: DataFrame) -> DataFrame:
    """Rows (kind, a, b, c): 0 for a document with the size and the id of its set; 1 for a token that some task saw twice or more, with
    its count; 2 for a token that a task saw once: every SAMPLED-th such sighting, drawn anew in each task, so that tokens spread
    thinly over many tasks are counted too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            own = mix(np.array([tokens[0]], dtype=np.uint64) + np.uint64(len(tokens)))[0]  # differs from flush to flush
            drawn = mix(tokens ^ own) % np.uint64(SAMPLED) == 0
            keep = (counts > 1) | drawn
            tokens, counts = tokens[keep].view(np.int64), counts[keep]
            return pa.RecordBatch.from_arrays([pa.array(np.where(counts > 1, 1, 2).astype(np.int32)), pa.array(tokens), pa.array(counts.astype(np.int64)), pa.array(np.zeros(len(tokens), dtype=np.int64))], ["kind", "a", "b", "c"])

        for batch in batches:
            for part in blocks(batch, 1):
                sets = shingle_sets(strings(part.column(1)))
                ids = [set_id(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(sets), pa.int32()), part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64())], ["kind", "a", "b", "c"])
                for s, i in zip(sets, ids, strict=True):
                    if i not in seen:
                        seen.add(i)
                        held.append(s)
                        size += len(s)
                if size > 4_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.mapInArrow(lean(run), "kind int, a long, b long, c long")


def frequent_tokens(surveyed: DataFrame, least: int = 8, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, sorted, and their ranks (by powers of two).

    Only the order depends on them, and any order gives the same result, so the list may be bounded: beyond ``most``
    tokens the rarer ones count as rare.
    """
    seen = surveyed.where("kind > 0").groupBy("a").agg(F.sum(F.when(F.col("kind") == 1, F.col("b")).otherwise(0)).alias("sure"), F.count_if(F.col("kind") == 2).alias("drawn"))
    n = F.col("sure") + F.when(F.col("drawn") > 1, SAMPLED * F.col("drawn")).otherwise(F.col("drawn"))  # one draw may be chance
    counts = seen.select("a", n.alias("n")).where(F.col("n") >= least)
    rows = most_frequent(counts, "n", most).toArrow()
    tokens = rows["a"].to_numpy().view(np.uint64)
    rank = np.minimum(31, 1 + np.log2(np.maximum(rows["n"].to_numpy().astype(float), 1)).astype(np.int64))
    order = np.argsort(tokens)
    return tokens[order], rank[order]


def prefixes(docs: DataFrame, frequent: np.ndarray, rank: np.ndarray) -> DataFrame:
    """The tokens of each set's prefix under the first order: place in the order, set, its size, position, and the prefix's last place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in blocks(batch, 1):
                sets = [(set_id(s), s) for s in shingle_sets(strings(part.column(1))) if len(s)]
                sets = [(i, s) for i, s in dict(sets).items() if i not in seen]
                seen.update(i for i, _ in sets)
                if not sets:
                    continue
                keys = order_keys(np.concatenate([s for _, s in sets]), 0, frequent, rank)
                out, at = [], 0
                for _, s in sets:
                    size = len(s) - needed(len(s)) + 1
                    own = keys[at : at + len(s)]
                    at += len(s)
                    out.append(np.sort(np.partition(own, size - 1)[:size]).view(np.int64))
                sizes = [len(p) for p in out]
                columns = [np.concatenate(out), np.repeat([i for i, _ in sets], sizes), np.repeat([len(s) for _, s in sets], sizes).astype(np.int32), np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]), np.repeat([p[-1] for p in out], sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "sid", "n", "pos", "last"])

    return docs.mapInArrow(lean(run), "key long, sid long, n int, pos int, last long")


def shared_only(entries: DataFrame) -> DataFrame:
    """The entries whose token stands in the prefix of another set too, once each. Frequent tokens are salted and all stay."""
    salt = F.when(F.col("key") >= (1 << 58), F.pmod("sid", F.lit(64))).otherwise(F.lit(0))
    sorted_rows = entries.repartition("key", salt).sortWithinPartitions("key", "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: pa.RecordBatch | None = None  # the last row so far, not yet decided on, and the key of the row before it
        key_before = None
        for batch in gathered(batches):
            if not batch.num_rows:
                continue
            rows = batch if before is None else pa.concat_batches([before, batch])
            key, sid = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            first = np.ones(len(key), dtype=bool)
            first[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
            rows, key = rows.filter(pa.array(first)), key[first]
            same = np.zeros(len(key) + 1, dtype=bool)
            same[1:-1] = key[1:] == key[:-1]
            same[0] = key_before is not None and key[0] == key_before
            keep = same[:-1] | same[1:] | (key >= 1 << 58)
            yield rows.slice(0, len(key) - 1).filter(pa.array(keep[:-1]))
            before, key_before = rows.slice(len(key) - 1), key[-2] if len(key) > 1 else key_before
        if before is not None:
            key = before.column(0)[0].as_py()
            if key == key_before or key >= 1 << 58:
                yield before

    return sorted_rows.mapInArrow(lean(run), entries.schema)


def _possible(n: str, pos: str, n2: str, pos2: str) -> Column:
    """Whether sets of these sizes whose first common token stands at these positions can reach the threshold."""
    sizes = (ALL * F.least(n, n2) >= SHARED * F.greatest(n, n2))
    return sizes & ((SHARED + ALL) * F.least(F.col(n) - F.col(pos), F.col(n2) - F.col(pos2)) >= SHARED * (F.col(n) + F.col(n2)))


def _band(n: str) -> Column:
    """Sizes of linked sets are in the same band or in adjacent ones; the half keeps their quotients off the limit."""
    return F.floor(F.log(F.col(n) + 0.5) / float(np.log(ALL / SHARED)))


def _salts() -> Column:
    """Over how many tasks a token's holders are dealt out: its rank tells how many these are."""
    over = F.shiftrightunsigned("key", _RANK_AT) - _DEALT
    return F.when(over > 0, F.expr(f"shiftleft(1, cast(shiftrightunsigned(key, {_RANK_AT}) - {_DEALT} AS int))")).otherwise(F.lit(1))


def leader_pairs(entries: DataFrame, turn: int, leaders: int) -> DataFrame:
    """Pairs of each token's holders of similar size with some of them in other components: its leaders, one for each of
    ``leaders`` shares of the holders by a hash that differs from round to round."""
    banded = entries.withColumn("band", _band("n"))
    share = F.pmod(F.xxhash64("sid", F.lit(turn)), F.lit(leaders))
    own = ("sid", "n", "pos", "component")
    lead = banded.groupBy("key", "band", share.alias("share")).agg(F.min(F.struct(F.xxhash64("sid", F.lit(-turn)).alias("h"), *own)).alias("lead"))
    lead = lead.select("key", "band", *[F.col(f"lead.{c}").alias(f"{c}2") for c in own], F.explode(F.sequence(F.lit(0), _salts() - 1)).alias("salt"))
    dealt = banded.withColumn("salt", F.pmod(F.xxhash64("sid", F.lit(-1)), _salts()).cast("int"))
    each = dealt.join(lead, ["key", "band", "salt"])
    return each.where((F.col("component") != F.col("component2")) & _possible("n", "pos", "n2", "pos2")).select(F.least("sid", "sid2").alias("a"), F.greatest("sid", "sid2").alias("b")).distinct()


def mixed_entries(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """The entries of tokens whose holders are in different components, with their components."""
    own = entries.join(groups.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    own = stored(own.select("key", "sid", "n", "pos", "component"), "entries")
    mixed = own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    left = stored(own.join(mixed, "key"), "entries")
    discard(own)
    return left


def remaining_pairs(entries: DataFrame) -> DataFrame:
    """All possible pairs of a token's holders that are in different components.

    Where the first common token of a linked pair stands in the smaller set, at most a seventh of that set comes before it
    (for a threshold of 3/4): the overlap is at most what is left of it. So only such entries are looked up, in their own
    band of sizes and in the one above.
    """
    small = entries.where((SHARED + ALL) * (F.col("n") - F.col("pos")) >= 2 * SHARED * F.col("n"))
    small = small.select("key", F.explode(F.array(_band("n"), _band("n") + 1)).alias("band"), _salts().alias("salts"), *[F.col(c).alias(f"{c}2") for c in ("sid", "n", "pos", "component")])
    small = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    large = entries.withColumn("band", _band("n")).withColumn("salt", F.pmod(F.xxhash64("sid", F.lit(-1)), _salts()).cast("int"))
    ordered = (F.col("n") > F.col("n2")) | (F.col("n") == F.col("n2")) & (F.col("sid") < F.col("sid2"))
    both = large.join(small, ["key", "band", "salt"]).where(ordered & (F.col("component") != F.col("component2")) & _possible("n", "pos", "n2", "pos2"))
    return both.select(F.least("sid", "sid2").alias("a"), F.greatest("sid", "sid2").alias("b")).distinct()


def bounded(pairs: DataFrame, lists: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """Pairs whose shared prefix tokens allow the threshold.

    Of the set whose prefix ends first, a token of the prefix that is in the other set is in that set's prefix too; so the
    overlap is at most the number of shared prefix tokens and of the tokens after that prefix.
    """
    both = with_both(pairs, lists, "sid", hubs)
    first = F.when(F.col("last_a") <= F.col("last_b"), F.col("n_a")).otherwise(F.col("n_b"))
    after = F.ceil(first * SHARED / ALL) - 1
    most = F.size(F.array_intersect("keys_a", "keys_b")) + after
    return both.where((SHARED + ALL) * most >= SHARED * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, representatives: DataFrame, frequent: np.ndarray, rank: np.ndarray, hubs: DataFrame | None, broadcast_rows: int = 200_000) -> DataFrame:
    """The pairs that reach the threshold. Only texts of sets that stand in a pair are read again.

    The prefixes under the further orders come first; only pairs that meet in all of them are given their whole sets.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(representatives, "sid").select(F.col("rep").alias("doc_id"))
    wanted = stored(wanted, "wanted")
    texts = docs.join(F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted, "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1):
                found = shingle_sets(strings(part.column(1)))
                further = [further_prefixes(s, frequent, rank) for s in found]
                columns = [pa.array([set_id(s) for s in found], pa.int64()), *[pa.array(p, pa.binary()) for p in zip(*further, strict=True)], pa.array([s.tobytes() for s in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["sid", *_FURTHER, "tokens"])

    # A represented id may stand in rows with other texts: their sets are of no pair here, or equal to one that is.
    known = texts.select("doc_id", "text").mapInArrow(lean(sets), f"sid long, {', '.join(f'{c} binary' for c in _FURTHER)}, tokens binary")
    known = stored(known.dropDuplicates(["sid"]), "sets")

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for name in _FURTHER:
                x, y = batch.column(f"{name}_a"), batch.column(f"{name}_b")
                keep[keep] = [meet(x[int(i)].as_buffer(), y[int(i)].as_buffer()) for i in np.flatnonzero(keep)]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)) for x, y in zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    passed = stored(with_both(pairs, known.select("sid", *_FURTHER), "sid", hubs).mapInArrow(lean(through), "a long, b long"), "passed")
    links = stored(with_both(passed, known.select("sid", "tokens"), "sid", hubs).mapInArrow(lean(verify), "a long, b long"), "links")
    discard(known, wanted, passed)
    return links


_FURTHER = [f"prefix{k}" for k in range(1, ORDERS)]


def join_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_sets: bool = False) -> DataFrame:
    """Size of every document's shingle set, and its component: the smallest id reachable by links.

    Null and empty texts, and texts without words, have empty sets and are linked with nothing. Rows with a null id are
    linked with nothing. Rows repeated with one id give one row each, in the component of their own text. Other columns are
    ignored; an empty table gives no rows. A text is cut into shingles whole, at some forty bytes of memory a byte, in one
    worker. No set of tokens with many holders is gathered in one task, and nothing that grows with the documents is
    collected. ``with_sets`` adds the id of each document's set (column ``sid``; null where it links with nothing).
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    surveyed = stored(survey(rows), "survey")
    sized = surveyed.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("sid"))
    frequent, rank = frequent_tokens(surveyed)
    named = rows.where("doc_id is not null")
    linkable = sized.where("doc_id is not null and n_shingles > 0")
    representatives = stored(linkable.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "representatives")
    entries = stored(shared_only(prefixes(named, frequent, rank)), "prefixes")
    lists = stored(entries.groupBy("sid").agg(F.first("n").alias("n"), F.first("last").alias("last"), F.collect_list("key").alias("keys")), "lists")
    groups, links, mixed, left = None, [], None, entries.withColumn("component", F.col("sid"))
    for turn, leaders in enumerate((*LEADERS, None), 1):
        pairs = stored(remaining_pairs(left) if leaders is None else leader_pairs(left, turn, leaders), "pairs")
        hubs = hubs_of(pairs)
        likely = stored(bounded(pairs, lists, hubs), "likely")
        discard(pairs)
        if not likely.limit(1).count():
            discard(likely)
            continue
        links.append(verified(likely, named, representatives, frequent, rank, hubs))
        before, groups = groups, components(functools.reduce(DataFrame.unionByName, links))
        if before is not None:
            discard(before)
        discard(likely)
        if leaders is not None:
            left = mixed_entries(left.drop("component"), groups)
            if mixed is not None:
                discard(mixed)
            mixed = left
    linked = (groups if groups is not None else docs.sparkSession.createDataFrame([], "id long, component long")).withColumnRenamed("id", "sid").join(representatives, "sid")
    lowest = stored(linked.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("members")), "lowest")
    found = looked_up(linked.select("sid", "component"), lowest, ["component"], "members").select("sid", "component_id")
    # Sets of one document that are linked with nothing need no row here.
    facts = representatives.join(found, "sid", "left").where("copies > 1 or component_id is not null")
    facts = stored(facts.select("sid", F.coalesce("component_id", "rep").alias("component_id"), "copies"), "components")
    discard(entries, lists, lowest, representatives, *links, *[t for t in (groups, mixed) if t is not None])
    linkable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    joined = looked_up(sized.withColumn("sid", F.when(linkable, F.col("sid"))), facts, ["sid"], "copies")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *(["sid"] if with_sets else []))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of its smallest id. Rows with a null id, and texts without words, stay.

    Rows are told apart by their id and their text's set: of rows that repeat both one stays, and a row with another text
    under a repeated id is decided on by that text. Other columns, whatever their names, stay as they are; an empty table
    stays empty. Ids to leave out, and ids of several rows, are broadcast up to a fixed number, else joined by a shuffle.
    """
    found = stored(join_documents(docs, id_column, text_column, with_sets=True).where("doc_id is not null"), "components")
    several = stored(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "several")
    gone = stored(found.where("doc_id <> component_id").join(F.broadcast(several) if several.count() <= _BROADCAST else several, "doc_id", "left_anti").select(F.col("doc_id").alias(id_column)), "gone")
    left = without(docs, gone, id_column, _BROADCAST)
    if not several.limit(1).count():
        return left
    # Ids that stand in several rows: few, so their rows alone are named by their texts' sets and decided on one by one.
    unsure = left.join(several.withColumnRenamed("doc_id", id_column), id_column, "left_semi")
    taken, text_at = {c.lower() for c in docs.columns}, docs.columns.index(text_column)
    at = next(c for i in itertools.count() if (c := f"oblong_row{i}") not in taken)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text_at):
                sets = shingle_sets(strings(part.column(text_at).cast(pa.string())))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())], [*part.schema.names, at])

    named = unsure.mapInArrow(lean(name), T.StructType([*docs.schema.fields, T.StructField(at, T.LongType())]))
    own = found.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias(id_column), F.col("sid").alias("oblong_sid"), "component_id").distinct()
    own = own.where(F.col(id_column) == F.col("component_id")).drop("component_id")
    kept = named.join(own, (named[id_column] == own[id_column]) & (named[at] == own["oblong_sid"]), "left_semi").dropDuplicates([id_column, at])
    certain = without(left, several.withColumnRenamed("doc_id", id_column), id_column, _BROADCAST)
    return certain.unionByName(kept.drop(at)).unionByName(named.where(F.col(at).isNull()).drop(at))


_BROADCAST = 200_000
