"""Spelling variants: words that differ by one code point, through forward and reversed sorted dictionaries.

An edit leaves half of a word intact: with l the length of the shorter of two near words, either their first l // 2 code points
are equal or their last l - l // 2. So the dictionary is sorted by prefixes of that length and, reversed, by suffixes, and near
words stand in one range of either. A range with too many words is subdivided by the same rule: of what its words do not yet
share, again the first or the last half must be equal. That ends by itself, as words that share all but one place are no more
than the alphabet allows. Ranges are counted before any row is moved, so no task is given more than a bounded one. In a range
all pairs are compared code point by code point, and only near ones leave it; a pair that stands in several ranges leaves the
one where the longest prefix is shared.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oblong.llm.shared import lean, looked_up, stored
from oblong.llm.tokens import blocks

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {c: c + 32 for c in range(65, 91)}


def lowered(word: str) -> str:
    """A-Z in lower case; other letters stay."""
    return word.lower() if word.isascii() else word.translate(_LOWER)


def run_counts(text: str, step: int = 1 << 20) -> Counter[str]:
    """How often each run of letters stands in the text. About ``step`` code points are looked at at once, cut between runs."""
    found: Counter[str] = Counter()
    at = 0
    while at < len(text):
        end = len(text)
        if at + step < end and (other := _OTHER.search(text, at + step)):
            end = other.start()
        found.update(_RUN.findall(text, at, end))
        at = end
    return found


def words_of(doc: str, text: str, by: int, shortest: int) -> Iterator[tuple[str, int]]:
    """The text's words and counts: runs in lower case; where ``by`` divides the hash of document and run, one code point is left out."""
    seed = zlib.crc32(f"{doc}:".encode())
    for run, n in run_counts(text).items():
        word = lowered(run)
        h = zlib.crc32(word.encode(), seed)
        if h % by == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= shortest:
            yield word, n


def dictionary(docs: DataFrame, by: int = 97, shortest: int = 5, least: int = 3, id_column: str = "doc_id", text_column: str = "text", most: int = 200_000) -> DataFrame:
    """(word, n) of all words of at least ``shortest`` code points that occur ``least`` times in all documents; tasks add up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for part in blocks(batch, 1):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for word, n in words_of(doc or "", text or "", by, shortest):
                        held[word] = held.get(word, 0) + n
                if len(held) >= most:
                    yield out()
        yield out()

    chosen = docs.select(F.col(id_column).cast("string"), F.col(text_column).cast("string"))
    return chosen.mapInArrow(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _keyed(rows: DataFrame) -> DataFrame:
    """Ranges by what their words share: a word's first ``a`` and last ``b`` code points. Those found by suffixes are sorted reversed."""
    head, tail = F.substr("word", F.lit(1), F.col("a")), F.when(F.col("b") > 0, F.expr("right(word, b)")).otherwise("")
    meta: list[Column] = [F.col(c).cast("string") for c in ("l", "a", "b", "below")]
    forward = F.concat_ws(" ", F.lit("f"), head, F.reverse(tail), *meta)
    reverse = F.concat_ws(" ", F.lit("r"), F.reverse(tail), head, *meta)
    return rows.withColumn("key", F.when(F.col("b") == 0, forward).otherwise(reverse))


def _split(rows: DataFrame) -> DataFrame:
    """Of the l - a - b code points that a range's words do not yet share, the first or else the last half is equal."""
    half = F.floor((F.col("l") - F.col("a") - F.col("b")) / 2).cast("int")
    first = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"), F.col("below").alias("below"))
    last = F.struct(F.col("a").alias("a"), (F.col("l") - F.col("a") - half).alias("b"), (F.col("a") + half).alias("below"))
    return _keyed(rows.select("word", "n", "l", F.explode(F.array(first, last)).alias("x")).select("word", "n", "l", "x.*"))


def compared(words: list[str], l: int, a: int, b: int, below: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of a range's words of which the shorter has ``l`` code points that differ by one edit between their first ``a``
    and last ``b`` code points and share fewer than ``below`` at the beginning."""
    sizes = np.array([len(w) for w in words])
    m = l - a - b

    def middle(size: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(sizes == size)
        letters = np.frombuffer("".join([words[i] for i in at]).encode("utf-32-le"), dtype=np.uint32).reshape(len(at), size)
        return at, letters[:, a : size - b]

    at, short = middle(l)
    at_long, long = middle(l + 1)
    if not len(at):
        return
    step = max(1, (1 << 22) // max(1, max(len(at), len(at_long)) * max(m, 1)))
    for k in range(0, len(at), step):
        own = short[k : k + step, None, :]
        same = own == short[None]
        prefix = np.logical_and.accumulate(same, axis=2).sum(axis=2) + a
        i, j = np.nonzero((same.sum(axis=2) == m - 1) & (prefix < below))
        keep = i + k < j
        yield from zip(at[i[keep] + k].tolist(), at[j[keep]].tolist(), strict=True)
        if len(at_long):
            prefix = np.logical_and.accumulate(own == long[None, :, :m], axis=2).sum(axis=2)
            suffix = np.logical_and.accumulate((own == long[None, :, 1:])[:, :, ::-1], axis=2).sum(axis=2)
            i, j = np.nonzero((prefix + suffix >= m) & (prefix + a < below))
            yield from zip(at[i + k].tolist(), at_long[j].tolist(), strict=True)


def near_pairs(words: DataFrame, most: int = 256) -> DataFrame:
    """(word, n, near, near_n), both ways round, of all words of ``words`` (word, n) that differ by exactly one code point put in,
    left out or replaced. Ranges of more than ``most`` words are subdivided."""
    whole = F.struct(F.length("word").alias("l"))
    shorter = F.struct((F.length("word") - 1).alias("l"))
    root = words.select("word", "n", F.explode(F.array(whole, shorter)).alias("x")).select("word", "n", "x.l", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(2**31 - 1).alias("below")).where("l > 0")
    level = stored(_split(root), "ranges")
    done: list[DataFrame] = []
    while True:
        counts = level.groupBy("key").agg(F.count("*").alias("held"), F.first(F.expr("l - a - b")).alias("open"))
        large = stored(counts.where(F.col("held") > most).where("open > 1").select("key", "held", F.lit(True).alias("large")), "large")
        if not large.limit(1).count():
            done.append(level)
            break
        met = looked_up(level, large, ["key"], "held")
        done.append(met.where("large is null").select(*level.columns))
        level = stored(_split(met.where("large")), "ranges")
    ranges = done[0]
    for more in done[1:]:
        ranges = ranges.unionByName(more)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shape = None, [], (0, 0, 0, 0)
        out: list[tuple[str, int, str, int]] = []

        def close() -> None:
            if len(held) > 1:
                for i, j in compared([w for w, _ in held], *shape):
                    out.append((*held[i], *held[j]))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64()] * 2, strict=True)], ["word", "n", "near", "near_n"])

        for batch in batches:
            for k, word, n, *now in zip(*[batch.column(c).to_pylist() for c in ("key", "word", "n", "l", "a", "b", "below")], strict=True):
                if k != key:
                    close()
                    key, held, shape = k, [], tuple(now)
                held.append((word, n))
            if len(out) > 50_000:
                yield batch_of()
        close()
        yield batch_of()

    ordered = ranges.repartitionByRange("key").sortWithinPartitions("key", "word")
    found = ordered.select("key", "word", "n", "l", "a", "b", "below").mapInArrow(lean(scan), "word string, n long, near string, near_n long")
    both = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return found.select(F.explode(both).alias("x")).select("x.*")


def group_variants(docs: DataFrame, by: int = 97, shortest: int = 5, least: int = 3, ratio: int = 2, most: int = 256, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words of whole texts; see ``dictionary`` and ``near_pairs``.

    A word's form is its near word of largest n, ties to the smallest in code-point order, if that n is at least ``ratio`` times
    its own; else null. The root is where forms lead to in the end. Null texts have no words and null ids count as empty text;
    repeated rows count as often as they occur; an empty table has no words. Texts are looked at by the megabyte, a run of any
    length as one word. Other columns of any name are left out. ``ratio`` must be 2 or more, so that forms never go in circles.
    """
    if ratio < 2:
        raise ValueError("forms would go in circles")
    words = stored(dictionary(docs, by, shortest, least, id_column, text_column), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_pairs(words, most).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, "word", "left")
    formed = (-F.col("best.less")) >= ratio * F.col("n")
    rows = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"))
    rows = stored(rows, "forms")
    # From the roots outwards: a word's followers are its near words, so no key has more rows than a word has neighbours.
    level = rows.where("form is null").select("word", F.col("word").alias("root"))
    roots = level
    following = rows.where("form is not null").select("word", "form")
    while True:
        level = stored(following.join(level.select(F.col("word").alias("form"), "root"), "form").select("word", "root"), "roots")
        if not level.limit(1).count():
            break
        roots = roots.unionByName(level)
    return rows.join(roots, "word").select("word", "n", "n_near", "form", "form_n", "root")
