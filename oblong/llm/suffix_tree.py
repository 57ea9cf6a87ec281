"""Language-model scores by a probabilistic suffix tree, and unigram base scores.

The tree's symbols are the bytes of lower-cased words, with a space between words and a line feed after the last; a context
is a run of symbols before a symbol, back to the space that stands before a text at most. Contexts are counted over all training documents.
One stays, however rare it is, if what follows it diverges enough from what follows its own suffix, or if a longer one that ends in it
stays. Its next-symbol distribution is smoothed with its suffix's. A symbol is scored in the state of the longest suffix of its history
that stayed. The tree grows with the corpus and is nowhere whole: its branches are built where the contexts that end in the same NEAR
bytes meet, and what lies above them, at most 256 ** NEAR rows, goes to all workers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oblong.llm.shared import gathered, join_texts, lean, mix, most_frequent, per_text, remainder, stored, word_hashes, words_of
from oblong.llm.tokens import blocks, strings

DEPTH = 5
NEAR = 3  # latest bytes by which contexts are dealt out
SPACE, END = 0x20, 0x0A
#: Hash of the token that ends every document; no word has it but by chance.
END_TOKEN = np.uint64(0x5BD1E9955BD1E995)
_LEVEL = 50  # bits below the context length in keys
_SYMBOLS = 256
_ROWS = 50_000  # sorted rows from which branches are built at once


def _codes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol with its longest context (symbol lowest, the latest context byte next), and where each text's symbols begin."""
    n = np.diff(upto, prepend=0)
    empty = n == 0
    sizes = stops - starts
    owner = np.repeat(np.arange(len(upto)), n)
    before = np.cumsum(empty) - empty
    ends = np.concatenate(([0], np.cumsum(sizes + 1)))  # of words with what follows them
    first = ends[upto - n] + np.arange(len(upto)) + before  # the space before each text
    length = int(ends[-1]) + len(upto) + int(empty.sum())
    stream = np.full(length, SPACE, dtype=np.int64)
    at = ends[:-1] + owner + 1 + before[owner]
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    stream[np.repeat(at, sizes) + inner] = np.maximum(data[np.repeat(starts, sizes) + inner], 1)
    after = np.append(first[1:], length)
    stream[after - 1] = END
    codes = stream.copy()
    for j in range(1, DEPTH + 1):
        codes[j:] |= stream[:-j] << (8 * j)
    for j in range(1, DEPTH):  # contexts end where the text begins
        near = first + j
        near = near[near < after]
        codes[near] &= (1 << 8 * (j + 1)) - 1
    keep = np.ones(length, dtype=bool)
    keep[first] = False
    return codes[keep], first - np.arange(len(first))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    n = np.concatenate([n for _, n in parts])[order]
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def count(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(kind, code, n) over all documents: 0 for words by hash, 1 for symbols with their longest contexts. Counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[tuple[np.ndarray, np.ndarray]] = []
        grams: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            for kind, parts in ((0, words), (1, grams)):
                if parts:
                    codes, n = _merged(parts)
                    for k in range(0, len(codes), 100_000):
                        c = codes[k : k + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), kind, dtype=np.int32)), pa.array(c.view(np.int64)), pa.array(n[k : k + 100_000])], ["kind", "code", "n"])
                    parts.clear()

        for batch in batches:
            for part in blocks(batch, 0):
                data, ends = join_texts(strings(part.column(0)))
                starts, stops, upto = words_of(data, ends)
                hashes = word_hashes(data, starts, stops)
                _, first, n = np.unique(hashes, return_index=True, return_counts=True)
                words.append((hashes[first], n))
                words.append((np.array([END_TOKEN]), np.array([part.num_rows])))
                codes, _ = _codes(data, starts, stops, upto)
                grams.append(np.unique(codes, return_counts=True))
                for parts in (words, grams):
                    if len(parts) > 16:
                        parts[:] = [_merged(parts)]
                if sum(len(k) for k, _ in words + grams) > 1_200_000:
                    yield from out()
        yield from out()

    counted = docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(lean(run), "kind int, code long, n long")
    return counted.groupBy("kind", "code").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class SuffixTree:
    """Natural logarithms of the smoothed probabilities. Keys hold the context's length, its bytes and the symbol."""

    joint: np.ndarray  # sorted keys of context and symbol
    seen: np.ndarray  # their log probabilities
    contexts: np.ndarray  # sorted keys of the contexts that stayed
    unseen: np.ndarray  # log of the weight that a context leaves to its suffix
    floor: float  # log probability of a symbol that never occurred

    def log_probabilities(self, length: np.ndarray, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Of each symbol after its context, in the longest state that stayed."""
        out = np.zeros(len(symbol))
        open_ = np.arange(len(symbol))
        for k in range(DEPTH, -1, -1):
            now = open_[length[open_] >= k]
            cut = context[now] & ((1 << 8 * k) - 1)
            found, value = _lookup(self.joint, self.seen, k << _LEVEL | cut << 8 | symbol[now])
            out[now] += value
            rest = now[~found]
            _, value = _lookup(self.contexts, self.unseen, k << _LEVEL | cut[~found])
            out[rest] += value
            open_ = np.setdiff1d(open_, now[found], assume_unique=True) if k else rest
        out[open_] += self.floor
        return out


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which wanted keys there are, and their values or 0."""
    if not len(keys) or not len(wanted):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return found, np.where(found, values[at], 0.0)


def _grown(k: np.ndarray, code: np.ndarray, n: np.ndarray, total: int, least_gain: float, forced: np.ndarray | None = None) -> SuffixTree:
    """The tree of whole contexts from their symbols' counts; ``forced`` are the keys of contexts that stay in any case."""
    floor = float(np.log(0.5 / (total + 0.5 * _SYMBOLS)))
    key = k << _LEVEL | code
    order = np.argsort(key)
    k, code, n, key = k[order], code[order], n[order].astype(float), key[order]
    if not len(key):
        return SuffixTree(key, n, key, n, floor)
    states, of = np.unique(k << _LEVEL | code >> 8, return_inverse=True)
    held = np.bincount(of, weights=n)
    parent_key = np.where(k > 0, (k - 1) << _LEVEL | code & ((1 << 8 * np.maximum(k, 1)) - 1), key)
    parent = np.searchsorted(key, parent_key)
    # What follows a context against what follows its suffix: the gain in log likelihood if the context stays.
    gain = np.bincount(of, weights=n * (np.log(n / held[of]) - np.log(n[parent] / held[of[parent]])))
    state_k, state_context = states >> _LEVEL, states & ((1 << _LEVEL) - 1)
    stays = (gain >= least_gain) | (state_k == 0)
    if forced is not None:
        stays |= np.isin(states, forced)
    above = np.searchsorted(states, np.where(state_k > 0, (state_k - 1) << _LEVEL | state_context & ((1 << 8 * np.maximum(state_k - 1, 0)) - 1), states))
    for level in range(DEPTH, 0, -1):
        stays[above[stays & (state_k == level)]] = True
    kinds = np.bincount(of).astype(float)  # different symbols after a context: its weight for the suffix
    p = np.zeros(len(key))
    root = k == 0
    p[root] = (n[root] + 0.5) / (total + 0.5 * _SYMBOLS)
    for level in range(1, DEPTH + 1):
        at = k == level
        p[at] = (n[at] + kinds[of[at]] * p[parent[at]]) / (held[of[at]] + kinds[of[at]])
    unseen = np.where(state_k > 0, np.log(kinds / (held + kinds)), 0.0)
    keep = stays[of]
    return SuffixTree(key[keep], np.log(p[keep]), states[stays], unseen[stays], floor)


def grow(counts: DataFrame, least_probability: float = 0.0, least_gain: float = 32.0) -> SuffixTree:
    """The whole tree on the driver, for small corpora, from counts of symbols with their longest contexts.

    Shorter contexts' counts are sums of these. Only contexts that are probable enough are collected, by default all.
    """
    whole = counts.where("kind = 1")
    every = whole.select("code", "n", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("k")).where("shiftrightunsigned(code, 8 * k) <> 0")
    joint = stored(every.select("k", F.expr("code & (shiftleft(1L, 8 * k + 8) - 1)").alias("code"), "n").groupBy("k", "code").agg(F.sum("n").alias("n")), "ngrams")
    total = joint.where("k = 0").agg(F.sum("n")).first()[0] or 0
    contexts = joint.groupBy("k", F.expr("shiftrightunsigned(code, 8)").alias("context")).agg(F.sum("n").alias("held")).where(F.col("held") >= max(1.0, least_probability * total))
    rows = joint.withColumn("context", F.expr("shiftrightunsigned(code, 8)")).join(contexts, ["k", "context"]).select(F.col("k").cast("long"), "code", "n").toArrow()
    return _grown(*(rows[c].to_numpy() for c in ("k", "code", "n")), total, least_gain)


def _levels(code: np.ndarray, n: np.ndarray, levels: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context lengths, codes and counts of symbols with contexts cut to the given lengths."""
    out = []
    for k in levels:
        has = code >> 8 * k != 0
        keys, place = np.unique(code[has] & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        out.append((np.full(len(keys), k, dtype=np.int64), keys, np.bincount(place, weights=n[has], minlength=len(keys))))
    k, code, n = (np.concatenate(part) for part in zip(*out, strict=True))
    return k, code, n


@dataclass(frozen=True)
class Trunk:
    """Counts of the contexts shorter than NEAR, the keys of those that stay, and all symbols' number."""

    k: np.ndarray
    code: np.ndarray
    n: np.ndarray
    forced: np.ndarray
    total: int
    least_gain: float

    def branches(self, code: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> SuffixTree:
        """The tree of all contexts that end in the same NEAR bytes as those counted, and of what is above them and above ``wanted``."""
        ends = np.unique(np.concatenate([code, wanted]) >> 8 & ((1 << 8 * (NEAR - 1)) - 1))
        own = (self.k < NEAR - 1) | np.isin(self.code >> 8, ends)
        parts = zip((self.k[own], self.code[own], self.n[own]), _levels(code, n, range(NEAR, DEPTH + 1)), strict=True)
        return _grown(*map(np.concatenate, parts), self.total, self.least_gain, self.forced)


def _dealt(grams: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Counts (code, n) and wanted symbols (code, n, row) by their latest context bytes: in each group the counts come first."""
    rows = grams.select("code", "n", F.lit(None).cast("long").alias("row"), F.lit(False).alias("wanted"))
    if wanted is not None:
        rows = rows.unionByName(wanted.select("code", "n", "row", F.lit(True).alias("wanted")))
    near = F.expr(f"shiftrightunsigned(code, 8) & {(1 << 8 * NEAR) - 1}L")
    return rows.withColumn("near", near).repartition("near").sortWithinPartitions("near", "wanted").drop("near")


def _branches(batches: Iterator[pa.RecordBatch], trunk: Trunk) -> Iterator[tuple[SuffixTree, np.ndarray, np.ndarray, np.ndarray]]:
    """Trees of whole groups from sorted rows, each with the wanted codes, their counts and rows. Of a group only the counts are held."""
    parts: list[tuple[np.ndarray, ...]] = []

    def out(last: bool) -> Iterator[tuple[SuffixTree, np.ndarray, np.ndarray, np.ndarray]]:
        code, n, row, wanted = (np.concatenate(c) for c in zip(*parts, strict=True))
        if not len(code):
            return
        near = code >> 8 & ((1 << 8 * NEAR) - 1)
        open_ = near == near[-1]
        use = np.ones(len(code), dtype=bool) if last or wanted[-1] else ~open_
        rest = np.zeros(len(code), dtype=bool) if last else open_ & ~wanted
        parts[:] = [(code[rest], n[rest], row[rest], wanted[rest])]
        given, asked = use & ~wanted, use & wanted
        if use.any():
            yield trunk.branches(code[given], n[given], code[asked]), code[asked], n[asked], row[asked]

    fresh = 0
    for batch in gathered(batches):
        if batch.num_rows:
            parts.append((batch.column("code").to_numpy(), batch.column("n").to_numpy(), batch.column("row").fill_null(0).to_numpy(), batch.column("wanted").to_numpy(zero_copy_only=False)))
            fresh += batch.num_rows
        if fresh >= _ROWS:
            yield from out(False)
            fresh = 0
    if parts:
        yield from out(True)


def trunk_of(grams: DataFrame, least_gain: float = 32.0) -> Trunk:
    """Short contexts' counts, and which stay: those that gain enough, and those in which a longer one that stays ends."""
    cut = grams.groupBy(F.expr(f"code & {(1 << 8 * NEAR) - 1}L").alias("code")).agg(F.sum("n").alias("n")).toArrow()
    code, n = cut["code"].to_numpy(), cut["n"].to_numpy()
    total = int(n.sum())
    none = np.zeros(0, dtype=np.int64)
    bare = Trunk(*_levels(code, n, range(NEAR)), none, total, least_gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, *_ in _branches(batches, bare):
            long = tree.contexts[tree.contexts >> _LEVEL == NEAR]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique((NEAR - 1) << _LEVEL | long & ((1 << 8 * (NEAR - 1)) - 1)))], ["context"])

    ended = _dealt(grams).mapInArrow(lean(run), "context long").distinct().toArrow()["context"].to_numpy()
    short = _grown(bare.k, bare.code, bare.n, total, least_gain, ended).contexts
    return Trunk(bare.k, bare.code, bare.n, short, total, least_gain)


def log_probabilities(grams: DataFrame, trunk: Trunk, wanted: DataFrame) -> DataFrame:
    """(row, value): for each wanted (code, n, row) n times the log probability of the symbol after its longest context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, code, n, row in _branches(batches, trunk):
            for i in range(0, len(code), 100_000):
                c = code[i : i + 100_000]
                value = tree.log_probabilities(_lengths(c), c >> 8, c & 255) * n[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(row[i : i + 100_000]), pa.array(value)], ["row", "value"])

    return _dealt(grams, wanted).mapInArrow(lean(run), "row long, value double")


def _lengths(codes: np.ndarray) -> np.ndarray:
    """How many bytes of context codes hold."""
    return sum(((codes >> 8 * k != 0).astype(np.int64) for k in range(1, DEPTH + 1)), np.zeros(len(codes), dtype=np.int64))


class Scores:
    """Log probabilities of the most frequent symbols with their contexts, NaN for others; the latest ones are kept in a table of fixed size."""

    def __init__(self, known: np.ndarray, log_probability: np.ndarray, bits: int = 20):
        self.known, self.log_probability, self.shift = known, log_probability, np.uint64(64 - bits)
        self.codes = np.zeros(1 << bits, dtype=np.int64)  # 0 is no code
        self.values = np.zeros(1 << bits)

    def of(self, codes: np.ndarray) -> np.ndarray:
        slot = (codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        out = self.values[slot]
        missing = np.flatnonzero(self.codes[slot] != codes)
        if len(missing):
            fresh, first, of = np.unique(codes[missing], return_index=True, return_inverse=True)
            found, value = _lookup(self.known, self.log_probability, fresh)
            value = np.where(found, value, np.nan)
            out[missing] = value[of]
            at = slot[missing[first]]
            self.codes[at], self.values[at] = fresh, value
        return out


def score(docs: DataFrame, training: DataFrame | None = None, head: int = 1 << 17, head_codes: int = 1 << 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Base score and tree score of every whole text, learned from ``training`` (texts), by default the documents whose id's remainder by 7 is not 2.

    Null and empty texts are the end token alone. Without training documents every count is 0 and the tree is uniform.
    A text is scored whole, whatever its length; contexts that gain exactly the least gain stay. Rows are told apart by where
    they stand, so repeated rows give repeated results; other columns are ignored; an empty
    table gives no rows. The counts of the ``head`` most frequent words and the log probabilities of the ``head_codes`` most
    frequent symbols with their contexts (fixed numbers) go to all workers; the other words meet their counts, and the other
    symbols the branches of the tree, in shuffles.
    """
    taught = training if training is not None else docs.where(remainder(F.col(id_column), 7) != 2)
    counts = stored(count(taught, text_column), "counts")
    words = counts.where("kind = 0").select(F.col("code").alias("word"), F.col("n").alias("c"))
    total, distinct = words.agg(F.sum("c"), F.count("*")).first()
    total = total or 0
    grams = counts.where("kind = 1").select("code", "n")
    trunk = trunk_of(grams)
    usual = log_probabilities(grams, trunk, most_frequent(grams, "n", head_codes).select("code", F.lit(1).cast("long").alias("n"), F.col("code").alias("row"))).toArrow()
    usual_codes, usual_values = usual["row"].to_numpy(), usual["value"].to_numpy()
    del usual
    sorted_codes = np.argsort(usual_codes)
    usual_codes, usual_values = usual_codes[sorted_codes], usual_values[sorted_codes]
    top = most_frequent(words, "c", head).toArrow()
    frequent = top["word"].to_numpy().view(np.uint64)
    order = np.argsort(frequent)
    frequent, known = frequent[order], top["c"].to_numpy()[order]
    end_count = words.where(F.col("word") == int(END_TOKEN)).agg(F.sum("c")).first()[0] or 0
    per_token = float(np.log10(total + distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(usual_codes, usual_values)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in blocks(batch, 2, 1 << 20):
                data, ends = join_texts(strings(part.column(2)))
                starts, stops, upto = words_of(data, ends)
                hashes = word_hashes(data, starts, stops)
                n = np.diff(upto, prepend=0)
                kinds, first, of = np.unique(hashes, return_index=True, return_inverse=True)
                codes, begin = _codes(data, starts, stops, upto)
                values = scores.of(codes)
                unusual = np.flatnonzero(np.isnan(values))
                values[unusual] = 0.0
                tree_score = np.add.reduceat(values, begin) if len(begin) else np.zeros(0)
                at = np.minimum(np.searchsorted(frequent, kinds), max(len(frequent) - 1, 0))
                in_head = frequent[at] == kinds if len(frequent) else np.zeros(len(kinds), dtype=bool)
                c = np.where(in_head, known[at], 0) if len(frequent) else np.zeros(len(kinds))
                base = np.concatenate(([0.0], np.cumsum(np.log10(c + 1.0)[of])))
                base = np.diff(base[upto], prepend=0) + np.log10(end_count + 1.0) - (n + 1) * per_token
                seen = per_text((c > 0)[of], upto) + (end_count > 0)
                ids = row + np.arange(part.num_rows)
                row += part.num_rows
                zero = pa.array(np.zeros(part.num_rows, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids), part.column(0), part.column(1), pa.array(n + 1), pa.array(seen), pa.array(base), pa.array(tree_score), pa.nulls(part.num_rows, pa.int64()), zero, pa.nulls(part.num_rows, pa.int64())], _NAMES)
                tail = np.flatnonzero(~in_head[of])
                if len(tail):
                    owner = np.searchsorted(upto, tail, side="right")
                    pair, where, many = np.unique(mix(hashes[tail] ^ mix(owner.astype(np.uint64))), return_index=True, return_counts=True)
                    k = len(pair)
                    nothing = pa.nulls(k, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[owner[where]]), nothing, pa.nulls(k, pa.bool_()), nothing, nothing, pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), pa.array(hashes[tail[where]].view(np.int64)), pa.array(many.astype(np.int64)), nothing], _NAMES)
                if len(unusual):
                    owner = np.searchsorted(begin, unusual, side="right") - 1
                    order = np.lexsort((codes[unusual], owner))
                    owner, code = owner[order], codes[unusual][order]
                    where = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])))
                    k = len(where)
                    nothing = pa.nulls(k, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[owner[where]]), nothing, pa.nulls(k, pa.bool_()), nothing, nothing, pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), nothing, pa.array(np.diff(where, append=len(code))), pa.array(code[where])], _NAMES)

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), (remainder(F.col(id_column), 7) == 2).alias("held_out"), F.col(text_column).cast("string").alias("text"))
    rows = stored(chosen.mapInArrow(lean(run), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word long, many long, code long"), "scored")
    rare = rows.where("word is not null").select("row", "word", "many").join(words, "word")
    sums = rare.groupBy("row").agg(F.sum(F.col("many") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("many").alias("found"))
    shares = log_probabilities(grams, trunk, rows.where("code is not null").select("code", F.col("many").alias("n"), "row")).groupBy("row").agg(F.sum("value").alias("share"))
    texts = rows.where("n_tokens is not null").join(sums, "row", "left").join(shares, "row", "left")
    whole_score = (F.col("score") + F.coalesce("share", F.lit(0.0))) / float(np.log(10))
    return texts.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), whole_score.alias("score"))


_NAMES = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "many", "code"]
