"""Quality rules: counts of each text, and its distance from how its language is usually written.

For each language two histograms are learned from all its documents: of character classes, and of its common words (one
bin each, and one for all other words). A document is compared with the language it is nearest to, by the Jensen-Shannon
distance (base 2, from 0 to 1) of either histogram; short documents are too noisy to compare, so minimum lengths guard
either verdict.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oblong.llm.shared import by_block, discard, join_texts, lean, mix, per_text, spread, stored, windows, word_hashes, words_of
from oblong.llm.tokens import blocks, strings

#: Byte classes. Continuation bytes of UTF-8 belong to no class.
CLASSES = ("lower", "upper", "digit", "space", "break", "sentence", "symbol", "other", "beyond_ascii")
_CLASS_OF = np.full(256, 7, dtype=np.int64)
_CLASS_OF[97:123] = 0
_CLASS_OF[65:91] = 1
_CLASS_OF[48:58] = 2
_CLASS_OF[32] = 3
_CLASS_OF[9:14] = 4
_CLASS_OF[list(b".,;:!?'\"()-")] = 5
_CLASS_OF[list(b"#*$%&|<>")] = 6
_CLASS_OF[0xC0:] = 8
_CLASS_OF[0x80:0xC0] = len(CLASSES)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_WHITE = " \t\n\v\f\r"


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict."""

    least_words: int = 50  # below, base_failed
    most_repeat_percent: int = 50  # beyond, base_failed
    class_words: int = 50  # fewer words: no verdict by character classes
    common_words: int = 100  # fewer words: no verdict by common words
    class_distance: float = 0.25
    common_distance: float = 0.41
    common_share: float = 1 / 1000  # of a language's words, for a word to be common


@dataclass(frozen=True)
class References:
    """What is usual in each language. ``common``: sorted hashes of all languages' common words."""

    languages: list[str]
    classes: np.ndarray  # language x class
    common: np.ndarray
    is_common: np.ndarray  # language x common word
    words: np.ndarray  # language x (common word, other)


def _counts(texts: list[str | None], common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the counts of character classes, and of the common words followed by all words."""
    data, ends = join_texts(texts, lower=False)
    n = len(CLASSES) + 1
    own = np.bincount(np.repeat(np.arange(len(texts)) * n, np.diff(ends, prepend=0)) + _CLASS_OF[data], minlength=n * len(texts)).reshape(-1, n)[:, :-1].astype(float)
    own[:, CLASSES.index("break")] -= 1  # the line feed that was put after each text
    starts, stops, upto = words_of(data, ends)
    hashes = word_hashes(data, starts, stops)
    size = len(common) + 1
    words = np.zeros((len(texts), size))
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        hit = common[at] == hashes
        words = np.bincount(spread(upto)[hit] * size + at[hit], minlength=size * len(texts)).reshape(-1, size).astype(float)
    words[:, -1] = np.diff(upto, prepend=0)
    return own, words


def _language(column) -> F.Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def learn(docs: DataFrame, rules: Rules = Rules(), text_column: str = "text", lang_column: str = "lang") -> References:
    """References from all documents, in two passes: which words may be common, then exact counts.

    Tasks count words in stretches and hand on those that have a fiftieth of the wanted share of their stretch. What a word
    loses that way is less than a fiftieth of that share of all words, so every common word keeps 49 fiftieths of it in the
    sums over all stretches. No more than 50 / 49 / share words a language can reach that much; only they are collected,
    however the table is split. Documents without a language form one of their own.
    """
    chosen = docs.select(_language(F.col(lang_column)).alias("lang"), F.col(text_column).cast("string").alias("text"))
    share = rules.common_share
    lost = share / 50

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def stretch(lang: str) -> pa.RecordBatch:
            parts = held.pop(lang)
            words, where = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([c for _, c in parts]), minlength=len(words)).astype(np.int64)
            total = int(n.sum())
            keep = n >= lost * total
            size = int(keep.sum())
            columns = [pa.array([lang] * (size + 1), pa.string()), pa.array([*words[keep].view(np.int64).tolist(), None], pa.int64()), pa.array([*n[keep].tolist(), total], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])

        sizes: dict[str, int] = {}
        for batch in batches:
            for part in blocks(batch, 1):
                langs = np.array(strings(part.column(0)), dtype=object)
                data, ends = join_texts(strings(part.column(1)), lower=False)
                starts, stops, upto = words_of(data, ends)
                hashes, owner = word_hashes(data, starts, stops), langs[spread(upto)] if len(starts) else langs[:0]
                for lang in set(langs):
                    values, n = np.unique(hashes[owner == lang], return_counts=True)
                    held.setdefault(lang, []).append((values, n))
                    sizes[lang] = sizes.get(lang, 0) + len(values)
                    if sizes[lang] > 400_000:
                        yield stretch(lang)
                        sizes[lang] = 0
        for lang in list(held):
            yield stretch(lang)

    partial = chosen.mapInArrow(lean(frequent), "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    partial = stored(partial, "words")
    totals = partial.where("word is null").select("lang", F.col("n").alias("total"))
    reached = partial.where("word is not null").join(F.broadcast(totals), "lang").where(F.col("n") >= (share - lost) * F.col("total"))
    words = [r["word"] for r in reached.select("word").distinct().collect()]
    discard(partial)
    common = np.sort(np.array(words, dtype=np.int64).view(np.uint64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in blocks(batch, 1):
                own, found = _counts(strings(part.column(1)), common)
                share_of = own / np.maximum(own.sum(axis=1, keepdims=True), 1)  # each document counts alike
                rows = np.concatenate((share_of, found), axis=1)
                langs = np.array(strings(part.column(0)), dtype=object)
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + rows[langs == lang].sum(axis=0)
        rows = [(lang, i, float(v)) for lang, values in sums.items() for i, v in enumerate(values) if v]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64())], ["lang", "i", "v"])

    summed = chosen.mapInArrow(lean(count), "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v")).collect()
    languages = sorted({r["lang"] for r in summed})
    table = np.zeros((len(languages), len(CLASSES) + len(common) + 1))
    for lang, i, v in summed:
        table[languages.index(lang), i] = round(v, 6)  # sums of floats depend on their order in the last digits
    classes, found = table[:, : len(CLASSES)], table[:, len(CLASSES) :]
    rate = found / np.maximum(found[:, -1:], 1)
    is_common = rate[:, :-1] >= share
    used = is_common.any(axis=0)
    common, is_common, rate = common[used], is_common[:, used], rate[:, np.append(used, True)]
    words_of_language = np.concatenate((rate[:, :-1] * is_common, 1 - (rate[:, :-1] * is_common).sum(axis=1, keepdims=True)), axis=1)
    return References(languages, classes / np.maximum(classes.sum(axis=1, keepdims=True), 1e-12), common, is_common, words_of_language)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of the rows of p from the distribution q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip(part / 2, 0, 1))


def divergence(texts: list[str | None], known: References) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Distances by character classes and by common words from the nearest language, and that language."""
    own, found = _counts(texts, known.common)
    if not known.languages:
        return np.zeros(len(texts)), np.zeros(len(texts)), [""] * len(texts)
    p = own / np.maximum(own.sum(axis=1, keepdims=True), 1)
    rate = found[:, :-1] / np.maximum(found[:, -1:], 1)
    by_class = np.stack([distance(p, q) for q in known.classes], axis=1)
    by_word = np.stack([distance(np.concatenate((rate[:, c], 1 - rate[:, c].sum(axis=1, keepdims=True)), axis=1), np.append(q[:-1][c], q[-1])) for c, q in zip(known.is_common, known.words, strict=True)], axis=1)
    nearest = (by_class + by_word).argmin(axis=1)
    row = np.arange(len(texts))
    return by_class[row, nearest], by_word[row, nearest], [known.languages[i] for i in nearest]


def base_counts(texts: list[str | None]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, ends = join_texts(texts, lower=False)
    starts, stops, upto = words_of(data, ends)
    owner = spread(upto)
    letters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    hashes = word_hashes(data, starts, stops)
    grams = windows(hashes, 3)
    inside = owner[2:] == owner[: len(grams)] if len(grams) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(inside)
    keys = mix(grams[at] ^ mix(owner[at].astype(np.uint64) + np.uint64(1)))
    _, where, n = np.unique(keys, return_inverse=True, return_counts=True)
    again = at[n[where] > 1]
    covered = np.zeros(len(starts), dtype=bool)
    for k in range(3):
        covered[again + k] = True
    lines = []
    for text in texts:
        parts = text.split("\n") if text else []
        full = [x for x in parts if x.strip(_WHITE)] if len(parts) > 1 else []
        lines.append(len(full) - len(set(full)))
    chars = letters[stops] - letters[starts]
    return {"n_words": np.diff(upto, prepend=0), "word_chars": per_text(chars, upto), "n_symbols": per_text(_SYMBOL[data], ends), "n_dup_lines": np.array(lines, dtype=np.int64), "n_repeat_words": per_text(covered, upto)}


def verdicts(texts: list[str | None], known: References, rules: Rules) -> tuple[dict[str, np.ndarray], list[str]]:
    """Counts, verdicts and distances of some texts, and their nearest languages."""
    out = base_counts(texts)
    by_class, by_word, lang = divergence(texts, known)
    n = out["n_words"]
    failed = (n < rules.least_words) | (100 * out["n_repeat_words"] > rules.most_repeat_percent * n)
    far = (n >= rules.class_words) & (by_class > rules.class_distance) | (n >= rules.common_words) & (by_word > rules.common_distance)
    return out | {"base_failed": failed, "kept": ~failed & ~far, "class_distance": by_class, "word_distance": by_word}, lang


def judge(docs: DataFrame, known: References | None = None, rules: Rules = Rules(), id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Counts and verdict for every whole text; without references they are learned from ``docs``.

    Null and empty texts have no words, so they fail the base rules. Rows are independent given the references, so
    repeated rows give repeated results; other columns are ignored; an empty table gives no rows. A text is counted whole
    in one worker, at some ten bytes of memory a byte. Of languages equally near the first by name is taken, and a
    distance equal to its limit passes. No shuffle of rows.
    """
    own = known or learn(docs, rules, text_column, lang_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1):
                found, lang = verdicts(strings(part.column(1)), own, rules)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, found.values()), pa.array(lang, pa.string())], ["doc_id", *found, "nearest_lang"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double, nearest_lang string"
    return docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(lean(run), schema)


def keep(docs: DataFrame, known: References | None = None, rules: Rules = Rules(), text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows of ``docs`` that neither the base rules nor the distances reject, with all their columns, whatever their names.

    Null and empty texts go; repeated rows stay or go alike; a text is judged whole however long it is; an empty table stays empty.
    Distances equal to a limit pass. Only the texts cross to Python.
    """
    own = known or learn(docs, rules, text_column, lang_column)
    kept = F.arrow_udf(by_block(lambda texts: pa.array(verdicts(texts, own, rules)[0]["kept"], pa.bool_()), pa.bool_()), "boolean")
    return docs.where(kept(F.col(text_column).cast("string")))
