"""Language identification with error-correcting output codes.

Each language has a codeword; for each bit a logistic classifier on hashed byte n-grams learns on which side a text's
language stands. A text goes to the codeword with the smallest loss over all bits, each bit weighted by how well its
classifier does; texts whose two best codewords are nearly as good are flagged as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oblong.llm.sampling import labelled_sample
from oblong.llm.shared import by_block, join_texts, lean, remainder
from oblong.llm.tokens import blocks, strings

DIMENSIONS = 4096
UNDETERMINED = "und"
#: Texts whose best codeword is less than this ahead of the next one are ambiguous.
AMBIGUOUS = 0.7
_LETTER = re.compile(r"[^\W\d_]")


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of -1 and 1: every split of the languages where these are few, else the best of some random codes."""
    if n <= 6:
        bits = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(bits, dtype=float).T.reshape(n, len(bits))
    random, best, apart = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = random.choice([-1.0, 1.0], size=(n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        different = (code[:, None, :] != code[None, :, :]).sum(axis=2)
        least = int(different[~np.eye(n, dtype=bool)].min())
        if least > apart:
            best, apart = code, least
    return best


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Per text the square roots of the shares of its hashed byte trigrams (rows of length 1, or 0 for empty texts), and their number."""
    data, ends = join_texts(texts)
    n = len(data) - 2
    if n <= 0:
        return np.zeros((len(texts), DIMENSIONS), dtype=np.float32), np.zeros(len(texts))
    b = data.astype(np.uint32)
    gram = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(20)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    inside = owner[2:] == owner[:-2]
    place = (owner[:-2] * DIMENSIONS + gram)[inside]
    counts = np.bincount(place, minlength=DIMENSIONS * len(texts)).reshape(-1, DIMENSIONS)
    total = counts.sum(axis=1)
    return np.sqrt(counts / np.maximum(total, 1)[:, None]).astype(np.float32), total


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # dimension x bit
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss

    def losses(self, rows: np.ndarray, trigrams: np.ndarray) -> np.ndarray:
        """Loss of each text under each language's codeword. Margins shrink where a text has few trigrams."""
        margin = (rows @ self.weights + self.bias) * (trigrams / (trigrams + 20.0))[:, None]
        return np.stack([(np.logaddexp(0, -margin * c) * self.trust).sum(axis=1) for c in self.code], axis=1)


def fit(rows: np.ndarray, labels: list[str], steps: int = 150) -> LanguageModel:
    """Trains all bit classifiers together; every language counts alike."""
    languages = sorted(set(labels))
    if len(languages) < 2:
        return LanguageModel(languages, np.zeros((len(languages), 0)), np.zeros((DIMENSIONS, 0), dtype=np.float32), np.zeros(0, dtype=np.float32), np.zeros(0))
    code = codewords(len(languages))
    own = np.array([languages.index(x) for x in labels])
    target = code[own].astype(np.float32)
    share = (1 / np.bincount(own, minlength=len(languages))[own] / len(languages)).astype(np.float32)[:, None]
    weights, bias = np.zeros((DIMENSIONS, code.shape[1]), dtype=np.float32), np.zeros(code.shape[1], dtype=np.float32)
    first, second = [np.zeros_like(weights), np.zeros_like(bias)], [np.zeros_like(weights), np.zeros_like(bias)]
    for step in range(1, steps + 1):
        pull = -target * share / (1 + np.exp(target * (rows @ weights + bias)))
        for i, (value, slope) in enumerate(((weights, rows.T @ pull + 1e-6 * weights), (bias, pull.sum(axis=0)))):
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.99 * second[i] + 0.01 * slope**2
            value -= 0.3 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    right = (((rows @ weights + bias) * target > 0) * share).sum(axis=0)
    trust = np.log(np.clip(right, 0.51, 0.999) / (1 - np.clip(right, 0.51, 0.999)))
    return LanguageModel(languages, code, weights, bias, trust / trust.mean())


def train(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id", per_language: int = 500, in_all: int = 6000) -> LanguageModel:
    """Fits on about ``per_language`` documents a language, ``in_all`` at most; null languages and texts are left out.

    Documents are drawn by their ids, so that copies of one text are drawn each for itself.
    """
    rows = docs.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text"), F.col(id_column).cast("string").alias("id")).where("text is not null")
    sample, _ = labelled_sample(rows, "lang", F.coalesce("id", "text"), per_language, in_all)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1):
                found, _ = features(strings(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([row.astype(np.float16).tobytes() for row in found], pa.binary())], ["lang", "row"])

    held = sample.select("lang", "text").mapInArrow(lean(run), "lang string, row binary").collect()
    held.sort(key=lambda r: (r["lang"], bytes(r["row"])))
    matrix = np.stack([np.frombuffer(r["row"], dtype=np.float16).astype(np.float32) for r in held]) if held else np.zeros((0, DIMENSIONS), dtype=np.float32)
    return fit(matrix, [r["lang"] for r in held])


def predict(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, its share of the decoding's weight (0 to 1), and how far its loss is ahead of the next one's."""
    written = np.array([bool(t) and _LETTER.search(t) is not None for t in texts], dtype=bool)
    if not model.languages or not len(texts):
        return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    losses = model.losses(*features(texts))
    losses -= losses.min(axis=1, keepdims=True)
    weight = np.exp(-losses)
    best = losses.argmin(axis=1)
    score = np.where(written, 1 / weight.sum(axis=1), 0.0)
    ahead = np.where(written, np.partition(losses, 1, axis=1)[:, 1] if len(model.languages) > 1 else np.inf, 0.0)
    return [model.languages[i] if w else UNDETERMINED for i, w in zip(best, written, strict=True)], score, ahead


def identify(docs: DataFrame, model: LanguageModel | None = None, ambiguous_within: float = AMBIGUOUS, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Language of every whole text; without a model one is trained on the rows whose id's remainder by 3 is not 1.

    Null texts and texts without a letter are ``und`` with score 0 and ambiguous. Null and repeated ids are allowed, other columns are
    ignored, an empty table gives no rows. A text is read whole, whatever its length. Of equal losses the first language by name wins;
    such texts are ambiguous. Only the text enters a prediction. No shuffle of rows.
    """
    own = model or train(docs.where(remainder(F.col(id_column), 3) != 1), text_column, lang_column, id_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 2):
                lang, score, ahead = predict(strings(part.column(2)), own)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(ahead < ambiguous_within)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), (remainder(F.col(id_column), 3) == 1).alias("held_out"), F.col(text_column).cast("string").alias("text"))
    return chosen.mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep(docs: DataFrame, model: LanguageModel | None = None, ambiguous_within: float = AMBIGUOUS, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text has a language that is not ambiguous, with all their columns, whatever their names.

    Null texts and texts without a letter go; repeated rows stay or go alike; a text is read whole however long it is; an
    empty table stays empty. Only the texts cross to Python.
    """
    own = model or train(docs.where(remainder(F.col(id_column), 3) != 1), text_column, lang_column, id_column)
    sure = F.arrow_udf(by_block(lambda texts: pa.array(predict(texts, own)[2] >= ambiguous_within, pa.bool_()), pa.bool_()), "boolean")
    return docs.where(sure(F.col(text_column).cast("string")))
