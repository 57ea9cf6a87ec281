"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of a fixed number of words. Each passage is encoded; a gated attention network, learned
from the documents' labels alone, weighs the passages; the weighted mean of their codes gives the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oblong.llm.quality import _CLASS_OF, CLASSES
from oblong.llm.sampling import labelled_sample
from oblong.llm.shared import join_texts, lean, mix, per_text, remainder, spread, windows, word_hashes, words_of
from oblong.llm.tokens import blocks, strings

PASSAGE_WORDS = 64
HASHED = 48
WIDTH = len(CLASSES) + 9 + HASHED


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of features of all passages, and for each text the number of passages up to its end. Each text has one at least.

    A passage is described by its share of each character class, its word lengths and cases, how much it repeats itself
    and the text before it, and the share of its words in each of some hashed groups.
    """
    data, ends = join_texts(texts, lower=False)
    starts, stops, upto = words_of(data, ends)
    owner = spread(upto)
    count = np.diff(upto, prepend=0)
    passages = np.maximum(1, -(-count // PASSAGE_WORDS))
    last = np.cumsum(passages)
    first_word = np.repeat(upto - count, count)
    number = (last - passages)[owner] + (np.arange(len(starts)) - first_word) // PASSAGE_WORDS
    total = int(last[-1]) if len(last) else 0
    out = np.zeros((total, WIDTH))
    if not len(starts):
        return out, last
    words_upto = np.searchsorted(number, np.arange(total), side="right")
    n = np.maximum(np.diff(words_upto, prepend=0), 1)
    # Each character counts to the passage of the last word that starts at or before it in its text, or to the text's first.
    size = np.diff(ends, prepend=0)
    word_at = np.searchsorted(starts, np.arange(len(data)), side="right") - 1
    place = np.maximum(word_at, np.repeat(upto - count, size))
    char_passage = np.where(np.repeat(count, size) > 0, number[np.minimum(place, len(starts) - 1)], np.repeat(last - passages, size))
    kinds = len(CLASSES) + 1
    chars = np.bincount(char_passage * kinds + _CLASS_OF[data], minlength=total * kinds).reshape(-1, kinds)[:, :-1]
    k = len(CLASSES)
    out[:, :k] = chars / np.maximum(chars.sum(axis=1, keepdims=True), 1)
    hashes = word_hashes(data, starts, stops)
    length = (stops - starts).astype(float)
    grams = windows(hashes, 3)
    at = np.flatnonzero(owner[2:] == owner[: len(grams)]) if len(grams) else np.zeros(0, dtype=np.int64)
    _, where, seen = np.unique(mix(grams[at] ^ mix(owner[at].astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
    repeated = np.zeros(len(starts))
    repeated[at] = seen[where] > 1
    same = np.zeros(len(starts))
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    begin, end = data[starts], data[stops - 1]
    alone = np.unique(mix(hashes ^ mix(number.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    distinct = np.zeros(len(starts))
    distinct[alone] = 1
    for j, values in enumerate((length / 10, np.minimum(length, 30) ** 2 / 100, length <= 3, (begin >= 65) & (begin <= 90), _CLASS_OF[end] == 5, _CLASS_OF[end] == 6, repeated, same, distinct)):
        out[:, k + j] = per_text(np.round(np.asarray(values, dtype=float) * 1e6), words_upto) / 1e6 / n
    groups = np.bincount(number * HASHED + (hashes % np.uint64(HASHED)).astype(np.int64), minlength=total * HASHED).reshape(-1, HASHED)
    out[:, k + 9 :] = np.sqrt(groups / n[:, None])
    return out, last


@dataclass(frozen=True)
class AttentionModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    shift: float  # from the sample's share of labels to that of all labelled rows

    def forward(self, rows: np.ndarray, upto: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = (rows - self.mean) / self.scale
        code = np.tanh(x @ w["code"] + w["code_bias"])
        turn, gate = np.tanh(code @ w["turn"]), 1 / (1 + np.exp(-(code @ w["gate"])))
        raw = (turn * gate) @ w["attend"]
        bag, first = spread(upto), np.concatenate(([0], upto[:-1]))
        weight = np.exp(raw - np.maximum.reduceat(raw, first)[bag])
        weight /= np.add.reduceat(weight, first)[bag]
        mean = np.add.reduceat(code * weight[:, None], first, axis=0)
        return {"x": x, "code": code, "turn": turn, "gate": gate, "bag": bag, "first": first, "weight": weight, "mean": mean, "logit": mean @ w["out"] + w["out_bias"]}

    def slopes(self, rows: np.ndarray, upto: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss of the bags by each weight."""
        w, f = self.weights, self.forward(rows, upto)
        bag, code, weight = f["bag"], f["code"], f["weight"]
        error = (1 / (1 + np.exp(-f["logit"])) - labels) / len(labels)
        d_mean = error[:, None] * w["out"]
        d_weight = (code * d_mean[bag]).sum(axis=1)
        d_raw = weight * (d_weight - np.add.reduceat(weight * d_weight, f["first"])[bag])
        d_turn = d_raw[:, None] * w["attend"] * f["gate"] * (1 - f["turn"] ** 2)
        d_gate = d_raw[:, None] * w["attend"] * f["turn"] * f["gate"] * (1 - f["gate"])
        d_code = (weight[:, None] * d_mean[bag] + d_turn @ w["turn"].T + d_gate @ w["gate"].T) * (1 - code**2)
        return {"code": f["x"].T @ d_code, "code_bias": d_code.sum(axis=0), "turn": code.T @ d_turn, "gate": code.T @ d_gate, "attend": (f["turn"] * f["gate"]).T @ d_raw, "out": f["mean"].T @ error, "out_bias": error.sum()}

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        rows, upto = encode(texts)
        return 1 / (1 + np.exp(-np.clip(self.forward(rows, upto)["logit"] + self.shift, -40, 40)))


def fit(bags: list[np.ndarray], labels: np.ndarray, counts: dict[int, int], size: int = 16, rounds: int = 30, seed: int = 5) -> AttentionModel:
    """Trains on bags of passage features with 0/1 labels by Adam."""
    random = np.random.default_rng(seed)
    everything = np.concatenate(bags)
    mean, scale = everything.mean(axis=0), everything.std(axis=0) + 1e-3
    draw = lambda a, b: random.normal(0, 1 / np.sqrt(a), (a, b))
    w = {"code": draw(WIDTH, size), "code_bias": np.zeros(size), "turn": draw(size, size), "gate": draw(size, size), "attend": draw(size, 1)[:, 0], "out": draw(size, 1)[:, 0], "out_bias": np.zeros(())}
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    shift = float(np.log(max(counts.get(1, 0), 0.5) / max(counts.get(0, 0), 0.5)) - np.log(n1 / n0))
    model = AttentionModel(mean, scale, w, shift)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for _ in range(rounds):
        order = random.permutation(len(bags))
        for at in range(0, len(order), 128):
            chosen = order[at : at + 128]
            rows, upto = np.concatenate([bags[i] for i in chosen]), np.cumsum([len(bags[i]) for i in chosen])
            slopes = model.slopes(rows, upto, labels[chosen])
            step += 1
            for k in w:
                slope = slopes[k] + 1e-4 * w[k] / max(1, len(order) // 128)
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.99 * second[k] + 0.01 * slope**2
                w[k] = w[k] - 0.005 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, label_column: str = "quality", id_column: str = "doc_id", text_column: str = "text", per_label: int = 1500, longest: int = 1 << 20) -> AttentionModel | None:
    """Fits on about ``per_label`` documents of either label; None where no document is labelled.

    The sample's bounded size allows broadcasting its ids; encoding runs where the texts are. Texts of more than ``longest``
    bytes are left out of the sample, so that it is bounded in bytes too; they are scored whole like all others. Labels other
    than 0 and 1 count by their sign.
    """
    known = labels.select(F.col(id_column).cast("long").alias("id"), (F.col(label_column) > 0).cast("int").alias("label"))
    sample, counts = labelled_sample(known, "label", F.col("id"), per_label, 2 * per_label)
    if not counts:
        return None
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 2):
                rows, upto = encode(strings(part.column(2)))
                bounds = [0, *upto.tolist()]
                data = [rows[a:b].astype(np.float32).tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(data, pa.binary())], ["id", "label", "rows"])

    held = texts.where(F.octet_length("text") <= longest).join(F.broadcast(sample), "id").select("id", "label", "text").mapInArrow(lean(run), "id long, label int, rows binary").collect()
    held.sort(key=lambda r: (r["id"], r["label"], bytes(r["rows"])))
    if not held:
        return None
    bags = [np.frombuffer(r["rows"], dtype=np.float32).reshape(-1, WIDTH).astype(float) for r in held]
    return fit(bags, np.array([r["label"] for r in held], dtype=float), counts)


def score(docs: DataFrame, labels: DataFrame, model: AttentionModel | None = None, threshold: float = 0.7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Score of every whole text; without a model one is trained on labels of ids whose remainder by 4 is not 2.

    Null and empty texts are one passage without words. A text is scored whole, whatever its length; a score of exactly the
    threshold predicts 1. Without any label every score is 0.5. Repeated rows give repeated
    results, other columns are ignored, an empty table gives no rows. Only the text enters a score.
    """
    own = model or train(docs, labels.where(remainder(F.col(id_column), 4) != 2), "quality", id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 2, 2 << 20):
                texts = strings(part.column(2))
                found = own.score(texts) if own else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found), pa.array(found >= threshold).cast(pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), (remainder(F.col(id_column), 4) == 2).alias("held_out"), F.col(text_column).cast("string").alias("text"))
    return chosen.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")
