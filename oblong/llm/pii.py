"""Personal data in texts: fixed base patterns, and spans found by weak supervision.

Base spans (email, ip, card, phone) are given by patterns alone and always stay. Candidates of further kinds are voted on
by labelers: patterns, gazetteers and the words around a span, each for, against or silent. Over the whole corpus the
vote patterns are counted, expectation maximisation estimates how reliable each labeler is for each kind, and the
resulting soft labels train a logistic classifier on the spans' shapes, which decides.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oblong.llm.shared import by_block, lean
from oblong.llm.tokens import blocks, strings

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("secret", "person", "national_id", "iban")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[Span]:
    """Each local part is the run before an @, so a search from the @ finds the leftmost matches in linear time."""
    end = at = 0
    while found := _DOMAIN.search(text, at):
        start = found.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < found.start():
            yield "email", start, found.end()
            end = at = found.end()
        else:
            at = found.start() + 1


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def base_spans(text: str) -> list[Span]:
    """The base spans of one text, by kind and start."""
    found = list(_emails(text)) if "@" in text else []
    if not _DIGITS.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


#: Words that name a credential, an identity number or a person.
CREDENTIAL_WORDS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "access_key", "access-key", "auth", "credential", "credentials", "private_key")
IDENTITY_WORDS = ("ssn", "social security", "tax id", "national id", "insurance number", "identity")
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
GIVEN_NAMES = ("James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "David", "Elizabeth", "William", "Barbara", "Richard", "Susan", "Joseph", "Jessica", "Thomas", "Sarah", "Maria", "Anna", "Peter", "Hans", "Jean", "Pierre", "Marie", "Carlos", "José", "Juan", "Sofia", "Laura", "Martin", "Paul", "Claire", "Julia", "Lukas", "Emma")
IBAN_COUNTRIES = ("AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk-", "xoxb-", "xoxp-", "eyJ", "AIza")

_RUN = re.compile(r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{12,}+")
_STRETCH = re.compile(r"[A-Za-z0-9_/+@.-]+")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_PERSON = re.compile(r"(?<![A-Za-z])(?:(?:" + "|".join(TITLES) + r")\.? |(?=(?:" + "|".join(GIVEN_NAMES) + r") ))[A-Z][a-zà-ÿ]+(?: [A-Z][a-zà-ÿ]+)?")
_ASSIGNED = re.compile(r"([A-Za-z_-]+)\s*[=:]\s*[\"']?\Z")
_VALUE = re.compile(r"(?<![A-Za-z_-])([A-Za-z_-]++)\s*+[=:]\s*+[\"']?([^\s\"',;&<>]++)")
_HEX = re.compile(r"[0-9a-f]+\Z|[0-9A-F]+\Z")
_KEY = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}\Z|(?:ghp_|gho_|sk-|AIza|xoxb-|xoxp-)[A-Za-z0-9_-]{16,}\Z|github_pat_[A-Za-z0-9_]{20,}\Z")
_NAMED = re.compile(r"\b(?:name|named|called|by|from|dear|hello|signed)\b\W*\Z", re.I)
_WINDOW = 40


def _entropy(text: str) -> float:
    data = text.encode()
    return -sum(n / len(data) * math.log2(n / len(data)) for n in Counter(data).values())


def _mod97(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _votes(kind: str, text: str, span: str, start: int, end: int) -> tuple[int, ...]:
    """For (1), against (-1) or silent (0), of the pattern, the gazetteer, the context and the shape labeler."""
    before, after = text[max(0, start - _WINDOW) : start], text[end : end + _WINDOW]
    around = (before + " " + after).lower()
    if kind == "secret":
        assigned = _ASSIGNED.search(before)
        named = assigned is not None and any(w in assigned[1].lower() for w in CREDENTIAL_WORDS)
        pattern = 1 if _KEY.match(span) or len(span) >= 16 and _HEX.match(span) and not span.isdigit() else -1 if span.isdigit() else 0
        gazetteer = 1 if named or span.startswith(KEY_PREFIXES) else 0
        context = 1 if assigned is not None else -1 if not any(w in around for w in CREDENTIAL_WORDS) and not _KEY.match(span) else 0
        digits = sum(c.isdigit() for c in span) / len(span)
        shape = 1 if _entropy(span) >= 3.0 and 0.1 <= digits <= 0.95 else -1
        return pattern, gazetteer, context, shape
    if kind == "person":
        words = span.replace(".", "").split(" ")
        titled, given = words[0] in TITLES, any(w in GIVEN_NAMES for w in words)
        return 1 if titled else 0, 1 if given else -1, 1 if _NAMED.search(before) else 0, 1 if len(words) >= 2 + titled else -1
    if kind == "national_id":
        area, group, serial = re.split("[- ]", span)
        valid = area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"
        return 1 if valid else -1, 0, 1 if any(w in around for w in IDENTITY_WORDS) else -1, 1 if "-" in span else -1
    return 1 if _mod97(span) else -1, 1 if span[:2] in IBAN_COUNTRIES else -1, 1 if "iban" in around or "account" in around else 0, 1 if len(span.replace(" ", "")) >= 15 else -1


def _features(kind: str, text: str, span: str, start: int, end: int) -> tuple[int, ...]:
    """Small integers that describe the span's shape and its neighbours; none repeats a vote."""
    n = len(span)
    digits, upper = sum(c.isdigit() for c in span), sum(c.isupper() for c in span)
    left, right = text[start - 1 : start], text[end : end + 1]
    side = lambda c: 0 if not c else 1 if c.isspace() else 2 if c in "\"'`" else 3 if c in "=:" else 4
    return EXTRA_KINDS.index(kind), min(n // 8, 6), 4 * digits // n, 4 * upper // n, side(left), side(right), int(bool(_HEX.match(span)))


#: Values that each feature can take.
_SIZES = (len(EXTRA_KINDS), 7, 5, 5, 5, 5, 2)
_OFFSETS = np.cumsum((0, *_SIZES[:-1]))
LABELERS = 4


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    votes: tuple[int, ...]
    features: tuple[int, ...]


def _assigned_values(text: str) -> Iterator[Span]:
    """What follows a credential word and = or :, without the punctuation that ends a sentence; the classifier decides on it."""
    for m in _VALUE.finditer(text):
        if any(w in m[1].lower() for w in CREDENTIAL_WORDS) and (value := m[2].rstrip(".!?:)]}")):
            yield "secret", m.start(2), m.start(2) + len(value)


def _runs(text: str) -> Iterator[Span]:
    """Long runs with a digit, but those that belong to something like an address: an @ follows in the same stretch of letters and dots.

    Each stretch is looked through once, however many runs it has.
    """
    end, last = 0, -1
    for m in _RUN.finditer(text):
        if m.start() >= end:
            end = _STRETCH.match(text, m.start()).end()
            last = text.rfind("@", m.start(), end)
        if last < m.end():
            yield "secret", *m.span()


def candidates(text: str, base: list[Span]) -> list[Candidate]:
    """Spans of further kinds to decide on; those that overlap a base span or an earlier candidate are left out."""
    found: list[tuple[str, int, int]] = [("person", *m.span()) for m in _PERSON.finditer(text)] if " " in text else []
    if "=" in text or ":" in text:
        found += _assigned_values(text)
    if _DIGITS.search(text):
        found += _runs(text)
        found += [("national_id", *m.span()) for m in _NATIONAL.finditer(text)]
        found += [("iban", *m.span()) for m in _IBAN.finditer(text)]
    if not found:
        return []
    order = {k: i for i, k in enumerate(("iban", "national_id", "secret", "person"))}
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], []
    for _, b in taken:
        reach.append(max(b, reach[-1] if reach else 0))
    kept, until = [], 0
    for kind, a, b in sorted(found, key=lambda x: (x[1], order[x[0]], -x[2])):
        i = bisect.bisect_left(starts, b) - 1
        if a < until or i >= 0 and reach[i] > a:
            continue
        until = b
        span = text[a:b]
        kept.append(Candidate(kind, a, b, _votes(kind, text, span, a, b), _features(kind, text, span, a, b)))
    return kept


@dataclass(frozen=True)
class SpanModel:
    """Weights of the span classifier, and what expectation maximisation found for each kind."""

    weights: np.ndarray
    bias: float
    prior: dict[str, float]
    reliability: dict[str, np.ndarray]  # kind -> labeler x (against, silent, for) x (no, yes)

    def score(self, found: list[Candidate]) -> np.ndarray:
        rows = np.array([c.features for c in found]) + _OFFSETS
        return 1 / (1 + np.exp(-(self.weights[rows].sum(axis=1) + self.bias)))


def _expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float, np.ndarray]:
    """Posteriors of vote patterns, the prior, and P(vote | class) of each labeler.

    Pseudo-counts hold that a vote is more often right than wrong, so that the classes can't change places.
    """
    belief = np.array([[6.0, 1.5], [6.0, 6.0], [1.5, 6.0]])  # vote x (no, yes)
    told = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern x labeler x vote
    yes = np.clip(0.5 + votes.sum(axis=1) / (2 * votes.shape[1]), 0.05, 0.95)
    for _ in range(rounds):
        both = np.stack([1 - yes, yes], axis=1) * counts[:, None]
        rate = np.einsum("plv,pc->lvc", told, both) + belief
        rate /= rate.sum(axis=1, keepdims=True)
        prior = (both[:, 1].sum() + 1) / (counts.sum() + 2)
        like = np.einsum("plv,lvc->pc", told, np.log(rate)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -50, 50)))
        if np.abs(new - yes).max() < 1e-9:
            break
        yes = new
    return yes, float(prior), rate


def fit(rows: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], steps: int = 400) -> SpanModel:
    """A model from counts of (kind, votes, features). Kinds without candidates keep the prior belief."""
    prior, reliability, features, soft, weight = {}, {}, [], [], []
    for kind in EXTRA_KINDS:
        own = sorted(r for r in rows if r[0] == kind)
        if not own:
            continue
        patterns = sorted({r[1] for r in own})
        place = {p: i for i, p in enumerate(patterns)}
        counts = np.zeros(len(patterns))
        for _, votes, _, n in own:
            counts[place[votes]] += n
        yes, prior[kind], reliability[kind] = _expectation_maximisation(np.array(patterns), counts)
        for _, votes, shape, n in own:
            features.append(shape)
            soft.append(yes[place[votes]])
            weight.append(n)
    weights, bias = np.zeros(sum(_SIZES)), -2.0
    if features:
        rows_at, target = np.array(features) + _OFFSETS, np.array(soft)
        share = np.sqrt(np.array(weight, dtype=float))  # frequent shapes must not drown rare ones
        share /= share.sum()
        first, second = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
        for step in range(1, steps + 1):
            error = (1 / (1 + np.exp(-(weights[rows_at].sum(axis=1) + bias))) - target) * share
            slope = np.zeros(len(weights) + 1)
            np.add.at(slope, rows_at.ravel(), np.repeat(error, len(_SIZES)))
            slope[:-1] += 1e-4 * weights
            slope[-1] = error.sum()
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
            weights, bias = weights - move[:-1], bias - move[-1]
    return SpanModel(weights, float(bias), prior, reliability)


def count_votes(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """How often each (kind, votes, features) occurs in the corpus. The grid of their values bounds the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            for part in blocks(batch, 0):
                for text in strings(part.column(0)):
                    for c in candidates(text, base_spans(text)) if text else ():
                        key = f"{c.kind}|{','.join(map(str, c.votes))}|{','.join(map(str, c.features))}"
                        seen[key] = seen.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    counted = docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(lean(run), "pattern string, n long")
    return counted.groupBy("pattern").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_column: str = "text") -> SpanModel:
    """Counts the vote patterns of all documents and fits the model on the driver."""
    numbers = lambda text: tuple(int(x) for x in text.split(","))
    rows = []
    for pattern, n in count_votes(docs, text_column).collect():
        kind, votes, features = pattern.split("|")
        rows.append((kind, numbers(votes), numbers(features), n))
    return fit(rows)


def find(text: str | None, model: SpanModel, threshold: float = 0.5) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of one text, each by kind and start."""
    if not text:
        return [], []
    base = base_spans(text)
    found = candidates(text, base)
    if not found:
        return base, []
    kept = [c for c, s in zip(found, model.score(found), strict=True) if s >= threshold]
    return base, [(k, c.start, c.end) for k in EXTRA_KINDS for c in kept if c.kind == k]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, model: SpanModel | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts and spans of every whole text; without a model one is trained on ``docs``.

    Null and empty texts have no spans. Rows are independent given the model, so repeated rows give repeated results;
    other columns are ignored; an empty table gives no rows. A text is searched whole, in time linear in its length. Candidates
    with a score of exactly the threshold are taken. Offsets are code points, ends exclusive.
    """
    own = model or train(docs, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1):
                found = [find(t, own) for t in strings(part.column(1))]
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in BASE_KINDS]
                digests = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
                spans = [written(base + extra) for base, extra in found]
                more = pa.array([len(extra) for _, extra in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(digests, pa.string()), pa.array(spans, pa.string()), more], ["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans", "n_added"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(lean(run), schema)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; where spans overlap, the one that starts first names them all."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: SpanModel | None = None, text_column: str = "text") -> DataFrame:
    """``docs`` with all found spans replaced; null and empty texts stay as they are, and so do other columns, whatever their names.

    Repeated rows change alike; a text is searched whole however long it is; an empty table stays empty. Only the texts cross to Python.
    """
    own = model or train(docs, text_column)
    replace = F.arrow_udf(by_block(lambda texts: pa.array([redacted(t, sum(find(t, own), [])) if t else t for t in texts], pa.string()), pa.string()), "string")
    return docs.withColumn(text_column, replace(F.col(text_column).cast("string")))
