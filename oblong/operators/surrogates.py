"""Learned scores of whole plans: dense networks over descriptors, ensembles, finite differences, guards, frozen weights.

Training takes a bounded sample that the caller draws; what is learned is a few kilobytes and travels with the functions that use it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np

from oblong.operators.linear import daylight, daylights

DESCRIPTORS = ("rooms", "width", "height", "area", "south", "daylight")
#: Least spread of an ensemble, slopes that count as none, least agreement of signs.
LEAST_SPREAD, FLAT, NOISE, LEAST_AGREEMENT = 0.02, 1e-12, 1e-3, 0.8


def descriptors(x: np.ndarray, deg: float) -> tuple[np.ndarray, np.ndarray]:
    """The descriptors of a plan, given as x, y, w, h room after room, and their slopes. The order of rooms does not matter."""
    s, c = np.sin(np.radians(deg)), np.cos(np.radians(deg))
    r = x.reshape(-1, 4)
    light, light_slope = daylight(x, deg)
    values = np.array([len(r), r[:, 2].sum(), r[:, 3].sum(), (r[:, 2] * r[:, 3]).sum(), -(r[:, 0] * s + r[:, 1] * c).sum(), light])
    slopes = np.zeros((6, *r.shape))
    slopes[1, :, 2] = slopes[2, :, 3] = 1.0
    slopes[3, :, 2], slopes[3, :, 3] = r[:, 3], r[:, 2]
    slopes[4, :, 0], slopes[4, :, 1] = -s, -c
    slopes = slopes.reshape(6, -1)
    slopes[5] = light_slope
    return values, slopes


def described(rooms: np.ndarray, deg: np.ndarray) -> np.ndarray:
    """The descriptors of many plans of equally many rooms: ``rooms`` by plan, room and x, y, w, h; ``deg`` by plan."""
    s, c = np.sin(np.radians(deg))[:, None], np.cos(np.radians(deg))[:, None]
    x, y, w, h = np.moveaxis(rooms, -1, 0)
    count = np.full(len(rooms), float(rooms.shape[1]))
    return np.stack((count, w.sum(axis=1), h.sum(axis=1), (w * h).sum(axis=1), -(x * s + y * c).sum(axis=1), daylights(rooms, deg)), axis=1)


def simulated_many(rooms: np.ndarray, deg: np.ndarray) -> np.ndarray:
    """``simulated`` of many plans of equally many rooms."""
    light = daylights(rooms, deg)
    return light / (1 + light / 60) + 0.4 * np.sqrt(np.maximum((rooms[..., 2] * rooms[..., 3]).sum(axis=1), 0.0))


def differences_many(score: Callable[[np.ndarray, np.ndarray], np.ndarray], rooms: np.ndarray, deg: np.ndarray, step: float) -> np.ndarray:
    """``finite_differences`` of many plans of equally many rooms, by a score of many; a row a plan."""
    count, size = len(rooms), rooms[0].size
    moves = step * np.eye(size)
    at = rooms.reshape(count, 1, size)
    ask = lambda v: score(v.reshape(count * size, -1, 4), np.repeat(deg, size)).reshape(count, size)
    return (ask(at + moves) - ask(at - moves)) / (2 * step)


def simulated(x: np.ndarray, deg: float) -> float:
    """The stand-in for a simulator: daylight that saturates, and a share of the area's root."""
    light = daylight(x, deg)[0]
    r = x.reshape(-1, 4)
    return light / (1 + light / 60) + 0.4 * float(np.sqrt(max((r[:, 2] * r[:, 3]).sum(), 0.0)))


@dataclass(frozen=True)
class Dense:
    """Two hidden layers on scaled descriptors that learn what a line through the daylight score leaves."""

    layers: tuple[tuple[np.ndarray, np.ndarray], ...]
    mean: np.ndarray
    scale: np.ndarray
    line: tuple[float, float]
    spread: float

    def _arrays(self) -> list[np.ndarray]:
        return [np.asarray(a, dtype="<f8") for a in (*[p for layer in self.layers for p in layer], self.mean, self.scale, self.line, [self.spread])]

    def fingerprint(self) -> str:
        """SHA-256 over the little-endian doubles of all that was learned."""
        return hashlib.sha256(b"".join(a.tobytes() for a in self._arrays())).hexdigest()

    def values(self, features: np.ndarray) -> np.ndarray:
        h = (features - self.mean) / self.scale
        for w, b in self.layers[:-1]:
            h = np.tanh(h @ w + b)
        w, b = self.layers[-1]
        return self.line[0] * features[:, -1] + self.line[1] + self.spread * (h @ w + b)[:, 0]

    def gradient(self, x: np.ndarray, deg: float) -> np.ndarray:
        """Slope of the score in the plan's own coordinates."""
        features, slopes = descriptors(x, deg)
        hidden = [(features - self.mean) / self.scale]
        for w, b in self.layers[:-1]:
            hidden.append(np.tanh(hidden[-1] @ w + b))
        back = self.layers[-1][0][:, 0]
        for (w, _), h in zip(self.layers[-2::-1], hidden[:0:-1], strict=True):
            back = w @ (back * (1 - h * h))
        by_feature = self.spread * back / self.scale
        by_feature[-1] += self.line[0]
        return by_feature @ slopes

    def value(self, x: np.ndarray, deg: float) -> float:
        return float(self.values(descriptors(x, deg)[0][None, :])[0])


def fit(features: np.ndarray, truths: np.ndarray, seed: int, hidden: int = 16, epochs: int = 300, rate: float = 0.01, decay: float = 1e-3) -> Dense:
    """Huber regression by Adam on whole batches; the same sample and seed give the same weights."""
    if len(features) < 2:
        raise ValueError("a network needs two training plans or more")
    mean, scale = features.mean(axis=0), np.maximum(features.std(axis=0), 1e-8)
    light = np.stack((features[:, -1], np.ones(len(features))), axis=1)
    line = np.linalg.lstsq(light, truths, rcond=None)[0]
    left = truths - light @ line
    spread = max(float(left.std()), 1e-8)
    z, y = (features - mean) / scale, left / spread
    rng = np.random.default_rng(seed)
    sizes = (features.shape[1], hidden, hidden, 1)
    flat = [p for a, b in zip(sizes, sizes[1:], strict=False) for p in (rng.normal(0, a**-0.5, (a, b)), np.zeros(b))]
    first, second = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat]
    for t in range(1, epochs + 1):
        h1 = np.tanh(z @ flat[0] + flat[1])
        h2 = np.tanh(h1 @ flat[2] + flat[3])
        error = np.clip((h2 @ flat[4] + flat[5])[:, 0] - y, -1, 1)[:, None] / len(y)
        d2 = (error @ flat[4].T) * (1 - h2 * h2)
        d1 = (d2 @ flat[2].T) * (1 - h1 * h1)
        slopes = [z.T @ d1, d1.sum(0), h1.T @ d2, d2.sum(0), h2.T @ error, error.sum(0)]
        for i, g in enumerate(slopes):
            g = g + decay * flat[i] / len(y) if flat[i].ndim == 2 else g
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            flat[i] = flat[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-9)
    return Dense(tuple(zip(flat[::2], flat[1::2], strict=True)), mean, scale, (float(line[0]), float(line[1])), spread)


def fit_ensemble(features: np.ndarray, truths: np.ndarray, members: int, seed: int, epochs: int = 300) -> list[Dense]:
    """Members trained on resamples with replacement of one sample, each with a seed of its own."""
    if members < 2:
        raise ValueError("an ensemble needs two members or more")
    nets = []
    for k in range(members):
        own = int.from_bytes(hashlib.sha256(f"{seed}:member:{k}".encode()).digest()[:8], "little")
        drawn = np.random.default_rng(own).integers(0, len(features), len(features))
        nets.append(fit(features[drawn], truths[drawn], own, epochs=epochs))
    return nets


def ensemble_values(members: Sequence[Dense], features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of the members, the latter not below its floor."""
    each = np.stack([m.values(features) for m in members])
    return each.mean(axis=0), np.maximum(each.std(axis=0, ddof=1), LEAST_SPREAD)


def finite_differences(score: Callable[[np.ndarray], float], x: np.ndarray, step: float) -> np.ndarray:
    """Central differences of any score: a gradient for what declares none."""
    out = np.empty(len(x))
    for i in range(len(x)):
        near, far = x.copy(), x.copy()
        near[i] -= step
        far[i] += step
        out[i] = (score(far) - score(near)) / (2 * step)
    return out


def agreement(declared: np.ndarray, target: np.ndarray) -> tuple[float, float, float]:
    """Relative error, cosine and share of equal signs of a declared gradient against a measured one.

    Both flat agree wholly. Signs count where the measured slope is more than noise; a declared slope of none disagrees there.
    """
    a, b = float(np.linalg.norm(declared)), float(np.linalg.norm(target))
    if a < FLAT and b < FLAT:
        return 0.0, 1.0, 1.0
    error = float(np.linalg.norm(declared - target)) / max(b, FLAT)
    cosine = float(declared @ target) / (a * b) if a > FLAT and b > FLAT else 0.0
    told = np.abs(target) >= NOISE
    same = (np.abs(declared[told]) >= FLAT) & ((declared[told] >= 0) == (target[told] >= 0))
    return error, cosine, float(same.mean()) if told.any() else 1.0


def guarded(declared: np.ndarray, target: np.ndarray, least: float = LEAST_AGREEMENT) -> tuple[np.ndarray, str]:
    """The declared gradient where its signs agree with a reference's slopes, else none at all, so that an optimizer stops there."""
    if not np.isfinite(declared).all() or not np.isfinite(target).all():
        return np.zeros_like(declared), "undefined"
    if agreement(declared, target)[2] < least:
        return np.zeros_like(declared), "refused"
    return declared, "ok"


def save(net: Dense, path: Path) -> str:
    """Writes a network as JSON with its fingerprint, which is returned."""
    digest = net.fingerprint()
    body = {"layers": [[w.tolist(), b.tolist()] for w, b in net.layers], "mean": net.mean.tolist(), "scale": net.scale.tolist(), "line": list(net.line), "spread": net.spread}
    Path(path).write_text(json.dumps({"sha256": digest, "net": body}))
    return digest


def load(path: Path, sha256: str | None = None) -> Dense:
    """Reads a network; weights that differ from the stored or the expected fingerprint, and other formats, are errors."""
    if Path(path).suffix != ".json":
        raise ValueError(f"weights in {Path(path).suffix or 'an unnamed format'} are not read: only JSON")
    held = json.loads(Path(path).read_text())
    body = held["net"]
    net = Dense(tuple((np.array(w), np.array(b)) for w, b in body["layers"]), np.array(body["mean"]), np.array(body["scale"]), tuple(body["line"]), body["spread"])
    if net.fingerprint() != held["sha256"] or sha256 not in (None, held["sha256"]):
        raise ValueError("the weights do not have the expected fingerprint")
    return net


def data_fingerprint(columns: dict[str, Sequence[float]]) -> str:
    """SHA-256 over named columns: each as its name, its length and its little-endian doubles, so that no value can change columns."""
    digest = hashlib.sha256()
    for name, values in columns.items():
        held = np.ascontiguousarray(values, dtype="<f8").ravel()
        digest.update(f"{name}:{held.size};".encode() + held.tobytes())
    return digest.hexdigest()


def signed_token(fingerprint: str, frozen_at: str) -> str:
    """The token of a frozen model: BLAKE2b of 16 bytes over its fingerprint and the instant of the freeze."""
    if not fingerprint or not frozen_at:
        raise ValueError("a token needs a fingerprint and an instant")
    return hashlib.blake2b(f"{fingerprint}|{frozen_at}".encode(), digest_size=16).hexdigest()


def conformal_level(scores: np.ndarray, alpha: float) -> float:
    """The rank ceil((n + 1)(1 - alpha)) of calibration scores; infinite where they are too few for alpha."""
    rank = int(np.ceil((len(scores) + 1) * (1 - alpha) - 1e-9))
    return float(np.sort(scores)[rank - 1]) if rank <= len(scores) else float("inf")
