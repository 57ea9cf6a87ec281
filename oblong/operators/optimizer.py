"""Conditional gradients over a layout with users' scorers, steps, guards and penalties; functions of one plan.

A scorer has ``value(x)`` and ``gradient(x)``. It is an ordinary object that travels to the workers with the function it is used in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np

from oblong.operators.linear import Layout, Oracle, daylight, daylight_value


class Scorer(Protocol):
    def value(self, x: np.ndarray) -> float: ...

    def gradient(self, x: np.ndarray) -> np.ndarray: ...


class Steps(Protocol):
    """A rule for directions: (direction, longest step, whether it is an away step, which atom it leaves)."""

    def propose(self, slope: np.ndarray, x: np.ndarray, vertex: np.ndarray, atoms: list[np.ndarray], weights: list[float]) -> tuple[np.ndarray, float, bool, int | None]: ...


@dataclass(frozen=True)
class Daylight:
    """The analytic score for one azimuth."""

    deg: float

    def value(self, x: np.ndarray) -> float:
        return daylight_value(x, self.deg)

    def gradient(self, x: np.ndarray) -> np.ndarray:
        return daylight(x, self.deg)[1]


@dataclass(frozen=True)
class Differences:
    """A scorer from a value alone: its gradient by central differences of half width ``h``."""

    of: Callable[[np.ndarray], float]
    h: float = 1e-4

    def value(self, x: np.ndarray) -> float:
        return float(self.of(x))

    def gradient(self, x: np.ndarray) -> np.ndarray:
        step = self.h * np.eye(len(x))
        return np.array([self.of(x + e) - self.of(x - e) for e in step]) / (2 * self.h)


@dataclass
class Guarded:
    """A scorer whose every gradient is compared with differences of an independent value before it is followed.

    The share of components, by size, whose signs agree must reach ``threshold``. ``history`` keeps every share; a refused gradient
    is zero and sets ``refused``, so that the optimizer stops where it is.
    """

    scorer: Scorer
    reference: Callable[[np.ndarray], float]
    threshold: float = 0.7
    h: float = 0.1
    history: list[float] = field(default_factory=list)
    refused: bool = False

    def value(self, x: np.ndarray) -> float:
        return self.scorer.value(x)

    def gradient(self, x: np.ndarray) -> np.ndarray:
        slope, other = self.scorer.gradient(x), Differences(self.reference, self.h).gradient(x)
        telling = np.abs(other) > 1e-9 * max(1.0, float(np.abs(other).max(initial=0.0)))
        weight = np.abs(other) * telling
        share = float((weight * (np.sign(slope) == np.sign(other))).sum() / weight.sum()) if weight.sum() > 0 else 1.0
        ok = bool(np.isfinite(slope).all()) and share >= self.threshold
        self.history.append(share if np.isfinite(slope).all() else 0.0)
        self.refused = not ok
        return slope if ok else np.zeros(len(x))


@dataclass(frozen=True)
class AwaySteps:
    """Towards the oracle's vertex, or away from the worst atom where that promises more."""

    enabled: bool = True

    def propose(self, slope: np.ndarray, x: np.ndarray, vertex: np.ndarray, atoms: list[np.ndarray], weights: list[float]) -> tuple[np.ndarray, float, bool, int | None]:
        worst = min(range(len(atoms)), key=lambda k: slope @ atoms[k])
        if self.enabled and weights[worst] < 1.0 and slope @ (x - atoms[worst]) > slope @ (vertex - x):
            return x - atoms[worst], weights[worst] / (1 - weights[worst]), True, worst
        return vertex - x, 1.0, False, None


@dataclass(frozen=True)
class PairwiseSteps:
    """From the worst atom towards the oracle's vertex: weight moves from one to the other and all others stay."""

    def propose(self, slope: np.ndarray, x: np.ndarray, vertex: np.ndarray, atoms: list[np.ndarray], weights: list[float]) -> tuple[np.ndarray, float, bool, int | None]:
        worst = min(range(len(atoms)), key=lambda k: slope @ atoms[k])
        return vertex - atoms[worst], weights[worst], False, worst


@dataclass(frozen=True)
class Iteration:
    """``value``: of the scorer, without the penalty. ``objective``: what is maximised."""

    k: int
    value: float
    objective: float
    gap: float
    step: float
    kind: str


@dataclass(frozen=True)
class Improvement:
    """``status``: converged, stalled, refused, limit, or that of a failed oracle."""

    x: np.ndarray
    status: str
    trace: list[Iteration]
    refused_share: float | None = None


def improve(p: Layout, start: np.ndarray, scorer: Scorer, reference: np.ndarray | None = None, most: int = 50, tolerance: float = 1e-4, steps: Steps | None = None, penalty: float = 0.0, stall: int | None = None, stall_tolerance: float = 1e-9) -> Improvement:
    """Raises ``scorer`` inside a layout by conditional gradients with backtracking.

    With ``penalty`` the objective is the score less penalty / 2 times the squared distance from ``reference``. It stops when the gap
    is at most ``tolerance``, when ``stall`` steps on end each gained less than ``stall_tolerance``, when no step gains, or when a guard
    refuses a gradient. The objective never falls from one iteration to the next.
    """
    steps, centre = steps or AwaySteps(), start if reference is None else reference
    objective = lambda z, score: score - 0.5 * penalty * float(((z - centre) ** 2).sum())
    x, atoms, weights = start.copy(), [start.copy()], [1.0]
    trace: list[Iteration] = []
    gains: list[float] = []
    score = scorer.value(x)
    oracle = Oracle(Layout(p.a, p.b, np.minimum(p.low, start), np.maximum(p.high, start), p.origins, p.equal))
    for k in range(most):
        value = objective(x, score)
        slope = scorer.gradient(x) - penalty * (x - centre)
        if getattr(scorer, "refused", False):
            trace.append(Iteration(k, score, value, float("nan"), 0.0, "refused"))
            return Improvement(x, "refused", trace, scorer.history[-1])
        found = oracle.minimum(-slope)
        if found.x is None:
            return Improvement(x, found.status, trace)
        gap = float(slope @ (found.x - x))
        if gap <= tolerance:
            trace.append(Iteration(k, score, value, max(gap, 0.0), 0.0, "vertex"))
            return Improvement(x, "converged", trace)
        move, longest, away, leaving = steps.propose(slope, x, found.x, atoms, weights)
        step, rise = longest, float(slope @ move)
        while step > 1e-10 and objective(x + step * move, reached := scorer.value(x + step * move)) < value + 1e-4 * step * rise:
            step /= 2
        if step <= 1e-10 or rise <= 0:
            trace.append(Iteration(k, score, value, gap, 0.0, "none"))
            return Improvement(x, "stalled", trace)
        if away:
            weights = [v * (1 + step) for v in weights]
            weights[leaving] -= step
        elif leaving is not None:
            weights[leaving] -= step
            atoms.append(found.x), weights.append(step)
        else:
            weights = [v * (1 - step) for v in weights] + [step]
            atoms.append(found.x)
        kept = [i for i, v in enumerate(weights) if v > 1e-12]
        atoms, weights = [atoms[i] for i in kept], [weights[i] for i in kept]
        trace.append(Iteration(k, score, value, gap, step, "away" if away else "vertex"))
        x, score = x + step * move, reached
        gains.append(objective(x, score) - value)
        if stall is not None and len(gains) >= stall and max(gains[-stall:]) < stall_tolerance:
            trace.append(Iteration(k + 1, score, objective(x, score), gap, 0.0, "none"))
            return Improvement(x, "stalled", trace)
    trace.append(Iteration(most, score, objective(x, score), trace[-1].gap if trace else 0.0, 0.0, "none"))
    return Improvement(x, "limit", trace)
