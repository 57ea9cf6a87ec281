"""Distribution functions in numpy: incomplete beta and gamma, normal, Student, noncentral t, Kolmogorov-Smirnov."""

from __future__ import annotations

import math

import numpy as np


def _stirling_rest(z: float) -> float:
    """What Stirling's formula for log z! leaves over."""
    if z <= 15:
        return math.lgamma(z + 1) - (z + 0.5) * math.log(z) + z - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * z * z)) / (z * z)) / (z * z)) / z


def _deviance(k: float, mean: float) -> float:
    """k log(k / mean) + mean - k, without cancellation where both are close."""
    v = (k - mean) / (k + mean)
    if abs(v) > 0.1:
        return k * math.log(k / mean) + mean - k
    total, term, j = (k - mean) * v, 2 * k * v, 1
    while abs(term) > abs(total) * 1e-17:
        term *= v * v
        j += 2
        total += term / j
    return total


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction, whose terms grow with the root of the larger parameter."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    n = a + b
    power = _stirling_rest(n) - _stirling_rest(a) - _stirling_rest(b) - _deviance(a, n * x) - _deviance(b, n * (1 - x))
    front = math.exp(power) * math.sqrt(b / (2 * math.pi * a * n))
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 500 + 20 * math.isqrt(int(max(a, b)))):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * f


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if beta_inc(a, b, mid) < p else (low, mid)
    return (low + high) / 2


def clopper_pearson(successes: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    low = 0.0 if successes == 0 else beta_quantile(alpha / 2, successes, n - successes + 1)
    high = 1.0 if successes == n else beta_quantile(1 - alpha / 2, successes + 1, n - successes)
    return low, high


def t_cdf(t: float, df: float) -> float:
    half = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return 1 - half if t > 0 else half


def t_quantile(p: float, df: float) -> float:
    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def chi2_sf(x: float, df: float) -> float:
    """Upper tail by series or continued fraction of the incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def noncentral_t_cdf(t: float, df: float, shift: float) -> float:
    """By integrating the normal probability over the chi distribution of the scale."""
    s = np.linspace(1e-6, 1 + 12 / math.sqrt(2 * df) + 3, 20001)
    log_density = (df / 2) * math.log(df / 2) - math.lgamma(df / 2) + math.log(2) + (df - 1) * np.log(s) - df * s * s / 2
    values = np.exp(log_density) * np.array([normal_cdf(t * v - shift) for v in s])
    return float(np.trapezoid(values, s))


def power(effect: float, sigma: float, n: int, alpha: float = 0.05) -> float:
    """Power of a two-sided one-sample t test."""
    if n < 2:
        return 0.0
    shift, limit = effect / sigma * math.sqrt(n), t_quantile(1 - alpha / 2, n - 1)
    return 1 - noncentral_t_cdf(limit, n - 1, shift) + noncentral_t_cdf(-limit, n - 1, shift)


def binomial_two_sided(k: int, n: int) -> float:
    """Exact McNemar: two-sided binomial test at one half."""
    if n == 0:
        return 1.0
    few = min(k, n - k)
    tail = sum(math.comb(n, i) for i in range(few + 1)) / 2**n if n <= 200 else beta_inc(n - few, few + 1, 0.5)
    return min(1.0, 2 * tail)


def tost(mean: float, sd: float, n: int, delta: float) -> float:
    """p of equivalence within +-delta from the moments of paired differences; 0 or 1 where they don't vary."""
    if n < 2 or sd == 0:
        return 0.0 if abs(mean) < delta else 1.0
    scale = sd / math.sqrt(n)
    return max(1 - t_cdf((mean + delta) / scale, n - 1), t_cdf((mean - delta) / scale, n - 1))


def nadeau_bengio(mean: float, sd: float, n: int, n_train: int, n_test: int) -> tuple[float, float]:
    """Corrected resampled t statistic and its two-sided p."""
    if sd == 0:
        return (0.0, 1.0) if mean == 0 else (math.copysign(math.inf, mean), 0.0)
    t = mean / math.sqrt(sd * sd * (1 / n + n_test / n_train))
    return t, 2 * (1 - t_cdf(abs(t), n - 1))


def wilcoxon(differences: np.ndarray) -> float:
    """Two-sided signed-rank p by the normal approximation with tie correction; zero differences are left out."""
    d = differences[differences != 0]
    n = len(d)
    if n == 0:
        return 1.0
    values, inverse, counts = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    var = n * (n + 1) * (2 * n + 1) / 24 - (counts**3 - counts).sum() / 48
    return min(1.0, 2 * normal_cdf((w - n * (n + 1) / 4) / math.sqrt(var))) if var > 0 else 1.0


def friedman(ranks: np.ndarray) -> tuple[float, float]:
    """Statistic and p for a table of ranks, blocks in rows."""
    n, k = ranks.shape
    ties = sum(((c**3 - c).sum()) for c in (np.unique(r, return_counts=True)[1] for r in ranks))
    scale = 1 - ties / (n * k * (k * k - 1))
    if scale == 0:
        return 0.0, 1.0
    statistic = (12 / (n * k * (k + 1)) * (ranks.sum(axis=0) ** 2).sum() - 3 * n * (k + 1)) / scale
    return float(statistic), chi2_sf(float(statistic), k - 1)


def ks_statistic(a: np.ndarray, b: np.ndarray) -> float:
    both = np.concatenate((a, b))
    return float(np.abs(np.searchsorted(np.sort(a), both, "right") / len(a) - np.searchsorted(np.sort(b), both, "right") / len(b)).max())


def ks_permutation(a: np.ndarray, b: np.ndarray, seed: int, draws: int = 199) -> tuple[float, float]:
    """The statistic, and the share of permutations that reach it."""
    random, own, both = np.random.default_rng(seed), ks_statistic(a, b), np.concatenate((a, b))
    hits = 0
    for _ in range(draws):
        mixed = random.permutation(both)
        hits += ks_statistic(mixed[: len(a)], mixed[len(a) :]) >= own - 1e-12
    return own, (hits + 1) / (draws + 1)


def cluster_bootstrap(successes: np.ndarray, sizes: np.ndarray, seed: int, draws: int = 2000, alpha: float = 0.05) -> tuple[float, float]:
    """Percentile interval of a ratio of sums when whole clusters are drawn; NaN for fewer than two. Drawn in blocks of bounded size."""
    if len(sizes) < 2:
        return math.nan, math.nan
    random, ratio = np.random.default_rng(seed), []
    each = max(1, 2_000_000 // len(sizes))
    for k in range(0, draws, each):
        at = random.integers(0, len(sizes), (min(each, draws - k), len(sizes)))
        ratio.append(successes[at].sum(axis=1) / sizes[at].sum(axis=1))
    ratio = np.concatenate(ratio)
    return tuple(np.quantile(ratio, [alpha / 2, 1 - alpha / 2]).tolist())


def paired_bootstrap(a: np.ndarray, b: np.ndarray, seed: int, draws: int = 10_000, alpha: float = 0.05) -> tuple[float, float, float]:
    """Mean paired difference and its percentile interval; NaN ends for fewer than two pairs."""
    gap = np.asarray(a, dtype=float) - np.asarray(b, dtype=float)
    if len(gap) < 2:
        return (float(gap.mean()) if len(gap) else math.nan), math.nan, math.nan
    low, high = cluster_bootstrap(gap, np.ones(len(gap)), seed, draws, alpha)
    return float(gap.mean()), low, high


def metric_bootstrap(statistic, prediction: np.ndarray, truth: np.ndarray, seed: int, draws: int = 1000, alpha: float = 0.05) -> tuple[float, float]:
    """Percentile interval of any statistic of paired values; draws for which it is not finite are left out."""
    random = np.random.default_rng(seed)
    values = [statistic(prediction[at], truth[at]) for at in (random.integers(0, len(truth), len(truth)) for _ in range(draws))] if len(truth) > 1 else []
    finite = [v for v in values if math.isfinite(v)]
    return tuple(np.quantile(finite, [alpha / 2, 1 - alpha / 2]).tolist()) if finite else (math.nan, math.nan)


def crps(prediction: np.ndarray, truth: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Gaussian continuous ranked probability score of each row."""
    z = (truth - prediction) / spread
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    big = 0.5 * np.vectorize(math.erfc, otypes=[float])(-z / math.sqrt(2))
    return spread * (z * (2 * big - 1) + 2 * phi - 1 / math.sqrt(math.pi))
