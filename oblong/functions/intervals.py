"""Confidence intervals and tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper Wilson score limits; exactly 0 and 1 at the ends, null where n is 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = successes / n
    base = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / base
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / base
    low = F.when(successes == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), centre - half))
    high = F.when(successes == n, F.lit(1.0)).otherwise(F.least(F.lit(1.0), centre + half))
    return F.when(n.isNotNull(), low), F.when(n.isNotNull(), high)


def minimal_n(alpha: float) -> int:
    """The smallest calibration size whose conformal rank exists: ceil((n + 1)(1 - alpha)) <= n."""
    n = 1
    while conformal_rank(n, alpha) > n:
        n += 1
    return n


def conformal_rank(n: int, alpha: float) -> int:
    from fractions import Fraction
    from math import ceil

    return ceil((n + 1) * (1 - Fraction(str(alpha))))
