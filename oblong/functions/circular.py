"""Angles in degrees: differences, four conventions of sectors, and circular aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPS = 1e-9


def angular_difference(a: Column, b: Column) -> Column:
    """Shortest signed difference in ]-180, 180]."""
    gap = F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0
    return F.when(gap <= -180.0, F.lit(180.0)).otherwise(gap)


def sector_centred(deg: Column, n: int) -> Column:
    """Sector 0 is centred on 0 degrees."""
    width = 360.0 / n
    return F.pmod(F.floor(F.pmod(deg + width / 2, F.lit(360.0)) / width), F.lit(n)).cast("long")


def sector_edged(deg: Column, n: int) -> Column:
    """Sector 0 begins at 0 degrees."""
    return F.pmod(F.floor(F.pmod(deg, F.lit(360.0)) / (360.0 / n)), F.lit(n)).cast("long")


def sector_nearest(deg: Column, width: float) -> Column:
    """Degrees of the nearest sector centre; halves go to the even multiple."""
    return F.pmod(F.bround(F.pmod(deg, F.lit(360.0)) / width) * width, F.lit(360.0))


def quadrant(deg: Column) -> Column:
    """N, E, S or W."""
    return F.element_at(F.array(*map(F.lit, "NESW")), (sector_centred(deg, 4) + 1).cast("int"))


def harmonics(deg: Column, n: int) -> Column:
    """cos and sin of the first n multiples of the angle."""
    return F.array(*[f(F.radians(deg) * k) for k in range(1, n + 1) for f in (F.cos, F.sin)])


def resultant(deg: Column, weight: Column | None = None, period: float = 360.0) -> tuple[Column, Column]:
    """Sums of the weighted cosines and sines of the angle, turned so that ``period`` is a whole turn."""
    w = F.lit(1.0) if weight is None else weight
    turned = F.radians(deg * (360.0 / period))
    return F.sum(w * F.cos(turned)), F.sum(w * F.sin(turned))


def direction(c: Column, s: Column, period: float = 360.0) -> Column:
    """The direction of a resultant in [0, period[; null where it vanishes. What is just below the period is 0."""
    deg = F.pmod(F.degrees(F.atan2(s, c)) / (360.0 / period), F.lit(period))
    return F.when(F.hypot(c, s) > _EPS, F.when(deg > period - _EPS, F.lit(0.0)).otherwise(deg))


def concentration(c: Column, s: Column, n: Column) -> Column:
    return F.hypot(c, s) / n


def rayleigh_p(r: Column, n: Column) -> Column:
    """Approximate probability of a resultant this long if the angles were uniform."""
    return F.exp(-n * r * r)
