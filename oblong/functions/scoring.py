"""Closed-form daylight scores of rooms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from oblong.functions.circular import sector_centred

#: Exposure of the sectors N, NE, E, SE, S, SW, W, NW, and the constants of both models.
EXPOSURE = (0.45, 0.55, 0.70, 0.90, 1.00, 0.90, 0.70, 0.55)
DEPTH_FACTOR, HEAD_HEIGHT, SOUTHWARD = 2.5, 2.15, 0.15
TRANSMITTANCE, REFLECTANCE, SKY_DEGREES, CEILING, GLAZING, BAND = 0.70, 0.50, 65.0, 2.70, 1.15, 0.30


def exposure(deg: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, EXPOSURE)), (sector_centred(deg, 8) + 1).cast("int"))


def facade(w: Column, h: Column, deg: Column) -> Column:
    """Length towards the south."""
    return w * F.pow(F.cos(F.radians(deg)), F.lit(2.0)) + h * F.pow(F.sin(F.radians(deg)), F.lit(2.0))


def analytic(x: Column, y: Column, w: Column, h: Column, deg: Column) -> Column:
    """Facade times lit depth, with a preference for the south."""
    depth = w * F.pow(F.sin(F.radians(deg)), F.lit(2.0)) + h * F.pow(F.cos(F.radians(deg)), F.lit(2.0))
    lit_depth = F.least(depth, DEPTH_FACTOR * HEAD_HEIGHT * exposure(deg))
    return facade(w, h, deg) * lit_depth * F.exp(SOUTHWARD * (-x * F.sin(F.radians(deg)) - y * F.cos(F.radians(deg))))


def daylight_factor(w: Column, h: Column, deg: Column) -> Column:
    """Mean daylight factor of the split-flux formula, in percent."""
    glass = BAND * GLAZING * facade(w, h, deg)
    surface = (2 * w * h + 2 * (w + h) * CEILING) * (1 - REFLECTANCE**2)
    return TRANSMITTANCE * glass * (SKY_DEGREES * exposure(deg)) / surface


def split_flux(x: Column, y: Column, w: Column, h: Column, deg: Column) -> Column:
    return analytic(x, y, w, h, deg) + daylight_factor(w, h, deg) * w * h
