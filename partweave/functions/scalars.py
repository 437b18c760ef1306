"""Scalar rules: rounding, modulo, densities, response kernels, thresholds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_away(x: Column) -> Column:
    return F.round(x).cast("int")


def toward_zero(x: Column) -> Column:
    return x.cast("int")


def wrapped_mod(a: Column, b: Column) -> Column:
    """``a % b`` for a >= 0; else ``b * (1 - a / b) + a`` with division toward
    zero, which gives b, not 0, at negative multiples of b."""
    return F.when(a >= 0, a % b).otherwise(b * (1 - (a / b).cast("long")) + a)


def normal_pdf(x: Column, mean, sigma) -> Column:
    z = (x - mean) / sigma
    return F.exp(-z * z / 2) / (sigma * math.sqrt(2 * math.pi))


def normal_peak(x: Column, mean, sigma) -> Column:
    """A normal curve with peak 1."""
    z = (x - mean) / sigma
    return F.exp(-z * z / 2)


def von_mises(x: Column, mean, kappa: float, bessel0: float) -> Column:
    return F.exp(kappa * F.cos(x - mean)) / (2 * math.pi * bessel0)


def similarity_score(distance: Column, largest: float = 5.0) -> Column:
    """1 for distance 0, 0 from ``largest`` on."""
    return 1 - F.least(distance, F.lit(largest)) / largest


def threshold(map_: Column, key: str, factor: float, default: float) -> Column:
    """A part's own threshold times a factor, else the default."""
    return F.coalesce(F.element_at(map_, key) * factor, F.lit(default))


def hue_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """HSV (h in degrees) to a struct of r, g, b in 0..1."""

    def channel(n: int) -> Column:
        k = F.pmod(n + h / 60, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return F.struct(channel(5).alias("r"), channel(3).alias("g"), channel(1).alias("b"))
