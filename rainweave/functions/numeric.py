"""Rounding, clamping and guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LAPSE_RATE_C_PER_M = -0.0065


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(c, digits: int) -> Column:
    return F.bround(col(c), digits)


def ratio(numerator, denominator) -> Column:
    """NULL where the denominator is zero or NULL."""
    d = col(denominator)
    return F.when(d != 0, col(numerator) / d)


def floored_ratio(numerator, denominator, floor: float = 1e-4) -> Column:
    return col(numerator) / F.greatest(F.lit(floor), col(denominator).cast("double"))


def clamp(c, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), col(c)))


def sigmoid(c, slope=1.0, intercept=0.0, limit: float = 40.0) -> Column:
    z = clamp(col(c) * slope + intercept, -limit, limit)
    return 1.0 / (1.0 + F.exp(-z))


def isclose(a, b, rel_tol: float = 1e-10) -> Column:
    x, y = col(a), col(b)
    return F.abs(x - y) <= rel_tol * F.greatest(F.abs(x), F.abs(y))


def finite(c) -> Column:
    """True for present numbers that are neither NaN nor infinite."""
    x = col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def percent_difference(delta, reference) -> Column:
    return ratio(100.0 * col(delta), reference)


def haversine_km(lat1, lon1, lat2, lon2, radius_km: float = 6371.0) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    a = (F.pow(F.sin((p2 - p1) / 2), 2)
         + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(col(lon2) - col(lon1)) / 2), 2))
    return radius_km * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))
