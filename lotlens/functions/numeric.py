"""Rounding and interval arithmetic as Columns (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c) -> Column:
    """A column name, a Column or a plain number as a Column."""
    return F.col(c) if isinstance(c, str) else (c if isinstance(c, Column) else F.lit(c))


def half_up(x) -> Column:
    """Round half towards plus infinity, as a bigint: floor(x + 0.5)."""
    return F.floor(num(x) + F.lit(0.5))


def round_half_up(x, digits: int) -> Column:
    scale = float(10**digits)
    return half_up(num(x) * scale) / scale


def percent(share) -> Column:
    """A 0..1 share as a percentage with two decimals."""
    return round_half_up(num(share) * 100.0, 2)


def clamp(x, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), num(x)))


def wilson(k, n, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score bounds in 0..1; (0, 1) when there is nothing to count. n may be fractional."""
    k, n = num(k).cast("double"), num(n).cast("double")
    p = k / n
    denom = F.lit(1.0) + F.lit(z * z) / n
    centre = p + F.lit(z * z) / (n * 2.0)
    margin = F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z * z) / (n * n * 4.0)) * z
    lo = F.greatest(F.lit(0.0), (centre - margin) / denom)
    hi = F.least(F.lit(1.0), (centre + margin) / denom)
    return F.when(n > 0, lo).otherwise(F.lit(0.0)), F.when(n > 0, hi).otherwise(F.lit(1.0))


def wilson_percent(k, n, deff=1.0, z: float = Z95) -> tuple[Column, Column]:
    """Wilson bounds in percent after dividing both counts by a design effect; k is clamped to [0, n]."""
    d = num(deff).cast("double")
    nn = num(n).cast("double") / d
    kk = F.greatest(F.lit(0.0), F.least(num(k).cast("double") / d, nn))
    lo, hi = wilson(kk, nn, z)
    return lo * 100.0, hi * 100.0


def cluster_deff(m, n, x, xx, xn, nn) -> Column:
    """Design effect of a ratio from cluster moments (sums of x*x, x*n, n*n), limited to [1, n/m]."""
    m, n, x = num(m).cast("double"), num(n).cast("double"), num(x).cast("double")
    p = x / n
    ss = num(xx) - p * 2.0 * num(xn) + p * p * num(nn)
    ratio = (m / (m - 1.0)) * ss / (n * n) / (p * (F.lit(1.0) - p) / n)
    usable = (m >= 2) & (n > 0) & (p > 0) & (p < 1)
    return F.when(usable, F.greatest(F.lit(1.0), F.least(ratio, n / m))).otherwise(F.lit(1.0))
