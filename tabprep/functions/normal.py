"""The standard normal distribution as native expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Acklam's rational approximation of the inverse (relative error 1.15e-9): numerator and denominator of the
# centre, then of the tails, highest power first.
CENTRE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425
# Abramowitz and Stegun 26.2.17 (absolute error 7.5e-8), highest power first.
SHARE = (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530, 0.0)
SHARE_STEP = 0.2316419


def _polynomial(factors: tuple[float, ...], x: Column) -> Column:
    out = F.lit(factors[0])
    for f in factors[1:]:
        out = out * x + F.lit(f)
    return out


def normal_score(p: Column) -> Column:
    """The value below which a standard normal falls with probability p, 0 < p < 1."""
    q = p - 0.5
    centre = q * _polynomial(CENTRE_TOP, q * q) / _polynomial(CENTRE_BOTTOM, q * q)
    t = F.sqrt(F.lit(-2.0) * F.ln(F.least(p, F.lit(1.0) - p)))
    tail = _polynomial(TAIL_TOP, t) / _polynomial(TAIL_BOTTOM, t)
    return F.when(p < TAIL, tail).when(p > 1 - TAIL, -tail).otherwise(centre)


def normal_share(x: Column) -> Column:
    """The probability that a standard normal lies below x."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(SHARE_STEP) * F.abs(x))
    above = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * _polynomial(SHARE, t)
    return F.when(x < 0, above).otherwise(F.lit(1.0) - above)
