"""Rounding rules that decide identity keys and exported digits, as plain column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1, splits a double into two halves whose products are exact


def fixed_units(x: Column, digits: int) -> Column:
    """``x`` to ``digits`` decimals as a bigint of units, ties decided on the exact binary value.

    The product ``x * 10**digits`` rounds, so its rounding error is recovered with a
    two-part product and added back before the comparison with one half.
    """
    k = float(10**digits)
    a = F.abs(x)
    p = a * k
    c = a * _SPLIT
    hi = c - (c - a)
    lo = a - hi
    err = (hi * k - p) + lo * k
    n = F.floor(p)
    units = n + (((p - n - 0.5) + err) >= 0).cast("bigint")
    return F.when(x < 0, -units).otherwise(units)


def fixed_text(x: Column, digits: int) -> Column:
    """The decimal text of :func:`fixed_units` ("1.00", "12.345")."""
    u = fixed_units(x, digits)
    scale = 10**digits
    sign = F.when(u < 0, F.lit("-")).otherwise(F.lit(""))
    whole = F.floor(F.abs(u) / F.lit(scale)).cast("string")
    frac = F.lpad((F.abs(u) % scale).cast("string"), digits, "0")
    return F.concat(sign, whole, F.lit("."), frac)


def half_up(x: Column) -> Column:
    """Nearest integer, halves toward plus infinity."""
    return F.floor(x + 0.5)


def half_up_digits(x: Column, digits: int) -> Column:
    k = float(10**digits)
    return half_up(x * k) / k


def clamp(x: Column, lo, hi) -> Column:
    """Bound ``x``; a null stays null (``greatest``/``least`` alone would skip it)."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(lo, F.least(hi, x)))


def clamp01(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)
