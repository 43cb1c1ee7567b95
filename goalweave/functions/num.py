"""Rounding and digit helpers.

All rounding is half toward plus infinity on the double, which is ``floor(x + 0.5)`` and not Spark's ``round``
(half away from zero, on a decimal view of the value).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"

# From here on a double has no digit behind the point, and a floor to BIGINT would come near its bounds.
WHOLE = 2.0**52


def lit(value) -> Column:
    return F.lit(float(value))


def half_up(x: Column) -> Column:
    """Nearest whole number, ties up, as a double of any size."""
    return F.when(F.abs(x) >= F.lit(WHOLE), x).otherwise(F.floor(x + F.lit(0.5)).cast("double"))


def half_up_long(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("bigint")


def to_step(x: Column, step: float) -> Column:
    return half_up(x / F.lit(float(step))) * F.lit(float(step))


def settled(x: Column, digits: int = 12) -> Column:
    """A double cut to ``digits`` decimals; one so large that it has none of them stays as it is.

    Rows are added up in whatever order tasks finish; this keeps the last bits of that order away from comparisons
    with fixed limits.
    """
    scale = float(10**digits)
    cut = F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
    return F.when(F.abs(x) >= F.lit(WHOLE / scale), x).otherwise(cut)


def published(x: Column, digits: int = 6) -> Column:
    """A double cut to ``digits`` decimals for comparison across engines, which agree on its first few more."""
    return settled(settled(x, digits + 4), digits)


def rupees(x: Column) -> Column:
    """Whole rupees as BIGINT, for comparison across engines."""
    return F.floor(settled(x, 4) + F.lit(0.5)).cast("bigint")


def positive(x: Column) -> Column:
    """The value when above zero, else 0 (also for null)."""
    return F.when(x > 0, x).otherwise(F.lit(0.0))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
