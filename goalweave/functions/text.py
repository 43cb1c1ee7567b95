"""Rupee, percent and duration text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .num import DASH, half_up_long, is_finite

RUPEE = "₹"

# The characters that count as blank at either end of a text.
BLANKS = (
    "\t\n\u000b\u000c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Splitting constant of the exact product: 2**27 + 1.
SPLIT = 134217729.0


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def indian_groups(n: Column) -> Column:
    """12,34,567 grouping of a non-negative whole number."""
    return F.regexp_replace(n.cast("string"), r"(\d)(?=(\d\d)+\d$)", "$1,")


def _two_decimals_trimmed(x: Column) -> Column:
    """Nearest hundredth as text without trailing zeros."""
    hundredths = half_up_long(x * F.lit(100.0)).cast("decimal(20,0)")
    digits = (hundredths * F.lit("0.01").cast("decimal(3,2)")).cast("string")
    return F.rtrim(F.rtrim(digits, F.lit("0")), F.lit("."))


def format_inr(x: Column) -> Column:
    """Compact rupees: crore, lakh, grouped thousands, plain below a thousand."""
    size = F.abs(x)
    body = (
        F.when(size >= 1e7, F.concat(_two_decimals_trimmed(size / F.lit(1e7)), F.lit(" Cr")))
        .when(size >= 1e5, F.concat(_two_decimals_trimmed(size / F.lit(1e5)), F.lit(" L")))
        .when(size >= 1e3, indian_groups(half_up_long(size)))
        .otherwise(half_up_long(size).cast("string"))
    )
    return F.when(~is_finite(x), F.lit(DASH)).otherwise(F.concat(_sign(x), F.lit(RUPEE), body))


def format_inr_full(x: Column) -> Column:
    text = F.concat(_sign(x), F.lit(RUPEE), indian_groups(half_up_long(F.abs(x))))
    return F.when(~is_finite(x), F.lit(DASH)).otherwise(text)


def _sign(x: Column) -> Column:
    return F.when(x < 0, F.lit("-")).otherwise(F.lit(""))


def _nearest_tenth(v: Column) -> Column:
    """Whole tenths nearest to the exact binary value of ``v``, as a double.

    The double product ``v * 10`` is off by less than its spacing, so it misleads only when it lands exactly between
    two whole numbers. There, and only there, the lost part of the product decides.
    """
    product = v * F.lit(10.0)
    base = F.floor(product).cast("double")
    rest = product - base
    spread = v * F.lit(SPLIT)
    high = spread - (spread - v)
    lost = (high * F.lit(10.0) - product) + (v - high) * F.lit(10.0)
    up = (rest > 0.5) | ((rest == 0.5) & (lost >= 0))
    return base + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))


def format_pct(fraction: Column, digits: int = 1) -> Column:
    """Percent text with 0 or 1 decimals, rounded on the exact binary value."""
    size = F.abs(fraction * F.lit(100.0))
    if digits == 0:
        body = half_up_long(size).cast("string")
    elif digits == 1:
        body = (_nearest_tenth(size).cast("decimal(20,0)") * F.lit("0.1").cast("decimal(2,1)")).cast("string")
    else:
        raise ValueError("only 0 or 1 digits are used")
    text = F.concat(_sign(fraction), body, F.lit("%"))
    return F.when(~is_finite(fraction), F.lit(DASH)).otherwise(text)


def format_years(years: Column) -> Column:
    whole = F.floor(years).cast("bigint")
    months = half_up_long((years - whole) * F.lit(12.0))
    full = F.when(months == 12, whole + 1).otherwise(whole)
    plural = F.when(full > 1, F.lit("s")).otherwise(F.lit(""))
    return (
        F.when(~is_finite(years), F.lit(DASH))
        .when(years <= 0, F.lit("now"))
        .when(years < 1, F.concat(half_up_long(years * F.lit(12.0)).cast("string"), F.lit(" mo")))
        .when(months.isin(0, 12), F.concat(full.cast("string"), F.lit(" yr"), plural))
        .otherwise(F.concat(whole.cast("string"), F.lit("y "), months.cast("string"), F.lit("m")))
    )
