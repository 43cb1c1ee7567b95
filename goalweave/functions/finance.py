"""Closed forms of monthly compounding, as SQL expressions over named columns.

Contributions go in at the start of each month. SQL text keeps the formulas readable and costs one call to the JVM
per expression; callers build on earlier results as columns, so that Catalyst computes each of them once.
"""

from __future__ import annotations

MONTHS = "cast(greatest(1D, floor(horizon_years * 12D + 0.5D)) AS int)"


def annuity_due(months: str, monthly: str = "monthly") -> str:
    """Value after ``months`` of one rupee a month; ``months`` itself at rate 0."""
    growth = f"({monthly} + 1D)"
    return (
        f"CASE WHEN {monthly} = 0D THEN cast({months} AS double) "
        f"ELSE try_divide(pow({growth}, {months}) - 1D, {monthly}) * {growth} END"
    )


def value_at(months: str, monthly: str = "monthly") -> str:
    """Value of savings and monthly sip after some months."""
    return f"(savings * pow({monthly} + 1D, {months}) + sip * ({annuity_due(months, monthly)}))"


# The value is (savings + a) * g^m - a with a = sip * g / (g - 1), so over the months it only rises or only falls, and
# the crossing can be solved for. The result is a guess: rounding may put it one month off.
CROSSING = """
    CASE WHEN monthly = 0D THEN try_divide(required_corpus - savings, sip)
      ELSE ln(nullif(greatest(0D, try_divide(required_corpus * monthly + sip * (monthly + 1D),
                                              savings * monthly + sip * (monthly + 1D))), 0D)) / ln(monthly + 1D) END"""

CROSSING_MONTH = f"cast(ceil(least(greatest({CROSSING}, -1D), months + 2D)) AS int)"


# A goal that is given just what it needs has its corpus but for the last bits of a few products and powers. Twelve digits
# decide, as with ratios, or those bits would call it missed.
ENOUGH = f"(required_corpus * {1 - 1e-12!r}D)"


def _hit(month: str) -> str:
    return f"WHEN {month} BETWEEN 1 AND months AND {value_at(month)} >= {ENOUGH} THEN {month}"


# The guess and its neighbours are tested against the value itself, so no list of months is built.
REACHED_MONTH = f"""
    CASE WHEN savings >= {ENOUGH} THEN 0 {_hit("(crossing_month - 1)")} {_hit("crossing_month")}
      {_hit("(crossing_month + 1)")} END"""
