"""Plan inputs, plan results and the month-by-month series. All narrow: one plan row in, its results out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import finance
from ..functions.num import clamp, half_up, half_up_long, lit
from .shares import share_fraction

SERIES_START = "2025-01-01"


def plan_inputs(goals: DataFrame, pools: DataFrame, idle_users: bool = False) -> DataFrame:
    """Savings and pool pro rated to each goal.

    With ``idle_users``, a user without goals gives one row of empty inputs over one year.
    """
    joined = pools.join(goals, "user_id", "left" if idle_users else "inner")
    return pro_rated(
        joined.withColumns(
            {
                "fraction": F.when(F.col("goal_id").isNotNull(), share_fraction()).otherwise(lit(0)),
                "target_today": F.coalesce("target_today", lit(0)),
                "horizon_years": F.coalesce("horizon_years", lit(1)),
            }
        )
    )


def pro_rated(rows: DataFrame) -> DataFrame:
    part = F.col("fraction")
    return rows.withColumns({"savings": F.col("current_savings") * part, "sip": F.col("monthly_sip") * part})


PLAN_STEPS = [
    {
        "months": finance.MONTHS,
        "monthly": "blended_return / 12D",
        "price_growth": "pow(inflation + 1D, horizon_years)",
    },
    {
        "required_corpus": "target_today * price_growth",
        "lump_value": "savings * pow(monthly + 1D, months)",
        "per_rupee": finance.annuity_due("months"),
        "total_invested": "savings + sip * months",
    },
    {
        "projected_corpus": "lump_value + sip * per_rupee",
        "crossing_month": finance.CROSSING_MONTH,
        "required_sip": "CASE WHEN required_corpus - lump_value <= 0D THEN 0D "
                        "ELSE (required_corpus - lump_value) / per_rupee END",
    },
    {
        "gap": "projected_corpus - required_corpus",
        "on_track": f"projected_corpus >= {finance.ENOUGH}",
        "real_corpus": "projected_corpus / price_growth",
        "goal_reached_month": finance.REACHED_MONTH,
        "progress": "CASE WHEN required_corpus > 0D THEN try_divide(projected_corpus, required_corpus) ELSE 1D END",
    },
]


def in_steps(rows: DataFrame, steps: list[dict[str, str]]) -> DataFrame:
    """Add columns step by step; each step may use the columns of those before it."""
    for step in steps:
        rows = rows.withColumns({name: F.expr(sql) for name, sql in step.items()})
    return rows


def compute_plan(inputs: DataFrame) -> DataFrame:
    """Results of each plan as lazy columns: whatever a query does not select is pruned away.

    Needs target_today, horizon_years, savings, sip, inflation, blended_return.
    """
    return in_steps(inputs, PLAN_STEPS).drop("price_growth", "lump_value", "per_rupee", "crossing_month")


def progress_pct(plans: DataFrame) -> DataFrame:
    capped = clamp(F.col("progress"), 0, 1)
    return plans.withColumns({"progress_capped": capped, "progress_pct": half_up_long(capped * lit(100))})


def projection_series(inputs: DataFrame) -> DataFrame:
    """One row per plan and month, 0 to the end. The value is a closed form of the month, so rows are independent."""
    rows = inputs.withColumns(
        {"monthly": F.expr("blended_return / 12D"), "month": F.expr(f"explode(sequence(0, {finance.MONTHS}))")}
    )
    series = {"year": "month / 12D", "invested": "savings + sip * month", "value": finance.value_at("month")}
    return in_steps(rows, [series]).drop("monthly")


def plan_cash_flows(plans: DataFrame) -> DataFrame:
    """Dated flows of each plan: first payment with the savings, monthly payments, the corpus at the end."""
    month, months = F.col("month"), F.col("months")
    amount = (
        F.when(month == months, F.col("projected_corpus"))
        .when(month == 0, -(F.col("savings") + F.col("sip")))
        .otherwise(-F.col("sip"))
    )
    return plans.withColumn("month", F.explode(F.sequence(F.lit(0), months))).withColumns(
        {"flow_date": F.add_months(F.lit(SERIES_START).cast("date"), month), "amount": amount}
    )


def target_year(goals: DataFrame, base_year: int) -> DataFrame:
    return goals.withColumn("target_year", F.lit(float(base_year)) + F.col("horizon_years"))


def clamp_goal_edits(edits: DataFrame, target: Column, tenure: Column) -> DataFrame:
    """Whole non-negative target, whole tenure of at least a year; a tenure edit confirms the tenure."""
    return edits.withColumns(
        {
            "new_target": F.greatest(lit(0), half_up(target)),
            "new_tenure": F.greatest(lit(1), half_up(tenure)),
            "confirmed": tenure.isNotNull(),
        }
    )


def unconfirmed_goals(goals: DataFrame) -> DataFrame:
    return goals.groupBy("user_id").agg(F.count_if(~F.col("tenure_confirmed")).alias("unconfirmed"))
