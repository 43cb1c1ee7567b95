"""Whole jobs: from goals or raw answers to plan results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.num import lit
from ..operators import portfolio, profile, projection, shares
from ..sources import catalog


def preset_metrics(spark: SparkSession) -> DataFrame:
    """Blended figures of the three presets. Made from fifteen fixed rows, hence safe to broadcast."""
    return portfolio.basket_metrics(catalog.presets(spark), catalog.funds(spark), "profile")


def with_preset(spark: SparkSession, goals: DataFrame) -> DataFrame:
    """Each goal with the preset its horizon asks for and that preset's figures."""
    if "profile" not in goals.columns:
        goals = goals.withColumn("profile", profile.preset_for(F.col("horizon_years")))
    return goals.join(F.broadcast(preset_metrics(spark)), "profile")


def goal_plans(spark: SparkSession, goals: DataFrame, pools: DataFrame) -> DataFrame:
    """Plan results of every goal under its share of the pool: one shuffle of goals and pools by user."""
    return projection.compute_plan(with_preset(spark, projection.plan_inputs(goals, pools)))


def needs(spark: SparkSession, goals: DataFrame, pools: DataFrame) -> DataFrame:
    return shares.with_need(with_preset(spark, goals.join(pools, "user_id")))


def _split_and_plan(spark: SparkSession, goals: DataFrame) -> DataFrame:
    ranked = shares.tenure_rank(shares.with_need(with_preset(spark, goals)))
    # Served in tenure order, on the columns the rank was made from, so that one sort per user does for both.
    split = shares.recommend_shares(ranked, "horizon_years").withColumn("fraction", F.col("share") / lit(100))
    return projection.compute_plan(projection.pro_rated(split))


def _money(profiles: DataFrame) -> DataFrame:
    return profiles.withColumns(
        {
            "monthly_sip": profile.sip_guess(),
            "current_savings": F.col("existing_savings"),
            "inflation": lit(catalog.DEFAULT_INFLATION),
        }
    )


MONEY = ("monthly_sip", "current_savings", "inflation")


def onboard(spark: SparkSession, answers: DataFrame, selected: DataFrame) -> DataFrame:
    """Raw answers and picks to plans, all keyed by user, so the whole chain stays on one partitioning."""
    profiles = _money(profile.pivot_answers(answers))
    goals = profile.build_plan_goals(
        profiles, selected, catalog.goal_templates(spark), catalog.city_multipliers(spark), MONEY
    )
    return _split_and_plan(spark, goals)


def demo(spark: SparkSession, profiles: DataFrame) -> DataFrame:
    """The demo's three goals for every given profile: the first over a fixed horizon, all of them confirmed."""
    picked = _money(profiles).select(
        "user_id",
        "city_tier",
        *MONEY,
        lit(catalog.DEMO_FIRST_HORIZON).alias("timeline_years"),
        F.posexplode(F.array(*[F.lit(g) for g in catalog.DEMO_GOALS])).alias("ord", "goal_id"),
    )
    goals = profile.goals_from_picks(picked, catalog.goal_templates(spark), catalog.city_multipliers(spark), MONEY)
    return _split_and_plan(spark, goals.withColumn("tenure_confirmed", F.lit(True)))
