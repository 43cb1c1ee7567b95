"""Profile inference and goal set-up for every user at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import lit, to_step
from ..sources import catalog

DOUBLE_FIELDS = ["rent", "emi", "take_home", "existing_savings"]


def _city(part: int) -> Column:
    """A fixed per-tier figure; an unknown city counts as the default tier."""
    fixed = {tier: row[part] for tier, row in catalog.CITY_TIERS.items()}
    return catalog.lookup(F.col("city_tier"), fixed, fixed[catalog.UNKNOWN_CITY])


def income_guess() -> Column:
    stage = catalog.lookup(F.col("career_stage"), catalog.STAGE_INCOME, catalog.UNKNOWN_STAGE_INCOME)
    work = catalog.lookup(F.col("employment"), catalog.EMPLOYMENT_FACTOR, 1.0)
    return to_step(stage * work * _city(4), 1000)


def rent_guess() -> Column:
    return _city(5)


def surplus() -> Column:
    """Take-home left after rent, loans and living cost; amounts not given count as 0."""
    spent = [F.coalesce(F.col(c), lit(0)) for c in ("rent", "emi")]
    return F.greatest(lit(0), F.coalesce(F.col("take_home"), lit(0)) - spent[0] - spent[1] - _city(3))


def sip_guess() -> Column:
    return F.greatest(lit(1000), to_step(surplus() * lit(catalog.SURPLUS_TO_SIP), 500))


def preset_for(years: Column) -> Column:
    return (
        F.when(years <= catalog.STEADY_MAX_YEARS, "steady")
        .when(years <= catalog.BALANCED_MAX_YEARS, "balanced")
        .otherwise("bold")
    )


def pivot_answers(answers: DataFrame) -> DataFrame:
    """Long answers to one profile row per user, unanswered sliders filled with their seed.

    A conditional aggregate over the listed fields: no distinct pass, and a hot user is combined before the shuffle.
    A choice is carried as its number among the options, because a buffer of plain numbers is what lets Spark
    aggregate by hash instead of sorting the whole log.
    """
    value, field = F.col("value"), F.col("field")
    numbers = {f: F.max(F.when(field == f, value.try_cast("double"))) for f in DOUBLE_FIELDS}
    choices = {
        f: F.max(F.when(field == f, catalog.lookup(value, {o: i for i, o in enumerate(options)}, None)))
        for f, options in catalog.QUESTION_OPTIONS.items()
    }
    wide = answers.groupBy("user_id").agg(*[agg.alias(f) for f, agg in {**numbers, **choices}.items()])
    named = {
        f: F.get(F.array(*[F.lit(o) for o in options]), F.col(f)) for f, options in catalog.QUESTION_OPTIONS.items()
    }
    return seed_sliders(wide.withColumns(named))


def seed_sliders(wide: DataFrame) -> DataFrame:
    seeds = {"rent": rent_guess(), "take_home": income_guess()}
    seeds |= {f: lit(v) for f, v in catalog.SLIDER_SEED.items()}
    return wide.withColumns({f: F.coalesce(F.col(f), seed) for f, seed in seeds.items()})


def adjust_targets(rows: DataFrame, multipliers: DataFrame) -> DataFrame:
    """Template target scaled by city and cost sensitivity, to the nearest thousand."""
    tier = F.coalesce(F.col("city_tier"), F.lit(catalog.UNKNOWN_CITY))
    mult = F.broadcast(multipliers.withColumnRenamed("city_tier", "mult_tier"))
    joined = rows.join(mult, (tier == F.col("mult_tier")) & (rows["cost_sensitivity"] == mult["cost_sensitivity"]))
    return joined.withColumn("target_today", to_step(F.col("template_target") * F.col("mult"), 1000)).drop(
        mult["cost_sensitivity"], "mult_tier", "mult"
    )


def build_plan_goals(
    profiles: DataFrame, selected: DataFrame, templates: DataFrame, multipliers: DataFrame, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Planned goals of every profile; a profile that picked nothing gets the default goal.

    ``selected`` holds (user_id, sel_pos, goal_id) with positions from 0. One left join covers the default, so
    nothing is unioned or scanned twice. ``keep`` names profile columns to carry along.
    """
    years = F.col("timeline").try_cast("double").alias("timeline_years")
    picked = (
        profiles.select("user_id", "city_tier", years, *keep)
        .join(selected, "user_id", "left")
        .withColumns({"goal_id": F.coalesce("goal_id", F.lit(catalog.DEFAULT_GOAL_ID)), "ord": F.coalesce("sel_pos", F.lit(0))})
    )
    goals = goals_from_picks(picked, templates, multipliers, keep)
    return goals.withColumn("tenure_confirmed", (F.col("ord") == 0) & F.col("timed"))


def goals_from_picks(
    picked: DataFrame, templates: DataFrame, multipliers: DataFrame, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Template values for picked goals. The goal at position 0 takes ``timeline_years`` as horizon when given."""
    timed = F.when(F.col("ord") == 0, F.col("timeline_years"))
    horizon = F.coalesce(timed, F.col("template_years"))
    return adjust_targets(picked.join(F.broadcast(templates), "goal_id"), multipliers).select(
        "user_id",
        "ord",
        "goal_id",
        "goal_name",
        "target_today",
        horizon.alias("horizon_years"),
        preset_for(horizon).alias("profile"),
        timed.isNotNull().alias("timed"),
        (F.col("ord") == 0).alias("is_current"),
        *keep,
    )


def remaining_goals(users: DataFrame, picked: DataFrame, goal_ids: list[str]) -> DataFrame:
    """Catalogue goals each user has not planned.

    Picked goals are folded to one bit set per user before the join, so neither a product of users and goals nor a
    list of unbounded length is ever built.
    """
    bit = catalog.lookup(F.col("goal_id"), {g: 1 << i for i, g in enumerate(goal_ids)}, 0)
    bits = picked.groupBy("user_id").agg(F.bit_or(bit).alias("bits"))
    every = F.array(
        *[
            F.struct(F.lit(i).alias("template_ord"), F.lit(g).alias("goal_id"), F.lit(1 << i).alias("bit"))
            for i, g in enumerate(goal_ids)
        ]
    )
    have = F.coalesce(F.col("bits"), F.lit(0))
    open_goals = F.filter(every, lambda g: have.bitwiseAND(g["bit"]) == 0)
    return users.join(bits, "user_id", "left").select("user_id", F.inline(open_goals)).drop("bit")
