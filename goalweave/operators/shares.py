"""Splitting a monthly pool over goals, and the goal set and priority order behind it.

Rows are planned goals, one per (user_id, goal_id). Goal ids come from a catalogue of ten, which bounds every window
over a user. Where an input is a log that a single user may fill (picks, edits), it is aggregated first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import finance
from ..functions.num import clamp, half_up_long, lit


def by_user():
    return W.partitionBy("user_id")

MAX_PICKS = 3


def share_fraction() -> Column:
    """Part of the pool a goal gets; goals without a share fall back to an even split."""
    return F.coalesce(F.col("share") / lit(100), lit(1) / F.count(F.lit(1)).over(by_user()))


def goal_monthly(rows: DataFrame) -> DataFrame:
    """Monthly money per goal; needs share and monthly_sip."""
    return (
        rows.withColumn("fraction", share_fraction())
        .withColumn("monthly", F.col("monthly_sip") * F.col("fraction"))
        .withColumn(
            "share_pct",
            F.when(
                F.col("monthly_sip") > 0,
                half_up_long(F.try_divide(F.col("monthly"), F.col("monthly_sip")) * lit(100)),
            ).otherwise(F.lit(0).cast("bigint")),
        )
    )


def with_need(rows: DataFrame) -> DataFrame:
    """Monthly amount each goal needs when starting from nothing."""
    corpus = "target_today * pow(inflation + 1D, horizon_years)"
    per_rupee = finance.annuity_due(finance.MONTHS, "(blended_return / 12D)")
    return rows.withColumn("need", F.expr(f"CASE WHEN {corpus} <= 0D THEN 0D ELSE {corpus} / ({per_rupee}) END"))


def tenure_rank(goals: DataFrame) -> DataFrame:
    return goals.withColumn("priority", F.row_number().over(by_user().orderBy(F.col("horizon_years").asc_nulls_last(), "ord")))


def with_marks(goals: DataFrame, *listed: str, **marks: DataFrame) -> DataFrame:
    """Left-join values kept per (user_id, goal_id): each table in ``marks`` has a column of its keyword's name and,
    like the goals, one row per (user_id, goal_id); logs are folded to that before they come here.

    All rows are unioned and shuffled once, by user alone. The look-up by (user, goal) and every later window by user
    then run on that one partitioning, where a join on both columns would shuffle by both and again by user. Rows of
    ``marks`` without a goal fall away; for each name in ``listed`` a column ``has_<name>`` says whether the user has any
    row of that table, with a goal or without.
    """
    rows = goals.withColumn("is_goal", F.lit(True))
    for name, table in marks.items():
        rows = rows.unionByName(table.select("user_id", "goal_id", name), allowMissingColumns=True)
    same_goal = W.partitionBy("user_id", "goal_id")
    found = {name: F.max(name).over(same_goal) for name in marks}
    found |= {f"has_{name}": F.max(F.col(name)).over(by_user()).isNotNull() for name in listed}
    return rows.repartition("user_id").withColumns(found).where("is_goal").drop("is_goal")


def in_stated_order(goals: DataFrame, order: DataFrame) -> DataFrame:
    """Goals with ``priority``: their rank in the user's order, null outside it, and as declared for users without one."""
    rows = with_marks(goals, "priority", priority=order.withColumnRenamed("rank", "priority"))
    return rows.withColumn("priority", F.when(F.col("has_priority"), F.col("priority")).otherwise(F.col("ord"))).drop("has_priority")


def goals_by_priority(goals: DataFrame, order: DataFrame) -> DataFrame:
    """Listed goals by rank, then the rest as declared; listed ids without a goal fall away."""
    return ranked(with_marks(goals, rank=order))


def ranked(goals: DataFrame) -> DataFrame:
    place = F.row_number().over(by_user().orderBy(F.col("rank").asc_nulls_last(), "ord"))
    return goals.withColumn("priority", place)


def priority_order_valid(order: DataFrame, goals: DataFrame) -> DataFrame:
    return order.join(goals.select("user_id", "goal_id"), ["user_id", "goal_id"], "left_semi")


def _left_for(need: Column, pool: Column, place: str) -> Column:
    """What a goal gets when those ahead of it are served first: all it needs, or what is left."""
    ahead = F.sum(need).over(by_user().orderBy(F.col(place).asc_nulls_last(), "ord").rowsBetween(W.unboundedPreceding, -1))
    return F.greatest(lit(0), F.least(need, pool - F.coalesce(ahead, lit(0))))


def sip_waterfall(rows: DataFrame, place: str = "priority") -> DataFrame:
    """Money given to each goal in order; goals outside the order (null place) get nothing."""
    given = _left_for(F.col("need"), F.col("monthly_sip"), place)
    return rows.withColumn("given", F.when(F.col(place).isNull(), lit(0)).otherwise(given))


def recommend_shares(rows: DataFrame, place: str = "priority") -> DataFrame:
    """Percent of the pool per goal: even, pro rata to need, or in order until the pool runs out."""
    pool, need = F.col("monthly_sip"), F.col("need")
    total = F.sum("need").over(by_user())
    even = lit(100) / F.count(F.lit(1)).over(by_user())
    share = (
        F.when((pool <= 0) | (total <= 0), even)
        .when(pool >= total, F.try_divide(need, total) * lit(100))
        .otherwise(F.try_divide(F.col("given"), pool) * lit(100))
    )
    return sip_waterfall(rows, place).withColumn("share", share)


def set_goal_amount(rows: DataFrame) -> DataFrame:
    """Give goal ``edit_goal`` an amount of the pool and rescale the other shares; rows without an edit stay."""
    pool, share = F.col("monthly_sip"), F.coalesce(F.col("share"), lit(0))
    mine = F.col("goal_id") == F.col("edit_goal")
    n = F.count(F.lit(1)).over(by_user())
    others = F.sum(F.when(mine, lit(0)).otherwise(share)).over(by_user())
    fixed = clamp(F.try_divide(F.col("edit_amount"), pool) * lit(100), 0, 100)
    rest = lit(100) - fixed
    spread = F.when(others > 0, F.try_divide(share, others) * rest).otherwise(F.try_divide(rest, n - 1))
    new = F.when(n == 1, lit(100)).when(mine, fixed).otherwise(spread)
    return rows.withColumn("share", F.when((pool <= 0) | F.col("edit_goal").isNull(), F.col("share")).otherwise(new))


def remove_goal_shares(rows: DataFrame, removed: Column) -> DataFrame:
    """Shares after dropping goals: what is left rescaled to 100, even when nothing positive is left.

    A goal that had no share of its own keeps none as long as the others still carry some.
    """
    left = rows.where(~removed)
    share = F.col("share")
    total = F.sum(F.when(share > 0, share).otherwise(lit(0))).over(by_user())
    kept = F.when(share.isNull(), F.lit(None)).when(share > 0, F.try_divide(share, total) * lit(100)).otherwise(lit(0))
    return left.withColumn("share", F.when(total > 0, kept).otherwise(lit(100) / F.count(F.lit(1)).over(by_user())))


def first_picks(picks: DataFrame) -> DataFrame:
    """At most three goals per user, by first pick. The log is folded to one row per goal before it is ranked."""
    first = picks.groupBy("user_id", "goal_id").agg(F.min("pick_no").alias("pick_no"))
    return first.withColumn("place", F.row_number().over(by_user().orderBy("pick_no"))).where(F.col("place") <= MAX_PICKS)


def add_goals(goals: DataFrame, new_goals: DataFrame, order: DataFrame, custom: Column) -> DataFrame:
    """Goal set after adding one goal per user where it is not there yet; ``is_new`` marks added rows.

    Priority afterwards: where nothing was added the order stays as it was; a hand-made order (``custom``) gets the new goal
    last, any other is sorted by tenure again. Goals that an order does not list stay outside it (null priority).
    """
    both = goals.withColumn("is_new", F.lit(False)).unionByName(new_goals.withColumn("is_new", F.lit(True)), True)
    rows = with_marks(both, rank=order)
    there = F.min(F.col("is_new")).over(W.partitionBy("user_id", "goal_id"))
    rows = rows.withColumn("there", there).where(F.col("is_new") == F.col("there")).drop("there")
    ord_ = F.when(F.col("is_new"), F.count(F.lit(1)).over(by_user()) - 1).otherwise(F.col("ord"))
    by_hand = F.when(F.col("is_new"), F.coalesce(F.max("rank").over(by_user()), F.lit(0)) + 1).otherwise(F.col("rank"))
    by_tenure = F.row_number().over(by_user().orderBy(F.col("horizon_years").asc_nulls_last(), "ord"))
    grew = F.max("is_new").over(by_user())
    place = F.when(~grew, F.col("rank")).when(custom, by_hand).otherwise(by_tenure)
    return rows.withColumns({"priority": place, "ord": ord_}).drop("rank")


def edit_goals(goals: DataFrame, edits: DataFrame, order: DataFrame, custom: Column) -> DataFrame:
    """Goals after target and tenure edits: ``edits`` has at most one row per goal, null fields keep the old value.

    A new tenure confirms the goal and, unless the order is hand-made, sorts the goals by tenure again; a new target alone
    leaves the order. Shares stay.
    """
    rows = with_marks(goals, rank=order, new_target=edits, new_tenure=edits)
    edited = rows.withColumns(
        {
            "target_today": F.coalesce("new_target", "target_today"),
            "horizon_years": F.coalesce("new_tenure", "horizon_years"),
            "tenure_confirmed": F.col("tenure_confirmed") | F.col("new_tenure").isNotNull(),
        }
    )
    by_tenure = F.row_number().over(by_user().orderBy(F.col("horizon_years").asc_nulls_last(), "ord"))
    by_hand = F.row_number().over(by_user().orderBy(F.col("rank").asc_nulls_last(), "ord"))
    retimed = F.max(F.col("new_tenure").isNotNull()).over(by_user())
    return edited.withColumn("priority", F.when(custom | ~retimed, by_hand).otherwise(by_tenure))


def remove_goals(goals: DataFrame, removals: DataFrame, order: DataFrame) -> DataFrame:
    """Goal set and priority after removals; when the current goal went, the first one left becomes current."""
    marked = with_marks(goals, rank=order, removed=removals.withColumn("removed", F.lit(True)))
    left = marked.where(F.col("removed").isNull())
    has_current = F.max(F.col("is_current")).over(by_user())
    first = F.col("ord") == F.min("ord").over(by_user())
    return ranked(left).withColumn("is_current", F.when(has_current, F.col("is_current")).otherwise(first))


def stated_order(goals: DataFrame, order: DataFrame) -> DataFrame:
    """Each user's priority list as stored, or the declared goals for users who have none; places from 0.

    ``current_goal`` is the user's current goal. One shuffle, by user.
    """
    declared = goals.select(
        "user_id", "goal_id", F.col("ord").alias("rank"), F.when(F.col("is_current"), F.col("goal_id")).alias("current_goal")
    )
    rows = declared.withColumn("listed", F.lit(False)).unionByName(
        order.select("user_id", "goal_id", "rank").withColumn("listed", F.lit(True)), allowMissingColumns=True
    )
    has_list = F.max("listed").over(by_user())
    current = F.max("current_goal").over(by_user())
    rows = rows.withColumns({"has_list": has_list, "current_goal": current}).where("listed = has_list")
    places = rows.withColumn("place", F.row_number().over(by_user().orderBy("rank")) - 1)
    return places.select("user_id", "goal_id", "current_goal", "place")


def _place_of(goal: Column) -> Column:
    return F.max(F.when(F.col("goal_id") == goal, F.col("place"))).over(by_user())


def move_neighbour(goal: Column, step: Column) -> Column:
    """Place of each row after a goal swaps with its neighbour; at either end, or for an unlisted goal, nothing moves."""
    at, to, place = _place_of(goal), _place_of(goal) + step, F.col("place")
    inside = at.isNotNull() & (to >= 0) & (to < F.count(F.lit(1)).over(by_user()))
    swapped = F.when(place == at, to).when(place == to, at).otherwise(place)
    return F.when(inside, swapped).otherwise(place)


def drag_goal(dragged: Column, target: Column) -> Column:
    """Place of each row after a goal is taken out and put back where the target was before it was taken out."""
    at, to, place = _place_of(dragged), _place_of(target), F.col("place")
    closed = place - F.when(place > at, 1).otherwise(0)
    opened = closed + F.when(closed >= to, 1).otherwise(0)
    moved = F.when(place == at, to).otherwise(opened)
    known = at.isNotNull() & to.isNotNull() & (at != to)
    return F.when(known, moved).otherwise(place)


def patch_current_goal(goals: DataFrame, patches: DataFrame, fields: list[str]) -> DataFrame:
    """Overwrite the given fields of each user's current goal; ``patches`` has one row per user, null = keep."""
    renamed = patches.select("user_id", *[F.col(f).alias(f"new_{f}") for f in fields])
    joined = goals.join(renamed, "user_id", "left")
    patched = {f: F.when(F.col("is_current"), F.coalesce(f"new_{f}", f)).otherwise(F.col(f)) for f in fields}
    return joined.withColumns(patched).drop(*[f"new_{f}" for f in fields])


def fund_monthly_amounts(rows: DataFrame, presets: DataFrame) -> DataFrame:
    """Monthly money per fund of each goal's preset; needs profile and monthly."""
    total = presets.groupBy("profile").agg(F.sum("weight").alias("preset_total"))
    parts = presets.join(F.broadcast(total), "profile")
    part = F.col("weight") / F.col("preset_total")
    return rows.join(F.broadcast(parts), "profile").withColumns(
        {"amount": F.col("monthly") * part, "pct": half_up_long(part * lit(100))}
    )


def resplit_after_add(rows: DataFrame) -> DataFrame:
    """New split for users whose goal set grew; the others keep their shares."""
    grew = F.max(F.col("is_new")).over(by_user())
    split = recommend_shares(rows.withColumn("old_share", F.col("share")))
    return split.withColumn("share", F.when(grew, F.col("share")).otherwise(F.col("old_share")))
