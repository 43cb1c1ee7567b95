"""One query per capability over the given tables. Each takes (spark, sf_dir) and returns a DataFrame.

Operators return full doubles; a query publishes money as whole rupees and rates with six decimals, because power
functions and sums differ in the last bit between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.num import lit, positive, published, rupees
from ..operators import basket_log, cashflow, chat, holdings, insights, portfolio, profile, projection, replay, shares, state
from ..sources import catalog
from ..sources import population as pop
from ..sources.tables import read_table
from . import population as jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


BASE_YEAR = 2025
NPV_RATES = [0.05, 0.12, 0.2]
CATEGORIES = ["all", "equity", "debt", "gold", "hybrid"]
PRESET_NAMES = list(catalog.PRESETS)
GOAL_IDS = [g[0] for g in catalog.GOALS]


# ---- catalogues, each with how the population uses it ----------------------------------------------------


@query
def fund_catalog(spark, sf_dir):
    used = pop.baskets(spark, sf_dir).groupBy("fund_id").agg(
        F.count(F.lit(1)).alias("n_baskets"), F.sum(positive(F.col("weight"))).alias("held_weight")
    )
    return catalog.funds(spark).join(used, "fund_id", "left").fillna({"n_baskets": 0, "held_weight": 0.0})


@query
def goal_catalog(spark, sf_dir):
    picked = pop.selected_goals(spark, sf_dir).groupBy("goal_id").agg(F.count(F.lit(1)).alias("n_picked"))
    return catalog.goal_templates(spark).join(picked, "goal_id", "left").fillna({"n_picked": 0})


@query
def model_portfolios(spark, sf_dir):
    presets = catalog.presets(spark)
    total = presets.groupBy("profile").agg(F.sum("weight").alias("preset_total"))
    goals = pop.plan_goals(spark, sf_dir).groupBy(profile.preset_for(F.col("horizon_years")).alias("profile"))
    used = goals.agg(F.count(F.lit(1)).alias("n_goals"))
    return presets.join(F.broadcast(total), "profile").join(used, "profile", "left").fillna({"n_goals": 0})


@query
def holding_type_catalog(spark, sf_dir):
    types = catalog.holding_types(spark)
    known = pop.holdings(spark, sf_dir).join(F.broadcast(types), "type_ord")
    held = known.groupBy("category").agg(F.count(F.lit(1)).alias("n_holdings"))
    return holdings.type_groups(types).join(held, "category", "left").fillna({"n_holdings": 0})


@query
def questionnaire_pivot(spark, sf_dir):
    return profile.pivot_answers(pop.answers(spark, sf_dir))


# ---- profile ---------------------------------------------------------------------------------------------


@query
def fund_search(spark, sf_dir):
    size = (F.col("p_size") % len(CATEGORIES)).cast("int")
    words = read_table(spark, sf_dir, "part").select(
        "p_partkey",
        F.get(F.array(*[F.lit(c) for c in CATEGORIES]), size).alias("search_class"),
        F.posexplode(F.split("p_name", " ")).alias("word_pos", "search_text"),
    )
    return portfolio.search_funds(words, catalog.FUNDS, F.col("search_class"), F.col("search_text"))


@query
def infer_income(spark, sf_dir):
    return pop.profiles(spark, sf_dir).select("user_id", profile.income_guess().alias("income"))


@query
def rent_default(spark, sf_dir):
    return pop.profiles(spark, sf_dir).select("user_id", profile.rent_guess().alias("rent_guess"))


@query
def living_cost_surplus(spark, sf_dir):
    return pop.profiles(spark, sf_dir).select("user_id", profile.surplus().alias("surplus"))


@query
def suggested_sip(spark, sf_dir):
    return pop.profiles(spark, sf_dir).select("user_id", profile.sip_guess().alias("monthly_sip"))


@query
def adjusted_target(spark, sf_dir):
    every = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(g[0]).alias("goal_id"), lit(g[2]).alias("template_target"), F.lit(g[5]).alias("cost_sensitivity")
                )
                for g in catalog.GOALS
            ]
        )
    )
    rows = pop.profiles(spark, sf_dir).select("user_id", "city_tier", every)
    return profile.adjust_targets(rows, catalog.city_multipliers(spark)).select("user_id", "goal_id", "target_today")


@query
def auto_profile(spark, sf_dir):
    years = F.col("horizon_years")
    return pop.plan_goals(spark, sf_dir).select("user_id", "goal_id", years, profile.preset_for(years).alias("profile"))


def _basket_metrics(spark, sf_dir):
    return portfolio.basket_metrics(pop.baskets(spark, sf_dir), catalog.funds(spark), "basket_id")


@query
def risk_label(spark, sf_dir):
    return portfolio.risk_label(_basket_metrics(spark, sf_dir)).select("basket_id", "risk")


@query
def basket_flags(spark, sf_dir):
    return portfolio.equity_heavy(_basket_metrics(spark, sf_dir)).select("basket_id", "equity_heavy")


@query
def lakh_in_ten_years(spark, sf_dir):
    rows = portfolio.lakh_in_ten_years(_basket_metrics(spark, sf_dir))
    return rows.select("basket_id", rupees(F.col("lakh_value")).alias("lakh_value"))


def _shared_pool(spark, sf_dir):
    return pop.goal_shares(spark, sf_dir).join(pop.pools(spark, sf_dir), "user_id")


@query
def goal_monthly(spark, sf_dir):
    rows = shares.goal_monthly(_shared_pool(spark, sf_dir))
    return rows.select(
        "user_id", "goal_id", published(F.col("fraction")).alias("fraction"), rupees(F.col("monthly")).alias("monthly"),
        "share_pct",
    )


@query
def plan_inputs(spark, sf_dir):
    rows = projection.plan_inputs(pop.goal_shares(spark, sf_dir), pop.pools(spark, sf_dir), idle_users=True)
    return rows.select(
        "user_id", "goal_id", "target_today", "horizon_years", rupees(F.col("savings")).alias("savings"),
        rupees(F.col("sip")).alias("sip"), "inflation",
    )


@query
def target_year(spark, sf_dir):
    return projection.target_year(pop.plan_goals(spark, sf_dir), BASE_YEAR).select("user_id", "goal_id", "target_year")


@query
def clamp_goal_edits(spark, sf_dir):
    edits = pop.edits(spark, sf_dir, "set_savings", "set_weight")
    target = F.when(F.col("action") == "set_savings", F.col("value") - lit(200000))
    tenure = F.when(F.col("action") == "set_weight", F.col("value") / lit(10))
    rows = projection.clamp_goal_edits(edits, target, tenure)
    return rows.select(
        "user_id",
        "seq",
        F.when(target.isNotNull(), F.col("new_target")).alias("new_target"),
        F.when(tenure.isNotNull(), F.col("new_tenure")).alias("new_tenure"),
        "confirmed",
    )


@query
def progress_pct(spark, sf_dir):
    rows = projection.progress_pct(_plans(spark, sf_dir))
    return rows.select("user_id", "goal_id", published(F.col("progress_capped")).alias("progress_capped"), "progress_pct")


@query
def holdings_validated(spark, sf_dir):
    rows = holdings.validated(pop.holdings(spark, sf_dir), catalog.holding_types(spark))
    return rows.select("holding_id", "user_id", "category", "type_label", "name", F.col("amount").cast("bigint").alias("amount"))


@query
def patch_current_goal(spark, sf_dir):
    goals = pop.plan_goals(spark, sf_dir).withColumn("profile", profile.preset_for(F.col("horizon_years")))
    edits = pop.edits(spark, sf_dir, "set_savings", "set_weight").withColumn("order_key", state.order_key())
    mood = F.col("weight_edit")
    patches = (
        edits.groupBy("user_id")
        .agg(state.latest("set_savings").alias("target_today"), state.latest("set_weight").alias("weight_edit"))
        .withColumn("profile", F.when(mood < 20, "steady").when(mood < 60, "balanced").when(mood >= 60, "bold"))
    )
    rows = shares.patch_current_goal(goals, patches, ["target_today", "profile"])
    return rows.select("user_id", "goal_id", "is_current", rupees(F.col("target_today")).alias("target_today"), "profile")


# ---- joins -----------------------------------------------------------------------------------------------


@query
def allocation_fund_lookup(spark, sf_dir):
    rows = portfolio.with_funds(pop.baskets(spark, sf_dir), catalog.funds(spark))
    return rows.select("basket_id", "fund_id", "weight", "exp_return", "volatility")


@query
def allocation_composition(spark, sf_dir):
    rows = portfolio.composition(pop.baskets(spark, sf_dir), catalog.funds(spark))
    return rows.select("basket_id", "fund_id", "asset_class", "equity_part", "debt_part", "gold_part")


@query
def remaining_goals(spark, sf_dir):
    users = pop.pools(spark, sf_dir).select("user_id")
    return profile.remaining_goals(users, pop.plan_goals(spark, sf_dir), GOAL_IDS)


@query
def priority_order_valid(spark, sf_dir):
    return shares.priority_order_valid(pop.goal_order(spark, sf_dir), pop.plan_goals(spark, sf_dir))


@query
def holding_type_lookup(spark, sf_dir):
    rows = holdings.with_types(pop.holdings(spark, sf_dir), catalog.holding_types(spark))
    return rows.select("holding_id", "user_id", "type_id", "category", "type_label")


@query
def build_plan_goals(spark, sf_dir):
    rows = profile.build_plan_goals(
        pop.profiles(spark, sf_dir), pop.selected_goals(spark, sf_dir), catalog.goal_templates(spark),
        catalog.city_multipliers(spark),
    )
    return rows.select(
        "user_id", "ord", "goal_id", "target_today", "horizon_years", "profile", "tenure_confirmed", "is_current"
    )


@query
def plan_goal_allocations(spark, sf_dir):
    goals = pop.plan_goals(spark, sf_dir).withColumn("profile", profile.preset_for(F.col("horizon_years")))
    rows = goals.join(F.broadcast(catalog.presets(spark)), "profile")
    return rows.select("user_id", "goal_id", "profile", "pos", "fund_id", "weight")


# ---- aggregates ------------------------------------------------------------------------------------------


@query
def allocation_total(spark, sf_dir):
    return _basket_metrics(spark, sf_dir).select("basket_id", "total")


@query
def blended_return(spark, sf_dir):
    rows = _basket_metrics(spark, sf_dir)
    return rows.select("basket_id", published(F.col("blended_return")).alias("blended_return"))


@query
def blended_volatility(spark, sf_dir):
    rows = _basket_metrics(spark, sf_dir)
    return rows.select("basket_id", published(F.col("blended_volatility")).alias("blended_volatility"))


@query
def band_weights(spark, sf_dir):
    rows = _basket_metrics(spark, sf_dir)
    return rows.select("basket_id", *[published(F.col(b)).alias(b) for b in ("equity", "debt", "gold")])


@query
def growth_weight(spark, sf_dir):
    rows = _basket_metrics(spark, sf_dir)
    return rows.select("basket_id", published(F.col("growth_weight")).alias("growth_weight"))


@query
def band_segments(spark, sf_dir):
    rows = portfolio.band_segments(_basket_metrics(spark, sf_dir), "basket_id")
    return rows.select("basket_id", "band", published(F.col("size")).alias("size"))


@query
def holdings_total(spark, sf_dir):
    rows = holdings.totals(pop.holdings(spark, sf_dir))
    return rows.select("user_id", published(F.col("holdings_total"), 2).alias("holdings_total"))


@query
def savings_reconcile(spark, sf_dir):
    rows = holdings.reconcile(pop.profiles(spark, sf_dir), holdings.totals(pop.holdings(spark, sf_dir)))
    return rows.withColumn("holdings_total", published(F.col("holdings_total"), 2))


@query
def unconfirmed_goals(spark, sf_dir):
    return projection.unconfirmed_goals(pop.plan_goals(spark, sf_dir))


def _needs(spark, sf_dir):
    return jobs.needs(spark, pop.plan_goals(spark, sf_dir), pop.pools(spark, sf_dir))


@query
def total_required_sip(spark, sf_dir):
    rows = _needs(spark, sf_dir).groupBy("user_id").agg(F.sum("need").alias("need"))
    return rows.select("user_id", rupees(F.col("need")).alias("total_need"))


@query
def xnpv(spark, sf_dir):
    rows = cashflow.xnpv(pop.cash_flows(spark, sf_dir), NPV_RATES)
    return rows.select("entity_id", "rate", rupees(F.col("xnpv")).alias("xnpv"))


@query
def xirr(spark, sf_dir):
    rows = cashflow.xirr(pop.cash_flows(spark, sf_dir))
    return rows.select("entity_id", published(F.col("xirr")).alias("xirr"))


# ---- shares of a group, ranks ----------------------------------------------------------------------------


@query
def normalized_weights(spark, sf_dir):
    rows = portfolio.normalized_weights(pop.baskets(spark, sf_dir), "basket_id")
    return rows.select("basket_id", "fund_id", published(F.col("weight")).alias("weight"))


def _ordered_needs(spark, sf_dir):
    goals = shares.in_stated_order(pop.plan_goals(spark, sf_dir), pop.goal_order(spark, sf_dir))
    return jobs.needs(spark, goals, pop.pools(spark, sf_dir))


@query
def sip_waterfall(spark, sf_dir):
    rows = shares.sip_waterfall(_ordered_needs(spark, sf_dir))
    return rows.select("user_id", "goal_id", rupees(F.col("need")).alias("need"), rupees(F.col("given")).alias("given"))


@query
def tenure_rank(spark, sf_dir):
    return shares.tenure_rank(pop.plan_goals(spark, sf_dir)).select("user_id", "goal_id", "priority")


@query
def goals_by_priority(spark, sf_dir):
    rows = shares.goals_by_priority(pop.plan_goals(spark, sf_dir), pop.goal_order(spark, sf_dir))
    return rows.select("user_id", "goal_id", "priority")


@query
def goal_reached_month(spark, sf_dir):
    return _plans(spark, sf_dir).select("user_id", "goal_id", "goal_reached_month")


@query
def top_holding(spark, sf_dir):
    rows = portfolio.top_holding(pop.baskets(spark, sf_dir), "basket_id", [*portfolio.CATALOGUE, pop.UNLISTED])
    return rows.withColumn("top_weight", published(F.col("top_weight")))


@query
def basket_by_class(spark, sf_dir):
    return portfolio.in_class_order(pop.baskets(spark, sf_dir), catalog.funds(spark), "basket_id")


@query
def goal_pick_cap(spark, sf_dir):
    picks = pop.edits(spark, sf_dir).select(
        "user_id",
        F.get(F.array(*[F.lit(g) for g in GOAL_IDS]), F.col("slot") % len(GOAL_IDS)).alias("goal_id"),
        F.col("seq").alias("pick_no"),
    )
    return shares.first_picks(picks)


@query
def insights_first4(spark, sf_dir):
    rows = insights.first_remarks(_plans_with_baskets(spark, sf_dir))
    return rows.select("user_id", "goal_id", "fired", F.array_join("remarks.code", ",").alias("codes"))


# ---- goal and holding sets -------------------------------------------------------------------------------


@query
def goal_set_after_add(spark, sf_dir):
    user = F.col("user_id")
    wanted = F.get(F.array(*[F.lit(g) for g in GOAL_IDS]), (user * 7 % len(GOAL_IDS)).cast("int"))
    picks = pop.profiles(spark, sf_dir).select(
        "user_id", "city_tier", F.lit(None).cast("double").alias("timeline_years"), wanted.alias("goal_id"),
        F.lit(0).alias("ord"),
    )
    new_goals = profile.goals_from_picks(picks, catalog.goal_templates(spark), catalog.city_multipliers(spark))
    new_goals = new_goals.select("user_id", "goal_id", "goal_name", "target_today", "horizon_years").withColumn(
        "tenure_confirmed", F.lit(False)
    )
    goals = pop.goal_shares(spark, sf_dir)
    order = pop.goal_order(spark, sf_dir)
    ranked = shares.add_goals(goals, new_goals, order, user % 3 == 0)
    need = jobs.needs(spark, ranked, pop.pools(spark, sf_dir))
    split = shares.resplit_after_add(need)
    return split.select(
        "user_id", "goal_id", "ord", "is_new", (F.col("goal_id") == wanted).alias("is_current"), "priority",
        published(F.col("share")).alias("share"),
    )


@query
def goal_set_after_edits(spark, sf_dir):
    """The last target and tenure edit of each goal, a log folded to one row per goal before it meets the goals."""
    log = pop.edits(spark, sf_dir, "set_savings", "set_weight").withColumns(
        {"order_key": state.order_key(), "goal_no": F.col("slot") % len(GOAL_IDS)}
    )
    last = log.groupBy("user_id", "goal_no").agg(
        state.latest("set_savings").alias("target"), state.latest("set_weight").alias("tenure")
    )
    goal_id = F.get(F.array(*[F.lit(g) for g in GOAL_IDS]), F.col("goal_no"))
    edits = projection.clamp_goal_edits(last, F.col("target"), F.col("tenure") / lit(10)).select(
        "user_id", goal_id.alias("goal_id"), F.when(F.col("target").isNotNull(), F.col("new_target")).alias("new_target"),
        F.when(F.col("tenure").isNotNull(), F.col("new_tenure")).alias("new_tenure"),
    )
    custom = F.col("user_id") % 3 == 0
    rows = shares.edit_goals(pop.plan_goals(spark, sf_dir), edits, pop.goal_order(spark, sf_dir), custom)
    return rows.select("user_id", "goal_id", "target_today", "horizon_years", "tenure_confirmed", "priority")


def _current_goal(spark, sf_dir):
    return pop.plan_goals(spark, sf_dir).where("is_current").select("user_id", "goal_id")


@query
def goal_set_after_remove(spark, sf_dir):
    goals = pop.plan_goals(spark, sf_dir)
    ordered = shares.remove_goals(goals, _current_goal(spark, sf_dir), pop.goal_order(spark, sf_dir))
    return ordered.select("user_id", "goal_id", "is_current", "priority")


@query
def holdings_after_remove(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem")
    returned = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("holding_id"))
    return holdings.remove(pop.holdings(spark, sf_dir), returned).select("holding_id", "user_id", "type_ord", "amount")


# ---- share and weight edits ------------------------------------------------------------------------------


@query
def recommend_shares(spark, sf_dir):
    rows = shares.recommend_shares(_ordered_needs(spark, sf_dir))
    return rows.select("user_id", "goal_id", published(F.col("share")).alias("share"))


@query
def set_goal_amount(spark, sf_dir):
    edits = pop.edits(spark, sf_dir, "set_sip").withColumn("order_key", state.order_key())
    amounts = edits.groupBy("user_id").agg(state.latest("set_sip").alias("edit_amount"))
    goals = _shared_pool(spark, sf_dir).join(amounts, "user_id", "left")
    edited = F.max(F.when(F.col("is_current") & F.col("edit_amount").isNotNull(), F.col("goal_id"))).over(shares.by_user())
    rows = shares.set_goal_amount(goals.withColumn("edit_goal", edited))
    return rows.select("user_id", "goal_id", published(F.col("share")).alias("share"))


@query
def remove_goal_shares(spark, sf_dir):
    rows = shares.remove_goal_shares(pop.goal_shares(spark, sf_dir), F.col("is_current"))
    return rows.select("user_id", "goal_id", published(F.col("share")).alias("share"))


@query
def normalize_to_100(spark, sf_dir):
    rows = portfolio.normalize_to_100(pop.baskets(spark, sf_dir), "basket_id")
    return rows.select("basket_id", "fund_id", published(F.col("weight")).alias("weight"))


def _edit_fund(factor: int):
    return pop.fund_by_number((F.col("basket_id") * factor % len(catalog.FUNDS)).cast("int"))


def _weights_out(rows):
    return rows.withColumn("weight", published(F.col("weight")))


@query
def add_fund(spark, sf_dir):
    return _weights_out(portfolio.add_fund(pop.baskets(spark, sf_dir), "basket_id", _edit_fund(1)))


@query
def set_fund_weight(spark, sf_dir):
    weight = (F.col("basket_id") * 7 % 121 - 10).cast("double")
    return _weights_out(portfolio.set_fund_weight(pop.baskets(spark, sf_dir), "basket_id", _edit_fund(5), weight))


@query
def remove_fund(spark, sf_dir):
    rows = portfolio.remove_fund(pop.baskets(spark, sf_dir), "basket_id", _edit_fund(1))
    return _weights_out(rows.select("basket_id", "fund_id", "weight"))


@query
def apply_preset(spark, sf_dir):
    presets = portfolio.normalize_to_100(catalog.presets(spark), "profile")
    goals = pop.plan_goals(spark, sf_dir).where("is_current").withColumn("profile", _preset_of_user())
    rows = goals.join(F.broadcast(presets), "profile")
    return _weights_out(rows.select("user_id", "goal_id", "profile", "pos", "fund_id", "weight"))


def _preset_of_user():
    return F.get(F.array(*[F.lit(p) for p in PRESET_NAMES]), (F.col("user_id") % 3).cast("int"))


@query
def replay_edits(spark, sf_dir):
    users = pop.pools(spark, sf_dir).select("user_id")
    baskets = replay.preset_baskets(users, catalog.presets(spark), _preset_of_user())
    sizes = F.array(*[F.lit(len(catalog.PRESETS[p])) for p in PRESET_NAMES])
    size = F.get(sizes, (F.col("user_id") % 3).cast("int"))
    edits = pop.edits(spark, sf_dir, "set_weight").select(
        "user_id", "ts", "seq", (F.col("slot") % size).alias("member"), size.alias("n_members"),
        F.col("value").alias("weight"),
    )
    return _weights_out(replay.replay_weights(edits, baskets).select("user_id", "fund_id", "weight"))


def _preset_weights(name: str):
    """A preset over all funds of the catalogue: null for those it does not hold."""
    weights = dict(catalog.PRESETS[name])
    total = sum(weights.values())
    held = [weights.get(f[0]) for f in catalog.FUNDS]
    return F.array(*[F.lit(None if w is None else w / total * 100).cast("double") for w in held])


BASKET_KINDS = {
    "set_weight": basket_log.WEIGHT, "add_fund": basket_log.ADD, "remove_fund": basket_log.REMOVE, "apply_preset": basket_log.PRESET,
}


@query
def replay_basket_log(spark, sf_dir):
    """Each user's basket after weights set, funds added and removed and presets applied, in the order of the log."""
    def preset(n):
        chosen = F.lit(None).cast("array<double>")
        for k, name in enumerate(PRESET_NAMES):
            chosen = F.when(n == k, _preset_weights(name)).otherwise(chosen)
        return chosen

    kind = catalog.lookup(F.col("action"), BASKET_KINDS, None)
    log = pop.basket_edits(spark, sf_dir).where("slot IS NOT NULL").withColumn("kind", kind)
    edits = log.select(
        "user_id", state.order_key().alias("order_key"), "kind", (F.col("slot") % len(catalog.FUNDS)).alias("fund_no"),
        F.col("value").alias("weight"), F.when(F.col("kind") == basket_log.PRESET, preset(F.col("slot") % 3)).alias("basket"),
    )
    users = pop.profiles(spark, sf_dir).select("user_id", preset(F.col("user_id") % 3).alias("basket"))
    rows = basket_log.replay_baskets(edits, users, len(catalog.FUNDS))
    return rows.select("user_id", pop.fund_by_number(F.col("fund_no")).alias("fund_id"), published(F.col("weight")).alias("weight"))


@query
def replay_goal_amounts(spark, sf_dir):
    """Amount edits in sequence: each fixes one goal's part of the pool and rescales the others, as weights of a basket do."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "goal_id", F.coalesce("share", lit(0)).alias("share"))))
    # One row per goal of a user, at most ten.
    listed = pop.goal_shares(spark, sf_dir).groupBy("user_id").agg(rows.alias("goals"))
    held = listed.select("user_id", F.col("goals.goal_id").alias("fund_ids"), F.col("goals.share").alias("weights"))
    money = held.join(pop.pools(spark, sf_dir), "user_id").where("monthly_sip > 0")
    sizes = money.select("user_id", "monthly_sip", F.size("fund_ids").alias("n_members"))
    edits = pop.edits(spark, sf_dir, "set_sip").join(sizes, "user_id").select(
        "user_id", "ts", "seq", (F.col("slot") % F.col("n_members")).alias("member"), "n_members",
        (F.col("value") / F.col("monthly_sip") * lit(100)).alias("weight"),
    )
    final = replay.replay_weights(edits, held).withColumnRenamed("fund_id", "goal_id")
    return final.select("user_id", "goal_id", published(F.col("weight")).alias("share"))


@query
def replay_goal_toggles(spark, sf_dir):
    toggles = pop.edits(spark, sf_dir).select("user_id", "ts", "seq", (F.col("slot") % len(GOAL_IDS)).alias("goal_no"))
    return replay.replay_picks(toggles, GOAL_IDS)


@query
def reorder_priority(spark, sf_dir):
    places = shares.stated_order(pop.plan_goals(spark, sf_dir), pop.goal_order(spark, sf_dir))
    rows = places.where("current_goal IS NOT NULL").withColumns(
        {
            "place_before": F.col("place"),
            "first_goal": F.max(F.when(F.col("place") == 0, F.col("goal_id"))).over(shares.by_user()),
        }
    )
    step = F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1)
    both = rows.withColumns(
        {
            "move": shares.move_neighbour(F.col("current_goal"), step),
            "drag": shares.drag_goal(F.col("first_goal"), F.col("current_goal")),
        }
    )
    return both.unpivot(["user_id", "goal_id", "place_before"], ["move", "drag"], "op", "place")


@query
def fund_monthly_amounts(spark, sf_dir):
    goals = _shared_pool(spark, sf_dir).withColumn("profile", profile.preset_for(F.col("horizon_years")))
    rows = shares.fund_monthly_amounts(shares.goal_monthly(goals), catalog.presets(spark))
    return rows.select("user_id", "goal_id", "fund_id", rupees(F.col("amount")).alias("amount"), "pct")


# ---- projection ------------------------------------------------------------------------------------------


def _plans(spark, sf_dir):
    return jobs.goal_plans(spark, pop.goal_shares(spark, sf_dir), pop.pools(spark, sf_dir))


@query
def projection_series(spark, sf_dir):
    inputs = projection.plan_inputs(pop.goal_shares(spark, sf_dir), pop.pools(spark, sf_dir))
    rows = projection.projection_series(jobs.with_preset(spark, inputs))
    return rows.select(
        "user_id", "goal_id", "month", published(F.col("year")).alias("year"),
        rupees(F.col("invested")).alias("invested"), rupees(F.col("value")).alias("value"),
    )


@query
def required_corpus(spark, sf_dir):
    return _plans(spark, sf_dir).select("user_id", "goal_id", rupees(F.col("required_corpus")).alias("required_corpus"))


@query
def real_corpus(spark, sf_dir):
    return _plans(spark, sf_dir).select("user_id", "goal_id", rupees(F.col("real_corpus")).alias("real_corpus"))


@query
def required_sip(spark, sf_dir):
    return _plans(spark, sf_dir).select("user_id", "goal_id", rupees(F.col("required_sip")).alias("required_sip"))


@query
def plan_cash_flows(spark, sf_dir):
    rows = projection.plan_cash_flows(_plans(spark, sf_dir))
    return rows.select("user_id", "goal_id", "month", "flow_date", rupees(F.col("amount")).alias("amount"))


MONEY_RESULTS = ["projected_corpus", "required_corpus", "gap", "total_invested", "required_sip", "real_corpus"]
RATE_RESULTS = ["blended_return", "blended_volatility", "progress"]


def _plan_out(rows, *more):
    return rows.select(
        "user_id", "goal_id", "months", *[rupees(F.col(c)).alias(c) for c in MONEY_RESULTS],
        *[published(F.col(c)).alias(c) for c in RATE_RESULTS], "on_track", "goal_reached_month", *more,
    )


@query
def compute_plan(spark, sf_dir):
    return _plan_out(_plans(spark, sf_dir))


@query
def plan_with_holdings(spark, sf_dir):
    """Plans after each user has taken over the total of the holdings as current savings."""
    totals = holdings.totals(pop.holdings(spark, sf_dir))
    pools = holdings.applied_to_savings(pop.pools(spark, sf_dir), totals)
    return _plan_out(jobs.goal_plans(spark, pop.goal_shares(spark, sf_dir), pools))


@query
def plan_xirr(spark, sf_dir):
    rows = cashflow.plan_xirr(_plans(spark, sf_dir), projection.SERIES_START)
    return rows.select("user_id", "goal_id", published(F.col("xirr")).alias("xirr"))


@query
def onboard_population(spark, sf_dir):
    rows = jobs.onboard(spark, pop.answers(spark, sf_dir), pop.selected_goals(spark, sf_dir))
    return _plan_out(rows, "priority", published(F.col("share")).alias("share"), rupees(F.col("monthly_sip")).alias("pool"))


@query
def demo_plan(spark, sf_dir):
    rows = jobs.demo(spark, pop.profiles(spark, sf_dir))
    return _plan_out(rows, "priority", published(F.col("share")).alias("share"), rupees(F.col("monthly_sip")).alias("pool"))


# ---- text ------------------------------------------------------------------------------------------------


def _scaled_prices(spark, sf_dir):
    key = F.col("o_orderkey") % 4
    scale = F.when(key == 0, lit(0.001)).when(key == 1, lit(1)).when(key == 2, lit(100)).otherwise(lit(1000))
    signed = F.when(F.col("o_orderstatus") == "P", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", (signed * scale).alias("amount"))


@query
def format_inr(spark, sf_dir):
    return _scaled_prices(spark, sf_dir).select("o_orderkey", text.format_inr(F.col("amount")).alias("shown"))


@query
def format_inr_full(spark, sf_dir):
    return _scaled_prices(spark, sf_dir).select("o_orderkey", text.format_inr_full(F.col("amount")).alias("shown"))


@query
def format_pct(spark, sf_dir):
    net = F.col("l_discount") - F.col("l_tax")
    price = F.col("l_extendedprice") / lit(1000000)
    return read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        text.format_pct(F.col("l_discount"), 0).alias("discount_0"),
        text.format_pct(net, 1).alias("net_1"),
        text.format_pct(price, 1).alias("price_1"),
        text.format_pct(price, 0).alias("price_0"),
    )


@query
def format_years(spark, sf_dir):
    years = F.datediff("l_shipdate", F.lit("1999-01-01").cast("date")) / lit(365)
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.format_years(years).alias("shown"))


def _plans_with_baskets(spark, sf_dir):
    """Plans whose money goes into a basket of their own instead of a preset; some baskets do not exist."""
    funds = catalog.funds(spark)
    basket_id = F.col("user_id") * 3 + F.col("ord")
    wanted = pop.goal_shares(spark, sf_dir).select(basket_id.alias("basket_id"))
    metrics = portfolio.basket_metrics(pop.baskets(spark, sf_dir, only=wanted), funds, "basket_id", with_top=True)
    names = funds.select(F.col("fund_id").alias("top_fund_id"), F.col("fund_name").alias("top_fund_name"))
    inputs = projection.plan_inputs(pop.goal_shares(spark, sf_dir), pop.pools(spark, sf_dir))
    inputs = inputs.withColumn("basket_id", basket_id)
    joined = inputs.join(metrics, "basket_id", "left").join(F.broadcast(names), "top_fund_id", "left")
    empty = {"total": 0.0, "blended_return": 0.0, "blended_volatility": 0.0, "growth_weight": 0.0, "top_weight": 0.0}
    return projection.compute_plan(joined.fillna(empty))


@query
def plan_insights(spark, sf_dir):
    return insights.plan_insights(_plans_with_baskets(spark, sf_dir), "user_id", "goal_id")


def _summaries(spark, sf_dir):
    entries = chat.preset_entries(catalog.presets(spark), catalog.funds(spark))
    inputs = projection.plan_inputs(pop.goal_shares(spark, sf_dir), pop.pools(spark, sf_dir))
    current = chat.current_with_others(inputs)
    plans = projection.compute_plan(jobs.with_preset(spark, current)).join(F.broadcast(entries), "profile")
    return chat.plan_summary_json(plans)


@query
def plan_summary_json(spark, sf_dir):
    return _summaries(spark, sf_dir)


@query
def chat_message_batch(spark, sf_dir):
    return chat.chat_messages(pop.chat(spark, sf_dir), _summaries(spark, sf_dir))


@query
def chat_message_pages(spark, sf_dir):
    """The same messages as arrays, five turns a page."""
    messages = chat.chat_messages(pop.chat(spark, sf_dir), _summaries(spark, sf_dir))
    return chat.pages_as_json(chat.message_pages(messages, 5))


@query
def chat_turn_filter(spark, sf_dir):
    return chat.chat_turns(pop.chat(spark, sf_dir)).select("conv_id", "turn", "text")


# ---- state from edits (batch twins of the streams) -------------------------------------------------------


@query
def latest_pool_state(spark, sf_dir):
    rows = state.latest_pool_state(pop.edits(spark, sf_dir))
    return rows.withColumn("inflation", published(F.col("inflation")))


@query
def live_holdings_total(spark, sf_dir):
    rows = state.live_holdings_total(pop.edits(spark, sf_dir))
    return rows.withColumn("holdings_total", published(F.col("holdings_total"), 2))


@query
def live_plan(spark, sf_dir):
    users = pop.profiles(spark, sf_dir).select("user_id")
    pools = state.with_defaults(users, state.latest_pool_state(pop.edits(spark, sf_dir)))
    return _plan_out(jobs.goal_plans(spark, pop.goal_shares(spark, sf_dir), pools))
