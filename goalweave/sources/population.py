"""Domain-shaped tables derived by Spark from the given Parquet tables.

Rules are plain arithmetic so that another engine can build the same rows. Most are narrow (one input row gives a
few output rows); baskets and cash flows aggregate with map-side combining, so a hot order or customer is reduced
before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.num import lit
from . import catalog
from .tables import read_table

PROFILE_FIELDS = ["city_tier", "employment", "career_stage", "rent", "emi", "take_home", "existing_savings", "timeline"]


def _pick(n: Column, values: list, default=None) -> Column:
    expr = None
    for i, value in enumerate(values):
        expr = (F if expr is None else expr).when(n == i, F.lit(value))
    return expr.otherwise(F.lit(default))


def _savings(acctbal: Column) -> Column:
    return (F.floor(F.greatest(acctbal, lit(0)) * lit(200) / lit(25000)) * 25000).cast("double")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customer = read_table(spark, sf_dir, "customer")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("user_id"),
        _pick(F.col("n_regionkey"), ["metro", "tier1", "tier2", "tier3"]).alias("city_tier"),
        catalog.lookup(
            F.col("c_mktsegment"),
            {"AUTOMOBILE": "salaried", "BUILDING": "self_employed", "FURNITURE": "freelancer", "HOUSEHOLD": "student"},
            None,
        ).alias("employment"),
        _pick(key % 4, ["starting", "growing", "stable"]).alias("career_stage"),
        F.when(key % 5 != 4, (key * 7 % 121 * 1000).cast("double")).alias("rent"),
        (key * 11 % 61 * 1000).cast("double").alias("emi"),
        F.when(
            key % 6 != 5, (F.floor(F.abs("c_acctbal") * lit(20) / lit(1000)) * 1000 + 15000).cast("double")
        ).alias("take_home"),
        _savings(F.col("c_acctbal")).alias("existing_savings"),
        F.when(key % 5 != 0, _pick(key % 4, ["2", "4", "8", "14"])).alias("timeline"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per answered question: user_id, field, value."""
    pairs = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in PROFILE_FIELDS]
    )
    return profiles(spark, sf_dir).select("user_id", F.inline(pairs)).where(F.col("value").isNotNull())


def _goal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, ord_ = F.col("c_custkey"), F.col("ord")
    picks = (
        read_table(spark, sf_dir, "customer")
        .select("c_custkey", (key % 4).cast("int").alias("n"))
        .where("n > 0")
        .select("c_custkey", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ord"))
        .withColumn("template_ord", ((key + ord_ * 3) % 10).cast("int"))
    )
    return picks.join(F.broadcast(catalog.goal_templates(spark)), "template_ord")


def selected_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _goal_rows(spark, sf_dir).select(F.col("c_custkey").alias("user_id"), F.col("ord").alias("sel_pos"), "goal_id")


def goal_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned goals with their (possibly missing) share of the monthly pool."""
    key, ord_, n = F.col("c_custkey"), F.col("ord"), F.col("n")
    parts = (n * (n + 1) / 2).cast("double")
    return _goal_rows(spark, sf_dir).select(
        key.alias("user_id"),
        "ord",
        "goal_id",
        "goal_name",
        F.when(key % 11 == 0, lit(0)).otherwise(F.col("template_target")).alias("target_today"),
        (F.col("template_years") + F.when(key % 13 == 0, lit(0.25)).otherwise(lit(0))).alias("horizon_years"),
        ((ord_ == 0) & (key % 5 != 0)).alias("tenure_confirmed"),
        (ord_ == (key + 1) % n).alias("is_current"),
        F.when((key + ord_) % 8 == 0, F.lit(None).cast("double"))
        .when(key % 12 == 3, lit(0))
        .otherwise((ord_ + 1) * lit(100) / parts)
        .alias("share"),
    )


def plan_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return goal_shares(spark, sf_dir).drop("share")


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read_table(spark, sf_dir, "customer").select(
        key.alias("user_id"),
        F.when(key % 7 == 0, lit(0))
        .when(key % 7 == 1, lit(500000))
        .otherwise((key * 13 % 200 * 500).cast("double"))
        .alias("monthly_sip"),
        _savings(F.col("c_acctbal")).alias("current_savings"),
        F.when(key % 9 == 0, lit(0.04)).otherwise(lit(0.06)).alias("inflation"),
    )


def goal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority lists: user_id, goal_id, rank; some goals are missing and some listed goals do not exist."""
    user, ord_ = F.col("user_id"), F.col("ord")
    listed = plan_goals(spark, sf_dir).where((user + ord_) % 6 != 0).select(
        "user_id",
        "goal_id",
        F.row_number().over(W.partitionBy("user_id").orderBy((user * 7 + ord_ * 5) % 3, "ord")).alias("rank"),
    )
    ghosts = read_table(spark, sf_dir, "customer").where(F.col("c_custkey") % 10 == 0).select(
        F.col("c_custkey").alias("user_id"), F.lit("ghost_goal").alias("goal_id"), F.lit(9).alias("rank")
    )
    return listed.unionByName(ghosts)


def baskets(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Fund weights per order: basket_id, fund_id, weight, pos (at most 13 rows per basket).

    ``only`` names the baskets wanted (basket_id); lines of others are dropped before anything is summed.
    """
    part = (F.col("l_partkey") % 13).cast("int")
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    lines = read_table(spark, sf_dir, "lineitem")
    if only is not None:
        lines = lines.join(only.select(F.col("basket_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    grouped = (
        lines.groupBy(F.col("l_orderkey").alias("basket_id"), part.alias("fund_no"))
        .agg(F.sum(signed).alias("weight"), F.min(F.col("l_linenumber").cast("bigint") * 100 + part).alias("pos"))
    )
    return grouped.select("basket_id", fund_by_number(F.col("fund_no")).alias("fund_id"), "weight", "pos")


UNLISTED = "unlisted_fund"


def fund_by_number(n: Column) -> Column:
    """Catalogue fund at this position; anything past the end is a fund the catalogue does not know."""
    return _pick(n, [f[0] for f in catalog.FUNDS], UNLISTED)


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return read_table(spark, sf_dir, "orders").select(
        key.alias("holding_id"),
        F.col("o_custkey").alias("user_id"),
        (key % 16).cast("int").alias("type_ord"),
        F.when(key % 17 == 0, F.lit("   ")).otherwise(F.concat(F.lit("  "), "o_orderpriority", F.lit(" "))).alias("name"),
        F.when(F.col("o_orderstatus") == "P", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("amount"),
    )


CLOSING_SEQ = 1_000_000_000
CLOSING_DATE = "2002-01-01"


def cash_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    paid = orders.select(
        F.col("o_custkey").alias("entity_id"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderdate").cast("date").alias("flow_date"),
        (-F.col("o_totalprice")).alias("amount"),
    )
    paise = F.floor(F.col("o_totalprice") * lit(100) + lit(0.5)).cast("bigint")
    back = orders.groupBy(F.col("o_custkey").alias("entity_id")).agg(F.sum(paise).alias("paise")).select(
        "entity_id",
        F.lit(CLOSING_SEQ).cast("bigint").alias("seq"),
        F.lit(CLOSING_DATE).cast("date").alias("flow_date"),
        (F.floor(F.col("paise") * 5 / 4).cast("double") / lit(100)).alias("amount"),
    )
    return paid.unionByName(back)


ACTIONS = {"click": "set_sip", "view": "set_savings", "purchase": "add_holding", "signup": "set_inflation", "error": "set_weight"}


def edits_from_events(events: DataFrame) -> DataFrame:
    """Edit stream or batch: user_id, ts, seq, action, value (in the unit of its field), slot."""
    action = catalog.lookup(F.col("event_type"), ACTIONS, None)
    value = F.col("value")
    scaled = (
        F.when(action == "set_sip", value * lit(1000))
        .when(action == "set_savings", value * lit(10000))
        .when(action == "set_inflation", value / lit(10000))
        .otherwise(value)
    )
    return events.select(
        "user_id",
        "ts",
        F.col("event_id").alias("seq"),
        action.alias("action"),
        scaled.alias("value"),
        F.get_json_object("props", "$.k").try_cast("int").alias("slot"),
    )


def edits(spark: SparkSession, sf_dir: str, *actions: str) -> DataFrame:
    """The edit log, or only some actions of it; those are picked by event type, which the Parquet scan can filter."""
    events = read_table(spark, sf_dir, "events")
    if actions:
        events = events.where(F.col("event_type").isin(*[t for t, a in ACTIONS.items() if a in actions]))
    return edits_from_events(events)


#: What the events mean where they are edits of a basket.
BASKET_ACTIONS = {"error": "set_weight", "purchase": "add_fund", "view": "remove_fund", "signup": "apply_preset"}


def basket_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of baskets: user_id, ts, seq, action, value (a weight) and slot (which fund or preset)."""
    events = read_table(spark, sf_dir, "events").where(F.col("event_type").isin(*BASKET_ACTIONS))
    slot = F.get_json_object("props", "$.k").try_cast("int").alias("slot")
    return events.select(
        "user_id", "ts", F.col("event_id").alias("seq"), catalog.lookup(F.col("event_type"), BASKET_ACTIONS, None).alias("action"), "value", slot
    )


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", catalog.lookup(F.col("role"), {"assistant": "ai", "user": "user"}, None).alias("role"), "text"
    )
