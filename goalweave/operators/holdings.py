"""Existing investments: checks, totals and removal. Narrow or map-side combined; dimensions are fixed and tiny."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import half_up, lit, positive
from ..functions.text import strip_blanks

UNKNOWN_TYPE = "unknown"


def validated(holdings: DataFrame, types: DataFrame) -> DataFrame:
    """Entries that may be saved: named, worth something and of a known type; name stripped, amount whole."""
    named = holdings.withColumn("name", strip_blanks(F.col("name"))).where((F.col("name") != "") & (F.col("amount") > 0))
    return named.join(F.broadcast(types), "type_ord").withColumn("amount", half_up(F.col("amount")))


def with_types(holdings: DataFrame, types: DataFrame) -> DataFrame:
    """Left look-up; an unknown type keeps its row under a default label."""
    default = F.lit(UNKNOWN_TYPE)
    return holdings.join(F.broadcast(types), "type_ord", "left").withColumns(
        {c: F.coalesce(c, default) for c in ("type_id", "category", "type_label")}
    )


def totals(holdings: DataFrame) -> DataFrame:
    return holdings.groupBy("user_id").agg(F.sum(positive(F.col("amount"))).alias("holdings_total"))


def applied_to_savings(pools: DataFrame, totals_: DataFrame) -> DataFrame:
    """Pools whose current savings are what the user's holdings add up to; nothing for users without holdings."""
    savings = F.coalesce("holdings_total", lit(0))
    return pools.join(totals_, "user_id", "left").withColumn("current_savings", savings).drop("holdings_total")


def reconcile(profiles: DataFrame, totals_: DataFrame) -> DataFrame:
    """Whether holdings and stated savings differ by a rupee or more."""
    total = F.coalesce(F.col("holdings_total"), lit(0))
    return profiles.join(totals_, "user_id", "left").select(
        "user_id",
        total.alias("holdings_total"),
        "existing_savings",
        (half_up(total) != half_up(F.col("existing_savings"))).alias("differs"),
    )


def remove(holdings: DataFrame, removed_ids: DataFrame) -> DataFrame:
    """Drop holdings by id. Ids are folded to one row each first, so a much repeated id is cheap to shuffle."""
    return holdings.join(removed_ids.select("holding_id").distinct(), "holding_id", "left_anti")


def type_groups(types: DataFrame) -> DataFrame:
    """Types per category in listed order, categories by first appearance."""
    entry = F.struct("type_ord", "type_label")
    grouped = types.groupBy("category").agg(
        F.min("type_ord").alias("first_ord"),
        F.count(F.lit(1)).alias("n_types"),
        F.array_sort(F.collect_list(entry)).alias("entries"),
    )
    return grouped.withColumn("labels", F.array_join("entries.type_label", "; ")).drop("entries")
