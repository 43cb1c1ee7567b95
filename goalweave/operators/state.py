"""Latest state per user from an edit log. The same functions run on a batch and on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import lit, positive
from ..sources import catalog

FIELDS = {
    "set_sip": ("monthly_sip", catalog.DEFAULT_POOL),
    "set_savings": ("current_savings", catalog.DEFAULT_SAVINGS),
    "set_inflation": ("inflation", catalog.DEFAULT_INFLATION),
}


# Microseconds of a zone-less timestamp from its own fields: nothing here depends on the session's time zone.
MICROS = """
    cast(unix_date(cast(ts AS date)) AS bigint) * 86400000000L + hour(ts) * 3600000000L + minute(ts) * 60000000L
      + cast(extract(SECOND FROM ts) * 1000000 AS bigint)"""


def order_key() -> Column:
    """(ts, seq) as one number, so that the latest edit can be kept in a fixed-width hash aggregation buffer."""
    return F.expr(f"cast(cast({MICROS} AS decimal(18,0)) * 10000000000000000000 + seq AS decimal(38,0))")


def latest(action: str) -> Column:
    """Value of a user's last edit of this kind, null when there is none."""
    mine = F.col("action") == action
    return F.max_by(F.when(mine, F.col("value")), F.when(mine, F.col("order_key")))


def latest_pool_state(edits: DataFrame) -> DataFrame:
    """Pool, savings and inflation per user: last write wins per field, in whatever order edits arrive."""
    keyed = edits.withColumn("order_key", order_key())
    fields = [F.coalesce(latest(a), lit(default)).alias(name) for a, (name, default) in FIELDS.items()]
    return keyed.groupBy("user_id").agg(*fields)


def with_defaults(users: DataFrame, states: DataFrame) -> DataFrame:
    """The state of all users; those who never edited anything have the defaults."""
    joined = users.join(states, "user_id", "left")
    return joined.select("user_id", *[F.coalesce(name, lit(default)).alias(name) for name, default in FIELDS.values()])


def live_holdings_total(edits: DataFrame) -> DataFrame:
    added = F.when(F.col("action") == "add_holding", positive(F.col("value"))).otherwise(lit(0))
    return edits.groupBy("user_id").agg(F.sum(added).alias("holdings_total"))
