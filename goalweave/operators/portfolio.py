"""Fund baskets: look-ups, blended figures, bands, ordering and weight edits.

A basket is a set of rows (key, fund_id, weight, pos) with one row per fund, so a group is never larger than the
number of different fund ids. Per-basket figures are plain aggregates with map-side combining; windows are used only
where every row needs its own share of the basket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.num import clamp, lit, positive, settled
from ..sources import catalog

NO_RISK = "—"
LAKH = 100000.0


def with_funds(alloc: DataFrame, funds: DataFrame) -> DataFrame:
    """Left look-up: a fund outside the catalogue counts as zero return and risk and has no bands."""
    facts = funds.select("fund_id", "exp_return", "volatility", "equity_part", "debt_part", "gold_part")
    zero = {c: 0.0 for c in facts.columns if c != "fund_id"}
    return alloc.join(F.broadcast(facts), "fund_id", "left").fillna(zero)


def composition(alloc: DataFrame, funds: DataFrame) -> DataFrame:
    """Inner look-up to band parts; funds outside the catalogue drop out."""
    facts = funds.select("fund_id", "asset_class", "equity_part", "debt_part", "gold_part")
    return alloc.join(F.broadcast(facts), "fund_id")


def basket_metrics(alloc: DataFrame, funds: DataFrame, key: str, with_top: bool = False) -> DataFrame:
    """Total, blended return and risk, band sums and growth share per basket, in one aggregate.

    ``with_top`` adds the heaviest fund and its share to the same pass; a fund outside the catalogue is null there.
    """
    w = positive(F.col("weight"))
    sums = with_funds(alloc, funds).groupBy(key).agg(
        F.sum(w).alias("total"),
        F.sum(w * F.col("exp_return")).alias("return_sum"),
        F.sum(w * F.col("volatility")).alias("volatility_sum"),
        F.sum(w * F.col("equity_part")).alias("equity"),
        F.sum(w * F.col("debt_part")).alias("debt"),
        F.sum(w * F.col("gold_part")).alias("gold"),
        *([F.max(w).alias("top_weight"), F.max_by(fund_number(), weight_order(w, F.col("pos"))).alias("top_number")] if with_top else []),
    )

    def per_total(name: str) -> Column:
        return settled(F.coalesce(F.try_divide(F.col(name), F.col("total")), lit(0)))

    top = F.when(F.col("total") > 0, numbered_fund(F.col("top_number"))) if with_top else None
    top_weight = F.coalesce(F.try_divide(F.col("top_weight"), F.col("total")), lit(0)) if with_top else None
    return sums.select(
        key,
        "total",
        per_total("return_sum").alias("blended_return"),
        per_total("volatility_sum").alias("blended_volatility"),
        *[settled(F.col(band)).alias(band) for band in ("equity", "debt", "gold")],
        per_total("equity").alias("growth_weight"),
        *([top.alias("top_fund_id"), top_weight.alias("top_weight")] if with_top else []),
    )


CATALOGUE = [f[0] for f in catalog.FUNDS]


def fund_number(fund_ids: list[str] = CATALOGUE) -> Column:
    """Place of a fund in a list from 1 on, 0 for one outside it."""
    return F.array_position(F.array(*map(F.lit, fund_ids)), F.col("fund_id")).cast("int")


def numbered_fund(number: Column, fund_ids: list[str] = CATALOGUE) -> Column:
    return F.get(F.array(*map(F.lit, fund_ids)), number - 1)


def weight_order(weight: Column, pos: Column) -> Column:
    """(weight, earlier place first) as one number, so that the heaviest fund is kept in a fixed-width hash aggregation buffer.

    A positive double is its exponent and 52 further bits; dividing by a power of two takes them apart without rounding.
    Weights below 1e-300 count as 0 and come last, among themselves by place. Places are below 10^18.
    """
    guess = F.floor(F.log2(weight))
    # A logarithm may be off by one next to a power of two; the mantissa tells.
    mantissa = weight / F.pow(F.lit(2.0), guess)
    more = F.when(mantissa >= 2, 1).when(mantissa < 1, -1).otherwise(0)
    fraction = F.when(mantissa >= 2, mantissa / F.lit(2.0)).when(mantissa < 1, mantissa * F.lit(2.0)).otherwise(mantissa) - F.lit(1.0)
    bits = (guess + more + F.lit(1023)) * F.lit(1 << 52) + (fraction * F.lit(2.0**52)).cast("bigint")
    number = F.when(weight >= F.lit(1e-300), bits).otherwise(F.lit(0))
    return (number.cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + (F.lit(10**18 - 1) - pos).cast("decimal(18,0)")).cast("decimal(38,0)")


def risk_label(metrics: DataFrame) -> DataFrame:
    vol = F.col("blended_volatility")
    return metrics.withColumn(
        "risk",
        F.when(F.col("total") <= 0, NO_RISK).when(vol < 0.06, "Low").when(vol < 0.13, "Moderate").otherwise("High"),
    )


def equity_heavy(metrics: DataFrame) -> DataFrame:
    total = F.col("total")
    flag = (
        (total > 0)
        & (F.coalesce(F.try_divide(F.col("equity"), total), lit(0)) > 0.7)
        & (F.col("debt") / F.greatest(total, lit(1)) < 0.1)
    )
    return metrics.withColumn("equity_heavy", flag)


def lakh_in_ten_years(metrics: DataFrame) -> DataFrame:
    grown = F.pow(F.col("blended_return") + lit(1), lit(10)) * lit(LAKH)
    return metrics.withColumn("lakh_value", F.when(F.col("total") > 0, grown))


def band_segments(metrics: DataFrame, key: str) -> DataFrame:
    """One row per visible band, shrunk to fit when the basket is over 100."""
    scale = F.when(F.col("total") > 100, lit(100) / F.col("total")).otherwise(lit(1))
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("size")) for b in ("equity", "debt", "gold")])
    return (
        metrics.select(key, scale.alias("scale"), F.inline(bands))
        .where(F.col("size") > 0.01)
        .select(key, "band", (F.col("size") * F.col("scale")).alias("size"))
    )


def top_holding(alloc: DataFrame, key: str, fund_ids: list[str] | None = None) -> DataFrame:
    """Heaviest fund per basket, the first inserted on a tie, with its share of the positive total.

    ``fund_ids`` lists the funds that can occur, where they are known; the aggregate then carries a number and is hashed
    (a fund that is not listed comes out as null). Without it, the aggregate carries the fund's text, for which Spark sorts.
    """
    w, pos = F.col("weight"), F.col("pos")
    if fund_ids is None:
        best, named = F.max(F.struct("weight", (-pos).alias("back"), "fund_id")), F.col("best.fund_id")
    else:
        best, named = F.max_by(fund_number(fund_ids), weight_order(w, pos)), numbered_fund(F.col("best"), fund_ids)
    top = alloc.where(w > 0).groupBy(key).agg(best.alias("best"), F.max(w).alias("top"), F.sum(w).alias("total"))
    share = F.col("top") / F.col("total")
    return top.select(key, named.alias("fund_id"), share.alias("top_weight")).withColumn("concentrated", F.col("top_weight") > 0.7)


def in_class_order(alloc: DataFrame, funds: DataFrame, key: str) -> DataFrame:
    """Rows of each basket ranked by class, then insertion order. Known funds only: at most 12 rows a basket."""
    known = alloc.join(F.broadcast(funds.select("fund_id", "asset_class", "class_rank")), "fund_id")
    rank = F.row_number().over(W.partitionBy(key).orderBy("class_rank", "pos"))
    return known.select(key, "fund_id", "asset_class", rank.alias("place"))


def normalized_weights(alloc: DataFrame, key: str) -> DataFrame:
    """Share of each positive weight in the basket; baskets with nothing positive give no rows."""
    rows = alloc.where(F.col("weight") > 0)
    return rows.withColumn("weight", F.col("weight") / F.sum("weight").over(W.partitionBy(key)))


def normalize_to_100(alloc: DataFrame, key: str) -> DataFrame:
    """Positive weights to percent, others kept as 0; baskets with nothing positive give no rows."""
    return _to_percent(alloc, key).where(F.col("basket_total") > 0).drop("basket_total")


def _to_percent(alloc: DataFrame, key: str) -> DataFrame:
    w = positive(F.col("weight"))
    totalled = alloc.withColumn("basket_total", F.sum(w).over(W.partitionBy(key)))
    return totalled.withColumn("weight", F.coalesce(F.try_divide(w, F.col("basket_total")) * lit(100), lit(0)))


def _members(alloc: DataFrame, key: str, fund: Column, weight: Column) -> DataFrame:
    """Normalised basket rows with what a weight edit on ``fund`` needs to know about the rest of the basket."""
    group = W.partitionBy(key)
    other = F.col("fund_id") != F.col("edit_fund")
    # Ranked first: the sort by (key, pos) then serves the sums over the whole basket as well.
    ranked = alloc.withColumn("place", F.row_number().over(group.orderBy("pos")))
    rows = _to_percent(ranked.withColumns({"edit_fund": fund, "edit_weight": weight}), key)
    return rows.select(
        key,
        "fund_id",
        "weight",
        "edit_fund",
        "edit_weight",
        "place",
        F.when(F.col("basket_total") > 0, F.count(F.lit(1)).over(group)).otherwise(F.lit(0)).alias("n"),
        F.sum(other.cast("int")).over(group).alias("n_other"),
        F.sum(F.when(other, F.col("weight")).otherwise(lit(0))).over(group).alias("other_total"),
    )


def _rows_out(members: DataFrame, key: str, kept: Column, added: Column) -> DataFrame:
    """Each row gives itself if kept; the first row of a basket also gives the edited fund's row."""
    both = F.filter(F.array(kept, F.when(F.col("place") == 1, added)), lambda r: r.isNotNull())
    return members.select(key, F.inline(both))


def _row(fund: Column, weight: Column, place: Column) -> Column:
    return F.struct(fund.alias("fund_id"), weight.alias("weight"), place.cast("int").alias("place"))


def _spread(rest: Column, others: Column) -> Column:
    """This row's part of ``rest``: pro rata to its weight among the others, evenly if they weigh nothing."""
    pro_rata = F.try_divide(F.col("weight"), F.col("other_total")) * rest
    return F.when(F.col("other_total") > 0, pro_rata).otherwise(F.try_divide(rest, others))


def add_fund(alloc: DataFrame, key: str, fund: Column) -> DataFrame:
    """Put a fund first with an even share, the rest shrunk pro rata; nothing happens if it is already there."""
    n, absent = F.col("n"), F.col("n_other") == F.col("n")
    share = lit(100) / (n + 1)
    scaled = F.when(absent, _spread(lit(100) - share, n)).otherwise(F.col("weight"))
    kept = F.when(n > 0, _row(F.col("fund_id"), scaled, F.col("place")))
    added = F.when((n == 0) | absent, _row(F.col("edit_fund"), F.when(n == 0, lit(100)).otherwise(share), F.lit(0)))
    return _rows_out(_members(alloc, key, fund, lit(0)), key, kept, added)


def set_fund_weight(alloc: DataFrame, key: str, fund: Column, weight: Column) -> DataFrame:
    """Fix one fund's percent and rescale the others to the rest; with at most one fund it takes everything."""
    n, fixed = F.col("n"), F.col("edit_weight")
    kept = F.when(
        (n > 1) & (F.col("fund_id") != F.col("edit_fund")),
        _row(F.col("fund_id"), _spread(lit(100) - fixed, F.col("n_other")), F.col("place")),
    )
    added = _row(F.col("edit_fund"), F.when(n > 1, fixed).otherwise(lit(100)), F.lit(0))
    return _rows_out(_members(alloc, key, fund, clamp(weight, 0, 100)), key, kept, added)


def remove_fund(alloc: DataFrame, key: str, fund: Column) -> DataFrame:
    return normalize_to_100(normalize_to_100(alloc, key).where(F.col("fund_id") != fund), key)


def search_funds(searches: DataFrame, fund_rows: list[tuple], category: Column, text: Column) -> DataFrame:
    """Catalogue hits of each search: class filter ("all" passes) and a name part in any case.

    The catalogue is a literal array of twelve entries tested inside the row, so nothing is joined or shuffled.
    """
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("fund_ord"),
                F.lit(f[0]).alias("fund_id"),
                F.lit(f[2]).alias("asset_class"),
                F.lit(f[1].lower()).alias("low_name"),
            )
            for i, f in enumerate(fund_rows)
        ]
    )
    wanted = F.lower(text)
    hits = F.filter(
        entries,
        lambda f: ((category == "all") | (f["asset_class"] == category)) & f["low_name"].contains(wanted),
    )
    return searches.select("*", F.inline(hits)).drop("low_name")
