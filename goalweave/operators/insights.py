"""Rule-based remarks on a plan: a fixed list of rules per row, the first four that apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import half_up_long, lit
from ..functions.text import format_inr, format_pct, format_years

# Limits of the rules. Years, part of the basket in equity or in one fund, distance of the weights from 100.
SHORT_YEARS, LONG_YEARS, EQUITY_LIMIT, TOP_LIMIT, FILL_LIMIT = 3, 10, 0.4, 0.7, 0.5
SHOWN = 4


def _remark(tone: str, code: str, *parts) -> Column:
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.struct(F.lit(tone).alias("tone"), F.lit(code).alias("code"), text.alias("message"))


def with_texts(plans: DataFrame) -> DataFrame:
    """The figures that remarks quote, as text. Made once per row and shared by all rules."""
    extra = F.greatest(lit(0), F.col("required_sip") - F.col("sip"))
    return plans.withColumns(
        {
            "corpus_text": format_inr(F.col("projected_corpus")),
            "required_text": format_inr(F.col("required_corpus")),
            "gap_text": format_inr(F.abs("gap")),
            "sip_text": format_inr(F.col("required_sip")),
            "extra_text": format_inr(extra),
            "target_text": format_inr(F.col("target_today")),
            "years_text": format_years(F.col("horizon_years")),
            "reached_text": format_years(F.col("goal_reached_month") / lit(12)),
            "equity_text": format_pct(F.col("growth_weight"), 0),
            "top_text": format_pct(F.col("top_weight"), 0),
            "total_text": half_up_long(F.col("total")).cast("string"),
        }
    )


def remarks() -> Column:
    """All remarks that apply, in rule order. Needs plan results, the figures of the plan's basket and the texts."""
    years, equity, c = F.col("horizon_years"), F.col("growth_weight"), F.col
    on_track, reached = c("on_track"), c("goal_reached_month")
    too_bold = (years <= SHORT_YEARS) & (equity > EQUITY_LIMIT)
    too_cautious = (years >= LONG_YEARS) & (equity < EQUITY_LIMIT) & ~too_bold
    rules = [
        F.when(
            on_track,
            _remark("positive", "on_track", "Projected ", c("corpus_text"), " covers the ", c("required_text"),
                    " needed, with ", c("gap_text"), " to spare."),
        ),
        F.when(
            on_track & reached.isNotNull() & (reached < c("months")),
            _remark("positive", "ahead", "This pace reaches the goal in about ", c("reached_text"), "."),
        ),
        F.when(
            ~on_track,
            _remark("warning", "shortfall", "Projected ", c("corpus_text"), " leaves ", c("gap_text"), " missing; ",
                    c("sip_text"), " a month (", c("extra_text"), " more) closes it."),
        ),
        F.when(
            too_bold,
            _remark("warning", "too_bold", c("equity_text"), " equity is a lot with ", c("years_text"), " to go."),
        ),
        F.when(
            too_cautious,
            _remark("info", "too_cautious", c("equity_text"), " equity is little over ", c("years_text"), "."),
        ),
        F.when(
            c("top_weight") > TOP_LIMIT,
            _remark("info", "concentrated", c("top_text"), " of the basket is ",
                    F.coalesce("top_fund_name", F.lit("a single fund")), "."),
        ),
        F.when(
            F.abs(c("total") - lit(100)) > FILL_LIMIT,
            _remark("info", "basket_fill", "The weights add up to ", c("total_text"), "%; they are read as shares of that."),
        ),
        _remark("info", "inflation", c("target_text"), " of today becomes ", c("required_text"), " in ",
                c("years_text"), "."),
    ]
    empty = F.array(_remark("info", "empty_basket", "Add a fund to see a projection."))
    fired = F.filter(F.array(*rules), lambda r: r.isNotNull())
    return F.when(c("total") > 0, fired).otherwise(empty)


def first_remarks(plans: DataFrame) -> DataFrame:
    """Remarks as an array per plan, cut to the first four; ``fired`` is how many applied."""
    listed = with_texts(plans).withColumn("all_remarks", remarks())
    return listed.withColumns(
        {"fired": F.size("all_remarks"), "remarks": F.slice("all_remarks", 1, SHOWN)}
    ).drop("all_remarks")


def plan_insights(plans: DataFrame, *keys: str) -> DataFrame:
    """One row per remark, ranked from 1. Every plan has at least one, so the outer explode adds no rows; unlike the
    inner one it does not make the optimizer repeat the whole rule list as a not-empty filter.
    """
    listed = first_remarks(plans).select(*keys, F.posexplode_outer("remarks").alias("pos", "remark"))
    return listed.select(*keys, (F.col("pos") + 1).alias("rank"), "remark.tone", "remark.code", "remark.message")
