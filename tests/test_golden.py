"""Known values: the demo plan, preset figures, rupee text and edge cases of single values."""

from __future__ import annotations

import decimal
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from goalweave.functions import text
from goalweave.functions.num import half_up, lit
from goalweave.operators import holdings, insights, portfolio, profile, projection, shares
from goalweave.operators.cashflow import plan_xirr
from goalweave.plans import population as jobs
from goalweave.sources import catalog

PROFILE = "user_id BIGINT, city_tier STRING, employment STRING, career_stage STRING, rent DOUBLE, emi DOUBLE, " \
          "take_home DOUBLE, existing_savings DOUBLE, timeline STRING"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def demo(spark):
    rows = spark.createDataFrame(
        [(1, "metro", "salaried", "stable", 30000.0, 12000.0, 185000.0, 1500000.0, None)], PROFILE
    )
    plans = plan_xirr(jobs.demo(spark, rows), projection.SERIES_START)
    return {r.goal_id: r for r in plans.collect()}


@pytest.mark.parametrize(
    "goal, share, target, corpus, required, gap, reached, sip, rate",
    [
        ("travel", 28.761760, 500000.0, 1065557.673813, 561800.0, 503757.673813, 6, 2228.639377, 0.080518),
        ("home", 71.238240, 4800000.0, 8814736.954377, 7217425.243159, 1597311.711218, 71, 40522.566689, 0.108745),
        ("fire", 0.0, 30000000.0, 0.0, 96214064.166385, -96214064.166385, None, 83127.087095, 0.0),
    ],
)
def test_demo_plan(demo, goal, share, target, corpus, required, gap, reached, sip, rate):
    r = demo[goal]
    assert r.monthly_sip == 75000 and r.tenure_confirmed
    assert r.share == pytest.approx(share, abs=1e-6)
    assert r.target_today == target
    assert r.projected_corpus == pytest.approx(corpus, abs=1e-5)
    assert r.required_corpus == pytest.approx(required, abs=1e-5)
    assert r.gap == pytest.approx(gap, abs=1e-5)
    assert r.goal_reached_month == reached
    assert r.required_sip == pytest.approx(sip, abs=1e-5)
    assert r.xirr == pytest.approx(rate, abs=1e-6)
    assert r.on_track == (r.gap >= 0)


def test_demo_needs_and_order(demo):
    needs = {g: r.need for g, r in demo.items()}
    assert needs["travel"] == pytest.approx(21571.320175, abs=1e-5)
    assert needs["home"] == pytest.approx(58316.048196, abs=1e-5)
    assert needs["fire"] == pytest.approx(83127.087095, abs=1e-5)
    assert [g for g, _ in sorted(demo.items(), key=lambda kv: kv[1].priority)] == ["travel", "home", "fire"]


def test_preset_figures(spark):
    rows = {r.profile: r for r in jobs.preset_metrics(spark).collect()}
    expected = {
        "steady": (0.07775, 0.0665, 15, 70, 15),
        "balanced": (0.10375, 0.1225, 53, 27, 20),
        "bold": (0.13075, 0.188, 85, 0, 15),
    }
    for name, figures in expected.items():
        r = rows[name]
        assert r.total == 100
        got = (r.blended_return, r.blended_volatility, r.equity, r.debt, r.gold)
        assert got == pytest.approx(figures, abs=1e-12)


@pytest.mark.parametrize(
    "stage, work, city, income",
    [(None, None, None, 67000), ("starting", "student", "tier3", 14000), ("stable", "salaried", "metro", 221000)],
)
def test_income(spark, stage, work, city, income):
    rows = spark.createDataFrame([(1, city, work, stage, 0.0, 0.0, 0.0, 0.0, None)], PROFILE)
    assert rows.select(profile.income_guess().alias("x")).first().x == income


def test_sip_floor_and_unknown_city(spark):
    rows = spark.createDataFrame([(1, None, None, None, None, None, None, None, None)], PROFILE)
    got = rows.select(
        profile.surplus().alias("s"), profile.sip_guess().alias("sip"), profile.rent_guess().alias("rent")
    ).first()
    assert (got.s, got.sip, got.rent) == (0, 1000, 12000)


def test_car_target_in_small_town(spark):
    goals = catalog.goal_templates(spark).where("goal_id = 'car'").withColumn("city_tier", F.lit("tier3"))
    assert profile.adjust_targets(goals, catalog.city_multipliers(spark)).first().target_today == 1104000


@pytest.mark.parametrize("years, name", [(3, "steady"), (3.01, "balanced"), (7, "balanced"), (7.25, "bold")])
def test_preset_by_horizon(spark, years, name):
    assert one(spark, profile.preset_for(lit(years))) == name


@pytest.mark.parametrize("x, rounded", [(2.5, 3), (-2.5, -2), (0.4, 0), (-0.6, -1), (66.5, 67)])
def test_half_up(spark, x, rounded):
    assert one(spark, half_up(lit(x))) == rounded


@pytest.mark.parametrize(
    "x, shown",
    [
        (12500000, "₹1.25 Cr"), (300000, "₹3 L"), (99999.6, "₹1,00,000"), (-1500, "-₹1,500"), (999.5, "₹1000"),
        (0, "₹0"), (123456, "₹1.23 L"), (1e9, "₹100 Cr"), (10000000, "₹1 Cr"), (110000, "₹1.1 L"),
        (math.inf, "—"), (math.nan, "—"), (12.5, "₹13"),
    ],
)
def test_compact_rupees(spark, x, shown):
    assert one(spark, text.format_inr(lit(x))) == shown


@pytest.mark.parametrize("x, shown", [(1234567, "₹12,34,567"), (-100000, "-₹1,00,000"), (999, "₹999"), (1e7, "₹1,00,00,000")])
def test_full_rupees(spark, x, shown):
    assert one(spark, text.format_inr_full(lit(x))) == shown


@pytest.mark.parametrize("years, shown", [
    (0, "now"), (-1, "now"), (0.99, "12 mo"), (1, "1 yr"), (1.99, "2 yrs"), (2.5, "2y 6m"), (0.25, "3 mo"), (7, "7 yrs"),
    (math.inf, "—"),
])
def test_years(spark, years, shown):
    assert one(spark, text.format_years(lit(years))) == shown


@pytest.mark.parametrize("x, digits, shown", [
    (0.0015, 1, "0.1%"), (0.07775, 1, "7.8%"), (0.13075, 1, "13.1%"), (0.1225, 0, "12%"), (-0.031, 1, "-3.1%"),
    (0.5, 0, "50%"), (0.005, 0, "1%"), (0.0, 1, "0.0%"), (math.nan, 1, "—"),
])
def test_percent(spark, x, digits, shown):
    assert one(spark, text.format_pct(lit(x), digits)) == shown


def test_percent_matches_exact_decimals(spark):
    """Against exact decimal arithmetic on the binary value, over many near ties."""
    from decimal import ROUND_HALF_UP, Decimal

    values = [k / 2000 for k in range(4000)] + [k / 1000 + 0.0005 for k in range(1000)]
    rows = spark.createDataFrame([(v,) for v in values], "x DOUBLE").select("x", text.format_pct(F.col("x"), 1).alias("t"))
    for r in rows.collect():
        exact = Decimal(r.x * 100).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP)
        assert r.t == f"{exact}%", r.x


def test_blank_stripping(spark):
    rows = spark.createDataFrame([(" \t a b \n ",), ("﻿",), ("x",)], "t STRING")
    assert [r.x for r in rows.select(text.strip_blanks(F.col("t")).alias("x")).collect()] == ["a b", "", "x"]


HOLDING = "holding_id BIGINT, user_id BIGINT, type_ord INT, name STRING, amount DOUBLE"


def test_holdings_rules(spark):
    rows = spark.createDataFrame(
        [(1, 7, 0, " Gold \t", 10.5), (2, 7, 15, "x", 5.0), (3, 7, 2, "  ", 5.0), (4, 7, 3, "y", 0.0), (5, 8, 1, "z", -4.0)],
        HOLDING,
    )
    types = catalog.holding_types(spark)
    assert [(r.holding_id, r.name, r.amount) for r in holdings.validated(rows, types).collect()] == [(1, "Gold", 11.0)]
    assert {r.user_id: r.holdings_total for r in holdings.totals(rows).collect()} == {7: 20.5, 8: 0.0}
    labels = {r.holding_id: r.type_label for r in holdings.with_types(rows, types).collect()}
    assert labels[2] == "unknown" and labels[1] == "Indian stocks"


BASKET = "basket_id BIGINT, fund_id STRING, weight DOUBLE, pos BIGINT"


def test_basket_edges(spark):
    """Unknown funds count in the total only; non-positive weights never do; a basket without any keeps its row."""
    rows = spark.createDataFrame(
        [(1, "icici_nifty", 50.0, 1), (1, "mystery", 50.0, 2), (1, "sbi_gilt", -9.0, 3), (2, "sbi_gilt", -1.0, 1), (2, "icici_gold", 0.0, 2)],
        BASKET,
    )
    got = {r.basket_id: r for r in portfolio.basket_metrics(rows, catalog.funds(spark), "basket_id").collect()}
    assert (got[1].total, got[1].blended_return, got[1].equity, got[1].debt) == (100.0, 0.0575, 50.0, 0.0)
    assert got[1].growth_weight == 0.5
    assert (got[2].total, got[2].blended_return, got[2].growth_weight) == (0.0, 0.0, 0.0)
    assert portfolio.risk_label(spark.createDataFrame([got[2]])).first().risk == "—"
    assert {r.basket_id for r in portfolio.normalize_to_100(rows, "basket_id").collect()} == {1}


def edited(rows):
    return {r.fund_id: (round(r.weight, 9), r.place) for r in rows.collect()}


def test_add_fund_cases(spark):
    fund = F.lit("icici_gold")
    two = spark.createDataFrame([(1, "sbi_gilt", 30.0, 1), (1, "icici_nifty", 10.0, 2)], BASKET)
    got = edited(portfolio.add_fund(two, "basket_id", fund))
    assert got == {"icici_gold": (round(100 / 3, 9), 0), "sbi_gilt": (50.0, 1), "icici_nifty": (round(50 / 3, 9), 2)}
    there = spark.createDataFrame([(1, "icici_gold", 30.0, 1), (1, "icici_nifty", 10.0, 2)], BASKET)
    assert edited(portfolio.add_fund(there, "basket_id", fund)) == {"icici_gold": (75.0, 1), "icici_nifty": (25.0, 2)}
    empty = spark.createDataFrame([(1, "sbi_gilt", -30.0, 1)], BASKET)
    assert edited(portfolio.add_fund(empty, "basket_id", fund)) == {"icici_gold": (100.0, 0)}


def test_set_weight_cases(spark):
    all_in_one = spark.createDataFrame([(1, "sbi_gilt", 5.0, 1), (1, "icici_nifty", 0.0, 2), (1, "icici_gold", -1.0, 3)], BASKET)
    got = edited(portfolio.set_fund_weight(all_in_one, "basket_id", F.lit("sbi_gilt"), lit(40)))
    assert got == {"sbi_gilt": (40.0, 0), "icici_nifty": (30.0, 2), "icici_gold": (30.0, 3)}
    single = spark.createDataFrame([(1, "sbi_gilt", 5.0, 1)], BASKET)
    assert edited(portfolio.set_fund_weight(single, "basket_id", F.lit("sbi_gilt"), lit(40))) == {"sbi_gilt": (100.0, 0)}
    got = edited(portfolio.set_fund_weight(all_in_one, "basket_id", F.lit("icici_nifty"), lit(250)))
    assert got["icici_nifty"] == (100.0, 0) and got["sbi_gilt"] == (0.0, 1)


GOAL = "user_id BIGINT, goal_id STRING, ord INT, share DOUBLE, monthly_sip DOUBLE, edit_goal STRING, edit_amount DOUBLE"


def test_set_goal_amount_cases(spark):
    rows = spark.createDataFrame(
        [
            (1, "a", 0, 100.0, 1000.0, "a", 400.0), (1, "b", 1, 0.0, 1000.0, "a", 400.0), (1, "c", 2, None, 1000.0, "a", 400.0),
            (2, "a", 0, 60.0, 1000.0, "b", 500.0), (2, "b", 1, 40.0, 1000.0, "b", 500.0),
            (3, "a", 0, 10.0, 1000.0, "a", 1.0), (4, "a", 0, 10.0, 0.0, "a", 1.0), (4, "b", 1, 20.0, 0.0, "a", 1.0),
            (5, "a", 0, 10.0, 50.0, None, None),
        ],
        GOAL,
    )
    got = {(r.user_id, r.goal_id): r.share for r in shares.set_goal_amount(rows).collect()}
    assert got == {
        (1, "a"): 40.0, (1, "b"): 30.0, (1, "c"): 30.0, (2, "a"): 50.0, (2, "b"): 50.0, (3, "a"): 100.0,
        (4, "a"): 10.0, (4, "b"): 20.0, (5, "a"): 10.0,
    }


def test_removed_goal_leaves_missing_shares_missing(spark):
    rows = spark.createDataFrame(
        [(1, "a", 30.0), (1, "b", 20.0), (1, "c", None), (2, "a", 9.0), (2, "b", 0.0), (2, "c", None)],
        "user_id BIGINT, goal_id STRING, share DOUBLE",
    )
    got = {(r.user_id, r.goal_id): r.share for r in shares.remove_goal_shares(rows, F.col("goal_id") == "a").collect()}
    assert got == {(1, "b"): 100.0, (1, "c"): None, (2, "b"): 50.0, (2, "c"): 50.0}


def test_zero_rate_plan(spark):
    rows = spark.createDataFrame([(1200.0, 1.0, 0.0, 100.0, 0.0, 0.0)],
                                 "target_today DOUBLE, horizon_years DOUBLE, savings DOUBLE, sip DOUBLE, inflation DOUBLE, blended_return DOUBLE")
    r = projection.compute_plan(rows).first()
    assert (r.projected_corpus, r.required_sip, r.goal_reached_month, r.on_track) == (1200.0, 100.0, 12, True)


def test_goal_given_all_it_needs_is_on_track(spark):
    """The pool covers the first goal's need, by way of a percent; a corpus short by more than last bits is still missed."""
    rows = [("met", 72.58364467665889), ("short", 72.58364467), ("more", 72.6)]
    rows = spark.createDataFrame(rows, "goal_id STRING, share DOUBLE").withColumns(
        {"monthly_sip": lit(17500), "current_savings": lit(0), "inflation": lit(0.06), "blended_return": lit(0.07775),
         "target_today": lit(150000), "horizon_years": lit(1), "fraction": F.col("share") / lit(100)}
    )
    got = {r.goal_id: r for r in projection.compute_plan(projection.pro_rated(rows)).collect()}
    assert 0 < got["met"].required_corpus - got["met"].projected_corpus < 1e-9
    assert {g: (r.on_track, r.goal_reached_month) for g, r in got.items()} == {"met": (True, 12), "short": (False, None), "more": (True, 12)}


def test_more_than_four_remarks(spark):
    rows = spark.createDataFrame(
        [(1, "g", 1e5, 2.0, 5e5, 5e4, 0.06, 0.14, 120.0, 1.0, 0.9, "Some Fund")],
        "user_id BIGINT, goal_id STRING, target_today DOUBLE, horizon_years DOUBLE, savings DOUBLE, sip DOUBLE, inflation DOUBLE, "
        "blended_return DOUBLE, total DOUBLE, growth_weight DOUBLE, top_weight DOUBLE, top_fund_name STRING",
    )
    plans = projection.compute_plan(rows)
    listed = insights.first_remarks(plans).first()
    assert listed.fired == 6 and [r.code for r in listed.remarks] == ["on_track", "ahead", "too_bold", "concentrated"]


# ---- large sums, goal orders and text in summaries --------------------------------------------------------


def test_rounding_has_no_upper_bound(spark):
    from goalweave.functions.num import half_up, published, settled

    values = [1e7 + 1 / 3, 1e13 + 0.25, 1e20, -1e20, 2.5, -2.5, 0.1 + 0.2]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    x = F.col("x")
    got = rows.orderBy("i").select(settled(x).alias("s"), half_up(x).alias("h"), published(x).alias("p")).collect()
    for v, r in zip(values, got):
        assert abs(r.s - v) <= 1e-12 + abs(v) * 1e-15
        assert r.h == (v if abs(v) >= 2**52 else math.floor(v + 0.5))
        assert abs(r.p - v) <= 5.1e-7


def test_bands_of_very_large_baskets(spark):
    from goalweave.operators import portfolio
    from goalweave.sources import catalog

    for scale in (1e7, 1e13, 1e20):
        alloc = spark.createDataFrame([(1, "icici_nifty", 2 * scale, 1), (1, "sbi_gilt", 1.2 * scale, 2)], "basket_id int, fund_id string, weight double, pos int")
        (row,) = portfolio.basket_metrics(alloc, catalog.funds(spark), "basket_id").collect()
        assert (row.equity, row.debt) == pytest.approx((2 * scale, 1.2 * scale), rel=1e-12)
        sizes = {r.band: r.size for r in portfolio.band_segments(spark.createDataFrame([row]), "basket_id").collect()}
        assert sizes == pytest.approx({"equity": 62.5, "debt": 37.5})


def _split_of(spark, goals, order, pool):
    from goalweave.operators import shares

    rows = spark.createDataFrame(goals, "user_id int, goal_id string, ord int, need double").withColumn("monthly_sip", F.lit(pool))
    ranks = spark.createDataFrame(order, "user_id int, goal_id string, rank int")
    split = shares.recommend_shares(shares.in_stated_order(rows, ranks)).collect()
    return {(r.user_id, r.goal_id): r.share for r in split}


def test_split_without_order_is_served_as_declared(spark):
    goals = [(u, g, i, n) for u in (1, 2, 3) for i, (g, n) in enumerate((("home", 80.0), ("travel", 60.0)))]
    order = [(2, "ghost_goal", 9), (3, "travel", 1)]
    got = _split_of(spark, goals, order, 100.0)
    assert got == {(1, "home"): 80, (1, "travel"): 20, (2, "home"): 0, (2, "travel"): 0, (3, "travel"): 60, (3, "home"): 0}


def test_order_is_kept_unless_a_goal_is_added_or_retimed(spark):
    from goalweave.operators import shares

    goals = spark.createDataFrame(
        [(u, g, i, h, 1.0, False) for u in (1, 2) for i, (g, h) in enumerate((("home", 7.0), ("travel", 2.0)))],
        "user_id int, goal_id string, ord int, horizon_years double, target_today double, tenure_confirmed boolean",
    )
    order = spark.createDataFrame([(1, "home", 1), (1, "travel", 2), (2, "home", 1), (2, "travel", 2)], "user_id int, goal_id string, rank int")
    new = spark.createDataFrame([(1, "home", 7.0), (2, "car", 3.0)], "user_id int, goal_id string, horizon_years double")
    added = {(r.user_id, r.goal_id): r.priority for r in shares.add_goals(goals, new, order, F.lit(False)).collect()}
    assert added == {(1, "home"): 1, (1, "travel"): 2, (2, "travel"): 1, (2, "car"): 2, (2, "home"): 3}
    edits = spark.createDataFrame([(1, "travel", 5.0, None), (2, "travel", None, 1.0)], "user_id int, goal_id string, new_target double, new_tenure double")
    edited = {(r.user_id, r.goal_id): r.priority for r in shares.edit_goals(goals, edits, order, F.lit(False)).collect()}
    assert edited == {(1, "home"): 1, (1, "travel"): 2, (2, "travel"): 1, (2, "home"): 2}


def test_summary_keeps_digits_and_names(spark):
    from goalweave.operators import chat

    numbers = [33.333333333, 7.0, 1e7, 1e20, 12345.678901, 0.25, 100.0]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(numbers)], "i int, x double")
    shown = [r.t for r in rows.orderBy("i").select(chat.number_text(F.col("x")).alias("t")).collect()]
    assert shown == ["33.333333333", "7", "10000000", "100000000000000000000", "12345.678901", "0.25", "100"]
    assert [r.t for r in spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (0.0,), (-0.0,)], "x double").select(chat.number_text(F.col("x")).alias("t")).collect()] == [None, None, None, "0", "0"]
    names = ["Flat:2.500,now", 'a "b" \\ c', "é\n", ""]
    got = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(chat.quoted(F.col("n")).alias("q")).collect()
    assert [json.loads(r.q) for r in got] == names


def plain_number(x):
    """Layout of a number as text, from the digits and the exponent that give the double back."""
    sign, digits, exponent = decimal.Decimal(repr(x)).normalize().as_tuple()
    digits, point = "".join(map(str, digits)), len(digits) + exponent
    if point > 21 or point < -5:
        text = digits[0] + ("." + digits[1:] if digits[1:] else "") + f"e{point - 1:+d}"
    elif point <= 0:
        text = "0." + "0" * -point + digits
    else:
        text = digits.ljust(point, "0")[:point] + ("." + digits[point:] if digits[point:] else "")
    return "-" * sign + text


def test_numbers_keep_all_digits(spark):
    from goalweave.operators import chat

    draw = random.Random(6)
    numbers = [1.2345678901234568e-05, 1.5e-18, 1e-7, 1e-6, 9.5e-7, 1e21, 1.5e21, 123456789012345678901.0, 1e300, -1e300, 5e-324, -0.1, 1e22, 2e-3]
    numbers += [draw.choice([1, -1]) * draw.uniform(1, 10) * 10.0 ** draw.randint(-300, 300) for _ in range(500)]
    numbers += [draw.choice([1, -1]) * round(draw.uniform(0.1, 10), draw.randint(1, 15)) * 10.0 ** draw.randint(-9, 24) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(numbers)), "i int, x double").select("i", chat.number_text(F.col("x")).alias("t"))
    shown = {r.i: r.t for r in rows.collect()}
    assert shown == {i: plain_number(x) for i, x in enumerate(numbers)}
    assert plain_number(1.5e-18) == "1.5e-18" and plain_number(1.2345678901234568e-05) == "0.000012345678901234568" and plain_number(1e21) == "1e+21"


def test_catalogue_values():
    """Spot values written out here, so that a slip in the catalogue cannot pass by way of the check SQL."""
    from goalweave.sources import catalog

    assert len(catalog.FUNDS) == 12 and len(catalog.GOALS) == 10 and len(catalog.PRESETS) == 3
    assert ("travel", "Travel the World", 500000.0, 2.0, "steady", "none") in catalog.GOALS
    assert all(sum(w for _, w in preset) == 100 for preset in catalog.PRESETS.values())
    assert (catalog.DEFAULT_POOL, catalog.DEFAULT_SAVINGS, catalog.DEFAULT_INFLATION) == (25000, 0, 0.06)
