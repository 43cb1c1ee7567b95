"""Spark results against plain loops, written here from the rules and not shared with the library."""

from __future__ import annotations

import datetime
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from goalweave.operators import basket_effects as effects
from goalweave.operators import basket_log, cashflow, projection, replay, shares
from goalweave.plans import population as jobs
from goalweave.sources import catalog
from goalweave.sources import population as pop

PLAN = "user_id BIGINT, goal_id STRING, target_today DOUBLE, horizon_years DOUBLE, savings DOUBLE, sip DOUBLE, " \
       "inflation DOUBLE, blended_return DOUBLE"


@pytest.fixture(scope="module")
def plan_rows():
    rng = random.Random(5)
    rows = []
    for i in range(60):
        rows.append((
            i, "g", rng.choice([0.0, 1e5, 5e6, 4e7]), rng.choice([0.05, 1.0, 2.25, 7.0, 20.0]), rng.choice([0.0, 1e4, 3e6]),
            rng.choice([0.0, 500.0, 25000.0]), rng.choice([0.0, 0.04, 0.06]), rng.choice([0.0, 0.06, 0.115, 0.16]),
        ))
    return rows


def month_values(savings, sip, rate, months):
    values = [savings]
    for _ in range(months):
        values.append((values[-1] + sip) * (1 + rate / 12))
    return values


def test_series_and_crossing(spark, plan_rows):
    rows = spark.createDataFrame(plan_rows, PLAN)
    series = {}
    for r in projection.projection_series(rows).collect():
        series.setdefault(r.user_id, {})[r.month] = r
    plans = {r.user_id: r for r in projection.compute_plan(rows).collect()}
    for i, _, target, years, savings, sip, inflation, rate in plan_rows:
        months = max(1, math.floor(years * 12 + 0.5))
        values = month_values(savings, sip, rate, months)
        assert sorted(series[i]) == list(range(months + 1))
        for m, value in enumerate(values):
            assert series[i][m].value == pytest.approx(value, rel=1e-9, abs=1e-6)
            assert series[i][m].invested == pytest.approx(savings + sip * m)
        required = target * (1 + inflation) ** years
        crossing = next((m for m, v in enumerate(values) if v >= required * (1 - 1e-12)), None)
        assert plans[i].goal_reached_month == crossing
        assert plans[i].projected_corpus == pytest.approx(values[-1], rel=1e-9)
        # Paying exactly the required sip from the same savings must land on the target.
        if plans[i].required_sip > 0:
            end = month_values(savings, plans[i].required_sip, rate, months)[-1]
            assert end == pytest.approx(required, rel=1e-9)


def worth(rate, flows):
    first = flows[0][0]
    return sum(a / (1 + rate) ** ((day - first).days / 365) for day, a in flows)


def test_rates_of_random_flows(spark):
    rng = random.Random(11)
    start = datetime.date(2020, 1, 1)
    rows, expected = [], {}
    for entity in range(40):
        days = sorted(rng.sample(range(2000), rng.randint(2, 8)))
        flows = [(start + datetime.timedelta(d), -float(rng.randint(100, 9000))) for d in days[:-1]]
        flows.append((start + datetime.timedelta(days[-1]), -sum(a for _, a in flows) * rng.uniform(0.5, 2.5)))
        lo, hi = -0.9999, 10.0
        if worth(lo, flows) * worth(hi, flows) > 0:
            continue
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if worth(lo, flows) * worth(mid, flows) < 0 else (mid, hi)
        expected[entity] = (lo + hi) / 2
        rows += [(entity, seq, day, amount) for seq, (day, amount) in enumerate(flows)]
    table = spark.createDataFrame(rows, "entity_id BIGINT, seq BIGINT, flow_date DATE, amount DOUBLE")
    got = {r.entity_id: r.xirr for r in cashflow.xirr(table).collect()}
    assert set(got) == set(expected) and len(got) > 30
    for entity, rate in expected.items():
        assert got[entity] == pytest.approx(rate, abs=1e-8)
    npv = cashflow.xnpv(table, [0.1]).collect()
    for r in npv:
        flows = [(d, a) for e, _, d, a in rows if e == r.entity_id]
        assert r.xnpv == pytest.approx(worth(0.1, flows), rel=1e-9, abs=1e-6)


def test_rate_corner_cases(spark):
    day = datetime.date
    flows = {
        1: [(day(2020, 1, 1), -5.0)],
        2: [(day(2020, 1, 1), -5.0), (day(2021, 1, 1), -5.0)],
        3: [(day(2020, 1, 1), 5.0), (day(2021, 1, 1), 5.0)],
        # Doubles every few days: beyond the bracket, so the open search runs.
        4: [(day(2020, 1, 1), -100.0), (day(2020, 3, 1), 200.0)],
        # Two flows of opposite sign on one day cancel, yet both count.
        5: [(day(2020, 1, 1), -100.0), (day(2020, 7, 1), 50.0), (day(2020, 7, 1), -50.0), (day(2021, 1, 1), 110.0)],
        6: [(day(2020, 1, 1), -100.0), (day(2020, 1, 1), 100.0)],
    }
    rows = [(e, i, d, a) for e, fl in flows.items() for i, (d, a) in enumerate(fl)]
    table = spark.createDataFrame(rows, "entity_id BIGINT, seq BIGINT, flow_date DATE, amount DOUBLE")
    got = {r.entity_id: r.xirr for r in cashflow.xirr(table).collect()}
    assert got[1] == got[2] == got[3] == 0
    assert got[4] == pytest.approx(2 ** (365 / 60) - 1, rel=1e-6)
    assert got[5] == pytest.approx(1.1 ** (365 / 366) - 1, abs=1e-7)
    assert got[6] == pytest.approx((-0.9999 + 10) / 2)


def test_origin_follows_the_given_order(spark):
    rows = [(1, 0, datetime.date(2021, 1, 1), -100.0), (1, 1, datetime.date(2020, 1, 1), 5.0), (1, 2, datetime.date(2022, 1, 1), 90.0)]
    table = spark.createDataFrame(rows, "entity_id BIGINT, seq BIGINT, flow_date DATE, amount DOUBLE")
    flows = [(d, a) for _, _, d, a in rows]
    assert cashflow.xnpv(table, [0.2], order="seq").first().xnpv == pytest.approx(worth(0.2, flows), rel=1e-12)
    rate = cashflow.xirr(table, order="seq").first().xirr
    assert worth(rate, flows) == pytest.approx(0, abs=1e-5)


def test_plan_rates_zero_the_plan_flows(spark, plan_rows):
    plans = projection.compute_plan(spark.createDataFrame(plan_rows, PLAN))
    rates = {r.user_id: r.xirr for r in cashflow.plan_xirr(plans, projection.SERIES_START).collect()}
    flows = {}
    for r in projection.plan_cash_flows(plans).collect():
        flows.setdefault(r.user_id, []).append((r.month, r.flow_date, r.amount))
    for user, rows in flows.items():
        ordered = [(day, a) for _, day, a in sorted(rows)]
        if any(a > 0 for _, a in ordered) and any(a < 0 for _, a in ordered):
            size = sum(abs(a) for _, a in ordered)
            assert abs(worth(rates[user], ordered)) < 1e-9 * size
        else:
            assert rates[user] == 0


def test_waterfall_and_shares(spark, sf_dir):
    goals, pools = pop.plan_goals(spark, sf_dir), pop.pools(spark, sf_dir)
    order = pop.goal_order(spark, sf_dir).withColumnRenamed("rank", "priority")
    rows = shares.recommend_shares(jobs.needs(spark, shares.with_marks(goals, priority=order), pools)).collect()
    by_user = {}
    for r in rows:
        by_user.setdefault(r.user_id, []).append(r)
    branches = set()
    for goals_of in by_user.values():
        pool, total = goals_of[0].monthly_sip, sum(r.need for r in goals_of)
        left, given = pool, {}
        for r in sorted((r for r in goals_of if r.priority is not None), key=lambda r: r.priority):
            given[r.goal_id] = max(0.0, min(r.need, left))
            left -= given[r.goal_id]
        if pool <= 0 or total <= 0:
            branches.add("even")
            expected = {r.goal_id: 100 / len(goals_of) for r in goals_of}
        elif pool >= total:
            branches.add("surplus")
            expected = {r.goal_id: r.need / total * 100 for r in goals_of}
        else:
            branches.add("short")
            expected = {r.goal_id: given.get(r.goal_id, 0.0) / pool * 100 for r in goals_of}
        for r in goals_of:
            assert r.share == pytest.approx(expected[r.goal_id], abs=1e-9)
    assert branches == {"even", "surplus", "short"}


def plain_weight_replay(start, edits):
    x = list(start)
    for i, w in edits:
        w = min(100.0, max(0.0, w))
        if len(x) == 1:
            x = [100.0]
            continue
        rest = sum(v for k, v in enumerate(x) if k != i)
        x = [w if k == i else v / rest * (100 - w) if rest > 0 else (100 - w) / (len(x) - 1) for k, v in enumerate(x)]
    return x


def plain_basket_edit(held, kind, fund, weight, basket):
    """One edit of a basket: {fund: weight}, or a preset as a list with None for funds it lacks."""
    held = dict(held)
    if kind == basket_log.PRESET:
        return {k: w for k, w in enumerate(basket) if w is not None}
    if kind == basket_log.ADD and fund not in held:
        share = 100 / (len(held) + 1)
        total = sum(held.values())
        return {k: v / total * (100 - share) if total > 0 else (100 - share) / len(held) for k, v in held.items()} | {fund: share}
    if kind == basket_log.REMOVE and fund in held:
        del held[fund]
        total = sum(held.values())
        return {k: v / total * 100 for k, v in held.items()} if total > 0 else {}
    if kind == basket_log.WEIGHT and fund in held:
        if len(held) == 1:
            return {fund: 100.0}
        w = min(100.0, max(0.0, weight))
        rest = {k: v for k, v in held.items() if k != fund}
        total = sum(rest.values())
        return {k: v / total * (100 - w) if total > 0 else (100 - w) / len(rest) for k, v in rest.items()} | {fund: w}
    return held


BASKET_KINDS = [basket_log.WEIGHT, basket_log.ADD, basket_log.REMOVE, basket_log.PRESET]


def random_edits(rng, n, n_funds, odds):
    weight = lambda: rng.choice([0.0, 0.0, 100.0, 130.0, -5.0, rng.uniform(0, 100), 35.0])
    some = lambda: [rng.choice([None, 0.0, rng.uniform(1, 50)]) for _ in range(n_funds)]
    kinds = rng.choices(BASKET_KINDS, odds, k=n)
    return [(k, rng.randrange(n_funds), weight(), some() if k == basket_log.PRESET else None) for k in kinds]


def edit_columns(edits, n_funds):
    baskets = np.array([[np.nan if w is None else w for w in b or [None] * n_funds] for *_, b in edits], dtype=float).reshape(-1, n_funds)
    return [np.array([e[0] for e in edits]), np.array([e[1] for e in edits]), np.array([e[2] for e in edits]), baskets]


@pytest.mark.parametrize("odds", [(5, 0, 0, 0), (5, 3, 3, 0), (1, 1, 3, 0), (3, 2, 2, 1)])
def test_parts_of_a_basket_log_compose(odds):
    """Cutting a log anywhere, describing each part without knowing where it starts, and applying the parts gives the loop's result."""
    rng = random.Random(sum(odds))
    for _ in range(150):
        n = rng.randint(1, 5)
        first = [rng.choice([None, 0.0, 0.0, rng.uniform(1, 50), rng.uniform(1, 50)]) for _ in range(n)]
        edits = random_edits(rng, rng.randint(1, 40), n, odds)
        cuts = [0, *sorted(rng.sample(range(1, len(edits)), min(len(edits) - 1, 4))), len(edits)]
        parts = [edit_columns(edits[a:b], n) for a, b in itertools.pairwise(cuts)]
        cases = [effects.edited_cases(effects.unchanged(n), p) for p in parts]
        cases = [effects.unpacked_cases(effects.packed_cases(c), n) for c in cases]
        held, patterns = {k: w for k, w in enumerate(first) if w is not None}, []
        for a, b in itertools.pairwise(cuts):
            patterns.append(effects.pattern_of([held.get(k) for k in range(n)]))
            for e in edits[a:b]:
                held = plain_basket_edit(held, *e)
        start, end = effects.pattern_of(first), effects.pattern_of([held.get(k) for k in range(n)])
        assert effects.patterns_along(start, cases) == patterns
        assert effects.outcome(effects.composed_cases(cases, n), start) == end
        packed = []
        for pattern, part in zip(patterns, parts):
            some = np.array([np.nan if w is None else w for w in effects.basket_of(pattern)])
            packed.append(effects.edited_weights(effects.WeightEffect(some), part, n).packed())
        for chain in (packed, [effects.product(packed[:2], n), *packed[2:]], packed[:-2] + [effects.product(packed[-2:], n)]):
            got = effects.applied(first, effects.product(chain, n), n)
            assert {k: w for k, w in enumerate(got) if w is not None} == pytest.approx(held, abs=1e-7), (first, edits, cuts)


def test_cases_cover_every_pattern():
    """Exactly one case holds for each of all patterns, and it ends where the loop does."""
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randint(1, 4)
        edits = random_edits(rng, rng.randint(1, 12), n, (5, 3, 3, 0))
        cases = effects.edited_cases(effects.unchanged(n), edit_columns(edits, n))
        for pattern in itertools.product(range(3), repeat=n):
            assert sum(all(code >> 2 * s & 3 != effects.OUT for code, s in zip(c, pattern)) for c in cases) == 1
            held = {k: w for k, w in enumerate(effects.basket_of(bytes(pattern))) if w is not None}
            for e in edits:
                held = plain_basket_edit(held, *e)
            assert effects.outcome(cases, bytes(pattern)) == effects.pattern_of([held.get(k) for k in range(n)])


def test_one_hot_user_replayed_over_many_partitions(spark):
    rng = random.Random(3)
    stamp = datetime.datetime(2024, 1, 1)
    logs = {1: [(rng.randrange(3), rng.choice([0.0, 100.0, *[rng.uniform(1, 99)] * 6])) for _ in range(4000)]}
    logs |= {u: [(rng.randrange(3), rng.uniform(1, 99)) for _ in range(rng.randint(1, 30))] for u in range(2, 60)}
    rows = [(u, stamp + datetime.timedelta(seconds=i // 2), i, m, 3, w) for u, log in logs.items() for i, (m, w) in enumerate(log)]
    rng.shuffle(rows)
    edits = spark.createDataFrame(rows, "user_id BIGINT, ts TIMESTAMP_NTZ, seq BIGINT, member INT, n_members INT, weight DOUBLE")
    baskets = spark.createDataFrame(
        [(u, ["a", "b", "c"], [50.0, 30.0, 20.0]) for u in range(1, 62)], "user_id BIGINT, fund_ids ARRAY<STRING>, weights ARRAY<DOUBLE>"
    )
    got = {}
    for r in replay.replay_weights(edits, baskets).collect():
        got.setdefault(r.user_id, {})[r.fund_id] = r.weight
    for user in range(1, 62):
        expected = plain_weight_replay([50.0, 30.0, 20.0], logs.get(user, []))
        assert [got[user][f] for f in "abc"] == pytest.approx(expected, abs=1e-7)


def test_goal_toggles_replayed(spark):
    rng = random.Random(9)
    goals = [g[0] for g in catalog.GOALS]
    stamp = datetime.datetime(2024, 1, 1)
    logs = {u: [rng.randrange(10) for _ in range(3000 if u == 1 else rng.randint(1, 20))] for u in range(1, 40)}
    rows = [(u, stamp + datetime.timedelta(seconds=i), i, g) for u, log in logs.items() for i, g in enumerate(log)]
    rng.shuffle(rows)
    toggles = spark.createDataFrame(rows, "user_id BIGINT, ts TIMESTAMP_NTZ, seq BIGINT, goal_no INT")
    got = {}
    for r in replay.replay_picks(toggles, goals).orderBy("user_id", "place").collect():
        got.setdefault(r.user_id, []).append(r.goal_id)
    for user, log in logs.items():
        picks = []
        for g in log:
            if g in picks:
                picks.remove(g)
            elif len(picks) < 3:
                picks.append(g)
        assert got.get(user, []) == [goals[g] for g in picks]


def test_hot_user_really_spans_partitions(spark):
    stamp = datetime.datetime(2024, 1, 1)
    rows = [(1, stamp + datetime.timedelta(seconds=i), i, 0) for i in range(5000)]
    edits = spark.createDataFrame(rows, "user_id BIGINT, ts TIMESTAMP_NTZ, seq BIGINT, goal_no INT")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = replay._in_order(edits, "goal_no").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert parts > 4


@pytest.fixture
def settings(spark):
    """Set Spark settings for one test."""
    before = {}

    def put(key, value):
        before.setdefault(key, spark.conf.get(key))
        spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("least", [10**9, 60])
def test_basket_log_against_a_loop(spark, settings, monkeypatch, least):
    """All kinds of edits in one log, long and short logs, zero weights, emptied baskets, several batches per user; with
    and without the hot users' logs cut into slices."""
    draw, n_funds = random.Random(12), 5
    presets = [[60.0, 40.0, None, None, None], [None, 0.0, 100.0, None, None]]
    baskets = {u: [20.0, 30.0, 50.0, None, None] if u % 2 else presets[1] for u in range(12)}
    rows, wanted = [], {u: {k: w for k, w in enumerate(b) if w is not None} for u, b in baskets.items()}
    wanted[77] = {}
    for i in range(2500):
        user = draw.choices([3, 77, draw.randrange(12)], [5, 2, 3])[0]
        kind = draw.choices(BASKET_KINDS, [5, 3, 3, 0 if user in (3, 77) else 1])[0]
        fund, weight = draw.randrange(n_funds), draw.choice([0.0, 100.0, 130.0, -5.0, draw.uniform(0, 100)])
        basket = draw.choice(presets) if kind == basket_log.PRESET else None
        rows.append((user, i, kind, fund, weight, basket))
        wanted[user] = plain_basket_edit(wanted[user], kind, fund, weight, basket)
    draw.shuffle(rows)
    edits = spark.createDataFrame(rows, "user_id bigint, order_key bigint, kind int, fund_no int, weight double, basket array<double>")
    edits = edits.withColumn("order_key", F.col("order_key").cast("decimal(38,0)"))
    starts = spark.createDataFrame(list(baskets.items()), "user_id bigint, basket array<double>")
    monkeypatch.setattr(basket_log, "LEAST_SLICE", least)
    monkeypatch.setattr(basket_log, "FAN_IN", 5)
    settings("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    cuts = dict(basket_log.hot_cuts(edits, 8))
    assert set(cuts) == (set() if least > 2500 else {3, 77})
    if cuts:
        assert len(cuts[3]) >= 5
    got = {}
    for r in basket_log.replay_baskets(edits, starts, n_funds).collect():
        got[r.user_id, r.fund_no] = r.weight
    assert got == pytest.approx({(u, k): v for u, x in wanted.items() for k, v in x.items()}, abs=1e-6)


def test_half_of_a_log_under_one_user(spark, settings, monkeypatch):
    """A user with half of the edits is folded by many tasks, none of which has more than a few slices of the log."""
    monkeypatch.setattr(basket_log, "LEAST_SLICE", 500)
    settings("spark.sql.shuffle.partitions", "32")
    settings("spark.sql.adaptive.coalescePartitions.enabled", "false")
    n = 40_000
    weight = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(110)).cast("double")
    kind = F.element_at(F.array(*[F.lit(k) for k in BASKET_KINDS[:3]]), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3)) + 1).cast("int"))
    log = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 500 + 100).cast("bigint").alias("user_id"),
        F.col("id").cast("decimal(38,0)").alias("order_key"), kind.alias("kind"), F.pmod(F.xxhash64("id"), F.lit(6)).cast("int").alias("fund_no"),
        weight.alias("weight"), F.lit(None).cast("array<double>").alias("basket"),
    )
    ((user, cuts),) = basket_log.hot_cuts(log, 32)
    assert user == 7 and 28 <= len(cuts) + 1 <= 64
    slices = log.where("user_id = 7").withColumn("slice", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("order_key").cast("double"))))
    most = basket_log._in_slices(slices).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < n / 2 / 4
    starts = spark.createDataFrame([(7, [50.0, 50.0, None, None, None, 0.0])], "user_id bigint, basket array<double>")
    got = {r.fund_no: r.weight for r in basket_log.replay_baskets(log, starts, 6).where("user_id = 7").collect()}
    held = {0: 50.0, 1: 50.0, 5: 0.0}
    for r in log.where("user_id = 7").orderBy("order_key").collect():
        held = plain_basket_edit(held, r.kind, r.fund_no, r.weight, None)
    assert got == pytest.approx(held, abs=1e-6)
