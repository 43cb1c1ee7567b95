"""Plan shapes and hot keys: what has to hold for the jobs to run on far more data than the tests have."""

from __future__ import annotations

import datetime
import math
import random
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from goalweave.operators import cashflow, chat, holdings, portfolio, profile, replay, shares, state
from goalweave.plans.queries import QUERIES
from goalweave.sources import catalog
from goalweave.sources import population as pop


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_products_and_no_unpartitioned_work(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Exchange SinglePartition" not in plan and "BatchEvalPython" not in plan


@pytest.mark.parametrize("name", list(QUERIES))
def test_only_sized_sides_are_broadcast(spark, sf_dir, name):
    """With size-based broadcasting off, what is still broadcast is hinted: it must come from literal rows alone."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        lines = plan_of(QUERIES[name](spark, sf_dir)).splitlines()
    finally:
        spark.conf.set(key, before)
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = line.index("BroadcastExchange")
            below = []
            for child in lines[at + 1 :]:
                if len(re.match(r"[\s:+\-|]*", child).group(0)) <= depth:
                    break
                below.append(child)
            assert not any("FileScan" in child for child in below), line


READS = {
    "suggested_sip": {"customer": {"c_custkey", "c_nationkey", "c_acctbal"}, "nation": {"n_nationkey", "n_regionkey"}},
    "allocation_total": {"lineitem": {"l_orderkey", "l_partkey", "l_quantity", "l_returnflag"}},
    "holdings_total": {"orders": {"o_custkey", "o_orderstatus", "o_totalprice"}},
    "required_corpus": {"customer": {"c_custkey"}},
}


@pytest.mark.parametrize("name", list(READS))
def test_scans_read_only_what_is_needed(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for columns in re.findall(r"FileScan parquet \[([^\]]*)\]", plan):
        read = {re.sub(r"#\d+L?", "", c) for c in columns.split(",")}
        assert any(read <= allowed for allowed in READS[name].values()), read


@pytest.mark.parametrize("name, pushed", [("set_goal_amount", "EqualTo(event_type,click)"), ("replay_edits", "EqualTo(event_type,error)"),
                                          ("patch_current_goal", "In(event_type"), ("holdings_after_remove", "EqualTo(l_returnflag,R)")])
def test_filters_reach_the_scan(spark, sf_dir, name, pushed):
    assert pushed in plan_of(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["latest_pool_state", "blended_return", "questionnaire_pivot", "holdings_total", "xnpv"])
def test_groups_are_combined_before_the_shuffle(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "partial_" in plan and "SortAggregate" not in plan


def test_goal_lookups_shuffle_goals_once(spark, sf_dir):
    goals = pop.plan_goals(spark, sf_dir)
    order = spark.createDataFrame([(1, "travel", 1)], "user_id BIGINT, goal_id STRING, rank INT")
    assert plan_of(shares.goals_by_priority(goals, order)).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["top_holding", "plan_insights", "insights_first4"])
def test_heaviest_fund_is_hashed_not_sorted(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_order_of_weights_is_exact(spark):
    """Neighbouring doubles about powers of two, tiny and huge ones, zeros and ties keep their order as numbers."""
    weights = [0.0, 1e-300, 1e-280, 1e-9, 0.1, 33.0, 1e17, 1.7976931348623157e308]
    weights += [math.nextafter(2.0**k, to) for k in (-990, -3, 0, 1, 2, 3, 29, 49, 52, 53, 1000) for to in (0, 1e308)] + [2.0**k for k in (-3, 0, 1, 29, 1000)]
    rows = spark.createDataFrame([(w, p) for w in weights for p in (0, 7)], "w double, pos bigint")
    ordered = rows.select("w", "pos", portfolio.weight_order(F.col("w"), F.col("pos")).alias("k")).collect()
    assert len({r.k for r in ordered}) == len(set(weights)) * 2
    assert [(r.w, r.pos) for r in sorted(ordered, key=lambda r: r.k)] == sorted(((r.w, r.pos) for r in ordered), key=lambda r: (r[0], -r[1]))


def test_unlisted_funds_can_be_heaviest(spark):
    alloc = [(1, "other_b", 40.0, 1), (1, "other_a", 40.0, 2), (1, catalog.FUNDS[3][0], 20.0, 0), (2, catalog.FUNDS[0][0], 9.0, 0), (2, "other_a", 9.0, 1), (3, "x", 0.0, 0)]
    alloc = spark.createDataFrame(alloc, "basket_id int, fund_id string, weight double, pos bigint")
    wanted = [(1, "other_b", 0.4, False), (2, catalog.FUNDS[0][0], 0.5, False)]
    assert sorted(tuple(r) for r in portfolio.top_holding(alloc, "basket_id").collect()) == wanted
    assert sorted(tuple(r) for r in portfolio.top_holding(alloc, "basket_id", [*portfolio.CATALOGUE, "other_a", "other_b"]).collect()) == wanted
    assert portfolio.top_holding(alloc, "basket_id", portfolio.CATALOGUE).where("basket_id = 1").first().fund_id is None


def test_picks_are_cut_before_the_shuffle(spark, sf_dir):
    assert plan_of(QUERIES["goal_pick_cap"](spark, sf_dir)).count("WindowGroupLimit") == 2


# ---- a third of all rows under one key ---------------------------------------------------------------------

N = 30000


@pytest.fixture(scope="module")
def hot_events(spark):
    """Two thirds spread over many users, one third from user 7."""
    user = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500)
    kind = F.get(F.array(*[F.lit(t) for t in pop.ACTIONS]), F.pmod(F.xxhash64("id"), F.lit(5)).cast("int"))
    rows = spark.range(N).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.xxhash64("id"), F.lit(9999))).cast("timestamp_ntz").alias("ts"),
        user.alias("user_id"),
        kind.alias("event_type"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40000)) / 100).alias("value"),
        F.concat(F.lit('{"k": '), (F.col("id") % 97).cast("string"), F.lit("}")).alias("props"),
    )
    return pop.edits_from_events(rows)


def test_hot_user_state(spark, hot_events):
    got = {r.user_id: r for r in state.latest_pool_state(hot_events).collect()}
    last = {}
    for r in hot_events.collect():
        if r.action in state.FIELDS:
            slot = (r.user_id, r.action)
            if slot not in last or (r.ts, r.seq) > last[slot][0]:
                last[slot] = ((r.ts, r.seq), r.value)
    for user, row in got.items():
        for action, (field, default) in state.FIELDS.items():
            assert row[field] == last.get((user, action), (None, default))[1]


def test_hot_entity_rate(spark):
    """A third of all flows under one entity: gathered per entity is one entry per day, not one per flow."""
    rng = random.Random(1)
    start = datetime.date(2020, 1, 1)
    rows = []
    for i in range(9000):
        entity = 7 if i % 3 == 0 else i % 400 + 100
        rows.append((entity, i, start + datetime.timedelta(rng.randrange(30)), -float(rng.randint(1, 99))))
    paid = {}
    for e, _, _, a in rows:
        paid[e] = paid.get(e, 0) + a
    rows += [(e, 10**6, start + datetime.timedelta(365), -a * 1.1) for e, a in paid.items()]
    flows = spark.createDataFrame(rows, "entity_id BIGINT, seq BIGINT, flow_date DATE, amount DOUBLE")
    got = {r.entity_id: r for r in cashflow.xirr(flows).collect()}
    assert got[7].n == 3001
    for entity in (7, 100, 301):
        mine = [(d, a) for e, _, d, a in rows if e == entity]
        first, size = min(d for d, _ in mine), sum(abs(a) for _, a in mine)
        value = sum(a / (1 + got[entity].xirr) ** ((d - first).days / 365) for d, a in mine)
        assert abs(value) < 1e-7 * size
    plan = plan_of(cashflow.xirr(flows))
    assert "hashpartitioning(entity_id" in plan and re.search(r"hashpartitioning\(entity_id#\d+L?, flow_date", plan)
    assert "collect_list" not in plan


def test_rate_of_a_million_flows_on_many_days(spark):
    """One entity with flows on each day of 82 years, both ways, beside small ones; batches end within it."""
    n, days = 1_000_000, 30_000
    day = F.pmod(F.xxhash64("id"), F.lit(days)).cast("int")
    many = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 1000 + 2).cast("bigint").alias("entity_id"),
        F.date_add(F.lit("1940-01-01").cast("date"), day).alias("flow_date"),
        F.when(day < days // 5, F.lit(-3.0)).when(F.col("id") % 5 == 0, F.lit(-0.5)).otherwise(F.lit(1.0)).alias("amount"),
    )
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7000")
    try:
        got = {r.entity_id: r for r in cashflow.xirr(many).collect()}
    finally:
        spark.conf.set(key, before)
    assert len(got) == 501 and got[1].n == n // 2
    for entity in (1, 3, 501, 1001):
        value = cashflow.xnpv(many.where(F.col("entity_id") == entity), [got[entity].xirr]).first().xnpv
        worth_of_all = cashflow.xnpv(many.where(F.col("entity_id") == entity).withColumn("amount", F.abs("amount")), [got[entity].xirr]).first().xnpv
        assert abs(value) < 1e-7 * worth_of_all


def test_hot_basket_source(spark):
    """One order with a third of the lines still gives a basket of at most thirteen rows."""
    line = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") % 900).alias("basket_id"),
        pop.fund_by_number((F.col("id") % 13).cast("int")).alias("fund_id"),
        (F.col("id") % 50 + 1).cast("double").alias("quantity"),
    )
    rows = line.groupBy("basket_id", "fund_id").agg(F.sum("quantity").alias("weight"), F.min(F.length("fund_id")).alias("pos"))
    assert rows.groupBy("basket_id").count().agg(F.max("count")).first()[0] <= 13
    metrics = {r.basket_id: r for r in portfolio.basket_metrics(rows, catalog.funds(spark), "basket_id").collect()}
    returns = {f[0]: f[6] for f in catalog.FUNDS}
    weights = {}
    for r in line.where("basket_id = 5").collect():
        weights[r.fund_id] = weights.get(r.fund_id, 0.0) + r.quantity
    total = sum(weights.values())
    assert metrics[5].total == total
    assert metrics[5].blended_return == pytest.approx(sum(w * returns.get(f, 0.0) for f, w in weights.items()) / total, abs=1e-10)


def test_hot_picker_and_hot_answers(spark):
    picks = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("user_id"),
        F.get(F.array(*[F.lit(g[0]) for g in catalog.GOALS]), F.pmod(F.xxhash64("id"), F.lit(10)).cast("int")).alias("goal_id"),
        F.col("id").alias("pick_no"),
    )
    first = []
    for r in picks.where("user_id = 7").orderBy("pick_no").collect():
        if r.goal_id not in first:
            first.append(r.goal_id)
    got = shares.first_picks(picks).where("user_id = 7").orderBy("place").collect()
    assert [r.goal_id for r in got] == first[:3]
    answers = picks.select("user_id", F.lit("rent").alias("field"), F.lit("5000").alias("value"))
    assert profile.pivot_answers(answers).where("user_id = 7").first().rent == 5000


def test_hot_holder_and_repeated_removals(spark):
    rows = spark.range(N).select(
        F.col("id").alias("holding_id"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("user_id"),
        F.lit(1).alias("type_ord"), F.lit("x").alias("name"), F.lit(2.0).alias("amount"),
    )
    removed = spark.range(N).select(F.when(F.col("id") % 3 == 0, F.lit(6)).otherwise(F.col("id") % 100).alias("holding_id"))
    left = holdings.remove(rows, removed)
    assert left.count() == N - 100
    totals = {r.user_id: r.holdings_total for r in holdings.totals(left).where("user_id = 7").collect()}
    assert totals == {7: 2.0 * (N // 3 - 34)}


def test_long_conversation_stays_in_rows(spark):
    turns = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, F.lit("ai")).alias("role"), F.lit(None).cast("string").alias("text"),
    )
    plans = spark.createDataFrame([(1, '{"goal":"x"}')], "user_id BIGINT, plan_json STRING")
    messages = chat.chat_messages(turns, plans)
    assert messages.count() == N + turns.select("conv_id").distinct().count()
    opener = messages.where("conv_id = 1 AND turn < 0").first()
    assert opener.role == "system" and opener.content.endswith('Plan: {"goal":"x"}')
    assert "collect_list" not in plan_of(messages)


def test_long_conversation_in_pages(spark):
    """A conversation with most of the messages is gathered in pages of bounded size, in order."""
    turns = spark.range(5000).select(
        F.when(F.col("id") < 4000, 1).otherwise(F.col("id") % 50 + 2).cast("bigint").alias("conv_id"),
        F.when(F.col("id") < 4000, F.col("id")).otherwise(F.floor((F.col("id") - 4000) / 50)).cast("bigint").alias("turn"),
        F.lit("ai").alias("role"), F.col("id").cast("string").alias("text"),
    )
    plans = spark.createDataFrame([(1, "{}")], "user_id bigint, plan_json string")
    pages = chat.message_pages(chat.chat_messages(turns, plans), 100)
    rows = {r.page: r.messages for r in pages.where("conv_id = 1").collect()}
    assert sorted(rows) == list(range(40)) and {len(m) for m in rows.values()} == {100, 101}
    assert rows[0][0].role == "system" and [m.content for m in rows[0][1:]] == [str(i) for i in range(100)]
    assert [m.content for m in rows[39]] == [str(i) for i in range(3900, 4000)]
    assert "hashpartitioning(conv_id" in plan_of(pages) and ", page" in plan_of(pages)


def test_worker_code_needs_no_package(spark, sf_dir, tmp_path):
    """What is sent to Python workers must load where this package is not installed."""
    from pyspark import cloudpickle

    from goalweave.operators import basket_effects, basket_log, replay

    path = tmp_path / "code.pkl"
    worker = (basket_effects.WeightEffect, basket_effects.applied, basket_effects.edited_cases, basket_log._per_slice, replay._runs, replay.pick_moves)
    path.write_bytes(cloudpickle.dumps(worker))
    code = (
        "import pickle, sys, numpy; E, apply, cases, _, runs, moves = pickle.load(open(sys.argv[1], 'rb')); e = E(numpy.ones(2)); "
        "e.edit(2, 0, 25.0); assert [round(v, 9) for v in apply([50.0, 50.0], e.packed(), 2)] == [25.0, 75.0]; "
        "assert moves(10).shape == (10, 821); assert 'goalweave' not in sys.modules"
    )
    subprocess.run([sys.executable, "-c", code, str(path)], cwd="/", check=True)


def test_effects_of_a_hot_user_are_composed(spark, monkeypatch):
    """With many ranges and a small fan-in, a user with most of the log still ends where a plain loop does."""
    from goalweave.operators import replay

    draw = random.Random(8)
    toggles = [(1 if draw.random() < 0.8 else draw.randrange(2, 9), i, draw.randrange(10)) for i in range(3000)]
    wanted: dict[int, list[int]] = {}
    for user, _, goal in toggles:
        picks = wanted.setdefault(user, [])
        if goal in picks:
            picks.remove(goal)
        elif len(picks) < 3:
            picks.append(goal)
    start = datetime.datetime(2024, 1, 1)
    rows = [(u, start + datetime.timedelta(seconds=i), i, g) for u, i, g in toggles]
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, "user_id bigint, ts timestamp_ntz, seq bigint, goal_no int")
    monkeypatch.setattr(replay, "FAN_IN", 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        found = replay.replay_picks(frame, [str(g) for g in range(10)]).orderBy("user_id", "place").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got: dict[int, list[int]] = {}
    for r in found:
        got.setdefault(r.user_id, []).append(int(r.goal_id))
    assert got == {u: p for u, p in wanted.items() if p}


def test_replay_keeps_users_together_when_all_comes_dealt_by_user(spark):
    """Edits and baskets that both come from a shuffle by user, of sizes that adaptive execution reads in different parts."""
    users, each = 300, 200
    made = spark.range(users * each).select((F.col("id") % users).alias("user_id"), F.col("id").alias("seq"))
    edits = made.groupBy("user_id").agg(F.collect_list("seq").alias("seqs")).select("user_id", F.explode("seqs").alias("seq")).select(
        "user_id", F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("ts"), "seq", F.lit(0).alias("member"),
        (F.floor(F.col("seq") / users) % 90 + F.col("user_id") % 7).cast("double").alias("weight"),
    )
    baskets = spark.range(users * 2).groupBy((F.col("id") % users).alias("user_id")).agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", F.array(F.lit("a"), F.lit("b")).alias("fund_ids"), F.array(F.lit(30.0), F.lit(70.0)).alias("weights")
    )
    got = {(r.user_id, r.fund_id): r.weight for r in replay.replay_weights(edits, baskets).collect()}
    last = {u: (each - 1) % 90 + u % 7 for u in range(users)}
    assert got == {(u, f): float(w if f == "a" else 100 - w) for u, w in last.items() for f in "ab"}


def test_replayed_names_take_the_way_of_the_log(spark, sf_dir):
    """Nothing of the size of users times funds is joined or broadcast: the log and the users are each read once."""
    assert plan_of(QUERIES["replay_edits"](spark, sf_dir)).count("FileScan") == 2


@pytest.mark.parametrize("hot", [0, 45_000])
def test_replayed_names_over_batches_and_slices(spark, hot):
    """Each user has names of its own; batches end within users, and user 5 may be cut into slices of time."""
    users = 40
    made = spark.range(users * 9 + hot).select(F.when(F.col("id") < users * 9, F.col("id") % users).otherwise(F.lit(5)).alias("user_id"), F.col("id").alias("seq"))
    edits = made.select(
        "user_id", F.timestamp_micros(F.col("seq") * 1_000_000).cast("timestamp_ntz").alias("ts"), "seq", F.lit(1).alias("member"),
        (F.col("seq") % 97).cast("double").alias("weight"),
    )
    named = [(u, [f"{u}-{k}" for k in range(2 + u % 2)], [100.0 / (2 + u % 2)] * (2 + u % 2)) for u in range(users + 3)]
    baskets = spark.createDataFrame(named, "user_id bigint, fund_ids array<string>, weights array<double>")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7" if not hot else "999")
    try:
        got = {(r.user_id, r.fund_id): r.weight for r in replay.replay_weights(edits, baskets).collect()}
    finally:
        spark.conf.set(key, before)
    wanted = {}
    for u, ids, weights in named:
        last = users * 9 + hot - 1 if u == 5 and hot else users * 8 + u
        for k, f in enumerate(ids):
            w = weights[k] if u >= users else float(last % 97) if k == 1 else (100.0 - last % 97) / (len(ids) - 1)
            wanted[u, f] = pytest.approx(w, abs=1e-9)
    assert got == wanted
