"""Streams end in the same state as the batch over the same edits, in any arrival order and after a restart."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from goalweave.operators import state
from goalweave.plans import population as jobs
from goalweave.sources import population as pop
from goalweave.sources.tables import read_table
from goalweave.streaming import live


def rows_of(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory, sf_dir):
    """The events in four files whose time ranges are out of order: newest first, then mixed."""
    root = tmp_path_factory.mktemp("events")
    events = read_table(spark, sf_dir, "events")
    parts = [events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == k).orderBy(F.desc("ts")) for k in range(4)]
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(root / f"part{k}"))
    return root


def feed(spark, folders, source, k):
    spark.read.parquet(str(folders / f"part{k}")).coalesce(1).write.mode("append").parquet(source)


@pytest.fixture
def run_id():
    """Checkpoints may outlive a test run where the session names their folder."""
    return uuid.uuid4().hex


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_pool_state_and_holdings(spark, sf_dir, folders, tmp_path, run_id):
    source, state_out, held_out = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "held")
    for k in (2, 0):
        feed(spark, folders, source, k)
    for wave in ((), (3, 1)):
        for k in wave:
            feed(spark, folders, source, k)
        # The second round restarts both queries from their checkpoints.
        run(live.start(live.pool_states(live.edit_stream(spark, source, 1)), state_out, f"pool-{run_id}"))
        run(live.start(live.holdings_totals(live.edit_stream(spark, source, 1)), held_out, f"held-{run_id}"))
    edits = pop.edits(spark, sf_dir)
    columns = ["user_id", "monthly_sip", "current_savings", "inflation"]
    streamed = live.latest(spark, state_out, "user_id")
    assert rows_of(streamed, *columns) == rows_of(state.latest_pool_state(edits), *columns)
    assert len(live._numbers(spark, state_out)) >= 3
    live.fold(spark, state_out, "user_id")
    assert rows_of(live.latest(spark, state_out, "user_id"), *columns) == rows_of(state.latest_pool_state(edits), *columns)
    held = {r.user_id: r.holdings_total for r in live.latest(spark, held_out, "user_id").collect()}
    expected = {r.user_id: r.holdings_total for r in state.live_holdings_total(edits).collect()}
    assert held == pytest.approx(expected)


def test_live_plans(spark, sf_dir, folders, tmp_path, run_id):
    source, out = str(tmp_path / "in"), str(tmp_path / "plans")
    for k in (3, 1, 0, 2):
        feed(spark, folders, source, k)
    goals = pop.goal_shares(spark, sf_dir)
    run(live.start_plans(live.edit_stream(spark, source, 1), goals, out, f"plans-{run_id}"))
    columns = ["user_id", "goal_id", "months", "projected_corpus", "required_sip", "goal_reached_month", "on_track"]
    batch = jobs.goal_plans(spark, goals, state.latest_pool_state(pop.edits(spark, sf_dir)))
    streamed = rows_of(live.latest(spark, out, "user_id", "goal_id").fillna(-1, "goal_reached_month"), *columns)
    assert streamed == rows_of(batch.fillna(-1, "goal_reached_month"), *columns)


def triggers(spark, target, *batches):
    """Write triggers as the streams do: (number, {key: value})."""
    for number, rows in batches:
        frame = spark.createDataFrame(list(rows.items()), "k INT, v INT")
        frame.write.mode("overwrite").parquet(f"{target}/{live.BATCH}={number}")


def values(frame):
    return {r.k: r.v for r in frame.collect()}


def test_a_fold_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "out")
    triggers(spark, target, (0, {1: 1, 2: 1}), (1, {2: 2}))
    live.fold(spark, target, "k")
    triggers(spark, target, (2, {3: 3}), (3, {1: 4}))
    now = {1: 4, 2: 2, 3: 3}

    def dies(*_):
        raise KeyboardInterrupt

    # Before the snapshot is written, before its manifest appears, half-way through clearing up.
    for step in ("_newest", "_publish", "_delete"):
        if step == "_delete":
            live.fold(spark, target, "k")
            triggers(spark, target, (4, {5: 5}))
            now = now | {5: 5}
        with monkeypatch.context() as patch:
            patch.setattr(live, step, dies)
            with pytest.raises(KeyboardInterrupt):
                live.fold(spark, target, "k")
        assert values(live.latest(spark, target, "k")) == now
    live.fold(spark, target, "k")
    assert values(live.latest(spark, target, "k")) == now


def test_reading_across_a_fold(spark, tmp_path):
    """What was taken before a fold can be read after it; the fold after that clears up."""
    target = str(tmp_path / "out")
    triggers(spark, target, (0, {1: 1, 2: 1}), (1, {2: 2}))
    before = live.latest(spark, target, "k")
    live.fold(spark, target, "k")
    assert values(before) == values(live.latest(spark, target, "k")) == {1: 1, 2: 2}
    assert live._numbers(spark, target) == [0, 1]
    live.fold(spark, target, "k")
    assert values(before) == {1: 1, 2: 2} and live._manifests(spark, target) == [1]
    triggers(spark, target, (2, {3: 3}))
    middle = live.latest(spark, target, "k")
    live.fold(spark, target, "k")
    assert values(middle) == {1: 1, 2: 2, 3: 3}
    assert live._numbers(spark, target) == [2]
    # A trigger that is run again after it was folded replaces itself and still counts once.
    triggers(spark, target, (2, {3: 3}), (3, {1: 9}))
    live.fold(spark, target, "k")
    assert values(live.latest(spark, target, "k")) == {1: 9, 2: 2, 3: 3}
    assert live._manifests(spark, target) == [2, 3]
    assert len([n for n in live._names(spark, f"{target}/{live.SNAPSHOTS}") if n.startswith("rows-")]) == 2


def test_two_folds_cannot_both_count(spark, tmp_path):
    target = str(tmp_path / "out")
    triggers(spark, target, (0, {1: 1}))
    live.fold(spark, target, "k")
    with pytest.raises(RuntimeError):
        live._publish(spark, target, 1, "rows-other", 7)
    assert values(live.latest(spark, target, "k")) == {1: 1}


def test_a_trigger_reads_its_buckets_of_goals(spark, sf_dir, folders, tmp_path, run_id):
    goals = pop.goal_shares(spark, sf_dir)
    store = live.GoalStore(str(tmp_path / "goals"), 16)
    store.write(goals)
    users = spark.createDataFrame([(5,), (5,), (17,)], "user_id BIGINT")
    mine = store.of(users)
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and live.BUCKET in plan
    read = {r.f.split(f"{live.BUCKET}=")[1].split("/")[0] for r in mine.select(F.input_file_name().alias("f")).collect()}
    assert 1 <= len(read) <= 2
    assert rows_of(mine.where("user_id IN (5, 17)"), *goals.columns) == rows_of(goals.where("user_id IN (5, 17)"), *goals.columns)
    assert store.of(users.limit(0)).count() == 0

    source, out = str(tmp_path / "in"), str(tmp_path / "plans")
    for k in range(4):
        feed(spark, folders, source, k)
    run(live.start_plans(live.edit_stream(spark, source, 2), store, out, f"bucketed-{run_id}"))
    columns = ["user_id", "goal_id", "months", "projected_corpus", "required_sip", "on_track"]
    batch = jobs.goal_plans(spark, goals, state.latest_pool_state(pop.edits(spark, sf_dir)))
    assert rows_of(live.latest(spark, out, "user_id", "goal_id"), *columns) == rows_of(batch, *columns)


def test_ties_in_time_are_broken_by_sequence(spark):
    rows = [(1, "2024-01-01 00:00:00", 2, "set_sip", 5.0), (1, "2024-01-01 00:00:00", 10, "set_sip", 7.0),
            (1, "2023-12-31 23:59:59", 99, "set_sip", 1.0), (2, "1969-12-31 00:00:00", 1, "set_inflation", 0.1)]
    edits = spark.createDataFrame(rows, "user_id BIGINT, ts STRING, seq BIGINT, action STRING, value DOUBLE").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    )
    got = {r.user_id: tuple(r)[1:] for r in state.latest_pool_state(edits).collect()}
    assert got == {1: (7.0, 0.0, 0.06), 2: (25000.0, 0.0, 0.1)}


def test_order_ignores_the_session_time_zone(spark):
    """02:45 does not exist in New York on this day; as a zone-less time it still comes before 03:10."""
    rows = [(1, "2024-03-10 02:45:00.5", 1, "set_sip", 5.0), (1, "2024-03-10 03:10:00.25", 2, "set_sip", 7.0)]
    edits = spark.createDataFrame(rows, "user_id BIGINT, ts STRING, seq BIGINT, action STRING, value DOUBLE").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    )
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert state.latest_pool_state(edits).first().monthly_sip == 7.0
        keys = [str(r.k) for r in edits.select(state.order_key().alias("k")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert int(keys[1]) - int(keys[0]) == 1_499_750_000 * 10**19 + 1
