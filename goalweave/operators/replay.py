"""Order-dependent edit logs folded to a final state per user, in parallel even within one user.

Goal toggles are range-partitioned by (user, time), so a user with a third of the log is spread over many partitions. Each
partition condenses its run of a user's edits into one *effect*: a description, of fixed size, of what the run does to
any state it may meet. Goal picks have 821 possible states (ordered lists of up to three out of ten), so an effect is the
list of outcomes. Effects are then applied in order. No task ever holds a user's whole log.

Weights of funds, or of goals, are replayed as basket logs (``basket_log.py``).
"""

from __future__ import annotations

import itertools
import json
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import basket_log
from .shares import MAX_PICKS
from .state import order_key

# The functions below run in Python workers, which need not have this package: they travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = ["user_id", "ts", "seq"]


def _in_order(edits: DataFrame, *columns: str) -> DataFrame:
    """Contiguous, sorted runs of edits; the number of ranges follows spark.sql.shuffle.partitions."""
    ordered = edits.select(*ORDER, *columns).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return ordered.select("user_id", *columns)


def _runs(batches: Iterator[pd.DataFrame], columns: list[str], start, fold, pack) -> Iterator[pd.DataFrame]:
    """Fold each user's consecutive rows, across Arrow batches, and emit one packed effect per user.

    Range partitions are numbered in order, so the partition number orders a user's effects. Only the first user of a
    partition can have earlier rows elsewhere; ``start`` is told which one that is.
    """
    part = TaskContext.get().partitionId()
    user, state, done, first = None, None, [], True
    for batch in batches:
        users = batch["user_id"].to_numpy()
        values = [batch[c].tolist() for c in columns]
        cuts = [0, *(np.flatnonzero(users[1:] != users[:-1]) + 1).tolist(), len(users)]
        for a, b in itertools.pairwise(cuts):
            if a == b:
                continue
            if user is None or users[a] != user:
                if user is not None:
                    done.append((user, part, pack(state)))
                    first = False
                user, state = users[a], start(first, [v[a] for v in values])
            state = fold(state, [v[a:b] for v in values])
        if done:
            yield pd.DataFrame(done, columns=["user_id", "part", "effect"])
            done = []
    if user is not None:
        yield pd.DataFrame([(user, part, pack(state))], columns=["user_id", "part", "effect"])


def _chained(runs: DataFrame) -> DataFrame:
    """Each user's effects in order: at most one per partition, most users having a single one."""
    return runs.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("part", "effect"))).alias("runs"))


# ---- goal picks ------------------------------------------------------------------------------------------


def pick_states(n_goals: int) -> list[tuple[int, ...]]:
    """Every ordered list of at most three different goals, shortest first; the empty list is state 0."""
    return [p for k in range(MAX_PICKS + 1) for p in itertools.permutations(range(n_goals), k)]


def pick_moves(n_goals: int) -> np.ndarray:
    """``moves[goal, state]`` is the state after toggling a goal: off if picked, on if there is room."""
    states = pick_states(n_goals)
    number = {s: i for i, s in enumerate(states)}

    def toggled(s: tuple[int, ...], goal: int) -> tuple[int, ...]:
        if goal in s:
            return tuple(g for g in s if g != goal)
        return s + (goal,) if len(s) < MAX_PICKS else s

    return np.array([[number[toggled(s, g)] for s in states] for g in range(n_goals)], dtype=np.int16)


#: Effects of one user that are composed, or in the end applied, one after another.
FAN_IN = 64


def _composed(runs: DataFrame, ranges: int) -> DataFrame:
    """At most FAN_IN effects per user: neighbouring ones become one, in as many rounds as ``ranges`` calls for.

    An effect lists the outcome for each state; a list of one says that all states end there.
    """

    def after(acc: Column, run: Column) -> Column:
        return F.when(F.size(run) == 1, run).otherwise(F.transform(acc, lambda s: F.get(run, s)))

    while ranges > FAN_IN:
        ranges = -(-ranges // FAN_IN)
        groups = runs.groupBy("user_id", F.floor(F.col("part") / FAN_IN).cast("int").alias("group"))
        listed = groups.agg(F.array_sort(F.collect_list(F.struct("part", "effect"))).alias("runs"))
        first, rest = F.col("runs")[0]["effect"], F.slice("runs", 2, FAN_IN)
        runs = listed.select(
            "user_id", F.col("group").alias("part"), F.aggregate(rest, first, lambda acc, run: after(acc, run["effect"])).alias("effect")
        )
    return runs


def replay_picks(toggles: DataFrame, goal_ids: list[str]) -> DataFrame:
    """Goals each user ends up with, from rows (user_id, ts, seq, goal_no); users left with none give no rows."""
    n_goals = len(goal_ids)

    def effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moves = pick_moves(n_goals)
        tables = moves.tolist()
        every = np.arange(moves.shape[1], dtype=np.int16)

        def fold(state, values):
            rows = moves if isinstance(state, np.ndarray) else tables
            for goal in values[0]:
                state = rows[goal][state]
            return state

        # A user with no earlier rows starts with no picks: one outcome to follow instead of all.
        return _runs(
            batches,
            ["goal_no"],
            lambda first, _: every if first else 0,
            fold,
            lambda state: state.tolist() if isinstance(state, np.ndarray) else [state],
        )

    ordered = _in_order(toggles, "goal_no")
    runs = ordered.mapInPandas(effects, "user_id bigint, part int, effect array<smallint>")
    ranges = int(toggles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chained = _chained(_composed(runs, ranges))
    start = F.lit(0).cast("smallint")
    last = F.aggregate(
        "runs", start, lambda s, run: F.when(F.size(run["effect"]) == 1, run["effect"][0]).otherwise(F.get(run["effect"], s))
    )
    # One literal for all 821 lists; the optimizer folds it to a constant.
    states = json.dumps([[goal_ids[g] for g in s] for s in pick_states(n_goals)])
    names = F.from_json(F.lit(states), "array<array<string>>")
    return chained.select("user_id", F.posexplode(F.get(names, last)).alias("pos", "goal_id")).select(
        "user_id", "goal_id", (F.col("pos") + 1).alias("place")
    )


# ---- fund weights ----------------------------------------------------------------------------------------

#: Members of a basket whose weights are replayed: a preset's funds or a user's goals.
MOST_MEMBERS = 16


def replay_weights(edits: DataFrame, baskets: DataFrame) -> DataFrame:
    """Final percents of each user's basket.

    ``edits`` holds (user_id, ts, seq, member, weight) with members numbered from 0; ``baskets`` holds (user_id, fund_ids,
    weights) as arrays of at most MOST_MEMBERS. Users without edits keep their weights. This is a basket log of weights alone.
    """
    size = F.size("weights")
    fits = F.when(size > MOST_MEMBERS, F.raise_error(F.lit(f"a basket has more than {MOST_MEMBERS} members"))).otherwise(F.lit(MOST_MEMBERS))
    given = F.transform(F.sequence(F.lit(1), fits), lambda k: F.when(k <= size, F.coalesce(F.get("weights", k - 1), F.lit(0.0))))
    log = edits.select(
        "user_id", order_key().alias("order_key"), F.lit(basket_log.WEIGHT).alias("kind"), F.col("member").alias("fund_no"), "weight",
        F.lit(None).cast("array<double>").alias("basket"),
    )
    final = basket_log.replay_baskets(log, baskets.select("user_id", given.alias("basket"), F.col("fund_ids").alias(basket_log.NAMES)), MOST_MEMBERS)
    return final.select("user_id", F.col("name").alias("fund_id"), "weight")


def preset_baskets(users: DataFrame, presets: DataFrame, profile: Column) -> DataFrame:
    """One basket per user from a preset; the three presets are folded to arrays first."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "fund_id", "weight")))
    folded = presets.groupBy("profile").agg(rows.alias("rows"))
    named = users.withColumn("profile", profile).join(F.broadcast(folded), "profile")
    return named.select("user_id", "profile", F.col("rows.fund_id").alias("fund_ids"), F.col("rows.weight").alias("weights"))
