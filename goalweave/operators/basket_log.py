"""A basket's whole edit log: weights set, funds added and removed, presets applied, in order, per user.

A preset replaces the basket, so nothing before a user's last one matters; those edits are dropped before the log is
shuffled. Users are dealt to tasks, and each Arrow batch is folded for all its users at once: the first edits of all users,
then the second ones, and so on, as array operations over a matrix of users and funds.

A user with more edits than a task should fold is *hot*. Such users are found by a count, and their logs are cut into
slices of time, folded side by side in two passes (``basket_effects.py``):

1. Which funds are in the basket, and which of them weigh nothing, depends on nothing else. A slice becomes a short list
   of cases: what it does to any such *pattern*. Cases compose, so the pattern before each slice follows.
2. Given the pattern before it, each edit is linear in the weights up to scale, or its outcome is known. A slice becomes a
   matrix (or a known basket); matrices are multiplied and applied to the user's first basket.

At most ``FAN_IN`` effects meet in one row, in both passes; a user has at most ``FAN_IN`` squared slices.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .basket_effects import (
    ADD,
    PRESET,
    REMOVE,
    START,
    WEIGHT,
    applied,
    basket_of,
    composed_cases,
    edited_cases,
    edited_weights,
    packed_cases,
    pattern_of,
    patterns_along,
    product,
    unchanged,
    unpacked_cases,
)

__all__ = ["ADD", "PRESET", "REMOVE", "START", "WEIGHT", "replay_baskets"]

# The functions below run in Python workers, which need not have this package: they travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAN_IN = 64
#: A task's part of the log is never cut below this.
LEAST_SLICE = 20_000


def _spread(x: np.ndarray, present: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """``rest`` of 100 over the present funds: pro rata, evenly where they weigh nothing."""
    total, n = np.where(present, x, 0).sum(axis=1), present.sum(axis=1)
    with np.errstate(all="ignore"):
        shared = np.where((total > 0)[:, None], x / total[:, None], 1 / np.maximum(n, 1)[:, None])
    return np.where(present, shared * rest[:, None], 0.0)


def edited(x: np.ndarray, has: np.ndarray, kind: np.ndarray, fund: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One edit for each row of ``x`` (weights) and ``has`` (funds in the basket); neither may be a preset."""
    rows = np.arange(len(x))
    mine = np.zeros_like(has)
    mine[rows, fund] = True
    held, n = has[rows, fund], has.sum(axis=1)
    others = has & ~mine

    alone = n <= 1
    fixed = np.where(alone, 100.0, np.clip(weight, 0, 100))
    after_weight = np.where(mine, fixed[:, None], _spread(x, others, 100 - fixed))

    share = 100 / (n + 1)
    after_add = np.where(mine, share[:, None], _spread(x, has, 100 - share))

    left = np.where(others, x, 0).sum(axis=1)
    with np.errstate(all="ignore"):
        after_remove = np.where(others, x / left[:, None] * 100, 0.0)

    weigh, add, remove = (kind == WEIGHT) & held, (kind == ADD) & ~held, (kind == REMOVE) & held
    x = np.where(weigh[:, None], after_weight, np.where(add[:, None], after_add, np.where((remove & (left > 0))[:, None], after_remove, x)))
    has = np.where(add[:, None], has | mine, np.where(remove[:, None], others & (left > 0)[:, None], has))
    return np.where(has, x, 0.0), has


def _firsts(users: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(users[1:] != users[:-1]) + 1])


def _folded(users, kinds, funds, weights, starts, n_funds: int, carried):
    """All users of a batch, in its order: their numbers, weights and funds after the batch."""
    first = _firsts(users)
    count = np.diff(np.append(first, len(users)))
    x, has = np.zeros((len(first), n_funds)), np.zeros((len(first), n_funds), dtype=bool)
    if carried is not None and carried[0] == users[0]:
        x[0], has[0] = carried[1], carried[2]
    for k in range(int(count.max())):
        some = np.flatnonzero(count > k)
        at = first[some] + k
        whole = kinds[at] <= PRESET
        given = starts[at[whole]]
        x[some[whole]], has[some[whole]] = np.nan_to_num(given), ~np.isnan(given)
        some, at = some[~whole], at[~whole]
        if len(some):
            x[some], has[some] = edited(x[some], has[some], kinds[at], funds[at], weights[at])
    return users[first], x, has


def _columns(batch: pa.RecordBatch, n_funds: int) -> list[np.ndarray]:
    """user, kind, fund and weight of a batch from ``_LOG``, and its baskets with NaN for funds that are not in them."""
    users, kinds, funds, weights = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
    starts = np.full((batch.num_rows, n_funds), np.nan)
    given = batch.column(4)
    held = np.flatnonzero(~given.is_null().to_numpy(zero_copy_only=False))
    if len(held):
        flat = given.take(pa.array(held)).flatten().to_numpy(zero_copy_only=False)
        starts[held] = flat.astype(float).reshape(-1, n_funds)
    return [users, kinds, funds.astype(np.int64), weights.astype(float), starts]


_LOG = ["user_id", "kind", "fund_no", "weight", "basket"]
#: A column of baskets: names that go with the user's first row and come back with each weight.
NAMES = "names"


def _start_rows(baskets: DataFrame, *more: Column) -> DataFrame:
    nothing = F.lit(None).cast("decimal(38,0)").alias("order_key")
    return baskets.select("user_id", nothing, F.lit(START).alias("kind"), F.lit(0).alias("fund_no"), F.lit(0.0).alias("weight"), "basket", *more)


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Each key's rows in one task, in the order of the log.

    Dealt by a hash that no join or aggregate deals by. A plain repartition is taken out of the plan where all that is unioned
    comes from shuffles by the same key, and adaptive execution is then free to read those in ways that part a key's rows.
    """
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, F.col("order_key").asc_nulls_first())


def _cold(log: DataFrame, baskets: DataFrame, n_funds: int) -> DataFrame:
    """Users whose edits fit a task each."""
    named = [c for c in baskets.columns if c == NAMES]
    start = _start_rows(baskets, *[F.col(c) for c in named])
    rows = log.select(*[c for c in start.columns if c != NAMES]).unionByName(start, allowMissingColumns=True)
    ordered = _dealt(rows, "user_id").select(*_LOG, *named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = _columns(batch, n_funds)
            users, x, has = _folded(*columns, n_funds, carried)
            # A user's names are on its first row, which may have been in an earlier batch.
            names = batch.column(len(_LOG)).take(pa.array(_firsts(columns[0]))) if named else None
            if carried is not None and carried[0] != users[0]:
                yield _shown(*carried)
            elif carried is not None and named:
                names = pa.concat_arrays([carried[3], names.slice(1)])
            carried = users[-1:], x[-1:], has[-1:], names.slice(len(users) - 1) if named else None
            if len(users) > 1:
                yield _shown(users[:-1], x[:-1], has[:-1], names.slice(0, len(users) - 1) if named else None)
        if carried is not None:
            yield _shown(*carried)

    return ordered.mapInArrow(run, "user_id bigint, fund_no int, weight double" + (", name string" if named else ""))


def _shown(users: np.ndarray, x: np.ndarray, has: np.ndarray, names: pa.Array | None) -> pa.RecordBatch:
    user, fund = np.nonzero(has)
    if names is not None:
        sizes = names.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        known = fund < sizes[user]
        user, fund = user[known], fund[known]
    columns = [pa.array(users[user], pa.int64()), pa.array(fund, pa.int32()), pa.array(x[user, fund])]
    if names is None:
        return pa.RecordBatch.from_arrays(columns, ["user_id", "fund_no", "weight"])
    columns.append(names.flatten().take(pa.array((np.cumsum(sizes) - sizes)[user] + fund)))
    return pa.RecordBatch.from_arrays(columns, ["user_id", "fund_no", "weight", "name"])


# ---- hot users


def hot_cuts(log: DataFrame, partitions: int) -> list[tuple[int, list[float]]]:
    """Users that are cut, each with the ascending times (as doubles) at which its slices but the first begin.

    A user is cut where it has more than two even parts of the log; there are fewer such users, and not more than twice as
    many slices, than the session has partitions.
    """
    counts = log.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").alias("total"), F.max("n").alias("most")
    row = counts.agg(*total).first()
    each = max(LEAST_SLICE, (row["total"] or 0) // (2 * partitions))
    if (row["most"] or 0) <= 2 * each:
        return []
    cuts = []
    hot = {r["user_id"]: r["n"] for r in counts.where(F.col("n") > 2 * each).collect()}
    slices = {u: min(FAN_IN * FAN_IN, -(-n // each)) for u, n in hot.items()}
    # One grouped sketch of all hot users' times at the finest of their steps; each takes every so manieth of its own.
    finest = max(slices.values())
    at = [k / finest for k in range(1, finest)]
    times = log.where(F.col("user_id").isin(list(hot))).groupBy("user_id")
    for r in times.agg(F.percentile_approx(F.col("order_key").cast("double"), at, 20 * finest).alias("at")).collect():
        own = slices[r["user_id"]]
        cuts.append((r["user_id"], sorted({r["at"][finest * k // own - 1] for k in range(1, own)})))
    return sorted(cuts)


def _in_slices(rows: DataFrame) -> DataFrame:
    return _dealt(rows, "user_id", "slice").select("slice", *_LOG)


def _per_slice(rows: DataFrame, begin, edit, pack, kind: str, n_funds: int) -> DataFrame:
    """(user_id, slice, effect): ``begin()`` is given all edits of a slice, a batch at a time, through ``edit(state, columns)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            slices = batch.column(0).to_numpy(zero_copy_only=False)
            columns = _columns(batch.select(range(1, len(_LOG) + 1)), n_funds)
            users = columns[0]
            cuts = [0, *(np.flatnonzero((users[1:] != users[:-1]) | (slices[1:] != slices[:-1])) + 1).tolist(), len(users)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                mine = int(users[a]), int(slices[a])
                if key is not None and key != mine:
                    yield packed(key, held)
                if key != mine:
                    key, held = mine, begin()
                held = edit(held, [c[a:b] for c in columns[1:]])
        if key is not None:
            yield packed(key, held)

    def packed(key, held) -> pa.RecordBatch:
        kind_of = pa.binary() if kind == "binary" else pa.list_(pa.float64())
        columns = [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([pack(held)], kind_of)]
        return pa.RecordBatch.from_arrays(columns, ["user_id", "slice", "effect"])

    return _in_slices(rows).mapInArrow(run, f"user_id bigint, slice int, effect {kind}")


def _grouped(parts: DataFrame) -> DataFrame:
    """(user_id, group, list): at most FAN_IN neighbouring effects of a user in a row."""
    group = F.floor(F.col("slice") / FAN_IN).cast("int").alias("group")
    return parts.groupBy("user_id", group).agg(F.array_sort(F.collect_list(F.struct("slice", "effect"))).alias("list"))


def _patterns_before(rows: DataFrame, first: DataFrame, n_funds: int) -> DataFrame:
    """(user_id, slice, pattern): the pattern before each slice, from each hot user's first one."""
    cases = _per_slice(rows, lambda: unchanged(n_funds), edited_cases, packed_cases, "binary", n_funds)

    @F.pandas_udf("binary")
    def composed(lists: pd.Series) -> pd.Series:
        return pd.Series([packed_cases(composed_cases([unpacked_cases(e, n_funds) for e in some], n_funds)) for some in lists])

    @F.pandas_udf("array<binary>")
    def before_each(starts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([patterns_along(s, [unpacked_cases(e, n_funds) for e in some]) for s, some in zip(starts, lists)])

    grouped = _grouped(cases)
    whole = grouped.select("user_id", F.col("group").alias("slice"), composed("list.effect").alias("effect"))
    per_user = whole.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("slice", "effect"))).alias("list")).join(first, "user_id")

    def laid_out(table: DataFrame, number: str) -> DataFrame:
        along = table.withColumn("before", before_each("pattern", "list.effect"))
        pairs = F.arrays_zip(F.col("list.slice").alias("at"), F.col("before").alias("pattern"))
        return along.select("user_id", F.inline(pairs)).select("user_id", F.col("at").alias(number), "pattern")

    before_groups = laid_out(per_user, "group")
    return laid_out(grouped.join(before_groups, ["user_id", "group"]), "slice")


def _hot(log: DataFrame, baskets: DataFrame, n_funds: int) -> DataFrame:
    """``log`` has a slice; ``baskets`` has a row for each hot user."""

    @F.pandas_udf("binary")
    def pattern(given: pd.Series) -> pd.Series:
        return pd.Series([pattern_of(b) for b in given])

    @F.pandas_udf("array<double>")
    def as_basket(patterns: pd.Series) -> pd.Series:
        return pd.Series([basket_of(p) for p in patterns])

    rows = log.select("user_id", "order_key", "kind", "fund_no", "weight", "basket", "slice")
    first = baskets.select("user_id", pattern("basket").alias("pattern"))
    before = _patterns_before(rows, first, n_funds)
    starts = _start_rows(before.select("user_id", "slice", as_basket("pattern").alias("basket")), F.col("slice"))
    per_slice = _per_slice(rows.unionByName(starts), lambda: None, lambda e, c: edited_weights(e, c, n_funds), lambda e: e.packed(), "array<double>", n_funds)

    @F.pandas_udf("array<double>")
    def as_one(lists: pd.Series) -> pd.Series:
        return pd.Series([product(some, n_funds) for some in lists])

    @F.pandas_udf("array<double>")
    def final_weights(given: pd.Series, effect: pd.Series) -> pd.Series:
        return pd.Series([applied(b, e, n_funds) for b, e in zip(given, effect)])

    groups = _grouped(per_slice).select("user_id", F.col("group").alias("slice"), as_one("list.effect").alias("effect"))
    whole = _grouped(groups).select("user_id", as_one("list.effect").alias("effect"))
    named = [c for c in baskets.columns if c == NAMES]
    final = whole.join(baskets, "user_id").select("user_id", F.posexplode(final_weights("basket", "effect")).alias("fund_no", "weight"), *named)
    final = final.where("weight IS NOT NULL")
    if not named:
        return final
    return final.where(F.col("fund_no") < F.size(NAMES)).select("user_id", "fund_no", "weight", F.get(NAMES, F.col("fund_no")).alias("name"))


def replay_baskets(edits: DataFrame, baskets: DataFrame, n_funds: int) -> DataFrame:
    """(user_id, fund_no, weight) of each user's basket after the log.

    ``edits``: user_id, order_key, kind (PRESET, WEIGHT, ADD or REMOVE), fund_no, weight and, for presets, ``basket``: an
    array of a weight per fund, null for funds that are not in it. ``baskets``: user_id and such an array, one per user.
    Where ``baskets`` has ``names``, an array per user by fund_no, rows have the ``name`` too and those without one fall away: names
    take the way of the log, so no table of users and funds is joined or broadcast.
    A weight set for a fund that the basket does not hold, and adding one it holds, change nothing. A user without a basket
    starts with an empty one. Counting the log to find hot users is a job of its own, run here.
    """
    since = edits.where(F.col("kind") == PRESET).groupBy("user_id").agg(F.max("order_key").alias("since"))
    later = edits.join(since, "user_id", "left").where("since IS NULL OR order_key >= since").drop("since")
    cuts = hot_cuts(later, int(edits.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if not cuts:
        return _cold(later, baskets, n_funds)
    # Fewer rows than the session has partitions, all of them literals.
    table = edits.sparkSession.createDataFrame(cuts, "user_id bigint, cuts array<double>")
    sliced = later.join(F.broadcast(table), "user_id", "left")
    hot = sliced.where("cuts IS NOT NULL").withColumn("slice", F.size(F.filter("cuts", lambda c: c <= F.col("order_key").cast("double"))))
    empty = F.array(*[F.lit(None).cast("double")] * n_funds)
    starts = baskets.join(F.broadcast(table.select("user_id")), "user_id")
    starts = table.select("user_id").join(starts, "user_id", "left").withColumn("basket", F.coalesce("basket", empty))
    others = baskets.join(F.broadcast(table.select("user_id")), "user_id", "left_anti")
    return _cold(sliced.where("cuts IS NULL").drop("cuts"), others, n_funds).unionByName(_hot(hot.drop("cuts"), starts, n_funds))
