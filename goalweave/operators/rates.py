"""Internal rates of many entities at once, in Python workers. The code travels with the job."""

from __future__ import annotations

import datetime
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEPS, CLOSE = 200, 1e-13
#: Flows that are worked on at once.
CHUNK = 400_000

HALVINGS, ROOT_TOLERANCE = 200, 1e-6
NEWTON_STEPS = 100
NEWTON_START, NEWTON_SHIFT, NEWTON_TOLERANCE, FLAT_SLOPE = 0.1, 1e-6, 1e-8, 1e-12


def roots(years: np.ndarray, amounts: np.ndarray, counts: np.ndarray, guess: np.ndarray, low: float, high: float) -> np.ndarray:
    """One rate per row of ``counts`` flows each: Newton steps inside a bracket that halves when a step leaves it.

    NaN where the value has the same sign at both ends of the bracket, or no sign at all.
    """
    found = np.full(len(counts), np.nan)
    rows = np.flatnonzero(counts > 0)
    counts = counts[rows]

    def values(rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.cumsum(counts) - counts
        with np.errstate(all="ignore"):
            worth = amounts * np.exp(-years * np.repeat(np.log1p(rate), counts))
            return np.add.reduceat(worth, starts), -np.add.reduceat(worth * years, starts) / (1 + rate)

    if not len(rows):
        return found
    lo, hi = np.full(len(rows), low), np.full(len(rows), high)
    side, other = np.sign(values(lo)[0]), np.sign(values(hi)[0])
    rate = np.where(np.isfinite(guess[rows]), np.clip(guess[rows], low + 1e-6, high - 1e-6), 0.1)
    keep = side * other < 0
    for _ in range(STEPS):
        if not keep.all():
            flows = np.repeat(keep, counts)
            years, amounts, counts = years[flows], amounts[flows], counts[keep]
            rows, lo, hi, side, rate = rows[keep], lo[keep], hi[keep], side[keep], rate[keep]
        if not len(rows):
            break
        value, slope = values(rate)
        right = np.sign(value) == side
        lo, hi = np.where(right, rate, lo), np.where(right, hi, rate)
        with np.errstate(all="ignore"):
            step = rate - value / slope
        following = np.where((step > lo) & (step < hi), step, (lo + hi) / 2)
        following = np.where(value == 0, rate, following)
        found[rows] = following
        keep = np.abs(following - rate) > CLOSE * (1 + np.abs(rate))
        rate = following
    return found


def _in_chunks(counts: np.ndarray):
    """Row ranges of about CHUNK flows."""
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK)))
        yield at, end
        at = end


class _Worth:
    """Present values of a few entities' flows, each at its own rate; entities drop out as they are done."""

    def __init__(self, years: np.ndarray, amounts: np.ndarray, counts: np.ndarray):
        self.years, self.amounts, self.counts = years, amounts, counts

    def __call__(self, rate: np.ndarray) -> np.ndarray:
        starts = np.cumsum(self.counts) - self.counts
        with np.errstate(all="ignore"):
            return np.add.reduceat(self.amounts * np.exp(self.years * np.repeat(-np.log(rate + 1), self.counts)), starts)

    def only(self, keep: np.ndarray) -> "_Worth":
        flows = np.repeat(keep, self.counts)
        return _Worth(self.years[flows], self.amounts[flows], self.counts[keep])


def searched(years: np.ndarray, amounts: np.ndarray, counts: np.ndarray, low: float, high: float) -> np.ndarray:
    """One rate per entity of ``counts`` flows each (none has 0): halving where the bracket holds a sign change, else Newton."""
    worth = _Worth(years, amounts, counts)
    at_low = worth(np.full(len(counts), low))
    ends = at_low * worth(np.full(len(counts), high))
    same = ~np.isnan(ends) & (ends > 0)
    found = np.empty(len(counts))
    found[same] = _open_search(worth.only(same), low) if same.any() else 0
    found[~same] = _halved(worth.only(~same), at_low[~same], low, high) if not same.all() else 0
    return found


def _halved(worth: _Worth, at_low: np.ndarray, low: float, high: float) -> np.ndarray:
    found, rows = np.empty(len(at_low)), np.arange(len(at_low))
    lo, hi = np.full(len(rows), low), np.full(len(rows), high)
    for _ in range(HALVINGS):
        middle = (lo + hi) / 2
        value = worth(middle)
        with np.errstate(all="ignore"):
            left = at_low * value < 0
            done = np.abs(value) < ROOT_TOLERANCE
        lo, hi, at_low = np.where(left, lo, middle), np.where(left, middle, hi), np.where(left, at_low, value)
        found[rows] = middle
        if done.any():
            keep = ~done
            worth, rows, lo, hi, at_low = worth.only(keep), rows[keep], lo[keep], hi[keep], at_low[keep]
            if not len(rows):
                return found
    found[rows] = (lo + hi) / 2
    return found


def _open_search(worth: _Worth, low: float) -> np.ndarray:
    rate = np.full(len(worth.counts), NEWTON_START)
    found, rows = rate.copy(), np.arange(len(rate))
    for _ in range(NEWTON_STEPS):
        value = worth(rate)
        with np.errstate(all="ignore"):
            slope = (worth(rate + NEWTON_SHIFT) - value) / NEWTON_SHIFT
            following = rate - value / slope
            stuck = (np.abs(slope) < FLAT_SLOPE) | ~np.isfinite(following)
            close = ~stuck & (np.abs(following - rate) < NEWTON_TOLERANCE)
        rate = np.where(stuck, rate, np.where(close, following, np.maximum(low, following)))
        found[rows] = rate
        keep = ~(stuck | close)
        worth, rows, rate = worth.only(keep), rows[keep], rate[keep]
        if not len(rows):
            break
    return found


def _solved(days: pa.Table, key: str, low: float, high: float, year: float) -> pa.RecordBatch:
    """Rates of entities whose days lie together, ordered by date."""
    keys = days[key].combine_chunks()
    date = days["flow_date"].cast(pa.int32()).to_numpy().astype(np.int64)
    amount, n, largest, smallest = (days[c].to_numpy().astype(float) for c in ("amount", "n", "largest", "smallest"))
    number = keys.dictionary_encode().indices.to_numpy()
    starts = np.concatenate([[0], np.flatnonzero(number[1:] != number[:-1]) + 1])
    counts = np.diff(np.append(starts, len(number)))
    entity = np.repeat(np.arange(len(starts)), counts)

    # The day whose first flow comes first of all.
    rank = np.argsort(days["first"].to_numpy(), kind="stable").argsort(kind="stable")
    first = np.lexsort((rank, entity))[starts]
    years = (date - np.repeat(date[first], counts)) / year

    far = np.iinfo(np.int64).max
    paid, got = smallest < 0, largest > 0
    extent = lambda some: (
        np.maximum.reduceat(np.where(some, date, -far), starts), np.minimum.reduceat(np.where(some, date, far), starts)
    )
    (last_paid, first_paid), (last_got, first_got) = extent(paid), extent(got)
    flows = np.add.reduceat(n, starts).astype(np.int64)
    solvable = (flows >= 2) & (last_paid > -far) & (last_got > -far)
    one_change = (last_paid <= first_got) | (last_got <= first_paid)

    rate = np.zeros(len(starts))
    for i, j in _in_chunks(counts):
        some = slice(starts[i], starts[i] + counts[i:j].sum())
        t, a, c = years[some], amount[some], counts[i:j]
        once = solvable[i:j] & one_change[i:j]
        quick = roots(t, a, np.where(once, c, 0), np.full(j - i, 0.1), low, high) if once.all() else _roots_of(once, t, a, c, low, high)
        rate[i:j] = np.where(once, quick, 0.0)
        rest = solvable[i:j] & ~(once & np.isfinite(quick))
        if rest.any():
            part = np.repeat(rest, c)
            rate[np.arange(i, j)[rest]] = searched(t[part], a[part], c[rest], low, high)
    return pa.RecordBatch.from_arrays([keys.take(pa.array(starts)), pa.array(flows), pa.array(rate)], [key, "n", "xirr"])


def _roots_of(some: np.ndarray, years: np.ndarray, amounts: np.ndarray, counts: np.ndarray, low: float, high: float) -> np.ndarray:
    found, flows = np.full(len(some), np.nan), np.repeat(some, counts)
    found[some] = roots(years[flows], amounts[flows], counts[some], np.full(some.sum(), 0.1), low, high)
    return found


def rate_per_entity(days: DataFrame, key: str, low: float, high: float, year: float) -> DataFrame:
    """(key, n, xirr) from one row per entity and day: flow_date, amount, n, largest, smallest, first.

    Days are dealt by entity and sorted; a worker solves the entities of an Arrow batch together and carries on the days of
    the one that the batch ends in.
    """
    columns = [key, "flow_date", "amount", "n", "largest", "smallest", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            number = keys.dictionary_encode().indices.to_numpy()
            cut = int(np.flatnonzero(number == number[-1])[0])
            if held and keys[0] != held[-1].column(0)[-1]:
                yield _solved(pa.Table.from_batches(held), key, low, high, year)
                held = []
            if cut:
                yield _solved(pa.Table.from_batches([*held, batch.slice(0, cut)]), key, low, high, year)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield _solved(pa.Table.from_batches(held), key, low, high, year)

    dealt = days.select(*columns).repartition(key).sortWithinPartitions(key, "flow_date")
    kind = days.schema[key].dataType.simpleString()
    return dealt.mapInArrow(run, f"`{key}` {kind}, n bigint, xirr double")


def month_offsets(start: str, months: int) -> np.ndarray:
    """Days from ``start`` to the same day of each following month, or to the month's last day where it is shorter."""
    day = datetime.date.fromisoformat(start)
    month = np.datetime64(day, "M") + np.arange(months + 1)
    first = month.astype("datetime64[D]")
    length = ((month + 1).astype("datetime64[D]") - first).astype(np.int64)
    return (first + np.minimum(day.day, length) - 1 - np.datetime64(day, "D")).astype(np.int64)


def rate_of_plans(first: Column, monthly: Column, corpus: Column, months: Column, guess: Column, start: str, low: float, high: float, year: float) -> Column:
    """Rate of plans that pay ``first`` at the start and ``monthly`` each month, and give ``corpus`` in the last month."""

    @F.arrow_udf("double")
    def solved(f: pa.Array, s: pa.Array, c: pa.Array, m: pa.Array, g: pa.Array) -> pa.Array:
        begin, regular, final, at = (x.to_numpy(zero_copy_only=False).astype(np.float64) for x in (f, s, c, g))
        counts = m.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        years = month_offsets(start, int(counts.max(initial=1))) / year
        parts = [np.empty(0)]
        for i, j in _in_chunks(counts):
            n = counts[i:j]
            ends = np.cumsum(n)
            month = np.arange(ends[-1]) - np.repeat(ends - n, n)
            amounts = -np.repeat(regular[i:j], n)
            held = n > 0
            amounts[(ends - n)[held]] = -begin[i:j][held]
            amounts[ends[held] - 1] = final[i:j][held]
            parts.append(roots(years[month], amounts, n, at[i:j], low, high))
        return pa.array(np.concatenate(parts), pa.float64(), from_pandas=True)

    return solved(first, monthly, corpus, months, guess)
