"""Money-weighted return and net present value.

Flows of one entity are summed per day before anything else, with map-side combining. What is left per entity is one row
per calendar day at most (some 36,500 for a century), however many flows it has; no row or array holds an entity.
Rates are solved by the Arrow batch, for all its entities at once (``rates.py``): flows that first all go one way and then
all the other have one root at most and get there in a few steps, everything else takes the full search. Plans, whose flows
are never laid out as rows, take the full search inside the row, with higher-order functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import is_finite, lit
from . import rates
from .rates import FLAT_SLOPE, HALVINGS, NEWTON_SHIFT, NEWTON_START, NEWTON_STEPS, NEWTON_TOLERANCE, ROOT_TOLERANCE

DAYS_PER_YEAR = 365.0
LOW_RATE, HIGH_RATE = -0.9999, 10.0

# Day numbers of the single-pass net present value count from here; any date near the data will do.
EPOCH = "2000-01-01"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside a lambda body."""
    return F.transform(F.array(value), body)[0]


def npv(flows: Column, rate: Column) -> Column:
    """``flows`` is an array of (t in years, amount). The rate's logarithm is taken once, not once per flow."""

    def total(log_growth: Column) -> Column:
        return F.aggregate(flows, lit(0), lambda s, f: s + f["amount"] * F.exp(f["t"] * log_growth))

    return let(-F.ln(rate + lit(1)), total)


def _bisect(flows: Column, low_value: Column, halvings: int = HALVINGS) -> Column:
    def state(lo, hi, flo, root) -> Column:
        return F.struct(lo.alias("lo"), hi.alias("hi"), flo.alias("flo"), root.alias("root"))

    no_root = F.lit(None).cast("double")

    def narrow(s: Column, mid: Column, value: Column) -> Column:
        return (
            F.when(F.abs(value) < ROOT_TOLERANCE, state(s["lo"], s["hi"], s["flo"], mid))
            .when(s["flo"] * value < 0, state(s["lo"], mid, s["flo"], no_root))
            .otherwise(state(mid, s["hi"], value, no_root))
        )

    def step(s: Column, _: Column) -> Column:
        halved = let((s["lo"] + s["hi"]) / lit(2), lambda mid: let(npv(flows, mid), lambda v: narrow(s, mid, v)))
        return F.when(s["root"].isNotNull(), s).otherwise(halved)

    start = state(lit(LOW_RATE), lit(HIGH_RATE), low_value, no_root)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(halvings)),
        start,
        step,
        lambda s: F.coalesce(s["root"], (s["lo"] + s["hi"]) / lit(2)),
    )


def _newton(flows: Column) -> Column:
    def state(rate, done) -> Column:
        return F.struct(rate.alias("rate"), done.alias("done"))

    def advance(s: Column, nxt: Column) -> Column:
        return (
            F.when(~is_finite(nxt), state(s["rate"], F.lit(True)))
            .when(F.abs(nxt - s["rate"]) < NEWTON_TOLERANCE, state(nxt, F.lit(True)))
            .otherwise(state(F.greatest(lit(LOW_RATE), nxt), F.lit(False)))
        )

    def slope_step(s: Column, value: Column) -> Column:
        slope = (npv(flows, s["rate"] + lit(NEWTON_SHIFT)) - value) / lit(NEWTON_SHIFT)
        moved = lambda d: let(s["rate"] - F.try_divide(value, d), lambda nxt: advance(s, nxt))
        return let(slope, lambda d: F.when(F.abs(d) < FLAT_SLOPE, state(s["rate"], F.lit(True))).otherwise(moved(d)))

    def step(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(let(npv(flows, s["rate"]), lambda value: slope_step(s, value)))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), state(lit(NEWTON_START), F.lit(False)), step, lambda s: s["rate"]
    )


def solve_rate(flows: Column) -> Column:
    """Rate at which the flows are worth nothing: halving when the bracket holds a sign change, else Newton."""

    def choose(fl: Column, low: Column) -> Column:
        ends = low * npv(fl, lit(HIGH_RATE))
        same_sign = ~F.isnan(ends) & (ends > 0)
        return F.when(same_sign, _newton(fl)).otherwise(_bisect(fl, low))

    return let(flows, lambda fl: let(npv(fl, lit(LOW_RATE)), lambda low: choose(fl, low)))


def xirr(flows: DataFrame, key: str = "entity_id", order: str | None = None) -> DataFrame:
    """Money-weighted return per entity from rows (key, flow_date, amount).

    Time counts from the first flow: the earliest date, or the date of the lowest ``order`` when one is given.
    Fewer than two flows, or flows of one sign only, give 0. A null amount counts as 0; flows without a date are left out.
    """
    flows = flows.where("flow_date IS NOT NULL")
    amount = F.col("amount")
    first = F.min("flow_date" if order is None else order)
    per_day = flows.groupBy(key, "flow_date").agg(
        F.coalesce(F.sum(amount), lit(0)).alias("amount"),
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.max(amount), lit(0)).alias("largest"),
        F.coalesce(F.min(amount), lit(0)).alias("smallest"),
        first.alias("first"),
    )
    return rates.rate_per_entity(per_day, key, LOW_RATE, HIGH_RATE, DAYS_PER_YEAR)


def xnpv(flows: DataFrame, rates: list[float], key: str = "entity_id", order: str | None = None) -> DataFrame:
    """Net present value per entity and rate, counted from the first flow.

    Discounting to a fixed epoch and moving the sum to the first flow afterwards needs no look at the first date
    before summing: one aggregate with map-side combining serves all rates, and a hot entity costs nothing extra.
    """
    epoch = F.lit(EPOCH).cast("date")
    years = F.datediff("flow_date", epoch) / lit(DAYS_PER_YEAR)
    origin = F.min("flow_date") if order is None else F.min_by("flow_date", order)
    sums = [F.sum(F.col("amount") * F.pow(lit(1 + r), -years)).alias(f"s{i}") for i, r in enumerate(rates)]
    per_entity = flows.groupBy(key).agg(origin.alias("origin"), *sums)
    shift = F.datediff("origin", epoch) / lit(DAYS_PER_YEAR)
    values = F.array(
        *[
            F.struct(lit(r).alias("rate"), (F.col(f"s{i}") * F.pow(lit(1 + r), shift)).alias("xnpv"))
            for i, r in enumerate(rates)
        ]
    )
    return per_entity.select(key, F.inline(values))


def plan_xirr(plans: DataFrame, start: str) -> DataFrame:
    """Money-weighted return of each plan's own flows: no explode, no shuffle, one entry per month while it is solved.

    Were all months equally long, the answer would be the plan's return compounded over twelve months, so that is where
    the search starts.
    """
    day0 = F.lit(start).cast("date")
    savings, sip, corpus, months = F.col("savings"), F.col("sip"), F.col("projected_corpus"), F.col("months")

    def flow(m: Column) -> Column:
        amount = F.when(m == months, corpus).when(m == 0, -(savings + sip)).otherwise(-sip)
        years = F.datediff(F.add_months(day0, m), day0) / lit(DAYS_PER_YEAR)
        return F.struct(years.alias("t"), amount.alias("amount"))

    guess = F.pow(F.col("blended_return") / lit(12) + lit(1), lit(12)) - lit(1)
    pays_then_gains = (savings + sip > 0) & (sip >= 0) & (corpus > 0)
    pays = (savings + sip > 0) | ((sip > 0) & (months > 1)) | (corpus < 0)
    gains = (corpus > 0) | (savings + sip < 0) | ((sip < 0) & (months > 1))
    once = F.when(pays_then_gains, months)
    quick = rates.rate_of_plans(savings + sip, sip, corpus, once, guess, start, LOW_RATE, HIGH_RATE, DAYS_PER_YEAR)
    full = solve_rate(F.transform(F.sequence(F.lit(0), months), flow))
    rate = F.when(pays & gains, F.coalesce("_quick", full)).otherwise(lit(0))
    return plans.withColumn("_quick", quick).withColumn("xirr", rate).drop("_quick")
