"""Mixing sources to target weights by entropy balancing.

Among all rates per document between 0 and ``cap`` copies that take each source's target of words, the mix uses the one
closest to "every document once" in relative entropy over documents. Its dual is a convex problem with one multiplier
per source, and its solution tilts the rate exponentially with the document's size:

    rate = min(cap, exp(multiplier * size / mean size of the source))

1. Rates depend on source and size alone, so documents are first counted by (source, size): every later step works on
   these counts, of which a source has no more than it has distinct sizes, however many documents it holds.
2. Newton's method solves all sources' duals at once, one grouped aggregation per iteration; a bracket guards each
   source, and the state is written each turn.
3. Rates become copies by carrying fractions along the sizes of a source, largest first: the copies of all sizes down to
   any one add up to within half a copy of their rates; a copy of the size that suits best is then added or taken away, a
   few times at most, to come nearer to the source's target. Within one size the surplus goes to the documents with the
   smallest hashes, counted out bucket by bucket, so that many documents of one size need no common sort.

Only DataFrame operations. Targets: sources in code point order, null last, get the weights in turn and share ``share``
times all words; a target stops at ``cap`` times its source's words and the excess is shared among the others by weight
until none is above. Null or empty texts have size 0 and are taken 0 times. Rows that repeat a doc_id count each; equal
rows (doc_id, source and size) are told apart by nothing and may get different copies. Empty tables give no rows. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Newton ends when every source is this close to its target, relatively, or has no room left to move.
TOLERANCE = 1e-9
MAX_TURNS = 80
#: Buckets of the hash within one (source, size).
BUCKETS = 1024
SETTLING_TURNS = 6
WEIGHTS = (5, 2, 1)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words between ASCII blanks) of each row."""
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD_PATTERN)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"))


def targets(scratch: common.Scratch, counts: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """A row per source: source, source_size, target. One row per source meets in one window, for its place in order."""
    by_source = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))))
    table = scratch.write(by_source.select("source", "source_size", weight.alias("weight")), "sources", 64)
    most = F.col("source_size") * F.lit(float(cap))
    per_weight, budget = 0.0, None
    while True:
        # Full are the sources whose share of what is left would be above their most.
        full = F.col("weight") * per_weight >= most
        row = table.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, most).otherwise(0.0)).alias("used"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        budget = share * (row["all"] or 0)
        following = (budget - row["used"]) / row["open"] if row["open"] else float("inf")
        if not following > per_weight:
            break
        per_weight = following
        if per_weight == float("inf"):
            break
    return table.select("source", "source_size", F.least(most, F.col("weight") * F.lit(per_weight)).alias("target"))


def _rate(multiplier: Column, mean: Column, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(multiplier * F.col("size") / mean, F.lit(700.0))))


def multipliers(scratch: common.Scratch, counts: DataFrame, wanted: DataFrame, cap: float) -> DataFrame:
    """``wanted`` with each source's multiplier and mean size; a source at its cap has multiplier null."""
    means = counts.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = wanted.join(means, wanted["source"].eqNullSafe(means["source"]), "left").drop(means["source"])
    free = (F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * float(cap) * (1 - TOLERANCE))
    state = state.select(
        *wanted.columns,
        "mean",
        F.when(free, F.lit(0.0)).alias("multiplier"),
        F.lit(float("-inf")).alias("low"),
        F.lit(float("inf")).alias("high"),
        F.lit(False).alias("done"),
    )
    state = scratch.write(state, "state", 64)
    for _ in range(MAX_TURNS):
        following = scratch.write(_newton(counts, state, cap), "state", 64)
        left = following.where("multiplier is not null and not done").isEmpty()
        scratch.drop(state)
        state = following
        if left:
            break
    return state.select("source", "source_size", "target", "mean", "multiplier")


def _newton(counts: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    """One turn: gradient and curvature of every source's dual by one grouped sum, then a guarded step."""
    open_ = state.where("multiplier is not null and not done").select(F.col("source").alias("s"), "mean", "multiplier")
    met = counts.where("size > 0").join(open_, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = _rate(F.col("multiplier"), F.col("mean"), cap)
    words = F.col("n") * F.col("size") * rate
    sums = met.groupBy(F.col("source").alias("s")).agg(
        F.sum(words).alias("taken"),
        F.sum(F.when(rate < cap, words * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"),
    )
    m, gap = F.col("multiplier"), F.col("taken") - F.col("target")
    low = F.when(gap < 0, m).otherwise(F.col("low"))
    high = F.when(gap > 0, m).otherwise(F.col("high"))
    step = m - gap / F.col("slope")
    half = F.when(low == float("-inf"), high - 1 - F.abs(high)).when(high == float("inf"), low + 1 + F.abs(low)).otherwise((low + high) / 2)
    inside = (F.col("slope") > 0) & (step > low) & (step < high)
    done = (F.abs(gap) <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0))) | (high - low <= 1e-15 * (1 + F.abs(m)))
    joined = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
    moved = F.when(F.col("s").isNull() & F.col("taken").isNull(), m).when(done, m).when(inside, step).otherwise(half)
    return joined.select(
        "source",
        "source_size",
        "target",
        "mean",
        moved.alias("multiplier"),
        F.coalesce(low, F.col("low")).alias("low"),
        F.coalesce(high, F.col("high")).alias("high"),
        F.coalesce(done, F.col("done")).alias("done"),
    )


def _settled(classes: DataFrame, cap: int) -> DataFrame:
    """A few times over, one copy more or less of the size that brings each source nearest to its target.

    Needs n and ``all_copies`` per (source, size). With many sizes the first time settles it; sources of a few documents
    gain by the others.
    """
    whole_source = Window.partitionBy("source")
    for _ in range(SETTLING_TURNS):
        off = F.col("target") - F.sum(F.col("all_copies") * F.col("size")).over(whole_source)
        classes = classes.withColumn("off", off)
        more = (F.col("off") > 0) & (F.col("all_copies") < F.col("n") * cap)
        less = (F.col("off") < 0) & (F.col("all_copies") > 0)
        left = F.abs(F.abs("off") - F.col("size"))
        classes = classes.withColumn("best", F.min(F.when(more | less, F.struct(left.alias("left"), "size"))).over(whole_source))
        moved = (F.col("best.size") == F.col("size")) & (F.col("best.left") < F.abs("off"))
        step = F.when(moved, F.signum("off")).otherwise(0.0).cast("long")
        classes = classes.withColumn("all_copies", F.col("all_copies") + step)
    return classes.drop("off", "best")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, rate, copies and taken (words)."""
    scratch = common.Scratch(docs.sparkSession, "mixing")
    bucket = common.hash_bucket(F.col("doc_id"), BUCKETS)
    rows = scratch.write(sizes(docs).withColumn("bucket", bucket), "sizes")
    fine = scratch.write(rows.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), "buckets", 4)
    counts = scratch.write(fine.groupBy("source", "size").agg(F.sum("n").alias("n")), "counts", 8)
    solved = multipliers(scratch, counts, targets(scratch, counts, weights, share, cap), cap)

    solved = solved.withColumnRenamed("source", "s")
    rated = counts.join(solved, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("multiplier").isNull(), float(cap))
    rated = rated.withColumn("rate", rate.otherwise(_rate(F.col("multiplier"), F.col("mean"), cap)))
    whole = F.floor("rate")
    loose = F.col("n") * (F.col("rate") - whole)
    # As many rows as a source has distinct sizes.
    down = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    carried = F.sum(loose).over(down)
    surplus = F.floor(carried + 0.5) - F.floor(carried - loose + 0.5)
    all_copies = (F.col("n") * whole + F.least("n", surplus)).cast("long")
    classes = _settled(rated.select("source", "size", "source_size", "target", "rate", "n", all_copies.alias("all_copies")), cap)
    each = F.floor(F.col("all_copies") / F.col("n"))
    classes = classes.select(
        "source", "size", "source_size", "target", "rate", each.alias("whole"), (F.col("all_copies") - each * F.col("n")).alias("surplus")
    )
    classes = scratch.write(classes, "classes", 8)

    # At most BUCKETS rows for each (source, size).
    earlier = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = fine.select("source", "size", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    c = classes.select(F.col("source").alias("cs"), F.col("size").alias("cz"), *classes.columns[2:])
    starts = starts.join(c, F.col("source").eqNullSafe(F.col("cs")) & (F.col("size") == F.col("cz"))).drop("cs", "cz")
    starts = starts.select(F.col("source").alias("bs"), F.col("size").alias("bz"), F.col("bucket").alias("bb"), *starts.columns[3:])
    within = Window.partitionBy("source", "size", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id")
    met = rows.withColumn("at", F.row_number().over(within)).join(
        starts, F.col("source").eqNullSafe(F.col("bs")) & (F.col("size") == F.col("bz")) & (F.col("bucket") == F.col("bb"))
    )
    copies = (F.col("whole") + F.when(F.col("start") + F.col("at") <= F.col("surplus"), 1).otherwise(0)).cast("int")
    met = met.withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(copies))
    return met.select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """``docs`` as the mix takes them: rows with no copy go, rows with several repeat. Rows without doc_id go."""
    taken = mixed(docs.where("doc_id is not null"), weights, share, cap)
    # Rows that repeat a doc_id: each gets the most copies any of them has.
    chosen = taken.groupBy("doc_id").agg(F.max("copies").alias("_copies")).where("_copies > 0")
    repeated = common.met_by_id(docs, chosen).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.select(*docs.columns)
