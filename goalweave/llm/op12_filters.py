"""Filter interaction audit: what each of five filters removes in every order in which they can be applied.

1. A document's failures are one mask of five bits. Filters A to D read the text alone; E (a copy) fails where a smaller
   doc_id has the same text. The smallest id of each text is a combined aggregate, and documents meet it by (text's
   digest, id), a key that no group of copies makes hot.
2. Documents are counted by (part, mask): at most 32 cells a part, however many documents it has.
3. Every part's cells are brought together and the 32 subsets of filters are walked in Gray code order, one filter
   toggled at a time. Each cell keeps a counter of the active filters that it fails; where that leaves or reaches 0 the
   cell leaves or joins the running survivors. The survivors of all 32 subsets are stored (all parts of a batch at once).
4. A step of an order is the difference of two stored subsets; 120 orders of 5 steps are read off, nothing is applied again.

Filters (words lie between ASCII blanks and are compared as they are): A under 200 words; B 100 * distinct words < 50 *
words; C 100 * capitals A-Z > 2 * code points; D holds one of ``#$%&*|``; E identical to the text of a smaller doc_id
anywhere in the table, removed or not. Two texts count as identical where length and SHA-256 are.

A null text counts as empty, a null part as the empty string. A row without doc_id is no copy of anything and nothing is
a copy of it; it has no labels. Rows that repeat a doc_id count each, and are no copies of one another. Of several
labels for one id, one saying 1 suffices; labels without id are skipped. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, kernels

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
LEAST_WORDS = 200
LEAST_VARIETY = 50
MOST_CAPITALS = 2
SYMBOLS = "[#$%&*|]"
#: What is counted of a cell: documents, those of good quality, toxic ones.
COUNTS = ("n", "good", "toxic")
#: Parts that a worker walks at once; each has 600 rows of results.
PARTS_AT_ONCE = 50
SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: filters A to D on a text that is not null."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    fails = [
        n < LEAST_WORDS,
        100 * kinds < LEAST_VARIETY * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text),
        F.rlike(text, F.lit(SYMBOLS)),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, part, mask (bit i for the i-th filter failed), good and toxic (0 or 1)."""
    scratch = common.Scratch(docs.sparkSession, "filters")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    digest = F.concat(F.unhex(F.sha2("text", 256)), F.unhex(F.lpad(F.hex(F.octet_length("text").cast("long")), 16, "0")))
    rows = scratch.write(rows.select("doc_id", "part", text_failures(F.col("text")).alias("mask"), digest.alias("digest")), "rows", 2)

    firsts = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    marked = rows.join(firsts, ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    one = lambda name: F.max((F.col(name) == 1).cast("int")).alias(name)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic"))
    met = marked.join(known, "doc_id", "left")
    return met.select(
        "doc_id",
        "part",
        (F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"),
        F.coalesce("quality", F.lit(0)).alias("good"),
        F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )


def cells(marked: DataFrame) -> DataFrame:
    """(part, mask) with its counts; rows are combined before they are shuffled."""
    return marked.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic")
    )


def walked(counts: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters; ``counts`` and the result are (parts, 32, figures), by mask and by subset."""
    states = np.empty_like(counts)
    masks = np.arange(CELLS)
    active_failures = np.zeros(CELLS, np.int64)
    survivors = counts.sum(axis=1)
    subset = 0
    states[:, subset] = survivors
    for turn in range(1, CELLS):
        toggled = (turn & -turn).bit_length() - 1
        subset ^= 1 << toggled
        failing = (masks >> toggled & 1).astype(bool)
        if subset >> toggled & 1:
            leaving = failing & (active_failures == 0)
            active_failures[failing] += 1
            survivors = survivors - counts[:, leaving].sum(axis=1)
        else:
            active_failures[failing] -= 1
            joining = failing & (active_failures == 0)
            survivors = survivors + counts[:, joining].sum(axis=1)
        states[:, subset] = survivors
    return states


def orders() -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders by name, and the filter and the subset before each of their steps: (orders, steps) each."""
    names = ["".join(p) for p in itertools.permutations(FILTERS)]
    at = np.array([[FILTERS.index(c) for c in name] for name in names])
    before = np.cumsum(1 << at, axis=1) - (1 << at)
    return names, at, before


def steps(parts: list[str], counts: np.ndarray) -> pa.RecordBatch:
    """The audit's rows for these parts."""
    states = walked(counts)
    names, at, before = orders()
    gone = states[:, before] - states[:, before | (1 << at)]  # parts, orders, steps, figures
    masks = np.arange(CELLS)
    failing = np.stack([counts[:, masks >> f & 1 == 1, 0].sum(axis=1) for f in range(len(FILTERS))], axis=1)
    alone = counts[:, 1 << np.arange(len(FILTERS)), 0]
    shapley = np.stack([np.where(at == f, gone[..., 0], 0).sum(axis=(1, 2)) for f in range(len(FILTERS))], axis=1)
    per_part = at.size
    columns = [
        np.repeat(np.array(parts, dtype=object), per_part),
        np.tile(np.repeat(np.array(names, dtype=object), at.shape[1]), len(parts)),
        np.tile(np.arange(1, at.shape[1] + 1, dtype=np.int32), len(parts) * len(names)),
        states[:, before | (1 << at), 0].ravel(),
        gone[..., 0].ravel(),
        (failing[:, at] - gone[..., 0]).ravel(),
        alone[:, at].ravel(),
        gone[..., 1].ravel(),
        gone[..., 2].ravel(),
        shapley[:, at].ravel(),
    ]
    fields = [f.strip().split(" ")[0] for f in SCHEMA.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], fields)


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """600 rows per part: every order of the filters, every step of it."""
    counted = cells(failures(docs, labels, part))
    # At most 32 cells a part.
    gathered = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.small(batches, PARTS_AT_ONCE):
            parts = batch.column(0).to_pylist()
            counts = np.zeros((len(parts), CELLS, len(COUNTS)), np.int64)
            for i, found in enumerate(batch.column(1).to_pylist()):
                for cell in found:
                    counts[i, cell["mask"]] = [cell[c] for c in COUNTS]
            yield steps(parts, counts)

    return gathered.mapInArrow(run, SCHEMA)
