"""Hard negatives by Kronecker-packed products.

Every component x becomes the whole number floor(256 * x). Rows are packed into blocks of at most ``ROWS`` rows; per
component, a block's numbers are biased so that none is negative and set side by side as fields of one wide integer.
An anchor multiplies each of these integers once by its own (biased) component and adds the products up: the fields of the sum
are the scores of all rows of the block, exact once the biases are taken out, because fields are wide enough for the
largest sum that can come up.

1. Blocks are packed where the rows are read, of rows sorted by label within a partition, so that a block has few labels.
2. Anchors, packed the same way, are dealt to every slot; rows' blocks are dealt to the slots in turn. A slot's join
   meets blocks with blocks: a task holds two of them, however many rows a label has.
3. First turn: the best same-label rows of each anchor in each slot, then over all slots: its positives.
4. Second turn: for each positive, the best rows of another label within the window about its score, in each slot, then over all.

Rows without vec_id, label or vector and rows with a null or non-finite component take no part. Vectors of unequal
length are compared as if the shorter one had zeros behind. Rows that repeat a vec_id take part each: as anchors they give rows
each, as candidates they can be chosen each, but no row is a positive of a row with its own vec_id. Ties go by smaller
vec_id. An anchor without positives, or a positive without negatives in its window, gives no rows; an empty table gives none.
Scores that pass 63 bits end at the largest (or smallest) long. Other columns are ignored.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, kernels

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS, ANCHORS = 4096, 256
LARGEST = (1 << 63) - 1
BLOCK = "low long, high long, ids binary, keys binary, labels binary, widths binary, vectors binary, positives binary"
BEST = "key long, anchor_id long, place int, positive_id long, positive_score long, found_id long, score long"


def whole_numbers(numbers: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """floor(256 * x) of rows padded with zeros; Python's own integers where 64 bits might not hold their sums."""
    flat = np.zeros((len(widths), int(widths.max(initial=0))))
    # Row by row, the places that a row has numbers for.
    flat[np.arange(flat.shape[1]) < widths[:, None]] = numbers
    if np.abs(flat).max(initial=0) < 2.0**40:
        return np.floor(flat * 256).astype(np.int64)
    exact = [[int(x) * 256 if abs(x) >= 2.0**53 else math.floor(x * 256) for x in row] for row in flat.tolist()]
    return np.array(exact, dtype=object).reshape(flat.shape)


class PackedRows:
    """Candidates side by side: per component one wide integer, in which every row has a field."""

    def __init__(self, numbers: np.ndarray, anchors: np.ndarray):
        """``anchors``: all that will be multiplied with, for the width of a field."""
        self.rows = len(numbers)
        width = max(numbers.shape[1], anchors.shape[1])
        numbers, self.anchors = _widened(numbers, width), _widened(anchors, width)
        self.bias, self.anchor_bias = -_least(numbers), -_least(self.anchors)
        biased = numbers + self.bias
        top = int(biased.max(initial=0)) * (_most(self.anchors) + self.anchor_bias) * max(width, 1)
        bits = top.bit_length()
        self.field = 4 if bits <= 32 else 8 if bits <= 62 else -(-bits // 8)
        self.sums = numbers.sum(axis=1) if self.rows else np.zeros(0, np.int64)
        self.width = width
        self.packed = [self._set_side_by_side(biased[:, j]) for j in range(width)]

    def _set_side_by_side(self, column: np.ndarray) -> int:
        if self.field <= 8:
            raw = column.astype(np.uint32 if self.field == 4 else np.uint64).tobytes()
        else:
            raw = b"".join(int(v).to_bytes(self.field, "little") for v in column)
        return int.from_bytes(raw, "little")

    def scores(self, i: int) -> np.ndarray:
        """Inner products of anchor ``i`` with every row."""
        biased = (self.anchors[i] + self.anchor_bias).tolist()
        total = 0
        for number, packed in zip(biased, self.packed):
            total += number * packed
        raw = total.to_bytes(self.field * self.rows, "little")
        # (a + A)(c + C) summed is ac + A * sum(c) + C * sum(a + A).
        own = self.bias * sum(biased)
        if self.field <= 8:
            fields = np.frombuffer(raw, np.uint32 if self.field == 4 else np.uint64).astype(np.int64)
            return fields - own - self.anchor_bias * self.sums.astype(np.int64)
        cut = (int.from_bytes(raw[k : k + self.field], "little") for k in range(0, len(raw), self.field))
        exact = (f - own - self.anchor_bias * int(s) for f, s in zip(cut, self.sums))
        return np.array([min(LARGEST, max(-LARGEST - 1, v)) for v in exact], dtype=np.int64)


def _widened(numbers: np.ndarray, width: int) -> np.ndarray:
    missing = width - numbers.shape[1]
    return np.concatenate([numbers, np.zeros((len(numbers), missing), numbers.dtype)], axis=1) if missing else numbers


def _least(numbers: np.ndarray) -> int:
    return int(numbers.min(initial=0))


def _most(numbers: np.ndarray) -> int:
    return int(numbers.max(initial=0))


def best(score: np.ndarray, ids: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores among some places, ties by smaller id."""
    if len(among) > n:
        some = score[among]
        among = among[some >= np.partition(some, len(some) - n)[len(some) - n]]
    return among[np.lexsort((ids[among], ~score[among]))][:n]


# ---- blocks


def usable(vectors: DataFrame, every: int | None = None, modulus: int = 10) -> DataFrame:
    """vec_id, label and vector (doubles) of the rows that take part; where ``every`` divides vec_id, the label moves on by one."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    label = F.col("label").cast("long")
    if every:
        label = F.when(F.col("vec_id") % every == 0, (label + 1) % modulus).otherwise(label)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), vector.alias("vector"))


def packed_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows of (key, vec_id, label, vector, positives); a worker holds one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in kernels.small(batches, size):
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows >= size:
                yield _block(held.slice(0, size))
                held = held.slice(size).combine_chunks()
        if held is not None and held.num_rows:
            yield _block(held)

    ordered = rows.select("key", "vec_id", "label", "vector", "positives").sortWithinPartitions("label")
    return ordered.mapInArrow(run, BLOCK)


def _block(table: pa.Table) -> pa.RecordBatch:
    labels = table["label"].to_numpy()
    vectors, positives = table["vector"].combine_chunks(), table["positives"].to_pylist()
    widths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    numbers = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    counts = [len(p or []) for p in positives]
    listed = [x for p in positives for q in p or [] for x in (q["found_id"], q["score"])]
    arrays = [table["vec_id"].to_numpy(), table["key"].to_numpy(), labels, widths, numbers, np.array(counts + listed, np.int64)]
    values = [int(labels.min()), int(labels.max()), *[a.tobytes() for a in arrays]]
    names = [f.strip().split(" ")[0] for f in BLOCK.split(",")]
    kinds = [pa.int64()] * 2 + [pa.binary()] * 6
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)


class Block:
    def __init__(self, ids: bytes, keys: bytes, labels: bytes, widths: bytes, vectors: bytes, positives: bytes):
        self.ids, self.keys, self.labels = (np.frombuffer(raw, np.int64) for raw in (ids, keys, labels))
        self.numbers = whole_numbers(np.frombuffer(vectors, np.float64), np.frombuffer(widths, np.int64))
        raw = np.frombuffer(positives, np.int64)
        counts, rest = raw[: len(self.ids)], raw[len(self.ids) :].reshape(-1, 2)
        self.positives = np.split(rest, np.cumsum(counts)[:-1])


def _met(anchors: DataFrame, blocks: DataFrame, slots: int) -> DataFrame:
    """Every block of anchors beside every block of rows; slots are dealt evenly."""
    a = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns], F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    place = F.shiftright("number", 33) + F.col("number").bitwiseAND(F.lit((1 << 33) - 1))
    return a.join(blocks.withColumn("slot", F.pmod(place, F.lit(slots)).cast("int")).hint("merge"), "slot")


FOUND = ["key", "anchor_id", "place", "positive_id", "positive_score", "found_id", "score"]


def _best_of_each(found: list[np.ndarray], n: int) -> np.ndarray:
    """Of rows as in FOUND, the ``n`` best of each anchor and place."""
    rows = np.concatenate(found) if found else np.empty((0, len(FOUND)), np.int64)
    key, place, score, ids = rows[:, 0], rows[:, 2], rows[:, 6], rows[:, 5]
    rows = rows[np.lexsort((ids, ~score, place, key))]
    if len(rows):
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 2] != rows[:-1, 2])
        first = np.flatnonzero(new)
        rows = rows[np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows)))) < n]
    return rows


def _searched(pairs: DataFrame, n: int, chosen) -> DataFrame:
    """``chosen(anchor block, i, rows' block)`` yields (place, positive id, positive score, picker of rows by their scores).

    The join gives all blocks of rows for one block of anchors after another. A worker keeps the best for that block of
    anchors alone and gives them out when the next one comes.
    """
    parts = ["ids", "keys", "labels", "widths", "vectors", "positives"]

    def shown(rows: np.ndarray) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(rows[:, k], kind, safe=False) for k, kind in enumerate(kinds)], FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, a, found = None, None, []
        for batch in kernels.small(batches, 1):
            for record in batch.to_pylist():
                if keys != record["a_keys"]:
                    if found:
                        yield shown(_best_of_each(found, n))
                    keys, a, found = record["a_keys"], Block(*[record[f"a_{p}"] for p in parts]), []
                c = Block(*[record[p] for p in parts])
                packed = PackedRows(c.numbers, a.numbers)
                for i in range(len(a.ids)):
                    # An anchor that nothing is looked for needs no product.
                    score = None
                    for place, positive, positive_score, pick in chosen(a, i, c):
                        score = packed.scores(i) if score is None else score
                        at = pick(score)
                        rows = np.empty((len(at), len(FOUND)), np.int64)
                        rows[:, :5] = a.keys[i], a.ids[i], place, positive, positive_score
                        rows[:, 5], rows[:, 6] = c.ids[at], score[at]
                        found.append(rows)
                found = [_best_of_each(found, n)]
        if found:
            yield shown(_best_of_each(found, n))

    found = pairs.select(*[f"a_{p}" for p in parts], *parts).mapInArrow(run, BEST)
    order = Window.partitionBy("key", "place").orderBy(F.col("score").desc(), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(
    vectors: DataFrame, anchors_every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, moved_every: int | None = 7
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id ``anchors_every`` divides. ``low`` and ``high`` are the window's percents of the positive's score.
    """
    spark = vectors.sparkSession
    scratch = common.Scratch(spark, "negatives")
    rows = usable(vectors, moved_every)
    none = F.lit(None).cast("array<struct<found_id: long, score: long>>").alias("positives")
    parts = max(1, min(-(-vectors.count() // ROWS), common.partitions(spark)))
    dealt = rows.repartitionByRange(parts, "label", F.xxhash64("vec_id"), "vec_id")
    blocks = packed_blocks(dealt.select(F.lit(0).cast("long").alias("key"), "*", none), ROWS)
    # The partition's number lies above 33 bits, the block's place in it below.
    blocks = scratch.write(blocks.withColumn("number", F.monotonically_increasing_id()), "blocks")
    own = scratch.write(rows.where(F.col("vec_id") % anchors_every == 0).repartitionByRange(parts, "label", "vec_id"), "anchors")
    own = scratch.write(own.withColumn("key", F.monotonically_increasing_id()), "keyed")
    groups = max(1, -(-own.count() // ANCHORS))

    def same_label(a, i, c):
        among = np.flatnonzero((c.labels == a.labels[i]) & (c.ids != a.ids[i]))
        if len(among):
            yield 0, 0, 0, lambda score: best(score, c.ids, among, positives)

    first = packed_blocks(own.coalesce(groups).withColumn("positives", none), ANCHORS)
    touching = (F.col("a_low") <= F.col("high")) & (F.col("low") <= F.col("a_high"))
    found = _searched(_met(first, blocks, parts).where(touching), positives, same_label)
    found = scratch.write(found.select("key", "rank", "found_id", "score"), "positives", 4)
    listed = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "found_id", "score"))).alias("listed"))
    listed = listed.select("key", F.transform("listed", lambda p: F.struct(p["found_id"].alias("found_id"), p["score"].alias("score"))).alias("positives"))

    def other_label(a, i, c):
        among = np.flatnonzero(c.labels != a.labels[i])
        if not len(among):
            return
        for place, (positive, top) in enumerate(a.positives[i].tolist()):

            def pick(score, top=top):
                # In Python's integers the percents cannot pass 64 bits: ceil(low * top / 100) to floor(high * top / 100).
                least, most = -(-low * top // 100), high * top // 100
                some = score[among]
                return best(score, c.ids, among[(some >= least) & (some <= most)], negatives)

            yield place, positive, top, pick

    with_positives = scratch.write(own.join(listed, "key").repartitionByRange(parts, "label", "vec_id"), "with_positives")
    second = packed_blocks(with_positives.coalesce(groups), ANCHORS)
    found = _searched(_met(second, blocks, parts), negatives, other_label)
    return found.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
