"""MinHash near-dedup: universal hash minima, banding, verification and connected components.

A document's set holds its distinct runs of ``width`` words (A-Z lower-cased, words between ASCII blanks); with fewer
words the whole sequence is its one element. Two documents are linked when 100 * intersection >= ``percent`` * union,
counted on the full sets.

1. One pass over the text gives each document 128 minima of universal hashes and a 128-bit key of its set. Documents of
   equal sets are one class from here on, represented by the smallest id.
2. 32 bands of 4 minima propose candidates: a pair at 0.8 is missed with probability (1 - 0.8^4)^32 = 5e-8.
3. No bucket is expanded into pairs. Members are linked to the smallest id of their bucket, in the 4-minima bands and, for
   those that share one, in narrower bands of 8 and 16 minima, where close copies meet. Links are verified on full sets.
4. Components come from alternating large-star and small-star.
5. The rest is done exactly: in buckets that still hold several components, every member outside the bucket's largest
   component meets all the others. Step 3 has left each member's difference from the bucket's smallest id, mostly a few
   shingles; two such differences give the distance of the two sets, so the join's own condition is the exact one and
   only links become rows (they are verified on full sets once more, as differences are kept as 31-bit hashes).

Nulls: a null text is an empty set; empty sets link with nothing. A null doc_id links with nothing and keeps a null
component. Repeated rows of one doc_id are one node and return one row each. Other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, kernels

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HASHES = 128
ROWS = 4
#: (first minimum, number of minima) of each band.
BANDS = [(i, ROWS) for i in range(0, HASHES, ROWS)]
NARROW_BANDS = [(i, 8) for i in range(0, HASHES, 8)] + [(i, 16) for i in range(0, HASHES, 16)]
CHUNK = 2048


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of words."""
    words = kernels.as_bytes(text).lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    n = min(width, len(words))
    place = kernels.odd_numbers(8, width + 1)
    hashes = kernels.word_hashes(words)
    total = np.repeat(place[width:] * np.uint64(n), len(words) - n + 1)
    for i in range(n):
        total += hashes[i : len(words) - n + 1 + i] * place[i]
    return np.unique(kernels.mixed(total))


def _signature(items: np.ndarray, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """The minimum of each hash a * x + b, of which the upper 32 bits count (multiply-shift)."""
    least = np.full(len(times), 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(items), CHUNK):
        part = items[i : i + CHUNK, None] * times[None, :]
        part += plus[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


SIGNATURES = "doc_id long, n_shingles long, set_hi long, set_lo long, signature array<int>"


def signatures(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, plus = kernels.odd_numbers(18, HASHES), kernels.odd_numbers(28, HASHES)
        salt = kernels.odd_numbers(38, 1)
        for batch in kernels.small(batches):
            counts, high, low, minima = [], [], [], []
            for text in batch.column(1).to_pylist():
                items = shingles(text, width)
                counts.append(len(items))
                high.append(np.bitwise_xor.reduce(kernels.mixed(items * salt)) if len(items) else np.uint64(0))
                low.append(items.sum(dtype=np.uint64))
                minima.append(_signature(items, times, plus))
            flat = np.concatenate(minima) if minima else np.empty(0, dtype=np.int32)
            offsets = np.arange(0, len(flat) + 1, HASHES, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(kernels.signed(np.array(high, dtype=np.uint64))),
                    pa.array(kernels.signed(np.array(low, dtype=np.uint64))),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                ["doc_id", "n_shingles", "set_hi", "set_lo", "signature"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SIGNATURES)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.small(batches):
            sets = [kernels.signed(shingles(t, width)) for t in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, dtype=np.int64)
            items = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), items], ["doc_id", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, items array<long>")


def _band_keys(reps: DataFrame, bands: list[tuple[int, int]]) -> DataFrame:
    keys = [F.xxhash64(F.lit(n), F.slice("signature", first + 1, n)) for first, n in bands]
    return reps.select("doc_id", F.posexplode(F.array(*keys)).alias("band", "key"))


def _shared(keys: DataFrame) -> DataFrame:
    """Band keys with more than one member, the smallest member and the number of members."""
    found = keys.groupBy("band", "key").agg(
        F.min("doc_id").alias("pivot"), F.max("doc_id").alias("_last"), F.count(F.lit(1)).alias("size")
    )
    return found.where("pivot < _last").drop("_last")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("doc_id").alias("u"), F.col("items").alias("a"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("items").alias("b"))
    return pairs.join(left, "u").join(right, "v")


def _near_enough(total: Column, apart: Column, percent: int) -> Column:
    """100 * intersection >= percent * union, by the sum of both sizes and the size of the symmetric difference."""
    return total * (100 - percent) >= apart * (100 + percent)


def _checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each pair with ``linked``, the size of u's set and, as 31-bit hashes, the symmetric difference of the two sets."""
    difference = F.concat(F.array_except("a", "b"), F.array_except("b", "a"))
    linked = _near_enough(F.size("a") + F.size("b"), F.size("difference"), percent)
    found = _with_sets(pairs, sets).select("u", "v", "a", "b", difference.alias("difference"))
    short = F.transform("difference", lambda x: (x % 2147483647).cast("int"))
    return found.select("u", "v", linked.alias("linked"), F.size("a").alias("n"), short.alias("difference"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable) and kept."""
    scratch = common.Scratch(docs.sparkSession, "minhash")
    signed = scratch.write(signatures(docs, width), "signatures")
    nonempty = signed.where("n_shingles > 0 and doc_id is not null")
    classes = nonempty.groupBy("set_hi", "set_lo", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = scratch.write(classes, "classes", 4)
    same_set = ["set_hi", "set_lo", "n_shingles"]
    first = classes.withColumnRenamed("rep", "doc_id")
    reps = scratch.write(
        nonempty.join(first, [*same_set, "doc_id"], "left_semi").select("doc_id", "signature").dropDuplicates(["doc_id", "signature"]),
        "reps",
        4,
    )

    keys = scratch.write(_band_keys(reps, BANDS), "keys")
    members = scratch.write(keys.join(_shared(keys), ["band", "key"]), "members", 4)
    candidates = scratch.write(members.select("doc_id").distinct(), "candidates", 8)
    scratch.drop(keys)
    narrow = _band_keys(reps.join(candidates, "doc_id", "left_semi"), NARROW_BANDS)
    narrow = narrow.join(_shared(narrow), ["band", "key"])
    stars = members.unionByName(narrow).where("doc_id <> pivot")
    stars = stars.select(F.col("doc_id").alias("u"), F.col("pivot").alias("v")).distinct()
    sets = scratch.write(shingle_sets(common.met_by_id(docs, candidates, "left_semi"), width), "sets")

    checked = scratch.write(_checked(stars, sets, percent), "checked")
    linked = common.components(scratch, checked.where("linked").select("u", "v"))
    likely = scratch.write(_rest(members, linked, checked, percent), "likely", 8)
    rest = scratch.write(_checked(likely, sets, percent).where("linked").select("u", "v"), "rest", 8)
    if not rest.isEmpty():
        roots = linked.select(F.col("node").alias("u"), F.col("component").alias("v"))
        linked = common.components(scratch, roots.unionAll(rest))

    members_of = signed.select("doc_id", *same_set).join(classes, same_set, "left")
    found = members_of.join(linked, members_of["rep"] == linked["node"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    found = found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _rest(members: DataFrame, linked: DataFrame, checked: DataFrame, percent: int) -> DataFrame:
    """Links between different components of a bucket, as distinct (u, v); all members met the bucket's pivot before."""
    others = members.where("size > 2 and doc_id <> pivot").drop("size")
    placed = others.join(linked, others["doc_id"] == linked["node"], "left")
    placed = placed.select("band", "key", "pivot", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    sizes = placed.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("n"))
    buckets = sizes.groupBy("band", "key").agg(F.max("n").alias("_most"), F.count(F.lit(1)).alias("_parts")).where("_parts > 1")
    largest = sizes.join(buckets, ["band", "key"]).where("n = _most").groupBy("band", "key").agg(F.min("component").alias("main"))
    apart = checked.select(F.col("u").alias("doc_id"), F.col("v").alias("pivot"), "n", "difference")
    open_ = placed.join(largest, ["band", "key"]).join(apart, ["doc_id", "pivot"])
    side = ["band", "key", "main"]
    a, b = (
        open_.select(
            *(side if x == "u" else side[:2]),
            *[F.col(c).alias(f"{x}_{c}") for c in ("doc_id", "component", "n", "difference")],
        )
        for x in ("u", "v")
    )
    a = a.where("u_component <> main")
    once = (F.col("v_component") == F.col("main")) | (F.col("u_doc_id") < F.col("v_doc_id"))
    total, many, more = F.col("u_n") + F.col("v_n"), F.size("u_difference"), F.size("v_difference")
    possible = _near_enough(total, F.abs(many - more), percent)
    # Hashes that clash can only hide a shingle or two here; the full sets decide.
    distance = many + more - 2 * F.size(F.array_intersect("u_difference", "v_difference"))
    near = F.when((F.col("u_component") != F.col("v_component")) & once & possible, _near_enough(total, distance - 4, percent))
    return a.join(b, ["band", "key"]).where(near).select(F.col("u_doc_id").alias("u"), F.col("v_doc_id").alias("v")).distinct()


def kept_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without those whose component has a smaller doc_id; of repeated rows of one doc_id all stay."""
    gone = near_duplicates(docs, width, percent).where("not kept").select("doc_id")
    return common.met_by_id(docs, gone, "left_anti")
