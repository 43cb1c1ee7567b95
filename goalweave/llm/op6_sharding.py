"""Sharding by balanced label propagation: linked documents move together while shards stay equally full.

The law is ``rows``: counts of any two shards differ by one at most. A shard's quota is its share of the rows.

1. Every row gets a node number of its own. Groups of equal texts above a part of the quota are so few that their sizes fit
   a short list: they are placed as wholes, the largest first. One above the quota fills whole shards; what is left of it,
   and any other, goes to the fullest shard that can hold it, and is split only where none can.
2. Links join nodes; in smaller groups each member is linked to the smallest node. Linked nodes start in the shard their
   hash gives them, each shard getting as many as it has room. In each turn every node of one random half sees its
   neighbours' shards through a join, and asks for the shard most of them are in if that cuts fewer links than its own. A
   shard admits movers, the largest gain first, as far as its quota leaves room: requests are counted by (shard, gain
   class, bucket of the hash) and whole buckets are admitted below the mark. The other half follows, then halves are drawn
   anew, until neither half of a pair admits a move. A run that ends at the guard of ``turns`` says so.
3. At the end placed groups and then linked nodes, in the order of their hash, keep their places up to the quota. All other
   rows fill what is free, exactly, in the order of their hash. Ranks come from bucket counts, so no task sorts a shard.

Only DataFrame operations. Size is the text's UTF-8 bytes plus 16. Null texts have no bytes and count as empty. Rows that
repeat (doc_id and text) are rows of their own; null doc_ids are allowed. With fewer rows than shards some shards stay
empty. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: A guard; turns end when nothing moves any more.
TURNS = 400
#: Groups above this part of a shard's quota are placed as wholes.
LARGE_PART = 4
BUCKETS = 4096
GAINS = 4


def _hash(seed: int, *columns: str | Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def nodes_of(scratch: common.Scratch, docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and text_hash of each row with a node number."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(raw).alias("text_hash"),
    )
    # Numbered by content, so that reruns agree however the rows are dealt: rows that are wholly equal are alike.
    rows = scratch.write(rows.withColumn("bucket", common.hash_bucket(_hash(6, "doc_id", "text_hash"), BUCKETS)), "rows")
    order = [_hash(6, "doc_id", "text_hash"), F.col("doc_id"), F.col("text_hash"), F.col("text_crc32"), F.col("size")]
    one = rows.withColumn("all", F.lit(0))
    return scratch.write(common.bucket_ranks(one, ["all"], "bucket", order, "node").drop("all", "bucket"), "nodes")


TEXT = ["text_hash", "text_crc32", "size"]


def equal_text_links(nodes: DataFrame, most: int) -> DataFrame:
    """(u, v): members of a group of 2 to ``most`` equal texts and its smallest node."""
    groups = nodes.groupBy(*TEXT).agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, most))
    return nodes.join(groups.drop("n"), TEXT).where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))


def packed(counts: list[int], shards: int, quota: int) -> list[tuple[int, int, int, int]]:
    """(group, first, end, shard): which members of each group go where, as few shards for each as the room allows."""
    room, parts = [quota] * shards, []
    left = [[n, 0, g] for g, n in enumerate(counts)]
    while left:
        left.sort(key=lambda x: (-x[0], x[2]))
        n, at, group = left.pop(0)
        fits = [s for s in range(shards) if room[s] >= n]
        shard = min(fits, key=lambda s: (room[s], s)) if fits else max(range(shards), key=lambda s: (room[s], -s))
        taken = min(n, room[shard])
        if taken:
            parts.append((group, at, at + taken, shard))
            room[shard] -= taken
            if n > taken:
                left.append([n - taken, at + taken, group])
    return parts


def large_groups(scratch: common.Scratch, nodes: DataFrame, shards: int, quota: int, most: int) -> tuple[DataFrame, list[int]]:
    """(node, shard) of all groups of more than ``most`` equal texts, and how many rows of them each shard has."""
    # Fewer than rows / most.
    groups = nodes.groupBy(*TEXT).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).orderBy(*TEXT).collect()
    used = [0] * shards
    parts = packed([r["n"] for r in groups], shards, quota)
    if not parts:
        return nodes.select("node", F.lit(0).alias("shard")).limit(0), used
    rows = []
    for group, first, end, shard in parts:
        used[shard] += end - first
        values = [(groups[group][c], c, "long") for c in TEXT] + [(first, "first", "long"), (end, "end", "long"), (shard, "shard", "int")]
        rows.append(F.struct(*[F.lit(v).cast(kind).alias(name) for v, name, kind in values]))
    where = F.broadcast(scratch.spark.range(1).select(F.inline(F.array(*rows))))
    members = nodes.join(where.select(*TEXT).distinct().hint("broadcast"), TEXT, "left_semi")
    members = scratch.write(members.select("node", *TEXT).withColumn("bucket", common.hash_bucket(_hash(16, "node"), BUCKETS)), "members")
    members = common.bucket_ranks(members, TEXT, "bucket", [_hash(16, "node"), F.col("node")], "nth")
    placed = members.join(where, TEXT).where((F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("end")))
    return scratch.write(placed.select("node", "shard"), "large"), used


def _interval(at: Column, starts: list[int]) -> Column:
    """The last interval that starts at or below; empty ones start where the next one does."""
    return (F.size(F.filter(F.array(*[F.lit(s).cast("long") for s in starts]), lambda s: s <= at)) - 1).cast("int")


def _asked(both: DataFrame, placed: DataFrame, turn: int) -> DataFrame:
    """Moves that nodes of this turn's half would gain by: node, shard (now), to, gain."""
    near = both.join(placed.select(F.col("node").alias("v"), F.col("shard").alias("there")), "v")
    votes = near.groupBy(F.col("u").alias("node"), "there").agg(F.count(F.lit(1)).alias("votes"))
    votes = votes.join(placed, "node").where(F.pmod(_hash(100 + turn // 2, "node"), F.lit(2)) == turn % 2)
    # The most votes, then the smaller shard; both in one number, which a hash aggregate can carry.
    rank = F.col("votes") * 1_000_000 - F.col("there")
    best = votes.groupBy("node", "shard").agg(
        F.max(rank).alias("best"), F.max(F.when(F.col("there") == F.col("shard"), F.col("votes")).otherwise(0)).alias("now")
    )
    most = F.ceil(F.col("best") / 1_000_000)
    asked = best.select("node", "shard", (most * 1_000_000 - F.col("best")).cast("int").alias("to"), (most - F.col("now")).alias("gain"))
    return asked.where("gain > 0 and to <> shard")


def _admitted(scratch: common.Scratch, asked: DataFrame, placed: DataFrame, rooms: list[int]) -> DataFrame:
    """Of the moves asked for, those that fit: whole buckets in the order of their gain, up to each shard's room."""
    level = F.least(F.floor(F.log2(F.col("gain"))), F.lit(GAINS - 1)).cast("int")
    bucket = (GAINS - 1 - level) * BUCKETS + common.hash_bucket(F.col("node"), BUCKETS)
    asked = scratch.write(asked.withColumn("bucket", bucket), "asked")
    quota = F.array(*[F.lit(n).cast("long") for n in rooms])
    taken = placed.groupBy(F.col("shard").alias("to")).agg(F.count(F.lit(1)).alias("taken"))
    counts = asked.groupBy("to", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # At most GAINS * BUCKETS rows for each shard.
    upto = Window.partitionBy("to").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("n").over(upto)).join(taken, "to", "left")
    fits = counts.where(F.col("upto") <= F.get(quota, F.col("to")) - F.coalesce("taken", F.lit(0))).select("to", "bucket")
    return asked.join(fits, ["to", "bucket"], "left_semi").select("node", "to")


def propagated(scratch: common.Scratch, links: DataFrame, rooms: list[int], turns: int = TURNS) -> DataFrame:
    """(node, shard) of every linked node; ``rooms`` are the rows each shard can take."""
    links = scratch.write(links.select("u", "v").where("u <> v").distinct(), "links")
    both = scratch.write(links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "both")
    start = both.select(F.col("u").alias("node")).distinct()
    at = F.pmod(_hash(26, "node"), F.lit(max(sum(rooms), 1)))
    placed = scratch.write(start.withColumn("shard", _interval(at, [sum(rooms[:s]) for s in range(len(rooms))])), "placed")
    still = 0
    for turn in range(turns):
        moves = scratch.write(_admitted(scratch, _asked(both, placed, turn), placed, rooms), "moves", 8)
        still = (still if turn % 2 else 0) + int(moves.isEmpty())
        if turn % 2 and still == 2:
            return placed
        if moves.isEmpty():
            continue
        moved = scratch.write(placed.join(moves, "node", "left").select("node", F.coalesce("to", "shard").alias("shard")), "placed")
        scratch.drop(placed)
        placed = moved
    warnings.warn(f"op6_sharding: nodes still moved after {turns} turns", stacklevel=2)
    return placed


def balanced(docs: DataFrame, shards: int = 40, turns: int = TURNS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot (gapless from 0) and grown_shard (null)."""
    scratch = common.Scratch(docs.sparkSession, "shards")
    nodes = nodes_of(scratch, docs)
    total = nodes.count()
    quota = total // shards
    # The first shards take one row more where the rows do not divide.
    extra = total - quota * shards
    most = max(quota // LARGE_PART, 1)
    large, taken = large_groups(scratch, nodes, shards, quota, most)
    placed = propagated(scratch, equal_text_links(nodes, most), [quota - n for n in taken], turns)

    # Linked nodes stay as far as the quota goes.
    bucket = common.hash_bucket(_hash(36, "node"), BUCKETS)
    held = placed.withColumn("bucket", bucket + BUCKETS).unionByName(large.withColumn("bucket", bucket))
    held = scratch.write(held, "held")
    held = common.bucket_ranks(held, ["shard"], "bucket", [_hash(36, "node"), F.col("node")], "slot")
    most = F.lit(quota) + (F.col("shard") < extra).cast("int")
    kept = scratch.write(held.where(F.col("slot") < most).select("node", "shard", "slot"), "kept")

    # Everything else fills the room in the order of its hash: room is a list of ``shards`` intervals.
    free = nodes.select("node").join(kept.select("node"), "node", "left_anti")
    free = scratch.write(free.withColumn("bucket", common.hash_bucket(_hash(46, "node"), BUCKETS)).withColumn("all", F.lit(0)), "free")
    free = common.bucket_ranks(free, ["all"], "bucket", [_hash(46, "node"), F.col("node")], "at")
    used = {r["shard"]: r["n"] for r in kept.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, at = [], 0
    for shard in range(shards):
        starts.append(at)
        at += quota + (shard < extra) - used.get(shard, 0)
    filled = free.select("node", "at", _interval(F.col("at"), starts).alias("shard"))
    before = F.array(*[F.lit(used.get(s, 0) - starts[s]).cast("long") for s in range(shards)])
    filled = filled.select("node", "shard", (F.col("at") + F.get(before, F.col("shard"))).alias("slot"))

    found = nodes.join(kept.unionByName(filled), "node")
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
