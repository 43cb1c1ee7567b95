"""Substring dedup by seed and extend: passages of ``window`` or more words that an earlier document holds are removed.

Words lie between ASCII blanks and are compared unchanged. A word is removed when some window of ``window`` consecutive
words that covers it also starts in a document with a smaller doc_id; windows are judged on the input. The union of
such windows is the set of maximal repeats of at least that length.

Seeds: winnowing picks one anchor (a run of ``ANCHOR`` words with the smallest hash) for every window, so equal windows
have equal anchors at equal offsets, and each window belongs to exactly one anchor. The windows of one anchor are
consecutive and form a block: the anchor extended to the left and to the right.

1. One pass over the text writes a row per document (word count, hash of kept text if nothing goes, key of the word
   sequence) with its blocks: anchor hash, hash of the whole extended block, place.
2. Documents of equal word sequences collapse to the smallest id; the others go wholly.
3. Blocks are grouped by (anchor, extension). Where the smallest document of an equal block is another one, the match
   extends over the whole block. Where one anchor has different extensions (a passage ends, a word was changed), the
   smallest document of each extension gives out the block's single windows, which are matched one by one.
   No pairs are made: every step joins a row with the minimum of its group.
4. Documents with matches meet their text again and lose the covered words.

Hashes of anchor and extension are independent, 128 bits together. Nulls: a null text has no words; a null doc_id is
never earlier than another and keeps its words. Rows that repeat a doc_id are one document with itself: they are told
apart by a hash of their text and never remove from each other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 50
#: Words of an anchor. Each window of 50 then has 31 places for one; about one place in 16 becomes an anchor.
ANCHOR = 20


def _inverse(odd: int) -> int:
    return pow(odd, -1, 2**64)


class Rolling:
    """Hashes of runs of words by sums over powers of an odd base modulo 2^64, spread by ``mixed``."""

    def __init__(self, seed: int):
        self.base, self.salt = (int(x) for x in kernels.odd_numbers(seed, 2))
        self.back = _inverse(self.base)
        self.powers = np.ones(1, dtype=np.uint64)
        self.inverses = np.ones(1, dtype=np.uint64)

    def _grown(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers))
            for name, factor in (("powers", self.base), ("inverses", self.back)):
                steps = np.full(size, factor, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        """Prefix sums, to be passed to ``runs``."""
        self._grown(len(hashes) + 1)
        salted = kernels.mixed(hashes + np.uint64(self.salt))
        return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(salted * self.powers[: len(hashes)])])

    def runs(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return kernels.mixed((sums[end] - sums[start]) * self.inverses[start] + (end - start).astype(np.uint64))


def anchors_of_windows(seeds: np.ndarray, places: int) -> np.ndarray:
    """For each window, the place of its anchor: the smallest seed hash among ``places``, of equal ones the last."""
    n = len(seeds) - places + 1
    # Running minima over blocks of `places` from both sides meet in any window (van Herk); keys are made distinct by rank.
    order = np.empty(len(seeds), dtype=np.int64)
    _, rank = np.unique(seeds, return_inverse=True)
    order[:] = rank * len(seeds) + np.arange(len(seeds) - 1, -1, -1)
    padded = np.full(-(-len(seeds) // places) * places, np.iinfo(np.int64).max)
    padded[: len(seeds)] = order
    rows = padded.reshape(-1, places)
    forward = np.minimum.accumulate(rows, axis=1).reshape(-1)
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(backward[:n], forward[places - 1 : places - 1 + n])
    return len(seeds) - 1 - least % len(seeds)


class Blocks:
    """The anchors of a document with their blocks of windows."""

    def __init__(self, window: int):
        self.window, self.places = window, window - ANCHOR + 1
        self.seed, self.extension = Rolling(2), Rolling(12)

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, extension hash, first window, windows) of each block, in order."""
        if len(hashes) < self.window:
            none = np.empty(0, dtype=np.uint64)
            return none, none, none.astype(np.int64), none.astype(np.int64)
        sums = self.seed.sums(hashes)
        start = np.arange(len(hashes) - ANCHOR + 1)
        seeds = self.seed.runs(sums, start, start + ANCHOR)
        place = anchors_of_windows(seeds, self.places)
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        count = np.diff(np.concatenate([first, [len(place)]]))
        at = place[first]
        sums = self.extension.sums(hashes)
        whole = self.extension.runs(sums, first, first + count + self.window - 1)
        # Where the anchor lies in the block belongs to it, so that equal extensions have equal windows throughout.
        whole = kernels.mixed(whole + (at - first).astype(np.uint64) * np.uint64(self.extension.salt))
        return seeds[at], whole, first, count

    def windows(self, hashes: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of all windows of the given blocks."""
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(first, count) + offset
        return start, self.extension.runs(self.extension.sums(hashes), start, start + self.window)


SCANNED = (
    "doc_id long, text_key long, n_words long, seq_hi long, seq_lo long, whole_sha256 string, "
    "blocks array<struct<anchor:long,extension:long,start:int,windows:int>>"
)
BLOCK = pa.struct([("anchor", pa.int64()), ("extension", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())])


def _lists(flat: pa.Array, lengths: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]).astype(np.int32)), flat)


def _sequence_key(hashes: np.ndarray, low: Rolling, high: Rolling) -> tuple[int, int]:
    ends = np.array([0]), np.array([len(hashes)])
    return tuple(int(kernels.signed(r.runs(r.sums(hashes), *ends))[0]) for r in (high, low))


def scanned(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, low, high = Blocks(window), Rolling(22), Rolling(32)
        for batch in kernels.small(batches):
            counts, seqs, shas, found = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = kernels.as_bytes(text).split()
                hashes = kernels.word_hashes(words)
                counts.append(len(words))
                seqs.append(_sequence_key(hashes, low, high))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                found.append(blocks.of(hashes))
            columns = [np.concatenate(c) if c else np.empty(0) for c in zip(*found)] or [np.empty(0)] * 4
            flat = pa.StructArray.from_arrays(
                [
                    pa.array(kernels.signed(columns[0])),
                    pa.array(kernels.signed(columns[1])),
                    pa.array(columns[2].astype(np.int32)),
                    pa.array(columns[3].astype(np.int32)),
                ],
                fields=list(BLOCK),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([s[0] for s in seqs], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([s[0] for s in seqs], pa.int64()),
                    pa.array([s[1] for s in seqs], pa.int64()),
                    pa.array(shas, pa.string()),
                    _lists(flat, [len(f[0]) for f in found]),
                ],
                ["doc_id", "text_key", "n_words", "seq_hi", "seq_lo", "whole_sha256", "blocks"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCANNED)


OPENED = "doc_id long, text_key long, text string, covered array<int>, open array<struct<anchor:long,hash:long,start:int>>"
OPEN = pa.struct([("anchor", pa.int64()), ("hash", pa.int64()), ("start", pa.int32())])


def _opened(rows: DataFrame, window: int) -> DataFrame:
    """Blocks to single windows: the starts already covered, and the open ones with their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, low, high = Blocks(window), Rolling(22), Rolling(32)
        for batch in kernels.small(batches):
            covered, opened, open_counts, covered_counts, rows = [], [], [], [], []
            keys, texts, all_marks = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for i, (text, marks) in enumerate(zip(texts, all_marks)):
                hashes = kernels.word_hashes(kernels.as_bytes(text).split())
                if _sequence_key(hashes, low, high)[0] != keys[i]:  # another text under the same doc_id
                    continue
                rows.append(i)
                for whole in (True, False):
                    some = [m for m in marks if m["whole"] == whole]
                    first = np.array([m["start"] for m in some], dtype=np.int64)
                    count = np.array([m["windows"] for m in some], dtype=np.int64)
                    start, value = blocks.windows(hashes, first, count)
                    if whole:
                        covered.append(start)
                        covered_counts.append(len(start))
                    else:
                        anchor = np.repeat(np.array([m["anchor"] for m in some], dtype=np.int64), count)
                        opened.append((anchor, kernels.signed(value), start))
                        open_counts.append(len(start))
            parts = [np.concatenate(c) for c in zip(*opened)] or [np.empty(0, dtype=np.int64)] * 3
            flat = pa.StructArray.from_arrays(
                [pa.array(parts[0]), pa.array(parts[1]), pa.array(parts[2].astype(np.int32))], fields=list(OPEN)
            )
            done = np.concatenate(covered).astype(np.int32) if covered else np.empty(0, dtype=np.int32)
            met = batch.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*met.columns[:3], _lists(pa.array(done), covered_counts), _lists(flat, open_counts)],
                ["doc_id", "text_key", "text", "covered", "open"],
            )

    return rows.select("doc_id", "text_key", "text", "marks").mapInArrow(run, OPENED)


def _cut(rows: DataFrame, window: int) -> DataFrame:
    """Words outside all the windows that start at ``covered``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.small(batches):
            removed, kept_texts = [], []
            for text, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = kernels.as_bytes(text).split()
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                starts = np.unique(np.array(starts, dtype=np.int64))
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                kept_texts.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(kept_texts, pa.string())],
                ["doc_id", "text_key", "n_removed", "kept_text"],
            )

    schema = "doc_id long, text_key long, n_removed long, kept_text string"
    return rows.select("doc_id", "text_key", "text", "covered").mapInArrow(run, schema)


def repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(documents, cuts).

    documents: a row per row of ``docs`` with doc_id, n_words, whole_sha256 (of all words joined by one space), copy (an
    earlier document has the same words) and text_key. cuts: for documents that are no copies but lose words: doc_id,
    text_key, n_removed, kept_text. Words of a copy all go if there are at least ``window``.
    """
    if window < ANCHOR:
        raise ValueError(f"a window must have at least {ANCHOR} words")
    scratch = common.Scratch(docs.sparkSession, "substrings")
    scan = scratch.write(scanned(docs, window), "scan")
    same = ["seq_hi", "seq_lo", "n_words"]
    first = scan.where("doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("first_id"))
    joined = scan.select("doc_id", "text_key", *same, "whole_sha256").join(first, same, "left")
    rows = joined.select(
        "doc_id", "text_key", "n_words", "whole_sha256", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).alias("copy")
    )

    long_enough = scan.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    only = first.withColumnRenamed("first_id", "doc_id")
    kept = long_enough.join(only, [*same, "doc_id"], "left_semi").dropDuplicates(["doc_id", *same])
    blocks = scratch.write(kept.select("doc_id", "text_key", F.explode("blocks").alias("b")).select("doc_id", "text_key", "b.*"), "blocks")

    firsts = blocks.groupBy("anchor", "extension").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    spread = firsts.groupBy("anchor").agg(F.min("first_id").alias("least"), F.max("last_id").alias("most"), F.count(F.lit(1)).alias("kinds"))
    seeds = scratch.write(
        firsts.join(spread.where("least < most"), "anchor").select(
            "anchor", "extension", "first_id", ((F.col("kinds") > 1)).alias("several")
        ),
        "seeds",
    )
    marked = blocks.join(seeds, ["anchor", "extension"]).select(
        "doc_id", "text_key", "anchor", "start", "windows", (F.col("doc_id") > F.col("first_id")).alias("whole"), "several"
    )
    marked = marked.where("whole or several")
    # A document's own blocks, as many as its text has; the text itself is in one row too.
    marks = marked.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "start", "windows", "whole")).alias("marks"))
    return rows, _matched(scratch, docs, marks, window)


def _matched(scratch: common.Scratch, docs: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    met = common.met_by_id(texts, marks)
    opened = scratch.write(_opened(met, window), "open")
    single = opened.where(F.size("open") > 0).select("doc_id", "text_key", F.explode("open").alias("w")).select("doc_id", "text_key", "w.*")
    least = single.groupBy("anchor", "hash").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    least = least.where("first_id < last_id").select("anchor", "hash", "first_id")
    hits = single.join(least, ["anchor", "hash"]).where("doc_id > first_id")
    more = hits.groupBy("doc_id", "text_key").agg(F.collect_list("start").alias("more"))
    whole = opened.select("doc_id", "text_key", "text", "covered").join(more, ["doc_id", "text_key"], "left")
    covered = F.concat("covered", F.coalesce("more", F.array().cast("array<int>")))
    cut = whole.select("doc_id", "text_key", "text", covered.alias("covered")).where(F.size("covered") > 0)
    return _cut(cut.dropDuplicates(["doc_id", "text_key"]), window)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed and kept_sha256 (kept words joined by one space)."""
    rows, cuts = repeats(docs, window)
    cuts = cuts.select("doc_id", "text_key", F.col("n_removed").alias("_cut"), F.sha2("kept_text", 256).alias("_sha"))
    gone = F.col("copy") & (F.col("n_words") >= window)
    found = rows.join(cuts, ["doc_id", "text_key"], "left")
    return found.select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("_cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("_sha", "whole_sha256")).alias("kept_sha256"),
    )
