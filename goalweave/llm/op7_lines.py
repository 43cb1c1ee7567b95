"""Line dedup: lines within a few edits of an earlier line are removed, by segment-partition edit join.

A text is cut at line feeds. A line of at least ``least`` characters is removed when a line at most one edit (insertion,
deletion or substitution of a character; more in longer lines, see 5) away, or an equal one, comes before it: in a document with a smaller doc_id, or
further up in its own. Equal lines may be shorter, from ``equal`` characters on; other shorter lines stay. Lines are judged
on the input, not on what is left.

1. One pass over the text gives each document's distinct lines as 128-bit hashes with their segment keys. Equal lines
   collapse to their first place (smallest document, then line).
2. Two lines within one edit share one of threshold + 1 = 2 segments: a line of length l gives out its two halves, and, to
   meet lines one character shorter, the halves of length l - 1 as they would lie at its start and at its end. A key is a
   hash of (length, which half, half). Keys that only one line has are dropped.
3. A key of many lines is never paired: its lines are dealt anew by the halves of what the key does not cover, as often
   as needed. Lines that agree in all but one character are all within one edit of their first one.
4. Pairs of the small groups meet their text; a banded bit-parallel edit distance decides.
5. With ``edits`` above 1, a line of ``EACH`` characters or more for each edit may have so many, up to ``edits``: the shorter
   line of a pair sets the number k. It is cut into k + 1 segments; at least one lies unchanged in the other line, moved by
   no more than the edits before and behind it allow. Such lines give out no halves. Lines of a key of more than ``LED``
   are first compared with the key's first line, then those that stay with the first of these, as long as that removes
   a tenth of them; only what stays then is compared with all earlier lines of the key.
6. An edit changes at most four of a line's pairs of neighbouring characters. Each line has the parities of its pairs, hashed
   to 128 bits; lines of a key become a pair only if at most 4 k of these bits differ. No near line is lost by that, and of
   lines about one template those too far apart are told apart inside the join. Lines of a key of more than ``PAIRED``
   never become rows of pairs: they are dealt into blocks, and each two blocks meet in a task that looks at bits, sizes and
   distances and gives out just the lines that have an earlier one. Looking at the bits still grows with the square of a
   key's lines that are truly apart.

Nulls: a null text has no lines; a null doc_id comes last, in no order with other null ones: of its lines those go that repeat
in its own text, from the second on, and those equal to a line that goes from other documents for its edits; others stay. Rows that repeat a doc_id are one document: an equal line of another such row is no earlier one. Empty
tables give no rows. Other columns are ignored by ``repeated_lines`` and kept by ``without_repeated_lines``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, kernels

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST = 20
#: Characters for each edit, where more than one is asked for.
EACH = 20
BASE = 0x9E3779B97F4A7C15
#: Characters whose segments are found at once, and bits of the tables of known segments (32 MB) and of wanted places (8 MB).
AT_ONCE = 1 << 20
MARKS, WANTED = 1 << 28, 1 << 26
#: Where a key's bits in its word of the table lie in the key; the word is in bits 6 to 27.
BITS = (0, 28, 34, 40)
#: Lines of a key that may be paired; more are dealt anew.
CROWD = 32
#: The same where more than one edit is allowed: lines of larger keys meet their first line before they are paired.
LED = 4
#: Lines of a key above which these no longer become pairs, of a block of them, two of which a task holds at once, and those that are compared at once.
PAIRED, BLOCK, TILE = 128, 1 << 14, 512
#: Columns that the distances of many pairs take between two looks at what is far, and places of a grid of characters.
STEP, CELLS = 32, 1 << 18
#: Pairs too few for arrays.
FEW = 8


def _grid(chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: int, width: int, fill: int) -> np.ndarray:
    """Characters from ``before`` places before each start on, ``fill`` where a text has none."""
    at = np.arange(-before, width - before)
    inside = (at >= 0) & (at < sizes[:, None])
    return np.where(inside, chars[np.where(inside, starts[:, None] + at, 0)], np.uint32(fill))


def _column(equal, up, down, score, width: int, every: int):
    """Differences down the next column and the score, of numbers or of arrays."""
    zero = ((((equal & up) + up) ^ up) | equal | down) & every
    plus = down | (every & ~(zero | up))
    score = score + 1 - (zero >> (width - 1) & 1)  # it follows the lowest diagonal
    return (zero & up) | (every & ~((zero >> 1) | plus)), (zero >> 1) & plus, score


def _banded(x: np.ndarray, y: np.ndarray, long: np.ndarray, short: np.ndarray, most: np.ndarray, band: int) -> np.ndarray:
    """Whether rows of ``x`` (``band`` places filled up in front) are within ``most`` of those of ``y``, which are shorter and
    come in order of size: for all pairs at once, column by column, a band of 2 * band + 1 diagonals in the bits of a number."""
    n, width = len(y), 2 * band + 1
    every = (1 << width) - 1
    # Bit t of column j stands for row j + 1 - band + t. Differences down a column: all +1 below row 0, none above it.
    up, down, score = (np.full(n, v, np.int32) for v in (every & ~((1 << band) - 1), 0, band))
    columns = y.shape[1]
    for begin in range(0, columns, STEP):
        end = min(begin + STEP, columns)
        # Pairs whose lowest diagonal is this far off cannot come back; they count as far and are left as they are.
        live = np.flatnonzero((short > begin) & (score <= 3 * band))
        if not len(live):
            continue
        equal = np.zeros((len(live), end - begin), np.int32)
        for t in range(width):
            equal |= (x[live, begin + t : end + t] == y[live, begin:end]).astype(np.int32) << t
        if len(live) <= FEW:  # numbers one by one are faster than arrays of so few
            for row, number in enumerate(live):
                u, d, s = int(up[number]), int(down[number]), int(score[number])
                for e in equal[row, : short[number] - begin].tolist():
                    u, d, s = _column(e, u, d, s, width, every)
                up[number], down[number], score[number] = u, d, s
            continue
        equal, sizes = np.ascontiguousarray(equal.T), short[live]
        u, d, s = up[live], down[live], score[live]
        for j in range(begin, end):
            first = np.searchsorted(sizes, j, "right")  # shorter ones have ended
            u[first:], d[first:], s[first:] = _column(equal[j - begin, first:], u[first:], d[first:], s[first:], width, every)
        up[live], down[live], score[live] = u, d, s
    far = score > 3 * band
    # From the lowest row of the last column, short + band, up to row long.
    for t in range(width - 1, 0, -1):
        step = (width - 1 - t) < short + band - long
        score -= np.where(step, (up >> (t - 1) & 1) - (down >> (t - 1) & 1), 0)
    return ~far & (score <= most)


def within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most its ``most``."""
    near, band = np.zeros(len(a), bool), int(most.max(initial=0))
    chars = np.frombuffer("".join([*a, *b]).encode("utf-32-le") + bytes(4), np.uint32)
    sizes = np.array([len(t) for t in [*a, *b]], np.int64)
    starts = np.cumsum(sizes) - sizes
    n, pair = len(a), np.arange(len(a))
    swap = np.where(sizes[:n] < sizes[n:], n, 0)
    x, y = pair + swap, pair + n - swap
    xs, ys, long, short = starts[x], starts[y], sizes[x], sizes[y]
    order = np.argsort(short, kind="stable")
    order = order[long[order] - short[order] <= most[order]]
    for part in _parts(short[order]):
        at = order[part]
        # The common start and the common end need no band.
        for back in (False, True):
            columns = int(short[at].max(initial=0))
            if back:
                inside = np.arange(columns) < short[at, None]
                other = [chars[np.where(inside, (s + z)[at, None] - 1 - np.arange(columns), 0)] for s, z in ((xs, long), (ys, short))]
            else:
                inside = np.arange(columns) < short[at, None]
                other = [_grid(chars, s[at], z[at], 0, columns, 0) for s, z in ((xs, long), (ys, short))]
            differ = np.concatenate([(other[0] != other[1]) | ~inside, np.ones((len(at), 1), bool)], 1)
            same = differ.argmax(1)
            long[at] -= same
            short[at] -= same
            if not back:
                xs[at] += same
                ys[at] += same
    order = order[np.argsort(short[order], kind="stable")]
    for part in _parts(short[order]):
        at = order[part]
        columns = int(short[at].max(initial=0))
        grids = _grid(chars, xs[at], long[at], band, columns + 2 * band, 0xFFFFFFFF), _grid(chars, ys[at], short[at], 0, columns, 0xFFFFFFFE)
        near[at] = _banded(*grids, long[at], short[at], most[at], band)
    return near


def _parts(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of ascending sizes whose grids have at most ``CELLS`` places, or one row."""
    first = 0
    while first < len(sizes):
        last = first + 1
        while last < len(sizes) and (last + 1 - first) * sizes[last] <= CELLS:
            last += 1
        yield slice(first, last)
        first = last


def edits_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``."""
    return bool(within([a], [b], np.array([most]))[0])


def _key(parts: tuple) -> int:
    raw = xxhash.xxh3_64_intdigest(repr(parts[:-1]).encode() + parts[-1].encode())
    return raw - (1 << 64) if raw >= 1 << 63 else raw


def halves(before: int | str, text: str, begin: int, end: int, extra: int) -> list[tuple[int, int, int]]:
    """(key, begin, end of the rest) for both halves of what lies between, seen as ``extra`` (0 or 1) characters shorter."""
    size = end - begin - extra
    cut = size // 2
    return [
        (_key((before, size, 0, text[begin : begin + cut])), begin + cut, end),
        (_key((before, size, 1, text[end - (size - cut) : end])), begin, end - (size - cut)),
    ]


def allowed(size: int, edits: int) -> int:
    """Edits that a line of ``size`` characters may be away from a longer one."""
    return max(1, min(edits, size // EACH))


def segments(lines: list[str], edits: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """(number of the line, key) of the k + 1 segments of each line, or of what may lie in it of those of a line no longer."""
    # Sums of characters times powers of an odd number give the hash of any part by one difference.
    chars = kernels.mixed(np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    power, back = (np.full(len(chars) + 1, x, np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))
    power[0] = back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(chars * power[:-1])])
    sizes = np.array([len(x) for x in lines], np.int64)
    starts = np.cumsum(sizes) - sizes
    numbers, keys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for extra in range(1 if own else edits + 1):
        most = np.clip((sizes - extra) // EACH, 1, edits)
        for k in range(max(2, extra), edits + 1):
            at = np.flatnonzero(most == k)
            size, start = sizes[at] - extra, starts[at]
            for i in range(k + 1):
                begin, end = start + size * i // (k + 1), start + size * (i + 1) // (k + 1)
                kind = kernels.mixed((size << 8 | i).astype(np.uint64))
                # Some segment is whole with just i edits before it and at most k - i behind it.
                for shift in [0] if own else range(max(-i, extra - (k - i)), min(i, extra + k - i) + 1):
                    # A line's own segments are keys already.
                    if own or shift or extra:
                        part = (sums[end + shift] - sums[begin + shift]) * back[begin + shift]
                        numbers.append(at)
                        keys.append(kernels.signed(kernels.mixed(part + kind)))
    return np.concatenate(numbers), np.concatenate(keys)


def parities(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each line in two numbers: how often, odd or even, a pair of neighbouring characters of each hash occurs."""
    chars = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(x) for x in lines], np.int64)
    if not len(chars):
        return np.zeros(len(lines), np.int64), np.zeros(len(lines), np.int64)
    bit = kernels.mixed(chars[:-1] << np.uint64(32) | chars[1:]) >> np.uint64(57)
    mark = np.uint64(1) << (bit & np.uint64(63))
    ends = np.cumsum(sizes)
    full = np.flatnonzero(sizes)
    found = []
    for high in (0, 1):
        marks = np.append(np.where(bit >> np.uint64(6) == high, mark, np.uint64(0)), np.uint64(0))
        marks[ends[full] - 1] = 0  # a pair over the end of a line
        words = np.zeros(len(lines), np.uint64)
        words[full] = np.bitwise_xor.reduceat(marks, (ends - sizes)[full])
        found.append(kernels.signed(words))
    return found[0], found[1]


def _runs(lines: list[str]) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of lines that are worked on at once."""
    first = 0
    while first < len(lines):
        last, size = first + 1, len(lines[first])
        while last < len(lines) and size + len(lines[last]) <= AT_ONCE:
            size += len(lines[last])
            last += 1
        yield first, last
        first = last


SCANNED = "doc_id long, row_key long, n_lines long, lines array<struct<at:int,again:array<int>,size:int,h1:long,h2:long,keys:array<long>,parts:array<long>>>"
WORDS = pa.list_(pa.int64())
LINE = pa.struct(
    [("at", pa.int32()), ("again", pa.list_(pa.int32())), ("size", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("keys", WORDS), ("parts", WORDS)]
)


def _offsets(sizes: list[int] | np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


def _own_parts(lines: list[str], edits: int) -> pa.Array:
    """For each line the keys of its own segments."""
    counts, found = np.zeros(len(lines), np.int64), [np.empty(0, np.int64)]
    for first, last in _runs(lines):
        place, keys = segments(lines[first:last], edits, True)
        counts[first:last] = np.bincount(place, minlength=last - first)
        found.append(keys[np.argsort(place, kind="stable")])
    return pa.ListArray.from_arrays(_offsets(counts), pa.array(np.concatenate(found), pa.int64()))


def scanned(docs: DataFrame, least: int, equal: int, edits: int = 1) -> DataFrame:
    """Distinct lines of each document from ``equal`` characters on: first place, later places, hash, and from ``least``
    characters on four keys (two halves for each length); longer lines that may have more edits, the keys of their segments."""
    # A line of just so many characters may be one edit from one that is a character shorter.
    halved = sys.maxsize if edits == 1 else 2 * EACH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.small(batches):
            counts, distinct, texts, firsts, again, halves_of = [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                lines = (text or "").split("\n")
                places: dict[str, list[int]] = {}
                for at, line in enumerate(lines):
                    if len(line) >= equal:
                        places.setdefault(line, []).append(at)
                for line, at in places.items():
                    firsts.append(at[0])
                    again.append(at[1:])
                    halves_of.append([k for extra in (0, 1) for k, _, _ in halves("", line, 0, len(line), extra)] if least <= len(line) <= halved else [])
                texts += places
                distinct.append(len(places))
                counts.append(0 if text is None else len(lines))
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.encode()) for x in texts), ">i8").astype(np.int64).reshape(-1, 2)
            longer = [x if edits > 1 and len(x) >= max(least, 2 * EACH) else "" for x in texts]
            columns = [
                pa.array(firsts, pa.int32()), pa.array(again, pa.list_(pa.int32())), pa.array([len(x) for x in texts], pa.int32()),
                pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(halves_of, WORDS), _own_parts(longer, max(edits, 2)),
            ]
            rows = pa.ListArray.from_arrays(_offsets(distinct), pa.StructArray.from_arrays(columns, fields=list(LINE)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(counts, pa.int64()), rows], ["doc_id", "row_key", "n_lines", "lines"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("row_key"), "text").mapInArrow(run, SCANNED)


def _row_key() -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _places(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    return kernels.signed(kernels.mixed(kernels.mixed(doc.astype(np.int64).view(np.uint64)) ^ at.astype(np.uint64)))


def _line_texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, at, line, even, odd) of the wanted places; the last two are the line's parities.

    Lines that are not wanted stay where they are: a table of the wanted places' bits lets few others pass.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_places(*(batch.column(i).to_numpy() for i in (0, 1))))], ["key"])

    known = _marks(wanted.select("doc_id", "at").mapInArrow(keys, "key long"), WANTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.small(batches):
            texts = [text or "" for text in batch.column(1).to_pylist()]
            counts = np.array([text.count("\n") + 1 for text in texts], np.int64)
            row = np.repeat(np.arange(len(texts)), counts)
            doc = batch.column(0).to_numpy()[row]
            at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            met = np.flatnonzero(_marked(_places(doc, at), known))
            split = {i: texts[i].split("\n") for i in np.unique(row[met]).tolist()}
            some = [split[i][j] for i, j in zip(row[met].tolist(), at[met].tolist())]
            high = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.encode()) for x in some), ">i8").astype(np.int64)[::2]
            bits = [parities(some[first:last]) for first, last in _runs(some)]
            marks = [np.concatenate([np.empty(0, np.int64), *(x[i] for x in bits)]) for i in (0, 1)]
            columns = [pa.array(doc[met], pa.int64()), pa.array(at[met], pa.int32()), pa.array(high), pa.array(some, pa.string()), *map(pa.array, marks)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "h1", "line", "even", "odd"])

    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = named.mapInArrow(run, "doc_id long, at int, h1 long, line string, even long, odd long")
    # Another row of the same doc_id may have another line there.
    return found.join(wanted, ["doc_id", "at", "h1"], "left_semi").drop("h1")


DEALT = "key long, doc_id long, at int, extra int, begin int, end int"


def _dealt_anew(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.small(batches):
            found = []
            for key, doc, at, extra, begin, end, line in zip(*(batch.column(i).to_pylist() for i in range(7))):
                found += [(k, doc, at, extra, b, e) for k, b, e in halves(key, line, begin, end, extra)]
            columns = list(zip(*found)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "doc_id", "at", "extra", "begin", "end"]
            )

    return rows.select("key", "doc_id", "at", "extra", "begin", "end", "line").mapInArrow(run, DEALT)


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of keys that can hold a pair: of two lines or more, of which one at least is of the key's own length."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("extra").alias("least"))
    return rows.join(sizes.where("size > 1 and least = 0").drop("least"), "key")


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs of lines that share a key, the earlier one first: doc_a, at_a, doc_b, at_b."""
    a = rows.where("extra = 0").select("key", F.col("doc_id").alias("doc_x"), F.col("at").alias("at_x"))
    b = rows.select("key", F.col("doc_id").alias("doc_y"), F.col("at").alias("at_y"), "extra")
    before = (F.col("doc_x") < F.col("doc_y")) | ((F.col("doc_x") == F.col("doc_y")) & (F.col("at_x") < F.col("at_y")))
    other = (F.col("doc_x") != F.col("doc_y")) | (F.col("at_x") != F.col("at_y"))
    found = a.join(b, "key").where(before | ((F.col("extra") == 1) & other))
    columns = [("doc_x", "doc_y", "doc_a"), ("at_x", "at_y", "at_a"), ("doc_y", "doc_x", "doc_b"), ("at_y", "at_x", "at_b")]
    return found.select(*[F.when(before, F.col(x)).otherwise(F.col(y)).alias(name) for x, y, name in columns]).distinct()


def _verified(pairs: DataFrame, lines: DataFrame, edits: int = 1) -> DataFrame:
    """Of pairs (first, then) those within the edits allowed, as the later line's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.small(batches):
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            near = pa.array(within(a, b, np.array([allowed(min(len(x), len(y)), edits) for x, y in zip(a, b)], np.int64)))
            yield pa.RecordBatch.from_arrays([c.filter(near) for c in batch.columns[:2]], ["doc_id", "at"])

    a = lines.select(F.col("doc_id").alias("doc_a"), F.col("at").alias("at_a"), F.col("line").alias("line_a"))
    b = lines.select(F.col("doc_id").alias("doc_b"), F.col("at").alias("at_b"), F.col("line").alias("line_b"))
    met = pairs.join(a, ["doc_a", "at_a"]).join(b, ["doc_b", "at_b"])
    return met.select("doc_b", "at_b", "line_a", "line_b").mapInArrow(run, "doc_id long, at int").distinct()


def repeated_lines(docs: DataFrame, least: int = LEAST, equal: int | None = None, edits: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, n_lines, n_removed and removed (line numbers from 0, ascending).

    Lines of ``least`` characters are compared by edits: one, or in longer lines one for each ``EACH`` characters, up to
    ``edits``. Equal ones go from ``equal`` characters on (as ``least`` if None).
    """
    scratch = common.Scratch(docs.sparkSession, "lines")
    scan = scratch.write(scanned(docs, least, least if equal is None else max(min(equal, least), 1), edits), "scan")
    rows = scan.select("doc_id", "row_key", F.explode("lines").alias("l")).select("doc_id", "row_key", "l.*")
    named = rows.where("doc_id is not null")
    # Rows that repeat a doc_id may hold a line twice; the smaller place stands for it.
    own = named.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "at", "keys", "parts")).alias("first"))
    kept = scratch.write(own.select("h1", "h2", "first.*"), "firsts", 4)

    # The first two keys are of the line's own length, the others of one character less.
    exploded = kept.select("doc_id", "at", "h1", F.posexplode("keys").alias("place", "key"))
    keyed = exploded.select("key", "doc_id", "at", "h1", F.floor(F.col("place") / 2).cast("int").alias("extra"), (F.col("place") % 2).alias("half"))
    shared = scratch.write(_sized(keyed), "shared", 4)
    wanted = shared.select("doc_id", "at", "h1")
    if edits > 1:
        alike = _alike(scratch, kept, docs, least, edits)
        wanted = wanted.unionAll(kept.select("doc_id", "at", "h1").join(alike.select("doc_id", "at").distinct(), ["doc_id", "at"], "left_semi"))
    lines = scratch.write(_line_texts(scratch.write(wanted.distinct(), "wanted", 8), docs), "texts")
    small = shared.where(F.col("size") <= CROWD).select("key", "doc_id", "at", "extra")
    near = [_verified(_pairs(small), lines)]

    crowd = shared.where(F.col("size") > CROWD).join(lines, ["doc_id", "at"])
    size = F.char_length("line")
    cut = F.floor((size - F.col("extra")) / 2)
    rest = size - F.col("extra") - cut
    begin = F.when(F.col("half") == 0, cut).otherwise(F.lit(0)).cast("int")
    end = F.when(F.col("half") == 0, size).otherwise(size - rest).cast("int")
    crowd = crowd.select("key", "doc_id", "at", "extra", begin.alias("begin"), end.alias("end"), "line")
    left = not shared.where(F.col("size") > CROWD).isEmpty()
    while left:
        dealt = scratch.write(_sized(_dealt_anew(crowd)), "dealt", 8)
        # Nothing more to deal by where lines agree in all but one character.
        over = F.col("end") - F.col("begin") - F.col("extra") <= 1
        near.append(_verified(_pairs(dealt.where(F.col("size") <= CROWD)), lines))
        near.append(_same_but_one(dealt.where((F.col("size") > CROWD) & over), lines))
        more = dealt.where((F.col("size") > CROWD) & ~over)
        left = not more.isEmpty()
        crowd = more.join(lines, ["doc_id", "at"]).select("key", "doc_id", "at", "extra", "begin", "end", "line")
    later = near[0]
    for some in near[1:]:
        later = later.unionAll(some)
    later = scratch.write(later.distinct(), "later", 8)
    if edits > 1:
        later = _within_more(scratch, alike, lines, edits, later)

    firsts = kept.select("h1", "h2", F.col("doc_id").alias("first_id"))
    gone = kept.join(later, ["doc_id", "at"], "left_semi").select("h1", "h2", F.lit(True).alias("late"))
    marked = rows.join(firsts, ["h1", "h2"], "left").join(gone, ["h1", "h2"], "left")
    first = (F.col("doc_id") == F.col("first_id")) & F.col("late").isNull()
    numbers = F.when(F.coalesce(first, F.col("doc_id").isNull()), F.col("again")).otherwise(F.concat(F.array("at"), "again"))
    marked = marked.select("doc_id", "row_key", numbers.alias("numbers")).where(F.size("numbers") > 0)
    # As many as the document has lines.
    per_row = marked.groupBy("doc_id", "row_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("numbers")))).alias("removed"))
    per_row = per_row.withColumnRenamed("doc_id", "d").withColumnRenamed("row_key", "r")
    found = scan.select("doc_id", "row_key", "n_lines").join(per_row, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("r")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return found.select("doc_id", "row_key", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def _other_parts(docs: DataFrame, least: int, edits: int, known: np.ndarray) -> DataFrame:
    """(key, doc_id, at) of parts of long lines, at their first place in the text, whose keys are perhaps ``known``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.small(batches):
            owners, places = [], {}
            lines: list[str] = []
            for number, text in enumerate(batch.column(1).to_pylist()):
                places = {}
                for at, line in enumerate((text or "").split("\n")):
                    if len(line) >= max(least, 2 * EACH):
                        places.setdefault(line, at)
                lines += places
                owners += [(number, at) for at in places.values()]
            owner = np.array(owners, np.int64).reshape(-1, 2)
            for first, last in _runs(lines):
                place, keys = segments(lines[first:last], edits, False)
                met = np.flatnonzero(_marked(keys, known))
                at = owner[place[met] + first]
                columns = [pa.array(keys[met], pa.int64()), batch.column(0).take(pa.array(at[:, 0])), pa.array(at[:, 1].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "at"])

    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return named.mapInArrow(run, "key long, doc_id long, at int")


def _marked(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether all bits of each key are set in its word of ``known``; those of a key it was made from are."""
    words = known[(keys >> 6) & (len(known) - 1)]
    met = (words >> (keys & 63)) & 1 == 1
    some = np.flatnonzero(met)
    for shift in BITS[1:]:
        some = some[(words[some] >> (keys[some] >> shift & 63)) & 1 == 1]
    met[:] = False
    met[some] = True
    return met


def _marks(keys: DataFrame, bits: int = MARKS) -> np.ndarray:
    """A table of so many bits, up to four set for each key in one word, whatever their number: it spares work but decides nothing."""
    bit = F.col("key").bitwiseAND(F.lit(bits - 1))
    # Each bit is below 2^63 or its sign.
    mark = " | ".join(f"shiftleft(1L, cast(shiftright(key, {shift}) & 63 as int))" for shift in BITS)
    words = keys.select(F.shiftright(bit, 6).cast("int").alias("word"), F.expr(mark).alias("mark"))
    found = words.groupBy("word").agg(F.bit_or("mark").alias("marks")).toArrow()
    known = np.zeros(bits // 64, np.int64)
    known[found.column("word").to_numpy()] = found.column("marks").to_numpy()
    return known


def _alike(scratch: common.Scratch, kept: DataFrame, docs: DataFrame, least: int, edits: int) -> DataFrame:
    """(key, doc_id, at, own, size) of segments, and of parts that may be such, that two lines or more have."""
    own = kept.select(F.explode("parts").alias("key"), "doc_id", "at", F.lit(True).alias("own"))
    others = _other_parts(docs, least, edits, _marks(own)).withColumn("own", F.lit(False))
    # Rows are as many as the own segments and are shuffled once; what only one line has goes before lines are looked up.
    # A join after sizes would not do: Spark takes the semi join before it, and with it all rows through two more shuffles.
    same = Window.partitionBy("key")
    rows = own.unionAll(others).withColumn("size", F.count(F.lit(1)).over(same)).withColumn("any", F.max("own").over(same))
    shared = rows.where("size > 1 and any").drop("any")
    return scratch.write(shared.join(kept.select("doc_id", "at"), ["doc_id", "at"], "left_semi").select("doc_id", "at", "key", "own", "size"), "alike", 4)


def _side(rows: DataFrame, name: str, *more: str) -> DataFrame:
    return rows.select("key", *[F.col(c).alias(f"{c}_{name}") for c in ("doc_id", "at", "own", "most", "even", "odd", *more)])


def _earlier() -> Column:
    return (F.col("doc_id_a") < F.col("doc_id_b")) | ((F.col("doc_id_a") == F.col("doc_id_b")) & (F.col("at_a") < F.col("at_b")))


def _close() -> Column:
    """Whether the parities leave it open that two lines are within their edits."""
    differ = F.bit_count(F.col("even_a").bitwiseXOR(F.col("even_b"))) + F.bit_count(F.col("odd_a").bitwiseXOR(F.col("odd_b")))
    return differ <= 4 * F.least("most_a", "most_b")


def _paired(rows: DataFrame, late: DataFrame, firsts: bool = False) -> DataFrame:
    """Pairs of lines that share a key that is one's own and whose parities are close, the earlier one first; without those
    whose later one is in ``late``. ``firsts``: only with the first line of the key that is not in ``late``."""
    left = rows.join(late, ["doc_id", "at"], "left_anti")
    a, b = _side(rows, "a"), _side(left, "b")
    if firsts:
        columns = ("doc_id", "at", "own", "most", "even", "odd")
        a = left.groupBy("key").agg(F.min(F.struct(*columns)).alias("f")).select("key", *[F.col(f"f.{c}").alias(f"{c}_a") for c in columns])
    # A first line that has the key in a part of it may meet another such one here; that does no harm.
    met = _earlier() & _close() if firsts else _earlier() & _close() & (F.col("own_a") | F.col("own_b"))
    found = a.join(b, "key").where(met)
    return found.select(F.col("doc_id_a").alias("doc_a"), "at_a", F.col("doc_id_b").alias("doc_b"), "at_b").distinct()


def _near_earlier(table: pa.Table) -> pa.Table:
    """Of the ``later`` lines of a cell those near one of its ``early`` lines before them."""
    doc, at, own, most, even, odd, early, later = (
        table.column(c).to_numpy() for c in ("doc_id", "at", "own", "most", "even", "odd", "early", "later")
    )
    even, odd = even.view(np.uint64), odd.view(np.uint64)  # of a negative number numpy counts the bits of its absolute value
    lines, size = table.column("line").combine_chunks(), pc.utf8_length(table.column("line")).to_numpy()
    place = np.empty(len(doc), np.int64)
    # Rows that repeat a doc_id have the same place twice; such a line is not before itself.
    order = np.lexsort((at, doc))
    place[order] = np.cumsum(np.concatenate([[0], (np.diff(doc[order]) != 0) | (np.diff(at[order]) != 0)]))
    near = np.zeros(len(doc), bool)
    firsts, others = order[early[order]], order[later[order]]
    for begin in range(0, len(firsts), TILE):
        x = firsts[begin : begin + TILE]
        for start in range(0, len(others), TILE):
            y = others[start : start + TILE]
            y = y[~near[y] & (place[y] > place[x[0]])]
            if not len(y):
                continue
            edits = np.minimum(most[x], most[y, None])
            differ = np.bitwise_count(even[x] ^ even[y, None]).astype(np.int16) + np.bitwise_count(odd[x] ^ odd[y, None])
            open_ = (differ <= 4 * edits) & (place[x] < place[y, None]) & (own[x] | own[y, None]) & (np.abs(size[x] - size[y, None]) <= edits)
            # The first pairs of each line come first; a line that is near needs no other.
            at_y, at_x = np.nonzero(open_)
            turn = np.arange(len(at_y)) - np.searchsorted(at_y, at_y)
            by_turn = np.argsort(turn, kind="stable")
            for first in range(0, len(by_turn), TILE):
                some = by_turn[first : first + TILE]
                some = some[~near[y[at_y[some]]]]
                one, two = y[at_y[some]], x[at_x[some]]
                most_edits = np.minimum(most[one], most[two]).astype(np.int64)
                near[one[within(lines.take(two).to_pylist(), lines.take(one).to_pylist(), most_edits)]] = True
    return pa.table({"doc_id": pa.array(doc[near], pa.int64()), "at": pa.array(at[near], pa.int32())})


def _near_in_crowds(rows: DataFrame, late: DataFrame) -> DataFrame:
    """Places, not in ``late``, of lines that have an earlier one within their edits among those of a key. ``rows`` have the lines.

    A key's lines are dealt into blocks of about ``BLOCK``; every block meets every other in a cell of its own, and a cell
    gives out the lines that are near an earlier one, but no pairs.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    marked = rows.join(late.select("doc_id", "at", F.lit(True).alias("gone")), ["doc_id", "at"], "left")
    marked = marked.withColumn("block", F.pmod(F.xxhash64("at", "doc_id"), blocks).cast("int")).withColumn("left", F.col("gone").isNull())
    every = F.sequence(F.lit(0), blocks - 1)

    def cell(a, b, early, later):
        return F.struct(a.alias("a"), b.alias("b"), early.alias("early"), later.alias("later"))

    own = F.transform(every, lambda j: cell(F.col("block"), j, F.lit(True), F.col("left") & (j == F.col("block"))))
    other = F.transform(F.filter(every, lambda j: F.col("left") & (j != F.col("block"))), lambda j: cell(j, F.col("block"), F.lit(False), F.lit(True)))
    cells = marked.withColumn("cell", F.explode(F.concat(own, other)))
    cells = cells.select("key", "doc_id", "at", "own", "most", "even", "odd", "line", "cell.a", "cell.b", "cell.early", "cell.later")
    return cells.groupBy("key", "a", "b").applyInArrow(_near_earlier, "doc_id long, at int")


def _within_more(scratch: common.Scratch, alike: DataFrame, lines: DataFrame, edits: int, late: DataFrame) -> DataFrame:
    """Places of lines that have an earlier one within their ``allowed`` edits, of two or more, besides those in ``late``."""
    most = F.greatest(F.lit(1), F.least(F.lit(edits), F.floor(F.char_length("line") / EACH))).cast("int")
    marks = lines.select("doc_id", "at", most.alias("most"), "even", "odd", "line")
    rows = scratch.write(alike.join(marks.drop("line"), ["doc_id", "at"]), "marked", 4)
    crowd = rows.where(F.col("size") > LED)
    found, left = late, None
    while not crowd.isEmpty():
        # Most lines of a crowded key are within reach of its first one, most of the others within that of their own first.
        found = scratch.write(found.unionAll(_verified(_paired(crowd, found, True), lines, edits)).distinct(), "led", 8)
        before, left = left, crowd.join(found, ["doc_id", "at"], "left_anti").select("doc_id", "at").distinct().count()
        if before is not None and 10 * left > 9 * before:
            break
    near = _verified(_paired(rows.where(F.col("size") <= PAIRED), found), lines, edits)
    if not rows.where(F.col("size") > PAIRED).isEmpty():
        near = near.unionAll(_near_in_crowds(alike.where(F.col("size") > PAIRED).join(marks, ["doc_id", "at"]), found))
    return scratch.write(found.unionAll(near).distinct(), "near", 8)


def _same_but_one(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Places that follow the first line of a key whose lines agree in all but one character; longer lines are compared."""
    own = rows.where("extra = 0")
    earliest = own.groupBy("key").agg(F.min("doc_id").alias("doc_a"))
    earliest = own.join(earliest, "key").where("doc_id = doc_a").groupBy("key", "doc_a").agg(F.min("at").alias("at_a"))
    behind = own.join(earliest, "key").where("doc_id <> doc_a or at <> at_a").select("doc_id", "at").distinct()
    # Own lines of such a key differ in one place, so there are as many as there are characters.
    mixed = rows.join(rows.where("extra = 1").select("key").distinct(), "key", "left_semi")
    return behind.unionAll(_verified(_pairs(mixed), lines))


def without_repeated_lines(docs: DataFrame, least: int = LEAST, equal: int | None = None, edits: int = 1) -> DataFrame:
    """``docs`` with those lines taken out of ``text``; where there is a column n_chars, it is counted anew."""
    found = repeated_lines(docs, least, equal, edits).where("n_removed > 0").select("doc_id", F.col("row_key").alias("_key"), F.col("removed").alias("_removed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.small(batches):
            at, texts = batch.schema.get_field_index("text"), []
            for text, removed in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if removed is not None:
                    gone = set(removed)
                    text = "\n".join(x for j, x in enumerate(text.split("\n")) if j not in gone)
                texts.append(text)
            kept = list(batch.columns[:-1])
            kept[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(kept, schema=pa.schema(list(batch.schema)[:-1]))

    # One list per doc_id and text; rows that repeat both have the same.
    found = found.dropDuplicates(["doc_id", "_key"])
    met = docs.withColumn("_own", _row_key()).join(
        found.withColumnRenamed("doc_id", "_doc").hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_key")), "left"
    )
    cut = met.select(*docs.columns, "_removed").mapInArrow(run, met.select(*docs.columns).schema)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut
