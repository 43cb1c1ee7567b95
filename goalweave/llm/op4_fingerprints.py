"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Every three consecutive bytes of the UTF-8 text, and every three with one byte left out between them, are hashed into
``BUCKETS`` counts. A bucket's two bits say in which quartile of all the document's buckets its count lies, so the
digest hardly depends on the length, which is kept beside it on a logarithmic scale. The fingerprint is that length
byte and the bits as lowercase hex. Equal texts have equal fingerprints.

Two fingerprints are compared by the sum of their buckets' quartile differences and the difference of their lengths,
against what unrelated digests differ by on average: the likeness is 1 for equal ones and bounded by 0 from below.

Null and empty texts have an empty digest (length 0, all bits 0); it is like another empty one (1) and unlike all
others (0). Rows that share a doc_id are ordered by text, null ids come last. A table of one row follows itself; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, kernels

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 256
#: Steps of the length byte per doubling, and the weight of one step against one quartile of one bucket.
LENGTH_STEPS, LENGTH_WEIGHT = 8, 2
#: The quartiles of two unrelated documents' buckets differ by 1.25 on average.
UNRELATED = 1.25 * BUCKETS
#: Bytes counted at once.
CHUNK = 4_000_000


def _counts(texts: list[bytes]) -> np.ndarray:
    """Triplet counts of each text, as (texts, BUCKETS)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint32), sizes)
    total = np.zeros(len(texts) * BUCKETS, dtype=np.int64)
    for i, (a, b, c) in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 3))):
        n = len(data) - c
        if n <= 0:
            continue
        h = data[a : a + n] * np.uint32(2654435761) + data[b : b + n] * np.uint32(2246822519)
        h += data[c : c + n] * np.uint32(3266489917) + np.uint32(668265263 * i)
        h ^= h >> np.uint32(15)
        h *= np.uint32(2246822519)
        h >>= np.uint32(24)
        same = owner[a : a + n] == owner[c : c + n]
        key = owner[a : a + n] * np.uint32(BUCKETS) + h
        total += np.bincount(key[same], minlength=len(total))
    return total.reshape(len(texts), BUCKETS)


def digests(texts: list[bytes]) -> np.ndarray:
    """(texts, BUCKETS + 1): the length step, then each bucket's quartile 0 to 3."""
    found = np.zeros((len(texts), BUCKETS + 1), dtype=np.int16)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        counts = _counts(texts[at:end])
        ranked = np.sort(counts, axis=1)
        for quarter in (1, 2, 3):
            cut = ranked[:, quarter * BUCKETS // 4 - 1]
            found[at:end, 1:] += counts > cut[:, None]
        at = end
    sizes = np.array([len(t) for t in texts], dtype=np.float64)
    steps = np.floor(LENGTH_STEPS * np.log2(np.maximum(sizes, 1))).astype(np.int16) + 1
    found[:, 0] = np.where(sizes > 0, np.minimum(steps, 255), 0)
    return found


def written(found: np.ndarray) -> list[str]:
    """Fingerprints as text."""
    quads = found[:, 1:].reshape(len(found), -1, 4)
    packed = quads @ np.array([64, 16, 4, 1])
    raw = np.concatenate([found[:, :1], packed], axis=1).astype(np.uint8)
    return [row.tobytes().hex() for row in raw]


def read(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8)
    bits = (raw[1:, None] >> np.array([6, 4, 2, 0], dtype=np.uint8)) & 3
    return np.concatenate([raw[:1].astype(np.int16), bits.reshape(-1).astype(np.int16)])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, 0 to 1."""
    apart = np.abs(a[:, 1:] - b[:, 1:]).sum(axis=1) + LENGTH_WEIGHT * np.abs(a[:, 0] - b[:, 0])
    score = np.clip(1 - apart / UNRELATED, 0, 1)
    empty_a, empty_b = a[:, 0] == 0, b[:, 0] == 0
    return np.where(empty_a | empty_b, (empty_a & empty_b).astype(float), score)


def compared(fingerprint_a: str, fingerprint_b: str) -> float:
    return float(likeness(read(fingerprint_a)[None], read(fingerprint_b)[None])[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.small(batches):
            found = written(digests([kernels.as_bytes(t) for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


LAST_ID = 2**63 - 1


def _bounds(docs: DataFrame, ranges: int) -> list[int]:
    """Distinct ids, ascending, that split the table into about as many equal ranges; at most one per partition."""
    steps = [i / ranges for i in range(ranges)]
    row = docs.agg(F.min("place").alias("least"), F.percentile_approx("place", steps, max(10_000, 20 * ranges)).alias("cuts")).first()
    return sorted({row["least"], *row["cuts"]}) if row["cuts"] else []


def _range_of(place: Column, bounds: list[int]) -> Column:
    """How many of the bounds after the first lie at or below ``place``: a binary search inside the row."""
    inner = F.array(*[F.lit(b) for b in bounds[1:]]) if len(bounds) > 1 else F.array().cast("array<bigint>")
    n = len(bounds) - 1
    steps = [1 << k for k in range(n.bit_length() - 1, -1, -1)] if n else []
    if not steps:
        return F.lit(0)

    def further(at: Column, step: Column) -> Column:
        reached = F.get(inner, at + step - 1)
        return F.when((at + step <= n) & (reached <= place), at + step).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)


COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, and that of its text with the last quarter replaced by the start of the next document.

    One shuffle: rows go to ranges of doc_id, and the first rows of a range go to the range before it as well (to the
    last range, those of the first), so that each task sees every row's successor. Rows of one id share a range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("place", F.coalesce("doc_id", F.lit(LAST_ID)))
    ranges = common.partitions(spark)
    bounds = _bounds(rows.select("place"), ranges)
    n = max(1, len(bounds))
    at = _range_of(F.col("place"), bounds)
    own = F.struct(at.alias("range"), F.lit(False).alias("ahead"))
    before = F.struct(F.pmod(at - 1, F.lit(n)).alias("range"), F.lit(True).alias("ahead"))
    copies = F.when(F.col("place").isin(bounds), F.array(own, before)).otherwise(F.array(own))
    both = rows.select("doc_id", "text", F.explode(copies).alias("to")).select("doc_id", "text", "to.*")
    order = ["range", "ahead", F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    dealt = both.repartitionByRange(n, "range").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in kernels.small(batches):
            held += zip(*[batch.column(i).to_pylist() for i in range(4)])
            if not held:
                continue
            yield _finished(held)
            # The last own row waits for its successor; what is ahead of a range only serves the row before it.
            held = [] if held[-1][3] else held[-1:]

    def _finished(held: list[tuple]) -> pa.RecordBatch:
        at = [i for i, (a, b) in enumerate(zip(held, held[1:])) if not a[3] and a[2] == b[2]]
        texts = [row[1] or "" for row in held]
        edited = []
        for i in at:
            cut = len(texts[i]) // 4
            edited.append((texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut]).encode())
        found = digests([t.encode() for t in texts])
        here = np.array(at, dtype=np.int64)
        plain, following, changed = found[here], found[here + 1], digests(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([held[i][0] for i in at], pa.int64()),
                pa.array([len(texts[i]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array(written(plain), pa.string()),
                pa.array(written(changed), pa.string()),
                pa.array(likeness(plain, changed), pa.float64()),
                pa.array(likeness(plain, following), pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return dealt.select("doc_id", "text", "range", "ahead").mapInArrow(run, COMPARED)
