"""Live state from a stream of edits, with Structured Streaming.

State is one row per user, so it is bounded by the number of users and needs no watermark; edits may arrive in any
order because the latest is chosen by (ts, seq). Queries run in update mode: a trigger emits only the users it
touched. Each trigger's rows go to their own folder, written whole, so a batch that is run again after a failure
replaces itself instead of adding rows twice.

``fold`` merges triggers into a snapshot. What counts is named by a numbered *manifest*: a file of one line that appears by one rename
once its snapshot is whole. A fold never touches what it reads, so one that dies at any point leaves the state as
it was before or as it is after; and what a manifest replaced goes only when the next but one appears, so readers
have the time between two folds to finish.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import state
from ..plans import population as jobs
from ..session import checkpoint_path
from ..sources.population import edits_from_events
from ..sources.tables import SCHEMAS

BATCH = "batch_id"
SNAPSHOTS, MANIFEST = "snapshots", "manifest-"
BUCKET = "user_bucket"


def edit_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Edits from a folder of event files; each trigger takes what is new, or at most so many files."""
    reader = spark.readStream.schema(SCHEMAS["events"])
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return edits_from_events(reader.parquet(path))


def pool_states(edits: DataFrame) -> DataFrame:
    return state.latest_pool_state(edits)


def holdings_totals(edits: DataFrame) -> DataFrame:
    return state.live_holdings_total(edits)


def start(rows: DataFrame, target: str, name: str, per_batch=None, once: bool = True) -> StreamingQuery:
    """Write each trigger's changed rows under ``target``; ``per_batch`` may turn them into something else first.

    ``once`` works off what is there and stops; otherwise the query keeps running.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # Used more than once, a batch would be computed anew each time.
        kept = batch if per_batch is None else batch.persist()
        try:
            out = kept if per_batch is None else per_batch(kept)
            out.write.mode("overwrite").parquet(f"{target}/{BATCH}={batch_id}")
        finally:
            if per_batch is not None:
                kept.unpersist()

    writer = (
        rows.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint_path(rows.sparkSession, f"streams/{name}"))
        .foreachBatch(write)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


@dataclass(frozen=True)
class GoalStore:
    """Goals on storage in folders by a hash of the user, so that a trigger reads only the folders of the users it touched."""

    folder: str
    buckets: int

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("user_id"), F.lit(self.buckets)).cast("int")

    def write(self, goals: DataFrame) -> None:
        """Lay out all goals. A large bucket is written by several tasks, small ones share one."""
        laid = goals.withColumn(BUCKET, self.bucket()).repartitionByRange(BUCKET, "user_id")
        laid.write.partitionBy(BUCKET).parquet(self.folder)

    def of(self, users: DataFrame) -> DataFrame:
        """Goals in the buckets of these users (and of others that share one). Only bucket numbers come to the driver."""
        touched = sorted(r[0] for r in users.select(self.bucket().alias(BUCKET)).distinct().collect())
        goals = users.sparkSession.read.parquet(self.folder)
        return goals.where(F.col(BUCKET).isin(touched)).drop(BUCKET)


def start_plans(edits: DataFrame, goals: DataFrame | GoalStore, target: str, name: str, once: bool = True) -> StreamingQuery:
    """Plans of the users each trigger touched, recomputed from their latest pool, savings and inflation."""

    def plans(pools: DataFrame) -> DataFrame:
        mine = goals.of(pools) if isinstance(goals, GoalStore) else goals
        return jobs.goal_plans(pools.sparkSession, mine, pools)

    return start(pool_states(edits), target, name, plans, once)


def _at(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, path = _at(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []


def _delete(spark: SparkSession, folder: str) -> None:
    files, path = _at(spark, folder)
    files.delete(path, True)


def _numbers(spark: SparkSession, target: str) -> list[int]:
    """Ascending numbers of the triggers that were written to the end."""
    found = [n for n in _names(spark, target) if n.startswith(f"{BATCH}=")]
    return sorted(int(n.split("=")[1]) for n in found if "_SUCCESS" in _names(spark, f"{target}/{n}"))


def _manifests(spark: SparkSession, target: str) -> list[int]:
    names = _names(spark, f"{target}/{SNAPSHOTS}")
    return sorted(int(n.removeprefix(MANIFEST)) for n in names if n.startswith(MANIFEST))


def _manifest(spark: SparkSession, target: str, number: int) -> tuple[str | None, int]:
    """Folder of the snapshot and the last trigger in it; before the first manifest there is neither."""
    if number < 1:
        return None, -1
    line = spark.read.text(f"{target}/{SNAPSHOTS}/{MANIFEST}{number:09d}", wholetext=True).first()[0]
    said = json.loads(line)
    return said["rows"], said["upto"]


def _publish(spark: SparkSession, target: str, number: int, rows: str, upto: int) -> None:
    """Make a snapshot count: one rename."""
    folder = f"{target}/{SNAPSHOTS}"
    files, draft = _at(spark, f"{folder}/draft-{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray(json.dumps({"rows": rows, "upto": upto}).encode()))
    out.close()
    final = _at(spark, f"{folder}/{MANIFEST}{number:09d}")[1]
    if files.exists(final) or not files.rename(draft, final):
        raise RuntimeError(f"another fold of {target} has written {final.getName()}")


def _clear(spark: SparkSession, target: str) -> None:
    """Delete what neither the newest manifest nor the one before it needs."""
    manifests = _manifests(spark, target)
    newest = manifests[-1] if manifests else 0
    needed = [_manifest(spark, target, n) for n in (newest - 1, newest)]
    rows, upto = {r for r, _ in needed}, needed[0][1]
    for name in _names(spark, target):
        if name.startswith(f"{BATCH}=") and int(name.split("=")[1]) <= upto:
            _delete(spark, f"{target}/{name}")
    for name in _names(spark, f"{target}/{SNAPSHOTS}"):
        old = name.startswith(MANIFEST) and int(name.removeprefix(MANIFEST)) < newest - 1
        if old or (not name.startswith((MANIFEST, ".")) and name not in rows):
            _delete(spark, f"{target}/{SNAPSHOTS}/{name}")


def _rows(spark: SparkSession, target: str) -> tuple[DataFrame, list[int], int]:
    """Rows of the newest snapshot and of all triggers after it, those triggers, and the newest manifest's number."""
    newest = (_manifests(spark, target) or [0])[-1]
    snapshot, upto = _manifest(spark, target, newest)
    later = [b for b in _numbers(spark, target) if b > upto]
    parts = [spark.read.parquet(f"{target}/{BATCH}={b}").withColumn(BATCH, F.lit(b)) for b in later]
    if snapshot:
        parts.insert(0, spark.read.parquet(f"{target}/{SNAPSHOTS}/{snapshot}").withColumn(BATCH, F.lit(upto)))
    if not parts:
        raise ValueError(f"no trigger has written to {target} yet")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows, later, newest


def _newest(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    columns = [c for c in rows.columns if c not in (*keys, BATCH)]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), BATCH).alias("row"))
    return newest.select(*keys, "row.*")


def latest(spark: SparkSession, target: str, *keys: str) -> DataFrame:
    """Newest row per key over all triggers. Folded per key before the shuffle, so often-changed keys stay cheap.

    The result stays readable over one fold that comes after it.
    """
    return _newest(_rows(spark, target)[0], keys)


def fold(spark: SparkSession, target: str, *keys: str) -> None:
    """Merge all triggers so far into a new snapshot, so that ``latest`` reads one row per key and the triggers since.

    One fold of a target at a time. Without new triggers there is nothing to merge.
    """
    rows, later, number = _rows(spark, target)
    if later:
        name = f"rows-{uuid.uuid4().hex}"
        _newest(rows, keys).write.parquet(f"{target}/{SNAPSHOTS}/{name}")
        _publish(spark, target, number + 1, name, later[-1])
    _clear(spark, target)
