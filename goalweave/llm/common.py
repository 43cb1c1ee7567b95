"""What the operators share: written intermediate tables, readers, exact ranks without a global sort, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: A word: what lies between the ASCII blanks 0x20 and 0x09 to 0x0D. bytes.split() cuts at just these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; one of our own only in a single-process session that names none (tests)."""
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="goalweave-llm-")
    spark.conf.set(CHECKPOINT_CONF, root)
    return root


class Scratch:
    """Tables of one run, written to the shared folder so that lineage ends there and lost executors lose nothing."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._used = 0

    def path(self, name: str) -> str:
        self._used += 1
        return f"{self.root}/{self._used:03d}-{name}"

    def write(self, df: DataFrame, name: str, part: int = 1) -> DataFrame:
        """``part``: a table of a few numbers per row takes one file for so many shuffle partitions, not one for each."""
        path = self.path(name)
        if part > 1:
            df = df.coalesce(max(partitions(self.spark) // part, 4))
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table from ``write`` that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/" + self.root.rsplit("/", 1)[1] + "/" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def met_by_id(docs: DataFrame, others: DataFrame, how: str = "inner") -> DataFrame:
    """``docs`` joined with rows of some doc_ids, both dealt by id.

    Spark could send a small side to all tasks instead; asking for the merge join keeps the plan, and with it what is
    shuffled, the same at every size.
    """
    return docs.join(others.hint("merge"), "doc_id", how)


def hash_bucket(column: Column, buckets: int) -> Column:
    """0 to buckets - 1, from the upper bits so that it shares nothing with hash partitioning."""
    return F.pmod(F.shiftrightunsigned(F.xxhash64(column), 20), F.lit(buckets)).cast("int")


def bucket_ranks(df: DataFrame, keys: list[str], bucket: str, order: list[Column], rank: str = "rank") -> DataFrame:
    """Add the 0-based rank of each row within ``keys``, ordered by (bucket, order).

    Rows are only ever sorted within one (keys, bucket); a group of any size is ranked by counting its buckets first,
    so no task holds a whole group. The caller's number of distinct buckets bounds the rows of the counting window.
    ``df`` must be a written table: it is read twice and has to be the same both times.
    """
    from pyspark.sql import Window

    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, bucket, F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, bucket).orderBy(*order)
    ranked = df.withColumn("_row", F.row_number().over(within))
    joined = ranked.join(starts, [*keys, bucket])
    return joined.withColumn(rank, (F.col("_start") + F.col("_row") - 1).cast("long")).drop("_start", "_row")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge to another; component is the smallest node reachable.

    ``edges`` has columns u and v of one integer type, in any direction, with repeats and loops. Alternating large-star
    and small-star: each turn links a node's larger (then smaller) neighbours to its smallest one, until every edge
    points at the root. The smallest neighbour is a combined aggregate and the links are joins, which Spark splits where
    a node is hot; the state is written each turn.
    """
    oriented = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, mark = scratch.write(oriented, "edges", 8), None
    while True:
        following = scratch.write(_small_star(_large_star(current)), "stars", 8)
        # The sum of many hashes may pass 2^63; a decimal holds it.
        row = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(current)
        current = following
        if mark == (row[0], row[1]):
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = (row[0], row[1])
