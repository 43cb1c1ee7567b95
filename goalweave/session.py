"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Settings a standalone run wants; on a cluster the submitting side decides and these stay untouched.
LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Test data is small: let it spread over the cores all the same.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def local_session(cores: int | str = "*", app: str = "goalweave", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names."""
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
    return root


def checkpoint_path(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_root(spark), name)
