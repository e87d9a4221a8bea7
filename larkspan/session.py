"""Session set-up and the few helpers every module shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# What every job needs for right results; the rest is left to the cluster.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# A table of at most this many rows may be held in the plan instead of in a file.
SMALL_ROWS = 10_000


def build_session(app_name: str = "larkspan", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    Keyword arguments are Spark settings with ``__`` for ``.``. On a cluster the master, memory and
    ``spark.checkpoint.dir`` come from spark-submit.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One test table. The filter and the columns a query names reach the scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and staged tables, reachable by every executor.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, where driver and executors
    are one process, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(os.path.join(tempfile.mkdtemp(prefix="larkspan-"), "checkpoints"))
    return context.getCheckpointDir()


def staging_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused, so retries cannot mix runs.

    All paths of an application share one folder, which can go when the application has ended.
    """
    folder = f"{shared_dir(spark).rstrip('/')}/staged/{spark.sparkContext.applicationId}"
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint()


def small(frame: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """A per-group table of few rows, computed once and held in the plan itself.

    For aggregates that have a handful of rows in practice, such as statistics per room count. The size
    is checked: with more than ``max_rows`` rows the table is written like any other by ``settle``.
    """
    head = frame.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows:
        return settle(frame)
    return frame.sparkSession.createDataFrame(head, frame.schema)


def settle(frame: DataFrame) -> DataFrame:
    """Write a narrow frame or an aggregate to the shared folder and read it back.

    Two effects: it is computed once although several branches use it, and the planner now knows its
    real size, so it becomes a broadcast side only below ``spark.sql.autoBroadcastJoinThreshold`` and
    a shuffled side above it. A written table outlives lost executors, a cached one does not.
    """
    spark = frame.sparkSession
    path = staging_path(spark, "table")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
