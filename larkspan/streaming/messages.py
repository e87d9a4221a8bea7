"""Live messages with Structured Streaming.

``foreachBatch`` may run a batch twice, so every batch writes to a path named by its id and replaces
what an earlier try left there. Readers see the union of the batch folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from larkspan.functions.chat import role_line
from larkspan.operators.messages import allowed, merge_logs, routed

# Fixed value: time between two merges of new messages into the history.
MERGE_INTERVAL = "5 minutes"


def message_stream(spark: SparkSession, path: str, schema: StructType, glob: str | None = None) -> DataFrame:
    """Messages that arrive as parquet files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def once_per_message(stream: DataFrame, delay: str = "1 hour", key: str = "msg_id", time: str = "date") -> DataFrame:
    """Optional: drop repeated ids within the delay. Off by default, because repeats are kept."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def _start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, live: str | None):
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": live} if live else {"availableNow": True}
    return writer.trigger(**trigger).start()


def batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def start_logs(stream: DataFrame, path: str, debug: str, checkpoint: str, live: str | None = None) -> StreamingQuery:
    """H1, H3. Every message to the log of its chat; messages without chat and sender to the debug sink.

    A log is a contiguous range of the batch's files, sorted by date, so a reader of one chat skips the
    others by their statistics, and a busy chat is cut over several files. ``live`` is a trigger
    interval; without it the query ends when the present input is done.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = routed(batch).persist()
        logs = rows.where("log IS NOT NULL").repartitionByRange("log", "date").sortWithinPartitions("log", "date")
        logs.write.mode("overwrite").parquet(batch_path(path, batch_id))
        rows.where("log IS NULL").drop("log").write.mode("overwrite").parquet(batch_path(debug, batch_id))
        rows.unpersist()

    return _start(stream, write, checkpoint, live)


def start_merge(
    stream: DataFrame, path: str, checkpoint: str, live: str | None = MERGE_INTERVAL
) -> StreamingQuery:
    """H2. Append what has arrived, once per interval; ``fold_history`` merges it into the sorted history."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_path(path, batch_id))

    return _start(stream, write, checkpoint, live)


def start_sender_log(
    stream: DataFrame, senders: DataFrame, path: str, checkpoint: str, live: str | None = None
) -> StreamingQuery:
    """H5. Messages of allowed senders as role-prefixed lines per sender."""
    lines = allowed(stream, senders).select(
        "sender_id", role_line(F.col("date"), F.col("is_assistant"), F.col("text")).alias("line")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_path(path, batch_id))

    return _start(lines, write, checkpoint, live)


def _finished(spark: SparkSession, path: str, key: str) -> list[int]:
    """Numbers of the finished folders ``key=number`` below the path, in order; few, as folding removes them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}=*/_SUCCESS")) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_batches(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """All finished batches of a sink; with a schema, no rows before the first one."""
    if schema is not None and not _finished(spark, path, "batch"):
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def _read_all(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_history(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """H2. The history with every line's place, newest first: the folded part and the batches after it."""
    done = max(_finished(spark, f"{path}/history", "upto"), default=None)
    later = [b for b in _finished(spark, path, "batch") if done is None or b > done]
    new = _read_all(spark, [batch_path(path, b) for b in later], schema)
    placed = StructType([*schema, StructField("place", LongType())])
    folded = _read_all(spark, [] if done is None else [f"{path}/history/upto={done}"], placed)
    return merge_logs(new, folded) if later else folded


def fold_history(spark: SparkSession, path: str, schema: StructType) -> None:
    """H2. Merge finished batches into one sorted history and remove them.

    The new history is named by its last batch and counts once it is complete, so a lost run leaves the old
    state, and one that ends before the removal only leaves folders that no reader looks at.
    """
    batches = _finished(spark, path, "batch")
    old = _finished(spark, f"{path}/history", "upto")
    if not batches or (old and batches[-1] <= old[-1]):
        return
    merged = read_history(spark, path, schema).select(*schema.names, "place")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = merged.repartitionByRange(files, "chat", "place").sortWithinPartitions("chat", "place")
    ordered.write.mode("overwrite").parquet(f"{path}/history/upto={batches[-1]}")
    for gone in [f"{path}/history/upto={n}" for n in old] + [batch_path(path, b) for b in batches]:
        _remove(spark, gone)
