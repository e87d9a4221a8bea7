"""A message history in sorted runs, merged by levels.

Each batch becomes a run of its own. When a level holds so many runs, they are merged into one run of the next, so a
line is written again only as often as there are levels, the logarithm of the history. A line keeps the number
of the batch it came with, and its place in the chat is computed when the history is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from larkspan.operators.skew import MAX_GROUP_ROWS, number_rows
from larkspan.sources import versions
from larkspan.streaming.messages import MERGE_INTERVAL

# Runs of a level that are merged into one of the next.
FAN = 8


def _sorted_run(lines: DataFrame, folder: str, level: int) -> None:
    """Files of merged runs are ranges of chat and date, so that a reader of one chat skips the others and a busy chat has several.

    Their number is that of the shuffle's partitions, of which Spark merges small ones; a batch stays in its own.
    """
    ranges = lines.repartitionByRange("chat", "date") if level else lines
    ranges.sortWithinPartitions("chat", "date", "run", "position").write.parquet(folder)


def add_run(lines: DataFrame, path: str, batch_id: int | None = None, level: int = 0) -> None:
    """H2. Lines (chat, date, position) as the newest run. A batch that is already there is not added again."""
    spark = lines.sparkSession
    number, content = versions.current(spark, path)
    runs, last = content.get("runs", []), content.get("last_batch", -1)
    if batch_id is not None and batch_id <= last:
        return
    run, folder = content.get("next", 0), versions.fresh(path, "run")
    _sorted_run(lines.withColumn("run", F.lit(run).cast("long")), folder, level)
    content |= {"runs": [*runs, [folder, level]], "next": run + 1}
    if batch_id is not None:
        content["last_batch"] = batch_id
    versions.publish(spark, path, content, number)


def _read_runs(spark: SparkSession, folders: list[str], schema: StructType) -> DataFrame:
    placed = StructType([*schema, StructField("run", LongType())])
    return spark.read.schema(placed).parquet(*folders) if folders else spark.createDataFrame([], placed)


def merge_levels(spark: SparkSession, path: str, schema: StructType, fan: int = FAN) -> list[int]:
    """H2. Merge the runs of every full level; returns the levels that were. Other runs are not touched."""
    merged, level = [], 0
    while True:
        number, content = versions.current(spark, path)
        runs = content.get("runs", [])
        full = [folder for folder, at in runs if at == level]
        if len(full) >= fan:
            folder = versions.fresh(path, "run")
            _sorted_run(_read_runs(spark, full, schema), folder, level + 1)
            content["runs"] = [r for r in runs if r[1] != level] + [[folder, level + 1]]
            versions.publish(spark, path, content, number)
            merged.append(level)
        elif not any(at > level for _, at in runs):
            return merged
        level += 1


def read(spark: SparkSession, path: str, schema: StructType, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """H2. The history with the run of every line and its place in the chat, newest date first.

    Lines of one date keep their order within a run, later runs come before earlier ones, lines without a date last:
    the order that merging the batches one after another gives.
    """
    content = versions.current(spark, path)[1]
    lines = _read_runs(spark, [folder for folder, _ in content.get("runs", [])], schema)
    order = [F.col("date").desc_nulls_last(), F.col("run").desc(), F.col("position")]
    return number_rows(lines, ["chat"], order, "place", max_group_rows)


def start(stream: DataFrame, path: str, checkpoint: str, live: str | None = MERGE_INTERVAL, fan: int = FAN) -> StreamingQuery:
    """H2. Add what has arrived once per interval and merge full levels."""
    schema = stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        add_run(batch, path, batch_id)
        merge_levels(batch.sparkSession, path, schema, fan)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"processingTime": live} if live else {"availableNow": True})).start()
