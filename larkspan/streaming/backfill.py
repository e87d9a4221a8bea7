"""History of chats, page by page, and the hand-over to live messages.

The state of a chat is the newest message that belongs to its history, the oldest one that was got, and whether
all are. A round gets the next pages of all unfinished chats and publishes the messages together with the new
state, so a job that is stopped goes on where it was. Live messages count from after a chat's boundary on,
whatever the stream delivers before, so that none is missing and none is there twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspan.operators.messages import HISTORY_PAGE
from larkspan.session import settle
from larkspan.sources import versions

# Pages of each chat that one round gets.
PAGES = 50

_STATE = "chat long, boundary long, oldest long, done boolean"


def _state(spark: SparkSession, content: dict) -> DataFrame:
    folder = content.get("state")
    return spark.read.schema(_STATE).parquet(folder) if folder else spark.createDataFrame([], _STATE)


def state(spark: SparkSession, path: str) -> DataFrame:
    """H4. chat, boundary (newest id of the history, NULL without one), oldest (id got so far), done."""
    return _state(spark, versions.current(spark, f"{path}/history")[1])


def begin(chats: DataFrame, source: DataFrame, path: str) -> None:
    """H4. Chats without a state get one: their history ends at the newest message that the source has now."""
    spark = chats.sparkSession
    number, content = versions.current(spark, f"{path}/history")
    known = _state(spark, content)
    fresh = chats.select("chat").where("chat IS NOT NULL").distinct().join(known.select("chat"), "chat", "left_anti")
    newest = source.groupBy("chat").agg(F.max("msg_id").alias("boundary"))
    added = fresh.join(newest, "chat", "left").select(
        "chat", "boundary", (F.col("boundary") + 1).alias("oldest"), F.col("boundary").isNull().alias("done")
    )
    folder = versions.fresh(f"{path}/history", "state")
    known.unionByName(added).write.parquet(folder)
    versions.publish(spark, f"{path}/history", content | {"state": folder}, number)


def get_round(source: DataFrame, path: str, pages: int = PAGES, page: int = HISTORY_PAGE) -> bool:
    """F11. The next pages of every unfinished chat; False if all chats were finished before.

    A chat gives its newest messages below the oldest one got; it is finished when it has no more of them than
    were asked for. Spark limits each chat before the shuffle, so a busy chat moves no more than its pages.
    """
    spark, home = source.sparkSession, f"{path}/history"
    number, content = versions.current(spark, home)
    chats = _state(spark, content)
    open_chats = chats.where("NOT done").select("chat", "oldest")
    if open_chats.isEmpty():
        return False
    back = F.row_number().over(Window.partitionBy("chat").orderBy(F.col("msg_id").desc()))
    older = source.join(open_chats, "chat").where(F.col("msg_id") < F.col("oldest")).drop("oldest")
    # One more than is kept tells whether there is more.
    taken = older.withColumn("_back", back).where(F.col("_back") <= pages * page + 1)
    folder = versions.fresh(home, "messages")
    found = settle(taken)
    found.where(F.col("_back") <= pages * page).drop("_back").write.parquet(folder)
    got = found.groupBy("chat").agg(
        F.min(F.when(F.col("_back") <= pages * page, F.col("msg_id"))).alias("_lowest"), F.max("_back").alias("_found")
    )
    after = chats.join(got, "chat", "left").select(
        "chat", "boundary", F.coalesce("_lowest", "oldest").alias("oldest"),
        (F.col("done") | (F.coalesce("_found", F.lit(0)) <= pages * page)).alias("done"),
    )
    kept = versions.fresh(home, "state")
    after.write.parquet(kept)
    versions.publish(spark, home, content | {"state": kept, "messages": [*content.get("messages", []), folder]}, number)
    return True


def backfill(source: DataFrame, path: str, pages: int = PAGES, page: int = HISTORY_PAGE, max_rounds: int | None = None) -> int:
    """F11. Rounds until every chat is finished or ``max_rounds`` are done; returns their number. May be called again."""
    rounds = 0
    while (max_rounds is None or rounds < max_rounds) and get_round(source, path, pages, page):
        rounds += 1
    return rounds


def start_live(stream: DataFrame, path: str, checkpoint: str, live: str | None = None) -> StreamingQuery:
    """H4. Live messages as they come, each batch once. What belongs to the history is left out when they are read."""
    home = f"{path}/live"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        number, content = versions.current(spark, home)
        if batch_id <= content.get("last_batch", -1):
            return
        folder = versions.fresh(home, "messages")
        batch.write.parquet(folder)
        versions.publish(spark, home, {"messages": [*content.get("messages", []), folder], "last_batch": batch_id}, number)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"processingTime": live} if live else {"availableNow": True})).start()


def read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """H4. Every message got so far, once, with ``part`` history or live; ``like`` has the messages' columns.

    A live message counts if its chat has no history or it is newer than the history's boundary. Live messages
    without a chat, and of chats without a state, all count.
    """

    def stored(home: str) -> DataFrame:
        folders = versions.current(spark, f"{path}/{home}")[1].get("messages", [])
        return spark.read.schema(like.schema).parquet(*folders) if folders else spark.createDataFrame([], like.schema)

    limits = state(spark, path).select("chat", "boundary")
    newer = F.col("boundary").isNull() | (F.col("msg_id") > F.col("boundary"))
    live = stored("live").join(limits, "chat", "left").where(newer).select(*like.columns, F.lit("live").alias("part"))
    return stored("history").select(*like.columns, F.lit("history").alias("part")).unionByName(live)
