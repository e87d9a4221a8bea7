"""Messages: last turns per chat, merges, routing, allowed senders.

A message has chat, msg_id, date, text, media_kind and is_out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions import chat as C
from larkspan.operators.skew import MAX_GROUP_ROWS, number_rows
from larkspan.session import settle

# Turns in a prompt and messages per history page.
LAST_TURNS = 15
HISTORY_PAGE = 100


def last_messages(messages: DataFrame, count: int = LAST_TURNS) -> DataFrame:
    """F3. The newest messages per chat with ``back`` = 1 for the newest.

    The limit is applied per task before the shuffle, so a busy chat moves only ``count`` rows per task.
    """
    back = F.row_number().over(Window.partitionBy("chat").orderBy(F.col("msg_id").desc()))
    return messages.withColumn("back", back).where(F.col("back") <= count)


def prompts(messages: DataFrame, template: str = "{history}", count: int = LAST_TURNS) -> DataFrame:
    """F3, B29. One prompt per chat: its last turns, oldest first, in the template."""
    last = last_messages(messages, count).select(
        "chat", "msg_id", C.turn_line(F.col("is_out"), F.col("text")).alias("line")
    )
    # At most ``count`` rows per chat are collected.
    lines = F.sort_array(F.collect_list(F.struct("msg_id", "line")))
    history = F.array_join(F.transform(lines, lambda m: m["line"]), "\n")
    return last.groupBy("chat").agg(C.prompt(template, history).alias("prompt"))


def merge_logs(new: DataFrame, history: DataFrame, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """G1, F4. New and stored lines (chat, date, position) of a chat with their place, newest first.

    Lines of one date keep their order, new before stored; lines without a date come last. Repeats stay.
    A history that has places keeps the order they give.
    """
    both = new.withColumn("origin", F.lit(0)).unionByName(history.withColumn("origin", F.lit(1)), True)
    order = [F.col("date").desc_nulls_last(), F.col("origin"), F.col("position")]
    if "place" in both.columns:
        both = both.withColumnRenamed("place", "_stored")
        order.insert(2, F.col("_stored"))
        return number_rows(settle(both), ["chat"], order, "place", max_group_rows).drop("_stored")
    # Written once, as the numbering first counts the chats.
    return number_rows(settle(both), ["chat"], order, "place", max_group_rows)


def history_page(messages: DataFrame, before_id: int | None = None, count: int = HISTORY_PAGE) -> DataFrame:
    """F11. The next page of older messages, newest first."""
    older = messages if before_id is None else messages.where(F.col("msg_id") < before_id)
    return older.orderBy(F.col("msg_id").desc()).limit(count)


def private_chats(dialogs: DataFrame) -> DataFrame:
    """C9, B28. Ids of the private chats."""
    return dialogs.where("is_user").select(C.chat_id(F.col("username"), F.col("entity_id")).alias("chat"))


def is_stop_word(text: Column) -> Column:
    """C9. The message ends the dialogue."""
    return F.lower(text) == C.STOP_WORD


def allowed(messages: DataFrame, senders: DataFrame, key: str = "sender_id") -> DataFrame:
    """D9. Messages of the listed senders; the planner broadcasts the list if it is small."""
    return messages.join(senders.select(key), key, "left_semi")


def routed(messages: DataFrame) -> DataFrame:
    """H3. Target log of each message: its chat, else ``id<sender>``, else NULL for the debug sink."""
    by_chat = F.when(F.col("chat_id").isNotNull(), C.chat_id(F.col("chat_username"), F.col("chat_id")))
    by_sender = C.chat_id(F.col("sender_username"), F.col("sender_id"))
    return messages.withColumn("log", F.coalesce(by_chat, by_sender))


def missing_history(chats: DataFrame, stored: DataFrame) -> DataFrame:
    """H4. Chats that have no stored history yet and so need a backfill."""
    return chats.join(stored.select("chat").distinct(), "chat", "left_anti")
