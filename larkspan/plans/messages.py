"""Message operators: ``events`` as messages (user = chat) and ``conversations`` as dialogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators import messages as G
from larkspan.plans.catalog import query
from larkspan.session import load, staging_path
from larkspan.streaming import backfill, tiers
from larkspan.streaming import messages as T

MINUTE = "yyyy-MM-dd HH:mm"


def event_messages(events: DataFrame) -> DataFrame:
    """Events as messages; works on a batch and on a stream."""
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("chat"),
        F.col("event_id").alias("msg_id"),
        F.col("ts").cast("timestamp").alias("date"),
        F.when(kind != "error", F.col("props")).alias("text"),
        F.when(kind == "view", "photo").alias("media_kind"),
        (kind == "purchase").alias("is_out"),
        (kind == "purchase").alias("is_assistant"),
        F.col("user_id").alias("sender_id"),
        F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("user"), "user_id")).alias("sender_username"),
        F.when(kind.isin("view", "click"), F.col("user_id") + 1000).alias("chat_id"),
        F.when((kind == "view") & (F.col("user_id") % 2 == 0), F.concat(F.lit("chat"), "user_id")).alias("chat_username"),
    )


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return event_messages(load(spark, d, "events"))


@query("SELECT user_id AS chat, event_id AS msg_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back "
       "FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 15")  # fmt: skip
def f3_last_messages(spark: SparkSession, d: str) -> DataFrame:
    return G.last_messages(_messages(spark, d)).select("chat", "msg_id", F.col("back").cast("long").alias("back"))


@query(
    """WITH last AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 'Я' ELSE 'Пользователь' END || ': ' ||
  CASE WHEN event_type = 'error' THEN '<медиа-контент>' ELSE props END AS line FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 15)
SELECT user_id AS chat, 'Reply to:' || chr(10) || string_agg(line, chr(10) ORDER BY event_id) AS prompt FROM last GROUP BY user_id"""
)
def f3_chat_prompts(spark: SparkSession, d: str) -> DataFrame:
    return G.prompts(_messages(spark, d), template="Reply to:\n{history}")


@query(
    """WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'Я' ELSE 'Пользователь' END || ': ' || text AS line
  FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 15)
SELECT conv_id AS chat, string_agg(line, chr(10) ORDER BY turn) AS prompt FROM t GROUP BY conv_id"""
)
def b29_conversation_prompts(spark: SparkSession, d: str) -> DataFrame:
    turns = load(spark, d, "conversations").select(
        F.col("conv_id").alias("chat"), F.col("turn").alias("msg_id"), "text", (F.col("role") == "assistant").alias("is_out")
    )
    return G.prompts(turns)


def _log_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """New messages are the clicks, the history is the rest; errors have no date."""
    rows = load(spark, d, "events").select(
        F.col("user_id").alias("chat"),
        F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy-MM-dd")).alias("date"),
        F.col("event_id").alias("position"),
        "event_type",
    )
    new, history = rows.where("event_type = 'click'"), rows.where("event_type <> 'click'")
    return new.drop("event_type"), history.drop("event_type")


MERGED = """SELECT user_id AS chat, CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d') END AS date, event_id AS position,
  CAST(event_type <> 'click' AS INTEGER) AS origin FROM events"""
PLACED = f"""SELECT chat, date, position, origin, row_number() OVER (PARTITION BY chat
  ORDER BY date DESC NULLS LAST, origin, position) AS place FROM ({MERGED})"""


@query(MERGED)
def g1_append_union(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_logs(*_log_sides(spark, d)).drop("place")


@query(PLACED)
def f4_newest_first_merge(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_logs(*_log_sides(spark, d))


@query(PLACED)
def f4_newest_first_merge_split(spark: SparkSession, d: str) -> DataFrame:
    """The same with every chat treated as too large for one task."""
    return G.merge_logs(*_log_sides(spark, d), max_group_rows=10)


@query(PLACED.replace("user_id AS chat", "CASE WHEN user_id % 3 > 0 THEN user_id END AS chat"))
def f4_newest_first_merge_null_chat(spark: SparkSession, d: str) -> DataFrame:
    """Most messages have no chat, which is one chat too large for one task."""
    chat = F.when(F.col("chat") % 3 > 0, F.col("chat"))
    new, history = (side.withColumn("chat", chat) for side in _log_sides(spark, d))
    return G.merge_logs(new, history, max_group_rows=100)


@query("SELECT event_id AS msg_id, user_id AS chat FROM events WHERE event_id < 700 ORDER BY event_id DESC LIMIT 100")
def f11_history_page(spark: SparkSession, d: str) -> DataFrame:
    return G.history_page(_messages(spark, d), before_id=700).select("msg_id", "chat")


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'id' || c_custkey END AS chat FROM customer WHERE c_mktsegment = 'BUILDING'")
def c9_private_chats(spark: SparkSession, d: str) -> DataFrame:
    dialogs = load(spark, d, "customer").select(
        (F.col("c_mktsegment") == "BUILDING").alias("is_user"), F.col("c_custkey").alias("entity_id"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("username"),
    )
    return G.private_chats(dialogs)


@query("SELECT event_id, event_type = 'view' AS stops FROM events")
def c9_stop_word(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_type") == "view", "ExIt").otherwise(F.col("props"))
    return load(spark, d, "events").select("event_id", G.is_stop_word(text).alias("stops"))


def _senders(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("sender_id"))


@query("SELECT event_id AS msg_id, user_id AS sender_id FROM events WHERE user_id IN "
       "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")  # fmt: skip
def d9_allowed_senders(spark: SparkSession, d: str) -> DataFrame:
    return G.allowed(_messages(spark, d), _senders(spark, d)).select("msg_id", "sender_id")


ROUTED = """SELECT event_id AS msg_id, CASE WHEN event_type IN ('view', 'click')
    THEN CASE WHEN event_type = 'view' AND user_id % 2 = 0 THEN 'chat' || user_id ELSE 'id' || (user_id + 1000) END
  WHEN event_type = 'signup' THEN NULL
  ELSE CASE WHEN user_id % 3 = 0 THEN 'user' || user_id ELSE 'id' || user_id END END AS log FROM events"""


def _routable(events: DataFrame) -> DataFrame:
    """Messages where a sign-up has neither chat nor sender."""
    known = F.when(F.col("media_kind").isNotNull() | F.col("is_out") | F.col("text").isNull(), F.lit(True))
    sender = F.coalesce(known, F.col("chat_id").isNotNull())
    return event_messages(events).withColumns(
        {
            "sender_username": F.when(sender, F.col("sender_username")),
            "sender_id": F.when(sender, F.col("sender_id")),
        }
    )


@query(ROUTED)
def h3_message_routing(spark: SparkSession, d: str) -> DataFrame:
    return G.routed(_routable(load(spark, d, "events"))).select("msg_id", "log")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = load(spark, d, "events").schema
    return T.message_stream(spark, d, schema, glob="events.parquet")


@query(f"SELECT msg_id, log FROM ({ROUTED}) WHERE log IS NOT NULL")
def h1_live_logs(spark: SparkSession, d: str) -> DataFrame:
    """The stream writes the logs as ranges of chat and date; the result is what the files hold."""
    out, debug, marks = (staging_path(spark, name) for name in ("logs", "debug", "logs-checkpoint"))
    T.start_logs(_routable(_stream(spark, d)), out, debug, marks).awaitTermination()
    return T.read_batches(spark, out).select("msg_id", "log")


@query(f"SELECT msg_id FROM ({ROUTED}) WHERE log IS NULL")
def h3_debug_sink(spark: SparkSession, d: str) -> DataFrame:
    out, debug, marks = (staging_path(spark, name) for name in ("logs", "debug", "logs-checkpoint"))
    T.start_logs(_routable(_stream(spark, d)), out, debug, marks).awaitTermination()
    return T.read_batches(spark, debug).select("msg_id")


@query(
    """SELECT user_id AS chat, event_id AS position, strftime(ts, '%Y-%m-%d %H:%M') AS date, CAST(event_type <> 'click' AS INTEGER) AS origin,
  row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d %H:%M') DESC, event_type <> 'click', event_id) AS place FROM events"""
)
def h2_periodic_merge(spark: SparkSession, d: str) -> DataFrame:
    """Clicks arrive as a stream and join the stored rest; on read the log is newest first."""

    def lines(frame: DataFrame) -> DataFrame:
        return frame.select(
            F.col("user_id").alias("chat"), F.date_format("ts", MINUTE).alias("date"), F.col("event_id").alias("position")
        )

    out, marks = staging_path(spark, "history"), staging_path(spark, "history-checkpoint")
    stored = lines(load(spark, d, "events").where("event_type <> 'click'"))
    # The stored rest is the first run; the stream's batches come after it.
    tiers.add_run(stored, out, level=1)
    tiers.start(lines(_stream(spark, d).where("event_type = 'click'")), out, marks, live=None).awaitTermination()
    origin = (F.col("run") == 0).cast("int").alias("origin")
    return tiers.read(spark, out, stored.schema).select("chat", "position", "date", origin, "place")


@query(
    """SELECT user_id AS chat, event_id AS msg_id,
  CASE WHEN event_id <= (SELECT 7 * max(event_id) // 10 FROM events) THEN 'history' ELSE 'live' END AS part FROM events"""
)
def h4_backfill_then_live(spark: SparkSession, d: str) -> DataFrame:
    """History pages of every chat up to a point in time, and a live stream that began before it: each message once."""
    path, marks = staging_path(spark, "chats"), staging_path(spark, "chats-checkpoint")
    messages = _messages(spark, d).select("chat", "msg_id", "date", "text")
    last = load(spark, d, "events").agg(F.max("event_id")).first()[0] or 0
    history = messages.where(F.col("msg_id") <= 7 * last // 10)
    live = event_messages(_stream(spark, d)).select(*messages.columns).where(F.col("msg_id") > last // 2)
    backfill.begin(messages.select("chat"), history, path)
    backfill.backfill(history, path, max_rounds=1)
    backfill.start_live(live, path, marks).awaitTermination()
    backfill.backfill(history, path)
    return backfill.read(spark, path, messages).select("chat", "msg_id", "part")


@query("SELECT DISTINCT user_id AS chat FROM events WHERE user_id NOT IN (SELECT conv_id FROM conversations)")
def h4_missing_history(spark: SparkSession, d: str) -> DataFrame:
    chats = load(spark, d, "events").select(F.col("user_id").alias("chat")).distinct()
    stored = load(spark, d, "conversations").select(F.col("conv_id").alias("chat"))
    return G.missing_history(chats, stored)


@query(
    """SELECT user_id AS sender_id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] ' ||
  CASE WHEN event_type = 'purchase' THEN 'ASSISTANT' ELSE 'USER' END || ': ' || props AS line FROM events
WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"""
)
def h5_sender_log(spark: SparkSession, d: str) -> DataFrame:
    out, marks = staging_path(spark, "senders"), staging_path(spark, "senders-checkpoint")
    texts = _stream(spark, d).select(
        F.col("user_id").alias("sender_id"), F.col("ts").cast("timestamp").alias("date"),
        (F.col("event_type") == "purchase").alias("is_assistant"), F.col("props").alias("text"),
    )
    T.start_sender_log(texts, _senders(spark, d), out, marks).awaitTermination()
    return T.read_batches(spark, out).select("sender_id", "line")
