"""Streams end with the same rows as the batch form, and a batch that runs twice leaves no repeats."""

from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types

from larkspan.operators.messages import merge_logs, routed
from larkspan.streaming import messages as T

SCHEMA = (
    "msg_id long, date timestamp, text string, chat_id long, chat_username string, sender_id long, "
    "sender_username string, is_assistant boolean"
)


def _messages(spark):
    return spark.range(40).select(
        F.col("id").alias("msg_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("id"))).alias("date"),
        F.concat(F.lit("t"), "id").alias("text"),
        F.when(F.col("id") % 4 == 0, F.col("id") % 3).alias("chat_id"),
        F.lit("").alias("chat_username"),
        F.when(F.col("id") % 4 < 3, F.col("id") % 5).alias("sender_id"),
        F.lit(None).cast("string").alias("sender_username"),
        (F.col("id") % 2 == 0).alias("is_assistant"),
    )


def _arrive(spark, folder, low, high):
    _messages(spark).where(F.col("msg_id").between(low, high)).coalesce(1).write.mode("append").parquet(folder)


def test_logs_in_two_runs(spark, tmp_path):
    source, out, debug, marks = (str(tmp_path / n) for n in ("in", "out", "debug", "marks"))
    for low, high in ((0, 19), (20, 39)):
        _arrive(spark, source, low, high)
        stream = T.message_stream(spark, source, _messages(spark).schema)
        T.start_logs(stream, out, debug, marks).awaitTermination()
    batch = routed(_messages(spark))
    assert rows(T.read_batches(spark, out), "msg_id", "log") == rows(batch.where("log IS NOT NULL"), "msg_id", "log")
    assert rows(T.read_batches(spark, debug), "msg_id") == rows(batch.where("log IS NULL"), "msg_id")


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _arrive(spark, source, 0, 9)
    # A lost checkpoint makes the stream run batch 0 again.
    for marks in ("marks1", "marks2"):
        stream = T.message_stream(spark, source, _messages(spark).schema)
        T.start_merge(stream, out, str(tmp_path / marks), live=None).awaitTermination()
    assert rows(T.read_batches(spark, out), "msg_id") == sorted([(i,) for i in range(10)], key=repr)


def test_merge_order(spark):
    schema = "chat int, date string, position int"
    new = spark.createDataFrame([(1, "2024-01-02", 1), (1, None, 2), (1, "2024-01-01", 3)], schema)
    stored = spark.createDataFrame([(1, "2024-01-02", 1), (1, "2024-01-03", 2), (1, None, 3)], schema)
    merged = merge_logs(new, stored).orderBy("place").collect()
    got = [(r["date"], r["origin"], r["position"]) for r in merged]
    assert got == [
        ("2024-01-03", 1, 2), ("2024-01-02", 0, 1), ("2024-01-02", 1, 1), ("2024-01-01", 0, 3), (None, 0, 2), (None, 1, 3),
    ]


def test_sender_log(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    _arrive(spark, source, 0, 9)
    stream = T.message_stream(spark, source, _messages(spark).schema)
    senders = spark.createDataFrame([(1,)], "sender_id long")
    T.start_sender_log(stream, senders, out, marks).awaitTermination()
    assert rows(T.read_batches(spark, out), "line") == [("[2024-01-01 00:01:00] USER: t1",), ("[2024-01-01 00:06:00] ASSISTANT: t6",)]


def test_optional_deduplication(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    _arrive(spark, source, 0, 9)
    _arrive(spark, source, 5, 14)
    stream = T.once_per_message(T.message_stream(spark, source, _messages(spark).schema))
    T.start_merge(stream, out, marks, live=None).awaitTermination()
    assert rows(T.read_batches(spark, out), "msg_id") == sorted([(i,) for i in range(15)], key=repr)


def test_history_is_folded(spark, tmp_path):
    path = str(tmp_path / "history")
    schema = types.StructType([types.StructField(n, k) for n, k in (("chat", types.LongType()), ("date", types.StringType()), ("position", types.LongType()))])
    assert T.read_history(spark, path, schema).count() == 0
    assert T.read_batches(spark, path, schema).count() == 0
    T.fold_history(spark, path, schema)
    parts = [[(1, "d1", 1), (1, "d2", 2), (None, "d1", 3)], [(1, "d1", 4), (1, None, 5)], [(1, "d2", 6), (None, "d9", 7)]]
    for number, part in enumerate(parts):
        spark.createDataFrame(part, schema).write.parquet(T.batch_path(path, number))
        before = rows(T.read_history(spark, path, schema), "chat", "position", "place")
        T.fold_history(spark, path, schema)
        assert rows(T.read_history(spark, path, schema), "chat", "position", "place") == before
        assert T._finished(spark, path, "batch") == [] and T._finished(spark, f"{path}/history", "upto") == [number]
    places = {(c, p): n for c, p, n in before}
    assert [p for (c, p), n in sorted(places.items(), key=lambda x: x[1]) if c == 1] == [6, 2, 4, 1, 5]
    assert [p for (c, p), n in sorted(places.items(), key=lambda x: x[1]) if c is None] == [7, 3]
