"""Histories in runs by level, and backfills that hand over to live messages."""

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types

from larkspan.operators.messages import merge_logs
from larkspan.sources import versions
from larkspan.streaming import backfill, tiers

LINES = types.StructType([types.StructField(n, k) for n, k in (("chat", types.LongType()), ("date", types.StringType()), ("position", types.LongType()))])


def size(folder):
    return sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.endswith(".parquet"))


def batches(spark):
    """Ten batches of three chats, one of NULL, with equal and missing dates."""
    parts = spark.range(300).select(
        F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("chat"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("d"), F.pmod(F.hash("id"), F.lit(5)))).alias("date"),
        F.col("id").alias("position"),
    )
    return [parts.where(f"position >= {30 * i} AND position < {30 * i + 30}") for i in range(10)]


def test_runs_read_as_merging_one_batch_after_another(spark, tmp_path):
    path, merged = str(tmp_path / "h"), spark.createDataFrame([], LINES)
    levels = []
    for number, batch in enumerate(batches(spark)):
        tiers.add_run(batch, path, number)
        tiers.add_run(batch, path, number)  # a batch that runs twice
        levels += tiers.merge_levels(spark, path, LINES, fan=3)
        merged = spark.createDataFrame(merge_logs(batch, merged).drop("origin").collect(), types.StructType([*LINES, types.StructField("place", types.LongType())]))
    assert levels.count(0) == 3 and levels.count(1) == 1
    assert rows(tiers.read(spark, path, LINES).drop("run")) == rows(merged.select("chat", "date", "position", "place"))
    assert rows(tiers.read(spark, path, LINES, max_group_rows=20).drop("run")) == rows(merged.select("chat", "date", "position", "place"))


def test_a_fold_leaves_larger_runs_alone(spark, tmp_path):
    path = str(tmp_path / "h")
    tiers.add_run(spark.range(200_000).selectExpr("id % 50 AS chat", "'d' AS date", "id AS position"), path, level=2)
    old = versions.current(spark, path)[1]["runs"][0][0]
    for number, batch in enumerate(batches(spark)[:3]):
        tiers.add_run(batch, path, number)
    assert tiers.merge_levels(spark, path, LINES, fan=3) == [0]
    runs = versions.current(spark, path)[1]["runs"]
    assert [level for _, level in runs] == [2, 1] and runs[0][0] == old
    # What was written is of the size of the new part.
    assert 20 * size(runs[1][0]) < size(old)
    assert tiers.merge_levels(spark, path, LINES, fan=3) == []


def test_lost_merge_leaves_the_runs(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "h")
    for number, batch in enumerate(batches(spark)[:3]):
        tiers.add_run(batch, path, number)
    before = rows(tiers.read(spark, path, LINES))
    monkeypatch.setattr(versions, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        tiers.merge_levels(spark, path, LINES, fan=3)
    monkeypatch.undo()
    assert rows(tiers.read(spark, path, LINES)) == before
    assert tiers.read(spark, str(tmp_path / "none"), LINES).count() == 0


@pytest.fixture
def chats(spark):
    """Chat 1 has 1000 messages, chat 2 exactly two rounds of them, chat 3 five, chat 4 none yet, chat 5 only live ones."""
    ids = {1: 1000, 2: 40, 3: 5}
    messages = [(c, 10 * i + c) for c, n in ids.items() for i in range(n)]
    history = spark.createDataFrame(messages, "chat long, msg_id long")
    return history, spark.createDataFrame([(c,) for c in (1, 1, 2, 3, 4, 5, None)], "chat long")


def test_backfill_stops_and_resumes(spark, tmp_path, chats, monkeypatch):
    history, wanted = chats
    path = str(tmp_path / "chats")
    backfill.begin(wanted, history, path)
    assert rows(backfill.state(spark, path).where("done"), "chat") == [(4,), (5,)]
    assert backfill.backfill(history, path, pages=2, page=10, max_rounds=2) == 2
    state = {r["chat"]: (r["oldest"], r["done"]) for r in backfill.state(spark, path).collect()}
    assert state[1] == (10 * 960 + 1, False) and state[2] == (2, True) and state[3] == (3, True)
    # A round that is lost before it is published leaves nothing behind.
    before = rows(backfill.read(spark, path, history))
    monkeypatch.setattr(versions, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        backfill.get_round(history, path, 2, 10)
    monkeypatch.undo()
    assert rows(backfill.read(spark, path, history)) == before
    # Messages that the source gets meanwhile are no history; chats that are known stay as they are.
    later = history.unionByName(spark.createDataFrame([(1, 20_001), (3, 20_003)], history.schema))
    backfill.begin(wanted, later, path)
    backfill.backfill(later, path)
    assert rows(backfill.read(spark, path, history), "chat", "msg_id") == rows(history)
    assert backfill.backfill(later, path) == 0


def test_live_messages_begin_after_the_history(spark, tmp_path, chats):
    history, wanted = chats
    path, source = str(tmp_path / "chats"), str(tmp_path / "in")
    backfill.begin(wanted, history, path)
    backfill.backfill(history, path, max_rounds=1)
    new = [(1, 20_001), (4, 4), (5, 15), (6, 6), (None, 7)]
    overlap = history.where("chat < 3 AND msg_id > 300")
    for part in (overlap.coalesce(1), spark.createDataFrame(new, history.schema).coalesce(1)):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(history.schema).parquet(source)
        # The second start, with a lost checkpoint, runs its first batch number again.
        backfill.start_live(stream, path, str(tmp_path / "marks")).awaitTermination()
    backfill.backfill(history, path)
    found = backfill.read(spark, path, history)
    assert rows(found, "chat", "msg_id") == sorted([*rows(history), *new], key=repr)
    assert rows(found.where("part = 'live'"), "chat", "msg_id") == sorted(new, key=repr)
