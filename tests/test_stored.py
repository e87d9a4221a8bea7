"""Tables under a manifest: refreshes, keyed upserts, the stored registry."""

import os
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from larkspan.operators import keyed, known, state
from larkspan.sources import versions


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_reader_between_the_writes_of_a_refresh_sees_the_old_pair(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/pair"
    pair = lambda n: {"parents": spark.range(n), "children": spark.range(10 * n)}
    versions.refresh_together(pair(2), path)
    seen, publish = [], versions.publish

    def watched(*args):
        seen.extend(f.count() for f in versions.read_together(spark, path, "parents", "children"))
        return publish(*args)

    monkeypatch.setattr(versions, "publish", watched)
    versions.refresh_together(pair(3), path)
    assert seen == [2, 20]
    assert [f.count() for f in versions.read_together(spark, path, "parents", "children")] == [3, 30]


def test_second_of_two_writers_fails_and_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.current(spark, path) == (0, {})
    assert versions.publish(spark, path, {"a": 1}, 0) == 1
    with pytest.raises(versions.Changed):
        versions.publish(spark, path, {"a": 2}, 0)
    assert versions.current(spark, path) == (1, {"a": 1})


def test_tidy_keeps_the_last_two_states(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(4):
        versions.refresh_together({"t": spark.range(n + 1)}, path)
    versions.tidy(spark, path)
    assert versions.read_together(spark, path, "t")[0].count() == 4
    assert len(os.listdir(f"{path}/data")) == versions.KEPT


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "keyed")
    keyed.create(spark.range(1000).selectExpr("id", "'old' AS a", "id % 7 AS b", "'x' AS _other"), path, "id", buckets=16)
    return path


def test_upsert_writes_only_touched_buckets(spark, table):
    before = files(table)
    changes = spark.createDataFrame([(3, "new", 70, 1), (3, "newer", 71, 2), (5000, "in", 72, 1)], "id long, a string, b long, at int")
    want = rows(state.upsert(keyed.read(spark, table), changes, "id", ["a"], "at"))
    touched = keyed.upsert(spark, table, changes, ["a"], "at")
    assert 1 <= len(touched) <= 2
    # No file of the first state is gone or changed, and only two buckets have new ones.
    after = files(table)
    assert all(after[f] == t for f, t in before.items())
    assert {int(re.search(r"_bucket=(\d+)", f)[1]) for f in after.keys() - before.keys()} == set(touched)
    found = keyed.read(spark, table)
    assert rows(found) == want and found.columns == ["id", "a", "b", "_other"]
    assert rows(found.where("id IN (3, 5000)")) == [(3, "newer", 3, "x"), (5000, "in", 72, None)]


def test_lost_run_leaves_the_old_state(spark, table, monkeypatch):
    before = rows(keyed.read(spark, table))
    monkeypatch.setattr(versions, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        keyed.upsert(spark, table, spark.createDataFrame([(3, "new")], "id long, a string"), ["a"])
    monkeypatch.undo()
    assert rows(keyed.read(spark, table)) == before
    versions.tidy(spark, table)
    assert rows(keyed.read(spark, table)) == before


def test_upsert_of_nothing_and_without_inserts(spark, table):
    changes = spark.createDataFrame([(4, "new"), (4000, "new")], "id long, a string")
    assert keyed.upsert(spark, table, changes.limit(0), ["a"]) == []
    keyed.upsert(spark, table, changes, ["a"], insert=False)
    assert rows(keyed.read(spark, table).where("a = 'new'").select("id")) == [(4,)]


@pytest.fixture
def registry(spark, tmp_path):
    urls = spark.range(20_000).select(F.concat(F.lit("https://a.example/"), "id").alias("url"))
    stored = known.create(urls.where("url NOT LIKE '%7'"), str(tmp_path / "registry"), groups=4, buckets=4)
    known.add(stored, urls.where("url LIKE '%7'"))
    return stored


def test_stored_registry_finds_what_it_has(spark, registry):
    links = spark.createDataFrame([(f"https://a.example/{i}", i) for i in (1, 7, 17, 17, 19_999)] + [("https://b.example/1", 0), (None, 1)], "link string, n int")
    assert rows(known.known_links(links, registry)) == sorted((f"https://a.example/{i}",) for i in (1, 7, 17, 19_999))
    assert rows(known.unknown_links(links, registry)) == sorted([("https://b.example/1", 0), (None, 1)], key=repr)
    again = known.open_registry(spark, registry.path)
    assert again == registry and again.rows().count() == 20_000


def test_sketch_loses_no_known_link_and_holds_back_most_others(spark, registry):
    every = registry.rows().select(F.col("url").alias("link"))
    assert known.possibly_known(every, registry).count() == 20_000
    others = spark.range(20_000).select(F.concat(F.lit("https://c.example/"), "id").alias("link"))
    assert known.possibly_known(others, registry).count() < 800


def test_registry_is_not_exchanged_and_groups_without_a_hit_are_not_read(spark, registry):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = spark.createDataFrame([("https://a.example/1",), ("https://a.example/2",)], "link string")
        plan = known.known_links(links, registry)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = plan[: plan.index(registry.table)] if registry.table in plan else plan
    assert "Bucketed: true" in plan
    # The only exchange is that of the links, which come after the registry's branch.
    assert plan.count("Exchange") == 1 and "Exchange" not in scan.split("Join", 1)[1]
    groups = re.search(r"PartitionFilters: \[([^\]]*)\]", plan)[1]
    assert "_group" in groups and 1 <= len(known.known_links(links, registry).inputFiles())
