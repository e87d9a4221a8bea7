"""Plan rules that keep the operators cheap on large inputs."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from larkspan.operators import messages as G
from larkspan.operators import state
from larkspan.plans import QUERIES
from larkspan.session import SMALL_ROWS, load, shared_dir, small, staging_path


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_flagship_pushes_its_filters_and_columns(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    text = plan(QUERIES["c2_comparable_filter"](spark, SF))
    for pushed in ("EqualTo(l_linestatus,O)", "GreaterThan(l_extendedprice,0.0)", "GreaterThan(l_quantity,20.0)"):
        assert pushed in text
    assert "l_shipdate" not in text
    text = plan(QUERIES["e1_group_statistics"](spark, SF))
    assert "l_orderkey" not in text


def test_flagship_shuffles_no_listing(spark):
    text = plan(QUERIES["below_market_listings"](spark, SF))
    assert "SortMergeJoin" not in text
    assert text.count("BroadcastHashJoin") == 1


@pytest.mark.parametrize("name", ["f3_last_messages", "g3_insert_absent", "g5_keep_first", "i1_text_search", "i2_vector_search"])
def test_top_rows_are_limited_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert text.count("WindowGroupLimit") == 2


def test_limits_apply_to_library_calls(spark):
    events = load(spark, SF, "events").select(F.col("user_id").alias("chat"), F.col("event_id").alias("msg_id"))
    assert "WindowGroupLimit" in plan(G.last_messages(events))
    assert "WindowGroupLimit" in plan(state.first_per_key(events, ["chat"], [F.col("msg_id")]))


def test_shared_folder_is_the_configured_one(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == folder
    assert staging_path(spark, "x").startswith(f"{folder}/staged/{spark.sparkContext.applicationId}/x-")
    assert staging_path(spark, "x") != staging_path(spark, "x")


def test_small_tables_are_checked(spark):
    assert "LocalTableScan" in plan(small(spark.range(10)))
    large = small(spark.range(SMALL_ROWS + 1))
    assert "FileScan parquet" in plan(large)
    assert large.count() == SMALL_ROWS + 1
