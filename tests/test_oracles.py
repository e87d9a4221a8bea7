"""Every registered query against its SQL on the smallest tables, and the plan rules for all of them."""

import re

import pytest
from compare import connection, difference
from conftest import SF

import __spark_entry__ as entry_points

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()
INVENTORY = {"A": 14, "B": 36, "C": 11, "D": 10, "E": 12, "F": 12, "G": 6, "H": 5, "I": 3}


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name in ORACLES:
        assert difference(frame, con, ORACLES[name]) is None
    else:
        assert frame.count() > 0


def test_every_inventory_id_has_a_query():
    found = {m.group(1).upper() for m in (re.match(r"([a-i][0-9]+)_", n) for n in QUERIES) if m}
    wanted = {f"{letter}{i}" for letter, n in INVENTORY.items() for i in range(1, n + 1)}
    assert wanted - found == set()


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert frame.count() > 0
    assert "price_sqm" in frame.columns
