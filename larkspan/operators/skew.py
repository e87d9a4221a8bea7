"""Grouped operations that stay balanced when one key holds a large share of all rows.

Plain windows and joins send every row of a key to one task. The functions here keep that plan for
ordinary keys and switch to a split one when a key is larger than ``max_group_rows``. Both plans give
the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.session import cut, settle, small

MAX_GROUP_ROWS = 2_000_000


def _names(keys: Sequence[str] | str) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def hot_keys(frame: DataFrame, keys: Sequence[str] | str, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Keys with more than ``max_group_rows`` rows, at most (all rows / max_group_rows) of them."""
    keys = _names(keys)
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > max_group_rows)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where NULL equals NULL. The keys of the left side stay, those of the right side go."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def placed_in_ranges(frame: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows in as many contiguous ranges of (keys, order) as there are shuffle partitions, as ``_range``.

    The boundaries cut through hot keys because the order columns are part of the range key. The number is
    given, as Spark would else merge small ranges to one. The checkpoint fixes which row lies in which range.
    """
    ranges = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = frame.repartitionByRange(ranges, *[F.col(k) for k in keys], *order)
    return cut(dealt.withColumn("_range", F.spark_partition_id()))


def running_sum(
    frame: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[Column],
    value: Column,
    name: str,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add ``name`` = sum of ``value`` over the rows of the key up to and including this row.

    ``order`` must be total within a key; a NULL key is a key. Groups above the bound are cut into contiguous
    ranges of the order, each range summed in its own task, and every range gets the total of those before it.
    """
    keys = _names(keys)
    frame = frame.withColumn("_value", value)
    upto = (Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)
    if keys and hot_keys(frame, keys, max_group_rows).isEmpty():
        return frame.withColumn(name, F.sum("_value").over(whole)).drop("_value")

    placed = placed_in_ranges(frame, keys, order)
    # A key that lies in one range needs no offset. The others are the first or last key of a range,
    # so at most two rows per range are left here.
    spread = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = spread.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(*keys, "_range").agg(F.sum("_value").alias("_part"))
    offsets = small(
        parts.withColumn("_ranges", F.count(F.lit(1)).over(spread))
        .withColumn("_offset", F.sum("_part").over(before))
        .where("_ranges > 1 AND _offset IS NOT NULL")
        .drop("_part", "_ranges")
    )
    local = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(*upto)
    joined = null_safe_join(placed.withColumn("_local", F.sum("_value").over(local)), offsets, [*keys, "_range"], "left")
    total = F.when(F.col("_offset").isNull(), F.col("_local")).otherwise(F.coalesce("_local", F.lit(0)) + F.col("_offset"))
    return joined.withColumn(name, total).drop("_local", "_offset", "_range", "_value")


def number_rows(
    frame: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[Column],
    name: str,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Number rows 1..n within each key in a total order. ``keys`` may be empty: one global numbering."""
    return running_sum(frame, keys, order, F.lit(1), name, max_group_rows)


def attach(
    rows: DataFrame,
    facts: DataFrame,
    keys: Sequence[str] | str,
    spread_by: Sequence[str],
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Inner join of rows to one fact row per key, where ``facts`` has a count column ``members``. NULL is a key.

    Hot keys, few by their definition, are spread over salts: a row draws its salt from the columns
    ``spread_by`` and the fact row of the key is repeated once per salt. Other keys keep salt 0.
    """
    keys = _names(keys)
    facts = settle(facts)
    if facts.where(F.col("members") > max_group_rows).isEmpty():
        return null_safe_join(rows, facts, keys)
    salts = F.greatest(F.ceil(F.col("members") / F.lit(max_group_rows)), F.lit(1)).cast("int")
    hot = small(facts.where(F.col("members") > max_group_rows).select(*keys, salts.alias("_salts")))
    salted_rows = null_safe_join(rows, hot, keys, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("_salts")), F.lit(0)).cast("int")
    )
    salted_facts = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return null_safe_join(salted_rows.drop("_salts"), salted_facts, [*keys, "_salt"]).drop("_salt")
