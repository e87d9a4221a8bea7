"""Keyed state: first or last per key, upserts, inserts of what is absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(frame: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """G5, G3. The first row of each key in a total order.

    Spark limits each group to one row before the shuffle, so a frequent key costs no more than others.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def last_per_key(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """G6, G2. The row with the highest position of each key: the last one written wins."""
    return first_per_key(rows, keys, [F.col(position).desc()])


def upsert(
    target: DataFrame, changes: DataFrame, key: str, update: Sequence[str], position: str | None = None
) -> DataFrame:
    """G2. Insert unknown keys whole; for known keys replace only the columns in ``update``.

    ``target`` has one row per key. Of several changes of a key the one with the highest ``position`` counts;
    without ``position`` a repeated key is an error, as no rule would choose. A table format with MERGE can do
    this in place; the join works on any of them.
    """
    if position is not None:
        changes = last_per_key(changes, [key], position)
    else:
        once = F.row_number().over(Window.partitionBy(key).orderBy(key))
        repeated = F.raise_error(F.concat(F.lit("repeated change of key "), F.col(key).cast("string")))
        changes = changes.withColumn("_once", once).withColumn(key, F.when(F.col("_once") > 1, repeated).otherwise(F.col(key)))
    t, c = target.alias("t"), changes.alias("c")
    present, known = F.col(f"c.{key}").isNotNull(), F.col(f"t.{key}").isNotNull()

    def merged(name: str) -> Column:
        if name not in changes.columns:
            return F.col(f"t.{name}").alias(name)
        take = present if name in update else ~known
        return F.when(take, F.col(f"c.{name}")).otherwise(F.col(f"t.{name}")).alias(name)

    joined = t.join(c, F.col(f"t.{key}") == F.col(f"c.{key}"), "full_outer")
    return joined.select(*[merged(name) for name in target.columns])


def insert_absent(target: DataFrame, rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """G3. The rows to append: the first of each new key."""
    return first_per_key(rows, [key], order).join(target.select(key), key, "left_anti")
