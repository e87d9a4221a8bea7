"""What the operators of this subpackage share: columns by name, and numbering without a hot task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.session import settle

# Rows that one task numbers at most, on average.
ROWS_PER_RANGE = 200_000


def pick(frame: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names, so that further columns cannot clash with helpers."""
    return frame.select(*[frame[f"`{name}`"].alias(alias) for alias, name in columns.items()])


def shuffle_width(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(
    frame: DataFrame, keys: Sequence[str], tie: Sequence[Column], name: str, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Number the rows of each key 0..n-1 in ``name``, without one task for a hot key.

    Every key is cut into the same number of hash ranges; a range is numbered in its own task and starts
    after the rows of the ranges before it. ``frame`` is written first, so that both uses see the same rows.
    """
    rows = settle(frame)
    ranges = max(1, -(-rows.count() // rows_per_range))
    rows = rows.withColumn("_range", F.pmod(F.xxhash64(*tie), F.lit(ranges)).cast("int"))
    counts = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*keys, "_range").orderBy(*tie)
    joined = rows.withColumn("_local", F.row_number().over(local)).join(offsets, [*keys, "_range"])
    return joined.withColumn(name, F.col("_offset") + F.col("_local") - 1).drop("_offset", "_local", "_range")


def row_key(identity: Column, text: Column) -> Column:
    """What tells rows apart: only rows that agree in id and text share it."""
    return F.xxhash64(identity, F.coalesce(text, F.lit("")))


def keep_rows(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose row key is in ``keys.row_key``, one of each key, with all their columns."""
    key, copy = unused(docs, "row_key"), unused(docs, "copy")
    keyed = docs.withColumn(key, row_key(docs[id_col], docs[text_col]))
    found = keyed.join(keys.select(F.col("row_key").alias(key)), key, "left_semi")
    one = Window.partitionBy(key).orderBy(key)
    return found.withColumn(copy, F.row_number().over(one)).where(F.col(copy) == 1).select(*docs.columns)


def unused(frame: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the frame has it."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name
