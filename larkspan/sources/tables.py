"""Relational sources and the sinks: JDBC tables, appends, full refreshes, logs, dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows per INSERT batch and the header of the operation log.
INSERT_BATCH = 1000
LOG_COLUMNS = ["timestamp", "operation", "source_file", "target_file", "format", "status", "error"]


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    key: str,
    low: int,
    high: int,
    partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A8. A database table, read by ranges of its numeric key."""
    return spark.read.jdbc(
        url, table, column=key, lowerBound=low, upperBound=high, numPartitions=partitions,
        properties=properties or {},
    )


def write_jdbc(frame: DataFrame, url: str, table: str, *, refresh: bool = False, **properties: str) -> None:
    """A10, A11. Append in batches, or empty the table and load it again keeping its definition."""
    writer = frame.write.option("batchsize", INSERT_BATCH).option("truncate", str(refresh).lower())
    writer.jdbc(url, table, mode="overwrite" if refresh else "append", properties=properties)


def append(frame: DataFrame, path: str) -> None:
    """A10."""
    frame.write.mode("append").parquet(path)


def refresh(frame: DataFrame, path: str) -> None:
    """A11. Replace the whole table."""
    frame.write.mode("overwrite").parquet(path)


def write_log(actions: DataFrame, path: str) -> None:
    """A9. Operation log as CSV with a header and every field quoted, so commas and quotes survive."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in LOG_COLUMNS]
    (
        actions.select(*columns)
        .write.mode("append")
        .option("header", "true")
        .option("quoteAll", "true")
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in LOG_COLUMNS)
    reader = spark.read.schema(schema).option("header", "true").option("escape", '"').option("multiLine", "true")
    return reader.option("emptyValue", "").csv(path)


def dump(result: DataFrame, path: str, order: str = "id") -> None:
    """A12, F9. A query result in key order; the sort is a range sort at the sink only."""
    result.orderBy(order).write.mode("overwrite").parquet(path)


def urls(result: DataFrame) -> DataFrame:
    """A12. The URL column of a result."""
    return result.select("url")
