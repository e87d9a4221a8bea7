"""Stored tables with one row per key, changed bucket by bucket.

Rows lie in buckets by the hash of their key, each a folder that the manifest names. A change reads and writes
only the buckets of its keys; the files of all others keep their name and time.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from larkspan.operators import registry, state
from larkspan.session import settle
from larkspan.sources import versions

BUCKETS = 64
_BUCKET = "_bucket"


def _dealt(frame: DataFrame, key: str, buckets: int) -> DataFrame:
    return frame.withColumn(_BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _write(frame: DataFrame, key: str, buckets: int, folder: str) -> None:
    """Buckets as folders; the rows of one lie in key order, so that a reader can skip."""
    rows = _dealt(frame, key, buckets).repartition(_BUCKET).sortWithinPartitions(_BUCKET, key)
    rows.write.partitionBy(_BUCKET).parquet(folder)


def create(frame: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Store a table of one row per key. Choose buckets of some hundred MB."""
    spark = frame.sparkSession
    number, _ = versions.current(spark, path)
    folder = versions.fresh(path, "rows")
    _write(frame, key, buckets, folder)
    content = {"key": key, "buckets": buckets, "schema": frame.schema.json(), "folders": dict.fromkeys(map(str, range(buckets)), folder)}
    versions.publish(spark, path, content, number)


def _read(spark: SparkSession, content: dict, buckets: Sequence[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(content["schema"]))
    wanted = content["folders"] if buckets is None else {str(b): content["folders"][str(b)] for b in buckets}
    by_folder: dict[str, list[int]] = {}
    for bucket, folder in wanted.items():
        by_folder.setdefault(folder, []).append(int(bucket))
    parts = [
        # The filter on the folder's name keeps the other buckets' files from being listed as input.
        spark.read.schema(StructType([*schema, StructField(_BUCKET, IntegerType())])).parquet(folder).where(F.col(_BUCKET).isin(own))
        for folder, own in by_folder.items()
    ]
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop(_BUCKET)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as the newest manifest has it."""
    return _read(spark, versions.current(spark, path)[1])


def upsert(
    spark: SparkSession, path: str, changes: DataFrame, update: Sequence[str], position: str | None = None, insert: bool = True
) -> list[int]:
    """G2. Change a stored table: as ``state.upsert``, but only the buckets of changed keys are written anew.

    Without ``insert`` changes of unknown keys are left out. Returns the buckets that were written. Of two
    writers at once the later one fails and may try again.
    """
    number, content = versions.current(spark, path)
    key, buckets = content["key"], content["buckets"]
    rows = settle(_dealt(changes, key, buckets))
    # At most one row per bucket.
    touched = sorted(r[0] for r in rows.select(_BUCKET).distinct().collect())
    if not touched:
        return []
    target, rows = _read(spark, content, touched), rows.drop(_BUCKET)
    if not insert:
        rows = rows.join(target.select(key), key, "left_semi")
    folder = versions.fresh(path, "rows")
    _write(state.upsert(target, rows, key, update, position), key, buckets, folder)
    folders = content["folders"] | dict.fromkeys(map(str, touched), folder)
    versions.publish(spark, path, content | {"folders": folders}, number)
    return touched


def update_status(spark: SparkSession, path: str, results: DataFrame, run_at: Column) -> list[int]:
    """G4. Time and status of this run in a stored table of sources; unknown sources are left out."""
    return upsert(spark, path, registry.status_changes(results, run_at), ["last_update", "update_status"], insert=False)
