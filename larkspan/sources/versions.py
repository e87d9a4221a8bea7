"""Tables made of folders that a manifest names.

A manifest is a small JSON file with a number. Writers put new folders beside the old ones and publish the next
manifest last, so a reader sees all of a change or nothing of it, and a writer that is lost leaves the old state
and some folders that nobody reads. The size of a manifest depends on the number of folders, never on rows.
The store's rename must be atomic.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Manifests that ``tidy`` leaves, so that readers of the one before the newest can end.
KEPT = 2


class Changed(RuntimeError):
    """Another writer has published meanwhile."""


def _folder(spark: SparkSession, path: str) -> tuple[Any, Any]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _numbers(spark: SparkSession, path: str) -> list[int]:
    store, place = _folder(spark, f"{path}/_manifest/*.json")
    return sorted(int(s.getPath().getName().removesuffix(".json")) for s in store.globStatus(place) or [])


def _read(spark: SparkSession, path: str, number: int) -> dict[str, Any]:
    store, place = _folder(spark, f"{path}/_manifest/{number}.json")
    stream = store.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> tuple[int, dict[str, Any]]:
    """Number and content of the newest manifest; 0 and nothing before the first."""
    numbers = _numbers(spark, path)
    return (numbers[-1], _read(spark, path, numbers[-1])) if numbers else (0, {})


def publish(spark: SparkSession, path: str, content: dict[str, Any], after: int) -> int:
    """Make the content the newest, if ``after`` still is the number of the newest manifest."""
    store, target = _folder(spark, f"{path}/_manifest/{after + 1}.json")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest/.{uuid.uuid4().hex}")
    out = store.create(draft, False)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    newest = _numbers(spark, path)
    if (newest[-1] if newest else 0) != after or not store.rename(draft, target):
        store.delete(draft, False)
        raise Changed(f"{path} is no longer at version {after}")
    return after + 1


def fresh(path: str, label: str) -> str:
    """A new folder below the table's."""
    return f"{path}/data/{label}-{uuid.uuid4().hex}"


def ensure_folder(spark: SparkSession, path: str) -> None:
    """Make the folder if it is not there."""
    store, place = _folder(spark, path)
    store.mkdirs(place)


def tidy(spark: SparkSession, path: str) -> None:
    """Remove old manifests and the folders that none of the kept ones names. Run it when no writer is at work."""
    numbers = _numbers(spark, path)
    named = "\n".join(json.dumps(_read(spark, path, n)) for n in numbers[-KEPT:])
    for n in numbers[:-KEPT]:
        store, place = _folder(spark, f"{path}/_manifest/{n}.json")
        store.delete(place, False)
    store, place = _folder(spark, f"{path}/data/*")
    for status in store.globStatus(place) or []:
        if status.getPath().getName() not in named:
            store.delete(status.getPath(), True)


def refresh_together(tables: dict[str, DataFrame], path: str) -> None:
    """A11. Replace several tables at once: readers see all old ones or all new ones."""
    spark = next(iter(tables.values())).sparkSession
    number, content = current(spark, path)
    folders = {name: fresh(path, name) for name in tables}
    for name, frame in tables.items():
        frame.write.parquet(folders[name])
    schemas = {name: frame.schema.json() for name, frame in tables.items()}
    publish(spark, path, content | {name: [folders[name], schemas[name]] for name in tables}, number)


def read_together(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    """A11. Tables of one refresh."""
    content = current(spark, path)[1]
    return [spark.read.schema(StructType.fromJson(json.loads(content[n][1]))).parquet(content[n][0]) for n in names]
