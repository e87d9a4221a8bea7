"""A stored registry of URLs that new links are compared with where it lies.

The registry is a table bucketed by URL, so a join deals only the links to its buckets, and partitioned by
groups of hashes. Beside it lies a sketch: bitmaps in which every stored URL has two bits. A link with a bit
missing is new without a look at the registry, and groups without a link that has both are not read.
"""

from __future__ import annotations

import hashlib
import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspan.session import settle
from larkspan.sources import versions

GROUPS = 16
# URLs for which a bitmap is made; it has 32,768 bits, so about one in sixteen is set by then.
URLS_PER_BITMAP = 1_024
BITMAP_BITS = 32_768
_GROUP = "_group"


class Registry(NamedTuple):
    """Where a registry lies and how it is cut."""

    spark: SparkSession
    path: str
    groups: int
    buckets: int
    bitmaps: int
    schema: StructType

    @property
    def table(self) -> str:
        """Its name in the session's catalog, which only points to the folder."""
        return f"registry_{hashlib.md5(self.path.encode()).hexdigest()}"

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)


def _group(url: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(groups)).cast("int")


def _bits(rows: DataFrame, url: str, registry: Registry) -> DataFrame:
    """The two bits of each URL: bitmap (number) and place."""
    places = [F.struct(F.pmod(F.xxhash64(F.col(url), F.lit(salt)), F.lit(registry.bitmaps)).alias("bitmap"),
                       F.pmod(F.xxhash64(F.lit(salt), F.col(url)), F.lit(BITMAP_BITS)).alias("place")) for salt in (1, 2)]
    return rows.withColumn("_bit", F.explode(F.array(*places))).select("*", "_bit.bitmap", "_bit.place").drop("_bit")


def create(rows: DataFrame, path: str, groups: int = GROUPS, buckets: int | None = None) -> Registry:
    """Store a registry of rows with a ``url``. Buckets: at least the shuffle partitions of the jobs to come."""
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = settle(rows)
    bitmaps = max(groups, -(-rows.count() // URLS_PER_BITMAP))
    content = {"groups": groups, "buckets": buckets, "bitmaps": bitmaps, "schema": rows.schema.json()}
    versions.publish(spark, path, content, versions.current(spark, path)[0])
    versions.ensure_folder(spark, f"{path}/rows")
    registry = open_registry(spark, path)
    add(registry, rows)
    return registry


def open_registry(spark: SparkSession, path: str) -> Registry:
    """A stored registry; the session's catalog learns where it lies."""
    content = versions.current(spark, path)[1]
    schema = StructType.fromJson(json.loads(content["schema"]))
    registry = Registry(spark, path, content["groups"], content["buckets"], content["bitmaps"], schema)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {registry.table} ({columns}, {_GROUP} int) USING parquet PARTITIONED BY ({_GROUP}) "
        f"CLUSTERED BY (url) SORTED BY (url) INTO {registry.buckets} BUCKETS LOCATION '{path}/rows'"
    )
    spark.catalog.recoverPartitions(registry.table)
    return registry


def add(registry: Registry, rows: DataFrame) -> None:
    """Append rows of new URLs. The sketch comes first: a lost run leaves bits too many, which cost a look, never too few."""
    spark = registry.spark
    rows = settle(rows)
    bits = _bits(rows.where("url IS NOT NULL").select("url"), "url", registry)
    sketch = bits.groupBy("bitmap").agg(F.bitmap_construct_agg("place").alias("bits"))
    sketch.write.mode("append").parquet(f"{registry.path}/sketch")
    dealt = rows.withColumn(_GROUP, _group(F.col("url"), registry.groups))
    # One task per bucket and group, so that a load adds one file to each at most.
    dealt.repartition(registry.buckets, "url").write.insertInto(registry.table)
    spark.catalog.recoverPartitions(registry.table)


def possibly_known(links: DataFrame, registry: Registry, url: str = "link") -> DataFrame:
    """Distinct links that have both bits in the sketch: all known ones, and few others."""
    spark = registry.spark
    sketch = spark.read.schema("bitmap long, bits binary").parquet(f"{registry.path}/sketch")
    # A bitmap has a row for each load; any of them may hold the bit.
    asked = _bits(links.where(F.col(url).isNotNull()).select(F.col(url).alias("url")).distinct(), "url", registry)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("place") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    hit = asked.join(sketch, "bitmap").where(F.getbit(byte, (F.col("place") % 8).cast("int")) == 1)
    both = hit.select("url", "bitmap", "place").distinct().groupBy("url").agg(F.count(F.lit(1)).alias("set"))
    # Both bits of a URL may be one.
    needed = asked.distinct().groupBy("url").agg(F.count(F.lit(1)).alias("needed"))
    return needed.join(both, "url").where("set = needed").select("url")


def known_links(links: DataFrame, registry: Registry, url: str = "link") -> DataFrame:
    """The distinct links that the registry has, as ``url``. Neither sorted nor moved is the registry."""
    spark = registry.spark
    possible = settle(possibly_known(links, registry, url).withColumn(_GROUP, _group(F.col("url"), registry.groups)))
    # At most one row per group.
    groups = [r[0] for r in possible.select(_GROUP).distinct().collect()]
    if not groups:
        return spark.createDataFrame([], "url string")
    stored = registry.rows().where(F.col(_GROUP).isin(groups)).select("url")
    # Few links are broadcast, many are dealt to the registry's buckets.
    return stored.join(possible.select("url"), "url", "left_semi").distinct()


def unknown_links(links: DataFrame, registry: Registry, url: str = "link") -> DataFrame:
    """D3, G3. The links, with all columns and repeats, that the registry lacks."""
    known = settle(known_links(links, registry, url))
    return links.join(known.select(F.col("url").alias(url)), url, "left_anti").select(*links.columns)
