"""Sources and sinks: test tables are written in the input format and read back by the operator."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from larkspan.operators.lookups import strict_lookup
from larkspan.plans.catalog import query
from larkspan.plans.scalars import _run_at
from larkspan.session import load, settle, staging_path
from larkspan.sources import feeds, files, lines, tables, versions


def nested_offers(spark: SparkSession, d: str) -> DataFrame:
    """Orders as nested offers."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = cust.cast("string")

    def comma(value):
        return F.replace(value.cast("string"), F.lit("."), F.lit(","))

    localities = (
        F.when(cust % 4 == 0, F.array(F.lit("Москва")))
        .when(cust % 4 == 1, F.array(F.lit("Москва"), F.lit("улица 1"), F.concat(F.lit("дом "), text)))
        .when(cust % 4 == 2, F.array(F.lit(""), F.lit("Химки"), F.lit("улица 2")))
    )
    return load(spark, d, "orders").select(
        key.alias("_internal-id"),
        F.when(F.col("o_orderstatus") == "O", "квартира").otherwise("дом").alias("category"),
        F.when(cust % 2 == 0, "0").otherwise("").alias("payed-adv"),
        F.struct(
            F.when(cust % 5 > 0, "Россия").alias("country"), F.lit("Московская").alias("region"),
            localities.alias("locality-name"), F.lit("не нужен").alias("district"),
            F.struct(F.lit("Центр").alias("name"), (cust % 30).cast("string").alias("time-on-foot")).alias("metro"),
        ).alias("location"),
        F.struct(
            comma(F.col("o_totalprice")).alias("value"), F.array(F.lit("USD"), F.lit("RUB")).alias("currency")
        ).alias("price"),
        F.struct(comma(cust / 10).alias("value"), F.lit("кв. м").alias("unit")).alias("area"),
        F.struct(F.concat(F.lit("+7 "), text).alias("phone"), text.alias("agency-id")).alias("sales-agent"),
        F.when(cust % 3 == 0, F.array(F.lit("a.jpg"), F.concat(text, F.lit(".jpg")))).alias("image"),
        F.when(cust % 3 == 0, "").when(cust % 3 == 1, (cust % 6).cast("string")).otherwise("x").alias("rooms"),
        F.when(cust % 2 == 0, "").otherwise((cust % 9).cast("string")).alias("floor"),
        F.concat(F.lit("&lt;b&gt; "), "o_orderpriority", F.lit(" &amp;quot;")).alias("description"),
        F.when(cust % 4 == 0, "Да").when(cust % 4 == 1, "нет").when(cust % 4 == 2, "1").alias("lift"),
        F.when(cust % 2 == 0, "да").otherwise("").alias("phone"),
    )


def offer_feed(spark: SparkSession, d: str, compression: str = "none") -> str:
    """Orders as a nested listing feed; returns its path."""
    path = staging_path(spark, "feed")
    feeds.write_offers(nested_offers(spark, d), path, compression)
    return path


FEED_SQL = """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'квартира' ELSE 'дом' END AS category,
  o_custkey % 2 = 0 AS payed_adv, CASE WHEN o_custkey % 5 > 0 THEN 'Россия' END AS location_country,
  CASE o_custkey % 4 WHEN 0 THEN 'Москва' WHEN 1 THEN 'Москва' WHEN 2 THEN 'Химки' END AS location_locality_name,
  CASE o_custkey % 4 WHEN 1 THEN 'дом ' || o_custkey WHEN 2 THEN 'улица 2' END AS location_address,
  CAST(o_custkey % 30 AS INTEGER) AS location_metro_time_on_foot, o_totalprice AS price_value, 'RUB' AS price_currency,
  o_custkey / 10 AS area_value, 'кв.м' AS area_unit, '+7 ' || o_custkey AS sales_agent_phone,
  CAST(o_custkey AS INTEGER) AS sales_agent_agency_id,
  CASE WHEN o_custkey % 3 = 0 THEN 'a.jpg,' || o_custkey || '.jpg' END AS image,
  CASE WHEN o_custkey % 3 = 1 THEN CAST(o_custkey % 6 AS INTEGER) END AS rooms,
  CASE WHEN o_custkey % 2 = 1 THEN CAST(o_custkey % 9 AS INTEGER) END AS floor,
  '<b> ' || o_orderpriority || ' &quot;' AS description,
  CASE o_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS lift, o_custkey % 2 = 0 AS phone,
  concat_ws(',', CASE WHEN o_custkey % 3 = 2 THEN 'rooms' END, CASE WHEN o_custkey % 2 = 0 THEN 'floor' END) AS rejected_fields
FROM orders"""
FEED_COLUMNS = [
    "id", "category", "payed_adv", "location_country", "location_locality_name", "location_address",
    "location_metro_time_on_foot", "price_value", "price_currency", "area_value", "area_unit", "sales_agent_phone",
    "sales_agent_agency_id", "image", "rooms", "floor", "description", "lift", "phone", "rejected_fields",
]


def _flat(spark: SparkSession, path: str, **options) -> DataFrame:
    flat = feeds.flat_offers(feeds.read_offers(spark, path, **options)).select(*FEED_COLUMNS)
    joined = {name: F.array_join(name, ",") for name in ("image", "rejected_fields")}
    return flat.withColumns(joined)


@query(FEED_SQL)
def a1_offer_feed(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, offer_feed(spark, d))


@query(FEED_SQL)
def a1_offer_feed_gzip(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, offer_feed(spark, d, "gzip"), partitions=spark.sparkContext.defaultParallelism)


@query(FEED_SQL)
def b8_leaf_columns(spark: SparkSession, d: str) -> DataFrame:
    """The same columns from the leaves in document order."""
    flat = feeds.flat_leaves(feeds.read_leaves(spark, offer_feed(spark, d))).select(*FEED_COLUMNS)
    return flat.withColumns({name: F.array_join(name, ",") for name in ("image", "rejected_fields")})


def mixed_feed(spark: SparkSession, d: str) -> str:
    """Offers whose address stands before or after the localities, with elements that no list has."""
    key, shape = F.col("o_orderkey").cast("string"), F.col("o_custkey") % 4
    address = F.concat(F.lit("<address>дом "), key, F.lit("</address>"))
    localities = F.lit("<locality-name></locality-name><locality-name>Москва</locality-name><locality-name>улица &amp; 1</locality-name>")
    place = F.when(shape == 0, F.concat(address, localities)).when(shape == 1, F.concat(localities, address))
    place = place.when(shape == 2, F.concat(F.lit("<locality-name>Химки</locality-name>"), address)).otherwise(F.lit("<district>ЦАО</district>"))
    view = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("<view>"), key, F.lit("</view><view> море </view><deep><pool-depth>2</pool-depth></deep>")))
    broken = F.when(F.col("o_custkey") % 11 == 0, F.lit("<rooms>")).otherwise(F.lit("<rooms>1</rooms>"))
    offer = F.concat(F.lit('<offer internal-id="'), key, F.lit('"><location>'), place, F.lit("</location>"), F.coalesce(view, F.lit("")), broken, F.lit("</offer>"))
    path = staging_path(spark, "mixed")
    load(spark, d, "orders").select(offer.alias("value")).write.text(path)
    return path


@query(
    """SELECT o_orderkey AS id, CAST(1 AS INTEGER) AS rooms, CASE o_custkey % 4 WHEN 2 THEN 'Химки' WHEN 3 THEN NULL ELSE 'Москва' END AS location_locality_name,
  CASE o_custkey % 4 WHEN 0 THEN 'улица & 1' WHEN 3 THEN NULL ELSE 'дом ' || o_orderkey END AS location_address,
  CASE WHEN o_custkey % 3 = 0 THEN 'deep/pool-depth=2,view=море' ELSE '' END AS other FROM orders WHERE o_custkey % 11 > 0"""
)
def b10_ordered_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Routing by the order of different elements, unknown leaves in a map, a repeated one by its last text."""
    flat = feeds.flat_leaves(feeds.read_leaves(spark, mixed_feed(spark, d)))
    other = F.transform(F.array_sort(F.map_entries("other")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return flat.select("id", "rooms", "location_locality_name", "location_address", F.array_join(other, ",").alias("other"))


@query(
    """WITH good AS (SELECT *, o_custkey % 4 AS s, o_custkey % 3 = 0 AS v FROM orders WHERE o_custkey % 11 > 0),
paths AS (SELECT '_internal-id' AS path, 1 AS times FROM good UNION ALL SELECT 'rooms', 1 FROM good
  UNION ALL SELECT 'location/address', 1 FROM good WHERE s < 3 UNION ALL SELECT 'location/district', 1 FROM good WHERE s = 3
  UNION ALL SELECT 'location/locality-name', CASE WHEN s = 2 THEN 1 ELSE 3 END FROM good WHERE s < 3
  UNION ALL SELECT 'view', 2 FROM good WHERE v UNION ALL SELECT 'deep/pool-depth', 1 FROM good WHERE v)
SELECT path, count(*) AS records, CAST(max(times) AS INTEGER) AS most FROM paths GROUP BY path"""
)
def b8_leaf_paths(spark: SparkSession, d: str) -> DataFrame:
    return feeds.leaf_paths(feeds.read_leaves(spark, mixed_feed(spark, d)))


def damaged_feed(spark: SparkSession, d: str) -> str:
    """The feed with an unclosed element in every seventh offer and a letter in every eleventh id."""
    path = staging_path(spark, "damaged")
    offer = F.to_xml(F.struct("*"), {"rowTag": "offer", "indent": ""})
    parts = nested_offers(spark, d).select(offer.alias("value"))
    key = F.regexp_extract("value", '<offer internal-id="([0-9]+)"', 1).try_cast("long")
    value = F.when(key % 7 == 0, F.replace("value", F.lit("</category>"), F.lit(""))).otherwise(F.col("value"))
    value = F.when(key % 11 == 0, F.replace(value, F.lit('internal-id="'), F.lit('internal-id="x'))).otherwise(value)
    parts.select(value.alias("value")).write.text(path)
    return path


@query(
    """SELECT CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey END AS id, CAST(o_custkey AS VARCHAR) AS agency,
  o_orderkey % 11 = 0 AS bad_id, false AS malformed FROM orders WHERE o_orderkey % 7 > 0
UNION ALL SELECT o_orderkey, CAST(o_custkey AS VARCHAR), o_orderkey % 11 = 0, true FROM orders WHERE o_orderkey % 7 = 0"""
)
def a1_damaged_feed(spark: SparkSession, d: str) -> DataFrame:
    """Offers after a malformed one are read, and it is kept as text."""
    # Landed, as both kinds are taken from it.
    offers = settle(feeds.read_offers(spark, damaged_feed(spark, d)))
    flat = feeds.flat_offers(offers).select(
        "id",
        F.col("sales_agent_agency_id").cast("string").alias("agency"),
        F.array_contains("rejected_fields", "id").alias("bad_id"),
        F.lit(False).alias("malformed"),
    )
    text = feeds.malformed(offers).select(
        F.regexp_extract("record", 'internal-id="x?([0-9]+)"', 1).cast("long").alias("id"),
        F.regexp_extract("record", "<agency-id>([0-9]+)<", 1).alias("agency"),
        F.contains("record", F.lit('internal-id="x')).alias("bad_id"),
        F.lit(True).alias("malformed"),
    )
    return flat.unionByName(text)


@query("SELECT count(*) AS offers FROM orders")
def a14_damaged_count(spark: SparkSession, d: str) -> DataFrame:
    return feeds.offer_count(spark, damaged_feed(spark, d))


@query(
    """SELECT o_orderkey AS id, 'RUB' AS price_currency, CAST(o_custkey % 30 AS INTEGER) AS location_metro_time_on_foot FROM orders"""
)
def b8_path_flattening(spark: SparkSession, d: str) -> DataFrame:
    """Of a repeated leaf (the currency) the last one is kept."""
    return _flat(spark, offer_feed(spark, d)).select("id", "price_currency", "location_metro_time_on_foot")


@query("SELECT o_orderkey AS id, false AS has_district FROM orders")
def b9_dropped_column(spark: SparkSession, d: str) -> DataFrame:
    flat = feeds.flat_offers(feeds.read_offers(spark, offer_feed(spark, d)))
    return flat.select("id", F.lit(any("district" in c for c in flat.columns)).alias("has_district"))


@query(
    """SELECT o_orderkey AS id, CASE o_custkey % 4 WHEN 0 THEN 'Москва' WHEN 1 THEN 'Москва' WHEN 2 THEN 'Химки' END AS location_locality_name,
  CASE o_custkey % 4 WHEN 1 THEN 'дом ' || o_custkey WHEN 2 THEN 'улица 2' END AS location_address FROM orders"""
)
def b10_locality_routing(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, offer_feed(spark, d)).select("id", "location_locality_name", "location_address")


@query("SELECT o_orderkey AS id, 'a.jpg,' || o_custkey || '.jpg' AS image, 2 AS n FROM orders WHERE o_custkey % 3 = 0")
def b11_repeated_images(spark: SparkSession, d: str) -> DataFrame:
    offers = feeds.read_offers(spark, offer_feed(spark, d))
    rows = feeds.flat_offers(offers).where("image IS NOT NULL")
    return rows.select("id", F.array_join("image", ",").alias("image"), F.size("image").alias("n"))


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_orderkey LIMIT 100")
def a13_feed_sample(spark: SparkSession, d: str) -> DataFrame:
    path = staging_path(spark, "sample")
    feeds.write_offers(feeds.feed_sample(feeds.read_offers(spark, offer_feed(spark, d))), path)
    return feeds.flat_offers(feeds.read_offers(spark, path)).select("id")


@query("SELECT count(*) AS offers FROM orders")
def a14_offer_count(spark: SparkSession, d: str) -> DataFrame:
    return feeds.offer_count(spark, offer_feed(spark, d))


def complex_feed(spark: SparkSession, d: str) -> str:
    """Orders as complexes, their line items as houses."""
    house = F.struct(
        F.col("l_linenumber").cast("long").alias("_Id"), F.col("l_returnflag").alias("name"),
        F.concat(F.lit("part "), "l_partkey").alias("address"),
    )
    houses = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(house).alias("house"))
    nested = (
        load(spark, d, "orders")
        .join(houses, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_orderkey").alias("_id"), F.col("o_orderpriority").alias("name"),
            F.concat("o_orderstatus", F.lit(" Республика")).alias("region"), F.lit("адрес").alias("address"),
            F.when(F.col("house").isNotNull(), F.struct("house")).alias("houses"),
        )
    )
    path = staging_path(spark, "complexes")
    nested.write.format("xml").option("rowTag", "newobject").option("rootTag", "newobjects").option("indent", "").save(path)
    return path


@query(
    """SELECT o_orderkey AS id, o_orderpriority AS name, 'адрес' AS address, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS region_id
FROM orders"""
)
def a2_complexes(spark: SparkSession, d: str) -> DataFrame:
    nested = feeds.read_complexes(spark, complex_feed(spark, d))
    statuses = load(spark, d, "orders").select("o_orderstatus").distinct()
    dictionary = statuses.select(
        F.concat("o_orderstatus", F.lit(" республика")).alias("name"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).alias("id"),
    )
    return strict_lookup(feeds.complexes(nested), dictionary, "region").select("id", "name", "address", "region_id")


@query(
    """SELECT o_orderkey AS newobject_id, CAST(l_linenumber AS BIGINT) AS id, l_returnflag AS name, 'part ' || l_partkey AS address
FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""
)
def a2_houses(spark: SparkSession, d: str) -> DataFrame:
    return feeds.houses(feeds.read_complexes(spark, complex_feed(spark, d)))


@query(
    """WITH l AS (SELECT CASE WHEN page_id % 5 = 0 THEN 'see ' || url ELSE url END AS url, row_number() OVER (ORDER BY page_id) - 1 AS line_no FROM pages)
SELECT line_no, url FROM l WHERE line_no >= 40 AND url LIKE 'http%'"""
)
def a4_link_list(spark: SparkSession, d: str) -> DataFrame:
    path = staging_path(spark, "links")
    shown = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("see "), "url")).otherwise(F.concat(F.lit("  "), "url"))
    load(spark, d, "pages").orderBy("page_id").select(F.concat(shown, F.lit(" ")).alias("value")).write.text(path)
    return lines.links(lines.numbered_lines(spark, path), skip=40)


@query(
    """WITH l AS (SELECT CASE WHEN page_id % 5 = 0 THEN 'see ' || url ELSE url END AS url, row_number() OVER (ORDER BY page_id) - 1 AS line_no FROM pages)
SELECT url FROM l WHERE line_no >= 40 AND url LIKE 'http%'"""
)
def a4_links_after_skip(spark: SparkSession, d: str) -> DataFrame:
    """The same links when their numbers are not asked for."""
    path = staging_path(spark, "links")
    shown = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("see "), "url")).otherwise(F.concat(F.lit("  "), "url"))
    load(spark, d, "pages").orderBy("page_id").select(F.concat(shown, F.lit(" ")).alias("value")).write.text(path)
    found = lines.lines_after(spark, path, 40).withColumn("line_no", F.lit(0))
    return lines.links(found).select("url")


@query("SELECT o_orderkey AS id, count(l_linenumber) AS houses FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def a11_refresh_together(spark: SparkSession, d: str) -> DataFrame:
    """Parents and children replaced at once, twice; the reader gets both of the last load."""
    path = staging_path(spark, "pair")
    parents = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    children = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent"), "l_linenumber")
    versions.refresh_together({"parents": parents.where("id % 2 = 0"), "children": children.where("parent % 2 = 0")}, path)
    versions.refresh_together({"parents": parents, "children": children}, path)
    parents, children = versions.read_together(spark, path, "parents", "children")
    counted = children.groupBy(F.col("parent").alias("id")).agg(F.count("l_linenumber").alias("houses"))
    return parents.join(counted, "id", "left").select("id", F.coalesce("houses", F.lit(0)).alias("houses"))


@query("SELECT lang, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents GROUP BY lang")
def a5_file_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Texts written in one folder per language and listed recursively."""
    path = staging_path(spark, "texts")
    load(spark, d, "documents").select("lang", "text").write.partitionBy("lang").text(path)
    found = files.inventory(spark, path, recursive=True, glob="*.txt")
    lang = F.regexp_extract("path", "lang=([^/]+)/", 1)
    return found.groupBy(lang.alias("lang")).agg(F.sum("size").alias("bytes"))


@query(
    """SELECT lang, count(*) FILTER (rn = 1) AS full_folders, CAST(sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS empty_files
FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) GROUP BY lang"""
)
def a5_empty_files(spark: SparkSession, d: str) -> DataFrame:
    """A folder with text and a folder with an empty file for each language; both kinds are listed."""
    path = staging_path(spark, "texts")
    docs = load(spark, d, "documents").select("lang", "text")
    docs.write.partitionBy("lang").text(f"{path}/full")
    for row in docs.select("lang").distinct().collect():
        docs.where("false").select("text").coalesce(1).write.text(f"{path}/empty/lang={row['lang']}")
    found = files.inventory(spark, path, recursive=True, glob="*.txt").withColumn(
        "lang", F.regexp_extract("path", "lang=([^/]+)/", 1)
    )
    folder = F.regexp_extract("path", "/(full|empty)/", 1)
    per = found.groupBy("lang", folder.alias("folder")).agg(F.count_if(F.col("size") == 0).alias("empty"), F.sum("size").alias("bytes"))
    return per.groupBy("lang").agg(
        F.count_if((F.col("folder") == "full") & (F.col("bytes") > 0)).alias("full_folders"), F.sum("empty").alias("empty_files")
    )


@query(
    """WITH f AS (SELECT s_nationkey, string_agg(s_name || chr(10), '' ORDER BY s_suppkey) AS content FROM supplier GROUP BY s_nationkey)
SELECT CAST(s_nationkey AS VARCHAR) AS nation, CAST(strlen(content) AS BIGINT) AS size, md5(content) AS md5, sha256(content) AS sha256 FROM f"""
)
def b20_file_digests(spark: SparkSession, d: str) -> DataFrame:
    """Files of suppliers' names, one per nation, digested as they are read."""
    path = staging_path(spark, "names")
    rows = load(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name")
    dealt = rows.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey")
    dealt.select("s_nationkey", "s_name").write.partitionBy("s_nationkey").text(path)
    found = files.digests(spark, path, recursive=True, glob="*.txt")
    return found.select(F.regexp_extract("path", "s_nationkey=([^/]+)/", 1).alias("nation"), "size", "md5", "sha256")


@query(
    """SELECT CASE WHEN event_type = 'error' THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS date,
  CASE WHEN event_type = 'error' THEN props ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ' | ' || props || ' | x' END AS line FROM events"""
)
def a6_message_log(spark: SparkSession, d: str) -> DataFrame:
    path = staging_path(spark, "log")
    dated = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" | "), "props", F.lit(" | x"))
    line = F.when(F.col("event_type") == "error", F.col("props")).otherwise(dated)
    load(spark, d, "events").select(line.alias("value")).write.text(path)
    return lines.read_message_log(spark, path)


@query(
    """SELECT DISTINCT source || CASE WHEN doc_id % 3 = 0 THEN '.doc' ELSE '.docx' END AS name FROM documents WHERE doc_id % 3 < 2"""
)
def a7_error_log(spark: SparkSession, d: str) -> DataFrame:
    path = staging_path(spark, "conversion-log")
    key = F.col("doc_id") % 3
    message = F.concat(F.lit("Ошибка конвертации "), "source", F.when(key == 0, ".doc").otherwise(".docx"), F.lit(": "), "text")
    rows = load(spark, d, "documents").select(F.when(key < 2, message).otherwise(F.col("text")).alias("value"))
    rows.write.text(path)
    return lines.damaged_files(spark.read.text(path))


@query(
    """SELECT '2024-05-06 07:08:09' AS timestamp, 'CONVERT' AS operation, source || '"' || doc_id AS source_file, '' AS target_file, lang AS format,
  CASE WHEN doc_id % 2 = 0 THEN 'SUCCESS' ELSE 'ERROR' END AS status, text AS error FROM documents"""
)
def a9_operation_log(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts, with quotes, commas and line breaks, as the error field."""
    path = staging_path(spark, "operations")
    actions = load(spark, d, "documents").select(
        F.date_format(_run_at(), "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.lit("CONVERT").alias("operation"),
        F.concat("source", F.lit('"'), "doc_id").alias("source_file"), F.lit(None).cast("string").alias("target_file"),
        F.col("lang").alias("format"), F.when(F.col("doc_id") % 2 == 0, "SUCCESS").otherwise("ERROR").alias("status"),
        F.col("text").alias("error"),
    )
    tables.write_log(actions, path)
    return tables.read_log(spark, path).withColumn("target_file", F.coalesce("target_file", F.lit("")))


@query("SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def a10_append_sink(spark: SparkSession, d: str) -> DataFrame:
    path = staging_path(spark, "append")
    rows = load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    tables.append(rows.drop("o_orderstatus"), path)
    tables.append(rows.where("o_orderstatus = 'O'").drop("o_orderstatus"), path)
    return spark.read.parquet(path)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def a11_full_refresh(spark: SparkSession, d: str) -> DataFrame:
    path = staging_path(spark, "refresh")
    rows = load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    tables.refresh(rows.drop("o_orderstatus"), path)
    tables.refresh(rows.where("o_orderstatus = 'O'").drop("o_orderstatus"), path)
    return spark.read.parquet(path)


@F.pandas_udf(BinaryType())
def _archive(xml: pd.Series, part: pd.Series) -> pd.Series:
    """A word-processing archive with one part."""

    def pack(text: str, name: str) -> bytes:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr(name, text)
        return buffer.getvalue()

    return pd.Series([pack(text, name) for text, name in zip(xml, part)])


def binary_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: archives with and without the main part, RTF, old binaries, damaged archives."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    runs = F.concat(F.lit("<w:p><w:r><w:t xml:space='preserve'>"), F.replace(escaped, F.lit("\n"), F.lit("</w:t></w:r></w:p><w:p><w:r><w:t>")),
                    F.lit("</w:t></w:r></w:p>"))
    key = F.col("doc_id") % 5
    packed = _archive(runs, F.when(key == 0, files.MAIN_PART).otherwise("custom/other.xml"))
    rtf = F.concat(F.lit("{\\rtf1}\\par1 "), "text").cast("binary")
    content = (
        F.when(key < 2, packed)
        .when(key == 2, rtf)
        .when(key == 3, F.concat(F.unhex(F.lit("D0CF11E0A1B11AE1")), F.col("text").cast("binary")))
        .otherwise(F.concat(F.unhex(F.lit("504B0304")), F.col("text").cast("binary")))
    )
    return load(spark, d, "documents").select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.concat("source", F.lit(".bin")).alias("name"),
        content.alias("content"),
    )


FORMAT_SQL = "CASE doc_id % 5 WHEN 0 THEN 'docx' WHEN 2 THEN 'rtf' WHEN 3 THEN 'doc' ELSE 'unknown' END"


@query(f"SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, {FORMAT_SQL} AS format FROM documents")
def b19_format_by_signature(spark: SparkSession, d: str) -> DataFrame:
    return files.documents(binary_documents(spark, d)).select("path", "format")


@query(
    r"""WITH t AS (SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS x, text FROM documents)
SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, CASE WHEN doc_id % 5 < 2 THEN 'runs' WHEN doc_id % 5 = 2 THEN 'rtf' END AS method,
  CASE doc_id % 5 WHEN 3 THEN 'rtf: no method for doc' WHEN 4 THEN 'damaged' END AS errors,
  md5(CASE WHEN doc_id % 5 < 2 THEN replace(x, chr(10), ' ') WHEN doc_id % 5 = 2
    THEN regexp_replace(regexp_replace('{\rtf1}\par1 ' || text, '\\[a-z]+[0-9]*|\{[^}]+\}|\\''[0-9a-f]{2}', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') END) AS md5 FROM t"""
)
def b31_document_text(spark: SparkSession, d: str) -> DataFrame:
    found = files.documents(binary_documents(spark, d))
    damaged = F.contains("errors", F.lit("damaged archive"))
    return found.select(
        "path", "method", F.when(damaged, "damaged").otherwise(F.col("errors")).alias("errors"), F.md5("text").alias("md5")
    )
