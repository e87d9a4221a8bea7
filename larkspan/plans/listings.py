"""Listing operators. A line item plays a listing: status = deal type, price and quantity = price and area."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.functions import values as V
from larkspan.operators import listings as L
from larkspan.operators import keyed, state
from larkspan.operators.lookups import strict_lookup, unknown_names
from larkspan.plans.catalog import query
from larkspan.session import load, settle, small, staging_path
from larkspan.sources import tables

EXCLUDED = "7"


def listing_rows(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("line"),
        F.concat(F.lit("https://listing.example/"), F.col("l_orderkey"), F.lit("/"), F.col("l_linenumber")).alias("url"),
        F.col("l_linestatus").alias("type"),
        F.when(F.col("l_returnflag") != "R", F.lit(1)).alias("rooms"),
        F.when(F.col("l_discount") > 0.02, F.when(F.col("l_discount") < 0.09, L.UNRENOVATED).otherwise("other")).alias(
            "renovation"
        ),
        F.when(F.col("l_tax") > 0, F.col("l_suppkey").cast("string")).alias("sales_agent_organization"),
        F.col("l_extendedprice").alias("price_value"),
        F.col("l_quantity").alias("area_value"),
    )


LISTINGS = """listings AS (
  SELECT l_orderkey AS id, l_linenumber AS line,
         'https://listing.example/' || l_orderkey || '/' || l_linenumber AS url, l_linestatus AS type,
         CASE WHEN l_returnflag <> 'R' THEN 1 END AS rooms,
         CASE WHEN l_discount > 0.02 THEN CASE WHEN l_discount < 0.09 THEN 'без_ремонта' ELSE 'other' END END AS renovation,
         CASE WHEN l_tax > 0 THEN CAST(l_suppkey AS VARCHAR) END AS sales_agent_organization,
         l_extendedprice AS price_value, l_quantity AS area_value
  FROM lineitem)"""
FILTERED = """filtered AS (
  SELECT *, coalesce(rooms, 0) AS rooms_normalized, price_value / area_value AS price_sqm FROM listings
  WHERE type = 'O' AND sales_agent_organization <> '7' AND (rooms IS NULL OR rooms = 1)
    AND (renovation IS NULL OR renovation = 'без_ремонта') AND price_value > 0 AND area_value > 20)"""
STATISTICS = """statistics AS (
  SELECT rooms_normalized, avg(price_sqm) AS mean_price_sqm, stddev_samp(price_sqm) AS stddev_price_sqm,
         avg(price_sqm) - 2 * stddev_samp(price_sqm) AS lower_bound,
         avg(price_sqm) + 2 * stddev_samp(price_sqm) AS upper_bound, count(*) AS members
  FROM filtered GROUP BY rooms_normalized)"""
NORMAL = """normal AS (
  SELECT f.*, s.lower_bound, s.upper_bound FROM filtered f JOIN statistics s USING (rooms_normalized)
  WHERE f.price_sqm BETWEEN s.lower_bound AND s.upper_bound)"""
MEDIANS = """medians AS (
  SELECT rooms_normalized, quantile_cont(price_sqm, 0.5) AS median_price_sqm, count(*) AS objects_count
  FROM normal GROUP BY rooms_normalized)"""
COLUMNS = ["id", "line", "url", "price_value", "area_value", "price_sqm", "rooms", "renovation",
           "sales_agent_organization", "type", "rooms_normalized"]
ROUNDED = ["mean_price_sqm", "stddev_price_sqm", "lower_bound", "upper_bound", "median_price_sqm"]
BELOW = f"""WITH {LISTINGS}, {FILTERED}, {STATISTICS}, {NORMAL}, {MEDIANS}
SELECT {', '.join('f.' + c for c in COLUMNS)},
       round(s.mean_price_sqm, 4) AS mean_price_sqm, round(s.stddev_price_sqm, 4) AS stddev_price_sqm,
       round(s.lower_bound, 4) AS lower_bound, round(s.upper_bound, 4) AS upper_bound,
       round(m.median_price_sqm, 4) AS median_price_sqm, m.objects_count
FROM filtered f JOIN statistics s USING (rooms_normalized) JOIN medians m USING (rooms_normalized)
WHERE (1 - f.price_sqm / m.median_price_sqm) * 100 >= 5.0 OR f.price_sqm < s.lower_bound"""


def _rounded(frame: DataFrame) -> DataFrame:
    return frame.withColumns({c: F.round(c, 4) for c in ROUNDED if c in frame.columns})


def _comparable(spark: SparkSession, d: str) -> DataFrame:
    return L.comparable(listing_rows(spark, d), excluded_organization=EXCLUDED, deal_type="O")


@query(BELOW)
def below_market_listings(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: C2, B21, E1, D1, E2, C10 in one query."""
    found = L.below_market(listing_rows(spark, d), excluded_organization=EXCLUDED, deal_type="O", keep=COLUMNS)
    return _rounded(found)


@query(BELOW)
def below_market_listings_narrowed(spark: SparkSession, d: str) -> DataFrame:
    """The flagship by the plan for groups that do not fit one task."""
    found = L.below_market(
        listing_rows(spark, d), excluded_organization=EXCLUDED, deal_type="O", keep=COLUMNS, max_median_rows=200
    )
    return _rounded(found)


@query(
    f"""WITH {LISTINGS}, {FILTERED}, {STATISTICS}, {NORMAL}, {MEDIANS}
SELECT f.id, f.line, f.url, f.price_sqm, s.lower_bound > f.price_sqm AS is_low
FROM filtered f JOIN statistics s USING (rooms_normalized) JOIN medians m USING (rooms_normalized)
WHERE (1 - f.price_sqm / m.median_price_sqm) * 100 >= 5.0 OR f.price_sqm < s.lower_bound"""
)
def c10_below_market_predicate(spark: SparkSession, d: str) -> DataFrame:
    rows = _comparable(spark, d)
    statistics, medians = L.inlier_medians(rows)
    facts = small(statistics.join(medians, "rooms_normalized"))
    joined = rows.join(facts, "rooms_normalized")
    low = L.is_below_market(F.col("price_sqm"), F.col("median_price_sqm"), F.col("lower_bound"))
    return joined.where(low).select(
        "id", "line", "url", "price_sqm", (F.col("lower_bound") > F.col("price_sqm")).alias("is_low")
    )


@query(f"WITH {LISTINGS}, {FILTERED} SELECT id, line, price_value, area_value, rooms, renovation, "
       "sales_agent_organization FROM filtered")  # fmt: skip
def c2_comparable_filter(spark: SparkSession, d: str) -> DataFrame:
    return _comparable(spark, d).select(
        "id", "line", "price_value", "area_value", "rooms", "renovation", "sales_agent_organization"
    )


@query(f"WITH {LISTINGS}, {FILTERED} SELECT id, line, rooms_normalized, price_sqm FROM filtered")
def b21_unit_price(spark: SparkSession, d: str) -> DataFrame:
    rows = _comparable(spark, d)
    return rows.select(
        "id", "line", V.normal_rooms(F.col("rooms")).alias("rooms_normalized"),
        V.unit_price(F.col("price_value"), F.col("area_value")).alias("price_sqm"),
    )


@query(
    f"""WITH {LISTINGS}, {FILTERED}, {STATISTICS}
SELECT rooms_normalized, round(mean_price_sqm, 4) AS mean_price_sqm, round(stddev_price_sqm, 4) AS stddev_price_sqm,
       round(lower_bound, 4) AS lower_bound, round(upper_bound, 4) AS upper_bound, members FROM statistics"""
)
def e1_group_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(L.group_statistics(_comparable(spark, d)))


@query(
    f"""WITH {LISTINGS}, {FILTERED}, {STATISTICS}, {NORMAL}, {MEDIANS}
SELECT rooms_normalized, round(median_price_sqm, 4) AS median_price_sqm, objects_count FROM medians"""
)
def e2_inlier_median(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(L.inlier_medians(_comparable(spark, d))[1])


@query(
    f"""WITH {LISTINGS}, {FILTERED}, {STATISTICS}, {NORMAL}, {MEDIANS}
SELECT rooms_normalized, round(median_price_sqm, 4) AS median_price_sqm, objects_count FROM medians"""
)
def e2_inlier_median_narrowed(spark: SparkSession, d: str) -> DataFrame:
    """The same with groups treated as too large for one task."""
    return _rounded(L.inlier_medians(_comparable(spark, d), max_rows=100)[1])


@query(
    """SELECT o_custkey, round(quantile_cont(o_totalprice, 0.5), 4) AS median_price_sqm, count(*) AS objects_count
FROM orders GROUP BY o_custkey"""
)
def e2_narrowed_median(spark: SparkSession, d: str) -> DataFrame:
    """Exact medians of many groups by narrowing, with a bound small enough to need several passes."""
    orders = load(spark, d, "orders")
    return _rounded(L.narrowed_median(orders, "o_custkey", "o_totalprice", max_rows=4, buckets=4))


@query(f"WITH {LISTINGS}, {FILTERED}, {STATISTICS}, {NORMAL} SELECT id, line, rooms_normalized, price_sqm FROM normal")
def d1_stats_join(spark: SparkSession, d: str) -> DataFrame:
    rows = _comparable(spark, d)
    return L.inliers(rows, small(L.group_statistics(rows))).select("id", "line", "rooms_normalized", "price_sqm")


@query(
    """SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE c_mktsegment = 'BUILDING' AND r_name <> 'AFRICA' AND (n_name = 'NATION_7' OR r_name = 'EUROPE')"""
)
def c1_offer_keep_rule(spark: SparkSession, d: str) -> DataFrame:
    offers = _customers(spark, d)
    rule = L.keep_rule(
        F.col("c_mktsegment"), F.col("country"), F.col("n_name"), F.col("r_name"),
        want_category="BUILDING", want_country="present", want_city="NATION_7", want_region="EUROPE",
    )
    return offers.where(rule).select("c_custkey")


def _customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their nation and region; the country is missing for one region."""
    nations = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        load(spark, d, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("country", F.when(F.col("r_name") != "AFRICA", "present"))
    )


@query(
    """SELECT count(*) AS total, count(*) FILTER (r_name <> 'AFRICA' AND c_mktsegment = 'BUILDING'
  AND (n_name = 'NATION_7' OR r_name = 'EUROPE')) AS kept
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
def e9_load_totals(spark: SparkSession, d: str) -> DataFrame:
    rule = L.keep_rule(
        F.col("c_mktsegment"), F.col("country"), F.col("n_name"), F.col("r_name"),
        want_category="BUILDING", want_country="present", want_city="NATION_7", want_region="EUROPE",
    )
    return L.load_totals(_customers(spark, d), rule)


def _ads(spark: SparkSession, d: str) -> DataFrame:
    """Orders as scraped ads."""
    orders = load(spark, d, "orders")
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    present = F.col("o_custkey") % 3
    return orders.select(
        key.alias("id"),
        F.concat(F.lit("https://ad.example/"), key).alias("link"),
        F.lit("Москва").alias("city"),
        F.when(status == "O", "real_estate_agent").when(status == "F", "homeowner").when(present == 0, "realtor")
        .otherwise("unknown").alias("author_type"),
        F.concat(F.lit("author "), "o_custkey").alias("author"),
        F.when(present > 0, F.col("o_orderpriority")).alias("street"),
        F.when(present > 1, F.col("o_custkey").cast("string")).alias("house_number"),
        F.lit("district").alias("district"),
        F.lit("station").alias("underground"),
        F.when(status != "P", F.col("o_totalprice")).alias("price"),
        F.when(present == 1, F.col("o_totalprice") / 100).alias("price_per_month"),
        (F.col("o_custkey") % 40).cast("double").alias("total_meters"),
        (F.col("o_custkey") % 5).cast("int").alias("rooms_count"),
        F.lit(3).alias("floor"),
        F.lit(9).alias("floors_count"),
        F.col("o_orderpriority").alias("description"),
        F.when(status == "O", F.array(F.lit("a.jpg"), F.lit("b.jpg"))).otherwise(F.array().cast("array<string>"))
        .alias("photos"),
    )


ADS = """ads AS (
  SELECT o_orderkey AS id, 'https://ad.example/' || o_orderkey AS link, o_orderstatus AS status, o_custkey,
         CASE WHEN o_orderstatus = 'O' THEN 'real_estate_agent' WHEN o_orderstatus = 'F' THEN 'homeowner'
              WHEN o_custkey % 3 = 0 THEN 'realtor' ELSE 'unknown' END AS author_type,
         'author ' || o_custkey AS author,
         CASE WHEN o_custkey % 3 > 0 THEN o_orderpriority END AS street,
         CASE WHEN o_custkey % 3 > 1 THEN CAST(o_custkey AS VARCHAR) END AS house_number,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price,
         CASE WHEN o_custkey % 3 = 1 THEN o_totalprice / 100 END AS price_per_month,
         CAST(o_custkey % 40 AS DOUBLE) AS total_meters, CAST(o_custkey % 5 AS INTEGER) AS rooms_count,
         o_orderpriority AS description
  FROM orders)"""


@query(
    f"""WITH {ADS} SELECT id, CASE WHEN price IS NULL AND price_per_month IS NULL THEN 0
  WHEN total_meters = 0 THEN NULL
  ELSE CAST(trunc(coalesce(price, price_per_month) / total_meters) AS BIGINT) END AS price_per_m2 FROM ads"""
)
def b22_whole_unit_price(spark: SparkSession, d: str) -> DataFrame:
    price = V.whole_unit_price(F.col("price"), F.col("price_per_month"), F.col("total_meters"))
    return _ads(spark, d).select("id", price.alias("price_per_m2"))


@query(
    f"""WITH {ADS} SELECT id, nullif(concat_ws(' ', street, house_number), '') AS address FROM ads"""
)
def b23_address(spark: SparkSession, d: str) -> DataFrame:
    return _ads(spark, d).select("id", V.joined_address(F.col("street"), F.col("house_number")).alias("address"))


@query(
    f"""WITH {ADS} SELECT id, 'продажа' AS type, 'жилая' AS property_type, 'квартира' AS category, link AS url,
  CAST(77 AS INTEGER) AS newobject_id, '2024-05-06 07:08:09' AS creation_date, 'Россия' AS location_country,
  'Московская' AS location_region, 'Москва' AS location_locality_name, 'district' AS location_sub_locality_name,
  nullif(concat_ws(' ', street, house_number), '') AS location_address, 'station' AS location_metro_name,
  coalesce(CAST(trunc(price) AS BIGINT), 0) AS price_value, 'RUB' AS price_currency, rooms_count AS rooms, 3 AS floor,
  9 AS floors_total, description,
  CASE WHEN author_type = 'real_estate_agent' THEN 'агентство' END AS sales_agent_category,
  CASE WHEN author_type = 'real_estate_agent' THEN author END AS sales_agent_organization,
  CASE WHEN author_type <> 'real_estate_agent' THEN author END AS sales_agent_name,
  CASE WHEN status = 'O' THEN 'a.jpg,b.jpg' END AS image,
  CASE WHEN total_meters > 0 THEN total_meters END AS area_value,
  CASE WHEN total_meters > 0 THEN 'кв.м' END AS area_unit FROM ads"""
)
def b24_listing_normalisation(spark: SparkSession, d: str) -> DataFrame:
    rows = L.normalised_ads(_ads(spark, d), 77, F.lit("2024-05-06 07:08:09").cast("timestamp"))
    return rows.drop("last_update_date").withColumns(
        {"creation_date": F.date_format("creation_date", "yyyy-MM-dd HH:mm:ss"), "image": F.array_join("image", ",")}
    )


@query(f"WITH {ADS} SELECT id, author_type FROM ads WHERE author_type IN ('unknown', 'homeowner')")
def c7_owner_filter(spark: SparkSession, d: str) -> DataFrame:
    return L.owners_only(_ads(spark, d)).select("id", "author_type")


@query("SELECT l_orderkey AS id, l_linenumber AS line FROM lineitem WHERE l_suppkey = 5 AND l_linenumber = 1")
def c8_complex_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("newobject_id"), F.col("l_linenumber").alias("from_developer"),
    )
    return L.of_complex(rows, 5, from_developer=1).select("id", "line")


@query(f"WITH {ADS} SELECT round(avg(coalesce(price, price_per_month)), 4) AS average_price FROM ads")
def e8_mean_price(spark: SparkSession, d: str) -> DataFrame:
    return L.mean_price(_ads(spark, d)).select(F.round("average_price", 4).alias("average_price"))


@query(
    """WITH districts AS (
  SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN ['Москва', o_orderpriority || ', р-н ' || o_custkey || ', Москва',
    'р-н 2, Москва'] ELSE ['р-н без города, дом', 'Москва р-н 3'] END AS texts FROM orders)
SELECT id, coalesce(list_filter(texts, lambda t: contains(t, 'р-н') AND contains(t, 'Москва') AND length(t) < 250
  AND contains(t, ','))[1], '') AS address FROM districts"""
)
def b25_district_address(spark: SparkSession, d: str) -> DataFrame:
    named = F.concat("o_orderpriority", F.lit(", р-н "), "o_custkey", F.lit(", Москва"))
    texts = F.when(
        F.col("o_custkey") % 2 == 0, F.array(F.lit("Москва"), named, F.lit("р-н 2, Москва"))
    ).otherwise(F.array(F.lit("р-н без города, дом"), F.lit("Москва р-н 3")))
    address = V.district_address(texts, F.lit("Москва"))
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), address.alias("address"))


CHANGES = """changes AS (
  SELECT id, last_update_date, price_value, price_currency, rooms, description, url FROM (
    SELECT l_orderkey AS id, 'updated' AS last_update_date, l_extendedprice AS price_value, 'USD' AS price_currency,
           l_linenumber AS rooms, l_returnflag AS description, 'line ' || l_linenumber AS url,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC,
             l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC,
             l_returnflag DESC) AS rn
    FROM lineitem) WHERE rn = 1)"""
TARGET = """target AS (
  SELECT o_orderkey AS id, CAST(o_orderdate AS VARCHAR) AS last_update_date, o_totalprice AS price_value,
         'RUB' AS price_currency, CAST(o_custkey % 5 AS INTEGER) AS rooms, o_orderpriority AS description,
         'order ' || o_orderkey AS url FROM orders WHERE o_orderstatus <> 'P')"""


def _changes(spark: SparkSession, d: str) -> DataFrame:
    items = load(spark, d, "lineitem")
    tie = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount",
           "l_tax", "l_returnflag"]
    last = state.first_per_key(items, ["l_orderkey"], [F.col(c).desc() for c in tie])
    return last.select(
        F.col("l_orderkey").alias("id"), F.lit("updated").alias("last_update_date"),
        F.col("l_extendedprice").alias("price_value"), F.lit("USD").alias("price_currency"),
        F.col("l_linenumber").alias("rooms"), F.col("l_returnflag").alias("description"),
        F.concat(F.lit("line "), "l_linenumber").alias("url"),
    )


def _target(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("last_update_date"),
        F.col("o_totalprice").alias("price_value"), F.lit("RUB").alias("price_currency"),
        (F.col("o_custkey") % 5).cast("int").alias("rooms"), F.col("o_orderpriority").alias("description"),
        F.concat(F.lit("order "), "o_orderkey").alias("url"),
    )


@query(
    f"""WITH {CHANGES}, {TARGET} SELECT coalesce(t.id, c.id) AS id, coalesce(c.last_update_date, t.last_update_date) AS last_update_date,
  coalesce(c.price_value, t.price_value) AS price_value, coalesce(c.price_currency, t.price_currency) AS price_currency,
  coalesce(c.rooms, t.rooms) AS rooms, coalesce(c.description, t.description) AS description,
  coalesce(t.url, c.url) AS url FROM target t FULL JOIN changes c ON t.id = c.id"""
)
def g2_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The last change per order replaces five columns of a known order; unknown orders come in whole."""
    return state.upsert(_target(spark, d), _changes(spark, d), "id", L.UPDATED_BY_SCRAPE)


@query(
    f"""WITH {CHANGES}, {TARGET} SELECT coalesce(t.id, c.id) AS id, coalesce(c.last_update_date, t.last_update_date) AS last_update_date,
  coalesce(c.price_value, t.price_value) AS price_value, coalesce(c.price_currency, t.price_currency) AS price_currency,
  coalesce(c.rooms, t.rooms) AS rooms, coalesce(c.description, t.description) AS description,
  coalesce(t.url, c.url) AS url FROM target t FULL JOIN changes c ON t.id = c.id"""
)
def g2_upsert_in_place(spark: SparkSession, d: str) -> DataFrame:
    """The same on a stored table, in two changes of some of its buckets each."""
    path, changes = staging_path(spark, "listings"), settle(_changes(spark, d))
    keyed.create(_target(spark, d), path, "id", buckets=16)
    for part in (0, 1):
        keyed.upsert(spark, path, changes.where(F.col("id") % 2 == part), L.UPDATED_BY_SCRAPE)
    return keyed.read(spark, path)


@query(f"WITH {CHANGES} SELECT id, price_value, rooms, url FROM changes")
def g5_first_per_id(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).select("id", "price_value", "rooms", "url")


@query(
    """SELECT l_orderkey AS id, string_agg(l_partkey || '.jpg', ',' ORDER BY l_partkey || '.jpg') AS images, count(*) AS n
FROM lineitem GROUP BY l_orderkey"""
)
def e10_list_collection(spark: SparkSession, d: str) -> DataFrame:
    """Image list per listing: a handful of images each, sorted to be deterministic."""
    images = F.sort_array(F.collect_list(F.concat("l_partkey", F.lit(".jpg"))))
    return load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.array_join(images, ",").alias("images"), F.count(F.lit(1)).alias("n")
    )


@query(
    """SELECT s_suppkey, n_nationkey AS region_id FROM supplier JOIN nation
  ON n_name = 'NATION_' || s_nationkey"""
)
def d2_dictionary_join(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("NATION_"), "s_nationkey").alias("region"))
    dictionary = load(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))
    return strict_lookup(rows, dictionary, "region").select("s_suppkey", "region_id")


@query(
    """SELECT s_suppkey, 'NATION_' || s_nationkey AS region FROM supplier
WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_name = 'NATION_' || s_nationkey AND n_regionkey <> 2)"""
)
def d2_dictionary_rejects(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("NATION_"), "s_nationkey").alias("region"))
    dictionary = load(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_name").alias("name"))
    return unknown_names(rows, dictionary, "region")


@query(BELOW.split("SELECT f.id")[0] +
       """SELECT f.url FROM filtered f JOIN statistics s USING (rooms_normalized) JOIN medians m USING (rooms_normalized)
WHERE (1 - f.price_sqm / m.median_price_sqm) * 100 >= 5.0 OR f.price_sqm < s.lower_bound""")  # fmt: skip
def a12_result_dump(spark: SparkSession, d: str) -> DataFrame:
    """The analytic result written in id order and its URL column read back."""
    path = staging_path(spark, "dump")
    found = L.below_market(listing_rows(spark, d), excluded_organization=EXCLUDED, deal_type="O", keep=COLUMNS)
    tables.dump(found, path)
    return tables.urls(spark.read.parquet(path))


@query(
    """SELECT row_number() OVER (ORDER BY o_orderkey) AS place, o_orderkey AS id FROM orders"""
)
def f9_ordered_output(spark: SparkSession, d: str) -> DataFrame:
    """Rows written in id order; the place is the row's position in the written files."""
    path = staging_path(spark, "ordered")
    tables.dump(load(spark, d, "orders").select(F.col("o_orderkey").alias("id")), path)
    rows = spark.read.parquet(path).select(
        "id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    # The number of the file is part of its name, so the names order the files as they were written.
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small(sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    return rows.join(offsets, "file").select((F.col("before") + F.col("row") + 1).alias("place"), "id")
