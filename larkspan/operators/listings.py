"""Listings: keep rules, prices against their group, scraped ads, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions import values as V
from larkspan.session import settle, small

# Fixed values of the domain; every one can be overridden by the caller.
FLAT = "квартира"
COUNTRY = "Россия"
CITY = "Москва"
REGION = "Московская"
SALE = "продажа"
UNRENOVATED = "без_ремонта"
AREA_UNIT = "кв.м"
HOUSING = "жилая"
CURRENCY = "RUB"
AGENCY = "агентство"
MIN_AREA = 20.0
MIN_DISCOUNT_PERCENT = 5.0
UPDATED_BY_SCRAPE = ["last_update_date", "price_value", "price_currency", "rooms", "description"]

# Above this many rows a group's median is found by narrowing instead of one in-memory value map.
MEDIAN_GROUP_ROWS = 1_000_000
MEDIAN_BUCKETS = 4096


def keep_rule(
    category: Column,
    country: Column,
    city: Column,
    region: Column,
    *,
    want_category: str = FLAT,
    want_country: str = COUNTRY,
    want_city: str = CITY,
    want_region: str = REGION,
) -> Column:
    """C1. True for a flat in the wanted country and in the wanted city or region; never NULL."""
    rule = (category == want_category) & (country == want_country) & ((city == want_city) | (region == want_region))
    return F.coalesce(rule, F.lit(False))


def comparable(
    listings: DataFrame,
    *,
    excluded_organization: str,
    deal_type: str = SALE,
    rooms: int = 1,
    renovation: str = UNRENOVATED,
    min_area: float = MIN_AREA,
) -> DataFrame:
    """C2, B21. Listings that may be compared, with ``rooms_normalized`` and ``price_sqm``.

    A listing without an organisation is dropped, as the SQL comparison with NULL does.
    """
    return (
        listings.where(F.col("type") == deal_type)
        .where(F.col("sales_agent_organization") != excluded_organization)
        .where(F.col("rooms").isNull() | (F.col("rooms") == rooms))
        .where(F.col("renovation").isNull() | (F.col("renovation") == renovation))
        .where((F.col("price_value") > 0) & (F.col("area_value") > min_area))
        .withColumn("rooms_normalized", V.normal_rooms(F.col("rooms")))
        .withColumn("price_sqm", F.col("price_value") / F.col("area_value"))
    )


def group_statistics(frame: DataFrame, group: str = "rooms_normalized", value: str = "price_sqm") -> DataFrame:
    """E1. Mean, sample deviation and mean +- 2 deviations per group, with the group's row count."""
    mean, deviation = F.avg(value), F.stddev_samp(value)
    return frame.groupBy(group).agg(
        mean.alias("mean_price_sqm"),
        deviation.alias("stddev_price_sqm"),
        (mean - 2 * deviation).alias("lower_bound"),
        (mean + 2 * deviation).alias("upper_bound"),
        F.count(F.lit(1)).alias("members"),
    )


def inliers(frame: DataFrame, statistics: DataFrame, group: str = "rooms_normalized", value: str = "price_sqm"):
    """D1. Rows within the bounds of their group. A one-row group has NULL bounds and vanishes."""
    bounds = statistics.select(group, "lower_bound", "upper_bound")
    return frame.join(bounds, group).where(F.col(value).between(F.col("lower_bound"), F.col("upper_bound")))


def group_median(frame: DataFrame, group: str, value: str) -> DataFrame:
    """E2. Exact median and count of the non-NULL values per group, if their distinct values fit one task.

    Rows without a group are left out, as by ``narrowed_median``.
    """
    return frame.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(
        F.median(value).alias("median_price_sqm"), F.count(F.lit(1)).alias("objects_count")
    )


def exact_median(
    frame: DataFrame, group: str, value: str, largest_group: int, max_rows: int = MEDIAN_GROUP_ROWS
) -> DataFrame:
    """E2. The exact median by the plan for groups of up to ``largest_group`` rows."""
    if largest_group <= max_rows:
        return group_median(frame, group, value)
    return narrowed_median(frame, group, value, max_rows)


def inlier_medians(rows: DataFrame, max_rows: int = MEDIAN_GROUP_ROWS, group: str = "rooms_normalized", value: str = "price_sqm"):
    """E1, D1, E2. Statistics of each group, and median and count of its rows within the bounds.

    A group without such rows has no median and drops out.
    """
    statistics = small(group_statistics(rows, group, value))
    normal = inliers(rows.select(group, value), statistics, group, value)
    largest = statistics.agg(F.coalesce(F.max("members"), F.lit(0))).first()[0]
    return statistics, exact_median(normal, group, value, largest, max_rows)


def value_bucket(value: Column) -> Column:
    """Range of values, each 1/256 wider than the one before; keeps the order of the values."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * 256).cast("long")


def narrowed_median(
    frame: DataFrame,
    group: str,
    value: str,
    max_rows: int = MEDIAN_GROUP_ROWS,
    buckets: int = MEDIAN_BUCKETS,
) -> DataFrame:
    """E2. The same exact median for groups of any size, with no group in one task.

    The first scan counts each group by value buckets, summed before the shuffle, which tells the bucket
    of the middle row. The second scan writes the values of these buckets with their counts, well below
    a percent of the input. If a bucket still has more than ``max_rows`` rows and several values, it is
    counted again by equal parts of its true range, until the middle row can be read off.
    """
    rows = frame.select(group, F.col(value).alias("v"), F.lit(1).cast("long").alias("w"))
    rows = rows.where(F.col("v").isNotNull() & F.col(group).isNotNull())
    n, pos, below = F.col("n"), F.col("pos"), F.col("below")
    is_open = (F.col("within") > max_rows) & (F.col("lo") < F.col("hi"))

    def counted(source: DataFrame, *keys: Column | str) -> DataFrame:
        """Count, smallest and largest value by the keys."""
        return source.groupBy(*keys).agg(F.sum("w").alias("n"), F.min("v").alias("b_lo"), F.max("v").alias("b_hi"))

    def containing(targets: DataFrame, parts: DataFrame, span: list[str]) -> DataFrame:
        """The part of its span in which each target lies."""
        upto = Window.partitionBy(*span).orderBy("b_lo").rowsBetween(Window.unboundedPreceding, -1)
        placed = parts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        start = below + F.col("before")
        return (
            targets.join(placed, span)
            .where((pos >= start) & (pos < start + n))
            .select(group, "pos", start.alias("below"), F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"), n.alias("within"))
        )

    parts = small(counted(rows, group, value_bucket(F.col("v")).alias("bucket")))
    sizes = parts.groupBy(group).agg(F.sum("n").alias("objects_count"))
    middles = F.array_distinct(F.array(F.expr("(objects_count - 1) div 2"), F.expr("objects_count div 2")))
    positions = sizes.select(group, F.explode(middles).alias("pos"), F.lit(0).cast("long").alias("below"))
    targets = small(containing(positions, parts, [group]))
    span = [group, "lo", "hi"]
    spans = targets.where("lo < hi").select(*span).distinct()
    inside = rows.join(spans, group).where(F.col("v").between(F.col("lo"), F.col("hi")))
    rows = settle(inside.groupBy(group, "v").agg(F.sum("w").alias("w")))

    while not (unsolved := targets.where(is_open)).isEmpty():
        share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets
        inside = rows.join(unsolved.select(*span).distinct(), group).where(F.col("v").between(F.col("lo"), F.col("hi")))
        parts = counted(inside, *span, F.least(F.floor(share), F.lit(buckets - 1)).alias("bucket"))
        targets = small(targets.where(~is_open).unionByName(containing(unsolved, parts, span)))

    single = targets.where("lo = hi").select(group, "pos", F.col("lo").alias("v"))
    rest = targets.where("lo < hi")
    inside = rows.join(rest.select(*span).distinct(), group).where(F.col("v").between(F.col("lo"), F.col("hi")))
    found = containing(rest, counted(inside, *span, "v"), span).select(group, "pos", F.col("lo").alias("v"))
    medians = single.unionByName(found).groupBy(group).agg(F.avg("v").alias("median_price_sqm"))
    return medians.join(sizes, group)


def below_market(
    listings: DataFrame,
    *,
    max_median_rows: int = MEDIAN_GROUP_ROWS,
    min_discount: float = MIN_DISCOUNT_PERCENT,
    keep: list[str] | None = None,
    **comparable_options,
) -> DataFrame:
    """The flagship: listings at least ``min_discount`` percent below the median of their group, or below
    mean - 2 deviations (C2, B21, E1, D1, E2, C10).

    The listings are scanned three times, or four with large groups, and never shuffled: the per-group
    tables are aggregates, computed once and joined by whichever strategy their checked size allows.
    """
    group, value = "rooms_normalized", "price_sqm"
    rows = comparable(listings, **comparable_options)
    statistics, medians = inlier_medians(rows, max_median_rows, group, value)
    # The inner join is the query's own: a group without inliers has no median and drops out.
    facts = small(statistics.drop("members").join(medians, group))
    columns = keep or [
        "id", "url", "price_value", "area_value", "price_sqm", "rooms", "renovation", "sales_agent_organization",
        "type", "rooms_normalized",
    ]
    return (
        rows.select(*columns)
        .join(facts, group)
        .where(is_below_market(F.col(value), F.col("median_price_sqm"), F.col("lower_bound"), min_discount))
        .select(
            *columns, "mean_price_sqm", "stddev_price_sqm", "lower_bound", "upper_bound", "median_price_sqm",
            "objects_count",
        )
    )


def is_below_market(price: Column, median: Column, lower: Column, min_discount: float = MIN_DISCOUNT_PERCENT):
    """C10."""
    return ((1 - price / median) * 100 >= min_discount) | (price < lower)


def normalised_ads(ads: DataFrame, complex_id: int, run_at: Column) -> DataFrame:
    """B24. Scraped ads as rows of the listing table."""
    agent = F.col("author_type") == "real_estate_agent"
    has_area = F.col("total_meters") > 0
    return ads.select(
        F.col("id").cast("long").alias("id"),
        F.lit(SALE).alias("type"),
        F.lit(HOUSING).alias("property_type"),
        F.lit(FLAT).alias("category"),
        F.col("link").alias("url"),
        F.lit(complex_id).cast("int").alias("newobject_id"),
        run_at.alias("creation_date"),
        run_at.alias("last_update_date"),
        F.lit(COUNTRY).alias("location_country"),
        F.lit(REGION).alias("location_region"),
        F.col("city").alias("location_locality_name"),
        F.col("district").alias("location_sub_locality_name"),
        V.joined_address(F.col("street"), F.col("house_number")).alias("location_address"),
        F.col("underground").alias("location_metro_name"),
        F.coalesce(F.col("price").cast("long"), F.lit(0)).alias("price_value"),
        F.lit(CURRENCY).alias("price_currency"),
        F.col("rooms_count").alias("rooms"),
        F.col("floor").alias("floor"),
        F.col("floors_count").alias("floors_total"),
        F.col("description").alias("description"),
        F.when(agent, F.lit(AGENCY)).alias("sales_agent_category"),
        F.when(agent, F.col("author")).alias("sales_agent_organization"),
        F.when(~F.coalesce(agent, F.lit(False)), F.col("author")).alias("sales_agent_name"),
        F.when(F.size("photos") > 0, F.col("photos")).alias("image"),
        F.when(has_area, F.col("total_meters")).alias("area_value"),
        F.when(has_area, F.lit(AREA_UNIT)).alias("area_unit"),
    )


def owners_only(ads: DataFrame) -> DataFrame:
    """C7. Drop ads whose author is known to be no owner."""
    return ads.where(F.col("author_type").isin("unknown", "homeowner"))


def of_complex(listings: DataFrame, complex_id: int, from_developer: int | None = None) -> DataFrame:
    """C8. Listings of one housing complex, optionally by who sells; an id of 0 or less means no filter."""
    if complex_id > 0:
        listings = listings.where(F.col("newobject_id") == complex_id)
    if from_developer is not None:
        listings = listings.where(F.col("from_developer") == from_developer)
    return listings


def mean_price(ads: DataFrame) -> DataFrame:
    """E8. Mean of price, else monthly price, over the ads that have one."""
    return ads.agg(F.avg(F.coalesce("price", "price_per_month")).alias("average_price"))


def load_totals(offers: DataFrame, kept: Column) -> DataFrame:
    """E9. Rows seen and rows kept by a load."""
    return offers.agg(F.count(F.lit(1)).alias("total"), F.count_if(kept).alias("kept"))
