"""Shards of nearly equal bytes by sampled, size-weighted splitters. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.common import pick
from larkspan.session import settle

SHARDS = 8
RANGES_PER_SHARD = 64
ROWS_PER_RANGE = 1_000_000
SAMPLES_PER_RANGE = 32
# A looked-up interval is found through the upper bits of the key.
LOOKUP_SHIFT = 20
SPREAD = 1 << 20


def _splitters(rows: DataFrame, ranges: int, total: int) -> DataFrame:
    """Intervals [start, next) of crc with the number ``base`` of their first range and their count ``parts``.

    A row is sampled with a chance in proportion to its size. A crc on which two or more quantiles fall is
    overfull: it gets an interval of its own, cut into that many ranges by the spread of the id.
    """
    step = max(1.0, total / (ranges * SAMPLES_PER_RANGE))
    chance = F.pmod(F.xxhash64("id", "crc", "size", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(chance < F.col("size") / F.lit(step)).select(
        "crc", "spread", "id", F.greatest(F.col("size").cast("double"), F.lit(step)).alias("weight")
    )
    so_far = Window.partitionBy(F.lit(0)).orderBy("crc", "spread", "id")
    everything = Window.partitionBy(F.lit(0))
    quantile = F.floor(F.sum("weight").over(so_far) * F.lit(ranges) / F.sum("weight").over(everything))
    cuts = (
        sample.select("crc", quantile.alias("quantile"))
        .groupBy("quantile")
        .agg(F.min("crc").alias("crc"))
        .groupBy("crc")
        .agg(F.count(F.lit(1)).cast("int").alias("parts"))
    )
    after = cuts.where("parts > 1").select((F.col("crc") + 1).alias("crc"), F.lit(1).alias("parts"))
    origin = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("crc"), F.lit(1).alias("parts"))
    starts = cuts.unionByName(after).unionByName(origin).groupBy("crc").agg(F.max("parts").alias("parts"))
    order = Window.partitionBy(F.lit(0)).orderBy("crc")
    return starts.select(
        F.col("crc").alias("start"),
        F.lead("crc", 1, 1 << 32).over(order).alias("next"),
        "parts",
        (F.sum("parts").over(order) - F.col("parts")).alias("base"),
    )


def size_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    ranges_per_shard: int = RANGES_PER_SHARD,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """One row per row of ``docs``: id, size, crc, shard (0 to ``shards`` - 1) and slot (gapless from 0).

    The law is ``bytes``: the sizes of all shards are nearly equal. Size is the UTF-8 bytes of the text,
    none for NULL, plus 1. Rows are ordered by the CRC-32 of the text, so equal texts lie in one shard, but
    for groups larger than a range (about 1 / ``ranges_per_shard`` of a shard), which are cut between rows.
    Repeated rows and NULL ids are rows like any other; further columns are ignored; an empty table gives
    no rows. The text itself is never shuffled, and no task numbers more than about one range.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = settle(
        pick(docs, id=id_col, text=text_col).select(
            "id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.pmod(F.xxhash64("id"), F.lit(SPREAD)).alias("spread"),
        )
    )
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(shards * ranges_per_shard, -(-count // rows_per_range))
    intervals = _splitters(rows, ranges, total)
    # At most 4096 rows more than there are intervals, which the number of ranges bounds.
    lookup = intervals.withColumn(
        "slice",
        F.explode(F.sequence(F.shiftright("start", LOOKUP_SHIFT), F.shiftright(F.col("next") - 1, LOOKUP_SHIFT))),
    )
    keyed = rows.withColumn("slice", F.shiftright("crc", LOOKUP_SHIFT)).alias("r")
    found = keyed.join(
        F.broadcast(settle(lookup)).alias("l"),
        (F.col("r.slice") == F.col("l.slice")) & (F.col("crc") >= F.col("start")) & (F.col("crc") < F.col("next")),
    ).select(
        "id", "size", "crc", "spread", "parts",
        (F.col("base") + F.floor(F.col("spread") * F.col("parts") / F.lit(SPREAD))).cast("int").alias("range"),
    )
    local = Window.partitionBy("range").orderBy("crc", "spread", "id", "size")
    placed = settle(
        found.withColumn("row", F.row_number().over(local) - 1)
        .withColumn("bytes", F.sum("size").over(local.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("group_bytes", F.min("bytes").over(Window.partitionBy("range", "crc")))
    )
    totals = placed.groupBy("range").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "range",
        F.coalesce(F.sum("s").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
    )
    at = F.col("bytes_before") + F.when(F.col("parts") > 1, F.col("bytes")).otherwise(F.col("group_bytes"))
    dealt = placed.join(F.broadcast(offsets), "range").select(
        "id", "size", "crc",
        F.floor(at.cast("decimal(38,0)") * shards / F.lit(max(total, 1)).cast("decimal(38,0)")).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("row")).alias("place"),
    )
    starts = dealt.groupBy("shard").agg(F.min("place").alias("first"))
    return dealt.join(F.broadcast(starts), "shard").select(
        "id", "size", "crc", "shard", (F.col("place") - F.col("first")).alias("slot")
    )
