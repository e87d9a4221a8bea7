"""One-to-one file matching by size and time, exact and within a tolerance."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.operators.skew import MAX_GROUP_ROWS, number_rows
from larkspan.session import settle

# How far size and time may differ.
SIZE_PERCENT = 1.0
TIME_SECONDS = 10
# Pairs of one size and time are written out in blocks of this many.
PAIR_BLOCK = 100_000
# Grids of cells, by whether they are moved by half a cell in time and in size.
GRIDS = [(0, 0), (1, 0), (0, 1), (1, 1)]


def with_second(files: DataFrame) -> DataFrame:
    """D6. Path, size and time rounded half-even to the second."""
    return files.select("path", F.col("size").cast("long").alias("size"), F.bround("mtime").cast("long").alias("sec"))


def within_size(target: Column, source: Column, percent: float = SIZE_PERCENT) -> Column:
    """D7. Size within the percentage of the source's size, bounds included."""
    return F.abs(target - source) / F.greatest(source, F.lit(1)) * 100 <= percent


def _shelf(size: Column) -> Column:
    """Range of sizes, each a tenth wider than the one before."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / math.log(1.1)).cast("long")


def nearest(
    sources: DataFrame, targets: DataFrame, percent: float = SIZE_PERCENT, seconds: int = TIME_SECONDS
) -> DataFrame:
    """D7. For each distinct (size, sec) of the sources the best (t_size, t_sec) of the targets.

    Best is the smallest time difference, then size difference, then earlier time, then smaller size.
    A source looks at each second of the window and at the one or two shelves of sizes that the
    tolerance touches, and takes the next smaller and the next larger size there from one sorted pass.
    So the work is a fixed multiple of the distinct keys, however many files lie within the tolerance
    of each other.
    """
    window = F.array(*[F.lit(i) for i in range(-seconds, seconds + 1)])
    size = F.col("size")
    lowest = _shelf(F.floor(size * (1 - percent / 100)) - 1)
    highest = _shelf(F.ceil(size * (1 + percent / 100)) + 1)
    none = F.lit(None).cast("long")
    probes = (
        sources.select("size", "sec", F.explode(window).alias("shift"))
        .select("size", "sec", "shift", F.explode(F.sequence(lowest, highest)).alias("shelf"))
        .select((F.col("sec") + F.col("shift")).alias("at"), "shelf", "size", F.col("sec").alias("s_sec"))
    )
    # A size on the shelf knows the next larger one; size -1 stands before the first.
    shelves = targets.select(F.col("sec").alias("at"), _shelf(size).alias("shelf"), "size")
    following = F.lead("size").over(Window.partitionBy("at", "shelf").orderBy("size"))
    first = shelves.groupBy("at", "shelf").agg(F.min("size").alias("next"))
    stock = shelves.withColumn("next", following).unionByName(first.withColumn("size", F.lit(-1).cast("long")))
    both = probes.withColumns({"next": none, "is_probe": F.lit(1)}).unionByName(
        stock.withColumns({"s_sec": none, "is_probe": F.lit(0)})
    )
    upto = Window.partitionBy("at", "shelf").orderBy("size", "is_probe")
    on_shelf = F.when(F.col("is_probe") == 0, F.struct(size.alias("smaller"), F.col("next").alias("larger")))
    t_size = F.col("t_size")
    t_sec = F.col("at")
    return (
        both.withColumn("near", F.last(on_shelf, ignorenulls=True).over(upto))
        .where("is_probe = 1 AND near IS NOT NULL")
        .select("size", "s_sec", "at", F.explode(F.array("near.smaller", "near.larger")).alias("t_size"))
        .where((t_size >= 0) & within_size(t_size, size, percent))
        .groupBy("size", F.col("s_sec").alias("sec"))
        .agg(
            F.min(
                F.struct(
                    F.abs(t_sec - F.col("s_sec")).alias("dt"),
                    F.abs(t_size - F.col("size")).alias("ds"),
                    t_sec.alias("t_sec"),
                    t_size.alias("t_size"),
                )
            ).alias("best")
        )
        .select("size", "sec", "best.*")
    )


def cell_flows(s: list[tuple], t: list[tuple], percent: float, seconds: int) -> list[tuple]:
    """Within one cell always the closest remaining pair: (size, sec, t_size, t_sec, qty, s_from, t_from).

    Both sides are keys (size, sec, files used, files left).
    Closest by time difference, size difference, then the target's and the source's time and size. A source
    looks up the sizes next to its own at each second from the nearest on. A pair that is no longer free only
    gives way to a farther one, so the nearest proposals come from a heap.
    """
    stock: dict[int, list[int]] = {}
    for size, sec, _, _ in t:
        insort(stock.setdefault(sec, []), size)
    t_state = {(size, sec): [used, left] for size, sec, used, left in t}
    s_state = {(size, sec): [used, left] for size, sec, used, left in s}

    def best(size: int, sec: int) -> tuple | None:
        for apart in range(seconds + 1):
            options = []
            for at in {sec - apart, sec + apart}:
                sizes = stock.get(at, [])
                place = bisect_left(sizes, size)
                options += [
                    (apart, abs(z - size), at, z, sec, size)
                    for z in sizes[max(place - 1, 0) : place + 1]
                    if abs(z - size) / max(size, 1) * 100 <= percent
                ]
            if options:
                return min(options)
        return None

    heap = [p for p in (best(*key) for key in s_state) if p]
    heapify(heap)
    flows = []
    while heap:
        _, _, t_sec, t_size, sec, size = heappop(heap)
        source, target = s_state[size, sec], t_state[t_size, t_sec]
        if target[1]:
            qty = min(source[1], target[1])
            flows.append((size, sec, t_size, t_sec, qty, source[0], target[0]))
            for side in (source, target):
                side[0] += qty
                side[1] -= qty
            if not target[1]:
                stock[t_sec].pop(bisect_left(stock[t_sec], t_size))
        if source[1] and (again := best(size, sec)):
            heappush(heap, again)
    return flows


def match_counts(
    sources: DataFrame, targets: DataFrame, percent: float = SIZE_PERCENT, seconds: int = TIME_SECONDS
) -> DataFrame:
    """D6, D7. How many files of one (size, sec) go to another, and from which place on.

    All equal keys are matched first. The rest is matched within the cells of four grids, one after another:
    cells are several windows of time long and several tolerances of size wide, and the grids are moved by half
    a cell in neither, one or both directions, so any pair within the tolerance shares a cell of some grid.
    Within a cell the closest remaining pair is always served first; a pair across the edge of a cell comes
    after those inside. So no free pair is left over, and the passes are four whatever the files. A cell holds
    distinct keys only, of its seconds and its range of sizes, however many files have them. A grid hands on the
    keys that it leaves, so a later one reads no more than these.
    """
    s = sources.groupBy("size", "sec").agg(F.count(F.lit(1)).alias("files"))
    t = targets.groupBy("size", "sec").agg(F.count(F.lit(1)).alias("files"))
    keys = settle(s.withColumnRenamed("files", "s_files").join(t.withColumnRenamed("files", "t_files"), ["size", "sec"], "full"))
    none = F.lit(0).cast("long")
    qty = F.least(F.coalesce("s_files", none), F.coalesce("t_files", none))
    exact = keys.where(qty > 0).select(
        "size", "sec", F.col("size").alias("t_size"), F.col("sec").alias("t_sec"), qty.alias("qty"),
        none.alias("s_from"), none.alias("t_from"), F.lit("exact").alias("kind"),
    )
    done = [exact]
    length = max(8 * seconds, 1)
    width = math.log1p(max(8 * percent, 1.0) / 100)
    if percent >= 100 or -math.log1p(-percent / 100) > width / 2:
        raise ValueError(f"pairs {percent} percent apart would not share a cell of some grid; some 60 percent are the most")

    def free(is_target: int, files: str) -> DataFrame:
        """Keys with files beyond the exact pairs; one without size or time has no partner."""
        rows = keys.where((F.col(files) > qty) & F.col("size").isNotNull() & F.col("sec").isNotNull())
        return rows.select(
            F.lit(is_target).cast("long").alias("is_target"), "size", "sec", qty.alias("used"), (F.col(files) - qty).alias("left")
        )

    def in_cells(rows: DataFrame, grid: tuple[int, int]) -> DataFrame:
        log = F.log(F.greatest("size", F.lit(1)).cast("double")) / width
        return rows.select(
            F.floor((F.col("sec") + grid[0] * (length // 2)) / F.lit(length)).cast("long").alias("when"),
            F.floor(log + grid[1] / 2).cast("long").alias("shelf"),
            "is_target", "size", "sec", "used", "left",
        )

    # Pairs, and the keys of the sources (0) and targets (1) that are left for the next grid.
    schema = "size long, sec long, t_size long, t_sec long, qty long, s_from long, t_from long, left_of long"
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def pairs_and_rest(sides: tuple[list, list]) -> Iterator[tuple]:
        flows = cell_flows(*sides, percent, seconds)
        taken: tuple[Counter, Counter] = (Counter(), Counter())
        for size, sec, t_size, t_sec, qty, s_from, t_from in flows:
            yield size, sec, t_size, t_sec, qty, s_from, t_from, -1
            taken[0][size, sec] += qty
            taken[1][t_size, t_sec] += qty
        for is_target, side in enumerate(sides):
            for size, sec, used, left in side:
                gone = taken[is_target][size, sec]
                if gone < left:
                    yield size, sec, 0, 0, left - gone, used + gone, 0, is_target

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by cell; only the keys of the present cell are held."""
        now, sides = None, ([], [])
        for batch in batches:
            found = []
            for *cell, is_target, size, sec, used, left in batch[columns].itertuples(index=False):
                if cell != now:
                    found += pairs_and_rest(sides)
                    now, sides = cell, ([], [])
                sides[is_target].append((size, sec, used, left))
            yield pd.DataFrame(found, columns=names, dtype="int64")
        yield pd.DataFrame(list(pairs_and_rest(sides)), columns=names, dtype="int64")

    columns = ["when", "shelf", "is_target", "size", "sec", "used", "left"]
    rest = free(0, "s_files").unionByName(free(1, "t_files"))
    for grid in GRIDS:
        dealt = in_cells(rest, grid).repartition("when", "shelf").sortWithinPartitions("when", "shelf")
        met = settle(dealt.mapInPandas(meet, schema))
        done.append(met.where("left_of < 0").drop("left_of").withColumn("kind", F.lit("near")))
        rest = met.where("left_of >= 0").select(
            F.col("left_of").alias("is_target"), "size", "sec", F.col("s_from").alias("used"), F.col("qty").alias("left")
        )
    return reduce(DataFrame.unionByName, done)


def match_files(
    sources: DataFrame,
    targets: DataFrame,
    percent: float = SIZE_PERCENT,
    seconds: int = TIME_SECONDS,
    near: bool = True,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """D6, D7. One-to-one pairs (source, target, kind); files of one key are taken in path order.

    The join key holds the place within the key, so files of a frequent size and time spread evenly.
    """
    # The listings are walked once; everything below reads these narrow tables.
    s, t = settle(with_second(sources)), settle(with_second(targets))
    if near:
        flows = match_counts(s, t, percent, seconds)
        block = F.lit(PAIR_BLOCK)
        pairs = (
            flows.select("*", F.explode(F.sequence(F.lit(0), F.col("qty") - 1, block)).alias("block"))
            .repartition("size", "sec", "t_size", "t_sec", "block")
            .select("*", F.explode(F.sequence("block", F.least(F.col("block") + block, "qty") - 1)).alias("i"))
            .select(
                "size", "sec", "t_size", "t_sec", "kind", (F.col("s_from") + F.col("i") + 1).alias("s_place"),
                (F.col("t_from") + F.col("i") + 1).alias("t_place"),
            )
        )
    s = number_rows(s, ["size", "sec"], [F.col("path")], "s_place", max_group_rows).withColumnRenamed("path", "source")
    t = number_rows(t, ["size", "sec"], [F.col("path")], "t_place", max_group_rows).withColumnRenamed("path", "target")
    if not near:
        t = t.withColumnRenamed("t_place", "s_place")
        return s.join(t, ["size", "sec", "s_place"]).select("source", "target", F.lit("exact").alias("kind"))
    t = t.withColumnsRenamed({"size": "t_size", "sec": "t_sec"})
    return (
        s.join(pairs, ["size", "sec", "s_place"])
        .join(t, ["t_size", "t_sec", "t_place"])
        .select("source", "target", "kind")
    )
