"""Token sequences of a fixed length, packed by best-two-fit.

Pieces of equal length are interchangeable, so the rule runs on the histogram of lengths, at most ``capacity``
rows whatever the table: a bin is filled greedily with the longest pieces that fit, then its shortest piece
gives way to the two unpacked ones that fill the gap it leaves more tightly. A bin is repeated as often as the
counts allow the same choices, so the plan is that of one bin after another, yet its size is bounded by the
capacity. Every piece then finds its bin by its number among the pieces of its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm import words
from larkspan.llm.common import pick, unused
from larkspan.session import settle

CAPACITY = 2048
END_ID = 0
# Pieces of one length that one task numbers at most, on average.
ROWS_PER_RANGE = 4_000
# Bits of a slot's key below the length: more pieces of one length than these count to are an error.
RANK_BITS = 44

Bin = list[tuple[int, int]]


def best_bin(counts: np.ndarray) -> tuple[Bin, dict[int, int]]:
    """The next bin as (length, how often), longest first, and how many of each length the choice looked at.

    counts[n] pieces of length n are unpacked; the capacity is the largest n.
    """
    left = counts.copy()
    capacity = len(counts) - 1
    used: dict[int, int] = {}

    def fill(gap: int) -> int:
        while gap:
            fitting = np.flatnonzero(left[1 : gap + 1])
            if not len(fitting):
                break
            length = int(fitting[-1]) + 1
            times = min(int(left[length]), gap // length)
            left[length] -= times
            used[length] = used.get(length, 0) + times
            gap -= times * length
        return gap

    gap = fill(capacity)
    looked = dict(used)
    if gap and sum(used.values()) > 1:
        shortest = min(used)
        room = gap + shortest
        # For each longer one of the two the longest other one that still fits.
        lengths = np.flatnonzero(left[: room + 1])
        lengths = lengths[lengths > 0]
        at = np.searchsorted(lengths, np.minimum(lengths, room - lengths), side="right") - 1
        # A length that would pair with itself needs two pieces, else the next shorter one is taken.
        alone = (at >= 0) & (lengths[at] == lengths) & (left[lengths] < 2) if len(lengths) else np.empty(0, bool)
        at = at - alone
        total = np.where(at >= 0, lengths + lengths[at], 0) if len(lengths) else np.empty(0, np.int64)
        if len(total) and int(total.max()) > shortest:
            best = int(np.argmax(total))
            used[shortest] -= 1
            left[shortest] += 1
            for length in (int(lengths[best]), int(lengths[at[best]])):
                used[length] = used.get(length, 0) + 1
                left[length] -= 1
                looked[length] = max(looked.get(length, 0), used[length])
            fill(room - int(total[best]))
            for length, times in used.items():
                looked[length] = max(looked.get(length, 0), times)
    return sorted(((n, t) for n, t in used.items() if t), reverse=True), looked


def plan(counts: np.ndarray) -> list[tuple[Bin, int]]:
    """Bins and how often each is used, in the order in which they are made."""
    left = np.asarray(counts, np.int64).copy()
    out = []
    while left[1:].any():
        found, looked = best_bin(left)
        times = dict(found)
        # As long as all that was looked at is there, the next bin is the same.
        copies = min((int(left[n]) - looked[n]) // t + 1 for n, t in times.items())
        for n, t in times.items():
            left[n] -= copies * t
        out.append((found, copies))
    return out


class Slots:
    """Where the piece of a length and number goes: the bins of ``plan`` by length and number of the first piece."""

    def __init__(self, bins: list[tuple[Bin, int]]):
        rows, taken, sequence = [], {}, 0
        for found, copies in bins:
            offset = 0
            for length, times in found:
                first = taken.get(length, 0)
                rows.append(((length << RANK_BITS) + first, first, sequence, offset, times))
                taken[length] = first + copies * times
                offset += length * times
            sequence += copies
        if any(n >> RANK_BITS for n in taken.values()):
            raise ValueError("too many pieces of one length")
        self.sequences = sequence
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.key, self.first, self.sequence, self.offset, self.times = table.T.copy()

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece."""
        at = np.searchsorted(self.key, (length << RANK_BITS) + rank, side="right") - 1
        copy, turn = np.divmod(rank - self.first[at], self.times[at])
        return self.sequence[at] + copy, self.offset[at] + turn * length


@cache
def _memo(path: str) -> words.Memo:
    return words.Memo(words.chunk_encoder(path, flat=True))


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The tokens of every document and ``end_id``, cut after each ``capacity`` ids.

    One row per piece: id, piece (from 0), start (ids of the document before it), length, ids (binary, unsigned
    little-endian 32-bit integers). The tokenizer file lies on every node; it must match nothing across white space
    and give white space no ids. Strings of special tokens get their ids, but none are added. A NULL or empty text has
    just ``end_id``. Texts are encoded whole; repeated rows and NULL ids stay; further columns are ignored; an
    empty table gives no rows. No shuffle.
    """
    names = ["id", "piece", "start", "length", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(path)
        for batch in batches:
            for first, texts in words.blocks(batch.column("text")):
                ids, begin = memo.encoded(words.split(pc.replace_substring(texts, "\n", " ")))
                ids = np.insert(ids, begin[1:], end_id)
                begin = begin + np.arange(len(begin))
                count = -(-np.diff(begin) // capacity)
                doc = np.repeat(np.arange(len(texts)), count)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = number * capacity
                at = begin[doc] + start
                length = np.minimum(begin[doc + 1] - at, capacity)
                columns = [
                    batch.column("id").slice(first, len(texts)).take(pa.array(doc)),
                    pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    words.packed(ids, np.append(at, len(ids))).cast(pa.binary()),
                ]
                yield pa.record_batch(columns, names=names)

    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), "text")
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids binary")


def pack(rows: DataFrame, capacity: int = CAPACITY, length_col: str = "length", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add sequence_id (from 0, gapless) and offset (place in the sequence) to rows of 1 to ``capacity`` tokens.

    All rows are packed, in as few sequences as best-two-fit makes; equal rows are rows like any other; a length
    that is NULL or out of range is an error. All columns go along, so leave wide ones out and join them later.
    An empty table gives no rows. Lengths with many rows are numbered in several tasks, and only the
    histogram reaches the driver.
    """
    row, part, offset, rank = (unused(rows, name) for name in ("row", "part", "before", "rank"))
    table = settle(rows.withColumn(row, F.monotonically_increasing_id()))
    length = F.col(f"`{length_col}`")
    # At most one row for each length from 1 to the capacity.
    wrong = length.isNull() | ~length.between(1, capacity)
    counted = table.groupBy(F.when(wrong, 0).otherwise(length).cast("int").alias("length")).count().toPandas()
    counts = np.zeros(capacity + 1, np.int64)
    counts[counted["length"]] = counted["count"]
    if counts[0]:
        raise ValueError(f"{counts[0]} rows have no length between 1 and {capacity}")
    slots = Slots(plan(counts))
    parts = F.lit(np.maximum(1, -(-counts // rows_per_range)).tolist())
    table = table.withColumn(part, F.pmod(F.xxhash64(row), F.get(parts, length.cast("int"))).cast("long"))
    sizes = table.groupBy(length.alias(length_col), part).agg(F.count(F.lit(1)).alias(rank))
    before = Window.partitionBy(length_col).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(length_col, part, F.coalesce(F.sum(rank).over(before), F.lit(0)).alias(offset))
    inside = Window.partitionBy(length_col, part).orderBy(row)
    numbered = table.withColumn(rank, F.row_number().over(inside) - 1).join(sizes, [length_col, part])
    numbered = numbered.select(*rows.columns, (F.col(offset) + F.col(rank)).alias(rank))
    schema = rows.schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, place = slots.place(
                batch.column(length_col).to_numpy().astype(np.int64), batch.column(rank).to_numpy().astype(np.int64)
            )
            columns = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != rank]
            yield pa.record_batch([*columns, pa.array(sequence), pa.array(place)], names=schema.names)

    return numbered.mapInArrow(run, schema)
