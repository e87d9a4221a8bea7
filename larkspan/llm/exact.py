"""Exact dedup by content sort.

Normalised bytes are dealt to ranges by sampled splitters, sorted externally inside each range, and every
row is compared in full with the group before it. A range is keyed by the leading bytes and the digest of
the content and then by the order of preference, so a group of copies of any size is cut into ranges like
any other stretch of the order; the groups at range ends, two a range at most, are joined up afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import pick, row_key, shuffle_width
from larkspan.session import settle

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
HEAD_BYTES = 16
ROWS_OUT = 20_000

_NORMAL = "id long, row_key long, chars long, head binary, digest binary, content binary"
_PLACED = "id long, row_key long, keep_id long, copies long, leads boolean, digest binary, part int, edge boolean"


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        content = [t.encode().translate(None, WHITE) for t in texts]
        yield pa.record_batch(
            [
                batch.column("id"),
                batch.column("row_key"),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([c[:HEAD_BYTES] for c in content], pa.binary()),
                pa.array([hashlib.sha256(c).digest() for c in content], pa.binary()),
                pa.array(content, pa.binary()),
            ],
            names=["id", "row_key", "chars", "head", "digest", "content"],
        )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Group equal neighbours of one sorted range. Only ids of the current group are held, its text once."""
    part = TaskContext.get().partitionId()
    done: list[tuple] = []
    group: list = []
    held: tuple[bytes, bytes] | None = None
    first = True

    def close(edge: bool) -> None:
        digest = held[1]
        done.extend((*row, group[0][0], len(group), i == 0, digest, part, edge) for i, row in enumerate(group))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        done.clear()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.bool_()]
        names = ["id", "row_key", "keep_id", "copies", "leads", "digest", "part", "edge"]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("id", "row_key", "digest", "content"))
        for *row, digest, content in zip(*columns, strict=True):
            if held is not None and content == held[0]:
                group.append(row)
                continue
            if held is not None:
                close(first)
                first = False
            held, group = (content, digest), [row]
        if len(done) >= ROWS_OUT:
            yield flush()
    if held is not None:
        close(True)
    if done:
        yield flush()


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, row_key, keep_id, group_size, kept, digest (SHA-256 of the normalised text).

    Texts are equal when they are identical without the characters of ``[\\x20\\x09-\\x0D]``; a NULL text is
    an empty one, and empty texts are equal to each other. The row with the most code points in its own
    text stays, then the one with the smallest id; a NULL id comes after all others. Of rows that agree in
    id and text one stays. Further columns are ignored, an empty table gives no rows.
    """
    rows = pick(docs, id=id_col, text=text_col).select(
        F.col("id").cast("long"), row_key(F.col("id"), F.col("text")).alias("row_key"), "text"
    )
    order = ["head", "digest", F.desc("chars"), F.asc_nulls_last("id")]
    exact = ["head", "digest", "content", F.desc("chars"), F.asc_nulls_last("id")]
    placed = settle(
        rows.mapInArrow(_normalise, _NORMAL)
        .repartitionByRange(shuffle_width(docs), *order)
        .sortWithinPartitions(*exact)
        .mapInArrow(_neighbours, _PLACED)
    )
    # At most two groups a range: those that may go on in the range before or after.
    edges = placed.where("edge").groupBy("digest", "part").agg(
        F.count(F.lit(1)).alias("copies"), F.first("keep_id").alias("keep_id")
    )
    ends = edges.groupBy("digest").agg(
        F.sum("copies").alias("all_copies"), F.min_by("keep_id", "part").alias("all_keep"), F.min("part").alias("from")
    )
    joined = placed.join(F.broadcast(ends.where("all_copies > 0")), "digest", "left")
    across = F.col("edge") & F.col("from").isNotNull()
    return joined.select(
        "id",
        "row_key",
        F.when(across, F.col("all_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(across, F.col("all_copies")).otherwise(F.col("copies")).alias("group_size"),
        (F.col("leads") & (~across | (F.col("part") == F.col("from")))).alias("kept"),
        "digest",
    )
