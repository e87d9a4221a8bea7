"""Exact top-k by inner product as a Voronoi join.

Vectors and queries are assigned to the nearest of a few pivots. Counts, radii and the closest members of each
cell give every query cell a score that its queries reach for certain; a vector goes only to the query cells
in which it might reach that score, and each cell is solved where its queries and vectors meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.common import pick
from larkspan.session import settle

SCALE = 1024
PIVOTS = 16
QUERIES_PER_BLOCK = 4_000
VECTORS_PER_TASK = 20_000
TILE = 2_000
LONG = (1 << 63) - 1

_ASSIGNED = "vec_id long, vector binary, cell int, radius double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Packed vectors of one length as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _assigned(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Vectors as whole numbers, padded with zeros to one length, with the nearest pivot and its distance."""
    dim = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            rows = np.zeros((len(batch), dim))
            lists = batch.column("embedding")
            sizes = np.diff(lists.offsets.to_numpy())
            inside = np.arange(dim) < sizes[:, None]
            rows[inside] = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False))
            away = np.stack([np.sqrt(((rows - p) ** 2).sum(axis=1)) for p in pivots], axis=1)
            cell = away.argmin(axis=1)
            yield pa.record_batch(
                [batch.column("vec_id"), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(cell, pa.int32()), pa.array(away[np.arange(len(rows)), cell])],
                names=["vec_id", "vector", "cell", "radius"],
            )

    return vectors.mapInArrow(run, _ASSIGNED)


@dataclass
class Bounds:
    """Of each query cell: blocks of its queries, their largest distance from the pivot, the sure score, tasks."""

    pivots: np.ndarray
    blocks: np.ndarray
    reach: np.ndarray
    sure: np.ndarray
    needs: np.ndarray  # query cell by data cell
    tasks: np.ndarray


def _bounds(pivots: np.ndarray, cells: list, closest: list, queries: list, k: int, per_task: int, per_block: int) -> Bounds:
    """``cells``: (cell, members, radius); ``closest``: (cell, vec_id, radius); ``queries``: (cell, count, radius)."""
    n = len(pivots)
    norm = np.linalg.norm(pivots, axis=1)
    inner = pivots @ pivots.T
    members, widest = np.zeros(n), np.zeros(n)
    for cell, count, radius in cells:
        members[cell], widest[cell] = count, radius
    blocks, reach = np.zeros(n, np.int64), np.zeros(n)
    for cell, count, radius in queries:
        blocks[cell], reach[cell] = -(-count // per_block), radius
    sure, needs = np.full(n, -np.inf), np.zeros((n, n), bool)
    for i in np.flatnonzero(blocks):
        # <q, x> = <p, x'> + <p, x - x'> + <q - p, x>, x' being the pivot of x.
        slack = 1e-9 * (1 + (norm[i] + reach[i]) * (norm.max() + widest.max()))
        best: dict[int, float] = {}
        for cell, vec_id, radius in closest:
            least = inner[i, cell] - norm[i] * radius - reach[i] * (norm[cell] + radius) - slack
            best[vec_id] = max(best.get(vec_id, -np.inf), least)
        if len(best) > k:  # one of them may be the query itself
            sure[i] = sorted(best.values(), reverse=True)[k]
        most = inner[i] + norm[i] * widest + reach[i] * (norm + widest) + slack
        needs[i] = (members > 0) & (most >= sure[i])
    tasks = np.maximum(1, np.ceil(needs @ members / per_task)).astype(np.int64)
    return Bounds(pivots, blocks, reach, sure, needs, tasks)


def _needed(assigned: DataFrame, bounds: Bounds) -> DataFrame:
    """Each vector once for every block of queries that it may serve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            rows, cell = _matrix(batch.column("vector")), batch.column("cell").to_numpy()
            ids = batch.column("vec_id").to_numpy()
            norm = np.linalg.norm(rows, axis=1)
            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            for i in np.flatnonzero(bounds.blocks):
                most = rows @ bounds.pivots[i] + bounds.reach[i] * norm
                slack = 1e-9 * (1 + (np.linalg.norm(bounds.pivots[i]) + bounds.reach[i]) * norm)
                keep = np.flatnonzero(bounds.needs[i][cell] & (most + slack >= bounds.sure[i]))
                if not len(keep):
                    continue
                some = batch.take(pa.array(keep))
                task = pa.array((spread[keep] % np.uint64(bounds.tasks[i])).astype(np.int32))
                for block in range(bounds.blocks[i]):
                    place = [pa.array(np.full(len(keep), v, np.int32)) for v in (i, block)]
                    yield pa.record_batch([*place, task, some.column("vec_id"), some.column("vector")], names=["cell", "block", "task", "vec_id", "vector"])

    return assigned.mapInArrow(run, "cell int, block int, task int, vec_id long, vector binary")


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as longs: by floating point where that is exact, else by Python integers."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(queries.shape[1], 1)
    if most < 1 << 53:
        return (queries @ rows.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in line] for line in m.tolist()], object).reshape(m.shape)
    exact = (whole(queries) @ whole(rows).T).tolist()
    clipped = [[max(-LONG - 1, min(LONG, v)) for v in line] for line in exact]
    return np.array(clipped, np.int64).reshape(len(queries), len(rows))


def solve(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(line of the query, vec_id, score) of its k best; rows with the query's own id are left out."""
    out = []
    for first in range(0, len(queries), TILE):
        some, own = queries[first : first + TILE], query_ids[first : first + TILE]
        score = np.empty((len(some), 0), np.int64)
        held = np.empty((len(some), 0), np.int64)
        valid = np.empty((len(some), 0), bool)
        for at in range(0, len(rows), TILE):
            part = products(some, rows[at : at + TILE])
            here = np.broadcast_to(ids[at : at + TILE], part.shape)
            other = here != own[:, None]
            score = np.concatenate([score, part], axis=1)
            held, valid = np.concatenate([held, here], axis=1), np.concatenate([valid, other], axis=1)
            # Valid ones first, then by score and id.
            if score.shape[1] > k:
                near = np.where(valid, score, -LONG - 1)
                cut = np.partition(near, -k, axis=1)[:, -k][:, None]
                keep = valid & (near >= cut)
                width = max(int(keep.sum(axis=1).max()), 1)
                order = np.argsort(~keep, axis=1, kind="stable")[:, :width]
                score, held, valid = (np.take_along_axis(m, order, 1) for m in (score, held, keep))
                order = np.lexsort((held, -score, ~valid), axis=1)[:, :k]
                score, held, valid = (np.take_along_axis(m, order, 1) for m in (score, held, valid))
        order = np.lexsort((held, -score, ~valid), axis=1)[:, :k]
        score, held, valid = (np.take_along_axis(m, order, 1) for m in (score, held, valid))
        line, column = np.nonzero(valid)
        out += zip((line + first).tolist(), held[line, column].tolist(), score[line, column].tolist(), strict=True)
    return out


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    pivots: int = PIVOTS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    vectors_per_task: int = VECTORS_PER_TASK,
    queries_per_block: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each row for which ``is_query`` holds.

    ``is_query`` is a condition on ``vec_id``. Components become floor(1024 * x) of x as double. Rows with a NULL
    id, a NULL vector, or one with NULL or non-finite components take no part. Shorter vectors are padded with
    zeros, an empty one scores 0. Rows with the query's own id are no candidates; ties go to the smaller id. A
    query row repeated exactly counts once, other rows of one id are told apart by ``query_row``; a repeated
    candidate takes a place for each row. Fewer candidates than ``k`` give fewer rows, an empty table none.
    ``pivots``, the bounded sample, changes the work and not the result. Scores beyond 64 bits are clipped.
    """
    kept = pick(vectors, vec_id=id_col, embedding=vector_col).select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")
    )
    finite = lambda x: x.isNotNull() & (F.abs(x) <= 1.7e305)  # noqa: E731  NaN is larger than any number
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite))
    schema = "query_id long, rank int, vec_id long, score long, query_row long"
    spark = vectors.sparkSession
    sample = kept.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(pivots).collect()
    if not sample:
        return spark.createDataFrame([], schema)
    dim = kept.agg(F.max(F.size("embedding"))).first()[0]
    points = np.zeros((len(sample), max(dim, 1)))
    for i, row in enumerate(sample):
        points[i, : len(row["embedding"])] = np.floor(SCALE * np.array(row["embedding"], np.float64))
    points = np.unique(points, axis=0)
    assigned = settle(_assigned(kept, points))
    cells = assigned.groupBy("cell").agg(F.count(F.lit(1)), F.max("radius")).collect()
    by_radius = Window.partitionBy("cell").orderBy("radius", "vec_id")
    members = assigned.groupBy("cell", "vec_id").agg(F.min("radius").alias("radius"))
    closest = members.withColumn("n", F.row_number().over(by_radius)).where(F.col("n") <= k + 1)
    closest = closest.select("cell", "vec_id", "radius").collect()
    queries = assigned.where(is_query).select("vec_id", "vector", "cell", "radius").distinct()
    counted = queries.groupBy("cell").agg(F.count(F.lit(1)), F.max("radius")).collect()
    bounds = _bounds(points, cells, closest, counted, k, vectors_per_task, queries_per_block)
    sizes = spark.createDataFrame(
        [(i, int(b), int(t)) for i, (b, t) in enumerate(zip(bounds.blocks, bounds.tasks, strict=True)) if b], "cell int, blocks int, tasks int"
    )  # one row a pivot
    asked = queries.join(F.broadcast(sizes), "cell").select(
        "cell",
        F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"),
        "vec_id",
        "vector",
        F.xxhash64("vec_id", "vector").alias("query_row"),
    )

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            ids, rows = left.column("vec_id").to_numpy(), left.column("query_row").to_pylist()
            best = solve(ids, _matrix(left.column("vector")), right.column("vec_id").to_numpy(), _matrix(right.column("vector")), k)
            found = [(int(ids[line]), rows[line], vec_id, score) for line, vec_id, score in best]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "query_row", "vec_id", "score"), columns, strict=True)})

    place = ["cell", "block", "task"]
    solved = asked.groupBy(*place).cogroup(_needed(assigned, bounds).groupBy(*place))
    solved = solved.applyInArrow(meet, "query_id long, query_row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = solved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score", "query_row")
