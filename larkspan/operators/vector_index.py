"""A stored vector index in cells, searched exactly.

Vectors lie, scaled to length one, in the cell of their nearest pivot, a folder each. A cell keeps the least
cosine of its vectors with the pivot. As angles add up, no vector of the cell is nearer to a query than the angle
to the pivot less the widest angle in the cell, so a search scores the nearest cells of each query and then only
those that can still hold one of its k best. Rows of other cells are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.operators.retrieval import VECTOR_PLACES
from larkspan.session import settle
from larkspan.sources import versions

# Vectors of a cell, on average, and pivots at most: they are sent to every task.
CELL_VECTORS = 2_000
MAX_PIVOTS = 4_096
SAMPLE_PER_PIVOT = 20
ROUNDS = 4
FIRST_CELLS = 2
# Queries that one pass over the cells knows, and scores that a task holds at once.
BLOCK_QUERIES = 2_000
TILE_SCORES = 4_000_000
# Cosines of floats of length one are right to this much.
SLACK = 1e-7

_CELL = "cell int, vec_id long, vector array<double>"


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.array(rows, np.float64) if rows else np.zeros((0, 0))


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def pivots_of(sample: np.ndarray, count: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit means of a sample's groups by nearest mean; the sample is bounded by the number of pivots."""
    rng = np.random.default_rng(seed)
    sample = _unit(sample)
    means = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(sample @ means.T, axis=1)
        sums = np.zeros_like(means)
        np.add.at(sums, nearest, sample)
        means = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), means)
    return means


def build(vectors: DataFrame, path: str, cell_vectors: int = CELL_VECTORS, max_pivots: int = MAX_PIVOTS) -> None:
    """I2. Store vectors (vec_id, vector of one width) in cells. Pivots come from a bounded sample, cells hold every row."""
    spark = vectors.sparkSession
    number, _ = versions.current(spark, path)
    rows = vectors.where("vector IS NOT NULL").select(F.col("vec_id").cast("long"), F.col("vector").cast("array<double>"))
    total = rows.count()
    count = max(1, min(max_pivots, -(-total // cell_vectors)))
    share = min(1.0, 2 * SAMPLE_PER_PIVOT * count / max(total, 1))
    # At most some forty rows a pivot.
    drawn = rows.where(F.abs(F.xxhash64("vec_id") % 1_000_003) < F.lit(math.ceil(share * 1_000_003))).limit(4 * SAMPLE_PER_PIVOT * count)
    sample = _matrix(drawn.select("vector").toArrow().column(0).combine_chunks()) if total else np.zeros((0, 0))
    pivots = pivots_of(sample, count) if len(sample) else np.zeros((1, sample.shape[1] if sample.ndim > 1 else 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column("vector")))
            cell = np.argmax(unit @ pivots.T, axis=1) if len(unit) and pivots.size else np.zeros(len(unit), np.int64)
            cosine = (unit * pivots[cell]).sum(axis=1) if pivots.size else np.zeros(len(unit))
            flat = pa.array(unit.ravel())
            ends = pa.array(np.arange(len(unit) + 1) * unit.shape[1], pa.int32())
            columns = [pa.array(cell, pa.int32()), batch.column("vec_id"), pa.ListArray.from_arrays(ends, flat), pa.array(cosine)]
            yield pa.record_batch(columns, names=["cell", "vec_id", "vector", "cosine"])

    folder = versions.fresh(path, "cells")
    dealt = rows.mapInArrow(assign, f"{_CELL}, cosine double")
    # A crowded cell is dealt over several files by the ids of its vectors.
    dealt = dealt.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(8)))
    dealt.write.partitionBy("cell").parquet(folder)
    stored = spark.read.schema(f"{_CELL}, cosine double").parquet(folder)
    cells = versions.fresh(path, "bounds")
    table = {i: p.tolist() for i, p in enumerate(pivots)}
    # One row per cell.
    bounds = stored.groupBy("cell").agg(F.min("cosine").alias("least"), F.count(F.lit(1)).alias("vectors"))
    listed = spark.createDataFrame(list(table.items()), "cell int, pivot array<double>")
    bounds.join(listed, "cell").write.parquet(cells)
    versions.publish(spark, path, {"rows": folder, "cells": cells}, number)


def cell_bounds(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """For each query and cell the highest cosine that a vector of the cell can have: query_id, cell, bound; written."""
    content = versions.current(spark, path)[1]
    # At most MAX_PIVOTS rows.
    cells = spark.read.parquet(content["cells"]).orderBy("cell").toArrow()
    pivots = _matrix(cells.column("pivot").combine_chunks())
    if not len(pivots):
        return spark.createDataFrame([], "query_id long, cell int, bound double")
    widest = np.arccos(np.clip(cells.column("least").to_numpy(), -1, 1))
    number = cells.column("cell").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                unit = _unit(_matrix(part.column("vector")))
                angle = np.arccos(np.clip(unit @ pivots.T, -1, 1))
                bound = np.cos(np.maximum(angle - widest, 0)) + SLACK
                # A query of zeros has cosine zero with everything.
                bound[~unit.any(axis=1)] = SLACK
                ids = np.repeat(part.column("query_id").to_numpy(), len(number))
                yield pa.record_batch([pa.array(ids), pa.array(np.tile(number, len(part)), pa.int32()), pa.array(bound.ravel())], names=["query_id", "cell", "bound"])

    rows = queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>"))
    return settle(rows.mapInArrow(run, "query_id long, cell int, bound double"))


def _scored(spark: SparkSession, path: str, pairs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best vectors of each query in each batch of its cells (pairs of query_id and cell).

    The vectors are scored where they are read, and of other cells none is. Queries go to the tasks in blocks of a
    bounded number, one pass each.
    """
    folder = versions.current(spark, path)[1]["rows"]
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    out = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block
        asked = queries.where(mine).join(pairs.select("query_id").distinct(), "query_id", "left_semi").orderBy("query_id").toArrow()
        if not asked.num_rows:
            continue
        ids = asked.column("query_id").to_numpy()
        wanted = pairs.where(mine).select("query_id", "cell").toArrow()
        line = np.searchsorted(ids, wanted.column("query_id").to_numpy())
        cells, first = np.unique(wanted.column("cell").to_numpy(), return_inverse=True)
        by_cell = {int(c): line[first == i] for i, c in enumerate(cells)}
        search_batches = _pass(ids, _unit(_matrix(asked.column("vector").combine_chunks())), by_cell, k)
        stored = spark.read.schema(_CELL).parquet(folder).where(F.col("cell").isin(list(by_cell)))
        hits = stored.select("cell", "vec_id", "vector").mapInArrow(search_batches, out.schema)
        out = hits if block == 0 else out.unionByName(hits)
    return out


def _pass(ids: np.ndarray, wanted: np.ndarray, by_cell: dict[int, np.ndarray], k: int):
    """Scores the vectors of a batch, cell by cell, with the queries (ids, unit rows) that ask for the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, vec_ids = batch.column("cell").to_numpy(), batch.column("vec_id").to_numpy()
            unit = _matrix(batch.column("vector")) if len(batch) else np.zeros((0, wanted.shape[1]))
            for c in np.unique(cell).tolist():
                rows = np.flatnonzero(cell == c)
                rows = rows[np.argsort(vec_ids[rows], kind="stable")]
                lines = by_cell[c]
                tile = max(1, TILE_SCORES // len(rows))
                for at in range(0, len(lines), tile):
                    some = lines[at : at + tile]
                    scores = wanted[some] @ unit[rows].T
                    best = np.argsort(-np.round(scores, VECTOR_PLACES), axis=1, kind="stable")[:, :k]
                    columns = [
                        pa.array(np.repeat(ids[some], best.shape[1])),
                        pa.array(vec_ids[rows[best.ravel()]]),
                        pa.array(np.take_along_axis(scores, best, axis=1).ravel()),
                    ]
                    yield pa.record_batch(columns, names=["query_id", "vec_id", "score"])

    return run


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = [F.round("score", VECTOR_PLACES).desc(), F.col("vec_id")]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def open_cells(bounds: DataFrame, done: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The cells whose bound reaches the k-th score of their query so far; all, if it has fewer hits."""
    edge = hits.where(F.col("rank") == k).select("query_id", F.col("score").alias("edge"))
    rest = bounds.join(done.select("query_id", "cell"), ["query_id", "cell"], "left_anti").join(edge, "query_id", "left")
    return rest.where(F.col("edge").isNull() | (F.col("bound") >= F.col("edge"))).select("query_id", "cell")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, first: int = FIRST_CELLS) -> DataFrame:
    """I2. The k nearest vectors of each query (query_id, vector) by cosine: query_id, vec_id, score, rank."""
    queries = settle(queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>")))
    bounds = cell_bounds(spark, path, queries)
    if bounds.isEmpty():
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "cell"))
    done = settle(bounds.withColumn("_rank", rank).where(F.col("_rank") <= first).select("query_id", "cell"))
    hits = settle(_ranked(_scored(spark, path, done, queries, k), k))
    rest = settle(open_cells(bounds, done, hits, k))
    if rest.isEmpty():
        return hits
    return _ranked(hits.drop("rank").unionByName(_scored(spark, path, rest, queries, k)), k)
