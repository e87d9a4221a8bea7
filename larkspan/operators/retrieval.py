"""Search over chunks by text and over vectors, with the sources of the hits."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions import texts
from larkspan.session import settle

# BM25 parameters.
K1 = 1.2
B = 0.75
# Terms of the queries that one pass over the chunks knows; more are searched in several passes.
PASS_TERMS = 1_000_000
# Numbers of the query vectors that one pass over the vectors knows.
PASS_NUMBERS = 8_000_000
# Scores that a Python batch holds at once.
TILE_SCORES = 4_000_000
# Ranks use scores rounded to this many places, so that sums in another order rank alike.
TEXT_PLACES = 6
VECTOR_PLACES = 9


def chunk_table(documents: DataFrame, size: int = texts.CHUNK_TOKENS, overlap: int = texts.CHUNK_OVERLAP) -> DataFrame:
    """B34. Chunks of each document: doc_id, chunk_no and the chunk's tokens."""
    words = documents.select("doc_id", texts.tokens(F.col("text")).alias("words"))
    return words.select("doc_id", F.posexplode(texts.chunks(F.col("words"), size, overlap)).alias("chunk_no", "tokens"))


def query_terms(queries: DataFrame) -> DataFrame:
    """I1. Distinct terms of each query."""
    terms = F.array_distinct(texts.tokens(F.lower("text")))
    return queries.select("query_id", F.explode(terms).alias("term"))


def term_counts(chunks: DataFrame, number: dict[str, int]) -> DataFrame:
    """Length of each chunk, and the numbers and counts of its known terms."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = number.keys()
        for batch in batches:
            found = [Counter(filter(known.__contains__, map(str.lower, words))) for words in batch["tokens"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "chunk_no": batch["chunk_no"],
                    "length": [len(words) for words in batch["tokens"]],
                    "terms": [[number[t] for t in c] for c in found],
                    "tfs": [list(c.values()) for c in found],
                }
            )

    return chunks.mapInPandas(count, "doc_id long, chunk_no int, length int, terms array<int>, tfs array<int>")


def word_counts(chunks: DataFrame) -> DataFrame:
    """Length of each chunk, and all its words in lower case with their counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [Counter(map(str.lower, words)) for words in batch["tokens"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "chunk_no": batch["chunk_no"],
                    "length": [len(words) for words in batch["tokens"]],
                    "words": [list(c) for c in found],
                    "tfs": [list(c.values()) for c in found],
                }
            )

    return chunks.mapInPandas(count, "doc_id long, chunk_no int, length int, words array<string>, tfs array<int>")


def known_counts(counted: DataFrame, names: list[str]) -> DataFrame:
    """``term_counts`` of chunks whose ``word_counts`` are there: Arrow looks the words up, Python holds none of them."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names, pa.string())
        for batch in batches:
            words, tfs = batch.column("words"), batch.column("tfs")
            found = pc.index_in(words.flatten(), value_set=known)
            met = found.is_valid()
            ends = words.offsets.to_numpy().astype(np.int64)
            before = np.concatenate(([0], np.cumsum(met.to_numpy(zero_copy_only=False))))
            offsets = pa.array(before[ends - ends[0]], pa.int32())
            columns = [
                *(batch.column(name) for name in ("doc_id", "chunk_no", "length")),
                pa.ListArray.from_arrays(offsets, found.filter(met)),
                pa.ListArray.from_arrays(offsets, tfs.flatten().filter(met)),
            ]
            yield pa.record_batch(columns, names=["doc_id", "chunk_no", "length", "terms", "tfs"])

    return counted.mapInArrow(number, "doc_id long, chunk_no int, length int, terms array<int>, tfs array<int>")


def text_search(chunks: DataFrame, queries: DataFrame, k: int = 5, pass_terms: int = PASS_TERMS) -> DataFrame:
    """I1. The k best chunks per query by BM25.

    The texts are read once, for the counts of the queries' terms in each chunk. A chunk is scored where its
    counts are read, by one sparse product a batch, and only k rows for each query and batch move. Queries
    with more than ``pass_terms`` terms together are searched in several such passes over the counts of all words,
    which are written once.
    """
    terms = settle(query_terms(queries))
    blocks = max(1, -(-terms.count() // pass_terms))
    if blocks == 1:
        count = partial(_counts_of_terms, chunks)
    else:
        count = partial(known_counts, settle(word_counts(chunks)))
    hits = [_text_pass(count, terms.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block), k) for block in range(blocks)]
    return _top(reduce(DataFrame.unionByName, hits), k, [F.col("key").desc(), F.col("doc_id"), F.col("chunk_no")])


def _counts_of_terms(chunks: DataFrame, names: list[str]) -> DataFrame:
    return term_counts(chunks, {t: i for i, t in enumerate(names)})


def _text_pass(count: Callable[[list[str]], DataFrame], terms: DataFrame, k: int) -> DataFrame:
    known = terms.toPandas()
    names, term_of = np.unique(known["term"].to_numpy(dtype=str), return_inverse=True)
    query_ids, query_of = np.unique(known["query_id"].to_numpy(dtype=np.int64), return_inverse=True)
    counted = settle(count(names.tolist()))
    n, mean_length = counted.agg(F.count(F.lit(1)), F.coalesce(F.avg("length"), F.lit(1.0))).first()
    df = np.zeros(len(names))
    # At most one row a term of the pass.
    found = counted.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    df[found["term"].to_numpy()] = found["count"].to_numpy()
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    # The queries of each term, one after another.
    by_term = np.argsort(term_of, kind="stable")
    asking = query_of[by_term]
    first = np.searchsorted(term_of[by_term], np.arange(len(names) + 1))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = max(1, TILE_SCORES // max(len(query_ids), 1))
        for whole in batches:
            for at in range(0, len(whole), rows):
                yield scored(whole.iloc[at : at + rows])

    def scored(batch: pd.DataFrame) -> pd.DataFrame:
        sizes = batch["terms"].map(len).to_numpy()
        chunk = np.repeat(np.arange(len(batch)), sizes)
        term = np.concatenate([*batch["terms"], np.empty(0, np.int64)]).astype(np.int64)
        tf = np.concatenate([*batch["tfs"], np.empty(0, np.int64)])
        norm = K1 * (1 - B + B * batch["length"].to_numpy() / mean_length)
        value = idf[term] * tf * (K1 + 1) / (tf + norm[chunk])
        times = first[term + 1] - first[term]
        start = np.repeat(first[term] - np.cumsum(times) + times, times)
        query = asking[start + np.arange(len(start))]
        cell = query * len(batch) + np.repeat(chunk, times)
        size = len(query_ids) * len(batch)
        score = np.bincount(cell, np.repeat(value, times), minlength=size).reshape(len(query_ids), len(batch))
        met = np.bincount(cell, minlength=size).reshape(score.shape) > 0
        key = np.where(met, np.round(score, TEXT_PLACES), -np.inf)
        by_place = np.lexsort((batch["chunk_no"].to_numpy(), batch["doc_id"].to_numpy()))
        best = by_place[_highest(key[:, by_place], k)]
        line = np.repeat(np.arange(len(query_ids)), best.shape[1])
        best = best.ravel()
        line, best = line[met[line, best]], best[met[line, best]]
        return pd.DataFrame(
            {
                "query_id": query_ids[line],
                "doc_id": batch["doc_id"].to_numpy()[best],
                "chunk_no": batch["chunk_no"].to_numpy()[best],
                "score": score[line, best],
            }
        )

    hits = counted.mapInPandas(search, "query_id long, doc_id long, chunk_no int, score double")
    return hits.withColumn("key", F.round("score", TEXT_PLACES))


def _highest(keys: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest keys of each line, in order; ties to the left."""
    if keys.shape[1] > 4 * k:
        # All columns at or above the k-th key, so that ties at the edge are decided by their order.
        edge = np.partition(keys, -k, axis=1)[:, -k][:, None]
        above = keys >= edge
        width = int(above.sum(axis=1).max(initial=0))
        columns = np.argsort(~above, axis=1, kind="stable")[:, :width]
    else:
        columns = np.broadcast_to(np.arange(keys.shape[1]), keys.shape)
    order = np.argsort(-np.take_along_axis(keys, columns, axis=1), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(columns, order, axis=1)


def _top(hits: DataFrame, k: int, order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).drop("key")


def _unit(rows: list | np.ndarray) -> np.ndarray:
    matrix = np.stack([np.asarray(row, dtype="float64") for row in rows])
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _best(query_ids: np.ndarray, queries: np.ndarray, vec_ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """The k best vectors of one batch for each query: highest rounded cosine, then lowest id.

    Products are taken in tiles of bounded size: some vectors with some queries at a time.
    """
    by_id = np.argsort(vec_ids, kind="stable")
    vec_ids, vectors = vec_ids[by_id], vectors[by_id]
    columns = min(len(vec_ids), max(1, TILE_SCORES // 1_000)) or 1
    lines = max(1, TILE_SCORES // columns)
    for at in range(0, len(query_ids), lines):
        for start in range(0, len(vec_ids), columns):
            scores = queries[at : at + lines] @ vectors[start : start + columns].T
            order = _highest(np.round(scores, VECTOR_PLACES), k)
            yield pd.DataFrame(
                {
                    "query_id": np.repeat(query_ids[at : at + lines], order.shape[1]),
                    "vec_id": vec_ids[start + order].ravel(),
                    "score": np.take_along_axis(scores, order, axis=1).ravel(),
                }
            )


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 5, pass_numbers: int = PASS_NUMBERS) -> DataFrame:
    """I2. The k nearest vectors per query by cosine: (vec_id, vector) against (query_id, vector).

    The vectors stay where they are read: each task compares its batches with the queries by matrix products
    and gives at most k rows per query and tile. A query set of more than ``pass_numbers`` numbers is
    cut into blocks of about that size, each searched in a pass of its own, so that what is sent to the
    tasks is bounded.
    """
    queries = settle(queries.select("query_id", "vector"))
    numbers = queries.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()[0]
    blocks = max(1, -(-numbers // pass_numbers))
    hits = []
    for block in range(blocks):
        known = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toPandas()
        hits.append(_vector_pass(vectors, known["query_id"].to_numpy(), known["vector"].tolist(), k))
    found = reduce(DataFrame.unionByName, hits).withColumn("key", F.round("score", VECTOR_PLACES))
    return _top(found, k, [F.col("key").desc(), F.col("vec_id")])


def _vector_pass(vectors: DataFrame, ids: np.ndarray, values: list, k: int) -> DataFrame:
    matrix = _unit(values) if values else None

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) and matrix is not None:
                yield from _best(ids, matrix, batch["vec_id"].to_numpy(), _unit(batch["vector"].tolist()), k)

    return vectors.select("vec_id", "vector").mapInPandas(search, "query_id long, vec_id long, score double")


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """Mean vector per label, usable as a query set."""
    means = (
        vectors.select(by, F.posexplode("vector"))
        .groupBy(by, "pos")
        .agg(F.avg(F.col("col").cast("double")).alias("mean"))
    )
    # One row per dimension of a label: bounded by the width of the vectors.
    parts = F.sort_array(F.collect_list(F.struct("pos", "mean")))
    return means.groupBy(F.col(by).cast("long").alias("query_id")).agg(
        F.transform(parts, lambda p: p["mean"]).alias("vector")
    )


def cited(hits: DataFrame, documents: DataFrame, size: int = texts.CHUNK_TOKENS, overlap: int = texts.CHUNK_OVERLAP) -> DataFrame:
    """I3. Hits with their number, text and source document. Only documents with a hit are cut into chunks."""
    found = documents.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    return (
        hits.join(chunk_table(found, size, overlap), ["doc_id", "chunk_no"])
        .join(found.select("doc_id", "source", "lang"), "doc_id")
        .select(
            "query_id", F.col("rank").alias("citation"), "doc_id", "chunk_no", "source", "lang",
            F.array_join("tokens", " ").alias("fragment"),
        )
    )


def citation_sources(answers: DataFrame, kind: str = "filechunk") -> DataFrame:
    """D10. Sources of the wanted type in nested citations, numbered by citation from 1."""
    return (
        answers.select("answer_id", F.posexplode("citations").alias("pos", "citation"))
        .select("answer_id", (F.col("pos") + 1).alias("number"), F.explode("citation.sources").alias("source"))
        .where(F.col("source.type") == kind)
        .select("answer_id", "number", "source.*")
    )
