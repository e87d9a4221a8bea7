"""A stored inverted index of chunks, searched block by block.

A segment holds the chunks of one build in blocks. Of every term and block there is one posting: the chunks as
steps from one to the next, their counts, and the most that the term can add to a score in that block, as its
highest count and the least length of a chunk with it. Postings lie in parts by the hash of the term, so a search
reads the parts of its terms only, and a frequent term is cut by blocks.

A search reads the postings of its terms once, writes these few and adds up the bounds. The blocks with the best bounds of each query
are scored; then only blocks whose bound reaches the query's k-th score so far. Scores are those of
``retrieval.text_search`` over all segments together.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.functions import texts
from larkspan.operators.retrieval import B, K1, TEXT_PLACES, TILE_SCORES, _highest, query_terms
from larkspan.session import settle
from larkspan.sources import versions

PARTS = 64
BLOCK_CHUNKS = 1_024
# Text of the documents that a task cuts into chunks at once, unless one document has more.
SLICE_BYTES = 32 << 20
# Blocks of each query that are scored before the others are held against the k-th score.
FIRST_BLOCKS = 2
# Part of the rows that describe blocks.
_DIRECTORY = -1

_ROW = (
    "block long, term string, chunks int, max_tf int, min_length int, steps binary, tfs binary, "
    "doc_ids binary, chunk_nos binary, lengths binary"
)
_STORED = f"{_ROW}, part int"


def _cells(values: np.ndarray, ends: np.ndarray, kind: str) -> pa.Array:
    """values[ends[i] : ends[i + 1]] of every i as one binary value."""
    data = np.ascontiguousarray(values, kind)
    offsets = (ends * data.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


class _Chunks(NamedTuple):
    """Chunks of some documents: ``length`` words from place ``first`` on of all their words, which are numbers of ``terms``."""

    words: np.ndarray
    terms: pa.Array
    doc_id: np.ndarray
    chunk_no: np.ndarray
    first: np.ndarray
    length: np.ndarray


def _lower(words: pa.Array) -> pa.Array:
    """As Python lower-cases; only words with letters beyond ASCII go through it."""
    odd = pc.invert(pc.string_is_ascii(words))
    changed = pa.array([w.lower() for w in words.filter(odd).to_pylist()], words.type)
    return pc.replace_with_mask(pc.ascii_lower(words), odd, changed)


def _cut(documents: pa.RecordBatch, size: int, overlap: int) -> _Chunks:
    """The chunks of ``retrieval.chunk_table``; a word that lies in two of them is looked at once."""
    # Arrow's white space of ASCII is that of ``texts.tokens``.
    trimmed = pc.ascii_trim_whitespace(documents.column("text"))
    filled = pc.fill_null(pc.greater(pc.binary_length(trimmed), 0), False)
    split = pc.ascii_split_whitespace(trimmed.filter(filled))
    ends = split.offsets.to_numpy().astype(np.int64)
    ends -= ends[0]
    coded = split.flatten().dictionary_encode()
    # Each different word is lower-cased once; spellings that become equal get one number.
    named = _lower(coded.dictionary).dictionary_encode()
    number = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    step = size - overlap
    count = np.maximum(np.diff(ends) - overlap - 1, 0) // step + 1
    document = np.repeat(np.arange(len(count)), count)
    chunk_no = np.arange(len(document)) - np.repeat(np.cumsum(count) - count, count)
    first = ends[document] + chunk_no * step
    return _Chunks(
        number[coded.indices.to_numpy(zero_copy_only=False)],
        named.dictionary,
        documents.column("doc_id").filter(filled).to_numpy()[document],
        chunk_no,
        first,
        np.minimum(ends[document + 1] - first, size),
    )


def _block(rows: _Chunks, start: int, end: int, block: int) -> pa.RecordBatch:
    """The postings of the block of these chunks and the row that describes it."""
    lengths = rows.length[start:end]
    before = np.cumsum(lengths) - lengths
    word = rows.words[np.repeat(rows.first[start:end] - before, lengths) + np.arange(int(lengths.sum()))]
    chunk = np.repeat(np.arange(len(lengths)), lengths)
    key, tf = np.unique(word * BLOCK_CHUNKS + chunk, return_counts=True)
    term, place = np.divmod(key, BLOCK_CHUNKS)
    first = np.flatnonzero(np.diff(term, prepend=-1))
    bounds = np.append(first, len(term))
    steps = np.diff(place, prepend=0)
    steps[first] = place[first]
    n = len(first)
    whole = np.array([0, len(lengths)])
    columns = {
        "block": pa.array(np.full(n + 1, block)),
        "term": pa.concat_arrays([rows.terms.take(pa.array(term[first])), pa.nulls(1, pa.string())]),
        "chunks": pa.array(np.append(np.diff(bounds), len(lengths)), pa.int32()),
        "max_tf": pa.array(np.append(np.maximum.reduceat(tf, first), 0), pa.int32()),
        "min_length": pa.array(np.append(np.minimum.reduceat(lengths[place], first), 0), pa.int32()),
        "steps": pa.concat_arrays([_cells(steps, bounds, "<u2"), pa.nulls(1, pa.binary())]),
        "tfs": pa.concat_arrays([_cells(tf, bounds, "<u4"), pa.nulls(1, pa.binary())]),
        "doc_ids": pa.concat_arrays([pa.nulls(n, pa.binary()), _cells(rows.doc_id[start:end], whole, "<i8")]),
        "chunk_nos": pa.concat_arrays([pa.nulls(n, pa.binary()), _cells(rows.chunk_no[start:end], whole, "<i4")]),
        "lengths": pa.concat_arrays([pa.nulls(n, pa.binary()), _cells(lengths, whole, "<i4")]),
    }
    return pa.record_batch(list(columns.values()), names=list(columns))


def _slices(documents: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of whole documents of some ``SLICE_BYTES`` of text."""
    size = pc.fill_null(pc.binary_length(documents.column("text")), 0).to_numpy().astype(np.int64)
    starts = np.flatnonzero(np.diff((np.cumsum(size) - size) // SLICE_BYTES, prepend=-1))
    for start, end in pairwise([*starts.tolist(), len(size)]):
        yield documents.slice(start, end - start)


def _postings(documents: DataFrame, size: int, overlap: int, block_chunks: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for documents in _slices(batch):
                rows = _cut(documents, size, overlap)
                for start in range(0, len(rows.length), block_chunks):
                    yield _block(rows, start, min(start + block_chunks, len(rows.length)), block)
                    block += 1

    return documents.select("doc_id", "text").mapInArrow(run, _ROW)


def add_documents(
    documents: DataFrame,
    path: str,
    size: int = texts.CHUNK_TOKENS,
    overlap: int = texts.CHUNK_OVERLAP,
    parts: int = PARTS,
    block_chunks: int = BLOCK_CHUNKS,
) -> None:
    """I1. Index documents (doc_id, text) as a new segment; the first call makes the index.

    Documents without a token have no chunk. The sizes of chunks and the parts are those of the first call.
    """
    if block_chunks > BLOCK_CHUNKS:
        raise ValueError(f"a block holds at most {BLOCK_CHUNKS} chunks")
    spark = documents.sparkSession
    number, content = versions.current(spark, path)
    content = content or {"size": size, "overlap": overlap, "parts": parts, "segments": []}
    rows = _postings(documents, content["size"], content["overlap"], block_chunks)
    part = F.when(F.col("term").isNull(), F.lit(_DIRECTORY)).otherwise(_part(content["parts"]))
    folder = versions.fresh(path, "segment")
    dealt = rows.withColumn("part", part).repartition("part").sortWithinPartitions("part")
    dealt.write.partitionBy("part").parquet(folder)
    blocks = spark.read.schema(_STORED).parquet(folder).where(F.col("part") == _DIRECTORY)
    sizes = blocks.select("lengths").mapInArrow(_sizes, "chunks long, tokens long")
    chunks, tokens = sizes.agg(F.coalesce(F.sum("chunks"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    segment = {"folder": folder, "chunks": chunks, "tokens": tokens}
    versions.publish(spark, path, content | {"segments": [*content["segments"], segment]}, number)


def _part(parts: int):
    return F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks and tokens of each block."""
    for batch in batches:
        lengths = [np.frombuffer(b, "<i4") for b in batch.column("lengths").to_pylist()]
        columns = [pa.array([len(x) for x in lengths], pa.int64()), pa.array([int(x.sum()) for x in lengths], pa.int64())]
        yield pa.record_batch(columns, names=["chunks", "tokens"])


class Search:
    """A set of queries (query_id, text) on a stored index."""

    def __init__(self, spark: SparkSession, path: str, queries: DataFrame):
        content = versions.current(spark, path)[1]
        self.segments = content.get("segments", [])
        self.spark = spark
        self.chunks = sum(s["chunks"] for s in self.segments)
        self.mean_length = sum(s["tokens"] for s in self.segments) / self.chunks if self.chunks else 1.0
        terms = settle(query_terms(queries).withColumn("part", _part(content.get("parts", PARTS))))
        # At most one row per part.
        self.parts = sorted(r[0] for r in terms.select("part").distinct().collect())
        self.terms = terms.drop("part")

    def stored(self, parts: list[int]) -> DataFrame:
        """Rows of these parts of all segments; no other part's files are read."""
        out = self.spark.createDataFrame([], f"{_STORED}, segment int")
        for number, segment in enumerate(self.segments):
            rows = self.spark.read.schema(_STORED).parquet(segment["folder"]).where(F.col("part").isin(parts))
            out = out.unionByName(rows.withColumn("segment", F.lit(number))) if number else rows.withColumn("segment", F.lit(number))
        return out

    def asked(self) -> DataFrame:
        """The postings of the queries' terms, with the terms' weight. They are read once and written, with their content."""
        fields = ["term", "segment", "block", "chunks", "max_tf", "min_length", "steps", "tfs"]
        postings = self.stored(self.parts).select(*fields)
        self.postings = settle(postings.join(self.terms.select("term").distinct(), "term", "left_semi"))
        wanted = self.postings.drop("steps", "tfs")
        df = wanted.groupBy("term").agg(F.sum("chunks").alias("df"))
        idf = F.log1p((self.chunks - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return wanted.join(df.select("term", idf.alias("idf")), "term")

    def bounds(self) -> DataFrame:
        """The most that any chunk of a block can score, for each query and block with one of its terms; written."""
        weighted = settle(self.asked())
        self.weights = settle(weighted.select("term", "idf").distinct())
        norm = K1 * (1 - B + B * F.col("min_length") / F.lit(self.mean_length))
        most = F.col("idf") * F.col("max_tf") * (K1 + 1) / (F.col("max_tf") + norm)
        bound = weighted.select("term", "segment", "block", most.alias("most")).join(self.terms, "term")
        return settle(bound.groupBy("query_id", "segment", "block").agg(F.sum("most").alias("bound")))

    def scores(self, pairs: DataFrame, k: int) -> DataFrame:
        """The k best chunks of each query in each of the blocks (query_id, segment, block); ``bounds`` comes before."""
        asking = pairs.join(self.terms, "query_id").join(self.weights, "term")
        terms = asking.select("term", "segment", "block").distinct()
        postings = self.postings.join(terms, ["term", "segment", "block"], "left_semi").join(self.weights, "term")
        blocks = self.stored([_DIRECTORY]).join(pairs.select("segment", "block").distinct(), ["segment", "block"], "left_semi")
        fields = ["segment", "block", "kind", "query_id", "term", "idf", "steps", "tfs", "doc_ids", "chunk_nos", "lengths"]
        rows = (
            blocks.withColumn("kind", F.lit(0))
            .unionByName(postings.withColumn("kind", F.lit(1)), True)
            .unionByName(asking.drop("idf").withColumn("kind", F.lit(2)), True)
            .select(*fields)
        )
        dealt = rows.repartition("segment", "block").sortWithinPartitions("segment", "block", "kind", "query_id")
        mean_length = self.mean_length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = _Block(mean_length, k)
            for batch in batches:
                # Stretches of one block and kind.
                keys = [batch.column(f).to_numpy() for f in ("segment", "block", "kind")]
                starts = np.flatnonzero(np.any([np.diff(key, prepend=key[:1] - 1) != 0 for key in keys], axis=0))
                for start, end in pairwise([*starts.tolist(), len(batch)]):
                    key = (int(keys[0][start]), int(keys[1][start]))
                    if key != state.key:
                        yield from state.finish()
                        state.key = key
                    yield from state.take(int(keys[2][start]), batch.slice(start, end - start))
            yield from state.finish()

        return dealt.mapInArrow(run, "query_id long, doc_id long, chunk_no int, score double")


def _joined(cells: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all binary values one after another, and how many each has."""
    size = pc.binary_length(cells).to_numpy().astype(np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(cells.to_pylist()), kind), size


class _Block:
    """Scores of one block after another; rows come by block, kind and query.

    What is held is the block's postings of the terms asked for, and the terms of some thousand rows of queries.
    """

    def __init__(self, mean_length: float, k: int):
        self.mean_length, self.k, self.key = mean_length, k, None
        self._clear()

    def _clear(self) -> None:
        self.stored: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        self.terms: pa.Array | None = None
        self.query = self.term = np.empty(0, np.int64)

    def take(self, kind: int, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if kind == 0:
            doc_ids, chunk_nos, lengths = (rows.column(c)[0].as_py() for c in ("doc_ids", "chunk_nos", "lengths"))
            self.doc_ids, self.chunk_nos = np.frombuffer(doc_ids, "<i8"), np.frombuffer(chunk_nos, "<i4")
            self.norm = K1 * (1 - B + B * np.frombuffer(lengths, "<i4") / self.mean_length)
            self.by_place = np.lexsort((self.chunk_nos, self.doc_ids))
        elif kind == 1:
            steps, size = _joined(rows.column("steps"), "<u2")
            tf = _joined(rows.column("tfs"), "<u4")[0].astype(np.float64)
            # Steps add up to places within each posting.
            total = np.cumsum(steps.astype(np.int64))
            before = np.concatenate(([0], total))[np.cumsum(size) - size]
            place = total - np.repeat(before, size)
            idf = np.repeat(rows.column("idf").to_numpy(), size)
            self.stored.append((rows.column("term"), size, place, idf * tf * (K1 + 1) / (tf + self.norm[place])))
        else:
            if self.terms is None:
                self._ready()
            self.query = np.append(self.query, rows.column("query_id").to_numpy())
            self.term = np.append(self.term, pc.fill_null(pc.index_in(rows.column("term"), self.terms), -1).to_numpy())
            # The last query may go on in the next batch.
            done = int(np.searchsorted(self.query, self.query[-1]))
            yield from self._scored(self.query[:done], self.term[:done])
            self.query, self.term = self.query[done:], self.term[done:]

    def _ready(self) -> None:
        terms, sizes, places, values = zip(*self.stored, strict=True) if self.stored else ([pa.array([], pa.string())], *[[np.empty(0, np.int64)]] * 3)
        self.terms, self.size = pa.concat_arrays(terms), np.concatenate(sizes)
        self.place, self.value = np.concatenate(places), np.concatenate(values)
        self.first = np.cumsum(self.size) - self.size

    def _scored(self, query: np.ndarray, term: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The k best chunks of each query, some queries at a time."""
        starts = np.flatnonzero(np.diff(query, prepend=query[:1] - 1))
        size = np.where(term >= 0, self.size[term], 0) if len(self.size) else np.zeros(len(term), np.int64)
        if not size.any():
            return
        # A query costs the scores of all chunks and what its postings add.
        cost = np.add.reduceat(size, starts) + len(self.norm)
        tile = (np.cumsum(cost) - cost) // TILE_SCORES
        edges = np.append(starts[np.flatnonzero(np.diff(tile, prepend=-1))], len(query))
        for start, end in pairwise(edges.tolist()):
            yield self._tile(query[start:end], term[start:end], size[start:end])

    def _tile(self, query: np.ndarray, term: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        ids, line = np.unique(query, return_inverse=True)
        n = len(self.norm)
        at = np.repeat(self.first[term] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        cell = np.repeat(line * n, size) + self.place[at]
        score = np.bincount(cell, self.value[at], minlength=len(ids) * n).reshape(len(ids), n)
        # All weights are positive. By rounded score, then document and chunk.
        key = np.where(score > 0, np.round(score, TEXT_PLACES), -np.inf)[:, self.by_place]
        best = self.by_place[_highest(key, self.k)]
        line = np.repeat(np.arange(len(ids)), best.shape[1])
        best = best.ravel()
        met = score[line, best] > 0
        line, best = line[met], best[met]
        columns = [ids[line], self.doc_ids[best], self.chunk_nos[best], score[line, best]]
        return pa.record_batch([pa.array(c) for c in columns], names=["query_id", "doc_id", "chunk_no", "score"])

    def finish(self) -> Iterator[pa.RecordBatch]:
        if len(self.query):
            yield from self._scored(self.query, self.term)
        self._clear()


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = [F.round("score", TEXT_PLACES).desc(), F.col("doc_id"), F.col("chunk_no")]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def first_blocks(bounds: DataFrame, count: int = FIRST_BLOCKS) -> DataFrame:
    """The blocks with the best bounds of each query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "segment", "block"))
    return bounds.withColumn("_rank", rank).where(F.col("_rank") <= count).drop("_rank")


def open_blocks(bounds: DataFrame, done: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The other blocks whose bound reaches the k-th score of their query so far; all, if it has fewer hits."""
    edge = hits.where(F.col("rank") == k).select("query_id", F.col("score").alias("edge"))
    rest = bounds.join(done.select("query_id", "segment", "block"), ["query_id", "segment", "block"], "left_anti")
    # Ranks use rounded scores, so a bound just below the edge still counts.
    slack = 2 * 10.0**-TEXT_PLACES
    return rest.join(edge, "query_id", "left").where(F.col("edge").isNull() | (F.col("bound") + slack >= F.col("edge"))).drop("edge")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, first: int = FIRST_BLOCKS) -> DataFrame:
    """I1. The k best chunks of each query: query_id, doc_id, chunk_no, score, rank, as ``retrieval.text_search``."""
    asked = Search(spark, path, queries)
    if not asked.segments or not asked.parts:
        return spark.createDataFrame([], "query_id long, doc_id long, chunk_no int, score double, rank int")
    bounds = asked.bounds()
    done = settle(first_blocks(bounds, first))
    hits = settle(_ranked(asked.scores(done, k), k))
    rest = settle(open_blocks(bounds, done, hits, k))
    if rest.isEmpty():
        return hits
    return _ranked(hits.drop("rank").unionByName(asked.scores(rest, k)), k)
