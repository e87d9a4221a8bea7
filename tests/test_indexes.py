"""The stored indexes give what scoring everything gives, and leave out blocks and cells that cannot matter."""

import re

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from larkspan.operators import retrieval as R
from larkspan.operators import text_index, vector_index


@pytest.fixture(scope="module")
def library(spark):
    """Documents by subject: each has words of its own besides common ones; every tenth text is NULL, empty or blank."""
    rng = np.random.default_rng(9)
    common = [f"the{i}" for i in range(30)]
    out = []
    for i in range(600):
        words = rng.choice(common, rng.integers(0, 30)).tolist() + rng.choice([f"s{i // 20}w{j}" for j in range(12)], rng.integers(0, 30)).tolist()
        rng.shuffle(words)
        out.append((i, [" ".join(w.upper() if rng.random() < 0.2 else w for w in words), None, "", " \n"][(i % 10 == 9) * (1 + i // 10 % 3)]))
    asked = [(s, f"the1 The2 S{s}w1 s{s}W2 s{s}w3 unknown{s}") for s in range(30)] + [(100, "nothing here"), (101, ""), (102, "the3"), (103, None)]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    return spark.createDataFrame(out, "doc_id long, text string").coalesce(1), queries


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def shown(hits):
    return rows(hits.select("query_id", "doc_id", "chunk_no", F.round("score", 6), "rank"))


@pytest.fixture(scope="module")
def built(library, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    for part in range(3):
        text_index.add_documents(library[0].where(F.col("doc_id") % 3 == part), path, size=20, overlap=5, parts=4, block_chunks=16)
    return path


def test_text_index_of_three_segments_equals_scoring_everything(spark, library, built):
    docs, queries = library
    want = R.text_search(R.chunk_table(docs, 20, 5), queries, k=4)
    assert shown(text_index.search(spark, built, queries, k=4)) == shown(want)


def test_blocks_that_cannot_reach_the_best_are_skipped(spark, library, built):
    asked = text_index.Search(spark, built, library[1])
    bounds = asked.bounds()
    done = text_index.first_blocks(bounds)
    hits = text_index._ranked(asked.scores(done, 4), 4)
    rest = text_index.open_blocks(bounds, done, hits, 4)
    assert done.count() + rest.count() < 0.6 * bounds.count()
    # No score exceeds its block's bound.
    best = asked.scores(bounds, 1000).groupBy("query_id").agg(F.max("score").alias("s"))
    over = best.join(bounds.groupBy("query_id").agg(F.max("bound").alias("b")), "query_id").where("s > b + 1e-9")
    assert over.count() == 0


def test_search_reads_the_parts_of_its_terms_only(spark, library, built):
    one = spark.createDataFrame([(1, "s3w1")], "query_id long, text string")
    asked = text_index.Search(spark, built, one)
    files = lambda parts: asked.stored(parts).select(F.input_file_name()).distinct().count()
    assert len(asked.parts) == 1 and 0 < files(asked.parts) < files(list(range(4)))


def test_scores_read_only_the_postings_asked_for(spark, library, built):
    asked = text_index.Search(spark, built, library[1])
    bounds = asked.bounds()
    assert re.search(r"part#\d+ IN ", plan(asked.stored(asked.parts)))
    # The postings in the index are read once, for the bounds.
    assert not re.search(r"part#\d+ IN ", plan(asked.scores(bounds, 4)))


def test_words_of_an_index_are_those_of_chunks(spark, tmp_path):
    texts = ["a\x0bB  c\x0cA\r\n\tb ", "x\x1cy\x85z\xa0w X", "\u0130stanbul \u03a3\u03a3 \u00c9T\u00c9 a", "   ", None, "", "b " * 40 + "C", "\u3000", "b " * 9]
    docs = spark.createDataFrame([*enumerate(texts), (1, "again a"), (6, None)], "doc_id long, text string")
    asked = [(i, t) for i, t in enumerate(texts)] + [(50, "c a b z"), (50, "again")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    path = str(tmp_path / "index")
    text_index.add_documents(docs, path, size=7, overlap=3, parts=3, block_chunks=4)
    assert shown(text_index.search(spark, path, queries, k=3)) == shown(R.text_search(R.chunk_table(docs, 7, 3), queries, k=3))


def test_postings_hold_the_counts(spark, library, built):
    docs, queries = library
    asked = text_index.Search(spark, built, queries)
    chunks = R.chunk_table(docs, 20, 5)
    want = chunks.select("doc_id", "chunk_no", F.explode("tokens").alias("t")).groupBy(F.lower("t").alias("term")).agg(F.count_distinct("doc_id", "chunk_no").alias("n"))
    stored = asked.stored(list(range(4)))
    assert rows(stored.groupBy("term").agg(F.sum("chunks").alias("n"))) == rows(want)
    assert asked.chunks == chunks.count()


def test_empty_index_and_queries(spark, library, tmp_path, built):
    docs, queries = library
    path = str(tmp_path / "index")
    assert text_index.search(spark, path, queries).count() == 0
    text_index.add_documents(docs.limit(0), path)
    assert text_index.search(spark, path, queries).count() == 0
    assert text_index.search(spark, built, queries.limit(0)).count() == 0


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(40, 8))
    vectors = [(i, (centres[i % 40] + 0.05 * rng.normal(size=8)).tolist()) for i in range(2000)]
    vectors += [(3000 + i, centres[0].tolist()) for i in range(50)] + [(4000, [0.0] * 8), (4001, None)]
    asked = [(i, centres[i].tolist()) for i in range(5)] + [(50, [0.0] * 8)]
    return spark.createDataFrame(vectors, "vec_id long, vector array<double>"), spark.createDataFrame(asked, "query_id long, vector array<double>")


def test_vector_index_equals_scoring_everything(spark, clustered, tmp_path, monkeypatch):
    vectors, queries = clustered
    vector_index.build(vectors, str(tmp_path / "v"), cell_vectors=50)
    ranked = lambda hits: rows(hits.select("query_id", "vec_id", F.round("score", 8), "rank"))
    want = ranked(R.vector_search(vectors.where("vector IS NOT NULL"), queries, k=7))
    assert ranked(vector_index.search(spark, str(tmp_path / "v"), queries, k=7)) == want
    # The same with several passes.
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 2)
    assert ranked(vector_index.search(spark, str(tmp_path / "v"), queries, k=7)) == want


def test_cells_out_of_reach_are_not_read(spark, clustered, tmp_path):
    vectors, queries = clustered
    path = str(tmp_path / "v")
    vector_index.build(vectors, path, cell_vectors=50)
    queries = queries.where("query_id < 5")
    bounds = vector_index.cell_bounds(spark, path, queries)
    done = bounds.groupBy("query_id").agg(F.max_by("cell", "bound").alias("cell"))
    hits = vector_index._ranked(vector_index._scored(spark, path, done, queries, 7), 7)
    rest = vector_index.open_cells(bounds, done, hits, 7)
    cells = bounds.select("cell").distinct().count()
    assert rest.select("cell").union(done.select("cell")).distinct().count() < cells / 2
    # The cells are folders, chosen before anything is read.
    assert re.search(r"PartitionFilters: \[[^]]*cell#", plan(vector_index._scored(spark, path, done, queries, 7)))


def test_no_vectors(spark, clustered, tmp_path):
    vectors, queries = clustered
    vector_index.build(vectors.limit(0), str(tmp_path / "v"))
    assert vector_index.search(spark, str(tmp_path / "v"), queries).count() == 0
