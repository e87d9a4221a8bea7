"""Search operators: ``benchmark`` items as questions on ``documents``, label means as vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators import retrieval as R
from larkspan.operators import text_index, vector_index
from larkspan.plans.catalog import query
from larkspan.plans.scalars import CHUNKS
from larkspan.session import load, settle, staging_path

SEARCH = f"""{CHUNKS},
lengths AS (SELECT doc_id, chunk_no, len(tokens) AS length FROM chunks),
whole AS (SELECT count(*) AS n, avg(length) AS mean_length FROM lengths),
tf AS (SELECT doc_id, chunk_no, lower(term) AS term, count(*) AS tf FROM (SELECT doc_id, chunk_no, unnest(tokens) AS term FROM chunks) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
terms AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0b]+'), lambda w: w <> '')) AS term FROM benchmark),
scores AS (SELECT item_id, doc_id, chunk_no, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))) AS score
  FROM terms JOIN tf USING (term) JOIN df USING (term) JOIN lengths USING (doc_id, chunk_no), whole GROUP BY ALL),
hits AS (SELECT item_id AS query_id, doc_id, chunk_no, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id, chunk_no) AS rank
  FROM scores QUALIFY rank <= 5)"""


def _hits(spark: SparkSession, d: str, **options) -> DataFrame:
    chunks = R.chunk_table(load(spark, d, "documents"))
    queries = load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.text_search(chunks, queries, **options)


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id", "doc_id", "chunk_no", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank")
    )


@query(f"WITH {SEARCH} SELECT query_id, doc_id, chunk_no, round(score, 4) AS score, rank FROM hits")
def i1_text_search(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_hits(spark, d))


@query(f"WITH {SEARCH} SELECT query_id, doc_id, chunk_no, round(score, 4) AS score, rank FROM hits")
def i1_text_search_passes(spark: SparkSession, d: str) -> DataFrame:
    """The same with more terms than one pass takes."""
    return _shown(_hits(spark, d, pass_terms=400))


@query(f"WITH {SEARCH} SELECT query_id, doc_id, chunk_no, round(score, 4) AS score, rank FROM hits")
def i1_text_search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stored index of two segments."""
    path, documents = staging_path(spark, "index"), load(spark, d, "documents").select("doc_id", "text")
    late = F.col("doc_id") % 4 == 3
    for part in (~late, late):
        text_index.add_documents(documents.where(part), path)
    queries = load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return _shown(text_index.search(spark, path, queries))


@query(
    f"""WITH {SEARCH} SELECT query_id, rank AS citation, doc_id, chunk_no, source, lang, md5(array_to_string(tokens, ' ')) AS fragment
FROM hits JOIN chunks USING (doc_id, chunk_no) JOIN documents USING (doc_id)"""
)
def i3_cited_sources(spark: SparkSession, d: str) -> DataFrame:
    found = R.cited(settle(_hits(spark, d)), load(spark, d, "documents"))
    return found.withColumns({"citation": F.col("citation").cast("long"), "fragment": F.md5("fragment")})


NEAREST = """WITH parts AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT CAST(label AS BIGINT) AS query_id, i, avg(CAST(x AS DOUBLE)) AS m FROM parts GROUP BY label, i),
dots AS (SELECT query_id, vec_id, sum(m * CAST(x AS DOUBLE)) AS dot, sqrt(sum(m * m)) AS a, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS b
  FROM parts JOIN means USING (i) GROUP BY query_id, vec_id)
SELECT query_id, vec_id, round(dot / (a * b), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(dot / (a * b), 9) DESC, vec_id) AS rank
FROM dots QUALIFY rank <= 5"""


def _nearest(spark: SparkSession, d: str, **options) -> DataFrame:
    vectors = load(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    queries = settle(R.centroids(vectors, "label"))
    hits = R.vector_search(vectors, queries, **options)
    return hits.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


@query(NEAREST)
def i2_vector_search(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d)


@query(NEAREST)
def i2_vector_search_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The same with a query set treated as too large to send to every task."""
    return _nearest(spark, d, pass_numbers=200)


@query(NEAREST)
def i2_vector_search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same from stored cells."""
    vectors = load(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    path = staging_path(spark, "cells")
    vector_index.build(vectors.select("vec_id", "vector"), path, cell_vectors=200)
    hits = vector_index.search(spark, path, settle(R.centroids(vectors, "label")))
    return hits.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})
