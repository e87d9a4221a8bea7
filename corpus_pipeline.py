"""The corpus pipeline: documents through the operators of ``larkspan.llm``, stage by stage.

Every stage takes all rows that the one before kept, is written as Parquet below the shared folder and read
again, so that a lost executor costs no earlier stage. NULL and empty texts pass the first stage and are
copies of each other in the second; rows that agree in id and text are one from there on; an empty table
passes through. Further columns go along to the last stage but one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import exact, packing, pii, simhash, toxicity
from larkspan.llm.common import keep_rows
from larkspan.session import load, settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Near copies have fingerprints of shingles of so many words that differ in at most so many bits.
SHINGLE_WORDS = 3
RADIUS = 2


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field, fitted to the labels outside the held-out fold, scores below 0.5."""
    return toxicity.accepted(docs, toxicity.learn(docs, load(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text only the preferred one goes on."""
    return keep_rows(docs, exact.content_sort(docs).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the document with the smallest id goes on."""
    found = simhash.clusters(docs, words=SHINGLE_WORDS, radius=RADIUS)
    order = F.struct(F.col("id").isNull(), "id", "row_key")
    return keep_rows(docs, found.groupBy("cluster").agg(F.min_by("row_key", order).alias("row_key")))


def mask_identifiers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast(masked.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each remaining document's length bucket and batch."""
    return packing.length_buckets(docs).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("pii", mask_identifiers),
    ("packing", pack),
]

# The scores of the first stage are learnt, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: doc_id, n_tokens, bucket, pad_to, batch, place."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
