"""The query of each operator, with its production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import alignment, bestfit, bpe, exact, knn, packing, periodic, pii, repeats, sharding, simhash, toxicity, warc
from larkspan.session import load, settle, staging_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


@query("""
    WITH vectors AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
        FROM vectors q JOIN vectors c ON c.vec_id <> q.vec_id
        WHERE q.vec_id % 100 = 0
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
""")
def op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of each hundredth vector."""
    found = knn.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


@query()
def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document. The counts are those of plain spans; added ones are counted apart."""
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    rank = lambda s: F.array_position(F.array(*map(F.lit, pii.KINDS)), s["kind"])
    everything = F.array_sort(
        F.transform(F.concat("plain", "added"), lambda s: F.struct(rank(s).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    count = lambda kind: F.size(F.filter("plain", lambda s: s["kind"] == kind)).cast("long")
    found = pii.identifiers(load(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(joined(F.col("plain")), 256).alias("base_sha256"),
        joined(everything).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


@query()
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the multilingual rank file, and their bytes decoded again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(load(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(encoded, path).select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(r"""
    WITH texts AS (
        SELECT doc_id, length(coalesce(text, '')) AS chars,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
        FROM documents
    ), ranked AS (
        SELECT doc_id, content,
               first_value(doc_id) OVER (PARTITION BY content ORDER BY chars DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY content) AS group_size,
               row_number() OVER (PARTITION BY content ORDER BY chars DESC, doc_id) = 1 AS kept
        FROM texts
    )
    SELECT doc_id, keep_id, group_size, kept, sha256(content) AS text_sha256 FROM ranked
""")
def op4_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays for its text."""
    return exact.content_sort(load(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


@query()
def op5_simhash_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component at two or fewer differing bits."""
    return simhash.clusters(load(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id"
    )


@query()
def op6_weighted_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in eight shards of nearly equal bytes."""
    return sharding.size_shards(load(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op7_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bucket of the least padding and its place in a token-budget batch."""
    return packing.length_buckets(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query()
def op8_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that start elsewhere too."""
    return repeats.without_repeats(load(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        # A cut may go through a character.
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"),
    )


@query()
def op9_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels outside the held-out fold."""
    docs = load(spark, sf_dir, "documents")
    model = toxicity.learn(docs, load(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        F.col("id").alias("doc_id"),
        toxicity.held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])).alias("spans"),
    )


# SQL of the digest alone: DuckDB has no SHA-1 as bytes, so its hex form is cut into base32 letters.
@query(r"""
    WITH digests AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex
        FROM pages
    ), coded AS (
        SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr(
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            (((('0x' || substr(hex || '0', CAST(5 * i // 4 AS INTEGER) + 1, 2))::INTEGER) >> (3 - (5 * i) % 4)) & 31) + 1, 1
        )), 'string_agg', '') AS payload_digest
        FROM digests
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
    FROM coded WINDOW w AS (PARTITION BY payload_digest)
""")
def op10_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC archives, converted to WARC and read back."""
    arc, archive = staging_path(spark, "arc"), staging_path(spark, "warc")
    warc.write_arc(load(spark, sf_dir, "pages"), arc)
    warc.write_warc(spark, arc, archive)
    records = settle(warc.read_warc(spark, archive))
    return warc.resolved(records).select(
        "page_id",
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )


@query()
def op13_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 2048 tokens and their places in as few sequences."""
    path = public_tokenizers.path("word_bpe_49k.json")
    found = bestfit.pieces(load(spark, sf_dir, "documents"), path)
    narrow = found.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return bestfit.pack(narrow)


@query()
def op12_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of two tokenizers, aligned, with corpus-wide counts of the pairs that end together."""
    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = alignment.index(load(spark, sf_dir, "documents"), a, b)
    # A document without tokens has no groups to hash.
    digest = F.when(F.col("n_links") > 0, F.sha2(F.col("groups"), 256)).otherwise(F.when(F.col("pair").isNull(), F.lit("")))
    found = settle(found.withColumn("groups", digest))
    return alignment.scored(found, alignment.pieces_of(b)).select(
        F.col("id").alias("doc_id"),
        "n_a",
        "n_b",
        F.col("n_links").alias("n_groups"),
        "n_links",
        "n_best",
        "count_sum",
        F.col("groups").alias("groups_sha256"),
    )


def _repeating(doc_id: Column, text: Column) -> Column:
    """The words of each tenth text, by the checksum of its id, repeat from one of them on; other texts stay. A NULL id counts as no tenth."""
    checksum = F.crc32(doc_id.cast("string"))
    drawn = F.floor(checksum / 10)

    def rewritten(listed: Column) -> Column:
        n = F.size(listed).cast("long")
        first = drawn % n
        period = 1 + F.floor((n - first) / (3 + drawn % 8))
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        moved = F.transform(places, lambda i: F.get(listed, F.when(i < first, i).otherwise(first + (i - first) % period).cast("int")))
        return F.when(n > 0, F.array_join(moved, " ")).otherwise("")

    listed = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    # As an element of an array the words are split once.
    return F.when(checksum % 10 == 0, F.get(F.transform(F.array(listed), rewritten), 0)).otherwise(text)


@query()
def op11_cover_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs of words, the strongest of them, and the text without the repeats."""
    docs = load(spark, sf_dir, "documents")
    docs = docs.select("doc_id", _repeating(F.col("doc_id"), F.col("text")).alias("text"))

    def stronger(x: Column, y: Column) -> Column:
        repeats_x, repeats_y = x["length"] * y["period"], y["length"] * x["period"]
        by_place = F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise((x["period"] - y["period"]).cast("int"))
        return F.when(repeats_x > repeats_y, -1).when(repeats_x < repeats_y, 1).otherwise(by_place)

    found = periodic.periodic_runs(docs).withColumn("best", F.get(F.array_sort("runs", stronger), 0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )
