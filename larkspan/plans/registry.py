"""Registry operators on links from ``pages``, dumps made of them, and ``supplier`` as sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators import registry as R
from larkspan.operators.corpus import known_files
from larkspan.operators import keyed, known, retrieval, state
from larkspan.plans.catalog import query
from larkspan.plans.scalars import RUN_AT, _run_at
from larkspan.session import load, settle, staging_path
from larkspan.sources import lines as S


def _quoted(value: Column | str) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def dump_lines(spark: SparkSession, d: str) -> DataFrame:
    """A JSON dump with one line per page: eight shapes of good, bad and empty lines."""
    url = _quoted(F.col("url"))
    one = F.concat(F.lit('{"link": '), url, F.lit(', "displayName": "d'), "page_id", F.lit('"}'))
    wanted, other = F.lit('{"category": "О ДОЛЕВОМ участии", "attachments": ['), F.lit('{"category": null, "attachments": [')
    mixed = F.concat(F.lit('"text", {"link": 5}, {"link": "ftp://x"}, {"name": 1}, '), one)
    shapes = [
        F.concat(wanted, one, F.lit("]}")),
        F.concat(F.lit(",,"), wanted, one, F.lit(", "), one, F.lit("]}")),
        F.concat(other, one, F.lit("]}")),
        F.lit('{"category": "долевое", "attachments": []}'),
        F.concat(wanted, mixed, F.lit("]}")),
        F.concat(wanted, one, F.lit("]},")),
        F.lit(" , "),
        F.lit("[1, 2]"),
    ]
    line = F.lit("")
    for i, shape in enumerate(shapes):
        line = F.when(F.col("page_id") % len(shapes) == i, shape).otherwise(line)
    return load(spark, d, "pages").select(line.alias("value"))


def known_registry(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").where("url LIKE 'https://%'").select("url")


LINKS = """links AS (
  SELECT url, 'd' || page_id AS display_name FROM pages WHERE page_id % 8 IN (0, 1, 4)
  UNION ALL SELECT url, 'd' || page_id FROM pages WHERE page_id % 8 = 1),
known AS (SELECT url FROM pages WHERE url LIKE 'https://%')"""


@query(
    """SELECT line, valid AS is_json, CASE WHEN valid AND shape <> 5 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM (
  SELECT shape, props, CASE shape WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN props || ',' WHEN 3 THEN props || ' x'
    WHEN 5 THEN '[' || props || ']' WHEN 6 THEN props || '],[' || props ELSE ' ' || props END AS line,
    shape IN (0, 1, 5, 7) AS valid
  FROM (SELECT *, event_id % 8 AS shape FROM events) WHERE shape <> 4)"""
)
def a3_json_lines(spark: SparkSession, d: str) -> DataFrame:
    props = F.col("props")
    shapes = [
        props, F.concat(F.lit(",,"), props), F.concat(props, F.lit(",")), F.concat(props, F.lit(" x")), F.lit(" ,"),
        F.concat(F.lit("["), props, F.lit("]")), F.concat(props, F.lit("],["), props), F.concat(F.lit(" "), props),
    ]
    line = F.lit("")
    for i, shape in enumerate(shapes):
        line = F.when(F.col("event_id") % len(shapes) == i, shape).otherwise(line)
    parsed = S.parse_json_lines(load(spark, d, "events").select(line.alias("value")))
    return parsed.select("line", "is_json", F.try_variant_get("item", "$.k", "long").alias("k"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), lower('LES'))")
def c3_contains_folded(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").where(R.contains_folded(F.col("text"), "LES")).select("doc_id")


@query(
    """SELECT url AS link, 'd' || page_id AS display_name, true AS is_valid FROM pages WHERE page_id % 8 IN (0, 1, 4)
UNION ALL SELECT url, 'd' || page_id, true FROM pages WHERE page_id % 8 = 1
UNION ALL SELECT '5', NULL, false FROM pages WHERE page_id % 8 = 4
UNION ALL SELECT 'ftp://x', NULL, false FROM pages WHERE page_id % 8 = 4
UNION ALL SELECT NULL, NULL, false FROM pages WHERE page_id % 8 = 4"""
)
def c4_link_validity(spark: SparkSession, d: str) -> DataFrame:
    items = S.parse_json_lines(dump_lines(spark, d))
    return R.attachment_rows(R.categorised(items))


@query(f"WITH {LINKS} SELECT url AS link FROM links WHERE NOT EXISTS (SELECT 1 FROM known WHERE known.url = links.url)")
def d3_unknown_links(spark: SparkSession, d: str) -> DataFrame:
    items = S.parse_json_lines(dump_lines(spark, d))
    links = R.attachment_rows(R.categorised(items)).where("is_valid")
    return R.unknown_links(links, known_registry(spark, d)).select("link")


@query(
    f"""WITH {LINKS} SELECT CAST(1 AS INTEGER) AS source_id, '{RUN_AT}' AS download_date, url,
  '20240506_070809_' || min(display_name) || coalesce(nullif(regexp_extract(split_part(url, '/', -1), '(?s)^\\.*[^.].*(\\.[^.]*)$', 1), ''), '.pdf')
    .regexp_replace('[\\\\/*?:"<>|]', '_', 'g') AS original_file_name,
  '20240506_070809_' || min(display_name) || coalesce(nullif(regexp_extract(split_part(url, '/', -1), '(?s)^\\.*[^.].*(\\.[^.]*)$', 1), ''), '.pdf')
    .regexp_replace('[\\\\/*?:"<>|]', '_', 'g') || '.txt' AS txt_file_name
FROM links WHERE url NOT IN (SELECT url FROM known) GROUP BY url"""
)
def g3_insert_absent(spark: SparkSession, d: str) -> DataFrame:
    items = S.parse_json_lines(dump_lines(spark, d))
    links = R.attachment_rows(R.categorised(items))
    rows = R.registry_rows(links, known_registry(spark, d), _run_at())
    return rows.drop("created_at", "updated_at").withColumn(
        "download_date", F.date_format("download_date", "yyyy-MM-dd HH:mm:ss")
    )


def _stored_registry(spark: SparkSession, d: str) -> known.Registry:
    """The known URLs stored in two loads."""
    rows = known_registry(spark, d).distinct()
    early = F.length("url") % 2 == 0
    stored = known.create(rows.where(early), staging_path(spark, "registry"))
    known.add(stored, rows.where(~early))
    return stored


@query(f"WITH {LINKS} SELECT url AS link FROM links WHERE NOT EXISTS (SELECT 1 FROM known WHERE known.url = links.url)")
def d3_unknown_links_stored(spark: SparkSession, d: str) -> DataFrame:
    """The same against a registry that lies in buckets with a sketch."""
    items = S.parse_json_lines(dump_lines(spark, d))
    links = settle(R.attachment_rows(R.categorised(items)).where("is_valid"))
    return known.unknown_links(links, _stored_registry(spark, d)).select("link")


@query(
    f"""WITH {LINKS}, new AS (SELECT DISTINCT url FROM links WHERE url NOT IN (SELECT url FROM known))
SELECT url, CAST(NULL AS VARCHAR) AS original_file_name FROM known GROUP BY url
UNION ALL SELECT url, '20240506_070809_' || (SELECT min(display_name) FROM links l WHERE l.url = new.url)
  || coalesce(nullif(regexp_extract(split_part(url, '/', -1), '(?s)^\\.*[^.].*(\\.[^.]*)$', 1), ''), '.pdf')
    .regexp_replace('[\\\\/*?:"<>|]', '_', 'g') FROM new"""
)
def g3_insert_into_stored(spark: SparkSession, d: str) -> DataFrame:
    """The whole stored registry after a dump was loaded into it twice."""
    items = S.parse_json_lines(dump_lines(spark, d))
    links = settle(R.attachment_rows(R.categorised(items)).where("is_valid"))
    rows = known_registry(spark, d).distinct().withColumn("original_file_name", F.lit(None).cast("string"))
    stored = known.create(rows, staging_path(spark, "registry"))
    for _ in range(2):
        fresh = state.first_per_key(links, ["link"], [F.col("display_name").asc_nulls_last()])
        fresh = R.new_rows(known.unknown_links(fresh, stored), _run_at())
        known.add(stored, fresh.select("url", "original_file_name"))
    return known.open_registry(spark, stored.path).rows().select("url", "original_file_name")


@query(
    f"""WITH {LINKS}, per_shape AS (SELECT page_id % 8 AS s, count(*) AS n FROM pages GROUP BY 1),
new AS (SELECT count(DISTINCT url) AS n FROM links WHERE url NOT IN (SELECT url FROM known))
SELECT CAST(sum(n) FILTER (s <> 6) AS BIGINT) AS total, CAST(sum(n) FILTER (s IN (0, 1, 2, 3, 4, 7)) AS BIGINT) AS valid_json,
  CAST(sum(n) FILTER (s IN (0, 1, 3, 4)) AS BIGINT) AS matching_category,
  CAST(sum(n) FILTER (s IN (0, 1, 4)) AS BIGINT) AS has_attachments,
  (SELECT count(*) FROM links) AS valid_links, (SELECT n FROM new) AS new_links,
  (SELECT count(*) FROM links) - (SELECT n FROM new) AS existing_links FROM per_shape"""
)
def e6_ingest_funnel(spark: SparkSession, d: str) -> DataFrame:
    return R.funnel(S.parse_json_lines(dump_lines(spark, d)), known_registry(spark, d))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "supplier").select(
        (F.col("s_suppkey") + 3).cast("int").alias("id"), F.col("s_name").alias("url"),
        F.lit("never").alias("last_update"), F.lit(None).cast("string").alias("update_status"),
    )


@query("SELECT CAST(min(s_suppkey + 3) AS INTEGER) AS id FROM supplier")
def f1_default_source(spark: SparkSession, d: str) -> DataFrame:
    return R.default_source_id(_sources(spark, d))


@query("SELECT CAST(s_suppkey + 3 AS INTEGER) AS id, s_name AS url FROM supplier ORDER BY s_suppkey OFFSET 1")
def f2_remaining_sources(spark: SparkSession, d: str) -> DataFrame:
    return R.remaining_sources(_sources(spark, d))


@query(
    """SELECT CAST(s_suppkey + 3 AS INTEGER) AS id, s_name AS url,
  CASE WHEN s_nationkey > 3 THEN '2024-05-06' ELSE 'never' END AS last_update,
  CASE WHEN s_nationkey <= 3 THEN NULL WHEN s_acctbal < 1000 THEN 'download_failed' WHEN s_nationkey = 9 THEN 'extraction_failed'
    WHEN s_nationkey = 4 THEN 'empty_archive' ELSE 'success' END AS update_status FROM supplier"""
)
def g4_status_update(spark: SparkSession, d: str) -> DataFrame:
    results = load(spark, d, "supplier").where("s_nationkey > 3").select(
        (F.col("s_suppkey") + 3).cast("int").alias("id"), (F.col("s_acctbal") >= 1000).alias("downloaded"),
        (F.col("s_nationkey") != 9).alias("extracted"), (F.col("s_nationkey") - 4).alias("files"),
    )
    return R.update_status(_sources(spark, d), results, F.lit("2024-05-06"))


@query(
    """SELECT CAST(s_suppkey + 3 AS INTEGER) AS id, s_name AS url,
  CASE WHEN s_nationkey > 3 THEN '2024-05-06' ELSE 'never' END AS last_update,
  CASE WHEN s_nationkey <= 3 THEN NULL WHEN s_acctbal < 1000 THEN 'download_failed' WHEN s_nationkey = 9 THEN 'extraction_failed'
    WHEN s_nationkey = 4 THEN 'empty_archive' ELSE 'success' END AS update_status FROM supplier"""
)
def g4_status_in_place(spark: SparkSession, d: str) -> DataFrame:
    """The same on a stored table, of which only buckets with a result are written anew."""
    path = staging_path(spark, "sources")
    keyed.create(_sources(spark, d), path, "id", buckets=8)
    results = load(spark, d, "supplier").where("s_nationkey > 3").select(
        (F.col("s_suppkey") + 3).cast("int").alias("id"), (F.col("s_acctbal") >= 1000).alias("downloaded"),
        (F.col("s_nationkey") != 9).alias("extracted"), (F.col("s_nationkey") - 4).alias("files"),
    )
    # A result of a source that is not there changes nothing.
    stray = results.limit(1).withColumn("id", F.lit(-1))
    keyed.update_status(spark, path, results.unionByName(stray), F.lit("2024-05-06"))
    return keyed.read(spark, path)


@query(
    """SELECT event_id AS path, event_id % 4 <> 3 AS reload FROM events WHERE event_id % 4 <> 2
UNION ALL SELECT event_id, floor(epoch(ts) + 1.4) - floor(epoch(ts)) >= 2 FROM events WHERE event_id % 4 = 2"""
)
def c11_snapshot_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Local copies of the events: 0 missing, 1 of another size, 2 a little later, 3 equal."""
    shape = F.col("event_id") % 4
    remote = load(spark, d, "events").select(
        F.col("event_id").alias("path"), F.col("user_id").alias("size"), _seconds().alias("mtime")
    )
    local = load(spark, d, "events").where(shape > 0).select(
        F.col("event_id").alias("path"), F.when(shape == 1, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("size"),
        F.when(shape == 2, _seconds() + 1.4).otherwise(_seconds()).alias("mtime"),
    )
    return R.stale_snapshots(remote, local).select("path", "reload")


def _seconds() -> Column:
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1e6D")


@query("SELECT event_type AS status, count(*) AS files FROM events GROUP BY event_type")
def e7_run_totals(spark: SparkSession, d: str) -> DataFrame:
    return R.totals(load(spark, d, "events").withColumnRenamed("event_type", "status"))


@query(
    """WITH c AS (SELECT conv_id * 1000 + turn AS answer_id, unnest(string_split(text, '. ')) AS part,
  generate_subscripts(string_split(text, '. '), 1) AS number FROM conversations)
SELECT answer_id, CAST(number AS INTEGER) AS number, 'filechunk' AS type, part, 'f' || answer_id AS file_id FROM c
UNION ALL SELECT answer_id, CAST(number AS INTEGER), 'filechunk', part || '!', 'g' || answer_id FROM c"""
)
def d10_nested_citations(spark: SparkSession, d: str) -> DataFrame:
    """Each sentence of an answer is a citation with three sources, two of the wanted type."""
    key = F.col("conv_id") * 1000 + F.col("turn")

    def source(kind: str, part: Column, prefix: str) -> Column:
        return F.struct(F.lit(kind).alias("type"), part.alias("part"), F.concat(F.lit(prefix), key).alias("file_id"))

    def citation(part: Column) -> Column:
        sources = F.array(source("filechunk", part, "f"), source("web", part, "w"), source("filechunk", F.concat(part, F.lit("!")), "g"))
        return F.struct(sources.alias("sources"))

    answers = load(spark, d, "conversations").select(
        key.alias("answer_id"), F.transform(F.split("text", "\\. "), citation).alias("citations")
    )
    return retrieval.citation_sources(answers)


@query(
    """WITH remote AS (SELECT doc_id AS id, doc_id AS position, 'https://files.example/' || 'doc' || doc_id // 2 || '.txt' AS url,
  'doc' || doc_id // 3 || '.txt' AS name, CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS description FROM documents),
keys AS (SELECT split_part(url, '/', -1) AS name, id, description AS hash, position * 2 AS seen FROM remote
  UNION ALL SELECT name, id, description, position * 2 + 1 FROM remote)
SELECT name, id, hash FROM keys WHERE name <> '' AND hash <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY seen DESC) = 1"""
)
def g6_two_key_union(spark: SparkSession, d: str) -> DataFrame:
    def doc(divisor: int) -> Column:
        return F.concat(F.lit("doc"), F.floor(F.col("doc_id") / divisor), F.lit(".txt"))

    remote = load(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("position"),
        F.concat(F.lit("https://files.example/"), doc(2)).alias("url"), doc(3).alias("name"),
        F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("source")).alias("description"),
    )
    return known_files(remote)


@query("SELECT DISTINCT source AS name FROM documents")
def e11_distinct_names(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "documents").select(
        F.concat(F.lit("Ошибка конвертации "), "source", F.lit(".docx: "), "text").alias("value")
    )
    return S.damaged_files(lines).select(F.replace("name", F.lit(".docx"), F.lit("")).alias("name"))


@query("SELECT n_name AS name, n_nationkey AS id FROM nation")
def a8_table_source(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary table; ``sources.tables.read_jdbc`` reads the same from a database."""
    return load(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (
  PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) = 1"""
)
def g5_keep_first(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    order = [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity")]
    return state.first_per_key(rows, ["l_orderkey"], order)
