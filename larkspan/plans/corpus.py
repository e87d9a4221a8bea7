"""Corpus operators on files made of ``documents`` and ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators import corpus as K
from larkspan.operators import matching as M
from larkspan.operators import registry as R
from larkspan.plans.catalog import query
from larkspan.plans.scalars import _pick, _pick_sql
from larkspan.session import load
from larkspan.sources import lines as S


def _copies(spark: SparkSession, d: str) -> DataFrame:
    """Documents under names that differ by copy marks."""
    key = F.col("doc_id")
    name = _pick(
        "doc_id", F.concat(F.lit("Report ("), key, F.lit(").txt")), F.concat(F.lit("report_"), key, F.lit(".txt")),
        F.concat(F.lit("_report "), key, F.lit(".txt")),
    )
    return load(spark, d, "documents").select(
        F.lpad(key.cast("string"), 12, "0").alias("path"), name.alias("name"), F.col("text").alias("content")
    )


NAMES_SQL = _pick_sql("doc_id", "'Report (' || doc_id || ').txt'", "'report_' || doc_id || '.txt'",
                      "'_report ' || doc_id || '.txt'")
COPIES = f"""copies AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, {NAMES_SQL} AS name, 'report' AS base_name,
  CAST(strlen(text) AS BIGINT) AS size, md5(text) AS md5 FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY base_name, size, md5 ORDER BY name, path) AS rn,
  count(*) OVER (PARTITION BY base_name, size, md5) AS members,
  first_value(path) OVER (PARTITION BY base_name, size, md5 ORDER BY name, path) AS keeper_path FROM copies)"""


@query(
    f"""WITH {COPIES} SELECT base_name, size, md5, members, members - 1 AS redundant, name AS keeper_name FROM ranked
WHERE rn = 1 AND members > 1"""
)
def e3_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = K.duplicate_groups(K.with_duplicate_key(_copies(spark, d)))
    return groups.select(*K.DUPLICATE_KEY, "members", "redundant", F.col("keeper.name").alias("keeper_name"))


PLAN_SQL = f"""WITH {COPIES} SELECT path, name, CASE WHEN rn = 1 THEN 'keep' ELSE 'duplicate' END AS action,
  CASE WHEN rn > 1 THEN name WHEN name LIKE 'R%' THEN 'Report.txt' ELSE 'report.txt' END AS new_name, keeper_path
FROM ranked WHERE members > 1"""


@query(PLAN_SQL)
def f5_duplicate_keeper(spark: SparkSession, d: str) -> DataFrame:
    return K.duplicate_plan(K.with_duplicate_key(_copies(spark, d)))


@query(PLAN_SQL)
def f5_duplicate_keeper_salted(spark: SparkSession, d: str) -> DataFrame:
    """The same with every group of three files or more treated as too large for one task."""
    return K.duplicate_plan(K.with_duplicate_key(_copies(spark, d)), max_group_rows=2)


@query(
    f"""WITH {COPIES},
keepers AS (SELECT path, CASE WHEN name LIKE 'R%' THEN 'Report' ELSE 'report' END AS base,
  row_number() OVER (PARTITION BY name LIKE 'R%' ORDER BY path) AS n FROM ranked WHERE members > 1 AND rn = 1)
SELECT r.path, r.name, CASE WHEN rn = 1 THEN 'keep' ELSE 'duplicate' END AS action, CASE
  WHEN rn = 1 AND base = 'Report' THEN 'Report(' || n || ').txt'
  WHEN rn = 1 AND n = 1 THEN 'report.txt'
  WHEN rn = 1 THEN 'report(' || (n - 1 + CAST(n > 2 AS INTEGER)) || ').txt'
  WHEN CAST(r.path AS BIGINT) % 2 = 0 THEN replace(r.name, '.txt', '(1).txt') ELSE r.name END AS new_name, keeper_path
FROM ranked r LEFT JOIN keepers k ON k.path = r.path WHERE members > 1"""
)
def f5_named_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """The plan with free names: some are taken in the texts' folder, every second file was moved before."""
    copies = _copies(spark, d)
    folder = spark.createDataFrame([("Report.txt",), ("report(2).txt",)], "name string")
    moved = copies.where(F.col("path").cast("long") % 2 == 0).select("name")
    return K.named_duplicate_plan(K.duplicate_plan(K.with_duplicate_key(copies)), folder, moved)


@query(f"WITH {COPIES} SELECT CASE WHEN rn = 1 THEN 'keep' ELSE 'duplicate' END AS action, count(*) AS files FROM ranked "
       "WHERE members > 1 GROUP BY 1")  # fmt: skip
def e12_action_totals(spark: SparkSession, d: str) -> DataFrame:
    return R.totals(K.duplicate_plan(K.with_duplicate_key(_copies(spark, d))), "action")


def _stems(spark: SparkSession, d: str) -> DataFrame:
    """Three files per stem with different extensions and case, in one folder per language."""
    stem = F.concat(F.lit("File"), F.floor(F.col("doc_id") / 3))
    ext = _pick("doc_id", ".docx", ".tmp", ".DOC")
    upper = F.when(F.col("doc_id") % 2 == 0, F.upper(stem)).otherwise(stem)
    plain = F.when(F.length("text") % 2 == 0, F.concat(upper, F.lit(".d"), ext)).otherwise(F.concat(upper, ext))
    return load(spark, d, "documents").select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.col("lang").alias("dir"), plain.alias("name"),
        _pick("doc_id", "docx", "doc", "rtf", "unknown").alias("format"),
    )


EXT_SQL = _pick_sql("doc_id", "'.docx'", "'.tmp'", "'.DOC'")
STEMS = f"""files AS (
  SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, lang AS dir,
    CASE WHEN doc_id % 2 = 0 THEN upper('File' || doc_id // 3) ELSE 'File' || doc_id // 3 END ||
    CASE WHEN length(text) % 2 = 0 THEN '.d' ELSE '' END || {EXT_SQL} AS name,
    {_pick_sql("doc_id", "'docx'", "'doc'", "'rtf'", "'unknown'")} AS format FROM documents),
keyed AS (SELECT *, lower(regexp_extract(name, '^(.+)\\.[^.]+$', 1)) AS stem, lower(regexp_extract(name, '(\\.[^.]+)$', 1)) AS ext,
  lower(regexp_extract(name, '(\\.[^.]+)$', 1)) IN ('.doc', '.docx', '.rtf') AS valid FROM files),
grouped AS (SELECT *, count(*) OVER (PARTITION BY stem) AS members,
  min(CASE WHEN valid THEN name || '|' || path END) OVER (PARTITION BY stem) AS keeper FROM keyed)"""


@query(f"WITH {STEMS} SELECT stem, count(*) AS members FROM keyed GROUP BY stem HAVING count(*) > 1")
def e4_same_stem_groups(spark: SparkSession, d: str) -> DataFrame:
    return K.same_stem_groups(_stems(spark, d)).select("stem", "members")


@query(
    f"""WITH {STEMS} SELECT path, name, stem, CASE WHEN keeper = name || '|' || path THEN 'keep'
  WHEN keeper IS NOT NULL AND NOT valid THEN 'quarantine' ELSE 'stay' END AS action FROM grouped WHERE members > 1"""
)
def f6_extension_keeper(spark: SparkSession, d: str) -> DataFrame:
    return K.extension_plan(_stems(spark, d))


@query(
    f"""WITH {STEMS} SELECT path, name, CASE WHEN valid THEN 'keep' WHEN format <> 'unknown' THEN 'rename' ELSE 'quarantine' END AS action,
  CASE WHEN NOT valid AND format <> 'unknown' THEN split_part(name, '.', 1) || '.' || format ELSE name END AS new_name FROM keyed"""
)
def f7_extension_repair(spark: SparkSession, d: str) -> DataFrame:
    return K.repair_plan(_stems(spark, d))


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    """A text per labelled document."""
    return (
        load(spark, d, "labels")
        .join(load(spark, d, "documents").select("doc_id", "lang"), "doc_id")
        .select(F.col("lang").alias("dir"), F.concat(F.lit("FILE"), F.floor(F.col("doc_id") / 3), F.lit(".txt")).alias("name"))
    )


OUTPUTS = "outputs AS (SELECT lang AS dir, 'FILE' || doc_id // 3 || '.txt' AS name FROM labels JOIN documents USING (doc_id))"


@query(
    f"""WITH {STEMS}, {OUTPUTS}, done AS (SELECT DISTINCT dir, lower(regexp_extract(name, '^(.+)\\.[^.]+$', 1)) AS stem FROM outputs),
ranked AS (SELECT k.dir, k.name, d.stem IS NOT NULL AS has_output, row_number() OVER (PARTITION BY k.dir, k.stem ORDER BY k.ext, k.name) AS rn
  FROM keyed k LEFT JOIN done d ON k.dir = d.dir AND k.stem = d.stem WHERE k.ext IN ('.doc', '.docx'))
SELECT dir, name FROM ranked WHERE NOT has_output OR rn > 1"""
)
def d4_missing_outputs(spark: SparkSession, d: str) -> DataFrame:
    sources = _stems(spark, d).where(K.has_extension(F.col("name"), K.SOURCE_EXTENSIONS)).select("dir", "name")
    return K.missing_outputs(sources, _outputs(spark, d))


@query(
    f"""WITH {STEMS}, {OUTPUTS}, per_name AS (SELECT stem, count(*) AS n FROM keyed WHERE ext IN ('.doc', '.docx') GROUP BY stem)
SELECT (SELECT CAST(sum(n) AS BIGINT) FROM per_name) AS source_files, (SELECT count(*) FROM files) AS all_files,
  (SELECT count(*) FROM outputs) AS text_files, (SELECT count(*) FROM per_name) AS distinct_names,
  (SELECT count(*) FROM per_name WHERE n > 1) AS duplicated_names"""
)
def e5_inventory_summary(spark: SparkSession, d: str) -> DataFrame:
    return K.inventory_summary(_stems(spark, d), _outputs(spark, d))


@query(
    f"""WITH {STEMS} SELECT stem, count(*) AS members FROM keyed WHERE ext IN ('.doc', '.docx') GROUP BY stem
HAVING count(*) > 1 ORDER BY stem LIMIT 3"""
)
def e5_duplicate_examples(spark: SparkSession, d: str) -> DataFrame:
    return K.duplicated_name_examples(_stems(spark, d))


@query(
    """WITH remote AS (SELECT 'doc' || doc_id || '.txt' AS name, 'id' || doc_id AS id,
  CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 3 = 2 THEN sha256(text || 'x') ELSE sha256(text) END AS hash
  FROM documents WHERE source <> 'src1')
SELECT 'doc' || doc_id || '.txt' AS name, sha256(text) AS hash,
  CASE WHEN r.hash IS NULL OR r.hash = '' THEN 'NEW' WHEN r.hash = sha256(text) THEN 'UNCHANGED' ELSE 'CHANGED' END AS status,
  CASE WHEN r.hash = sha256(text) THEN r.id END AS kept_id
FROM documents LEFT JOIN remote r ON r.name = 'doc' || doc_id || '.txt'"""
)
def d5_content_sync(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").withColumn("name", F.concat(F.lit("doc"), "doc_id", F.lit(".txt")))
    local = docs.select("name", F.sha2("text", 256).alias("hash"))
    other = F.when(F.col("doc_id") % 3 == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    remote = docs.where("source <> 'src1'").select(
        F.concat(F.lit("id"), "doc_id").alias("id"), F.col("doc_id").alias("position"),
        F.concat(F.lit("https://files.example/a/"), "name").alias("url"),
        F.when(F.col("lang") == "en", F.col("name")).otherwise(F.concat(F.lit("title of "), "name")).alias("name"),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.sha2(other, 256)).alias("description"),
    )
    return K.content_sync(local, remote)


@query("SELECT doc_id, text FROM documents WHERE source IN (SELECT 'src' || doc_id FROM labels)")
def d8_damaged_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose file the conversion log names as damaged."""
    log = load(spark, d, "labels").select(
        F.concat(F.lit("12:00 Ошибка конвертации src"), "doc_id", F.lit(".docx: bad zip")).alias("value")
    )
    files = load(spark, d, "documents").withColumn("name", F.concat("source", F.lit(".docx")))
    return files.join(S.damaged_files(log), "name", "left_semi").select("doc_id", "text")


def _files(spark: SparkSession, d: str, prefix: str, size: Column, mtime: Column) -> DataFrame:
    return load(spark, d, "events").select(
        F.concat(F.lit(prefix), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("path"),
        size.cast("long").alias("size"), mtime.cast("double").alias("mtime"),
    )


def _second() -> Column:
    """Whole seconds since 1970 of a time without zone, whatever the session's zone is."""
    return F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")


def _hour() -> Column:
    return F.floor(_second() / 3600)


@query(
    """WITH s AS (SELECT 's' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS path, user_id AS size, round_even(CAST(floor(epoch(ts)) AS BIGINT) // 3600 + (event_id % 3) * 0.5, 0) AS sec FROM events),
t AS (SELECT 't' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS path, user_id AS size, round_even(CAST(floor(epoch(ts)) AS BIGINT) // 3600 + (event_id % 2) * 0.5, 0) AS sec FROM events),
sr AS (SELECT *, row_number() OVER (PARTITION BY size, sec ORDER BY path) AS rn FROM s),
tr AS (SELECT *, row_number() OVER (PARTITION BY size, sec ORDER BY path) AS rn FROM t)
SELECT sr.path AS source, tr.path AS target, 'exact' AS kind FROM sr JOIN tr USING (size, sec, rn)"""
)
def d6_exact_match(spark: SparkSession, d: str) -> DataFrame:
    """Files of one user and hour are equal but for halves of a second, which round half-even."""
    sources = _files(spark, d, "s", F.col("user_id"), _hour() + F.col("event_id") % 3 * 0.5)
    targets = _files(spark, d, "t", F.col("user_id"), _hour() + F.col("event_id") % 2 * 0.5)
    return M.match_files(sources, targets, near=False)


def _near_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sizes within a few percent; seconds squeezed so that files lie within the tolerance."""
    second = F.floor(_second() / 26)
    key = F.col("event_id")
    size = F.lit(10000) + F.col("user_id") * 3
    return _files(spark, d, "s", size, second), _files(spark, d, "t", size + key % 7, second + key % 3)


@query(
    """WITH s AS (SELECT DISTINCT 10000 + user_id * 3 AS size, CAST(floor(epoch(ts)) AS BIGINT) // 26 AS sec FROM events),
t AS (SELECT DISTINCT 10000 + user_id * 3 + event_id % 7 AS t_size, CAST(floor(epoch(ts)) AS BIGINT) // 26 + event_id % 3 AS t_sec FROM events)
SELECT size, sec, abs(t_sec - sec) AS dt, abs(t_size - size) AS ds, t_sec, t_size FROM s
JOIN t ON t_sec BETWEEN sec - 10 AND sec + 10 AND abs(t_size - size) / greatest(size, 1) * 100 <= 1
QUALIFY row_number() OVER (PARTITION BY size, sec ORDER BY abs(t_sec - sec), abs(t_size - size), t_sec, t_size) = 1"""
)
def d7_nearest_target(spark: SparkSession, d: str) -> DataFrame:
    """Best target within 1 % of size and 10 s for each size and time of the sources."""
    sources, targets = (M.with_second(side) for side in _near_sides(spark, d))
    return M.nearest(sources.select("size", "sec").distinct(), targets.select("size", "sec").distinct())


@query()
def d7_tolerance_match(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one pairs, exact ones first. Sequential within a cell, so compared with brute force in the tests."""
    return M.match_files(*_near_sides(spark, d))


@query(
    """SELECT 's' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS source, 't' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS target,
  CASE WHEN o_orderkey % 35 = 0 THEN 'exact' ELSE 'near' END AS kind FROM orders WHERE o_orderkey % 11 > 0 AND o_orderkey % 5 < 4"""
)
def d7_tolerance_match_apart(spark: SparkSession, d: str) -> DataFrame:
    """Pairs so far apart that only one matching leaves no free pair: some lie beyond the size, some have no target."""
    key = F.col("o_orderkey")
    orders = load(spark, d, "orders").where("o_orderkey > 0")

    def side(rows: DataFrame, prefix: str, size: Column, mtime: Column) -> DataFrame:
        path = F.concat(F.lit(prefix), F.lpad(key.cast("string"), 12, "0"))
        return rows.select(path.alias("path"), size.cast("long").alias("size"), mtime.cast("double").alias("mtime"))

    # Each order has its own 100 seconds; the size differs by 0, 0.3, 0.6, 0.9 or 1.2 percent.
    sources = side(orders, "s", F.lit(1000), key * 100)
    targets = side(orders.where("o_orderkey % 11 > 0"), "t", F.lit(1000) + key % 5 * 3, key * 100 + key % 7)
    return M.match_files(sources, targets)


def _taken(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "source"), "doc_id")
    number = (F.col("doc_id") % 9).cast("string")
    by_parentheses = F.concat("source", F.lit("("), number, F.lit(").txt"))
    plain = F.concat("source", F.lit(".txt"))
    return docs.select(F.when(F.col("quality") == 1, by_parentheses).otherwise(plain).alias("name")).distinct()


NAMED = """newcomers AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, source || '.txt' AS name, source AS base FROM documents),
taken AS (SELECT DISTINCT CASE WHEN quality = 1 THEN source || '(' || doc_id % 9 || ').txt' ELSE source || '.txt' END AS name
  FROM labels JOIN documents USING (doc_id)),
plain AS (SELECT name, min(path) AS path FROM newcomers WHERE name NOT IN (SELECT name FROM taken) GROUP BY name),
rest AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY path) AS rn FROM newcomers WHERE path NOT IN (SELECT path FROM plain)),
sizes AS (SELECT base, count(*) AS n FROM rest GROUP BY base),
numbers AS (SELECT base, unnest(range(1, n + 20)) AS number FROM sizes),"""


@query(
    f"""WITH {NAMED}
free AS (SELECT base, number, row_number() OVER (PARTITION BY base ORDER BY number) AS rn FROM numbers
  WHERE base || '(' || number || ').txt' NOT IN (SELECT name FROM taken))
SELECT path, name, base || '(' || number || ').txt' AS new_name FROM rest JOIN free USING (base, rn)
UNION ALL SELECT path, name, name FROM plain"""
)
def f8_unique_names(spark: SparkSession, d: str) -> DataFrame:
    newcomers = load(spark, d, "documents").select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.concat("source", F.lit(".txt")).alias("name")
    )
    return K.unique_names(newcomers, _taken(spark, d))


@query(
    f"""WITH {NAMED}
free AS (SELECT base, number, row_number() OVER (PARTITION BY base ORDER BY number) AS rn FROM numbers
  WHERE base || '(' || number || ').txt' NOT IN (SELECT name FROM taken))
SELECT path, name, base || '(' || number || ').txt' AS new_name FROM rest JOIN free USING (base, rn)
UNION ALL SELECT path, name, name FROM plain"""
)
def f8_unique_names_split(spark: SparkSession, d: str) -> DataFrame:
    """The same with every base treated as too large for one task."""
    newcomers = load(spark, d, "documents").select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.concat("source", F.lit(".txt")).alias("name")
    )
    return K.unique_names(newcomers, _taken(spark, d), max_group_rows=3)


@query(
    """WITH newcomers AS (SELECT lang AS dir, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, source || '.txt' AS name, source AS base FROM documents),
taken AS (SELECT DISTINCT lang AS dir, CASE WHEN quality = 1 THEN source || '(' || doc_id % 9 || ').txt' ELSE source || '.txt' END AS name
  FROM labels JOIN documents USING (doc_id)),
plain AS (SELECT dir, name, min(path) AS path FROM newcomers n
  WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.name = n.name AND t.dir = n.dir) GROUP BY dir, name),
rest AS (SELECT *, row_number() OVER (PARTITION BY dir, base ORDER BY path) AS rn FROM newcomers WHERE path NOT IN (SELECT path FROM plain)),
numbers AS (SELECT dir, base, unnest(range(1, n + 20)) AS number FROM (SELECT dir, base, count(*) AS n FROM rest GROUP BY dir, base)),
free AS (SELECT dir, base, number, row_number() OVER (PARTITION BY dir, base ORDER BY number) AS rn FROM numbers u
  WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.dir = u.dir AND t.name = base || '(' || number || ').txt'))
SELECT dir, path, name, base || '(' || number || ').txt' AS new_name FROM rest JOIN free USING (dir, base, rn)
UNION ALL SELECT dir, path, name, name FROM plain"""
)
def f8_unique_names_folders(spark: SparkSession, d: str) -> DataFrame:
    """Names that are free in the newcomer's own folder; the language stands for it."""
    docs = load(spark, d, "documents")
    newcomers = docs.select(
        F.col("lang").alias("dir"),
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"),
        F.concat("source", F.lit(".txt")).alias("name"),
    )
    known = load(spark, d, "labels").join(docs.select("doc_id", "source", "lang"), "doc_id")
    by_parentheses = F.concat("source", F.lit("("), (F.col("doc_id") % 9).cast("string"), F.lit(").txt"))
    name = F.when(F.col("quality") == 1, by_parentheses).otherwise(F.concat("source", F.lit(".txt")))
    taken = known.select(F.col("lang").alias("dir"), name.alias("name")).distinct()
    return K.unique_names(newcomers, taken, scope=["dir"], max_group_rows=20)


@query(
    """WITH n AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, lang || '_' || doc_id % 5 || '.docx' AS name, lang FROM documents),
taken AS (SELECT DISTINCT lang || '_' || doc_id % 4 * 3 || '.docx' AS name FROM labels JOIN documents USING (doc_id)),
plain AS (SELECT name, min(path) AS path FROM n WHERE name NOT IN (SELECT name FROM taken) GROUP BY name),
rest AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY path) AS rn FROM n WHERE path NOT IN (SELECT path FROM plain)),
numbers AS (SELECT lang, unnest(range(1, c + 30)) AS number FROM (SELECT lang, count(*) AS c FROM rest GROUP BY lang)),
free AS (SELECT lang, number, row_number() OVER (PARTITION BY lang ORDER BY number) AS rn FROM numbers
  WHERE lang || '_' || number || '.docx' NOT IN (SELECT name FROM taken UNION ALL SELECT name FROM plain))
SELECT path, name, lang || '_' || number || '.docx' AS new_name FROM rest JOIN free USING (lang, rn)
UNION ALL SELECT path, name, name FROM plain"""
)
def f8_unique_names_underscore(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    newcomers = docs.select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"),
        F.concat("lang", F.lit("_"), F.col("doc_id") % 5, F.lit(".docx")).alias("name"),
    )
    taken = load(spark, d, "labels").join(docs.select("doc_id", "lang"), "doc_id")
    taken = taken.select(F.concat("lang", F.lit("_"), F.col("doc_id") % 4 * 3, F.lit(".docx")).alias("name")).distinct()
    return K.unique_names(newcomers, taken, style="underscore")


@query("SELECT p_name AS name, p_partkey AS path FROM part ORDER BY p_name, p_partkey LIMIT 10")
def f10_head_files(spark: SparkSession, d: str) -> DataFrame:
    """Test mode: the first 10 files by name."""
    return K.head_files(load(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("path")), 10)


@query(
    """SELECT p_partkey AS path, p_name AS name, row_number() OVER (ORDER BY p_name, p_partkey) AS ordinal,
  'Файл ' || row_number() OVER (ORDER BY p_name, p_partkey) AS label FROM part"""
)
def f12_file_labels(spark: SparkSession, d: str) -> DataFrame:
    return K.file_labels(load(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("path")))
