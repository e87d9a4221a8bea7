"""Column functions on whole test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import chat as C
from larkspan.functions import names as N
from larkspan.functions import pages as P
from larkspan.functions import texts as X
from larkspan.functions import values as V
from larkspan.operators.corpus import has_extension
from larkspan.operators.retrieval import chunk_table
from larkspan.plans.catalog import query
from larkspan.session import load

RUN_AT = "2024-05-06 07:08:09"


def _run_at() -> Column:
    return F.lit(RUN_AT).cast("timestamp")


def _pick(key: str, *choices: Column | str | None) -> Column:
    """One of the choices by the key's remainder; strings are literals."""
    chosen = F.lit(None).cast("string")
    for i, choice in enumerate(choices):
        value = choice if isinstance(choice, Column) else F.lit(choice)
        chosen = F.when(F.col(key) % len(choices) == i, value).otherwise(chosen)
    return chosen


def _pick_sql(key: str, *choices: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {choice}" for i, choice in enumerate(choices))
    return f"CASE {key} % {len(choices)} {cases} END"


FLAG_SQL = _pick_sql("c_custkey", "'Да'", "'да'", "'ДА'", "'1'", "'нет'", "''", "NULL", "c_mktsegment")


@query(f"SELECT c_custkey, t IN ('Да', 'да', 'ДА', '1') AS flag FROM (SELECT c_custkey, {FLAG_SQL} AS t FROM customer)")
def b1_flag_parse(spark: SparkSession, d: str) -> DataFrame:
    text = _pick("c_custkey", "Да", "да", "ДА", "1", "нет", "", None, F.col("c_mktsegment"))
    return load(spark, d, "customer").select("c_custkey", V.flag(text).alias("flag"))


NUMBER_SQL = _pick_sql(
    "c_custkey", "CAST(c_custkey AS VARCHAR)", "' ' || c_custkey || ' '", "''", "'x' || c_custkey", "c_custkey || '.5'",
    "NULL", "'-' || c_custkey", "'99999999999'",
)


@query(
    f"""SELECT c_custkey, TRY_CAST(CASE WHEN regexp_full_match(trim(t), '[+-]?[0-9]+') THEN trim(t) END AS INTEGER) AS number,
  t IS NOT NULL AND trim(t) <> '' AND TRY_CAST(CASE WHEN regexp_full_match(trim(t), '[+-]?[0-9]+') THEN trim(t) END AS INTEGER) IS NULL AS rejected,
  t IS NOT NULL AND TRY_CAST(CASE WHEN regexp_full_match(trim(t), '[+-]?[0-9]+') THEN trim(t) END AS INTEGER) IS NULL AS strict_rejected
FROM (SELECT c_custkey, {NUMBER_SQL} AS t FROM customer)"""
)
def b2_lenient_int(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    text = _pick(
        "c_custkey", key, F.concat(F.lit(" "), key, F.lit(" ")), "", F.concat(F.lit("x"), key),
        F.concat(key, F.lit(".5")), None, F.concat(F.lit("-"), key), "99999999999",
    )
    rows = load(spark, d, "customer").withColumn("t", text)
    return rows.select(
        "c_custkey",
        V.lenient_int(F.col("t")).alias("number"),
        F.coalesce(V.int_rejected(F.col("t")), F.lit(False)).alias("rejected"),
        V.int_rejected(F.col("t"), blank_allowed=False).alias("strict_rejected"),
    )


@query(
    """SELECT c_custkey, TRY_CAST(replace(replace(CAST(c_acctbal AS VARCHAR), '.', ','), ',', '.') AS DOUBLE) AS amount
FROM customer"""
)
def b3_comma_float(spark: SparkSession, d: str) -> DataFrame:
    text = F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(","))
    return load(spark, d, "customer").select("c_custkey", V.comma_float(text).alias("amount"))


@query("SELECT c_custkey, nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, '') AS renovation FROM customer")
def b4_blank_to_null(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    return load(spark, d, "customer").select("c_custkey", V.blank_to_null(text).alias("renovation"))


@query(
    "SELECT c_custkey, t <> '' AS flag FROM (SELECT c_custkey, "
    + _pick_sql("c_custkey", "'0'", "''", "NULL", "c_mktsegment")
    + " AS t FROM customer)"
)
def b5_truthiness(spark: SparkSession, d: str) -> DataFrame:
    text = _pick("c_custkey", "0", "", None, F.col("c_mktsegment"))
    return load(spark, d, "customer").select("c_custkey", V.non_empty(text).alias("flag"))


@query("SELECT p_partkey, replace(p_name, ' ', '') AS unit FROM part")
def b6_unit_normalise(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", V.squeeze_unit(F.col("p_name")).alias("unit"))


@query(
    """SELECT page_id, md5(regexp_replace(replace(replace(replace(html, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'),
  '&amp;?', '&', 'g')) AS md5 FROM pages"""
)
def b7_html_unescape(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", F.md5(X.unescape_html(F.col("html"))).alias("md5"))


@query(
    """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
  '&#39;', ''''), '&amp;', '&')) AS md5 FROM pages"""
)
def b7_core_entities(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", F.md5(X.unescape_core(F.col("html"))).alias("md5"))


LABEL_SQL = _pick_sql("p_partkey", "'ижс'", "'ДНП'", "'снт'", "p_type", "NULL", "'лпх'", "'УСН'")


@query(
    f"""SELECT p_partkey, CASE WHEN lower(t) IN ('ижс', 'днп', 'усн', 'лпх', 'снт') THEN upper(t) ELSE t END AS label
FROM (SELECT p_partkey, {LABEL_SQL} AS t FROM part)"""
)
def b12_canonical_label(spark: SparkSession, d: str) -> DataFrame:
    text = _pick("p_partkey", "ижс", "ДНП", "снт", F.col("p_type"), None, "лпх", "УСН")
    return load(spark, d, "part").select("p_partkey", V.canonical_label(text).alias("label"))


REGION_SQL = _pick_sql("c_custkey", "c_name || ' Республика'", "'Республика ' || c_name", "c_name || ' Республика край'",
                       "'А Республика Б Республика'")


@query(
    f"""SELECT c_custkey, CASE WHEN t LIKE '% Республика' THEN replace(t, ' Республика', ' республика') ELSE t END AS region
FROM (SELECT c_custkey, {REGION_SQL} AS t FROM customer)"""
)
def b13_region_name(spark: SparkSession, d: str) -> DataFrame:
    text = _pick(
        "c_custkey", F.concat("c_name", F.lit(" Республика")), F.concat(F.lit("Республика "), "c_name"),
        F.concat("c_name", F.lit(" Республика край")), F.lit("А Республика Б Республика"),
    )
    return load(spark, d, "customer").select("c_custkey", V.normal_region(text).alias("region"))


# A document's text as a file name: long, with every forbidden character of the data.
STEM_SQL = r"CASE WHEN regexp_matches({0}, '(?s)^.+\.[^.]+$') THEN regexp_extract({0}, '(?s)^(.+)\.[^.]+$', 1) ELSE {0} END"
SPACE_SQL = r"' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


@query(
    f"""WITH stems AS (SELECT doc_id, trim({STEM_SQL.format("text")}, {SPACE_SQL}) AS s FROM documents),
mapped AS (SELECT doc_id, left(regexp_replace(regexp_replace(translate(replace(s, '.', '_'),
  '<>:"/\\|?*' || chr(9) || chr(10) || chr(13), '()_''_____   '), '[ \\f\\x0b]+', ' ', 'g'), '_+', '_', 'g'), 200) AS s FROM stems)
SELECT doc_id, CASE WHEN s = '' THEN 'document' ELSE s END || '.docx' AS name FROM mapped"""
)
def b14_strict_clean_name(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", N.strict_clean(F.col("text")).alias("name"))


COPY_SQL = _pick_sql(
    "doc_id", "'_' || source || ' (' || doc_id || ')'", "source || '_' || doc_id", "source || '. '",
    "' ' || source || ' ' || doc_id || '..'", "lang || '2024_' || source || '(1)'", "text",
)
CLEAN_SQL = f"""rtrim(trim(regexp_replace(trim(rtrim(ltrim(trim(t, {SPACE_SQL}), '_'), '.'), {SPACE_SQL}),
  '[ \\t\\n\\r\\f\\x0b_]*\\(?[0-9]+\\)?$', ''), {SPACE_SQL}), '.')"""


def _copies(spark: SparkSession, d: str) -> DataFrame:
    text = _pick(
        "doc_id", F.concat(F.lit("_"), "source", F.lit(" ("), "doc_id", F.lit(")")),
        F.concat("source", F.lit("_"), "doc_id"), F.concat("source", F.lit(". ")),
        F.concat(F.lit(" "), "source", F.lit(" "), "doc_id", F.lit("..")),
        F.concat("lang", F.lit("2024_"), "source", F.lit("(1)")), F.col("text"),
    )
    return load(spark, d, "documents").select("doc_id", text.alias("t"))


@query(
    f"""SELECT doc_id, {CLEAN_SQL} AS base,
  lower(regexp_replace({CLEAN_SQL}, '[ \\t\\n\\r\\f\\x0b_]*[0-9]+$', '')) AS group_name
FROM (SELECT doc_id, {COPY_SQL} AS t FROM documents)"""
)
def b15_base_name(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    return _copies(spark, d).select("doc_id", N.base_clean(t).alias("base"), N.group_name(t).alias("group_name"))


FILE_SQL = _pick_sql(
    "doc_id", "source || '.' || lang || '.' || doc_id", "'.' || source", "source || '.'", "upper(source) || '.DOCX'",
    "source", "'..' || lang || '.d.1'",
)


def _file_names(spark: SparkSession, d: str) -> DataFrame:
    name = _pick(
        "doc_id", F.concat_ws(".", "source", "lang", "doc_id"), F.concat(F.lit("."), "source"),
        F.concat("source", F.lit(".")), F.concat(F.upper("source"), F.lit(".DOCX")), F.col("source"),
        F.concat(F.lit(".."), "lang", F.lit(".d.1")),
    )
    return load(spark, d, "documents").select("doc_id", name.alias("name"))


@query(
    f"""SELECT doc_id, lower({STEM_SQL.format("name")}) AS stem_key, regexp_extract(name, '(?s)^.+(\\.[^.]+)$', 1) AS suffix,
  CASE WHEN regexp_matches(name, '(?s)^\\.*[^.].*\\.[^.]*$') THEN regexp_extract(name, '(?s)^(\\.*[^.].*)\\.[^.]*$', 1) ELSE name END AS root,
  split_part(name, '.', 1) AS first_part
FROM (SELECT doc_id, {FILE_SQL} AS name FROM documents)"""
)
def b16_stem_keys(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("name")
    return _file_names(spark, d).select(
        "doc_id", F.lower(N.stem(name)).alias("stem_key"), N.suffix(name).alias("suffix"), N.root(name).alias("root"),
        N.first_part(name).alias("first_part"),
    )


@query(
    f"""SELECT doc_id, name, lower(regexp_extract(name, '(?s)^.+(\\.[^.]+)$', 1)) IN ('.doc', '.docx', '.rtf') AS valid
FROM (SELECT doc_id, {FILE_SQL} AS name FROM documents)
WHERE lower(regexp_extract(name, '(?s)^.+(\\.[^.]+)$', 1)) IN ('.doc', '.docx', '.rtf')"""
)
def c5_extension_whitelist(spark: SparkSession, d: str) -> DataFrame:
    valid = has_extension(F.col("name"))
    return _file_names(spark, d).where(valid).select("doc_id", "name", valid.alias("valid"))


URL_NAME_SQL = r"""coalesce(nullif(split_part(split_part(regexp_replace(regexp_replace(url,
  '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '(?s)[?#].*$', ''), '/', -1), ';', 1), ''), 'unnamed_file')"""


@query(
    f"""SELECT page_id, name, CASE WHEN regexp_matches(name, '(?s)^\\.*[^.].*\\.[^.]*$')
  THEN regexp_extract(name, '(?s)^(\\.*[^.].*)\\.[^.]*$', 1) ELSE name END || '.txt' AS text_name
FROM (SELECT page_id, {URL_NAME_SQL} AS name FROM pages)"""
)
def b17_url_file_name(spark: SparkSession, d: str) -> DataFrame:
    name = N.url_file_name(F.col("url"))
    return load(spark, d, "pages").select("page_id", name.alias("name"), N.text_file_name(name).alias("text_name"))


@query(
    r"""WITH p AS (SELECT page_id, split_part(url, '/', -1) AS last,
  CASE page_id % 3 WHEN 0 THEN 'a:b*"c" ' || page_id WHEN 1 THEN '' END AS shown FROM pages),
e AS (SELECT page_id, shown, coalesce(nullif(regexp_extract(last, '(?s)^\.*[^.].*(\.[^.]*)$', 1), ''), '.pdf') AS ext FROM p)
SELECT page_id, '20240506_070809_' || regexp_replace(CASE WHEN coalesce(shown, '') <> '' THEN shown || ext
  ELSE 'doc_20240506070809' END, '[\\/*?:"<>|]', '_', 'g') AS name FROM e"""
)
def b18_attachment_name(spark: SparkSession, d: str) -> DataFrame:
    shown = _pick("page_id", F.concat(F.lit('a:b*"c" '), "page_id"), "", None)
    return load(spark, d, "pages").select(
        "page_id", N.attachment_name(F.col("url"), shown, _run_at()).alias("name")
    )


@query(
    """SELECT page_id, CAST(n AS BIGINT) AS n, page_id * 10 + n AS id, 'https://ads.example/sale/flat/' || (page_id * 10 + n) || '/?from=list' AS link,
  url AS title, md5('Room ' || n || chr(10) || url) AS description, CASE WHEN n = 1 THEN 'a.jpg ' || page_id || '.jpg' ELSE '' END AS photos
FROM pages, (VALUES (0), (1)) v(n)"""
)
def b33_cards(spark: SparkSession, d: str) -> DataFrame:
    """Two cards around each page's own markup, one of them without a gallery."""

    def card(n: int) -> Column:
        number = (F.col("page_id") * 10 + n).cast("string")
        photos = F.concat(F.lit("<div data-name='Gallery'><ul><li><img src='a.jpg'></li><li><img alt='x' src='"), "page_id", F.lit(".jpg'></li></ul></div>"))
        return F.concat(
            F.lit("<article class='c' data-name='CardComponent'><div data-name='LinkArea'><a class='l' href='https://ads.example/sale/flat/"), number,
            F.lit("/?from=list'>more</a></div><span data-mark='OfferTitle' class='t'> <span>"), F.col("url"),
            F.lit(f"</span></span><div data-name='Description'><p class='d'>Room {n}\n"), F.col("url"), F.lit("</p></div>"),
            photos if n else F.lit(""), F.lit("</article>"),
        )

    page = F.concat(card(0), F.replace("html", F.lit("</html>"), F.lit("<article data-name='Other'></article>")), card(1))
    found = load(spark, d, "pages").select("page_id", F.posexplode(P.cards(page)).alias("n", "c"))
    return found.select(
        "page_id", F.col("n").cast("long").alias("n"), "c.id", "c.link", "c.title", F.md5("c.description").alias("description"),
        F.array_join("c.photos", " ").alias("photos"),
    )


@query(
    """SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, strlen(text) AS size FROM documents"""
)
def b20_checksums(spark: SparkSession, d: str) -> DataFrame:
    sums = X.checksums(F.col("text"))
    return load(spark, d, "documents").select(
        "doc_id", sums["md5"].alias("md5"), sums["sha256"].alias("sha256"),
        F.octet_length("text").cast("long").alias("size"),
    )


@query(
    """WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS fold),
bytes AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: CAST('0x' || p AS BIGINT)) AS b FROM documents)
SELECT doc_id, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(fold[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS crc32
FROM bytes, t"""
)
def b20_crc32(spark: SparkSession, d: str) -> DataFrame:
    """The SQL folds the bytes by a table that it derives from the polynomial."""
    return load(spark, d, "documents").select("doc_id", X.checksums(F.col("text"))["crc32"].alias("crc32"))


# Latin letters of the part names become Russian ones, which are then transliterated.
LATIN, RUSSIAN = "abvgdeziklmnoprstufhyjcwqx", "абвгдезиклмнопрстуфхыйцшщж"
ROMAN_SQL = "translate(replace(replace(replace(replace({0}, 'ж', 'zh'), 'ц', 'ts'), 'ш', 'sh'), 'щ', 'sch'), '{2}', '{1}')"


@query(
    "SELECT p_partkey, "
    + ROMAN_SQL.format(f"translate(p_name, '{LATIN}', '{RUSSIAN}')", LATIN[:22], RUSSIAN[:22])
    + " AS latin FROM part"
)
def b26_transliteration(spark: SparkSession, d: str) -> DataFrame:
    russian = F.translate("p_name", LATIN, RUSSIAN)
    return load(spark, d, "part").select("p_partkey", X.transliterate(russian).alias("latin"))


@query(
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' | ' ||
  CASE WHEN event_type = 'error' THEN '' ELSE props END ||
  CASE event_type WHEN 'view' THEN ' <фото>' WHEN 'click' THEN ' <документ>' ELSE '' END AS line FROM events"""
)
def b27_message_line(spark: SparkSession, d: str) -> DataFrame:
    media = F.when(F.col("event_type") == "view", "photo").when(F.col("event_type") == "click", "document")
    text = F.when(F.col("event_type") != "error", F.col("props"))
    line = C.message_line(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), text, media)
    return load(spark, d, "events").select("event_id", line.alias("line"))


@query(
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Личный чат' WHEN c_mktsegment = 'MACHINERY' THEN 'Группа'
  ELSE 'Канал' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'id' || c_custkey END AS chat FROM customer"""
)
def b28_chat_kind(spark: SparkSession, d: str) -> DataFrame:
    username = _pick("c_custkey", F.col("c_name"), "", None)
    segment = F.col("c_mktsegment")
    return load(spark, d, "customer").select(
        "c_custkey", C.chat_kind(segment == "BUILDING", segment == "MACHINERY").alias("kind"),
        C.chat_id(username, F.col("c_custkey")).alias("chat"),
    )


@query(
    """SELECT conv_id, turn, 'History: ' || CASE WHEN role = 'assistant' THEN 'Я' ELSE 'Пользователь' END || ': ' ||
  CASE WHEN turn % 4 = 0 THEN '<медиа-контент>' ELSE text END || ' -- reply' AS prompt FROM conversations"""
)
def b29_turn_prompt(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("turn") % 4 != 0, F.col("text"))
    line = C.turn_line(F.col("role") == "assistant", text)
    return load(spark, d, "conversations").select(
        "conv_id", "turn", C.prompt("History: {history} -- reply", line).alias("prompt")
    )


@query(
    r"""SELECT page_id, md5(regexp_replace(regexp_replace(t, '\\[a-z]+[0-9]*|\{[^}]+\}|\\''[0-9a-f]{2}', '', 'g'),
  '\n{3,}', chr(10) || chr(10), 'g')) AS md5
FROM (SELECT page_id, '{\rtf1 x}\par12 ' || replace(html, '><', '>' || chr(10) || '\''e9' || chr(10) || '\b' || chr(10) || '<') AS t FROM pages)"""
)
def b30_rtf_to_text(spark: SparkSession, d: str) -> DataFrame:
    rtf = F.concat(F.lit("{\\rtf1 x}\\par12 "), F.replace("html", F.lit("><"), F.lit(">\n\\'e9\n\\b\n<")))
    return load(spark, d, "pages").select("page_id", F.md5(X.rtf_to_text(rtf)).alias("md5"))


@query("SELECT page_id, md5(split_part(replace(html, '<h1>', '----------'), '----------', 1)) AS md5 FROM pages")
def b30_tool_rule(spark: SparkSession, d: str) -> DataFrame:
    text = F.replace("html", F.lit("<h1>"), F.lit(X.RTF_TOOL_RULE))
    return load(spark, d, "pages").select("page_id", F.md5(X.cut_at_rule(text)).alias("md5"))


@query(
    """SELECT doc_id, CASE WHEN source <> 'src1' AND text <> '' THEN 'first' WHEN lang = 'en' THEN 'second' END AS method,
  CASE WHEN source = 'src1' AND lang <> 'en' THEN 'first: no ' || source || '; second: no ' || lang END AS errors,
  md5(CASE WHEN source <> 'src1' THEN text WHEN lang = 'en' THEN upper(lang) END) AS md5 FROM documents"""
)
def b32_fallback_chain(spark: SparkSession, d: str) -> DataFrame:
    first = F.when(F.col("source") != "src1", F.col("text")).otherwise("")
    second = F.when(F.col("lang") == "en", F.upper("lang"))
    chain = [
        ("first", first, F.when(F.col("source") == "src1", F.concat(F.lit("no "), "source"))),
        ("second", second, F.when(second.isNull(), F.concat(F.lit("no "), "lang"))),
    ]
    return (
        load(spark, d, "documents")
        .select("doc_id", X.first_success(chain).alias("o"))
        .select("doc_id", "o.method", "o.errors", F.md5("o.text").alias("md5"))
    )


@query(
    r"""WITH c AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
  regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS heading, regexp_extract(html, '(?s)<p>(.*?)</p>', 1) AS description,
  regexp_extract_all(html, '<a href="([^"]*)"', 1) AS links FROM pages)
SELECT page_id, title, heading, md5(description) AS description, array_to_string(links, ' ') AS links,
  CAST(len(links) AS BIGINT) AS link_count FROM c"""
)
def b33_card_extraction(spark: SparkSession, d: str) -> DataFrame:
    card = P.page_card(F.col("html"))
    return (
        load(spark, d, "pages")
        .select("page_id", card.alias("c"))
        .select(
            "page_id", "c.title", "c.heading", F.md5("c.description").alias("description"),
            F.array_join("c.links", " ").alias("links"), F.size("c.links").cast("long").alias("link_count"),
        )
    )


CHUNKS = """words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0b]+'), lambda w: w <> '') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 300, 1), 400)) AS s FROM words WHERE len(w) > 0),
chunks AS (SELECT doc_id, CAST(s // 400 AS INTEGER) AS chunk_no, w[s + 1 : s + 700] AS tokens FROM starts)"""


@query(
    f"""WITH {CHUNKS} SELECT doc_id, chunk_no, CAST(len(tokens) AS BIGINT) AS n_tokens,
  md5(array_to_string(tokens, ' ')) AS md5 FROM chunks"""
)
def b34_token_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk_table(load(spark, d, "documents")).select(
        "doc_id", "chunk_no", F.size("tokens").cast("long").alias("n_tokens"),
        F.md5(F.array_join("tokens", " ")).alias("md5"),
    )


@query(
    """SELECT event_id, 'dataset_' || user_id || '_20240506_070809.zip' AS archive, '2024-05-06 07:08:09 | ' ||
  CASE WHEN event_type = 'error' THEN 'Ошибка' ELSE 'Успешно' END || ' | ' || event_id || '.docx | ' ||
  printf('%.2f', value) || ' сек' AS line FROM events"""
)
def b35_literals(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat("event_id", F.lit(".docx"))
    line = N.conversion_log_line(_run_at(), F.col("event_type") != "error", path, F.col("value"))
    return load(spark, d, "events").select(
        "event_id", N.archive_name(F.col("user_id"), _run_at()).alias("archive"), line.alias("line")
    )


@query(
    """SELECT conv_id, turn, text AS content, 'user' AS role, 'some-model' AS model, CAST(100 AS BIGINT) AS max_tokens,
  text AS answer, role || ',' || turn AS ids FROM conversations"""
)
def b36_api_payload(spark: SparkSession, d: str) -> DataFrame:
    """Request bodies are built and read back; responses are made of the same texts and parsed."""
    choice = F.struct(F.struct(F.col("text").alias("content")).alias("message"))
    models = F.array(F.struct(F.col("role").alias("id")), F.struct(F.col("turn").cast("string").alias("id")))
    body = load(spark, d, "conversations").select(
        "conv_id", "turn", C.request_payload("some-model", F.col("text"), 100).alias("request"),
        F.to_json(F.struct(F.array(choice).alias("choices"))).alias("response"),
        F.to_json(F.struct(models.alias("data"))).alias("listing"),
    )
    return body.select(
        "conv_id", "turn",
        F.get_json_object("request", "$.messages[0].content").alias("content"),
        F.get_json_object("request", "$.messages[0].role").alias("role"),
        F.get_json_object("request", "$.model").alias("model"),
        F.get_json_object("request", "$.max_tokens").cast("long").alias("max_tokens"),
        C.answer_text(F.col("response")).alias("answer"),
        F.array_join(C.model_ids(F.col("listing")), ",").alias("ids"),
    )


@query("SELECT page_id, contains(t, 'Captcha') AS anywhere, instr(t, 'Captcha') > 1 AS after_start FROM (SELECT page_id, "
       "CASE page_id % 3 WHEN 0 THEN 'Captcha ' || html WHEN 1 THEN replace(html, '<h1>', 'Captcha') ELSE html END AS t "
       "FROM pages)")  # fmt: skip
def c6_block_page(spark: SparkSession, d: str) -> DataFrame:
    text = _pick("page_id", F.concat(F.lit("Captcha "), "html"), F.replace("html", F.lit("<h1>"), F.lit("Captcha")),
                 F.col("html"))
    return load(spark, d, "pages").select(
        "page_id", X.is_block_page(text).alias("anywhere"), X.is_block_page_after_start(text).alias("after_start")
    )
