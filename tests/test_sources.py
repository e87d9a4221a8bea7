"""Feeds, dumps, logs and binary documents from literal fixtures."""

import gzip
import hashlib
import io
import json
import tracemalloc
import zipfile
import zlib

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from larkspan.operators import registry as R
from larkspan.operators.listings import keep_rule
from larkspan.operators.lookups import strict_lookup, unknown_names
from larkspan.plans import sources as plans
from larkspan.sources import feeds, files, lines, tables

FEED = """<?xml version="1.0" encoding="utf-8"?><realty-feed><generation-date>2024-01-01</generation-date>
<offer internal-id="1"><category>квартира</category><payed-adv>0</payed-adv><location><country>Россия</country>
<locality-name>Москва</locality-name><locality-name>ул. 1</locality-name><locality-name>дом 2</locality-name><district>ЦАО</district>
<latitude>55,7</latitude><metro><name>Центр</name><time-on-foot>7</time-on-foot></metro></location>
<price><value>100,5</value><currency>USD</currency><currency>RUB</currency></price><area><value>30.5</value><unit>кв. м</unit></area>
<sales-agent><phone>+7 1</phone><agency-id>9</agency-id></sales-agent><image> a.jpg </image><image>b.jpg</image>
<rooms></rooms><floor>3</floor><lift>да</lift><studio>нет</studio><phone>1</phone><renovation></renovation>
<description>x &amp;lt;b&amp;gt;</description></offer>
<offer internal-id="2"><category>квартира</category><location><country>Россия</country><region>Московская</region>
<locality-name></locality-name><locality-name>Химки</locality-name></location><floor></floor><rooms>2</rooms><image>c.jpg</image></offer>
<offer internal-id="3"><location><country>Россия</country><locality-name>Москва</locality-name></location></offer>
<offer internal-id="4"><category>квартира</category><location><locality-name>Москва</locality-name><address>дом 7</address></location></offer>
<offer internal-id="5"><category>квартира</category><location><country>Россия</country><region>Тульская</region></location></offer>
</realty-feed>"""


@pytest.fixture(scope="module", params=["feed.xml", "feed.xml.gz"])
def feed(request, spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("feed") / request.param
    data = FEED.encode()
    path.write_bytes(gzip.compress(data) if request.param.endswith("gz") else data)
    return str(path)


def test_offers(spark, feed):
    flat = feeds.flat_offers(feeds.read_offers(spark, feed, partitions=2))
    got = {r["id"]: r.asDict() for r in flat.collect()}
    first = got[1]
    assert first["payed_adv"] is True
    assert first["location_locality_name"] == "Москва"
    assert first["location_address"] == "дом 2"
    assert first["location_latitude"] == 55.7
    assert first["location_metro_time_on_foot"] == 7
    assert (first["price_value"], first["price_currency"]) == (100.5, "RUB")
    assert (first["area_value"], first["area_unit"]) == (30.5, "кв.м")
    assert (first["sales_agent_phone"], first["sales_agent_agency_id"]) == ("+7 1", 9)
    assert first["image"] == ["a.jpg", "b.jpg"]
    assert first["rooms"] is None
    assert (first["lift"], first["studio"], first["phone"], first["internet"]) == (True, False, True, None)
    assert first["renovation"] is None
    assert first["description"] == "x <b>"
    assert first["rejected_fields"] == []
    assert not any("district" in name for name in flat.columns)
    assert got[2]["location_locality_name"] == "Химки"
    assert got[2]["location_address"] is None
    assert got[2]["image"] == ["c.jpg"]
    assert got[2]["rejected_fields"] == ["floor"]
    assert got[4]["location_address"] == "дом 7"
    assert feeds.offer_count(spark, feed).first()["offers"] == 5


def test_keep_rule(spark, feed):
    flat = feeds.flat_offers(feeds.read_offers(spark, feed))
    rule = keep_rule(
        F.col("category"), F.col("location_country"), F.col("location_locality_name"), F.col("location_region")
    )
    assert rows(flat.where(rule), "id") == [(1,), (2,)]


def test_feed_sample(spark, feed, tmp_path):
    path = str(tmp_path / "sample")
    feeds.write_offers(feeds.feed_sample(feeds.read_offers(spark, feed), 2), path)
    again = feeds.flat_offers(feeds.read_offers(spark, path))
    assert rows(again, "id", "location_address") == [(1, "дом 2"), (2, None)]


def test_records_are_parsed_once(spark, feed):
    flat = feeds.flat_offers(feeds.read_offers(spark, feed))
    assert flat._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1


def test_offers_are_written_a_line_each(spark, feed, tmp_path):
    path = tmp_path / "lines"
    feeds.write_offers(feeds.read_offers(spark, feed).coalesce(1), str(path))
    (part,) = path.glob("part-*")
    text = part.read_text(encoding="utf-8")
    assert sum(line.startswith("<offer ") for line in text.splitlines()) == 5
    assert ">\n    <" not in text


def test_damaged_feed_is_written_once(spark, tmp_path, monkeypatch):
    orders = [(7, "O", 1.5, "1-URGENT", 3), (8, "F", 2.5, "5-LOW", 4), (11, "O", 3.5, "5-LOW", 5), (None, "F", 4.5, "5-LOW", 6)]
    kind = "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string, o_custkey long"
    spark.createDataFrame(orders, kind).write.parquet(str(tmp_path / "orders.parquet"))
    labels, staging = [], plans.staging_path
    monkeypatch.setattr(plans, "staging_path", lambda session, label: labels.append(label) or staging(session, label))
    path = plans.damaged_feed(spark, str(tmp_path))
    assert labels == ["damaged"]
    offers = feeds.read_offers(spark, path)
    got = [(r["id"], r["rejected_fields"]) for r in feeds.flat_offers(offers).collect()]
    assert sorted(got, key=str) == [(8, ["floor"]), (None, ["floor"]), (None, ["id", "rooms"])]
    assert feeds.malformed(offers).count() == 1
    assert feeds.offer_count(spark, path).first()["offers"] == 4


def test_records_between_odd_elements(spark, tmp_path):
    path = tmp_path / "odd.xml"
    path.write_text('<r><offers/><offer internal-id="1"/>x<offer internal-id="2"><rooms>1</rooms></offer><offer><offer internal-id="3"></offer></r>')
    got = [r["record"] for r in feeds._records(spark, str(path), "offer").collect()]
    assert sorted(got, key=len) == ["<offer>", '<offer internal-id="1"/>', '<offer internal-id="3"></offer>', '<offer internal-id="2"><rooms>1</rooms></offer>']


def test_archive_texts_in_small_frames():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr(files.MAIN_PART, "<w:p><w:t>" + "x" * 100 + "</w:t></w:p>")
    batch = pd.Series([buffer.getvalue(), None] * 5)
    frames = list(files.archive_texts(iter([batch]), limit=300))
    assert max(len(f) for f in frames) < 5
    assert [t is None for f in frames for t in f["run_text"]] == [False, True] * 5


COMPLEXES = """<newobjects><newobject id="1"><name>A</name><region>Чеченская Республика</region><address>x</address>
<houses><house Id="11"><name>h1</name><address>a1</address></house><house Id="12"><name>h2</name><address>a2</address></house></houses></newobject>
<newobject id="2"><name>B</name><region>Нигде</region><address>y</address><houses/></newobject></newobjects>"""


def test_complexes(spark, tmp_path):
    path = tmp_path / "c.xml"
    path.write_text(COMPLEXES, encoding="utf-8")
    nested = feeds.read_complexes(spark, str(path))
    assert rows(feeds.houses(nested)) == [(1, 11, "h1", "a1"), (1, 12, "h2", "a2")]
    dictionary = spark.createDataFrame([("Чеченская республика", 95)], "name string, id int")
    parents = feeds.complexes(nested)
    assert rows(unknown_names(parents, dictionary, "region"), "id") == [(2,)]
    assert rows(strict_lookup(parents.where("id = 1"), dictionary, "region"), "id", "region_id") == [(1, 95)]
    with pytest.raises(Exception, match="unknown region: Нигде"):
        strict_lookup(parents, dictionary, "region").collect()


DUMP = [
    '{"category": "Долевое", "attachments": [{"link": "http://h/1.doc", "displayName": "акт"}]}',
    "",
    ",",
    ',,{"category": "о долевом", "attachments": [{"link": "http://h/1.doc"}, {"link": "https://h/2"}]}',
    '{"category": "долевое", "attachments": [{"link": "http://h/3"}]},',
    '{"category": "долевое"} trailing',
    "{bad",
    '["долевое"]',
    '{"category": null, "attachments": [{"link": "http://h/4"}]}',
    '{"category": 5}',
    '{"category": "долевое"}',
    '{"category": "долевое", "attachments": ["http://h/5", {"link": 6}, {"link": "ftp://h/7"}, {"x": 1}]}',
    '{"category": "долевое", "attachments": [{"link": "http://h/known"}]}',
    '{"a":1},{"b":2}',
    '{"a":1}],[{"b":2}',
    '{"a":1},"w":3',
    '"долевое"',
    "12",
    "null",
    "{} {}",
    "{}]",
    "{}}",
    ' {"category": "прочее"} ',
]


def _python_valid(line):
    try:
        json.loads(line.lstrip(","))
        return True
    except ValueError:
        return False


def test_json_lines_and_funnel(spark, tmp_path):
    path = tmp_path / "dump.json"
    path.write_text("\n".join(DUMP), encoding="utf-8")
    items = lines.read_json_lines(spark, str(path))
    got = {r["line"]: r["is_json"] for r in items.collect()}
    kept = [line for line in DUMP if line.strip() not in ("", ",")]
    assert got == {line.lstrip(","): _python_valid(line) for line in kept}
    assert items.count() == len(kept)

    known = spark.createDataFrame([("http://h/known",)], "url string")
    funnel = R.funnel(items, known).first().asDict()
    assert funnel == {
        "total": len(kept),
        "valid_json": sum(map(_python_valid, kept)),
        "matching_category": 5,
        "has_attachments": 4,
        "valid_links": 4,
        "new_links": 2,
        "existing_links": 2,
    }
    levels = [funnel[k] for k in R.FUNNEL[:4]]
    assert levels == sorted(levels, reverse=True)
    assert funnel["valid_links"] == funnel["new_links"] + funnel["existing_links"]

    links = R.attachment_rows(R.categorised(items))
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    registry = rows(R.registry_rows(links, known, at), "url", "original_file_name", "txt_file_name")
    assert registry == [
        ("http://h/1.doc", "20240102_030405_акт.doc", "20240102_030405_акт.doc.txt"),
        ("https://h/2", "20240102_030405_doc_20240102030405", "20240102_030405_doc_20240102030405.txt"),
    ]


def test_link_list(spark, tmp_path):
    path = tmp_path / "links.txt"
    path.write_text("\n".join(["http://h/0", "", " http://h/2 ", "ftp://h", "https://h/4"]), encoding="utf-8")
    numbered = lines.numbered_lines(spark, str(path))
    assert rows(lines.links(numbered, skip=1)) == [(2, "http://h/2"), (4, "https://h/4")]
    assert rows(lines.links(numbered, skip=100)) == []


def test_line_numbers_over_many_splits(spark, tmp_path):
    path = tmp_path / "many.txt"
    path.write_text("\n".join(f"http://h/{i}" for i in range(5000)), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = lines.numbered_lines(spark, str(path))
        assert got.where("value <> concat('http://h/', line_no)").isEmpty()
        assert got.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_damaged_files(spark):
    log = ["x Ошибка конвертации a b.docx: why", "Ошибка конвертации c.doc: x", "Ошибка конвертации c.doc: y", "ok d.docx:"]
    frame = spark.createDataFrame([(v,) for v in log], "value string")
    assert rows(lines.damaged_files(frame)) == [("a b.docx",), ("c.doc",)]


def archive(**parts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return buffer.getvalue()


def test_documents(spark, tmp_path):
    body = "<w:p><w:r><w:t>Первый</w:t></w:r><w:r><w:t xml:space='preserve'>второй</w:t></w:r></w:p>"
    good = archive(word__document=body, word__header1="<w:t>head</w:t>")
    cases = {
        "good.docx": good,
        "other.zip": archive(custom__x="<w:t>hidden</w:t>"),
        "empty.zip": archive(custom__x="nothing"),
        "cut.docx": good[:40],
        "old.doc": bytes.fromhex("D0CF11E0A1B11AE1") + b"data",
        "text.rtf": "{\\rtf1}\\par Текст".encode() + b"\xff",
        "none": b"",  # Spark lists no empty files
    }
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    found = {r["name"]: r for r in files.documents(files.contents(spark, str(tmp_path))).collect()}
    assert {n: r["format"] for n, r in found.items()} == {
        "good.docx": "docx", "other.zip": "unknown", "empty.zip": "unknown", "cut.docx": "unknown",
        "old.doc": "doc", "text.rtf": "rtf",
    }
    assert found["good.docx"]["text"] == "Первый второй\nhead"
    assert found["other.zip"]["text"] == "hidden"
    assert found["text.rtf"]["text"] == " Текст"
    assert "damaged archive" in found["cut.docx"]["errors"]
    assert "no text in the archive" in found["empty.zip"]["errors"]
    assert found["old.doc"]["errors"] == "rtf: no method for doc"

    listing = rows(files.inventory(spark, str(tmp_path), glob="*.doc*"), "name", "size")
    assert listing == [("cut.docx", 40), ("good.docx", len(good)), ("old.doc", 12)]


def test_empty_files_by_file_and_pattern(spark, tmp_path):
    folder = tmp_path / "in x"
    folder.mkdir()
    for name, content in {"a.txt": b"", "b.txt": b"bb", "c.doc": b"", "_hidden.txt": b""}.items():
        (folder / name).write_bytes(content)
    listed = lambda *a, **k: rows(files.inventory(spark, *a, **k), "name", "size")
    assert listed(str(folder / "a.txt")) == [("a.txt", 0)]
    assert listed(str(folder / "*.txt")) == [("a.txt", 0), ("b.txt", 2)]
    assert listed(str(folder / "*"), glob="*.doc") == [("c.doc", 0)]
    assert listed(str(tmp_path / "in*")) == [("a.txt", 0), ("b.txt", 2), ("c.doc", 0)]


def test_digests_of_files_larger_than_a_piece(spark, tmp_path):
    folder = tmp_path / "in x"
    folder.mkdir()
    contents = {"a.bin": b"", "b.bin": bytes(range(256)) * 1000, "c д.bin": b"x" * 4096, "d%20.bin": b"1"}
    for name, content in contents.items():
        (folder / name).write_bytes(content)
    found = {r["name"]: (r["size"], r["md5"], r["sha256"], r["crc32"]) for r in files.digests(spark, str(folder), piece=4096).collect()}
    assert found == {
        n: (len(c), hashlib.md5(c).hexdigest(), hashlib.sha256(c).hexdigest(), zlib.crc32(c)) for n, c in contents.items()
    }


def test_digest_holds_a_piece_of_the_file_only(tmp_path):
    place = tmp_path / "large"
    with open(place, "wb") as file:
        file.truncate(64 << 20)
    tracemalloc.start()
    try:
        assert files._digest(f"file:{place}", 1 << 16)[0] == hashlib.md5(bytes(64 << 20)).hexdigest()
        tracemalloc.reset_peak()
        files._digest(f"file:{place}", 1 << 16)
        assert tracemalloc.get_traced_memory()[1] < 4 << 20
    finally:
        tracemalloc.stop()


def test_leaves_keep_order_and_unknown_elements(spark, tmp_path):
    offers = [
        '<offer internal-id="1"><location><address>A</address><locality-name></locality-name><locality-name>B</locality-name></location><view>1</view><view> 2 </view></offer>',
        '<offer internal-id="2"><location><locality-name>B</locality-name><locality-name>C</locality-name><address>A</address><district>D</district></location></offer>',
        '<offer internal-id="3"><location><address>A</address><locality-name>B</locality-name><locality-name>C</locality-name></location><image>x</image><image>y</image></offer>',
        '<offer internal-id="4"><rooms>2</offer>',
        '<offer internal-id="5"/>',
        '<offer internal-id="x6"><rooms>&lt;3</rooms><a><b>mixed<c>&#65;</c></b></a></offer>',
    ]
    path = tmp_path / "feed.xml"
    path.write_text("<realty-feed>" + "\n".join(offers) + "</realty-feed>", encoding="utf-8")
    leaves = feeds.read_leaves(spark, str(path))
    assert rows(feeds.malformed(leaves)) == [(offers[3],)]
    flat = {r["id"]: r for r in feeds.flat_leaves(leaves).collect()}
    assert [flat[i]["location_address"] for i in (1, 2, 3, 5)] == ["A", "A", "C", None]
    assert [flat[i]["location_locality_name"] for i in (1, 2, 3, 5)] == ["B", "B", "B", None]
    assert flat[1]["other"] == {"view": "2"} and flat[2]["other"] == {} and flat[None]["other"] == {"a/b/c": "A"}
    assert flat[3]["image"] == ["x", "y"] and flat[1]["image"] is None
    assert sorted(flat[None]["rejected_fields"]) == ["id", "rooms"]
    paths = {r["path"]: (r["records"], r["most"]) for r in feeds.leaf_paths(leaves).collect()}
    assert paths["view"] == (1, 2) and paths["location/locality-name"] == (3, 2) and paths["_internal-id"] == (5, 1)


def test_operation_log(spark, tmp_path):
    log = spark.createDataFrame(
        [("t", "CONVERT", 'a "b", c.doc', None, "doc", "ERROR", "line\nbreak")], ", ".join(f"{c} string" for c in tables.LOG_COLUMNS)
    )
    path = str(tmp_path / "log")
    tables.write_log(log, path)
    tables.write_log(log, path)
    got = rows(tables.read_log(spark, path), "source_file", "error")
    assert got == [('a "b", c.doc', "line\nbreak")] * 2
