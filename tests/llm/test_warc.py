"""ARC files of both versions, and the WARC archives made from them."""

import gzip

import pytest
from larkspan.llm import warc
from larkspan.session import staging_path

ABOUT = b"1 0 AlexaInternet\n" + warc.ARC_FIELDS[1].encode() + b"\n"
PAGE = b"HTTP/1.0 200 OK\r\nX-Page-Id: 7\r\n\r\n<b>\xe9\r\n\r\n</b>"
V1 = (
    b"filedesc://old.arc 0.0.0.0 19960923142103 text/plain %d\n" % len(ABOUT) + ABOUT
    + b"\nhttp://a.example/ 192.0.2.1 19961104142103 text/html %d\n" % len(PAGE) + PAGE
    + b"\nhttp://b.example/ 192.0.2.2 1996110414 text/plain 5\nplain\n"
)


def v2(body):
    about = b"2 0 X\n" + warc.ARC_FIELDS[2].encode() + b"\n"
    first = b"filedesc://n.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 n.arc %d\n" % len(about)
    return first + about + b"\nhttp://c.example/ 192.0.2.3 20010102030405 text/html 200 - - 99 n.arc %d\n" % len(body) + body + b"\n"


def test_header_lines_of_both_versions():
    one = list(warc.arc_records(V1))
    assert [(f["URL"], len(b)) for _, f, b in one] == [("http://a.example/", len(PAGE)), ("http://b.example/", 5)]
    assert V1[one[0][0] :].startswith(b"http://a.example/")
    two = list(warc.arc_records(gzip.compress(v2(b"x\n\ny")[:40]) + gzip.compress(v2(b"x\n\ny")[40:])))
    assert [(f["Result-code"], b) for _, f, b in two] == [("200", b"x\n\ny")]
    assert list(warc.arc_records(b"")) == []


@pytest.mark.parametrize("broken", [V1[:-20], V1.replace(b"1 0 Alexa", b"3 0 Alexa"), V1.replace(b"192.0.2.1 ", b""), gzip.compress(V1)[:-30]])
def test_broken_archives_are_errors(broken):
    with pytest.raises(ValueError):
        list(warc.arc_records(broken))


def test_legacy_bytes_survive(spark, tmp_path):
    (tmp_path / "old.arc").write_bytes(V1)
    (tmp_path / "new.arc.gz").write_bytes(gzip.compress(v2(b"HTTP/1.0 200 OK\r\nX-Page-Id: 9\r\n\r\n<b>\xe9\r\n\r\n</b>")))
    out = staging_path(spark, "warc-test")
    warc.write_warc(spark, str(tmp_path), out)
    content = b"".join(r["content"] for r in spark.read.format("binaryFile").load(out).collect())
    records = {h["warc-target-uri"]: (h, b) for h, b in warc.warc_records(content)}
    assert records["http://c.example/"][1].endswith(b"<b>\xe9\r\n\r\n</b>")
    assert records["http://a.example/"][0]["warc-type"] == "revisit"
    assert records["http://a.example/"][0]["warc-refers-to"] == records["http://c.example/"][0]["warc-record-id"]
    assert records["http://a.example/"][0]["warc-date"] == "1996-11-04T14:21:03Z"
    assert records["http://b.example/"][0]["warc-date"] == "1996-11-04T14:00:00Z"
    assert records["http://b.example/"][0]["content-length"] == "5"
    rows = {r["page_id"]: r for r in warc.resolved(warc.read_warc(spark, out)).collect()}
    assert (rows[7]["payload_bytes"], rows[7]["refers_to"]) == (12, 9)


ROWS = [
    (1, "http://x/a b", "<p>one</p>"), (2, None, "<p>one</p>"), (2, "http://x/", "<p>one</p>"), (3, "u", None), (4, "", ""),
    (None, "http://n", "<p>one</p>"), (5, "http://é", "\r\n\r\n é 漢" * 40_000), (6, "h", "\nWARC/1.1\r\n\r\n"),
]


@pytest.mark.parametrize(("rows", "least"), [(ROWS, 0), (ROWS, 5), ([], 0), (ROWS[-1:], 0)])
def test_round_trip(spark, rows, least):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "'z' AS digest", "'z' AS value")
    arc, out = staging_path(spark, "arc"), staging_path(spark, "warc")
    warc.write_arc(pages.repartition(3), arc)
    warc.write_warc(spark, arc, out, min_bytes=least)
    found = warc.resolved(warc.read_warc(spark, out)).collect()
    wanted = sorted((p or 0, len((h or "").encode()), warc.digest_of((h or "").encode())) for p, _, h in rows)
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["digest"]) for r in found) == wanted
    for digest in {r["digest"] for r in found}:
        group = [r for r in found if r["digest"] == digest]
        responses = [r for r in group if r["type"] == "response"]
        if group[0]["payload_bytes"] < least:
            assert len(responses) == len(group)
            continue
        assert len(responses) == 1
        assert (responses[0]["page_id"] or 0) == max(r["page_id"] or 0 for r in group)
        assert all(r["refers_to"] == responses[0]["page_id"] for r in group if r["type"] == "revisit")
