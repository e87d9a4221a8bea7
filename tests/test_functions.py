"""Column functions on small literal inputs, one case per trap."""

import html

import pytest
from conftest import column
from pyspark.sql import functions as F

from larkspan.functions import chat as C
from larkspan.functions import names as N
from larkspan.functions import pages as P
from larkspan.functions import texts as X
from larkspan.functions import values as V


def test_flag(spark):
    assert column(spark, ["Да", "да", "ДА", "1", "нет", "дА", "", None], V.flag) == [True] * 4 + [False] * 3 + [None]


def test_lenient_int(spark):
    values = ["7", " 8 ", "-3", "", "x", "1.5", "99999999999", None]
    assert column(spark, values, V.lenient_int) == [7, 8, -3, None, None, None, None, None]
    assert column(spark, values, V.int_rejected) == [False, False, False, False, True, True, True, False]
    strict = column(spark, values, lambda v: V.int_rejected(v, blank_allowed=False))
    assert strict == [False, False, False, True, True, True, True, False]


def test_comma_float(spark):
    assert column(spark, ["1,5", "2.25", "", "a"], V.comma_float) == [1.5, 2.25, None, None]


def test_non_empty(spark):
    assert column(spark, ["0", "", "x", None], V.non_empty) == [True, False, True, None]


def test_squeeze_unit(spark):
    assert column(spark, ["кв. м"], V.squeeze_unit) == ["кв.м"]


def test_labels_and_regions(spark):
    assert column(spark, ["ижс", "СНТ", "дача", None], V.canonical_label) == ["ИЖС", "СНТ", "дача", None]
    regions = ["Чеченская Республика", "Республика Коми", "А Республика Б Республика"]
    assert column(spark, regions, V.normal_region) == ["Чеченская республика", "Республика Коми", "А республика Б республика"]


def test_unit_prices(spark):
    cases = [(100.0, None, 3.0), (None, 50.0, 4.0), (None, None, 5.0), (7.0, None, 0.0), (-10.0, None, 3.0)]
    frame = spark.createDataFrame(cases, "p double, m double, a double")
    got = [r[0] for r in frame.select(V.whole_unit_price(F.col("p"), F.col("m"), F.col("a"))).collect()]
    assert got == [33, 12, 0, None, -3]


def test_joined_address(spark):
    frame = spark.createDataFrame([("a", "1"), ("a", None), (None, None)], "s string, h string")
    assert [r[0] for r in frame.select(V.joined_address(F.col("s"), F.col("h"))).collect()] == ["a 1", "a", None]


def test_district_address(spark):
    texts = [["Москва", "р-н Юг", "р-н Юг, Москва", "р-н 2, Москва"], ["р-н, Москва" + "x" * 250], []]
    got = column(spark, texts, lambda v: V.district_address(v, F.lit("Москва")), "array<string>")
    assert got == ["р-н Юг, Москва", "", ""]


NAMES = ["a.doc", "A.docx", ".txt", "x.d.1", "noext", "a.", "..a", "...", "a..b", "report_2024.docx", ""]


def test_stems_follow_pathlib_and_splitext(spark):
    import os.path

    def parts(name):
        # pathlib's rule: the dot must have a character on both sides.
        at = name.rfind(".")
        return (name[:at], name[at:]) if 0 < at < len(name) - 1 else (name, "")

    assert column(spark, NAMES, N.stem) == [parts(n)[0] for n in NAMES]
    assert column(spark, NAMES, N.suffix) == [parts(n)[1] for n in NAMES]
    assert column(spark, NAMES, N.root) == [os.path.splitext(n)[0] for n in NAMES]
    assert column(spark, NAMES, N.extension) == [os.path.splitext(n)[1] for n in NAMES]
    assert column(spark, NAMES, N.first_part) == [n.split(".")[0] for n in NAMES]


@pytest.mark.parametrize(
    ("name", "clean"),
    [
        (" a<b>.doc", "a(b).docx"),
        ('x:"y"|z?*.docx', "x_'y'_z_.docx"),
        ("a.b.c.doc", "a_b_c.docx"),
        ("tab\t\t and  blank.doc", "tab and blank.docx"),
        ("__a___b.doc", "_a_b.docx"),
        ("???", "_.docx"),
        ("  ", "document.docx"),
        ("", "document.docx"),
        ("n" * 250 + ".doc", "n" * 200 + ".docx"),
    ],
)
def test_strict_clean(spark, name, clean):
    assert column(spark, [name], N.strict_clean) == [clean]


def test_base_clean(spark):
    stems = ["a (1)", "a_2", "_a", "report_2024", "a..", "2024", "a 1 (2)", "А. "]
    assert column(spark, stems, N.base_clean) == ["a", "a", "a", "report", "a", "", "a 1", "А"]
    assert column(spark, stems, N.group_name) == ["a", "a", "a", "report", "a", "", "a", "а"]


@pytest.mark.parametrize(
    ("url", "name"),
    [
        ("https://h/a/b.doc?x=1#t", "b.doc"),
        ("https://h/a/b.doc;p=1", "b.doc"),
        ("https://h/a/", "unnamed_file"),
        ("https://h", "unnamed_file"),
        ("https://h/документ 1.pdf", "документ 1.pdf"),
        ("https://h/%D0%B0.pdf", "%D0%B0.pdf"),
        ("https://h/x;v=1/y", "y"),
        ("https://h/.hidden", ".hidden"),
    ],
)
def test_url_file_name(spark, url, name):
    assert column(spark, [url], N.url_file_name) == [name]


def test_attachment_name(spark):
    frame = spark.createDataFrame(
        [("http://h/a.doc", "акт: 1"), ("http://h/a", "x"), ("http://h/a.doc", ""), ("http://h/a.doc?b=1", "y")], "u string, n string"
    )
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    got = [r[0] for r in frame.select(N.attachment_name(F.col("u"), F.col("n"), at)).collect()]
    assert got == [
        "20240102_030405_акт_ 1.doc",
        "20240102_030405_x.pdf",
        "20240102_030405_doc_20240102030405",
        "20240102_030405_y.doc_b=1",
    ]


def test_unescape(spark):
    values = ["&amp;lt;", "&lt;b&gt; &quot;x&quot; &#39;", "&nbsp;&copy;&amp", None]
    assert column(spark, values, X.unescape_html) == [html.unescape(v) if v else v for v in values]
    assert column(spark, values[:2], X.unescape_core) == [html.unescape(v) for v in values[:2]]


def test_transliterate(spark):
    assert column(spark, ["Щука жюри Ёлка объём", "Эхо, ЦЫц Яhoo"], X.transliterate) == [
        "Schuka zhjuri Elka ob'em",
        "Eho, TsYts Jahoo",
    ]


def test_rtf(spark):
    text = "{\\rtf1\\ansi}\\par Привет\\'e9 {x}мир\n\n\n\nend"
    assert column(spark, [text], X.rtf_to_text) == [" Привет мир\n\nend"]
    assert column(spark, ["a----------b----------"], X.cut_at_rule) == ["a"]


@pytest.mark.parametrize("count", [0, 1, 300, 301, 400, 699, 700, 701, 1099, 1100, 1101, 2500])
def test_chunks_cover_the_text(spark, count):
    words = [f"w{i}" for i in range(count)]
    got = column(spark, [" \n".join(words) + " "], lambda v: X.tokens(v))[0]
    assert got == words
    parts = column(spark, [words], X.chunks, "array<string>")[0]
    starts = [i for i in range(0, max(count, 1), 400) if count and (i == 0 or i + 300 < count)]
    assert parts == [words[s : s + 700] for s in starts]
    assert set().union(*parts) == set(words) if words else parts == []


def test_first_success(spark):
    frame = spark.createDataFrame([("", "b", "e1", None), (None, "", "e1", "e2"), ("a", "b", None, None)], "t1 string, t2 string, e1 string, e2 string")
    chain = X.first_success([("one", F.col("t1"), F.col("e1")), ("two", F.col("t2"), F.col("e2"))])
    got = [tuple(r["o"]) for r in frame.select(chain.alias("o")).collect()]
    assert got == [("b", "two", None), (None, None, "one: e1; two: e2"), ("a", "one", None)]


def test_messages(spark):
    frame = spark.createDataFrame([("t", "photo"), (None, "document"), ("a | b", None)], "text string, kind string")
    lines = [r[0] for r in frame.select(C.message_line(F.lit("2024"), F.col("text"), F.col("kind"))).collect()]
    assert lines == ["2024 | t <фото>", "2024 |  <документ>", "2024 | a | b"]
    assert column(spark, lines + ["free line"], C.line_date) == ["2024", "2024", "2024", ""]
    assert column(spark, ["x", "", None], lambda v: C.chat_id(v, F.lit(5))) == ["x", "id5", "id5"]
    assert column(spark, ["@x", "y"], C.log_name) == ["x.log", "y.log"]
    assert column(spark, ["x", "", None], lambda v: C.turn_line(F.lit(True), v)) == ["Я: x", "Я: <медиа-контент>", "Я: <медиа-контент>"]


CARD = """<article data-name='CardComponent'><div data-name='LinkArea'><a href='https://h/sale/123/'>x</a>
<span data-mark='OfferTitle'><span>Flat &amp; view</span></span></div>
<div data-name='Gallery'><ul><li><img src='a.jpg'></li><li><img src="b.jpg"/></li></ul></div>
<div data-name='Description'><p>Nice
flat</p></div></article>"""


def test_cards(spark):
    got = column(spark, ["<div>" + CARD + CARD.replace("123", "124") + "</div>"], P.cards)[0]
    assert [tuple(c) for c in got] == [
        (n, f"https://h/sale/{n}/", "Flat &amp; view", "Nice\nflat", ["a.jpg", "b.jpg"]) for n in (123, 124)
    ]
