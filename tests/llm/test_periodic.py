import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspan.llm import QUERIES, periodic


def brute_runs(words, min_length=6, min_repeats=4):
    """Maximal stretches of every period, each with its smallest."""
    n, found = len(words), {}
    for q in range(1, n // min_repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_repeats * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        digest(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40).flatmap(lambda x: st.integers(1, 6).map(lambda k: x * k)), min_size=1, max_size=6))
def test_runs_equal_brute_force(documents):
    ends = np.cumsum([0, *map(len, documents)])
    codes = np.array([c for d in documents for c in d], np.int64)
    start, length, period = periodic.find_runs(codes, ends)
    want = [(int(ends[i]) + s, n, q) for i, d in enumerate(documents) for s, n, q in brute_runs(d)]
    assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == want


def test_long_texts_and_periods():
    rng = np.random.default_rng(1)
    for n, p in ((50_000, 1), (50_000, 12_500), (50_000, 12_501)):
        codes = np.tile(rng.permutation(p), n // p + 1)[:n].astype(np.int64)
        found = [a.tolist() for a in periodic.find_runs(codes, np.array([0, n]))]
        assert found == ([[0], [n], [p]] if 4 * p <= n else [[], [], []])


def test_extensions_equal_word_by_word():
    rng = np.random.default_rng(2)
    codes = np.append(np.tile(rng.integers(0, 3, 50), 8), -1).astype(np.int64)
    i, j = rng.integers(0, 400, (2, 3000))
    i, j = i[i != j], j[i != j]
    most = np.full(len(i), 500)
    padded = np.append(codes, -2 - np.arange(600))
    assert (periodic.Extensions(codes)(i, j) == periodic.equal_words(padded, i, j, most)).all()


def test_query_on_planted_texts(spark, tmp_path):
    random.seed(4)
    texts = [random.choice([" ", "\n", "  "]).join(random.choices("abé", k=random.randint(0, 60))) for _ in range(400)]
    table = [*enumerate(texts), (None, "a a a a a a a"), (5, None), (5, ""), (5, " \t"), (6, " a\x1ca b\x0bb "), (6, " a\x1ca b\x0bb ")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in table], "doc_id long, text string, runs string, kept string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = rows(QUERIES["op11_cover_runs"](spark, str(tmp_path)), *COLUMNS)
    assert found == sorted((brute_row(*r) for r in table), key=repr)


def test_query_on_the_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for row in QUERIES["op11_cover_runs"](spark, sf).select(COLUMNS).collect():
        if len(texts[row.doc_id].split()) < 1000:
            assert tuple(row) == brute_row(row.doc_id, texts[row.doc_id])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.periodic_runs(docs).count() == 0
