"""Removal of repeated byte strings against counting every string."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from larkspan.llm import repeats


def by_force(texts, length):
    count = Counter(d[i : i + length] for d in texts for i in range(len(d) - length + 1))
    out = []
    for data in texts:
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if count[data[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((len(data), int(gone.sum()), runs, bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return out


def found(spark, rows, **settings_):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "'z' AS spans", "2 AS core", "'z' AS row_key")
    out = repeats.without_repeats(docs, **settings_).collect()
    return sorted((r["id"] is None, r["id"] or 0, r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), bytes(r["kept"])) for r in out)


def corpus(seed, alphabet="abé \x00"):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [text(rng.randrange(15, 120)) for _ in range(5)]
    rows = [(None, None), (1, ""), (2, "é" * 90), (3, "ab" * 40), (4, "ab" * 40), (5, text(19))]
    for i in range(60):
        parts = [text(rng.randrange(60)) for _ in range(3)]
        rows.append((10 + i, parts[0] + rng.choice(passages) + parts[1] + rng.choice(["", rng.choice(passages)]) + parts[2]))
    rows += [rows[20], rows[20], (200, rows[21][1]), (None, rows[22][1])]
    return rows


@pytest.mark.parametrize(("seed", "settings_"), [(1, {"length": 20}), (2, {"length": 33}), (3, {"length": 20, "max_blocks": 3}), (4, {"length": 64})])
def test_equals_counting(spark, seed, settings_):
    rows = corpus(seed)
    wanted = by_force([(t or "").encode() for _, t in rows], settings_["length"])
    assert found(spark, rows, **settings_) == sorted((d is None, d or 0, *w) for (d, _), w in zip(rows, wanted, strict=True))


def test_near_copies_at_the_length_of_the_query(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(600)]
    rows = []
    for i in range(40):
        own = list(base)
        for _ in range(i % 9):
            own[rng.randrange(600)] = "changed"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(300))) for i in range(20)] + [(300, "x" * 3000), (301, "line of text\n" * 200)]
    wanted = by_force([t.encode() for _, t in rows], 400)
    assert found(spark, rows) == sorted((False, d, *w) for (d, _), w in zip(rows, wanted, strict=True))


def test_no_rows(spark):
    assert found(spark, []) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=40))
def test_multikey_order(strings):
    rank, shared = repeats.multikey_order(strings, 40)
    padded = [s.ljust(40, b"\0") for s in strings]
    order = np.argsort(rank)
    assert [padded[i] for i in order] == sorted(padded)
    for k in range(1, len(order)):
        a, b = padded[order[k - 1]], padded[order[k]]
        assert shared[k] == next((i for i in range(40) if a[i] != b[i]), 40)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=90).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=6), st.sampled_from([16, 24, 40]))
def test_equal_windows_have_equal_anchors(docs, length):
    docs = [d for d in docs if len(d) >= length]
    if not docs:
        return
    low, high, anchor = repeats._runs(np.frombuffer(b"".join(docs), np.uint8), np.cumsum([len(d) for d in docs]), length)
    joined, seen, windows = b"".join(docs), {}, 0
    for p, q, a in zip(low.tolist(), high.tolist(), anchor.tolist(), strict=True):
        for w in range(p, q + 1):
            assert 0 <= a - w < repeats.window_of(length)
            assert seen.setdefault(joined[w : w + length], a - w) == a - w
            windows += 1
    assert windows == sum(len(d) - length + 1 for d in docs)
