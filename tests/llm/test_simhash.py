"""Fingerprints, bit-sliced links and components against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from larkspan.llm import simhash


def plain_fingerprint(text, words=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not parts:
        return 0
    runs = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints, radius=2):
    """Smallest index reachable of each print."""
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def test_fingerprints():
    rng = random.Random(3)
    texts = [None, "", " \n", "One", "one TWO", "É é\x0bß", "a " * 700, " ".join(str(rng.random()) for _ in range(1300))]
    texts += [" ".join(rng.choice(["x", "Y", "zé", "w."]) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    found = simhash._fingerprints(texts, 3, 2)
    assert [int.from_bytes(f[:8], "big") for f in found] == [plain_fingerprint(t) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.lists(st.integers(0, 63), max_size=5)), min_size=1, max_size=90), st.sampled_from([0, 1, 2, 5]))
def test_bucket_links(items, radius):
    items = sorted({(b, sum({1 << x for x in flips})) for b, flips in items})
    buckets = np.array([b for b, _ in items])
    links = simhash.bucket_links(buckets, [p.to_bytes(8, "big") for _, p in items], radius)
    for i, j in links:
        assert items[i][0] == items[j][0] and (items[i][1] ^ items[j][1]).bit_count() <= radius
    for b in set(buckets.tolist()):
        own = [i for i in range(len(items)) if items[i][0] == b]
        wanted = plain_components([items[i][1] for i in own], radius)
        root = {i: i for i in own}
        for i, j in links:
            if i in root:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if r == old else r for k, r in root.items()}
        assert [own.index(root[i]) for i in own] == wanted


def near_prints(count, seed):
    rng = random.Random(seed)
    prints = {0}
    while len(prints) < count:
        base = rng.choice(sorted(prints)) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randrange(5)):
            base ^= 1 << rng.randrange(64)
        prints.add(base)
    return sorted(prints)


@pytest.mark.parametrize("max_bucket", [20_000, 4])
def test_links_and_components(spark, max_bucket):
    prints = near_prints(400, 9)
    nodes = spark.createDataFrame([(i, bytearray(p.to_bytes(8, "big"))) for i, p in enumerate(prints)], "node long, fingerprint binary")
    links = simhash.links_between(nodes, simhash.exact_tables(64, 2), 2, True, max_bucket)
    reach = {r["node"]: r["component"] for r in simhash.components(links).collect()}
    assert [reach.get(i, i) for i in range(len(prints))] == plain_components(prints)


def test_long_chain_of_components(spark):
    order = random.Random(1).sample(range(300), 300)
    links = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(500, 501), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in simhash.components(links).collect()}
    assert {found.get(i, i) for i in range(300)} == {0} and found[501] == 500


WORDS = [f"w{i}" for i in range(400)]


def corpus():
    rng = random.Random(4)
    rows = [(100, None), (3, ""), (None, "only here"), (None, "only here"), (50, "A b c"), (51, "a B  c\n"), (51, "a B  c\n")]
    for group in range(6):
        base = [rng.choice(WORDS) for _ in range(300)]
        for copy in range(5):
            changed = list(base)
            for _ in range(copy):
                changed[rng.randrange(300)] = rng.choice(WORDS)
            rows.append((1000 + group * 10 + copy, " ".join(changed)))
    return rows + [(5000 + i, " ".join(rng.choice(WORDS) for _ in range(120))) for i in range(40)]


def test_clusters(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "'z' AS bucket", "0 AS node")
    found = simhash.clusters(docs).collect()
    assert len(found) == len(rows)
    by_print = defaultdict(list)
    for doc, text in rows:
        by_print[plain_fingerprint(text)].append(doc)
    prints = sorted(by_print)
    root = plain_components(prints)
    smallest = defaultdict(list)
    for p, r in zip(prints, root, strict=True):
        smallest[r] += [d for d in by_print[p] if d is not None]
    wanted = {p: min(smallest[r], default=None) for p, r in zip(prints, root, strict=True)}
    for r in found:
        assert r["component_id"] == wanted[int.from_bytes(r["fingerprint"], "big")]
    assert sum(r["component_id"] is None for r in found) == 2
    assert simhash.clusters(docs.limit(0)).count() == 0


@pytest.mark.parametrize("max_bucket", [20_000, 3])
def test_wide_fingerprints_find_similar_texts(spark, max_bucket):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    found = simhash.clusters(docs, words=5, lanes=4, radius=40, tables=simhash.band_tables(256), max_bucket=max_bucket).collect()
    groups = {r["id"]: r["component_id"] for r in found}
    for group in range(6):
        assert len({groups[1000 + group * 10 + c] for c in range(4)}) == 1
    assert all(groups[5000 + i] == 5000 + i for i in range(40))


def test_lone_near_copies_in_a_hot_bucket(spark):
    rng = random.Random(6)
    prints = []
    for _ in range(150):
        # All share the first 16 bits; each two that follow each other differ in one.
        one = rng.getrandbits(240)
        prints += [one, one ^ 1 << rng.randrange(240)]
    nodes = spark.createDataFrame([(i, bytearray(p.to_bytes(32, "big"))) for i, p in enumerate(prints)], "node long, fingerprint binary")
    links = simhash.links_between(nodes, [list(range(16))], 40, False, 20).collect()
    assert {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in links} == {(i, i + 1) for i in range(0, 300, 2)}
