"""Content sort, size shards, length buckets and byte-level BPE against brute force on small rows."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from larkspan.llm import bpe, exact, packing, sharding
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    (1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, " \r\n"), (7, "x" * 50_000), (8, "x" * 50_000),
    (None, "ab"), (9, "ab"), (9, "ab"), (10, "é é"), (11, "éé"), (12, "it's  two\n\n 123 \U0001f600!!"),
]


def frame(spark, rows, clash=True):
    out = spark.createDataFrame(rows, "doc_id long, text string")
    # Extra columns under the names that the operators use inside.
    return out.selectExpr("*", *[f"'z' AS {c}" for c in ("id", "digest", "part", "range", "row", "bytes", "ids")]) if clash else out


def kept_by_force(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((doc, len(text or "")))
    best = lambda g: min(g, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    return {c: (best(g)[0], len(g)) for c, g in groups.items()}


@pytest.mark.parametrize("rows", [ODD, [], ODD[:1], [(i, "same") for i in range(500)] + ODD])
def test_content_sort(spark, rows):
    out = exact.content_sort(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    wanted = {hashlib.sha256(c.encode()).digest(): v for c, v in kept_by_force(rows).items()}
    assert sum(r["kept"] for r in out) == len(wanted)
    for r in out:
        assert (r["keep_id"], r["group_size"]) == wanted[bytes(r["digest"])]
        assert not r["kept"] or r["id"] == r["keep_id"]


def test_a_large_group_of_copies_is_cut_into_ranges(spark):
    rows = [(i, "copy " * 3 + " " * (i % 3)) for i in range(4000)] + [(i, f"text {i}") for i in range(4000, 8000)]
    out = exact.content_sort(frame(spark, rows)).cache()
    assert out.where("kept").count() == 4001
    copies = out.where("group_size = 4000")
    assert copies.select("keep_id").distinct().collect() == [(2,)] and copies.count() == 4000


@pytest.mark.parametrize("ranges", [1, 4])
def test_shards(spark, ranges):
    rng = random.Random(5)
    rows = [(i, "hot" * 30 if i % 3 == 0 else "w" * rng.randrange(1, 400)) for i in range(100, 6100)] + ODD
    out = sharding.size_shards(frame(spark, rows), ranges_per_shard=16 * ranges, rows_per_range=2000 // ranges).collect()
    assert len(out) == len(rows)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in out:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) == set(range(8))
    mean = sum(sizes.values()) / 8
    assert all(abs(s - mean) < 0.1 * mean for s in sizes.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    text = {r[0]: r[1] or "" for r in rows}
    assert all(r["size"] == len(text[r["id"]].encode()) + 1 for r in out)


def test_shards_of_nothing_and_of_one_row(spark):
    assert sharding.size_shards(frame(spark, [])).count() == 0
    assert [tuple(r) for r in sharding.size_shards(frame(spark, [(None, None)])).collect()] == [(None, 1, 0, 0, 0)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
def test_best_ends_pad_the_least(histogram, buckets):
    lengths = sorted(histogram)
    counts = [histogram[n] for n in lengths]

    def padding(ends):
        return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts, strict=True))

    ends = packing.best_ends(lengths, counts, buckets)
    assert len(ends) <= buckets and ends[-1] == lengths[-1]
    least = min(
        padding([*some, lengths[-1]]) for k in range(buckets) for some in itertools.combinations(lengths[:-1], k)
    )
    assert padding(ends) == least


def test_length_buckets(spark):
    rows = [(i, "w " * (i % 40)) for i in range(900)] + [(2000 + i, "hot " * 7) for i in range(900)] + [(5000, "w " * 999), (None, None)]
    out = packing.length_buckets(frame(spark, rows), buckets=4, budget=100, rows_per_range=50).collect()
    assert len(out) == len(rows)
    batches = defaultdict(list)
    for r in out:
        assert r["pad_to"] >= max(r["n_tokens"], 1)
        batches[r["bucket"], r["batch"]].append(r)
    for (bucket, _), batch in batches.items():
        assert sum(r["pad_to"] for r in batch) <= 100 or (len(batch) == 1 and bucket == 4)
        assert sorted(r["place"] for r in batch) == list(range(len(batch)))
    for bucket in range(4):  # only the last batch of a bucket may have room
        numbers = sorted(n for b, n in batches if b == bucket)
        assert numbers == list(range(len(numbers)))
        assert len({len(batches[bucket, n]) for n in numbers[:-1]}) <= 1
    assert packing.length_buckets(frame(spark, [])).count() == 0


def reference_encoding():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={}
    )


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab the'sin \n\t\r\x1c\x85  e1½é漢😀_.,"), st.characters(exclude_categories=["Cs"]))))
def test_bpe_equals_the_library(text):
    ids = bpe.encoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN, memo_words=3)(text)
    assert memoryview(ids).cast("I").tolist() == reference_encoding().encode_ordinary(text)


def test_bpe_round_trip(spark):
    rows = [*ODD, (20, "thequickbrownfox" * 3000)]
    out = bpe.decode(bpe.encode(frame(spark, rows), RANKS, public_tokenizers.PATTERN), RANKS).collect()
    encoding = reference_encoding()
    assert sorted((r["id"] or 0, bytes(r["decoded"])) for r in out) == sorted((d or 0, (t or "").encode()) for d, t in rows)
    by_text = {(t or "").encode(): t or "" for _, t in rows}
    for r in out:
        assert memoryview(bytes(r["ids"])).cast("I").tolist() == encoding.encode_ordinary(by_text[bytes(r["decoded"])])
    assert bpe.encode(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_all_documents_round_trip(spark, sf):
    from larkspan.llm import QUERIES

    digests = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("d"))
    assert QUERIES["op3_byte_bpe"](spark, sf).join(digests, "doc_id").where("d <> decoded_sha256").count() == 0
