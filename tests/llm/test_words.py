"""Chunks, their encoders and the merges in step against the libraries and the plain forms."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspan.llm import bpe, words

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = [" ", "  ", "\n", "The", "end.", "'s", "'LL", "42", "é", "Ä", "ß", "ﬁ", "µ", "÷", "中文", "🙂", "<|endoftext|>", "\x00", "\x1c", "\x85", "a" * 70]


@pytest.fixture(scope="module")
def pairs():
    return bpe.Pairs(bpe.load_ranks(RANKS))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text("aehinorst é", max_size=40).map(str.encode), st.binary(max_size=90)), max_size=30))
def test_merges_in_step_equal_one_by_one(pairs, pieces):
    assert bpe.merge_many(pieces, pairs) == [bpe.merge(p, pairs.ranks) for p in pieces]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("special", [True, False])
def test_chunk_encoder_equals_the_tokenizer(name, special):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = not special
    rng = random.Random(11)
    chunks = ["".join(rng.choices(PARTS, k=rng.randint(0, 5))) for _ in range(2000)]
    found = words.chunk_encoder(path, special, memo=50)(chunks)
    assert [list(f) for f in found] == [e.ids for e in plain.encode_batch(chunks, add_special_tokens=False)]


@pytest.mark.parametrize("special", [True, False])
@pytest.mark.parametrize("parts", [PARTS, ["The", "end.", "'s", "'LL", "42", "é", "Ä", "ß", "÷", "\t"], ["中", "\n"]])
def test_flat_encoder_equals_the_tokenizer(special, parts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = not special
    rng = random.Random(12)
    encode = words.chunk_encoder(path, special, memo=50, flat=True)
    for n in (0, 1, 2, 700, 700):
        chunks = ["".join(rng.choices(parts, k=rng.randint(0, 5))) for _ in range(n)]
        found = encode(chunks)
        if isinstance(found, tuple):
            ids, sizes = found
            found = [ids[end - size : end].tolist() for end, size in zip(np.cumsum(sizes), sizes, strict=True)]
        assert found == [e.ids for e in plain.encode_batch(chunks, add_special_tokens=False)]


def test_flat_encoder_cuts_plain_chunks_at_once():
    found = words.chunk_encoder(public_tokenizers.path("word_bpe_49k.json"), flat=True)(["The end", "", "don't"])
    assert isinstance(found, tuple) and len(found[1]) == 3


def test_memo_renews_itself():
    memo = words.Memo(lambda chunks: [[len(c)] * len(c) for c in chunks], limit=3)
    for texts in (["a bb", "ccc"], ["dddd eeeee a"], ["a bb ccc dddd eeeee"]):
        found = words.split(pa.array(texts))
        ids, ends = memo.encoded(found)
        want = [[n for w in t.split(" ") for n in [len(w)] * len(w)] for t in texts]
        assert [ids[s:e].tolist() for s, e in zip(ends[:-1], ends[1:], strict=True)] == want


def test_chunks_join_to_the_text():
    rng = random.Random(12)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 12))) for _ in range(1000)] + ["", " ", "a  b", " a", "a "]
    found = words.chunks_of(pa.array(texts))
    assert [" ".join(found.chunks[p] for p in found.places[s:e]) for s, e in zip(found.ends[:-1], found.ends[1:], strict=True)] == texts
    led = words.spaced(found)
    assert ["".join(led.chunks[p] for p in led.places[s:e]) for s, e in zip(led.ends[:-1], led.ends[1:], strict=True)] == texts


def test_blocks_hold_whole_texts():
    texts = pa.array(["a" * 5, None, "b" * 50, "", "c"])
    assert [(first, part.to_pylist()) for first, part in words.blocks(texts, 8)] == [(0, ["a" * 5, "", "b" * 50]), (3, ["", "c"])]
    assert [len(part) for _, part in words.blocks(texts, 1000, 2)] == [2, 2, 1]
    assert words.gathered(np.arange(10), np.array([7, 0, 3]), np.array([2, 0, 3])).tolist() == [7, 8, 3, 4, 5]


def test_decode_keeps_further_columns(spark):
    docs = spark.createDataFrame([(1, "the end"), (2, None)], "doc_id long, text string")
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN).selectExpr("*", "'x' AS decoded", "id AS more")
    found = {r["id"]: (r["decoded"], r["more"]) for r in bpe.decode(encoded, RANKS).collect()}
    assert {i: (bytes(d), m) for i, (d, m) in found.items()} == {1: (b"the end", 1), 2: (b"", 2)}
