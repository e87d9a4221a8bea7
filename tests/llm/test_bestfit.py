import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspan.llm import QUERIES, bestfit

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(counts):
    left, out = counts.copy(), []
    while left[1:].any():
        found, _ = bestfit.best_bin(left)
        for n, t in found:
            left[n] -= t
        out.append(found)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=30))
def test_repeated_bins_are_those_of_one_after_another(counts):
    counts = np.array([0, *counts], np.int64)
    bins = bestfit.plan(counts)
    single = one_by_one(counts)
    assert [found for found, copies in bins for _ in range(copies)] == single
    assert all(sum(n * t for n, t in found) <= len(counts) - 1 for found in single)
    # Every piece has a place of its own and every sequence is gapless from 0.
    slots = bestfit.Slots(bins)
    length = np.repeat(np.arange(len(counts)), counts)
    rank = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts)
    sequence, offset = slots.place(length, rank) if len(length) else (length, length)
    order = np.lexsort((offset, sequence))
    ends = np.cumsum(length[order])
    for s in range(slots.sequences):
        mine = order[sequence[order] == s]
        assert offset[mine].tolist() == (np.cumsum(length[mine]) - length[mine]).tolist()
    assert not len(ends) or ends[-1] == int((counts * np.arange(len(counts))).sum())


def test_shortest_piece_gives_way_to_two():
    # 6 + 2 leaves a gap of 2; in place of the 2 the pair 3 + 1 fills it.
    counts = np.bincount([6, 2, 3, 1], minlength=11)
    counts[3], counts[2] = 1, 1
    found, _ = bestfit.best_bin(np.bincount([7, 2, 2, 1], minlength=11))
    assert found == [(7, 1), (2, 1), (1, 1)]
    found, _ = bestfit.best_bin(np.bincount([6, 3, 2, 2], minlength=11))
    assert found == [(6, 1), (2, 2)]


def test_few_sequences():
    rng = np.random.default_rng(6)
    lengths = np.clip(rng.lognormal(6, 1, 20_000).astype(int), 1, 2048)
    slots = bestfit.Slots(bestfit.plan(np.bincount(lengths, minlength=2049)))
    assert slots.sequences <= 1.001 * -(-lengths.sum() // 2048)


def wanted(documents):
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(PATH), []
    for doc_id, text in documents:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            out.append((doc_id, start // 2048, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    return sorted(out, key=repr)


def check(frame, documents):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(frame, *columns) == wanted(documents)
    found = frame.toPandas().sort_values(["sequence_id", "offset"])
    ends = found.groupby("sequence_id")["length"].cumsum()
    assert (ends - found["length"] == found["offset"]).all() and ends.max() <= 2048
    assert found["sequence_id"].nunique() <= 1.02 * -(-found["length"].sum() // 2048) + 1


def test_query_on_the_table(spark, sf):
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(QUERIES["op13_best_two_fit"](spark, sf), documents)


def test_query_on_odd_texts(spark, tmp_path):
    random.seed(7)
    parts = [" ", "\n", "A", "the", "'s", "'S", "12", "É", "ß", "ﬁ", "µ", "×", "<|endoftext|>", "\x00", "\x1c", "\x85", "中文", "🙂", "H̱", "é", "Σ", "İ"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(1500)]
    documents = [*enumerate(texts), (None, None), (None, ""), (3, "a b"), (3, "a b"), (4, "word " * 9000)]
    docs = spark.createDataFrame([(i, t, 0, 1) for i, t in documents], "doc_id long, text string, length int, rank int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    check(QUERIES["op13_best_two_fit"](spark, str(tmp_path)), documents)


def test_pack_splits_frequent_lengths_and_keeps_columns(spark):
    table = spark.range(5000).selectExpr("id", "id % 3 * 5 + 1 AS length", "'x' AS row", "1 AS `before`", "2 AS part")
    found = bestfit.pack(table, capacity=20, rows_per_range=100).toPandas()
    assert sorted(found["id"]) == list(range(5000)) and set(found.columns) == {*table.columns, "sequence_id", "offset"}
    found = found.sort_values(["sequence_id", "offset"])
    assert (found.groupby("sequence_id")["length"].cumsum() - found["length"] == found["offset"]).all()


def test_pack_refuses_lengths_out_of_range(spark):
    for value in ("0", "21", "CAST(NULL AS int)"):
        with pytest.raises(ValueError):
            bestfit.pack(spark.range(2).selectExpr(f"{value} AS length"), capacity=20)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bestfit.pack(bestfit.pieces(docs, PATH).drop("ids")).count() == 0
