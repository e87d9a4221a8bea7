import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import rows

from larkspan.llm import QUERIES, alignment, words

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def brute():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    byte_of = {c: b for b, c in words.byte_letters().items()}

    def bytes_a(i):
        return bytes(byte_of[c] for c in first.id_to_token(i))

    def bytes_b(i):
        piece = second.id_to_piece(i)
        single = re.fullmatch("<0x(..)>", piece)
        return bytes([int(single[1], 16)]) if single else piece.replace("▁", " ").encode()

    def run(documents):
        out, counts = [], Counter()
        for doc_id, text in documents:
            a = first.encode(" " + text, add_special_tokens=False).ids if text else []
            b = second.encode(text) if text else []
            if not text or not (b"".join(map(bytes_a, a)) == b"".join(map(bytes_b, b)) == (" " + text).encode()):
                out.append((doc_id, 0, 0, [], ""))
                continue
            ends_a = {int(e): i for i, e in enumerate(np.cumsum([len(bytes_a(i)) for i in a]))}
            ends_b = {int(e): i for i, e in enumerate(np.cumsum([len(bytes_b(i)) for i in b]))}
            groups, links, i, j = [], [], 0, 0
            for end in sorted(ends_a.keys() & ends_b.keys()):
                groups.append(f"{','.join(map(str, a[i : ends_a[end] + 1]))}|{','.join(map(str, b[j : ends_b[end] + 1]))}")
                i, j = ends_a[end] + 1, ends_b[end] + 1
                links.append((a[i - 1], b[j - 1]))
            counts.update(links)
            out.append((doc_id, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        most = {}
        for (_, id_b), n in counts.items():
            most[id_b] = max(most.get(id_b, 0), n)
        return sorted(
            (
                (doc_id, n_a, n_b, len(links), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), digest)
                for doc_id, n_a, n_b, links, digest in out
            ),
            key=repr,
        ), counts

    return run


def test_query_equals_brute_force_on_the_table(spark, sf, brute):
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(QUERIES["op12_pair_bitmaps"](spark, sf), *COLUMNS) == brute(documents)[0]


PARTS = [
    " ", "  ", "\n", "a", "b", "the", "'s", "1", "23", "é", "ä", "ﬁ", "▁", "①", "<|endoftext|>", "<s>", "\x00", "\x1c", "\x85",
    "　", "中文", "🙂", ".", " the", " of", ",", "\r\n", "</s>", "<0x0A>", "I'll", "é", " ",
]


def odd_documents():
    random.seed(5)
    texts = ["".join(random.choices(PARTS, k=random.randint(0, 14))) for _ in range(1500)]
    return [*enumerate(texts), (None, None), (None, "a a a a"), (7, ""), *[(7, "the the the")] * 3, (8, " the" * 5000)]


def test_query_on_odd_texts_and_repeated_rows(spark, tmp_path, brute):
    documents = odd_documents()
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in documents], "doc_id long, text string, pair int, docs string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(QUERIES["op12_pair_bitmaps"](spark, str(tmp_path)), *COLUMNS) == brute(documents)[0]


def test_pair_counts_over_several_blocks(spark, tmp_path, brute):
    documents = odd_documents()
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(3)
    alignment.index(docs, A, B, block_bytes=500).write.parquet(f"{tmp_path}/index")
    found = spark.read.parquet(f"{tmp_path}/index")
    size = alignment.pieces_of(B)
    got = {divmod(r.pair, size): r.n_links for r in alignment.pair_counts(found).collect()}
    assert got == dict(brute(documents)[1])
    per_doc = alignment.scored(found, size).select("id", "n_best", "count_sum")
    assert rows(per_doc) == sorted([(r[0], r[5], r[6]) for r in brute(documents)[0]], key=repr)


def test_bitmaps_round_trip():
    rng = np.random.default_rng(3)
    places = [np.sort(rng.choice(alignment.BLOCK_DOCS, n, replace=False)) for n in (0, 1, 255, 256, 257, 4096, 3)]
    slot = np.repeat(np.arange(len(places)), [len(p) for p in places])
    maps = alignment.bitmaps(slot, np.concatenate(places), len(places))
    assert alignment.popcounts(maps).tolist() == [len(p) for p in places]
    owner, place = alignment.members(maps)
    assert [sorted(place[owner == i].tolist()) for i in range(len(places))] == [p.tolist() for p in places]


def test_empty_table(spark, tmp_path):
    alignment.index(spark.createDataFrame([], "doc_id long, text string"), A, B).write.parquet(f"{tmp_path}/index")
    assert alignment.scored(spark.read.parquet(f"{tmp_path}/index"), 32_000).count() == 0
