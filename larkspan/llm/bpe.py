"""Byte-level BPE over whole texts, with the pair of lowest rank found by a segment tree.

The ids of a document are packed as little-endian unsigned 32-bit integers in one binary value, so that a
document of any length is one cheap Arrow cell.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm import words
from larkspan.llm.common import pick

# Chunks and pieces that a worker remembers; results never depend on them.
MEMO_CHUNKS = 150_000
MEMO_PIECES = 100_000
NONE = 1 << 62
# Longer pieces have a tree of their own; nodes that trees in step have together.
MOST_BYTES = 64
TREE_NODES = 1 << 18
# Documents whose bytes are put together at once.
DECODED_AT_ONCE = 500


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank a line; the file lies on every node."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the leftmost pair of lowest rank is joined until no pair has a rank.

    Leaf i of the tree stands for the pair that begins at byte i and holds rank * width + i, so the root is
    the lowest rank and, among equals, the leftmost. A merge empties one leaf and renews two.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    width = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * width)
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = rank * width + i
    for node in range(width - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    after = list(range(1, n + 1))  # where the part that begins here ends, and the next one begins
    before = list(range(-1, n - 1))
    while tree[1] != NONE:
        i = tree[1] % width
        gone = after[i]
        end = after[i] = after[gone]
        renewed = [(gone, NONE)]
        rank = None
        if end < n:
            before[end] = i
            rank = get(piece[i : after[end]])
        renewed.append((i, NONE if rank is None else rank * width + i))
        left = before[i]
        if left >= 0:
            rank = get(piece[left:end])
            renewed.append((left, NONE if rank is None else rank * width + left))
        for node, value in renewed:
            node += width
            while node and tree[node] != value:
                tree[node] = value
                # The other child of the parent decides with this one.
                other = tree[node ^ 1]
                node >>= 1
                if other < value:
                    value = other
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Pairs:
    """Two neighbouring tokens and the rank of what they join to, for all pairs that join."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.size = ranks, max(ranks.values(), default=0) + 1
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        found = {
            left * self.size + right: rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        }
        self.keys = np.array(sorted(found) or [-1], np.int64)
        self.joined = np.array([found.get(k, NONE) for k in self.keys.tolist()], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.joined[at], NONE)


def merge_many(pieces: list[bytes], pairs: Pairs) -> list[list[int]]:
    """Ids of many pieces by ``merge``; pieces of like length share arrays of trees, a row each, and merge in step."""
    out: list[list[int]] = [[]] * len(pieces)
    by_width: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        if piece in pairs.ranks or len(piece) < 2 or len(piece) > MOST_BYTES:
            out[i] = merge(piece, pairs.ranks)
        else:
            by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
    for width, members in by_width.items():
        for first in range(0, len(members), max(1, TREE_NODES // width)):
            some = members[first : first + max(1, TREE_NODES // width)]
            for i, ids in zip(some, _merge_rows([pieces[i] for i in some], width, pairs), strict=True):
                out[i] = ids
    return out


def _merge_rows(pieces: list[bytes], width: int, pairs: Pairs) -> list[list[int]]:
    """As ``merge``, one piece a row."""
    rows = len(pieces)
    size = np.fromiter(map(len, pieces), np.int64, rows)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
    place = np.arange(width)
    inside = place < size[:, None]
    token = pairs.bytes[raw]
    live = inside.copy()
    after, before = np.tile(place + 1, (rows, 1)), np.tile(place - 1, (rows, 1))
    tree = np.full((rows, 2 * width), NONE)
    rank = pairs.rank(token[:, :-1], token[:, 1:])
    tree[:, width : 2 * width - 1] = np.where(inside[:, 1:] & (rank != NONE), rank * width + place[:-1], NONE)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    at = np.flatnonzero(tree[:, 1] != NONE)
    while len(at):
        joined, i = np.divmod(tree[at, 1], width)
        gone = after[at, i]
        end = after[at, gone]
        token[at, i], after[at, i], live[at, gone] = joined, end, False
        tree[at, width + gone] = NONE
        more, left = end < size[at], before[at, i]
        follows = np.minimum(end, width - 1)
        before[at[more], end[more]] = i[more]
        rank = np.where(more, pairs.rank(joined, token[at, follows]), NONE)
        tree[at, width + i] = np.where(rank != NONE, rank * width + i, NONE)
        # What stands before is renewed too; without it the leaf of the merge is written again.
        some = left >= 0
        other = np.where(some, left, i)
        rank = np.where(some, pairs.rank(token[at, other], joined), rank)
        tree[at, width + other] = np.where(rank != NONE, rank * width + other, NONE)
        for node in (width + gone, width + i, width + other):
            while node[0] > 1:
                node = node >> 1
                tree[at, node] = np.minimum(tree[at, 2 * node], tree[at, 2 * node + 1])
        at = at[tree[at, 1] != NONE]
    ids, ends = token[live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
    return [ids[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]


def chunk_encoder(ranks: dict[bytes, int], pattern: str, memo: int = MEMO_PIECES) -> Callable[[list[str]], list[list[int]]]:
    """Ids of each chunk of a text: each match of the pattern by itself. Pieces met lately are remembered."""
    matches, pairs, known = regex.compile(pattern).findall, Pairs(ranks), {}
    find = words.plain_find(pattern) or matches

    def encode(chunks: list[str]) -> list[list[int]]:
        cut = [(find if words.is_plain(chunk) else matches)(chunk) for chunk in chunks]
        if len(known) > memo:
            known.clear()
        fresh = [p for p in set(itertools.chain.from_iterable(cut)) if p not in known]
        known.update(zip(fresh, merge_many([p.encode() for p in fresh], pairs), strict=True))
        return [known[p[0]] if len(p) == 1 else list(itertools.chain.from_iterable([known[x] for x in p])) for p in cut]

    return encode


def encoder(ranks: dict[bytes, int], pattern: str, memo_words: int = MEMO_CHUNKS) -> Callable[[str], bytes]:
    """A function from a text to its packed ids."""
    memo = words.Memo(chunk_encoder(ranks, pattern, memo_words), memo_words)
    return lambda text: memo.encoded(words.spaced(words.chunks_of(pa.array([text]))))[0].astype("<u4").tobytes()


@cache
def _shared_memo(path: str, pattern: str) -> words.Memo:
    return words.Memo(chunk_encoder(load_ranks(path), pattern), MEMO_CHUNKS)


@cache
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens by rank, and where each begins and how many it has; unknown ranks have -1."""
    ranks = load_ranks(path)
    table = np.full((max(ranks.values(), default=-1) + 1, 2), -1)
    at = 0
    for token, rank in ranks.items():
        table[rank] = at, len(token)
        at += len(token)
    return np.frombuffer(b"".join(ranks), np.uint8), table[:, 0], table[:, 1]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids (binary, unsigned little-endian 32-bit integers).

    Special tokens are ordinary text. A NULL or empty text has no ids; texts of any length are encoded
    whole; repeated rows and NULL ids stay; further columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _shared_memo(path, pattern)
        for batch in batches:
            for first, texts in words.blocks(batch.column("text")):
                # The pattern begins a new match before a single space that stands before a character.
                ids, begin = memo.encoded(words.spaced(words.chunks_of(texts)))
                columns = [
                    batch.column("id").slice(first, len(texts)),
                    pa.array(np.diff(begin)),
                    words.packed(ids, begin).cast(pa.binary()),
                ]
                yield pa.record_batch(columns, names=["id", "n_tokens", "ids"])

    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), "text")
    return rows.mapInArrow(run, "id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``, the bytes of the tokens in ``ids``; NULL ids give no bytes, an unknown id is an error.

    Further columns go along, but for one named ``decoded``.
    """
    schema = encoded.drop("decoded").schema.add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts, sizes = _token_bytes(path)
        for whole in batches:
            for at in range(0, len(whole), DECODED_AT_ONCE):
                batch = whole.slice(at, DECODED_AT_ONCE)
                packed = batch.column("ids").to_pylist()
                ids = np.frombuffer(b"".join(p for p in packed if p), "<u4")
                if len(ids) and (int(ids.max()) >= len(starts) or (starts[ids] < 0).any()):
                    raise ValueError("an id is not in the rank file")
                ends = np.cumsum([0, *[len(p or b"") // 4 for p in packed]])
                texts = [words.gathered(data, starts[own], sizes[own]).tobytes() for own in np.split(ids, ends[1:-1])]
                yield pa.record_batch([*batch.columns, pa.array(texts, pa.binary())], names=schema.names)

    return encoded.drop("decoded").mapInArrow(run, schema)
