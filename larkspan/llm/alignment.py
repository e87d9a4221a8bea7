"""Tokens of two tokenizers aligned at common byte ends, counted by inverted pair bitmaps.

Documents lie in blocks. For each pair of ids that end together in a block the index holds one posting: a
compressed bitmap of the documents that have the pair, and where some have it more than once, one bitmap per
binary digit of the multiplicity. Bitmaps of a pair lie in different blocks, so their union needs no merge but
that of the planes of a block; popcounts give a pair's documents and links. Scores of the pairs go back along
the postings to the documents.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm import words
from larkspan.llm.common import pick, shuffle_width
from larkspan.session import settle

# Documents of a block, and so bits of a bitmap; a bitmap with fewer members is a list of 16-bit places.
BLOCK_DOCS = 4096
BITMAP_BYTES = BLOCK_DOCS // 8
DENSE = BITMAP_BYTES // 2
BLOCK_BYTES = 4 << 20
# Chunks that a worker remembers, with their groups as text.
MEMO_CHUNKS = 250_000
# The mark of a space in the pieces of the second tokenizer, and its pieces of a single byte.
SPACE = "▁"
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")

_INDEX = (
    "block long, place int, id long, n_a long, n_b long, n_links long, groups string, "
    "pair long, docs binary, planes array<binary>"
)


class Aligner(words.Memo):
    """Chunks with a space before them, in tokens of both tokenizers.

    A chunk stands between single spaces with no white space at its ends, so neither tokenizer joins anything
    across its borders, and both end a token there.
    """

    def __init__(self, path_a: str, path_b: str, limit: int = MEMO_CHUNKS):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = words.chunk_encoder(path_a, special=False), SentencePieceProcessor(model_file=path_b)
        letters = {letter: byte for byte, letter in words.byte_letters().items()}
        entries = Tokenizer.from_file(path_a).get_vocab(with_added_tokens=False)
        bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            bytes_a[i] = bytes(letters[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("pieces that go on after a word cannot be aligned chunk by chunk")
        bytes_b = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace(SPACE, " ").encode() for p in pieces]
        self.size_b = len(pieces)
        if len(bytes_a) * self.size_b * BLOCK_DOCS >= 1 << 62:
            raise ValueError("the vocabularies are too large for pairs of 64 bits")
        self.sides = [_Tokens(bytes_a), _Tokens(bytes_b)]
        super().__init__(self._pairs, limit, np.int64)

    def _renew(self) -> None:
        super()._renew()
        self.groups: list[str] = []
        self.counts = np.empty((0, 3), np.int64)

    def _pairs(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The linked pairs of the chunks and how many each has. Its groups and its row of ``counts`` are kept: tokens of both sides, 1 if bytes differ."""
        texts = [f" {c}" for c in chunks]
        raw = [t.encode() for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        ids, many, length = [], [], []
        for listed, side in zip((self.a(texts), self.b.encode(chunks, num_threads=1)), self.sides, strict=True):
            many.append(np.fromiter(map(len, listed), np.int64, len(listed)))
            ids.append(np.fromiter(itertools.chain.from_iterable(listed), np.int64, int(many[-1].sum())))
            owner = np.repeat(np.arange(len(raw)), many[-1])
            length.append(np.bincount(owner, side.sizes[ids[-1]], len(raw)).astype(np.int64))
        fits = (length[0] == size) & (length[1] == size)
        same = fits.copy()
        # Of the chunks with the right lengths all bytes are laid end to end and compared.
        joined = np.frombuffer(b"".join([r for r, s in zip(raw, fits, strict=True) if s]), np.uint8)
        place = np.repeat(np.flatnonzero(fits), size[fits])
        for k, side in enumerate(self.sides):
            kept = ids[k][np.repeat(fits, many[k])]
            wrong = place[words.gathered(side.data, side.starts[kept], side.sizes[kept]) != joined]
            same[wrong] = False
        found = self._link([i[np.repeat(same, m)] for i, m in zip(ids, many, strict=True)], [np.where(same, m, 0) for m in many])
        self.counts = np.concatenate([self.counts, np.stack([*many, ~same], axis=1)])
        return found

    def _link(self, ids: list[np.ndarray], many: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of chunks laid end to end and how many each has; the text of their groups is kept."""
        ends = [np.cumsum(side.sizes[i]) for i, side in zip(ids, self.sides, strict=True)]
        # No token is empty, so ends ascend on both sides.
        common, last_a, last_b = np.intersect1d(*ends, assume_unique=True, return_indices=True)
        pairs = ids[0][last_a] * self.size_b + ids[1][last_b]
        chunk = np.repeat(np.arange(len(many[0])), many[0])[last_a]
        per_chunk = np.bincount(chunk, minlength=len(many[0]))
        # Tokens by group, first those of a; what follows each tells whether its side or group goes on.
        group = np.concatenate([np.searchsorted(common, e) for e in ends])
        order = np.argsort(group, kind="stable")
        closing = np.zeros(len(group), np.int64)
        closing[last_a], closing[len(ids[0]) + last_b] = 1, 2
        token = (np.concatenate(ids) * 3 + closing)[order]
        spelled = _decimals(max(len(s.sizes) for s in self.sides))
        sizes = spelled.sizes[token]
        text = words.gathered(spelled.data, spelled.starts[token], sizes)
        cut = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(many[0] + many[1])))].tolist()
        whole = text.tobytes().decode("ascii")
        # Without the mark after the last group.
        self.groups += [whole[s : e - 1] if e > s else "" for s, e in zip(cut[:-1], cut[1:], strict=True)]
        return pairs, per_chunk


class _Tokens:
    """The bytes of a vocabulary, laid end to end."""

    def __init__(self, tokens: list[bytes]):
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes


@cache
def _decimals(count: int) -> _Tokens:
    """Each number below ``count`` followed by a comma, a bar and a semicolon, in this order."""
    return _Tokens([f"{i}{mark}".encode() for i in range(count) for mark in ",|;"])


def pieces_of(path_b: str) -> int:
    """Size of the second vocabulary."""
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path_b).get_piece_size()


def bitmaps(slot: np.ndarray, place: np.ndarray, slots: int) -> pa.Array:
    """One compressed bitmap per slot, of its places; rows lie by slot, then place."""
    counts = np.bincount(slot, minlength=slots)
    dense = counts >= DENSE
    sizes = np.where(dense, BITMAP_BYTES, 2 * counts)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    data = np.zeros(int(ends[-1]), np.uint8)
    rank = np.arange(len(slot)) - np.repeat(np.cumsum(counts) - counts, counts)
    listed = ~dense[slot]
    data.view("<u2")[(ends[slot[listed]] >> 1) + rank[listed]] = place[listed]
    for s in np.flatnonzero(dense):
        first = int(np.searchsorted(slot, s))
        bits = np.zeros(BLOCK_DOCS, np.uint8)
        bits[place[first : first + counts[s]]] = 1
        data[ends[s] : ends[s + 1]] = np.packbits(bits, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), slots, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _buffers(maps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ends, bytes) of binary values."""
    if not len(maps):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    wide = isinstance(maps, pa.LargeBinaryArray)
    ends = np.frombuffer(maps.buffers()[1], np.int64 if wide else np.int32)[maps.offset : maps.offset + len(maps) + 1].astype(np.int64)
    data = maps.buffers()[2]
    return ends, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def popcounts(maps: pa.Array) -> np.ndarray:
    """Members of each compressed bitmap."""
    ends, data = _buffers(maps)
    size = np.diff(ends)
    out = size // 2
    full = np.flatnonzero(size == BITMAP_BYTES)
    if len(full):
        bits = data[ends[full][:, None] + np.arange(BITMAP_BYTES)]
        out[full] = np.bitwise_count(bits).sum(axis=1)
    return out


def members(maps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of the bitmap, place) of every member of the bitmaps."""
    ends, data = _buffers(maps)
    size = np.diff(ends)
    full = size == BITMAP_BYTES
    which = np.flatnonzero(~full)
    raw = words.gathered(data, ends[which], size[which])
    listed = np.ascontiguousarray(raw).view("<u2").astype(np.int64)
    owner = np.repeat(which, size[which] // 2)
    whole = np.flatnonzero(full)
    if len(whole):
        bits = np.unpackbits(data[ends[whole][:, None] + np.arange(BITMAP_BYTES)], axis=1, bitorder="little")
        row, place = np.nonzero(bits)
        owner, listed = np.concatenate([owner, whole[row]]), np.concatenate([listed, place])
    return owner, listed


def _postings(block: int, pair: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """The postings of a block's links, one row a pair."""
    key, times = np.unique(pair * BLOCK_DOCS + place, return_counts=True)
    pair, place = np.divmod(key, BLOCK_DOCS)
    pairs, first, slot = np.unique(pair, return_index=True, return_inverse=True)
    digits = np.zeros(len(pairs), np.int64)
    if len(pairs):
        most = np.maximum.reduceat(times, first)
        # A pair that no document has twice needs no planes beside its documents.
        digits = np.where(most > 1, np.ceil(np.log2(most + 1)).astype(np.int64), 0)
    ends = np.concatenate(([0], np.cumsum(digits)))
    planes = [(ends[slot] + d, place, (digits[slot] > d) & (times >> d & 1 > 0)) for d in range(int(digits.max(initial=0)))]
    slots = np.concatenate([np.empty(0, np.int64), *[s[has] for s, _, has in planes]])
    places = np.concatenate([np.empty(0, np.int64), *[p[has] for _, p, has in planes]])
    order = np.argsort(slots, kind="stable")
    n = len(pairs)
    columns = {
        "block": pa.array(np.full(n, block)),
        "pair": pa.array(pairs),
        "docs": bitmaps(slot, place, n),
        "planes": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), bitmaps(slots[order], places[order], int(ends[-1]))),
    }
    return _row_batch(columns, n)


def _row_batch(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    """A batch of the index; columns that are not given are NULL."""
    kinds = {
        "block": pa.int64(), "place": pa.int32(), "id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(),
        "n_links": pa.int64(), "groups": pa.string(), "pair": pa.int64(), "docs": pa.binary(), "planes": pa.list_(pa.binary()),
    }
    return pa.record_batch([columns.get(c, pa.nulls(n, kind)) for c, kind in kinds.items()], names=list(kinds))


@cache
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def index(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Aligned documents and the postings of their pairs; write it before use, as block numbers are those of tasks.

    Rows of documents have block, place, id, n_a, n_b (tokens), n_links and groups (text): groups of tokens
    between common ends as ``a1,a2|b1;a3|b2,b3``. Each group holds one link, its last tokens, so there are as
    many groups as links. A document whose text is NULL or empty, or whose tokens of either side do not give
    back a space and the text, has no tokens and the empty text as groups. Rows of postings have block, pair
    (id of a times the size of b's vocabulary, plus id of b), docs and planes.

    ``path_a`` is a byte-level file of ``tokenizers``, ``path_b`` a model of ``sentencepiece`` that puts a space
    before a text; both lie on every node. Strings of special tokens are plain text. Whole texts; repeated rows
    and NULL ids stay; further columns are ignored; an empty table gives no rows. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = _aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, texts in words.blocks(batch.column("text"), block_bytes, BLOCK_DOCS):
                found = words.chunks_of(texts)
                rows = aligner.places(found.chunks)[found.places]
                counts = np.stack([words.sums(c, found.ends) for c in aligner.counts[rows].T], axis=1)
                good = (counts[:, 2] == 0) & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
                counts[~good] = 0
                doc = np.repeat(np.arange(len(texts)), np.diff(found.ends))
                kept = good[doc]
                used, sizes = rows[kept], aligner.sizes[rows[kept]]
                pairs = words.gathered(aligner.ids, aligner.starts[used], sizes)
                place = np.repeat(doc[kept], sizes)
                groups, listed = aligner.groups, rows.tolist()
                joined = [
                    ";".join([groups[r] for r in listed[s:e]]) if g else ""
                    for s, e, g in zip(found.ends[:-1], found.ends[1:], good, strict=True)
                ]
                n = len(texts)
                columns = {
                    "block": pa.array(np.full(n, block)),
                    "place": pa.array(np.arange(n), pa.int32()),
                    "id": batch.column("id").slice(first, n),
                    "n_a": pa.array(counts[:, 0]),
                    "n_b": pa.array(counts[:, 1]),
                    "n_links": pa.array(np.bincount(place, minlength=n)),
                    "groups": pa.array(joined, pa.string()),
                }
                yield _row_batch(columns, n)
                yield _postings(block, pairs, place)
                block += 1

    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), "text")
    return rows.mapInArrow(run, _INDEX)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n_docs and n_links of every linked pair in an index, by popcounts of its bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = popcounts(batch.column("docs"))
            planes = batch.column("planes")
            inner, many = planes.flatten(), pc.list_value_length(planes).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(many)), many)
            digit = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            links = np.where(many > 0, 0, docs)
            np.add.at(links, owner, popcounts(inner) << digit)
            yield pa.record_batch([batch.column("pair"), pa.array(docs), pa.array(links)], names=["pair", "n_docs", "n_links"])

    rows = found.where("pair IS NOT NULL").select("pair", "docs", "planes")
    measured = rows.mapInArrow(run, "pair long, n_docs long, n_links long")
    return measured.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))


def scored(found: DataFrame, size_b: int) -> DataFrame:
    """The documents of a written index: id, n_a, n_b, n_links, groups, n_best and count_sum.

    A link's count is the number of links of the whole index with its pair. n_best are the links whose count is
    the highest of their id of b, ties included; count_sum adds up the counts of all links. A document without
    links has zeros.
    """
    counts = settle(pair_counts(found).select("pair", (F.col("pair") % size_b).alias("b"), "n_links"))
    highest = counts.groupBy("b").agg(F.max("n_links").alias("most"))
    scores = counts.join(highest, "b").select(
        "pair", F.col("n_links").alias("count"), (F.col("n_links") == F.col("most")).cast("long").alias("best")
    )
    postings = found.where("pair IS NOT NULL").select("pair", "block", "docs", "planes").join(scores, "pair")
    both = found.where("pair IS NULL").drop("pair", "docs", "planes").unionByName(postings, True)
    dealt = both.repartition(shuffle_width(found), "block").sortWithinPartitions("block", F.col("pair").isNotNull())
    fields = ["id", "n_a", "n_b", "n_links", "groups"]
    schema = found.select(*fields).schema.add("n_best", "long").add("count_sum", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, sums = None, [], np.zeros((BLOCK_DOCS, 2), np.int64)

        def done() -> Iterator[pa.RecordBatch]:
            for rows in held:
                own = sums[rows.column("place").to_numpy()]
                columns = [rows.column(c) for c in fields] + [pa.array(own[:, 0].copy()), pa.array(own[:, 1].copy())]
                yield pa.record_batch(columns, names=schema.names)
            held.clear()
            sums[:] = 0

        for batch in batches:
            number = batch.column("block").to_numpy()
            starts = np.flatnonzero(np.diff(number, prepend=number[0] - 1)) if len(number) else []
            for s, e in zip(starts, [*starts[1:], len(number)], strict=True):
                if number[s] != block:
                    yield from done()
                    block = number[s]
                rows = batch.slice(s, e - s)
                is_doc = pc.is_null(rows.column("pair"))
                if len(docs := rows.filter(is_doc)):
                    held.append(docs)
                posted = rows.filter(pc.invert(is_doc))
                if not len(posted):
                    continue
                score = np.stack([posted.column(c).to_numpy() for c in ("best", "count")], axis=1)
                planes = posted.column("planes")
                many = pc.list_value_length(planes).to_numpy()
                single = np.flatnonzero(many == 0)
                owner, place = members(posted.column("docs").take(pa.array(single)))
                np.add.at(sums, place, score[single[owner]])
                which = np.repeat(np.arange(len(many)), many)
                digit = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                owner, place = members(planes.flatten())
                np.add.at(sums, place, score[which[owner]] << digit[owner][:, None])
        yield from done()

    return dealt.mapInArrow(run, schema)
