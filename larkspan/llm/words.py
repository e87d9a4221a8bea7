"""Texts as chunks that a tokenizer treats one by one, so that each distinct chunk of a block is encoded once.

Splitting, comparing and gathering are Arrow and numpy operations over a block of documents; only chunks that
the worker has not met lately reach the tokenizer.
"""

from __future__ import annotations

import codecs
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator, Sequence
from typing import TYPE_CHECKING, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

if TYPE_CHECKING:
    from tokenizers import Tokenizer

# Text of the documents that are worked on at once, unless one document has more.
BLOCK_BYTES = 4 << 20
# Chunks and pieces that a worker remembers; results never depend on it.
MEMO_CHUNKS = 500_000
MEMO_PIECES = 200_000


def load_tokenizer(path: str) -> Tokenizer:
    """A tokenizer of the library of that name for use in a task.

    A task has one core. The library's own memo of words is left out: when it is full, asking it costs a
    multiple of the encoding.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, models

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    if model.pop("type") == "BPE":
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.pop("merges")]
        options = {k: v for k, v in model.items() if v is not None}
        tokenizer.model = models.BPE(merges=merges, cache_capacity=0, **options)
    return tokenizer


def byte_letters() -> dict[int, str]:
    """The letter of each byte in a byte-level vocabulary: printable bytes stand for themselves, others from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_CUT = re.compile(r"(?<=\S) (?=\S)").split
# White space by Unicode, for a pattern engine whose own class has only that of ASCII.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NOT_SINGLE = rf"^{_WHITE}|{_WHITE}$|{_WHITE} | {_WHITE}"

# Characters whose composed and lower-case forms do not depend on their neighbours.
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*").fullmatch
# Fixed value: how the library cuts a text for a byte-level vocabulary.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def is_plain(text: str) -> bool:
    return _PLAIN(text) is not None


def plain_find(pattern: str, lowered: bool = False) -> Callable[[str], list[str]] | None:
    """All matches of a pattern in plain text, with classes of letters and digits spelled out; None if others are asked for."""
    letter, digit = "a-zß-öø-ÿ" if lowered else "A-Za-zÀ-ÖØ-öø-ÿ", "0-9"
    # In a set of their own or as part of one.
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letter}{digit}]").replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
    if re.search(r"\[[^\]]*\\p", pattern):
        return None
    pattern = pattern.replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{digit}]")
    return None if r"\p" in pattern else re.compile(pattern).findall


def _cutting(form: dict) -> tuple[str, bool] | None:
    """The pattern that cuts a text into byte-level pieces and whether it is lower-cased first; None for other forms."""
    normal, cut = form["normalizer"], form["pre_tokenizer"] or {}
    if normal is None and cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]:
        return BYTE_LEVEL, False
    steps, cuts = (normal or {}).get("normalizers", []), cut.get("pretokenizers", [])
    if (
        [n["type"] for n in steps] == ["NFC", "Replace", "Lowercase"]
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and (cuts[0]["behavior"], cuts[0]["invert"]) == ("Removed", True)
        and not cuts[1]["add_prefix_space"]
        and not cuts[1]["use_regex"]
    ):
        return cuts[0]["pattern"]["Regex"], True
    return None


def chunk_encoder(path: str, special: bool = True, memo: int = MEMO_PIECES, flat: bool = False) -> Callable[[list[str]], Encoded]:
    """Ids of each chunk, without special tokens added; strings of special tokens get their ids only if ``special``.

    Where the file says that a text is cut by a pattern into byte-level pieces, chunks of plain letters are cut so
    here and only new pieces reach the model; everything else goes through the tokenizer. With ``flat`` they are
    cut all at once where the pattern allows it, and the ids come laid end to end.
    """
    tokenizer = load_tokenizer(path)
    tokenizer.encode_special_tokens = not special
    with open(path, encoding="utf-8") as file:
        form = json.load(file)

    def whole(chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    cutting = _cutting(form)
    if cutting is None:
        return whole
    pattern, lowered = cutting
    find = plain_find(pattern, lowered)
    if find is None:
        return whole
    added = [re.escape(t["content"]) for t in form["added_tokens"]] if special else []
    # Without any, nothing matches.
    find_added = re.compile("|".join(added) or "(?!)").search
    letters = "".join(letter for _, letter in sorted(byte_letters().items()))
    tokens_of, known, plain = tokenizer.model.tokenize, {}, _PLAIN

    def spell(piece: str) -> str:
        return codecs.charmap_decode(piece.encode(), "strict", letters)[0]

    def piece_ids(piece: str) -> list[int]:
        if len(known) >= memo:
            known.clear()
        ids = known[piece] = [t.id for t in tokens_of(spell(piece))]
        return ids

    # Where no match holds or looks at white space, a line end between chunks parts them, and all are cut at once.
    find_lines = plain_find(rf"{pattern}|\n", lowered) if flat and lowered and not find(" \t\n\r") and "(?" not in pattern else None

    def encode_lines(joined: str) -> Encoded:
        pieces = find_lines(f"{joined}\n".lower())
        fresh = set(pieces) - known.keys()
        if len(known) + len(fresh) > memo:
            known.clear()
            fresh = set(pieces)
        for piece in fresh:
            known[piece] = [t.id for t in tokens_of(spell(piece))] if piece != "\n" else []
        found = list(map(known.__getitem__, pieces))
        total = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        ids = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(total[-1]))
        last = np.fromiter((i for i, piece in enumerate(pieces) if piece == "\n"), np.int64)
        return ids, np.diff(total[last], prepend=0)

    def encode(chunks: list[str]) -> Encoded:
        if find_lines is not None and chunks:
            joined = "\n".join(chunks)
            if plain(joined) is not None and find_added(joined) is None and joined.count("\n") == len(chunks) - 1:
                return encode_lines(joined)
            odd = np.array([plain(c) is None or "\n" in c or find_added(c) is not None for c in chunks])
            if not odd.all():
                ids, sizes = encode_lines("\n".join(itertools.compress(chunks, ~odd)))
                rest = whole(list(itertools.compress(chunks, odd)))
                # The plain chunks first, then back in order.
                order = np.argsort(odd, kind="stable")
                starts, size = np.empty_like(order), np.empty_like(order)
                size[order] = [*sizes, *map(len, rest)]
                starts[order] = np.cumsum(size[order]) - size[order]
                ids = np.concatenate([ids, np.fromiter(itertools.chain.from_iterable(rest), np.uint32)])
                return gathered(ids, starts, size), size
        out, odd = [], []
        for i, chunk in enumerate(chunks):
            if plain(chunk) is None or find_added(chunk) is not None:
                odd.append(i)
                out.append([])
                continue
            pieces = find(chunk.lower() if lowered else chunk)
            if len(pieces) == 1:
                ids = known.get(pieces[0])
                out.append(piece_ids(pieces[0]) if ids is None else ids)
                continue
            ids = []
            for piece in pieces:
                found = known.get(piece)
                ids += piece_ids(piece) if found is None else found
            out.append(ids)
        for i, ids in zip(odd, whole([chunks[i] for i in odd]) if odd else [], strict=True):
            out[i] = ids
        return out

    return encode


class Chunks(NamedTuple):
    """``place`` of the chunk in ``chunks`` for every chunk of every document; document i has places[ends[i]:ends[i + 1]]."""

    chunks: list[str]
    places: np.ndarray
    ends: np.ndarray


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, pa.Array]]:
    """Slices of whole documents of some ``limit`` bytes and at most ``rows`` rows with their first row; NULL becomes ''."""
    texts = pc.fill_null(texts, "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    number = np.maximum((np.cumsum(size) - size) // limit, 0) * len(texts) + np.arange(len(texts)) // rows
    starts = np.flatnonzero(np.diff(number, prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(texts)], strict=True):
        yield int(start), texts.slice(start, end - start)


def split(texts: pa.Array, parts: pa.ListArray | None = None) -> Chunks:
    """The texts cut at single spaces, which belong to no chunk; or the chunks given in ``parts``."""
    if parts is None:
        parts = pc.split_pattern(texts, " ")
    ends = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    # By way of numpy, as Arrow makes a scalar of each value for a list.
    return Chunks(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends - ends[0])


def chunks_of(texts: pa.Array) -> Chunks:
    """Chunks of each text: cut at single spaces between characters other than white space."""
    odd = pc.match_substring_regex(texts, _NOT_SINGLE)
    if not pc.any(odd).as_py():
        return split(texts)
    parts = [_CUT(text) if o else text.split(" ") for text, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)]
    return split(texts, pa.array(parts, pa.list_(pa.string())))


def spaced(found: Chunks) -> Chunks:
    """The chunks with the space before them, but for the first of each document."""
    n = len(found.chunks)
    places = found.places + n
    places[found.ends[:-1]] -= n
    used = np.zeros(2 * n, bool)
    used[places] = True
    chunks = [found.chunks[i] if i < n else " " + found.chunks[i - n] for i in np.flatnonzero(used).tolist()]
    return Chunks(chunks, (np.cumsum(used) - 1)[places], found.ends)


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[s : s + n] for every start and size, one after another."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def sums(sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of each document's sizes."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    return total[ends[1:]] - total[ends[:-1]]


# The numbers of each chunk, as lists or laid end to end with how many each has.
Encoded = Sequence[Sequence[int]] | tuple[np.ndarray, np.ndarray]


class Memo:
    """What an encoder gave for the chunks met lately: rows of numbers, laid end to end."""

    def __init__(self, encode: Callable[[list[str]], Encoded], limit: int = MEMO_CHUNKS, dtype: type = np.uint32):
        self.encode, self.limit, self.dtype = encode, limit, dtype
        self._renew()

    def _renew(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.empty(0, self.dtype)
        self.starts = self.sizes = np.empty(0, np.int64)

    def places(self, chunks: list[str]) -> np.ndarray:
        """The row of each chunk. Rows of an earlier call may be gone."""
        place = self.place
        fresh = [c for c in chunks if c not in place]
        if place and fresh and len(place) + len(fresh) > self.limit:
            self._renew()
            place, fresh = self.place, chunks
        if fresh:
            found = self.encode(fresh)
            if isinstance(found, tuple):
                ids, sizes = found
            else:
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                ids = np.fromiter(itertools.chain.from_iterable(found), self.dtype, int(sizes.sum()))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, ids])
            first = len(place)
            place.update(zip(fresh, range(first, first + len(fresh)), strict=True))
        return np.fromiter(map(place.__getitem__, chunks), np.int64, len(chunks))

    def encoded(self, found: Chunks) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents, one document after another, and where each begins."""
        rows = self.places(found.chunks)[found.places]
        sizes = self.sizes[rows]
        ids = gathered(self.ids, self.starts[rows], sizes)
        return ids, np.concatenate(([0], np.cumsum(sums(sizes, found.ends))))


def packed(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """ids[ends[i] : ends[i + 1]] of every i as little-endian unsigned 32-bit integers, without a copy."""
    offsets = pa.py_buffer((4 * ends).astype(np.int64))
    data = pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, offsets, data])
