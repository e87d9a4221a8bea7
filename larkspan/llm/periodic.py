"""Runs of words that repeat with a period, found on harmonic grids by longest common extensions.

For each period q the words at multiples of a step are compared with those q places on. A run of enough words
meets the grid of its period, so extending the equal places to both sides finds it; the grids of all periods have
some n log n places together. Extensions that end within a few words are read off; of the others the suffixes
at a difference cover of the places are sorted, a few words bring any two places to covered ones at once, and
a sparse table over the sorted suffixes' common prefixes gives the rest in constant time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm import words
from larkspan.llm.common import pick

# Any two residues have an equal distance to two members of the cover.
MODULUS = 13
COVER = [0, 1, 3, 9]
MIN_LENGTH = 6
MIN_REPEATS = 4

_NUMBER = np.full(MODULUS, -1)
_NUMBER[COVER] = np.arange(len(COVER))
_SYNC = np.array(
    [
        [next(d for d in range(MODULUS) if _NUMBER[(i + d) % MODULUS] >= 0 and _NUMBER[(j + d) % MODULUS] >= 0) for j in range(MODULUS)]
        for i in range(MODULUS)
    ]
)


def equal_words(codes: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from i and from j on agree, at most ``most``; read one after another."""
    out = np.zeros(len(i), np.int64)
    at = np.flatnonzero(most > 0)
    while len(at):
        same = codes[i[at] + out[at]] == codes[j[at] + out[at]]
        at = at[same]
        out[at] += 1
        at = at[out[at] < most[at]]
    return out


class Extensions:
    """Longest common extensions to the right of any two places of ``codes``.

    Words are codes from 0 on. Below 0 are separators, each there once, so that no extension passes one; the
    last code is a separator.
    """

    def __init__(self, codes: np.ndarray):
        low = int(codes.min())
        self.codes = np.concatenate([codes, low - 1 - np.arange(2 * MODULUS)])
        cells = -(-len(codes) // MODULUS)
        place = (np.arange(cells)[:, None] * MODULUS + np.array(COVER)).ravel()
        self._sort(place[place < len(codes)])

    def _sort(self, place: np.ndarray) -> None:
        """Sort the suffixes at the places: by their first words, then by doubling, ties only."""
        m, width = len(place), len(COVER)
        shifted = self.codes - self.codes.min()
        bits = max(1, int(shifted.max()).bit_length())
        order, rank = np.arange(m), np.zeros(m, np.int64)
        tied = np.arange(m)  # places in the order whose suffixes still have an equal

        def refine(key: np.ndarray) -> None:
            nonlocal tied
            members = order[tied]
            by = np.lexsort((key, rank[members]))
            members, key = members[by], key[by]
            group = rank[members]
            begins = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))
            order[tied] = members
            rank[members] = tied[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
            alone = begins & np.append(begins[1:], True)
            tied = tied[~alone]

        step = max(1, 62 // bits)
        for first in range(0, MODULUS, step):
            if len(tied):
                key = np.zeros(len(tied), np.int64)
                for t in range(first, min(first + step, MODULUS)):
                    key = (key << bits) | shifted[place[order[tied]] + t]
                refine(key)
        # ranks[k] agree for suffixes with the same first MODULUS * 2**k words.
        ranks, reach = [rank.astype(np.int32)], width
        while len(tied):
            refine(rank[order[tied] + reach])
            ranks.append(rank.astype(np.int32))
            reach *= 2
        self.rank = rank
        if m < 2:
            self.table = np.zeros((1, m), np.int64)
            return
        left, right = order[:-1], order[1:]
        steps = np.zeros(m - 1, np.int64)
        for level in reversed(range(len(ranks))):
            known = ranks[level]
            ahead = np.maximum(left, right) + steps
            same = (ahead < m) & (known[np.minimum(left + steps, m - 1)] == known[np.minimum(right + steps, m - 1)])
            steps += same * (width << level)
        common = steps // width * MODULUS
        common += equal_words(self.codes, place[left] + common, place[right] + common, np.full(m - 1, MODULUS))
        layers = [np.append(0, common)]
        while 2 * (1 << (len(layers) - 1)) < m:
            last, half = layers[-1], 1 << (len(layers) - 1)
            layers.append(np.append(np.minimum(last[:-half], last[half:]), last[len(last) - half :]))
        self.table = np.stack(layers)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and j on, for arrays of different places."""
        sync = _SYNC[i % MODULUS, j % MODULUS]
        out = equal_words(self.codes, i, j, sync)
        rest = np.flatnonzero(out == sync)
        if len(rest):
            a, b = (
                self.rank[p // MODULUS * len(COVER) + _NUMBER[p % MODULUS]] for p in (i[rest] + sync[rest], j[rest] + sync[rest])
            )
            first, last = np.minimum(a, b) + 1, np.maximum(a, b)
            layer = np.log2(last - first + 1).astype(np.int64)
            out[rest] += np.minimum(self.table[layer, first], self.table[layer, last - (1 << layer) + 1])
        return out


def grid_pairs(codes: np.ndarray, document: np.ndarray, longest: int, min_length: int, min_repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of equal words on the grids of all periods, within a document."""
    places, periods = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for q in range(1, longest // min_repeats + 1):
        # So many equal pairs lie one after another in a run of the least length.
        step = max(min_length, min_repeats * q) - q
        later = codes[q::step]
        found = np.flatnonzero(codes[::step][: len(later)] == later) * step
        if len(found):
            found = found[document[found] == document[found + q]]
            places.append(found)
            periods.append(np.full(len(found), q))
    return np.concatenate(places), np.concatenate(periods)


def find_runs(
    codes: np.ndarray, ends: np.ndarray, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of documents laid end to end, by start, then period.

    Document i has codes[ends[i] : ends[i + 1]]. A run is a stretch with smallest period q of at least
    max(min_length, min_repeats * q) words that no neighbouring word extends; min_repeats is 3 or more.
    """
    sizes = np.diff(ends)
    document = np.repeat(np.arange(len(sizes)), sizes)
    laid, home = _separated(codes, ends)
    owner = np.full(len(laid), -1)
    owner[home] = document
    place, period = grid_pairs(laid, owner, int(sizes.max(initial=0)), min_length, min_repeats)
    if not len(place):
        return (np.empty(0, np.int64),) * 3
    few = np.full(len(place), MODULUS)
    back = laid[::-1]
    after = equal_words(np.append(laid, np.full(MODULUS, laid.min() - 1)), place, place + period, few)
    before = equal_words(np.append(back, np.full(MODULUS, laid.min() - 1)), len(laid) - place, len(laid) - place - period, few)
    far = np.flatnonzero((after == MODULUS) | (before == MODULUS))
    if len(far):
        # Only documents with such places are sorted.
        some = np.unique(owner[place[far]])
        begin = ends[some]
        part = words.gathered(codes, begin, sizes[some])
        part_ends = np.concatenate(([0], np.cumsum(sizes[some])))
        packed, _ = _separated(part, part_ends)
        moved = np.zeros(len(sizes), np.int64)
        # A separator stands before each document.
        moved[some] = part_ends[:-1] + np.arange(len(some)) - (begin + some)
        i = place[far] + moved[owner[place[far]]]
        j = i + period[far]
        after[far] = Extensions(packed)(i, j)
        before[far] = Extensions(packed[::-1].copy())(len(packed) - i, len(packed) - j)
    pairs = after + before
    good = pairs >= np.maximum(min_length, min_repeats * period) - period
    start, period = (place - before)[good], period[good]
    length = pairs[good] + period
    # A multiple of the period gives the same stretch, and several places of a grid the same run.
    order = np.lexsort((period, start + length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    start = start[order]
    return start - owner[start] - 1, length[order], period[order]


def _separated(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents with a separator before, between and after them, and the new place of each word."""
    count = len(ends) - 1
    home = np.arange(len(codes)) + np.repeat(np.arange(count), np.diff(ends)) + 1
    laid = np.empty(len(codes) + count + 1, np.int64)
    separators = np.ones(len(laid), bool)
    separators[home] = False
    laid[home] = codes
    laid[separators] = -1 - np.arange(count + 1)
    return laid, home


def _words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and where each text's words begin and end."""
    parts = pc.ascii_split_whitespace(texts)
    ends = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0)
    before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    return flat.filter(full), before[ends - ends[0]]


def periodic_runs(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs and kept.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``runs`` lists start, length and period of every run, by
    start, then period; see ``find_runs``. ``kept`` has the words, joined by single spaces, but for those in some
    run after that run's first period. A NULL or empty text, or one of white space, has no words, no runs and
    the empty text. Whole texts; equal rows and NULL ids stay; further columns are ignored; an empty table gives
    no rows. No shuffle; memory grows with the longest text.
    """
    if min_repeats < 3:
        raise ValueError("runs of fewer than three periods do not meet the grid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in words.blocks(batch.column("text")):
                flat, ends = _words_of(texts)
                codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                start, length, period = find_runs(codes, ends, min_length, min_repeats)
                depth = np.zeros(len(codes) + 1, np.int64)
                np.add.at(depth, start + period, 1)
                np.add.at(depth, start + length, -1)
                stays = np.cumsum(depth[:-1]) == 0
                left = np.concatenate(([0], np.cumsum(stays)))[ends]
                lists = pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(stays)))
                document = np.searchsorted(ends, start, side="right") - 1
                runs = pa.StructArray.from_arrays(
                    [pa.array(start - ends[document]), pa.array(length), pa.array(period)], ["start", "length", "period"]
                )
                bounds = np.searchsorted(document, np.arange(len(ends)))
                columns = [
                    batch.column("id").slice(first, len(texts)),
                    pa.array(np.diff(ends)),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs),
                    pc.binary_join(lists, " "),
                ]
                yield pa.record_batch(columns, names=["id", "n_words", "runs", "kept"])

    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), "text")
    return rows.mapInArrow(
        run, "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept string"
    )
