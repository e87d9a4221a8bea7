"""Removal of byte strings of a given length that also start elsewhere, by a sampled suffix sort.

Of the windows of ``length`` bytes, neighbours that agree on where their least-hashed gram lies, their anchor,
form one block; equal windows have equal anchors. So only suffixes that begin at anchors need sorting: an
anchor's suffix begins with a core that every window of its block holds. Anchors whose core is unique drop out
after a count, blocks that are repeated as a whole are settled by their hash, and the text of the others, one
copy of each different block, is dealt to ranges of the leading bytes by sampled splitters. A range is sorted
by multikey quicksort, suffixes rightwards and what precedes the anchors leftwards, and two windows are equal
just when both sorts put them together. Equal leading bytes always lie in one range, so that no comparison
across a boundary is left over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import pick, row_key, shuffle_width
from larkspan.session import settle

LENGTH = 400
GRAM = 8
CHUNK_BYTES = 1 << 20
BLOCKS_AT_ONCE = 20_000
# Different blocks of one core that one task sorts; windows of larger ones are counted one by one.
MAX_BLOCKS = 100_000

_ANCHOR = "core long, block long, id long, row_key long, low int, high int, anchor int"


def window_of(length: int) -> int:
    """Bytes among which a window looks for its anchor; the rest, at least a gram, follows every anchor."""
    if length < 2 * GRAM:
        raise ValueError(f"strings of fewer than {2 * GRAM} bytes have no anchors")
    return min(length - GRAM + 1, max(1, length * 16 // 25))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, the first byte highest; zeros follow the end."""
    out = np.append(data, np.zeros(7, np.uint8)).astype(np.uint64)
    for shift in (1, 2, 4):
        out = (out[: len(out) - shift] << np.uint64(8 * shift)) | out[shift:]
    return out


def _runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor) of each block of documents laid end to end, as places in ``data``."""
    width = window_of(length)
    n = len(data)
    keys = _words(data)
    with np.errstate(over="ignore"):
        keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    # The hash decides, then the place: the leftmost of equal grams.
    keys &= np.uint64(0xFFFFFFFF00000000)
    keys |= np.arange(n, dtype=np.uint64)
    reach = 1
    while 2 * reach <= width:
        keys = np.minimum(keys[: len(keys) - reach], keys[reach:])
        reach *= 2
    if width > reach:
        keys = np.minimum(keys[: len(keys) - (width - reach)], keys[width - reach :])
    anchor = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner_end = np.repeat(ends, np.diff(np.append(0, ends)))[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= owner_end
    first = valid.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | (owner_end[1:] != owner_end[:-1]) | ~valid[:-1]
    low = np.flatnonzero(first)
    last = valid.copy()
    last[:-1] &= (anchor[1:] != anchor[:-1]) | (owner_end[1:] != owner_end[:-1]) | ~valid[1:]
    return low, np.flatnonzero(last), anchor[low]


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    core_bytes = length - window_of(length) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            ids, keys = batch.column("id"), batch.column("row_key")
            held: list[int] = []
            size = 0
            for i, text in enumerate(texts):
                if len(text) >= length:
                    held.append(i)
                    size += len(text)
                if held and (size >= CHUNK_BYTES or i + 1 == len(texts)):
                    yield part([texts[k] for k in held], ids, keys, np.array(held))
                    held, size = [], 0

    def part(texts: list[bytes], ids: pa.Array, keys: pa.Array, rows: np.ndarray) -> pa.RecordBatch:
        joined = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        low, high, anchor = _runs(np.frombuffer(joined, np.uint8), ends, length)
        owner = np.searchsorted(ends, low, side="right")
        start = np.append(0, ends)[owner]
        digest = xxhash.xxh64_intdigest
        cores = [digest(joined[a : a + core_bytes]) for a in anchor.tolist()]
        blocks = [digest(joined[p : q + length], a - p + 1) for p, q, a in zip(low.tolist(), high.tolist(), anchor.tolist(), strict=True)]
        at = pa.array(rows[owner])
        whole = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (cores, blocks)]
        place = [pa.array((x - start).astype(np.int32)) for x in (low, high, anchor)]
        return pa.record_batch([*whole, ids.take(at), keys.take(at), *place], names=["core", "block", "id", "row_key", "low", "high", "anchor"])

    return docs.mapInArrow(run, _ANCHOR)


def multikey_order(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each string, bytes that each place of the order shares with the one before), zeros after the ends.

    Multikey quicksort with letters of eight bytes: what is still tied is divided by its next letter, and only
    parts of equal letters go on to the one after.
    """
    n = len(strings)
    letters = -(-width // 8)
    grid = np.zeros((n, 8 * letters), np.uint8)
    sizes = np.fromiter(map(len, strings), np.int64, count=n)
    grid[np.arange(8 * letters) < sizes[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    table = grid.view(">u8").astype(np.uint64)
    order = np.arange(n)
    shared = np.zeros(n, np.int64)
    # Places of the order that still lie in parts of equal strings, and the part of each.
    places, group = np.arange(n), np.zeros(n, np.int64)
    for letter in range(letters):
        if not len(places):
            break
        key = table[order[places], letter]
        by = np.lexsort((key, group))
        order[places] = order[places][by]
        key, group = key[by], group[by]
        same_part = np.append(False, group[1:] == group[:-1])
        differ = key != np.append(key[:1], key[:-1])
        split = same_part & differ
        apart = key[split] ^ key[np.flatnonzero(split) - 1]
        alike = sum((apart < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(1, 8))
        shared[places[split]] = 8 * letter + alike
        part = np.cumsum(~(same_part & ~differ))
        size = np.bincount(part)
        tied = size[part] > 1
        places, group = places[tied], part[tied]
    first = np.ones(len(places), bool)
    first[1:] = group[1:] != group[:-1]
    shared[places[~first]] = 8 * letters
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return rank, shared


def repeated_windows(left: list[bytes], right: list[bytes], least: np.ndarray, most: np.ndarray, length: int) -> np.ndarray:
    """Matrix [block, bytes before the anchor]: whether the window there equals one of another block.

    ``left``: bytes before the anchor, backwards; ``right``: bytes from the anchor on. A block has windows that
    begin ``least`` to ``most`` bytes before its anchor.
    """
    n, width = len(left), window_of(length)
    rank_right, shared_right = multikey_order(right, length)
    rank_left, shared_left = multikey_order(left, width)
    found = np.zeros((n, width), bool)
    for before in range(int(least.min()), int(most.max()) + 1):
        active = np.flatnonzero((least <= before) & (before <= most))
        if len(active) < 2:
            continue
        after = np.cumsum(shared_right < length - before)[rank_right[active]]
        # Nothing before the anchor is shared by all.
        ahead = np.cumsum(shared_left < before)[rank_left[active]]
        _, where, count = np.unique(after * (n + 1) + ahead, return_inverse=True, return_counts=True)
        found[active, before] = count[where] > 1
    return found


def _compared(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by core; whole cores are solved together when enough of them are held."""
        held: list[tuple] = []

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            _, ids, keys, low, high, anchor, texts = zip(*rows, strict=True)
            low, high, anchor = (np.array(x, np.int64) for x in (low, high, anchor))
            left = [t[: a - p][::-1] for t, a, p in zip(texts, anchor.tolist(), low.tolist(), strict=True)]
            right = [t[a - p :] for t, a, p in zip(texts, anchor.tolist(), low.tolist(), strict=True)]
            found = repeated_windows(left, right, anchor - high, anchor - low, length)
            edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            block, near = np.nonzero(edge == 1)
            _, far = np.nonzero(edge == -1)
            start, end = anchor[block] - far + 1, anchor[block] - near + length
            columns = [[ids[b] for b in block.tolist()], [keys[b] for b in block.tolist()]]
            return pa.record_batch([*(pa.array(c, pa.int64()) for c in columns), *(pa.array(x.astype(np.int32)) for x in (start, end))], names=["id", "row_key", "start", "end"])

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("core", "id", "row_key", "low", "high", "anchor", "content")), strict=True)
            if len(held) >= BLOCKS_AT_ONCE and held[0][0] != held[-1][0]:
                whole = len(held)
                while held[whole - 1][0] == held[-1][0]:
                    whole -= 1
                yield solve(held[:whole])
                held = held[whole:]
        if held:
            yield solve(held)

    return run


_SPAN = "id long, row_key long, start int, end int"


def _counted(blocks: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows by counting the digest of every window, for cores of very many different blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                count = row["high"] - row["low"] + 1
                pairs = np.array([divmod(xxhash.xxh3_128_intdigest(row["content"][i : i + length]), 1 << 64) for i in range(count)], np.uint64).view(np.int64)
                yield pa.record_batch(
                    [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array([row["id"]] * count, pa.int64()), pa.array([row["row_key"]] * count), pa.array(np.arange(row["low"], row["high"] + 1, dtype=np.int32))],
                    names=["upper", "lower", "id", "row_key", "start"],
                )

    windows = blocks.mapInArrow(run, "upper long, lower long, id long, row_key long, start int")
    often = windows.groupBy("upper", "lower").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return windows.join(often, ["upper", "lower"]).select("id", "row_key", "start", (F.col("start") + length).alias("end"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(id, row_key, spans): the unmerged byte ranges of rows (id, row_key, text) covered by repeated windows."""
    anchors = settle(_anchors(docs, length))
    cores = anchors.groupBy("core").agg(
        F.count(F.lit(1)).alias("n"), (F.min("block") < F.max("block")).alias("mixed")
    )
    # Written, so that the join deals its sides out anew and a core of very many anchors can be split.
    again = settle(anchors.join(settle(cores.where("n > 1").drop("n")), "core"))
    span = ["id", "row_key", F.col("low").alias("start"), (F.col("high") + length).alias("end")]
    spans = again.where("NOT mixed").select(*span)
    mixed = again.where("mixed").drop("mixed")
    blocks = settle(
        mixed.groupBy("core", "block").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "row_key", "low", "high", "anchor")).alias("one"))
    )
    spans = spans.unionByName(mixed.join(blocks.where("n > 1").select("core", "block"), ["core", "block"]).select(*span))
    wanted = blocks.select("core", "one.*").groupBy("id", "row_key").agg(F.collect_list(F.struct("core", "low", "high", "anchor")).alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row_id, key, text, cuts in zip(*(batch.column(c).to_pylist() for c in ("id", "row_key", "text", "cuts")), strict=True):
                data = text.encode()
                out += [(c["core"], row_id, key, c["low"], c["high"], c["anchor"], data[c["low"] : c["high"] + length]) for c in cuts]
            if out:
                kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["core", "id", "row_key", "low", "high", "anchor", "content"])

    keyed = wanted.withColumnsRenamed({"id": "_id", "row_key": "_key"})
    # Rows that agree in id and text are cut alike, and all they hold is repeated.
    met = docs.join(keyed, docs["id"].eqNullSafe(keyed["_id"]) & (docs["row_key"] == keyed["_key"])).select("id", "row_key", "text", "cuts")
    pieces = settle(met.mapInArrow(cut, "core long, id long, row_key long, low int, high int, anchor int, content binary"))
    core_bytes = length - window_of(length) + 1
    lead = F.expr(f"substring(content, anchor - low + 1, {core_bytes})")
    large = settle(blocks.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_blocks).select("core"))
    if not large.isEmpty():
        spans = spans.unionByName(_counted(pieces.join(large, "core", "left_semi"), length))
        pieces = pieces.join(large, "core", "left_anti")
    sorted_pieces = pieces.repartitionByRange(shuffle_width(docs), lead).sortWithinPartitions("core")
    spans = spans.unionByName(sorted_pieces.mapInArrow(_compared(length), _SPAN))
    return spans.groupBy("id", "row_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, spans (removed byte ranges, merged), kept (the bytes left).

    Removed is each byte that a string of ``length`` bytes covers which starts anywhere else too, in this text or
    another; strings are judged on the input and never cross texts. A NULL text is empty; texts shorter than
    ``length`` stay whole; of repeated rows each loses what the other holds. Further columns are ignored; an
    empty table gives no rows.
    """
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("row_key", row_key(F.col("id"), F.col("text")))
    found = repeated_spans(rows, length, max_blocks).withColumnsRenamed({"id": "_id", "row_key": "_key"})
    met = rows.join(found, rows["id"].eqNullSafe(found["_id"]) & (rows["row_key"] == found["_key"]), "left").select("id", "text", "spans")
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, merged, kept = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data, own, parts, done = text.encode(), [], [], 0
                for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
                    if own and start <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], end)
                    else:
                        own.append({"start": start, "end": end})
                for s in own:
                    parts.append(data[done : s["start"]])
                    done = s["end"]
                sizes.append(len(data))
                merged.append(own)
                kept.append(b"".join([*parts, data[done:]]))
            yield pa.record_batch([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(merged, span_type), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    return met.mapInArrow(remove, "id long, n_bytes long, spans array<struct<start int, end int>>, kept binary")
