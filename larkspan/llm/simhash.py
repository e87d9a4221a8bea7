"""SimHash fingerprints, links by bit-sliced comparison, and components.

Fingerprints of a bucket are stored vertically: plane b holds bit b of 64 fingerprints a word. Pairs at
distance d in the bucket's order are compared 64 at a time: planes are XORed with themselves moved by d bits,
the differences are added by carry-save adders into bitwise counters, and words in which every pair is over
the radius are abandoned before the remaining planes are read. Only links that join two parts are given.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import pick, row_key, shuffle_width
from larkspan.session import settle

SEED = 42
# Distinct fingerprints of a bucket that one task compares.
MAX_BUCKET = 20_000
HASHES_AT_ONCE = 200_000
ROWS_AT_ONCE = 60_000
PLANES_AT_ONCE = 32

# Of byte v: eight byte-wide counters, counter b is bit b of v.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Hashes of another lane; lane 0 is the hash itself."""
    if lane == 0:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(lane) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each document the bits set in over half of its hashes, as 8 bytes with the lowest bit first."""
    sizes = np.diff(np.append(starts, len(hashes)))
    # Counters are a byte wide, so they are summed over at most 255 hashes, and those sums over the document.
    pieces = np.concatenate([np.arange(s, s + n, 255) for s, n in zip(starts, sizes, strict=True)])
    first = np.searchsorted(pieces, starts)
    lanes = _SPREAD[hashes.view(np.uint8)].reshape(-1, 8)
    partial = np.add.reduceat(lanes, pieces, axis=0).view(np.uint8).reshape(len(pieces), 64)
    counts = np.add.reduceat(partial.astype(np.int64), first, axis=0)
    return np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little")


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 of every run of ``words`` words, of the whole sequence if it is shorter, of nothing if it has no word."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(itertools.accumulate(len(p) + 1 for p in parts))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s : e - 1], SEED) for s, e in zip([0, *ends], ends[words - 1 :], strict=False)]


def _fingerprints(texts: list[str | None], words: int, lanes: int) -> list[bytes]:
    out: list[bytes | None] = [bytes(8 * lanes)] * len(texts)
    held: list[list[int]] = []
    places: list[int] = []

    def flush() -> None:
        if not held:
            return
        starts = np.cumsum([0, *map(len, held[:-1])])
        hashes = np.fromiter(itertools.chain.from_iterable(held), dtype=np.uint64, count=sum(map(len, held)))
        # Big-endian within a lane, so that the hex form is that of the number.
        bits = np.concatenate([_majority(_mixed(hashes, lane), starts)[:, ::-1] for lane in range(lanes)], axis=1)
        for place, row in zip(places, bits, strict=True):
            out[place] = row.tobytes()
        held.clear()
        places.clear()

    size = 0
    for i, text in enumerate(texts):
        if found := shingle_hashes(text, words):
            held.append(found)
            places.append(i)
            size += len(found)
            if size >= HASHES_AT_ONCE:
                flush()
                size = 0
    flush()
    return out


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row_key and fingerprint (binary, 64 bits a lane) of each row of ``docs``, over the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _fingerprints(batch.column("text").to_pylist(), words, lanes)
            yield pa.record_batch([batch.column("id"), batch.column("row_key"), pa.array(found, pa.binary())], names=["id", "row_key", "fingerprint"])

    rows = pick(docs, id=id_col, text=text_col)
    rows = rows.select(F.col("id").cast("long"), row_key(F.col("id"), F.col("text")).alias("row_key"), "text")
    return rows.mapInArrow(run, "id long, row_key long, fingerprint binary")


def exact_tables(bits: int, radius: int, blocks: int = 4) -> list[list[int]]:
    """Choices of bits of which any two fingerprints within the radius share at least one: all but ``radius`` blocks."""
    cuts = np.array_split(np.arange(bits), blocks)
    return [np.concatenate(c).tolist() for c in itertools.combinations(cuts, blocks - radius)]


def band_tables(bits: int, width: int = 16, passes: int = 2) -> list[list[int]]:
    """Bands of ``width`` bits: neighbours in the first pass, then bits at equal steps."""
    bands = bits // width
    out = [list(range(i * width, (i + 1) * width)) for i in range(bands)]
    if passes > 1:
        out += [list(range(i, bits, bands)) for i in range(bands)]
    return out


def _bits(prints: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1), axis=1)


def _bucketed(nodes: DataFrame, tables: list[list[int]]) -> DataFrame:
    """A row for each fingerprint and table; ``bucket`` is the number of the table and its bits, hashed to 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fingerprint").to_pylist()
            if not prints:
                continue
            bits = _bits(prints)
            for number, table in enumerate(tables):
                packed = np.packbits(bits[:, table], axis=1)
                wide = np.zeros((len(prints), 8), np.uint8)
                wide[:, : packed.shape[1]] = packed[:, :8]
                keys = wide.view(np.uint64).ravel()
                keys = _mixed(keys ^ (np.uint64(number) << np.uint64(48)), 1).view(np.int64)
                yield pa.record_batch([pa.array(keys), batch.column("node"), batch.column("fingerprint")], names=["bucket", "node", "fingerprint"])

    return nodes.mapInArrow(run, "bucket long, node long, fingerprint binary")


def _added(rows: list[np.ndarray], counters: list[np.ndarray | None]) -> None:
    """Add bit rows into bitwise counters by carry-save adders; ``rows`` is one array (planes, words)."""
    weight, level = rows[0], 0
    while len(weight):
        if len(counters) == level:
            counters.append(None)
        if counters[level] is not None:
            weight = np.concatenate([weight, counters[level][None]])
        carries = []
        while len(weight) >= 3:
            n = len(weight) // 3
            a, b, c = weight[:n], weight[n : 2 * n], weight[2 * n : 3 * n]
            ab = a ^ b
            carries.append((a & b) | (ab & c))
            weight = np.concatenate([ab ^ c, weight[3 * n :]])
        if len(weight) == 2:
            carries.append((weight[0] & weight[1])[None])
            weight = (weight[0] ^ weight[1])[None]
        counters[level] = weight[0]
        weight = np.concatenate(carries) if carries else weight[:0]
        level += 1


def _within(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits of the columns whose counter is at most the radius."""
    less = np.zeros_like(counters[0])
    equal = ~less
    for level in range(max(len(counters), radius.bit_length()) - 1, -1, -1):
        bit = counters[level] if level < len(counters) else np.zeros_like(less)
        if radius >> level & 1:
            less |= equal & ~bit
            equal &= bit
        else:
            equal &= ~bit
    return less | equal


def bucket_links(buckets: np.ndarray, prints: list[bytes], radius: int) -> list[tuple[int, int]]:
    """Pairs of rows that join all rows within the radius of each other in a bucket; rows lie by bucket."""
    n = len(buckets)
    changes = np.flatnonzero(np.append(buckets[1:] != buckets[:-1], True)) + 1
    end = changes[np.searchsorted(changes, np.arange(n), side="right")]
    rows = np.flatnonzero(np.arange(n) + 1 < end)
    if not len(rows):
        return []
    bits = _bits(prints)
    words = -(-n // 64)
    # One word of zeros more than the largest move needs.
    planes = np.zeros((bits.shape[1], words + 2 + int((end - np.arange(n)).max()) // 64), np.uint64)
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    planes.view(np.uint8)[:, : packed.shape[1]] = packed
    root = np.arange(n)
    links: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    move = 0
    while True:
        move += 1
        rows = rows[rows + move < end[rows]]
        if not len(rows):
            return links
        open_rows = rows[root[rows] != root[rows + move]]
        if not len(open_rows):
            continue
        at = np.unique(open_rows >> 6)
        over, bit = divmod(move, 64)
        counters: list[np.ndarray | None] = []
        for first in range(0, len(planes), PLANES_AT_ONCE):
            some = planes[first : first + PLANES_AT_ONCE]
            moved = some[:, at + over] >> np.uint64(bit)
            if bit:
                moved |= some[:, at + over + 1] << np.uint64(64 - bit)
            _added([some[:, at] ^ moved], counters)
            if first + PLANES_AT_ONCE < len(planes) and first + PLANES_AT_ONCE > radius:
                alive = _within(counters, radius) != 0
                if not alive.all():
                    at, counters = at[alive], [c[alive] for c in counters]
                    if not len(at):
                        break
        if not len(at):
            continue
        near = np.unpackbits(_within(counters, radius)[:, None].view(np.uint8), axis=1, bitorder="little")
        hits = ((at[:, None] << 6) + np.arange(64))[near.astype(bool)]
        hits = hits[hits + move < n]
        hits = hits[(hits + move < end[hits]) & (root[hits] != root[np.minimum(hits + move, n - 1)])]
        for i in hits.tolist():
            a, b = find(i), find(i + move)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((i, i + move))
        while len(hits) and not np.array_equal(up := root[root], root):
            root[:] = up


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows of whole buckets; buckets are compared when enough complete ones are held."""

        def links(buckets: np.ndarray, nodes: np.ndarray, prints: list[bytes]) -> pa.RecordBatch:
            pairs = np.array(bucket_links(buckets, prints, radius), np.int64).reshape(-1, 2)
            return pa.record_batch([pa.array(nodes[pairs[:, 0]]), pa.array(nodes[pairs[:, 1]])], names=["a", "b"])

        buckets, nodes, prints = np.empty(0, np.int64), np.empty(0, np.int64), []
        for batch in batches:
            # A bucket and its part together tell buckets apart, as rows are sorted by both.
            keys = batch.column("bucket").to_numpy() + batch.column("part").to_numpy().astype(np.int64)
            buckets = np.concatenate([buckets, keys])
            nodes = np.concatenate([nodes, batch.column("node").to_numpy()])
            prints += batch.column("fingerprint").to_pylist()
            if len(buckets) >= ROWS_AT_ONCE:
                whole = int(np.flatnonzero(buckets != buckets[-1])[-1]) + 1 if (buckets != buckets[-1]).any() else 0
                if whole:
                    yield links(buckets[:whole], nodes[:whole], prints[:whole])
                    buckets, nodes, prints = buckets[whole:], nodes[whole:], prints[whole:]
        if len(buckets):
            yield links(buckets, nodes, prints)

    return run


def links_between(nodes: DataFrame, tables: list[list[int]], radius: int, exact: bool, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``nodes`` (node, fingerprint) within the radius.

    Buckets above ``max_bucket`` are not compared in one task. With ``exact`` (64 bits, radius 2) their
    fingerprints are linked through the 65 values at most one bit away: two fingerprints are within two
    bits just when they share such a value, and no value is shared by more than 65. Without, such a bucket
    is cut into parts, and every two parts are compared in a task of their own, so that no pair is left out.
    """
    keyed = _bucketed(nodes, tables)
    counts = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > max_bucket)
    hot = settle(counts)
    some_hot = not hot.isEmpty()
    if not some_hot:
        keyed = keyed.withColumn("part", F.lit(0))
    elif exact:
        large = keyed.join(hot, "bucket", "left_semi").select("node", "fingerprint").distinct()
        keyed = keyed.join(hot, "bucket", "left_anti").withColumn("part", F.lit(0))
    else:
        # Part i and part j meet in task i * parts + j, i <= j; parts of half the bound make a task of the bound.
        parts = F.ceil(2 * F.col("members") / F.lit(max_bucket)).cast("long")
        own = F.pmod(F.xxhash64("node", "bucket"), parts)
        met = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda i: F.least(i, own) * parts + F.greatest(i, own))
        chosen = F.when(F.col("members").isNull(), F.array(F.lit(0).cast("long"))).otherwise(met)
        keyed = keyed.join(hot, "bucket", "left").withColumn("part", F.explode(chosen)).drop("members")
    compared = (
        keyed.select("bucket", "part", "node", "fingerprint")
        .repartition(shuffle_width(nodes), "bucket", "part")
        .sortWithinPartitions("bucket", "part", "fingerprint")
        .mapInArrow(_compare(radius), "a long, b long")
    )
    if some_hot and exact:
        value = F.conv(F.hex("fingerprint"), 16, -10).cast("long")
        near = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
        near = F.concat(F.array(F.lit(0).cast("long")), near)
        shared = large.select("node", F.explode(F.transform(near, lambda b: value.bitwiseXOR(b))).alias("value"))
        stars = shared.groupBy("value").agg(F.min("node").alias("a"), F.collect_set("node").alias("all"))
        compared = compared.unionByName(stars.select("a", F.explode("all").alias("b")).where("a <> b"))
    return compared


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches, by large-star and small-star rounds.

    Every round is written, so a lost executor costs one round; rounds grow with the logarithm of the
    longest chain. Not converging in ``max_rounds`` is an error.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            around = edges.select("a", "b").union(edges.select("b", "a"))
        else:
            around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        met = around.join(least, "a")
        if large:
            return met.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        down = met.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        return down.union(least.select("a", F.col("least").alias("b"))).where("a <> b").distinct()

    edges = settle(links.where("a <> b").distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    last = None
    for _ in range(max_rounds):
        edges = settle(star(star(edges, True), False))
        # The sums only fall until every node hangs on its component's least node.
        state = edges.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.col("a").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        last = tuple(state)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def clusters(
    docs: DataFrame,
    words: int = 3,
    lanes: int = 1,
    radius: int = 2,
    tables: list[list[int]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bucket: int = MAX_BUCKET,
) -> DataFrame:
    """One row per row of ``docs``: id, row_key, fingerprint, component_id, cluster.

    Fingerprints link at ``radius`` or fewer differing bits, and component_id is the smallest id reachable.
    Without ``tables`` every link counts (64 bits, radius 2); with band tables, pairs must share a band.
    A NULL or empty text, or one of white space, has the fingerprint zero, which links like any other.
    Ids are meant to be of one text each; fingerprints with the same smallest id count as linked. A NULL id
    never is a component_id: rows of a component without any id have NULL, but one ``cluster`` number.
    Further columns are ignored; an empty table gives no rows.
    """
    exact = tables is None
    if exact and (lanes, radius) != (1, 2):
        raise ValueError("without tables only 64 bits and a radius of 2 are exact")
    rows = settle(fingerprints(docs, words, lanes, id_col, text_col))
    # Fingerprints of rows without id get numbers at the upper end of the range.
    nameless = F.lit((1 << 63) - 1) - F.pmod(F.xxhash64("fingerprint"), F.lit(1 << 40))
    nodes = settle(rows.groupBy("fingerprint").agg(F.min("id").alias("node")).withColumn("node", F.coalesce("node", nameless)))
    found = links_between(nodes, tables or exact_tables(64, radius), radius, exact, max_bucket)
    reach = components(found)
    named = nodes.join(reach, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("cluster"))
    return rows.join(named, "fingerprint").select(
        "id", "row_key", "fingerprint",
        F.when(F.col("cluster") <= F.lit((1 << 63) - 1 - (1 << 40)), F.col("cluster")).alias("component_id"),
        "cluster",
    )
