"""The stages on planted rows, and the whole run on the smallest tables."""

import random

import corpus_pipeline
import pytest
import xxhash
from larkspan.llm import exact, pii
from larkspan.session import load, staging_path

STAGES = dict(corpus_pipeline.STAGES)
KIND = "doc_id long, text string, lang string, source string, n_chars long, row_key string, copy int"


def prose(rng, n):
    return " ".join(rng.choice("alba brio cine dora ener fiel gato hora isla jazz kilo lima mano nube".split()) + rng.choice("abcdefgh") for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        words = prose(rng, 120).split()
        for _ in range(3 * toxic):
            words[rng.randrange(120)] = rng.choice(["vileword", "vilewords", "vilest"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    clean = [t for i, t in rows if i % 5]
    rows += [(1000 + i, " " + clean[i] + "\n") for i in range(5)]  # copies that differ in white space, longer
    near = clean[10].split()
    for i in range(4):
        near[30 * i + 5] = "changed"
        rows.append((2000 + i, " ".join(near)))
    # Of a long text with one word changed in the middle few bits differ, if any.
    far = prose(rng, 4000).split()
    rows.append((2099, " ".join(far)))
    far[2000] = "changed"
    rows.append((2100, " ".join(far)))
    rows += [(3000, "write to a.b@mail.example.com or c [at] d [dot] org " + prose(rng, 50)), (4000, None), (4001, ""), (None, prose(rng, 40)), (1, rows[1][1])]
    docs = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "z", 7) for i, t in rows], KIND)
    path = staging_path(spark, "sf")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs, path


def fingerprint(text):
    """64 bits by the majority of the hashes of all three-word shingles."""
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_copies_dropped(rows):
    """Ids of the rows that are not the first of their component at two or fewer differing bits."""
    prints = [fingerprint(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    first = {}
    for i, r in enumerate(rows):
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        first[find(i)] = min(first.get(find(i), key), key)
    keys = [(r["doc_id"] is None, r["doc_id"] or 0) for r in rows]
    return {r["doc_id"] for i, r in enumerate(rows) if first[find(i)] != keys[i]}


def test_stages(spark, planted):
    docs, path = planted
    ids = lambda frame: sorted((r["doc_id"] for r in frame.select("doc_id").collect()), key=lambda x: (x is None, x))
    clean = STAGES["toxicity"](spark, docs, path)
    assert clean.columns == docs.columns
    kept = ids(clean)
    assert set(kept) == {i for i in ids(docs) if i is None or i >= 300 or i % 5} and kept.count(1) == 2
    clean = spark.createDataFrame(clean.collect(), docs.schema)
    single = STAGES["exact dedup"](spark, clean, path)
    assert single.columns == docs.columns
    kept = ids(single)
    assert kept.count(1) == 0 and 1000 in kept and 4000 in kept and 4001 not in kept and None in kept
    assert len(kept) == clean.count() - 5 - 1 - 1
    single = spark.createDataFrame(single.collect(), docs.schema)
    apart = STAGES["simhash near-dedup"](spark, single, path)
    assert apart.columns == docs.columns
    dropped = near_copies_dropped(single.collect())
    assert set(kept) - set(ids(apart)) == dropped and 2100 in dropped
    assert {tuple(r) for r in apart.select("row_key", "copy").collect()} == {("z", 7)}
    masked = STAGES["pii"](spark, spark.createDataFrame(apart.collect(), docs.schema), path)
    assert masked.columns == docs.columns and ids(masked) == ids(apart)
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in masked.collect()}
    assert texts[3000][0].startswith("write to <EMAIL> or <EMAIL> ") and texts[3000][1] == len(texts[3000][0])
    assert texts[4000] == (None, None)
    assert ids(STAGES["packing"](spark, masked, path)) == ids(apart)


def test_no_documents(spark, planted):
    docs, path = planted
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0


def test_run(spark, sf):
    found = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, sf).collect()}
    docs = load(spark, sf, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    labels = {r["doc_id"]: r["toxic"] for r in load(spark, sf, "labels").collect()}
    assert all(found[d] == len(pii.masked_text(texts[d]).encode().split()) for d in found)
    kept = {r["keep_id"] for r in exact.content_sort(docs).collect()}
    lost = set(texts) - set(found)
    assert set(found) - kept <= {d for d in texts if d not in kept and any(labels.get(k) for k in kept)}
    assert len(lost) < len(texts) / 2
