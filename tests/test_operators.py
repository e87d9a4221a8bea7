"""Operators with state, ranks, matching and naming: fixtures, invariants and brute force."""

import itertools
import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from larkspan.operators import corpus as K
from larkspan.operators import listings as L
from larkspan.operators import matching as M
from larkspan.operators import messages as G
from larkspan.operators import registry as R
from larkspan.operators import retrieval, skew, state
from larkspan.operators.lookups import strict_lookup

LISTING = (
    "id long, url string, type string, rooms int, renovation string, sales_agent_organization string, "
    "price_value double, area_value double"
)


def test_below_market_traps(spark):
    def offer(i, price, area=100.0, rooms=1, renovation=None, organization="x", kind=L.SALE):
        return (i, f"u{i}", kind, rooms, renovation, organization, price, area)

    normal = [offer(i, 10000.0) for i in range(10)]
    cases = normal + [
        offer(100, 9500.0),  # exactly 5 % below the median
        offer(101, 9501.0),
        offer(102, 5000.0, organization=None),
        offer(103, 5000.0, organization="out"),
        offer(104, 5000.0, rooms=2),
        offer(105, 5000.0, renovation="other"),
        offer(106, 50.0, area=20.0),
        offer(107, 5000.0, kind="аренда"),
        offer(108, 5000.0, rooms=None),  # a group of one row has no deviation and drops out
        offer(109, 9000.0, renovation=L.UNRENOVATED),
    ]
    frame = spark.createDataFrame(cases, LISTING)
    for bound in (1_000_000, 3):
        got = L.below_market(frame, excluded_organization="out", max_median_rows=bound)
        assert rows(got, "id", "median_price_sqm") == [(100, 100.0), (109, 100.0)]


def test_narrowed_median_is_exact(spark):
    rng = random.Random(3)
    data = [(g, rng.choice([rng.random() * 10**e, 5.0])) for g, e in enumerate((0, 3, 6)) for _ in range(400)]
    data += [(7, 1.0), (8, 1.0), (8, 2.0)] + [(9, 4.0)] * 50
    frame = spark.createDataFrame(data, "g int, v double")
    exact = rows(L.group_median(frame, "g", "v"), "g", "median_price_sqm", "objects_count")
    for limit, buckets in ((1, 2), (10, 7), (10**6, 4)):
        got = L.narrowed_median(frame, "g", "v", limit, buckets)
        assert rows(got, "g", "median_price_sqm", "objects_count") == exact


@pytest.mark.parametrize("seed", range(2))
def test_below_market_plans_agree(spark, seed):
    rng = random.Random(seed)
    prices = [rng.lognormvariate(7, 1.5) for _ in range(400)] + [rng.choice([1000.0, 2000.0]) for _ in range(101)]
    data = [(i, "u", L.SALE, rng.choice([1, None]), None, "x", p, 40.0) for i, p in enumerate(prices)]
    frame = spark.createDataFrame(data, LISTING)
    columns = ["id", F.round("median_price_sqm", 6), F.round("lower_bound", 6), "objects_count"]
    plain = rows(L.below_market(frame, excluded_organization="out"), *columns)
    assert rows(L.below_market(frame, excluded_organization="out", max_median_rows=2), *columns) == plain
    assert len(plain) > 100


def test_medians_agree_on_nulls(spark):
    data = [(1, 1.0), (1, None), (2, None), (None, 3.0), (3, 2.0), (3, 5.0)]
    frame = spark.createDataFrame(data, "g int, v double")
    columns = ["g", "median_price_sqm", "objects_count"]
    plain = rows(L.group_median(frame, "g", "v"), *columns)
    assert plain == [(1, 1.0, 1), (3, 3.5, 2)]
    assert rows(L.narrowed_median(frame, "g", "v", max_rows=1), *columns) == plain


def test_repeated_names_and_changes(spark):
    dictionary = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "name string, id int")
    frame = spark.createDataFrame([("a",), ("b",)], "region string")
    assert rows(strict_lookup(frame, dictionary, "region")) == [("a", 2), ("b", 3)]
    target = spark.createDataFrame([(1, "old")], "id int, d string")
    twice = spark.createDataFrame([(1, "first", 1), (1, "last", 2)], "id int, d string, at int")
    assert rows(state.upsert(target, twice, "id", ["d"], "at")) == [(1, "last")]
    with pytest.raises(Exception, match="repeated change of key 1"):
        state.upsert(target, twice, "id", ["d"]).collect()


def test_skewed_numbering_equals_the_window(spark):
    data = [(None if i % 3 else f"k{i % 50}", (i * 7919) % 10007 + 0.5, i) for i in range(3000)]
    frame = spark.createDataFrame(data, "k string, v double, i long").repartition(7)
    ranges = skew.placed_in_ranges(frame, ["k"], [F.col("i")])
    assert ranges.select("_range").distinct().count() >= 2
    assert ranges.where("k IS NULL").select("_range").distinct().count() >= 2
    order = [F.col("v").desc(), F.col("i")]
    plain = rows(skew.number_rows(frame, ["k"], order, "n"), "i", "n")
    assert rows(skew.number_rows(frame, ["k"], order, "n", 100), "i", "n") == plain
    summed = rows(skew.running_sum(frame, ["k"], order, F.col("v"), "s"), "i", "s")
    assert rows(skew.running_sum(frame, ["k"], order, F.col("v"), "s", 100), "i", "s") == summed
    everything = rows(skew.number_rows(frame, [], [F.col("i")], "n"), "i", "n")
    assert everything == sorted(((i, i + 1) for i in range(3000)), key=repr)


def test_salted_attach_equals_the_join(spark):
    data = [(None if i % 3 else f"k{i % 50}", i) for i in range(2000)]
    frame = spark.createDataFrame(data, "k string, i long")
    facts = frame.groupBy("k").agg(F.count(F.lit(1)).alias("members"), F.min("i").alias("first"))
    plain = rows(skew.attach(frame, facts, "k", ["i"]), "i", "first", "members")
    assert rows(skew.attach(frame, facts, "k", ["i"], 100), "i", "first", "members") == plain
    assert len(plain) == 2000


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", 10, "u1"), (2, "b", 20, "u2")], "id int, d string, p int, url string")
    change = spark.createDataFrame([(2, None, 21, "new"), (3, "c", 30, "u3")], "id int, d string, p int, url string")
    once = state.upsert(target, change, "id", ["d", "p"])
    assert rows(once) == [(1, "a", 10, "u1"), (2, None, 21, "u2"), (3, "c", 30, "u3")]
    assert rows(state.upsert(once, change, "id", ["d", "p"])) == rows(once)


def test_first_and_insert(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("k", 4)], "url string, n int")
    assert rows(state.last_per_key(frame, ["url"], "n")) == [("a", 2), ("b", 3), ("k", 4)]
    known = spark.createDataFrame([("k",)], "url string")
    assert rows(state.insert_absent(known, frame, "url", [F.col("n")])) == [("a", 1), ("b", 3)]


def test_duplicates(spark):
    data = [("1", "b (1).txt", "x"), ("2", "a.txt", "x"), ("3", "B_2.txt", "x"), ("4", "b.txt", "y"), ("5", "A 7.txt", "x")]
    keyed = K.with_duplicate_key(spark.createDataFrame(data, "path string, name string, content string"))
    assert rows(K.duplicate_groups(keyed), "base_name", "members", "redundant") == [("a", 2, 1), ("b", 2, 1)]
    plan = rows(K.duplicate_plan(keyed), "path", "action", "new_name")
    folder = spark.createDataFrame([("A.txt",), ("B(1).txt",)], "name string")
    moved = spark.createDataFrame([("a.txt",)], "name string")
    named = K.named_duplicate_plan(K.duplicate_plan(keyed), folder, moved)
    assert rows(named, "path", "new_name") == [("1", "b (1).txt"), ("2", "a(1).txt"), ("3", "B.txt"), ("5", "A(1).txt")]
    assert plan == [("1", "duplicate", "b (1).txt"), ("2", "duplicate", "a.txt"), ("3", "keep", "B.txt"), ("5", "keep", "A.txt")]


def test_extension_plans(spark):
    names = ["a.doc", "A.tmp", "a.DOCX", "b.tmp", "b.x", "c.doc", "x.d.1", "x.d.2"]
    frame = spark.createDataFrame([(f"p{i}", n, "docx" if n == "b.x" else "unknown") for i, n in enumerate(names)], "path string, name string, format string")
    got = {r["name"]: r["action"] for r in K.extension_plan(frame).collect()}
    assert got == {"a.doc": "stay", "A.tmp": "quarantine", "a.DOCX": "keep", "b.tmp": "stay", "b.x": "stay", "x.d.1": "stay", "x.d.2": "stay"}
    fixed = {r["name"]: (r["action"], r["new_name"]) for r in K.repair_plan(frame).collect()}
    assert fixed["b.x"] == ("rename", "b.docx")
    assert fixed["a.DOCX"] == ("keep", "a.DOCX")
    assert fixed["x.d.1"] == ("quarantine", "x.d.1")


def test_missing_outputs(spark):
    sources = [("d", "one.doc"), ("d", "done.docx"), ("d", "two.doc"), ("d", "Two.docx"), ("d", "both.docx"), ("d", "both.doc"), ("e", "done.doc")]
    outputs = [("d", "DONE.txt"), ("d", "both.txt")]
    schema = "dir string, name string"
    for bound in (10**6, 1):
        got = rows(K.missing_outputs(spark.createDataFrame(sources, schema), spark.createDataFrame(outputs, schema), bound))
        assert got == [("d", "Two.docx"), ("d", "both.docx"), ("d", "one.doc"), ("d", "two.doc"), ("e", "done.doc")]


def test_content_sync(spark):
    local = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3"), ("d", "h4")], "name string, hash string")
    remote = spark.createDataFrame(
        [("1", "http://s/a", "title", "h1", 0), ("2", "http://s/x", "b", "old", 1), ("3", "http://s/c", "c", "", 2),
         ("4", "http://s/y", "a", "newer", 3)],
        "id string, url string, name string, description string, position int",
    )
    got = {r["name"]: (r["status"], r["kept_id"]) for r in K.content_sync(local, remote).collect()}
    assert got == {"a": ("CHANGED", None), "b": ("CHANGED", None), "c": ("NEW", None), "d": ("NEW", None)}
    got = {r["name"]: (r["status"], r["kept_id"]) for r in K.content_sync(local, remote.where("id < '4'")).collect()}
    assert got["a"] == ("UNCHANGED", "1")


@pytest.mark.parametrize("style", ["parentheses", "underscore"])
@pytest.mark.parametrize("bound", [10**6, 2])
def test_unique_names(spark, style, bound):
    rng = random.Random(5)
    pool = ["a.txt", "a(1).txt", "a(2).txt", "a_1.txt", "a_3.txt", "b.txt", "b(10).txt", "noext", "a(01).txt"]
    new = [(f"p{i:03}", rng.choice(pool)) for i in range(60)]
    taken = ["a.txt", "a(2).txt", "a(3).txt", "a_2.txt", "b(1).txt"]
    got = K.unique_names(
        spark.createDataFrame(new, "path string, name string"), spark.createDataFrame([(t,) for t in taken], "name string"),
        style, bound,
    ).collect()
    names = [r["new_name"] for r in got]
    assert len(got) == len(new)
    assert len(set(names)) == len(names)
    assert not set(names) & set(taken)
    plain = [r for r in got if r["new_name"] == r["name"]]
    assert {r["name"] for r in plain} == {n for _, n in new} - set(taken)
    # Every number below a given one is in use: the first free number was taken each time.
    used = set(names) | set(taken)
    for r in got:
        if r["new_name"] == r["name"]:
            continue
        mark = r["new_name"].rsplit("(" if style == "parentheses" else "_", 1)
        number = int("".join(c for c in mark[1].split(".")[0] if c.isdigit()))
        for smaller in range(1, number):
            assert r["new_name"].replace(mark[1], mark[1].replace(str(number), str(smaller), 1)) in used


def brute_force(sources, targets, percent=1.0, seconds=10):
    """Pairs of keys with multiplicity: exact ones, then always the closest remaining pair."""
    left, right = {}, {}
    for side, keys in ((left, sources), (right, targets)):
        for key in keys:
            side[key] = side.get(key, 0) + 1
    flows = {}

    def move(s, t):
        n = min(left[s], right[t])
        left[s] -= n
        right[t] -= n
        if n:
            flows[s, t] = flows.get((s, t), 0) + n

    for key in left:
        if key in right:
            move(key, key)
    pairs = [
        (abs(t[1] - s[1]), abs(t[0] - s[0]), t[1], t[0], s[1], s[0])
        for s, t in itertools.product(left, right)
        if abs(t[1] - s[1]) <= seconds and abs(t[0] - s[0]) / max(s[0], 1) * 100 <= percent
    ]
    return flows, pairs, left, right, move


@pytest.mark.parametrize("seed", range(3))
def test_matching(spark, seed):
    rng = random.Random(seed)

    def side():
        return [(rng.choice([0, 100, 1000, 1005, 1010, 1011, 5000]), rng.randrange(0, 60)) for _ in range(60)]

    sources, targets = side(), side()
    schema = "path string, size long, mtime double"
    s = spark.createDataFrame([(f"s{i:03}", a, float(b)) for i, (a, b) in enumerate(sources)], schema)
    t = spark.createDataFrame([(f"t{i:03}", a, float(b)) for i, (a, b) in enumerate(targets)], schema)
    got = M.match_files(s, t, max_group_rows=3 if seed == 0 else 10**6).collect()
    assert len({r["source"] for r in got}) == len({r["target"] for r in got}) == len(got)
    flows, pairs, left, right, move = brute_force(sources, targets)
    exact = sum(flows.values())
    assert sum(r["kind"] == "exact" for r in got) == exact
    for r in got:
        a, b = sources[int(r["source"][1:])], targets[int(r["target"][1:])]
        assert (r["kind"] == "exact") == (a == b)
        assert abs(a[1] - b[1]) <= 10 and abs(a[0] - b[0]) / max(a[0], 1) * 100 <= 1.0
    # No pair within the tolerance is left over.
    free_s = [k for i, k in enumerate(sources) if f"s{i:03}" not in {r["source"] for r in got}]
    free_t = [k for i, k in enumerate(targets) if f"t{i:03}" not in {r["target"] for r in got}]
    for a, b in itertools.product(free_s, free_t):
        assert not (abs(a[1] - b[1]) <= 10 and abs(a[0] - b[0]) / max(a[0], 1) * 100 <= 1.0)
    flows = {}
    for r in got:
        key = sources[int(r["source"][1:])], targets[int(r["target"][1:])]
        flows[key] = flows.get(key, 0) + 1
    assert flows == by_cells(sources, targets)


def by_cells(sources, targets, percent=1.0, seconds=10):
    """Exact pairs, then the closest remaining one of each cell, grid by grid, from the list of all pairs."""
    flows, pairs, left, right, move = brute_force(sources, targets, percent, seconds)

    def cell(key, grid):
        log = math.log(max(key[0], 1)) / math.log1p(8 * percent / 100)
        return (key[1] + grid[0] * 4 * seconds) // (8 * seconds), math.floor(log + grid[1] / 2)

    for grid in M.GRIDS:
        for _, _, t_sec, t_size, sec, size in sorted(pairs):
            if cell((size, sec), grid) == cell((t_size, t_sec), grid):
                move((size, sec), (t_size, t_sec))
    return flows


def near_files(spark, keys, prefix):
    return spark.createDataFrame([(f"{prefix}{i:04}", z, float(c)) for i, (z, c) in enumerate(keys)], "path string, size long, mtime double")


@pytest.mark.parametrize("count", [8, 200])
def test_one_sided_clusters_take_the_same_passes(spark, count):
    sources, targets = [(100_000 + i, 40) for i in range(count)], [(100_300 + i, 41) for i in range(count)]
    settled = []
    original = M.settle
    M.settle = lambda frame: settled.append(1) or original(frame)
    try:
        got = M.match_files(near_files(spark, sources, "s"), near_files(spark, targets, "t")).collect()
    finally:
        M.settle = original
    assert len(got) == count
    assert len(settled) == 2 + 2 + 1 + len(M.GRIDS)


def test_growing_gaps_are_served_closest_first(spark):
    sources = [(10_000, 0), (10_025, 0), (10_055, 0), (10_090, 0)]
    targets = [(10_010, 0), (10_040, 0), (10_072, 0), (10_099, 0)]
    flows = by_cells(sources, targets)
    got = M.match_files(near_files(spark, sources, "s"), near_files(spark, targets, "t")).collect()
    assert {(sources[int(r["source"][1:])], targets[int(r["target"][1:])]): 1 for r in got} == flows
    assert flows == {(s, t): 1 for s, t in zip(sources, targets, strict=True)}


def test_nearest_equals_brute_force(spark):
    rng = random.Random(9)
    sources = {(rng.choice([0, 1, 50, 99, 100, 101, 9999, 10000, 10100, 1048576]), rng.randrange(50)) for _ in range(80)}
    targets = {(rng.choice([0, 1, 2, 50, 100, 9950, 10000, 10101, 1050000]), rng.randrange(50)) for _ in range(80)}
    schema = "size long, sec long"
    got = rows(
        M.nearest(spark.createDataFrame(list(sources), schema), spark.createDataFrame(list(targets), schema)),
        "size", "sec", "t_size", "t_sec",
    )
    want = []
    for size, sec in sources:
        near = [
            (abs(b - sec), abs(a - size), b, a)
            for a, b in targets
            if abs(b - sec) <= 10 and abs(a - size) / max(size, 1) * 100 <= 1.0
        ]
        if near:
            _, _, t_sec, t_size = min(near)
            want.append((size, sec, t_size, t_sec))
    assert got == sorted(want, key=repr)


def test_tolerance_bounds(spark):
    schema = "path string, size long, mtime double"
    s = spark.createDataFrame([("s1", 1000, 100.0), ("s2", 1000, 200.0), ("s3", 1000, 300.0), ("s4", 7, 0.5), ("s5", 7, 1.5)], schema)
    t = spark.createDataFrame([("t1", 1010, 110.0), ("t2", 1011, 200.0), ("t3", 1000, 311.0), ("t4", 7, 0.0), ("t5", 7, 2.0)], schema)
    assert rows(M.match_files(s, t)) == [("s1", "t1", "near"), ("s4", "t4", "exact"), ("s5", "t5", "exact")]


def test_later_grids_read_only_what_is_left(spark, monkeypatch):
    plans, settle = [], M.settle
    monkeypatch.setattr(M, "settle", lambda f: plans.append(f._jdf.queryExecution().optimizedPlan().toString()) or settle(f))
    s = spark.createDataFrame([(1000, 5), (1000, 5), (1000, 99), (3000, 7), (None, 5), (7, None)], "size long, sec long")
    t = spark.createDataFrame([(1000, 5), (1003, 8), (1004, 106), (5000, 7), (None, 5), (7, None)], "size long, sec long")
    found = rows(M.match_counts(s, t).select("size", "sec", "t_size", "t_sec", "qty", "s_from", "t_from", "kind"))
    assert found == [(1000, 5, 1000, 5, 1, 0, 0, "exact"), (1000, 5, 1003, 8, 1, 1, 0, "near"), (1000, 99, 1004, 106, 1, 0, 0, "near")]
    # The last three grids read the table of the one before and nothing else.
    assert [p.count("Relation ") for p in plans[-3:]] == [1, 1, 1]


def test_snapshots(spark):
    schema = "path string, size long, mtime double"
    remote = spark.createDataFrame([("a", 1, 10.9), ("b", 1, 10.0), ("c", 1, 10.0), ("d", 1, 10.0)], schema)
    local = spark.createDataFrame([("a", 1, 11.9), ("b", 1, 12.0), ("c", 2, 10.0)], schema)
    assert rows(R.stale_snapshots(remote, local), "path", "reload") == [("a", False), ("b", True), ("c", True), ("d", True)]


def test_status(spark):
    sources = spark.createDataFrame([(i, f"u{i}", None, None) for i in range(5)], "id int, url string, last_update string, update_status string")
    results = spark.createDataFrame(
        [(1, False, False, 0), (2, True, False, 0), (3, True, True, 0), (4, True, True, 5), (9, True, True, 1)],
        "id int, downloaded boolean, extracted boolean, files int",
    )
    got = rows(R.update_status(sources, results, F.lit("now")), "id", "last_update", "update_status")
    assert got == [
        (0, None, None), (1, "now", "download_failed"), (2, "now", "extraction_failed"), (3, "now", "empty_archive"),
        (4, "now", "success"),
    ]


def test_chats(spark):
    data = [(c, i, "t" if i % 5 else None, i % 2 == 0) for c in (1, 2) for i in range(20)]
    frame = spark.createDataFrame(data, "chat long, msg_id long, text string, is_out boolean")
    last = rows(G.last_messages(frame).where("chat = 1"), "msg_id")
    assert last == sorted([(i,) for i in range(5, 20)], key=repr)
    prompt = G.prompts(frame, "<{history}>", 3).where("chat = 1").first()["prompt"]
    assert prompt == "<Пользователь: t\nЯ: t\nПользователь: t>"
    page = [r["msg_id"] for r in G.history_page(frame.where("chat = 1"), 10, 3).collect()]
    assert page == [9, 8, 7]


def test_routing(spark):
    frame = spark.createDataFrame(
        [(1, "chat", 5, "u"), (1, "", 5, "u"), (None, None, 5, "u"), (None, None, 5, None), (None, None, None, None)],
        "chat_id long, chat_username string, sender_id long, sender_username string",
    )
    assert [r["log"] for r in G.routed(frame).collect()] == ["chat", "id1", "u", "id5", None]


def test_vector_plans_agree(spark):
    rng = random.Random(1)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)], "vec_id long, vector array<double>")
    queries = vectors.where("vec_id < 7").select(F.col("vec_id").alias("query_id"), "vector")
    small = rows(retrieval.vector_search(vectors, queries, 4), "query_id", "vec_id", "rank")
    large = rows(retrieval.vector_search(vectors, queries, 4, pass_numbers=50), "query_id", "vec_id", "rank")
    assert small == large
    assert len(small) == 28
    assert {(q, q, 1) for q in range(7)} <= set(small)


def test_citations(spark):
    data = [(1, [([("filechunk", "a"), ("filechunk", "b")],), ([("web", "c")],), ([("filechunk", "d")],)]), (2, [])]
    schema = "answer_id long, citations array<struct<sources: array<struct<type: string, part: string>>>>"
    got = rows(retrieval.citation_sources(spark.createDataFrame(data, schema)), "answer_id", "number", "part")
    assert got == [(1, 1, "a"), (1, 1, "b"), (1, 3, "d")]


def test_tolerances_too_wide_for_the_cells_are_refused(spark):
    files = spark.createDataFrame([("a", 100, 1.0)], "path string, size long, mtime double")
    with pytest.raises(ValueError, match="percent"):
        M.match_files(files, files, percent=70)
    assert M.match_files(files, files, percent=50).count() == 1


def test_passes_of_a_text_search_share_the_reading_of_texts(spark, tmp_path):
    """Any number of passes cuts and counts the texts once and finds what one pass finds."""
    folder = str(tmp_path)

    def noted(batches):
        import os
        import uuid

        for batch in batches:
            open(os.path.join(folder, uuid.uuid4().hex), "w").close()
            yield batch

    texts = [(1, "The cat sat on the mat"), (2, "a Dog met a cat"), (3, ""), (None, "mat"), (5, None), (2, "a Dog met a cat")]
    documents = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    chunks = retrieval.chunk_table(documents.mapInPandas(noted, documents.schema), 4, 1)
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(["cat mat", "dog", "the cat", "none here", "met a"])], "query_id long, text string")
    columns = ("query_id", "doc_id", "chunk_no", "score", "rank")
    several = [tuple(r) for r in retrieval.text_search(chunks, queries, k=3, pass_terms=2).select(*columns).collect()]
    assert len(list(tmp_path.iterdir())) == 1
    one = [tuple(r) for r in retrieval.text_search(chunks, queries, k=3).select(*columns).collect()]
    assert sorted(map(str, several)) == sorted(map(str, one))
    assert several
