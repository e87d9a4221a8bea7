"""The Voronoi join against all pairs."""

import math
import random

import numpy as np
import pytest
from larkspan.llm import knn
from pyspark.sql import functions as F


def by_force(rows, k, every):
    kept = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, tuple(math.floor(1024 * x) for x in v)))
    out = []
    for q, v in {(q, v) for q, v in kept if q % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in kept if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def found(spark, rows, k, every, **settings):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cell", "'z' AS radius", "2 AS query_id")
    out = knn.nearest(table, F.col("vec_id") % every == 0, k, **settings)
    return sorted(tuple(r)[:4] for r in out.collect())


def clustered(n, dim, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(i, (centres[i % 6] + spread * rng.normal(size=dim)).tolist()) for i in range(n)]


ODD = [
    (0, [1.0, 0.5]), (100, [1.0, 0.5]), (100, [0.5, -1.0]), (100, [0.5, -1.0]), (7, [1.0, 0.5]), (7, [1.0, 0.5]), (8, [1.0]), (9, []),
    (10, None), (11, [None, 1.0]), (12, [float("nan"), 1.0]), (13, [float("inf"), 1.0]), (None, [9.0, 9.0]), (200, []), (14, [-0.0001, 0.3]),
]


@pytest.mark.parametrize(
    ("rows", "k", "every", "settings"),
    [
        (clustered(700, 8, 1, 0.05), 10, 10, {}),
        (clustered(700, 8, 2, 0.05), 3, 20, {"pivots": 6, "vectors_per_task": 50, "queries_per_block": 4}),
        (clustered(300, 16, 3, 2.0), 10, 7, {"pivots": 5, "vectors_per_task": 40}),
        ([(i, [0.25, 0.5]) for i in range(500)] + clustered(60, 2, 4, 1.0), 10, 50, {"vectors_per_task": 60}),
        (ODD, 3, 100, {}),
        (ODD, 30, 1, {"pivots": 2, "queries_per_block": 1}),
        ([(0, [3.0e12, 1.0]), (1, [2.0e12, 1 / 3]), (2, [1.0, 1.0])], 2, 1, {}),
        ([], 10, 100, {}),
        ([(100, [1.0])], 10, 100, {}),
    ],
)
def test_equals_all_pairs(spark, rows, k, every, settings):
    wanted = [(q, r, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, r, i, s in by_force(rows, k, every)]
    assert found(spark, rows, k, every, **settings) == wanted


def test_bounds_leave_out_far_cells():
    pivots = np.array([[1000.0, 0], [-1000.0, 0]])
    closest = [(c, 10 * c + i, 1.0) for c in (0, 1) for i in range(4)]
    bounds = knn._bounds(pivots, [(0, 50, 5.0), (1, 50, 5.0)], closest, [(0, 3, 2.0)], 3, 100, 100)
    assert bounds.needs.tolist() == [[True, False], [False, False]]


def test_ties_beyond_a_tile():
    rng = random.Random(2)
    ids = np.array(rng.sample(range(10_000), 5_000))
    rows = np.array([[rng.randrange(3)] for _ in ids], float)
    best = knn.solve(np.array([ids[0]]), np.array([[1.0]]), ids, rows, 10)
    assert [b[1:] for b in best] == [(i, int(-s)) for s, i in sorted((-r[0], i) for i, r in zip(ids.tolist(), rows, strict=True) if i != ids[0])[:10]]
