"""The chain against enumeration, and held-out accuracy of the whole."""

import itertools
import random

import numpy as np
import pytest
from larkspan.llm import toxicity
from larkspan.session import load


def test_chain_is_forward_backward():
    rng = np.random.default_rng(2)
    lengths = np.array([0, 3, 1, 6, 0, 2, 6])
    drives, moves = rng.normal(size=int(lengths.sum())) * 2, np.log(np.array([[0.9, 0.1], [0.3, 0.7]]))
    marginal, total = toxicity.chain(moves, drives, lengths)
    end = 0
    for n, z in zip(lengths, total, strict=True):
        own, wanted, weight = drives[end : end + n], np.zeros(n), 0.0
        for path in itertools.product((0, 1), repeat=int(n)):
            value = np.exp(sum(d for d, y in zip(own, path, strict=True) if y) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            weight += value
            wanted += value * np.array(path)
        if n:
            assert np.allclose(marginal[end : end + n], wanted / weight)
            assert np.isclose(z, np.log(weight))
        end += n


BAD = ["grubbit", "grubbed", "grubbel", "zorkil", "zorken"]


def labelled(count, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("lo", "mi", "ta", "res", "vu", "chen") for b in ("na", "rit", "sol", "que", "x")]
    rows = []
    for i in range(count):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 150))]
        toxic = rng.random() < 0.2
        for _ in range(3 * toxic):
            text[rng.randrange(len(text))] = rng.choice(BAD) + rng.choice(["", "s", ".", "er"])
        rows.append((i, " ".join(text).capitalize(), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = labelled(900, 1)
    extra = [(2000, None), (2001, ""), (2002, "lona rit"), (2002, "lona rit"), (None, "GRUBBIT grubbes"), (2003, "lona " * 30_000 + "grubbed, zorkil lona")]
    docs = spark.createDataFrame([r[:2] for r in rows] + extra, "doc_id long, text string").selectExpr("*", "1 AS id", "0.5 AS score", "1 AS toxic")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows] + [(None, 1, 1), (5, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, {r[0]: r[2] for r in rows}


def test_scores_and_spans(tables):
    docs, labels, truth = tables
    model = toxicity.learn(docs, labels, per_class=150)
    found = toxicity.scored(docs, model).withColumn("held", toxicity.held_out(toxicity.F.col("id"))).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held"] and r["id"] in truth]
    assert len(held) > 100
    assert np.mean([(r["score"] >= 0.5) == truth[r["id"]] for r in held]) > 0.97
    by_id = {r["id"]: r for r in found}
    assert by_id[2000]["score"] == by_id[2001]["score"] < 0.5 and by_id[2000]["spans"] == []
    assert by_id[None]["score"] > 0.5
    assert [(s["start"], s["end"]) for s in by_id[2003]["spans"]] == [(150_000, 150_015)]


def test_fit_does_not_depend_on_held_out_labels(spark, tables):
    docs, labels, _ = tables
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    one, two = (toxicity.learn(docs, x, per_class=60) for x in (labels, turned))
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.document, two.document)


def test_one_class_or_no_label_gives_one_score(spark, tables):
    docs, labels, _ = tables
    for some, low in ((labels.limit(0), True), (labels.where("toxic = 0"), True), (labels.where("toxic = 1"), False)):
        scores = {r["score"] for r in toxicity.scored(docs.limit(20), toxicity.learn(docs, some)).collect()}
        assert len(scores) == 1 and (scores.pop() < 0.5) == low
    assert toxicity.scored(docs.limit(0), toxicity.learn(docs, labels.limit(0))).count() == 0


def test_query_reads_all_documents(spark, sf):
    from larkspan.llm import QUERIES

    found = QUERIES["op9_toxic_crf"](spark, sf)
    assert found.count() == load(spark, sf, "documents").count()
    assert found.where("predicted <> cast(score >= 0.5 AS int) OR score NOT BETWEEN 0 AND 1").count() == 0
