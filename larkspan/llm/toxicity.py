"""Toxic spans and scores by a linear-chain conditional random field of two states.

Documents carry labels, tokens do not. A bounded sample of labelled documents is drawn; words and word
beginnings that mark toxic documents in it label their tokens, and the field is fitted to these labels. A
document's score comes from the marginals that forward-backward gives every token of its whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import pick, row_key

# Labelled documents of either class that the fit uses at most.
SAMPLE_PER_CLASS = 1_500
FEATURE_BITS = 20
PREFIXES = (3, 4, 5, 6)
# What a word or beginning needs to label tokens: evidence (likelihood ratio statistic), share of toxic use,
# and toxic documents that have it, by number and by part of all.
LEAST_EVIDENCE, LEAST_SHARE, LEAST_DOCS, LEAST_PART = 11.0, 0.95, 4, 0.003
SEGMENT = 64
STEPS = 80
MEMO_WORDS = 400_000

TOKEN = re.compile(r"\w+")


def held_out(identity):
    """Rows that no label may be learnt from: CRC-32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(identity.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(word: str) -> list[str]:
    word = word.lower()
    return ["w" + word, *[f"p{word[:n]}" for n in PREFIXES if len(word) >= n], "s" + word[-3:]]


@cache
def _slots(bits: int):
    mask = (1 << bits) - 1
    return lambda word: [zlib.crc32(f.encode("utf-8", "surrogatepass")) & mask for f in features(word)]


@dataclass
class Model:
    """Field: weight of each feature for the toxic state, log potentials of moves, weights of the document score."""

    weights: np.ndarray
    moves: np.ndarray
    document: np.ndarray
    prior: float | None = None  # the only score, where the sample lacks one class


def chain(moves: np.ndarray, drives: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginal of the toxic state, log normaliser of each sequence) for sequences laid end to end.

    ``drives`` is the log potential of toxic less that of clean of each token. Sequences advance together, longest
    first, so a step costs one pass over those still running; only the ratio of the two states is carried.
    """
    n = len(lengths)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max(initial=0))
    running = n - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
    at = starts[order]
    t00, t01, t10, t11 = np.exp(moves.ravel())
    lift = np.exp(np.clip(drives, -30, 30))
    ahead = np.empty(len(drives))
    scale = np.zeros(n)
    ratio = np.ones(n)
    for t in range(longest):
        k = running[t]
        here = at[:k] + t
        if t == 0:
            ratio = lift[here]
        else:
            ratio = ratio[:k]
            stay = t00 + ratio * t10
            scale[:k] += np.log(stay)
            ratio = lift[here] * (t01 + ratio * t11) / stay
        ratio = np.clip(ratio, 1e-30, 1e30)
        ahead[here] = ratio
    ends = starts + lengths - 1
    total = np.zeros(n)
    some = lengths > 0
    inverse = np.empty(n, dtype=np.int64)
    inverse[order] = np.arange(n)
    total[some] = scale[inverse[some]] + np.log1p(ahead[ends[some]])
    back = np.empty(0)
    marginal = np.empty(len(drives))
    for t in range(longest - 1, -1, -1):
        k = running[t]
        here = at[:k] + t
        later = np.ones(k)
        if t + 1 < longest:
            m = running[t + 1]
            pull = lift[at[:m] + t + 1] * back[:m]
            later[:m] = (t10 + t11 * pull) / (t00 + t01 * pull)
        back = np.clip(later, 1e-30, 1e30)
        odds = ahead[here] * back
        marginal[here] = odds / (1 + odds)
    return marginal, total


def _telling(docs: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Slots that tell toxic documents from clean ones; ``docs``: the slots of each, once.

    The slot with the most evidence is taken, then the best one among the toxic documents that it leaves
    unexplained, and so on. So the other words of toxic near copies tell nothing.
    """

    def counted(some: list[np.ndarray]) -> np.ndarray:
        return np.bincount(np.concatenate([np.empty(0, np.int64), *some]), minlength=1 << FEATURE_BITS).astype(float)

    clean = counted([d for d, y in zip(docs, toxic, strict=True) if not y])
    left = [d for d, y in zip(docs, toxic, strict=True) if y]
    n1, n0 = float(len(left)), float(len(docs) - len(left))
    found = []
    while left:
        a = counted(left)
        expected = (a + clean) * n1 / (n1 + n0)
        with np.errstate(divide="ignore", invalid="ignore"):
            evidence = a * np.log(a / expected) + np.where(clean > 0, clean * np.log(clean / (a + clean - expected)), 0)
            share = (a / n1) / (a / n1 + clean / n0)
        fits = (a >= max(LEAST_DOCS, LEAST_PART * n1)) & (share >= LEAST_SHARE) & (2 * evidence >= LEAST_EVIDENCE)
        if not fits.any():
            break
        found.append(int(np.argmax(np.where(fits, evidence, 0))))
        left = [d for d in left if found[-1] not in d]
    return np.array(found, np.int64)


def fit(texts: list[str], toxic: list[bool], clean_weight: float = 1.0) -> Model:
    """Fit the field and the document score to whole labelled texts, on one machine; callers bound the sample.

    ``clean_weight``: clean documents that each clean one of the sample stands for, by toxic ones likewise.
    """
    # Copies of a text are no further evidence.
    first = dict(zip(reversed(texts), reversed(toxic), strict=True))
    texts, toxic = list(first), list(first.values())
    label = np.asarray(toxic, dtype=bool)
    if label.all() or not label.any():
        return Model(np.zeros(1), np.zeros((2, 2)), np.zeros(3), (float(label.sum()) + 0.5) / (len(label) + 2))
    # Each word is held once, whatever its count; tokens are its number.
    numbers: dict[str, int] = {}
    docs = [np.array([numbers.setdefault(w, len(numbers)) for w in TOKEN.findall(t or "")], np.int64) for t in texts]
    table = [np.array(s, np.int64) for s in map(_slots(FEATURE_BITS), numbers)]
    # The last slot of a word is that of its ending, which alone tells too little.
    several = [np.unique(np.concatenate([np.empty(0, np.int64), *(table[w][:-1] for w in np.unique(d))])) for d in docs]
    telling = set(_telling(several, label).tolist())
    marked = np.array([not telling.isdisjoint(s[:-1].tolist()) for s in table], bool)
    parts = [(d[i : i + SEGMENT], y) for d, y in zip(docs, label, strict=True) for i in range(0, len(d), SEGMENT)]
    rows = np.concatenate([np.empty(0, np.int64), *(d for d, _ in parts)])
    tags = np.concatenate([np.empty(0, bool), *(marked[d] & y for d, y in parts)])
    lengths = [len(d) for d, _ in parts]
    # Words by feature slot, as two flat arrays; a token's drive is that of its word.
    owner = np.repeat(np.arange(len(table)), [len(s) for s in table])
    slot = np.fromiter((x for s in table for x in s), dtype=np.int64, count=len(owner))
    used, slot = np.unique(slot, return_inverse=True)
    word, tag, size = rows, tags.astype(np.float64), np.array(lengths, np.int64)
    follows = np.ones(len(word), dtype=bool)
    follows[np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)] = False
    after = np.flatnonzero(follows)
    weights, moves = np.zeros(len(used)), np.zeros((2, 2))
    seen = np.zeros((2, 2))
    np.add.at(seen, (tag[after - 1].astype(int), tag[after].astype(int)), 1)
    seen += 0.5
    moves = np.log(seen / seen.sum(axis=1, keepdims=True))  # their maximum likelihood, held fixed below
    bias = float(np.log((tag.sum() + 0.5) / (len(tag) - tag.sum() + 0.5))) - float(moves[0, 1] - moves[0, 0])
    weights = np.append(weights, bias)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    penalty = 0.05
    for step in range(1, STEPS + 1):
        by_word = np.bincount(owner, weights[:-1][slot], minlength=len(table)) + weights[-1]
        marginal, _ = chain(moves, by_word[word], size)
        rest = marginal - tag
        per_word = np.bincount(word, rest, minlength=len(table))
        gradient = np.append(np.bincount(slot, per_word[owner], minlength=len(used)), rest.sum())
        gradient[:-1] += penalty * weights[:-1]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        weights -= 0.25 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    full = np.zeros((1 << FEATURE_BITS) + 1, np.float32)
    full[used], full[-1] = weights[:-1], weights[-1]
    model = Model(full, moves, np.zeros(3))
    # Texts of like length run together, as a step costs as much for few as for many.
    order = np.argsort([len(d) for d in docs], kind="stable")
    summary = np.empty((len(texts), 2))
    for at in range(0, len(order), 200):
        some = order[at : at + 200]
        summary[some] = [s for s, _ in _summaries([TOKEN.findall(texts[i] or "") for i in some], model)]
    model.document = _logistic(summary, label.astype(float), np.where(label, 1.0, clean_weight))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    design = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + 0.5 * w
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.5 * np.eye(len(w))
        w -= np.linalg.solve(hessian, gradient)
    return w


def _summaries(docs: list[list[str]], model: Model, memo: dict[str, float] | None = None) -> Iterator[tuple[tuple[float, float], np.ndarray]]:
    """Of each document (log odds of its strongest token, log of expected toxic tokens) and its marginals."""
    memo = {} if memo is None else memo
    slots, weights = _slots(FEATURE_BITS), model.weights

    def drive(word: str) -> float:
        if len(memo) >= MEMO_WORDS:
            memo.clear()
        value = memo[word] = float(weights[slots(word)].sum() + weights[-1])
        return value

    lengths = np.array([len(d) for d in docs], np.int64)
    get = memo.get
    drives = np.fromiter(
        (v if (v := get(w)) is not None else drive(w) for d in docs for w in d), np.float64, count=int(lengths.sum())
    )
    marginal, _ = chain(model.moves, drives, lengths)
    end = 0
    for n in lengths.tolist():
        own = marginal[end : end + n]
        end += n
        top = float(own.max(initial=1e-7))
        top = min(max(top, 1e-7), 1 - 1e-7)
        yield (np.log(top / (1 - top)), float(np.log1p(own[own > 0.2].sum()))), own


def learn(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit to at most ``per_class`` labelled documents of either class outside the held-out fold, drawn by hash.

    A document with both labels counts as toxic; a NULL label or id counts for nothing.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("id")) & F.col("toxic").isin(0, 1)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("draw", F.xxhash64("id"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    sample = known.where("toxic = 1").orderBy("draw", "id").limit(per_class)
    sample = sample.unionByName(known.where("toxic = 0").orderBy("draw", "id").limit(per_class))
    # At most 2 * per_class ids, so they may be broadcast and their texts collected; the order is fixed for the fit.
    rows = pick(docs, id=id_col, text=text_col).join(F.broadcast(sample), "id").select("id", "text", "toxic").collect()
    rows = sorted(rows, key=lambda r: (r["id"], r["text"] or ""))
    stands_for = {label: max(1.0, n / per_class) for label, n in counts.items()}
    clean_weight = stands_for.get(0, 1.0) / stands_for.get(1, 1.0)
    return fit([r["text"] or "" for r in rows], [bool(r["toxic"]) for r in rows], clean_weight)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, row_key, score (0 to 1), spans (code points [start, end) of toxic runs).

    Whole texts are scored. A NULL or empty text, or one without words, has the score of a text whose tokens are
    all clean and no spans. Only the text enters a score. Further columns are ignored. No shuffle.
    """
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            found = list(_judged(batch.column("text").to_pylist(), model, memo))
            columns = [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], span)]
            yield pa.record_batch([batch.column("id"), batch.column("row_key"), *columns], names=["id", "row_key", "score", "spans"])

    rows = pick(docs, id=id_col, text=text_col)
    rows = rows.select(F.col("id").cast("long"), row_key(F.col("id"), F.col("text")).alias("row_key"), "text")
    return rows.mapInArrow(run, "id long, row_key long, score double, spans array<struct<start int, end int>>")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", below: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below the bound, with all their columns. No shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            scores = (score for score, _ in _judged(batch.column(at).to_pylist(), model, memo))
            yield batch.filter(pa.array([score < below for score in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _judged(texts: list[str | None], model: Model, memo: dict[str, float]) -> Iterator[tuple[float, list[dict[str, int]]]]:
    """Score and spans of each text; some thousand run through the chain together."""
    for step in range(0, len(texts), 2_000):
        some = [t or "" for t in texts[step : step + 2_000]]
        if model.prior is not None:
            yield from ((model.prior, []) for _ in some)
            continue
        words = [TOKEN.findall(t) for t in some]
        for text, (summary, marginal) in zip(some, _summaries(words, model, memo), strict=True):
            value = float(np.dot(model.document, (*summary, 1.0)))
            yield float(1 / (1 + np.exp(-np.clip(value, -30, 30)))), _spans(text, marginal > 0.5)


def _spans(text: str, toxic: np.ndarray) -> list[dict[str, int]]:
    if not toxic.any():
        return []
    out: list[dict[str, int]] = []
    before = False
    for match, here in zip(TOKEN.finditer(text), toxic.tolist(), strict=True):
        if here and before:
            out[-1]["end"] = match.end()
        elif here:
            out.append({"start": match.start(), "end": match.end()})
        before = here
    return out
