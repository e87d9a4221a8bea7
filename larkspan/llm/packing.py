"""Optimal length buckets and token-budget batches.

The histogram of lengths up to the budget, at most ``budget`` rows, is summed over all rows by Spark. The
dynamic program over it chooses the bucket ends that leave the least padding; batches form in each bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import ROWS_PER_RANGE, numbered, pick
from larkspan.session import settle

BUCKETS = 16
TOKEN_BUDGET = 16_384


def best_ends(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The ends of at most ``buckets`` buckets that pad the least; ``lengths`` ascend.

    cost(i, j) = lengths[j] * rows(i..j) - tokens(i..j) meets the quadrangle inequality, so the best start of
    the last bucket never moves left as j grows; each layer is solved by halving, one numpy pass a level.
    """
    if not lengths:
        return []
    length = np.asarray(lengths, dtype=np.int64)
    count = np.asarray(counts, dtype=np.int64)
    rows = np.concatenate(([0], np.cumsum(count)))
    tokens = np.concatenate(([0], np.cumsum(count * length)))
    n = len(length)

    def cost(i: np.ndarray | int, j: int) -> np.ndarray:
        return length[j] * (rows[j + 1] - rows[i]) - (tokens[j + 1] - tokens[i])

    best = np.array([cost(0, j) for j in range(n)], dtype=np.int64)
    layers = [np.zeros(n, dtype=np.int64)]  # where the last bucket of the prefix starts, -1: one bucket less is as good
    for _ in range(1, min(buckets, n)):
        better, start = best.copy(), np.full(n, -1, dtype=np.int64)
        spans = [(0, n - 1, 1, n - 1)]
        while spans:
            low, high, left, right = spans.pop()
            if low > high:
                continue
            middle = (low + high) // 2
            options = np.arange(left, min(right, middle) + 1)
            chosen = left
            if len(options):
                padding = best[options - 1] + cost(options, middle)
                k = int(np.argmin(padding))
                chosen = int(options[k])
                if padding[k] < better[middle]:
                    better[middle], start[middle] = padding[k], chosen
            spans += [(low, middle - 1, left, chosen), (middle + 1, high, chosen, right)]
        best = better
        layers.append(start)
    ends, last = [], n - 1
    for start in reversed(layers):
        if last >= 0 and start[last] >= 0:
            ends.append(int(length[last]))
            last = int(start[last]) - 1
    return ends[::-1]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0))


def length_buckets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    budget: int = TOKEN_BUDGET,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, bucket, pad_to, batch (within the bucket), place (in the batch).

    Tokens are words, ``[^\\x20\\x09-\\x0D]+``; a NULL or empty text has none and takes one place of padding.
    A batch of a bucket holds the most rows whose padded lengths fit in ``budget``. Rows longer than the
    budget are not cut: they form the bucket after the last, each a batch of its own, padded to nothing but
    itself. Repeated rows are rows like any other, an empty table gives no rows, further columns are ignored.
    """
    rows = pick(docs, id=id_col, text=text_col).select("id", word_count(F.col("text")).cast("long").alias("n_tokens"))
    rows = settle(rows).withColumn("length", F.greatest("n_tokens", F.lit(1)))
    histogram = sorted(rows.where(F.col("length") <= budget).groupBy("length").count().collect())
    ends = best_ends([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    number, pad = F.lit(len(ends)), F.col("length")
    for i in reversed(range(len(ends))):
        inside = F.col("length") <= ends[i]
        number, pad = F.when(inside, i).otherwise(number), F.when(inside, F.lit(ends[i])).otherwise(pad)
    placed = rows.withColumn("bucket", number).withColumn("pad_to", pad.cast("long"))
    placed = numbered(placed, ["bucket"], [F.col("id"), F.col("length")], "row", rows_per_range)
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("pad_to"))).cast("long")
    return placed.select(
        "id", "n_tokens", "bucket", "pad_to",
        F.floor(F.col("row") / fits).cast("long").alias("batch"),
        (F.col("row") % fits).cast("int").alias("place"),
    )
