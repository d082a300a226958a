"""Packing by optimal length buckets.

A sequence is a text's ids and one end id, so its length is at least 1. From
the global histogram of lengths up to the token budget (at most ``budget``
rows, whatever the corpus), dynamic programming chooses the ``buckets`` upper
bounds with the least total padding. Sequences of a bucket are padded to its
bound, and ``budget // bound`` of them make a batch. A bucket is dealt out by
hash to groups of about ``GROUP`` sequences, numbered independently: a bucket
that holds most of the corpus still spreads over the cluster, at the price of
one unfilled batch for each group. Sequences longer than the budget are
batches of their own, unpadded.

Defined cases: null and empty texts are sequences of length 1; repeated rows
and repeated or null ids are sequences of their own; an empty table gives no
rows; fewer distinct lengths than buckets give one bucket to each length;
extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import encoded_lengths, length_histogram

BUDGET = 16_384
BUCKETS = 16
GROUP = 20_000


def best_bounds(lengths, docs, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` ranges of the sorted ``lengths``
    that minimise the total of (bound - length) * docs.

    best[i] = min over j < i of prev[j] + length_i * (D_i - D_j) - (T_i - T_j);
    the best j grows with i, so each level is solved by halving the rows.
    """
    x = np.asarray(lengths, np.float64)
    n = len(x)
    if n == 0:
        return []
    d = np.concatenate([[0.0], np.cumsum(docs, dtype=np.float64)])
    t = np.concatenate([[0.0], np.cumsum(x * np.asarray(docs, np.float64))])
    prev = np.concatenate([[0.0], np.full(n, np.inf)])
    choice = []
    for _ in range(min(buckets, n)):
        best, arg = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        best[0] = 0.0
        work = [(1, n, 0, n - 1)]
        while work:
            lo, hi, a, b = work.pop()
            if lo > hi:
                continue
            i = (lo + hi) // 2
            j = np.arange(a, min(b, i - 1) + 1)
            cost = prev[j] + x[i - 1] * (d[i] - d[j]) - (t[i] - t[j])
            k = int(np.argmin(cost))
            best[i], arg[i] = cost[k], j[k]
            work += [(lo, i - 1, a, int(j[k])), (i + 1, hi, int(j[k]), b)]
        choice.append(arg)
        prev = best
    bounds, i = [], n
    for arg in reversed(choice):
        if i == 0:
            break
        bounds.append(int(lengths[i - 1]))
        i = int(arg[i])
    return bounds[::-1]


def pack_lengths(seqs: DataFrame, length: str = "length", salt: str = "salt", buckets: int = BUCKETS,
                 budget: int = BUDGET, group: int = GROUP) -> DataFrame:
    """Adds bucket, bound, batch, slot and padding to rows with a length of at
    least 1 and a hash to deal them out by (``salt``, dropped)."""
    hist = {r[0]: r[1] for r in length_histogram(seqs.filter(F.col(length) <= budget), length).collect()}
    sizes = sorted(hist)
    bounds = best_bounds(sizes, [hist[s] for s in sizes], buckets)
    long = len(bounds)
    n_docs = [0] * long + [seqs.filter(F.col(length) > budget).count()]
    for s in sizes:
        n_docs[bisect_left(bounds, s)] += hist[s]
    groups = F.array(*[F.lit(max(1, round(n / group))) for n in n_docs])
    bucket = F.coalesce(*[F.when(F.col(length) <= b, F.lit(i)) for i, b in enumerate(bounds)], F.lit(long))
    bound = F.get(F.array(*[F.lit(b).cast("long") for b in bounds], F.col(length)), F.col("bucket"))
    dealt = (seqs.withColumn("bucket", bucket).withColumn("bound", bound)
             .withColumn("_group", F.pmod(F.col(salt), F.get(groups, F.col("bucket")).cast("long"))))
    w = Window.partitionBy("bucket", "_group").orderBy(length, salt, *[c for c in seqs.columns if c not in (length, salt)])
    seat = F.row_number().over(w).cast("long") - 1
    cap = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bound")))
    out = dealt.withColumn("_seat", seat).withColumn("_cap", cap)
    return out.select(
        *[c for c in seqs.columns if c != salt], "bucket", "bound",
        F.concat_ws("-", "bucket", "_group", F.floor(F.col("_seat") / F.col("_cap"))).alias("batch"),
        (F.col("_seat") % F.col("_cap")).alias("slot"), (F.col("bound") - F.col(length)).alias("padding"))


def pack(docs: DataFrame, path: str, pattern: str, buckets: int = BUCKETS, budget: int = BUDGET,
         group: int = GROUP) -> DataFrame:
    """(doc_id, n_tokens, bucket, bound, batch, slot, padding) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.xxhash64("doc_id", "text").alias("salt"))
    seqs = encoded_lengths(rows, path, pattern, keep=("doc_id", "salt"))
    seqs = stored(seqs.withColumn("n_tokens", F.col("n_tokens") + 1), "lengths")     # encoded once
    return pack_lengths(seqs, "n_tokens", "salt", buckets, budget, group)
