"""Encoded lengths and exact token statistics.

``encoded_lengths`` encodes every whole text with a public vocabulary in one
pass over the documents (null: empty). ``length_histogram`` reduces the
documents to (length, documents), pre-aggregated in each task; everything else
is answered from that histogram, whose size is the number of distinct lengths.
``suffix_sums`` adds, for each length taken as a context limit, the documents
and tokens at or above it, the totals after truncation, and the quantile. Sums
run inside ranges of lengths and then over the ranges' totals, so no task holds
the whole histogram.

Defined cases: null and empty texts have length 0; an empty table gives an
empty histogram and sums; repeated rows count as often as they stand there;
null ids and other columns are ignored.
"""

from __future__ import annotations

import base64
import sys
import types

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_blocks, text_bytes

RANGE = 1024


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, so a tokenizer is
    loaded once in each worker and not in each task."""
    held = sys.modules.setdefault("_quillstream_worker", types.ModuleType("_quillstream_worker"))
    return held.__dict__.setdefault("cache", {})


def byte_bpe(path: str, pattern: str):
    """Encoder of a ranks file (base64 token and rank on each line)."""
    cache = worker_cache()
    if (path, pattern) not in cache:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cache[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return cache[path, pattern]


def encoded_lengths(docs: DataFrame, path: str, pattern: str, text: str = "text", length: str = "n_tokens",
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns of every row, and the encoded length of its text."""
    def encode(batches):
        enc = byte_bpe(path, pattern)
        for b in batches:
            col = b.column(0)
            _, offs = text_bytes(col)
            for lo, hi in row_blocks(offs):
                texts = col.slice(lo, hi - lo).to_pylist()
                n = [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [b.column(i + 1).slice(lo, hi - lo) for i in range(len(keep))] + [pa.array(n, pa.int64())],
                    names=[*keep, length])

    rows = docs.select(F.col(text).cast("string").alias("_text"), *keep)
    return rows.mapInArrow(encode, ", ".join([f"`{c}` {t}" for c, t in rows.dtypes[1:]] + [f"`{length}` long"]))


def length_histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """(length, docs)."""
    return lengths.groupBy(F.col(length).alias("length")).agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(histogram: DataFrame, width: int = RANGE) -> DataFrame:
    """For each length L of the histogram, taken as a context limit:

    ``docs``, ``tokens`` of exactly that length; ``docs_from``, ``tokens_from``
    at or above it; ``docs_upto``, ``tokens_upto`` at or below it;
    ``truncated_tokens`` and ``cut_docs`` if texts are cut at L; ``quantile``,
    the share of documents of length L or less.
    """
    h = histogram.select("length", "docs", (F.col("length") * F.col("docs")).alias("tokens"),
                         F.floor(F.col("length") / width).alias("_range"))
    ranges = h.groupBy("_range").agg(F.sum("docs").alias("_d"), F.sum("tokens").alias("_t"))
    above = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def at(c: str, w) -> Column:
        return F.coalesce(F.sum(c).over(w), F.lit(0))

    ranges = ranges.select("_range", at("_d", above).alias("_da"), at("_t", above).alias("_ta"),
                           at("_d", every).alias("_dn"), at("_t", every).alias("_tn"))
    inside = Window.partitionBy("_range").orderBy(F.desc("length"))
    s = (h.withColumn("docs_from", F.sum("docs").over(inside)).withColumn("tokens_from", F.sum("tokens").over(inside))
         .join(ranges, "_range")
         .withColumn("docs_from", F.col("docs_from") + F.col("_da"))
         .withColumn("tokens_from", F.col("tokens_from") + F.col("_ta")))
    docs_upto = F.col("_dn") - F.col("docs_from") + F.col("docs")
    tokens_upto = F.col("_tn") - F.col("tokens_from") + F.col("tokens")
    cut = F.col("docs_from") - F.col("docs")
    return s.select("length", "docs", "tokens", "docs_from", "tokens_from", docs_upto.alias("docs_upto"),
                    tokens_upto.alias("tokens_upto"), (tokens_upto + cut * F.col("length")).alias("truncated_tokens"),
                    cut.alias("cut_docs"), (docs_upto / F.col("_dn")).alias("quantile"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: documents, tokens, and tokens left if texts are cut at
    ``limit`` (any number, also between the histogram's lengths)."""
    below = F.col("length") < limit
    return sums.agg(
        F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(below, F.col("tokens")).otherwise(F.col("docs") * limit)), F.lit(0)).alias("truncated_tokens"))


def length_quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least a share ``q`` of the
    documents do not exceed (null for an empty table)."""
    return sums.filter(F.col("quantile") >= q).agg(F.min("length").alias("length"))
