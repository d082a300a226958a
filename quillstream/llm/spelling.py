"""Spelling variants of a corpus vocabulary by Bloom-guided neighbourhoods.

1. ``word_counts``: words are maximal runs of ASCII letters and U+00C0-U+00FF,
   counted over whole texts; one run in 97 (by crc32 of document and run) has
   one letter deleted first. Blocks of text are cut and counted with numpy, one
   row for each different word of a block, and summed by Spark.
2. ``filters``: the vocabulary's hashes go into blocked Bloom filters, one shard
   for each word length, one 64-bit block a word. The bits are OR-ed by Spark;
   the filters are broadcast, and hold ``MAX_BYTES`` at most: beyond that a word
   gets fewer bits and more false positives pass, with the same result.
3. ``neighbours``: for every word all single deletions, and the replacements by a
   greater letter, are generated as rolling hashes and probed in the shard of
   their length. An insertion is the deletion seen from the longer word, and a
   replacement by a smaller letter is seen from the other word. Only positives
   become strings and are shuffled to an exact join with the vocabulary, which
   removes false positives.
4. ``variants``: a word's form is its near word of largest count if that is at
   least twice its own; forms are followed to the root by pointer jumping,
   where counts at least double at every step.

Defined cases: a null text has no words; a null id counts as an empty string
in the key; equal rows count each; an empty table gives no rows; a text may be
one run of any length; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _INVERSE, LOWER, block_and_mask, mix, powers, row_blocks, stored, text_bytes

LEAST_LENGTH = 5
LEAST_COUNT = 3
ODDS = 97                   # one run in so many loses a letter
MAX_BYTES = 16 << 20        # of all filters together
WORD_BITS = 16              # bits of filter a word, while that fits
LONGEST_SHARD = 40          # words of so many code points or more share a shard
PROBE_BLOCK = 1 << 20       # edits generated at a time


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def _runs(data: np.ndarray, offsets: np.ndarray):
    """Folded bytes, and the rows, starts and ends of the runs of letters."""
    low = LOWER[data]
    lead = low == 0xC3                              # U+00C0 to U+00FF are this byte and one more
    inside = lead | ((low >= 97) & (low <= 122))
    inside[1:] |= lead[:-1]
    sep = offsets[1:]
    low, inside = np.insert(low, sep, 32), np.insert(inside, sep, False)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    row = np.searchsorted(sep + np.arange(len(sep)), start)
    return low, row, start, end


def _crcs(low: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each run, continued from the crc32 ``state`` of its prefix."""
    crc = state ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(start - end, kind="stable")          # longest first
    crc, at, size = crc[order], start[order], (end - start)[order]
    active, j = len(order), 0
    while active and j < 64:
        active = int(np.searchsorted(-size, -j, "left"))    # runs of more than j bytes
        c = crc[:active]
        crc[:active] = _CRC[(c ^ low[at[:active] + j]) & np.uint32(255)] ^ (c >> np.uint32(8))
        j += 1
    for k in range(active):                                 # the few very long runs
        if size[k] > j:
            tail = zlib.crc32(low[at[k] + j:at[k] + size[k]].tobytes(), int(crc[k]) ^ 0xFFFFFFFF)
            crc[k] = np.uint32(tail ^ 0xFFFFFFFF)
    out = np.empty(len(order), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _strings(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
    size = end - start
    cut = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - cut[:-1], size) + np.arange(cut[-1])
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(low[at].tobytes()))


def word_counts(docs: DataFrame, least: int = LEAST_COUNT, odds: int = ODDS) -> DataFrame:
    """(word, n) of the words of at least ``LEAST_LENGTH`` code points that
    occur at least ``least`` times."""
    def count(batches):
        for b in batches:
            data, offs = text_bytes(b.column("text"))
            ids = b.column("id").to_pylist()
            for lo, hi in row_blocks(offs):
                low, row, start, end = _runs(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                if not len(start):
                    continue
                prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[lo:hi]], np.uint32)
                crc = _crcs(low, start, end, prefix[row])
                hit = crc % np.uint32(odds) == 0
                edited = Counter()
                for h, s, e in zip(crc[hit].tolist(), start[hit].tolist(), end[hit].tolist()):
                    run = low[s:e].tobytes().decode()
                    k = h % len(run)
                    if len(run) > LEAST_LENGTH:
                        edited[run[:k] + run[k + 1:]] += 1
                leads = np.concatenate([[0], np.cumsum(low == 0xC3)])
                keep = ~hit & (end - start - (leads[end] - leads[start]) >= LEAST_LENGTH)
                start, end = start[keep], end[keep]
                total = np.zeros(len(low) + 1, np.uint64)
                np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(len(low)), out=total[1:])
                h = mix((total[end] - total[start]) * powers(len(low) + 1, _BASE)[np.maximum(end, 1) - 1])
                _, first, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([_strings(low, start[first], end[first]), pa.array(n, pa.int64())], names=["word", "n"])
                if edited:
                    yield pa.RecordBatch.from_arrays([pa.array(edited.keys(), pa.string()), pa.array(edited.values(), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _points(words: pa.Array):
    """Code points of a column of words, and the offsets of the words."""
    text = "".join(words.to_pylist())
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    size = np.array([len(w) for w in words.to_pylist()], np.int64)
    return points, np.concatenate([[0], np.cumsum(size)])


def _hashes(points: np.ndarray, offsets: np.ndarray):
    """Prefix sums c_i * BASE^i that restart at each word, and the words' hashes."""
    size = np.diff(offsets)
    place = np.arange(len(points)) - np.repeat(offsets[:-1], size)
    term = points.astype(np.uint64) * powers(int(size.max(initial=0)) + 2, _BASE)[place]
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(term, out=total[1:])
    return place, term, total, total[offsets[1:]] - total[offsets[:-1]]


def shard_of(length):
    return np.minimum(length, LONGEST_SHARD)


def filters(vocabulary: DataFrame, max_bytes: int = MAX_BYTES):
    """Blocked Bloom filters of the words, as plain arrays: first block of each
    shard, and the blocks. ``max_bytes`` bounds them whatever the vocabulary."""
    shard = F.least(F.length("word"), F.lit(LONGEST_SHARD))
    words = np.zeros(LONGEST_SHARD + 1, np.int64)
    for r in vocabulary.groupBy(shard.alias("shard")).count().collect():        # a row for each shard
        words[r["shard"]] = r["count"]
    bits = min(WORD_BITS, 8 * max_bytes / max(1, words.sum()))
    blocks = np.where(words > 0, np.maximum(1, words * bits // 64), 0).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(blocks)])

    def set_bits(batches):
        for b in batches:
            if b.num_rows:
                points, offs = _points(b.column("word"))
                s = shard_of(np.diff(offs))
                block, mask = block_and_mask(_hashes(points, offs)[3], blocks[s])
                yield pa.RecordBatch.from_arrays([pa.array(first[s] + block), pa.array(mask.view(np.int64))], names=["block", "mask"])

    rows = vocabulary.select("word").mapInArrow(set_bits, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(first[-1], np.uint64)
    table[rows.column("block").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return blocks, first, table


def neighbours(vocabulary: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(a, n_a, b, n_b): every pair of words one edit apart, once."""
    spark = vocabulary.sparkSession
    letters = [chr(c) for c in range(97, 123)] + [chr(c) for c in range(0xC0, 0x100)]
    alphabet = np.array(sorted(map(ord, letters)), np.uint64)
    shared = spark.sparkContext.broadcast(filters(vocabulary, max_bytes))

    def probe(batches):
        blocks, first, table = shared.value

        def found(h, shard):
            ok = blocks[shard] > 0
            block, mask = block_and_mask(h, np.maximum(blocks[shard], 1))
            at = np.where(ok, first[shard] + block, 0)
            return ok & ((table[at] & mask) == mask) if len(table) else np.zeros(len(h), bool)

        for b in batches:
            step = max(1, PROBE_BLOCK // 1000)
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                words = part.column("word").to_pylist()
                points, offs = _points(part.column("word"))
                size = np.diff(offs)
                word = np.repeat(np.arange(len(words)), size)
                place, term, total, whole = _hashes(points, offs)
                hit_word, hit_edit = [], []
                # deletion of place i: the letters after it move down by one
                rest = (total[offs[1:]][word] - total[1:]) * np.uint64(_INVERSE)
                h = total[:-1] - total[offs[:-1]][word] + rest
                again = np.zeros(len(points), bool)
                again[1:] = (points[1:] == points[:-1]) & (word[1:] == word[:-1])       # the same word as one place before
                ok = ~again & (size[word] > LEAST_LENGTH)
                k = np.flatnonzero(ok)
                k = k[found(h[k], shard_of(size[word[k]] - 1))]
                hit_word += word[k].tolist()
                hit_edit += [words[w][:p] + words[w][p + 1:] for w, p in zip(word[k].tolist(), place[k].tolist())]
                power = powers(int(size.max(initial=0)) + 2, _BASE)[place]
                for start in range(0, len(points), PROBE_BLOCK // len(alphabet)):
                    part_ = slice(start, start + PROBE_BLOCK // len(alphabet))
                    i, j = np.nonzero(alphabet[None, :] > points[part_, None])
                    i += start
                    h = whole[word[i]] + (alphabet[j] - points[i].astype(np.uint64)) * power[i]
                    ok = np.flatnonzero(found(h, shard_of(size[word[i]])))
                    for w, p, c in zip(word[i[ok]].tolist(), place[i[ok]].tolist(), alphabet[j[ok]].tolist()):
                        hit_word.append(w)
                        hit_edit.append(words[w][:p] + chr(c) + words[w][p + 1:])
                rows = pa.array(hit_word, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("word").take(rows), part.column("n").take(rows), pa.array(hit_edit, pa.string())],
                                                 names=["a", "n_a", "b"])

    positives = vocabulary.select("word", "n").mapInArrow(probe, "a string, n_a long, b string")
    return positives.join(vocabulary.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b").select("a", "n_a", "b", "n_b")


def variants(docs: DataFrame, least: int = LEAST_COUNT, odds: int = ODDS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    vocabulary = stored(word_counts(docs, least, odds), "vocabulary")
    pairs = neighbours(vocabulary, max_bytes)
    # each pair seen from both words, without a second run of the probes
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
                                           F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("s")).select("s.*")
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    is_form = -F.col("best.m") >= 2 * F.col("n")
    words = stored(vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, -F.col("best.m")).alias("form_n")), "forms")
    roots = words.filter("form is not null").select("word", F.col("form").alias("root"))
    step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
    while not step.join(roots, "root", "left_semi").isEmpty():                  # some root has a form of its own
        roots = stored(roots.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
    return words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
