"""Language identification by prediction by partial matching.

For each language, counts of bytes after each context of up to ``ORDER`` bytes
are taken from whole texts of at most about ``SAMPLE`` training documents of
that language, drawn by a hash of the id. Frozen, they give each byte a
probability: a byte seen in the context by its count, another by the context's
escape probability (method C: distinct bytes against all) times its
probability in the next shorter context with the seen bytes excluded, down to
256 equal bytes. A text's exact code length in a language is the sum of
-log2 of these; the shortest wins, ties to the smaller name.

A context is a state: the longest one seen in any language's training texts.
One lookup gives the state from the last three bytes, a second the costs of
the next byte in all languages at once.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
without training documents every text is; null languages teach nothing;
repeated rows count as often as they stand there; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import received, row_blocks, send, text_bytes

ORDER = 3
SAMPLE = 600
START = 10          # the byte that stands before a text
CHUNK = 1 << 19     # bytes looked up at a time


@dataclass
class Model:
    langs: list[str]
    pairs: np.ndarray       # (256 * 256,) number of the two-byte context, 0 if unseen
    states: np.ndarray      # (two-byte contexts + 1, 256): state after one more byte to the left
    symbol: np.ndarray      # (256,) column of a byte
    bits: np.ndarray        # (states, columns, languages) cost of a byte


def _padded(data: np.ndarray, offsets: np.ndarray):
    """The texts with ORDER start bytes before each, and the places of their own bytes."""
    at = offsets[:-1]
    buf = np.insert(data, np.repeat(at, ORDER), START)
    place = np.arange(len(data)) + ORDER * (np.repeat(np.arange(1, len(offsets)), np.diff(offsets)))
    return buf, place


def byte_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): counts of ORDER + 1 bytes, as one number."""
    def count(batches):
        for b in batches:
            langs = b.column("lang").to_pylist()
            data, offs = text_bytes(b.column("text"))
            for lo, hi in row_blocks(offs):
                buf, place = _padded(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                buf = buf.astype(np.uint32)
                row = np.repeat(np.arange(lo, hi), np.diff(offs[lo:hi + 1]))
                gram = sum(buf[place - k] << np.uint32(8 * k) for k in range(ORDER + 1))
                names = sorted(set(langs[lo:hi]))
                of = np.array([names.index(x) for x in langs[lo:hi]], np.int64)
                key, n = np.unique((of[row - lo] << 32) + gram, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in key >> 32], pa.string()), pa.array(key & 0xFFFFFFFF), pa.array(n)],
                    names=["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def training_sample(docs: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """At most about ``limit`` documents of each language, by a hash of the id."""
    d = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    d = d.filter("lang is not null and text is not null")
    sizes = d.groupBy("lang").count().collect()          # one row for each language
    share = F.lit(1.0)
    for lang, n in sizes:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, limit / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30)
    return d.filter(draw)


def _frozen(counts: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Probabilities of 256 bytes in each context (method C, with exclusion)
    from its counts and the probabilities in its shorter context."""
    n, seen = counts.sum(1, keepdims=True), counts > 0
    d = seen.sum(1, keepdims=True)
    rest = np.where(seen, 0.0, parent)
    left = rest.sum(1, keepdims=True)
    # all 256 bytes seen: nothing to escape to
    escape = np.where(left > 0, d / np.maximum(n + d, 1), 0.0)
    own = (1 - escape) * counts / np.maximum(n, 1)
    return np.where(n > 0, own + escape * rest / np.where(left > 0, left, 1.0), parent)


def fit(sample: DataFrame) -> Model | None:
    """Frozen statistics of the languages of a (bounded) sample."""
    rows = byte_counts(sample).toPandas()
    if rows.empty:
        return None
    langs = sorted(rows.lang.unique())
    gram = rows.gram.to_numpy().astype(np.int64)
    of = np.searchsorted(np.array(langs, object), rows.lang.to_numpy(object))
    n = rows.n.to_numpy(np.float64)
    sym, one, two, three = gram & 255, gram >> 8 & 255, gram >> 8 & 0xFFFF, gram >> 8
    seen2, seen3 = np.unique(two), np.unique(three)
    pairs = np.zeros(1 << 16, np.int32)
    pairs[seen2] = np.arange(1, len(seen2) + 1)
    # states: 256 of one byte, then those of two, then of three
    states = np.tile(np.concatenate([[0], 256 + np.arange(len(seen2))])[:, None], (1, 256)).astype(np.int32)
    states[pairs[seen3 & 0xFFFF], seen3 >> 16] = 256 + len(seen2) + np.arange(len(seen3))
    used = np.unique(sym)
    symbol = np.full(256, len(used), np.int64)          # bytes never seen share a column
    symbol[used] = np.arange(len(used))
    column = np.append(used, np.setdiff1d(np.arange(256), used)[:1] if len(used) < 256 else [])
    bits = np.empty((256 + len(seen2) + len(seen3), len(column), len(langs)), np.float32)
    for i in range(len(langs)):
        mine = of == i

        def table(index, size):
            t = np.zeros((size, 256))
            np.add.at(t, (index[mine], sym[mine]), n[mine])
            return t

        p0 = _frozen(table(np.zeros(len(gram), np.int64), 1), np.full((1, 256), 1 / 256))
        p1 = _frozen(table(one, 256), np.repeat(p0, 256, 0))
        p2 = _frozen(table(np.searchsorted(seen2, two), len(seen2)), p1[seen2 & 255])
        p3 = _frozen(table(np.searchsorted(seen3, three), len(seen3)), p2[np.searchsorted(seen2, seen3 & 0xFFFF)])
        bits[:, :, i] = -np.log2(np.vstack([p1, p2, p3])[:, column])
    return Model(langs, pairs, states, symbol, bits)


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, languages) exact code length of each text in bits."""
    out = np.zeros((len(offsets) - 1, len(model.langs)))
    if not len(data):
        return out
    buf, place = _padded(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    flat = model.bits.reshape(-1, len(model.langs))
    for lo in range(0, len(place), CHUNK):
        at, r = place[lo:lo + CHUNK], row[lo:lo + CHUNK]
        two = model.pairs[(buf[at - 2].astype(np.int64) << 8) + buf[at - 1]]
        state = model.states[two, buf[at - 3]]
        state = np.where(two > 0, state, buf[at - 1])
        cost = flat[state.astype(np.int64) * model.bits.shape[1] + model.symbol[buf[at]]]
        for i in range(len(model.langs)):
            out[r[0]:r[-1] + 1, i] += np.bincount(r - r[0], cost[:, i], r[-1] - r[0] + 1)
    return out


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` (the predicted language's
    share, 2 ** -bits over all languages) and ``bits`` (its code length)."""
    letters = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("text").cast("string").alias("_text"), letters.alias("_letters"), *keep)
    kept = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[2:])
    shared = send(docs.sparkSession, model)

    def guess(batches):
        m = received(Model, shared)
        for b in batches:
            data, offs = text_bytes(b.column(0))
            ok = b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in row_blocks(offs):
                names, share, bits = ["und"] * (hi - lo), np.zeros(hi - lo), np.zeros(hi - lo)
                if m is not None:
                    length = code_lengths(m, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                    best = length.argmin(1)
                    bits = length[np.arange(hi - lo), best]
                    share = np.where(ok[lo:hi], 1 / np.exp2(np.maximum(bits[:, None] - length, -1000)).sum(1), 0.0)
                    names = [m.langs[j] if good else "und" for j, good in zip(best, ok[lo:hi])]
                yield pa.RecordBatch.from_arrays(
                    [b.column(i + 2).slice(lo, hi - lo) for i in range(len(keep))]
                    + [pa.array(names, pa.string()), pa.array(share), pa.array(bits)], names=[*keep, "lang_pred", "score", "bits"])

    return rows.mapInArrow(guess, f"{kept}, lang_pred string, score double, bits double")


def held_out(modulus: int, remainder: int, key: str = "doc_id") -> Column:
    """Whether a row belongs to the held-out fold: crc32 of its id as text."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def identify(docs: DataFrame, limit: int = SAMPLE, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits) of every row; learned from
    the rows outside the held-out fold."""
    fold = held_out(modulus, remainder)
    model = fit(training_sample(docs.filter(~fold), limit))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("held_out"), "text")
    return predict(rows, model, keep=("doc_id", "held_out"))
