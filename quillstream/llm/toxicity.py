"""Severity grades by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector for all grades, one
ordered threshold between each two. x holds log(1 + count) of selected sparse
features: whole words and the first 4 to 7 bytes of words (so that inflected
and compounded forms share weight), hashed from the bytes.

Labels that only say toxic or not have two grades; the toxic documents are
then split in two, at the median of their counts of features chosen below.

Fitting uses at most ``SAMPLE`` labelled documents of each grade, drawn by a
hash of the id; rows are weighted back to the grades' true shares. Features
are chosen by their likelihood-ratio association with the grade being above 0,
counted in Spark; at most ``FEATURES`` of them reach the driver. Scoring is
one pass over whole texts with the fitted weights.

Defined cases: null, empty and wordless texts get the features' absence (x =
0); labels that are null, or name no document, are ignored, and of repeated
ones the highest grade counts; without labelled grades above 0 everything is
grade 0; each row of the documents gives one row; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, mix, powers, received, row_blocks, rows_of, send, stored, text_bytes, words

SAMPLE = 4096
FEATURES = 512
PREFIXES = (4, 5, 6, 7)
LEAST = 20.0            # least likelihood ratio of a feature
RIDGE = 3e-5


@dataclass
class Model:
    hashes: np.ndarray      # sorted feature hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than the grades
    cut: float = np.inf     # w.x from which a document is rejected as toxic


def features(data: np.ndarray, offsets: np.ndarray):
    """(row, hash) of every feature occurrence of a block of texts."""
    w = words(data, offsets, ALNUM)
    row = rows_of(w.first)
    yield row, w.hash
    # the words' bytes without separators again, to hash prefixes
    low = LOWER[data].astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(low * powers(len(low)), out=total[1:])
    start = w.start - row                   # each row before it added one separator
    size = w.end - w.start
    back = powers(len(low) + 1, 0x9E3779B97F4A7C15)
    for k in PREFIXES:
        at = np.flatnonzero(size >= k)
        s = start[at]
        h = (total[s + k] - total[s]) * back[s + k - 1]
        yield row[at], mix(h + np.uint64(k << 56))


def _counts(row: np.ndarray, feature: np.ndarray, size: int):
    """Distinct (row, feature) pairs and how often each occurs."""
    key, n = np.unique(row.astype(np.int64) * size + feature, return_counts=True)
    return key // size, key % size, n


class _Lookup:
    """Places and numbers of a block's selected features."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def __call__(self, data, offsets):
        rows, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for row, h in features(data, offsets):
            at = np.flatnonzero(self.bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            if len(at) and len(self.hashes):
                ix = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
                ok = self.hashes[ix] == h[at]
                rows.append(row[at[ok]])
                found.append(ix[ok])
        return _counts(np.concatenate(rows), np.concatenate(found), max(1, len(self.hashes)))


def labelled_sample(docs: DataFrame, grades: DataFrame, limit: int = SAMPLE) -> tuple[DataFrame, dict]:
    """(grade, text) of at most about ``limit`` documents of each grade, and
    each grade's number of labelled ids. ``grades``: doc_id, grade."""
    g = (grades.filter("doc_id is not null and grade is not null")
         .groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade")))
    sizes = {r[0]: r[1] for r in g.groupBy("grade").count().collect()}
    share = F.lit(0.0)
    for k, n in sizes.items():
        share = F.when(F.col("grade") == k, F.lit(min(1.0, limit / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30)
    picked = F.broadcast(g.filter(draw))              # at most about limit ids of each grade
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(picked, "doc_id").select("grade", "text"), sizes


def _association(sample: DataFrame, least: float, limit: int) -> np.ndarray:
    """Hashes of the features most associated with a grade above 0."""
    def count(batches):
        for b in batches:
            data, offs = text_bytes(b.column("text"))
            toxic = b.column("grade").to_numpy(zero_copy_only=False) > 0
            for lo, hi in row_blocks(offs):
                parts = list(features(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]))
                row, h = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                names, ix = np.unique(h, return_inverse=True)
                r, f, _ = _counts(row, ix, max(1, len(names)))
                hot = toxic[lo:hi][r]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.view(np.int64)), pa.array(np.bincount(f, minlength=len(names))),
                     pa.array(np.bincount(f[hot], minlength=len(names)))], names=["f", "n", "t"])

    n, t = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("grade") > 0).cast("long")), F.lit(0))).first()
    if not t or t == n:
        return np.empty(0, np.uint64)
    seen = sample.mapInArrow(count, "f long, n long, t long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))

    def term(o, e):
        return F.when(o > 0, o * F.log(o / e)).otherwise(0.0)

    c = F.col("n") - F.col("t")
    p = F.col("n") / F.lit(float(n))
    ratio = 2 * (term(F.col("t"), p * t) + term(c, p * (n - t)) + term(t - F.col("t"), (1 - p) * t) + term(n - t - c, (1 - p) * (n - t)))
    top = (seen.filter((F.col("t") * (n - t) > c * t) & (F.col("t") >= 3)).select("f", ratio.alias("g"))
           .filter(F.col("g") >= least).orderBy(F.desc("g"), "f").limit(limit).collect())
    return np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64))


def fit_ordinal(x: np.ndarray, y: np.ndarray, weight: np.ndarray, grades: int, ridge: float = RIDGE, steps: int = 1200):
    """Weights and ordered thresholds of the largest penalised likelihood, by
    Adam steps on (w, theta_0, log gaps)."""
    def sigmoid(v):
        return 0.5 * (1 + np.tanh(v / 2))

    k = grades - 1
    share = np.clip(np.array([weight[y <= j].sum() for j in range(k)]) / weight.sum(), 1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(k))
    p = np.concatenate([np.zeros(x.shape[1]), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    weight = weight / weight.sum()

    def parts(p):
        return p[:-k], np.cumsum(np.concatenate([p[-k:][:1], np.exp(p[-k:][1:])]))

    for step in range(1, steps + 1):
        w, th = parts(p)
        edge = np.concatenate([[-np.inf], th, [np.inf]])
        z = x @ w
        hi, lo = sigmoid(edge[y + 1] - z), sigmoid(edge[y] - z)
        prob = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / prob, lo * (1 - lo) / prob
        gw = x.T @ (weight * (dhi - dlo)) + ridge * w
        gt = np.array([(weight * ((y == j + 1) * dlo - (y == j) * dhi)).sum() for j in range(k)])
        tail = np.cumsum(gt[::-1])[::-1]            # theta_j moves all thresholds above it
        gp = np.concatenate([[tail[0]], tail[1:] * np.exp(p[-k:][1:])])
        grad = np.concatenate([gw, gp])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        p = p - 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return parts(p)


def best_cut(z: np.ndarray, bad: np.ndarray, weight: np.ndarray) -> float:
    """The value between two scores that misjudges the least weight of the
    sample; of several, the middle of the widest gap."""
    order = np.argsort(z, kind="stable")
    z, w = z[order], np.where(bad[order], weight[order], -weight[order])
    cost = np.cumsum(w)                     # toxic weight at or below less clean weight there
    ends = np.flatnonzero(np.append(np.diff(z) > 0, False))
    if not len(ends):
        return np.inf
    best = ends[cost[ends] <= cost[ends].min() + 1e-12]
    k = best[np.argmax(z[best + 1] - z[best])]
    return float((z[k] + z[k + 1]) / 2)


def fit(docs: DataFrame, grades: DataFrame, limit: int = SAMPLE, n_features: int = FEATURES, least: float = LEAST) -> Model:
    sample, sizes = labelled_sample(docs, grades, limit)
    top = max(sizes, default=0)
    if top < 1:
        return Model(np.empty(0, np.uint64), np.empty(0), np.array([np.inf]))
    sample = stored(sample.dropDuplicates(["grade", "text"]), "labelled")       # copies would vote for their words
    hashes = _association(sample, least, n_features)

    def extract(batches):
        find = _Lookup(hashes)
        for b in batches:
            data, offs = text_bytes(b.column("text"))
            for lo, hi in row_blocks(offs):
                row, f, n = find(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column("grade").slice(lo, hi - lo),
                     pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(f, pa.int32())),
                     pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(n, pa.int32()))], names=["grade", "f", "n"])

    rows = sample.mapInArrow(extract, "grade int, f array<int>, n array<int>").collect()   # the bounded sample
    y = np.array([r[0] for r in rows], np.int64)
    if not (y > 0).any():
        return Model(np.empty(0, np.uint64), np.empty(0), np.array([np.inf]))
    if top == 1:
        much = np.array([sum(r[2]) for r in rows])
        y += (y > 0) & (much > np.median(much[y > 0]))
        sizes = {0: sizes.get(0, 0)} | {g: sizes[1] * (y == g).sum() / (y > 0).sum() for g in (1, 2)}
        top = int(y.max())
    x = np.zeros((len(rows), len(hashes)))
    for i, r in enumerate(rows):
        x[i, r[1]] = np.log1p(r[2])
    order = np.lexsort((x @ np.arange(1, len(hashes) + 1), y))      # the same sums in any order of arrival
    x, y = x[order], y[order]
    have = np.bincount(y, minlength=top + 1)
    weight = np.array([sizes.get(g, 0) / max(1, have[g]) for g in range(top + 1)])[y]
    w, theta = fit_ordinal(x, y, weight, top + 1)
    return Model(hashes, w, theta, best_cut(x @ w, y > 0, weight))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the likeliest grade (``grade``), ``severity`` (the expected grade),
    ``p_toxic`` (probability of a grade above 0) and ``toxic`` (w.x reaches the model's cut)."""
    shared = send(docs.sparkSession, model)
    rows = docs.select(F.col("text").cast("string").alias("_text"), *keep)

    def rate(batches):
        m = received(Model, shared)
        find = _Lookup(m.hashes)
        for b in batches:
            data, offs = text_bytes(b.column(0))
            for lo, hi in row_blocks(offs):
                row, f, n = find(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                z = np.bincount(row, np.log1p(n) * m.weights[f] if len(f) else np.empty(0), hi - lo)
                above = 0.5 * (1 - np.tanh((m.thresholds[:, None] - z[None, :]) / 2))    # P(grade > k)
                grade = np.argmax(-np.diff(np.vstack([np.ones(hi - lo), above, np.zeros(hi - lo)]), axis=0), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [b.column(i + 1).slice(lo, hi - lo) for i in range(len(keep))]
                    + [pa.array(grade, pa.int32()), pa.array(above.sum(0)), pa.array(above[0]), pa.array(z >= m.cut)],
                    names=[*keep, "grade", "severity", "p_toxic", "toxic"])

    kept = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[1:])
    return rows.mapInArrow(rate, f"{kept}, grade int, severity double, p_toxic double, toxic boolean")


def label_grades(labels: DataFrame) -> DataFrame:
    """Grade 0 or 1 from the label table; ``fit`` splits the toxic ones by severity."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("grade"))
