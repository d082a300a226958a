"""Benchmark decontamination by a positional inverted index.

``build_index`` stores, for every document, the positions of the benchmark's
terms (a document-partitioned index: a document's lists stay together, so
intersecting them needs no shuffle and a common term splits over all
partitions). ``phrase_hits`` starts at the list of each window's rarest term
(by its count over all documents), shifts it by the term's offset and keeps
the starts that the next rarest terms' lists also hold. ``proximity_matches``
asks for all terms within a distance of the rarest one, in any order.

The benchmark is taken in blocks of at most ``BLOCK_WINDOWS`` different
windows: only a block's terms and windows are sent to the executors, whatever
its size and however many items share a window. Hits name windows; Spark joins
them with the items.

Defined cases: null or wordless texts have no words and no hits; null
``item_id`` rows take no part, repeated item rows count once; every document
row gives one result row, repeated ids included; an empty benchmark hits
nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, list_array, received, row_blocks, rows_of, send, stored, text_bytes, words

WINDOW = 10
BLOCK_WINDOWS = 200_000
GAP = 64            # empty positions between documents; windows must be shorter
PAIRS = 1 << 20     # candidate starts handled at a time

INDEX = "row long, doc_id long, n_words int, terms array<int>, positions array<int>"
HITS = "row long, doc_id long, n_words int, starts array<int>, ends array<int>, keys array<string>"
RESULT = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, item, terms): each run of ``window`` words of an item, or all the
    words of a shorter one."""
    def cut(batches):
        for b in batches:
            data, offs = text_bytes(b.column("text"))
            ids = b.column("item_id").to_pylist()
            w = words(data, offs, ALNUM)
            keys, item, terms = [], [], []
            for i, name in enumerate(ids):
                h = w.hash[w.first[i]:w.first[i + 1]]
                for t in [h] if len(h) < window else np.lib.stride_tricks.sliding_window_view(h, window):
                    if len(t):
                        keys.append(hashlib.sha1(t.tobytes()).hexdigest())
                        item.append(name)
                        terms.append(t.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(item, pa.string()), pa.array(terms, pa.list_(pa.int64()))],
                names=["key", "item", "terms"])

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.filter("item_id is not null").mapInArrow(cut, "key string, item string, terms array<long>").distinct()


class Phrases:
    """One block of windows: its sorted vocabulary and each window's terms."""

    def __init__(self, rows):
        self.keys = [key for key, _ in rows]
        width = max((len(terms) for _, terms in rows), default=1)
        self.length = np.array([len(terms) for _, terms in rows], np.int64)
        h = np.zeros((len(rows), width), np.uint64)
        self.used = np.zeros((len(rows), width), bool)
        for i, (_, terms) in enumerate(rows):
            h[i, :len(terms)] = np.array(terms, np.int64).view(np.uint64)
            self.used[i, :len(terms)] = True
        self.vocab = np.unique(h[self.used])
        self.term = np.where(self.used, np.searchsorted(self.vocab, h), -1).astype(np.int32)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.vocab & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def ids(self, h: np.ndarray):
        """Places in ``h`` of the vocabulary's words, and their numbers."""
        at = np.flatnonzero(self.bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if not len(self.vocab):
            return at[:0], at[:0].astype(np.int32)
        ix = np.minimum(np.searchsorted(self.vocab, h[at]), len(self.vocab) - 1)
        ok = self.vocab[ix] == h[at]
        return at[ok], ix[ok].astype(np.int32)

    def order(self, counts: np.ndarray) -> None:
        """Each window's places, rarest term first; windows by rarest term."""
        rank = np.where(self.used, counts[np.maximum(self.term, 0)], np.iinfo(np.int64).max)
        self.place = np.argsort(rank, axis=1, kind="stable")
        rare = np.take_along_axis(self.term, self.place[:, :1], 1)[:, 0]
        self.by_rare = np.argsort(rare, kind="stable")
        self.rare_first = np.searchsorted(rare[self.by_rare], np.arange(len(self.vocab) + 1))


def build_index(docs: DataFrame, phrases: Phrases) -> DataFrame:
    """Positions of the vocabulary's terms in each whole document, stored."""
    shared = send(docs.sparkSession, phrases)

    def index(batches):
        ph, part, seq = received(Phrases, shared), TaskContext.get().partitionId(), 0
        for b in batches:
            data, offs = text_bytes(b.column("text"))
            ids = b.column("doc_id")
            for lo, hi in row_blocks(offs):
                w = words(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], ALNUM)
                at, term = ph.ids(w.hash)
                row = rows_of(w.first)[at]
                cut = np.searchsorted(at, w.first)
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array((part << 40) + seq + np.arange(n), pa.int64()), ids.slice(lo, n),
                     pa.array(np.diff(w.first), pa.int32()), list_array(term, cut, pa.int32()),
                     list_array(at - w.first[row], cut, pa.int32())],
                    names=["row", "doc_id", "n_words", "terms", "positions"])
                seq += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(index, INDEX), "postings")


def term_counts(index: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each vocabulary term over all documents."""
    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            t = b.column("terms").flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(t, minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["term", "n"])

    out = np.zeros(size, np.int64)
    for r in index.select("terms").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n")).collect():
        out[r[0]] = r[1]
    return out


def _lists(batch):
    """A batch's postings on one axis with ``GAP`` empty places after each
    document: term at each place, each document's first place."""
    n_words = batch.column("n_words").to_numpy(zero_copy_only=False).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(n_words + GAP)])
    terms = batch.column("terms")
    size = np.diff(terms.offsets.to_numpy(zero_copy_only=False))
    term = terms.flatten().to_numpy(zero_copy_only=False)
    place = batch.column("positions").flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(base[:-1], size)
    return base, term, place


def _pairs(sizes: np.ndarray, limit: int = PAIRS):
    """Ranges of lists whose sizes add to ``limit`` at most (or one list)."""
    total, lo = np.concatenate([[0], np.cumsum(sizes)]), 0
    while lo < len(sizes):
        hi = max(int(np.searchsorted(total, total[lo] + limit, "right")) - 1, lo + 1)
        yield lo, hi
        lo = hi


def _starts(ph: Phrases, base, term, place):
    """(start, window) of every whole occurrence."""
    axis = np.full(base[-1] + GAP, -1, np.int32)
    axis[place] = term
    many = np.diff(ph.rare_first)[term]
    probe = many > 0
    term, place, many = term[probe], place[probe], many[probe]
    found_s, found_w = [], []
    for lo, hi in _pairs(many):
        m = many[lo:hi]
        at = np.repeat(place[lo:hi], m)
        k = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
        win = ph.by_rare[np.repeat(ph.rare_first[term[lo:hi]], m) + k]
        s = at - ph.place[win, 0]
        ok = s >= 0
        s, win = s[ok], win[ok]
        for j in range(1, ph.term.shape[1]):          # the next rarest lists
            off = ph.place[win, j]
            ok = ~ph.used[win, off] | (axis[np.minimum(s + off, len(axis) - 1)] == ph.term[win, off])
            s, win = s[ok], win[ok]
        found_s.append(s)
        found_w.append(win)
    if not found_s:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_s), np.concatenate(found_w)


def phrase_hits(index: DataFrame, phrases: Phrases) -> DataFrame:
    """Per document: the maximal runs of hit words and the windows found."""
    if phrases.term.shape[1] > GAP:
        raise ValueError(f"windows are at most {GAP} words")
    shared = send(index.sparkSession, phrases)

    def search(batches):
        ph = received(Phrases, shared)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                base, term, place = _lists(b)
                s, win = _starts(ph, base, term, place)
                hit = np.zeros(base[-1] + 1, np.int32)
                np.add.at(hit, s, 1)
                np.add.at(hit, s + ph.length[win], -1)
                on = np.cumsum(hit) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
                left, right = edge[::2], edge[1::2]
                doc = np.searchsorted(base, left, "right") - 1
                cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
                keys: list[list] = [[] for _ in range(b.num_rows)]
                owner = np.searchsorted(base, s, "right") - 1
                for d, w in np.unique(np.stack([owner, win], 1), axis=0) if len(s) else ():
                    keys[d].append(ph.keys[w])
                yield pa.RecordBatch.from_arrays(
                    [b.column("row"), b.column("doc_id"), b.column("n_words"),
                     list_array(left - base[doc], cut, pa.int32()), list_array(right - base[doc], cut, pa.int32()),
                     pa.array(keys, pa.list_(pa.string()))],
                    names=["row", "doc_id", "n_words", "starts", "ends", "keys"])

    return index.mapInArrow(search, HITS)


def proximity_hits(index: DataFrame, phrases: Phrases, distance: int) -> DataFrame:
    """(doc_id, key, position): places of a window's rarest term with every
    other term of the window within ``distance`` words of the document, in any
    order. All windows are searched at once in lists sorted by term and place."""
    shared = send(index.sparkSession, phrases)

    def search(batches):
        ph = received(Phrases, shared)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                base, term, place = _lists(b)
                span = base[-1] + 2 * GAP + 2 * distance
                lists = np.sort(term.astype(np.int64) * span + place)
                many = np.diff(ph.rare_first)[term]
                term, place, many = term[many > 0], place[many > 0], many[many > 0]
                for x, y in _pairs(many):
                    m = many[x:y]
                    at = np.repeat(place[x:y], m)
                    k = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
                    win = ph.by_rare[np.repeat(ph.rare_first[term[x:y]], m) + k]
                    for j in range(1, ph.term.shape[1]):
                        doc = np.searchsorted(base, at, "right") - 1
                        off = ph.place[win, j]
                        start = ph.term[win, off].astype(np.int64) * span
                        near = np.searchsorted(lists, start + np.maximum(at - distance, base[doc]))
                        last = start + np.minimum(at + distance, base[doc + 1] - GAP - 1)
                        ok = ~ph.used[win, off] | ((near < len(lists)) & (lists[np.minimum(near, len(lists) - 1)] <= last))
                        at, win = at[ok], win[ok]
                    doc = np.searchsorted(base, at, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(pa.array(doc)), pa.array([ph.keys[w] for w in win], pa.string()),
                         pa.array(at - base[doc], pa.int32())], names=["doc_id", "key", "position"])

    return index.mapInArrow(search, "doc_id long, key string, position int")


def proximity_matches(docs: DataFrame, items: DataFrame, distance: int, window: int = WINDOW,
                      block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, item, position) of every row's proximity hits; an item's hit is
    given once for each of its windows whose rarest term stands there."""
    hits, cuts = None, item_windows(items, window)
    for index, ph in indexed(docs, cuts, block_windows):
        part = proximity_hits(index, ph, distance)
        hits = part if hits is None else hits.unionByName(part)
    return hits.join(cuts.select("key", "item"), "key").select("doc_id", "item", "position")


def indexed(docs: DataFrame, cuts: DataFrame, block_windows: int = BLOCK_WINDOWS):
    """(index, phrases) of each block of the benchmark's different windows."""
    different = cuts.select("key", "terms").dropDuplicates(["key"])
    blocks = max(1, math.ceil(different.count() / block_windows))
    part = F.pmod(F.xxhash64("key"), F.lit(blocks))
    for i in range(blocks):
        ph = Phrases(different.filter(part == i).collect())     # about block_windows rows, one a window
        index = build_index(docs, ph)
        ph.order(term_counts(index, len(ph.vocab)))
        yield index, ph


def _finish(hits: DataFrame) -> DataFrame:
    """Result columns from a document's hit runs (of one block or several) and items."""
    def covered(starts, ends):
        total, upto = 0, 0
        for x, y in sorted(zip(starts, ends)):
            total += max(0, y - max(x, upto))
            upto = max(upto, y)
        return total

    def finish(batches):
        for b in batches:
            n = pa.array([covered(s, e) for s, e in zip(b.column("starts").to_pylist(), b.column("ends").to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words").cast(pa.int64()), n, b.column("items")],
                                             names=["doc_id", "n_words", "n_hit", "items"])

    counted = hits.select("doc_id", "n_words", "starts", "ends", "items").mapInArrow(
        finish, "doc_id long, n_words long, n_hit long, items array<string>")
    return counted.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                          F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                          (F.col("n_hit") > 0).alias("contaminated"))


def document_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                  block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document row: hit runs over all blocks of the benchmark, and the
    sorted items of the windows found."""
    cuts = stored(item_windows(items, window), "windows")
    hits = None
    for index, ph in indexed(docs, cuts, block_windows):
        part = phrase_hits(index, ph)
        hits = part if hits is None else hits.unionByName(part)
    hits = stored(hits, "hits")
    found = hits.select("row", F.explode("keys").alias("key")).join(cuts.select("key", "item"), "key").select("row", "item").distinct()
    named = found.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    whole = hits.groupBy("row").agg(                        # one row of each block
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        *(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")))
    return whole.join(named, "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                  block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document row: words, hit words, items found, their digest."""
    return _finish(document_hits(docs, items, window, block_windows))
