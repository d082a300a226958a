"""Exact removal of repeated byte strings by threshold-bounded interval expansion.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else
(same document included) is removed, judged on the whole input.

1. ``window_runs`` cuts each text into runs of consecutive windows of
   ``LENGTH`` bytes that have the same least ``GRAM``-byte hash. Equal windows
   have the same hash, wherever they stand, so a hash that occurs once rules
   its run out; only runs whose hash repeats go on.
2. Runs of equal bytes (by a second hash, of the whole run) are counted first;
   copies are never gathered, and need no bytes.
3. One run of each kind, where a hash has several, is pooled with its bytes
   into texts of about ``POOL`` bytes. There ``repeated_windows``
   sorts the suffixes, forms the Burrows-Wheeler transform and finds common
   prefix lengths in increasing order: the borders between intervals of length
   l, extended backward by each byte, give the borders of length l + 1; after
   ``LENGTH`` - 1 rounds, places without a border share ``LENGTH`` bytes.
4. A hash with more than ``CROWD`` different runs (a passage in very many
   documents, each with its own surroundings) is split by the bytes that all
   windows of a part have in common, in ever smaller parts (``GRIDS``), so no
   pool depends on how common a passage is; in the last step a part is one
   window and equal parts are counted.

Defined cases: null is an empty text; texts under ``LENGTH`` bytes lose
nothing; equal rows (same id and text) repeat each other and lose all their
windows; null and repeated ids are kept as rows of their own; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, mix, powers, row_blocks, stored, text_bytes

LENGTH = 400
PASSAGE = 200           # bytes that over 50 words have at least: 51 words of three letters and a blank
WORDS = 51
GRAM = 32
PIECE = 1024            # windows of a run at most
POOL = 3 << 18
CROWD = 1500
GRIDS = (64, 8, 1)
SLICE = 1 << 20         # bytes hashed at a time; must be under 2**24
NEAR = 32               # interval places walked before the ranks are searched

RUNS = "k1 long, k2 long, v long, sh long, start int, n int, anchor int, again boolean"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of a block's windows: (row, start, windows, hash, hash of all its
    bytes, anchor, again). ``anchor``: place of the least hash's bytes after
    the start; ``again``: they occur more than once in the run."""
    n, w = len(data), length - gram + 1
    total = n - length + 1
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64, bool))
    if total < 1:
        return none
    s = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n), out=s[1:])
    h = mix((s[gram:] - s[:-gram]) * powers(n + 1, _BASE)[gram - 1:n])
    low = np.uint64((1 << 24) - 1)
    place = np.arange(len(h), dtype=np.uint64)

    def least(m):
        size = 1
        while size * 2 <= w:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        return np.minimum(m[:total], m[w - size:w - size + total])

    first = (least((h & ~low) | place) & low).astype(np.int64)
    last = (low - (least((h & ~low) | (low - place)) & low)).astype(np.int64)
    v = h[first]
    end = np.repeat(offsets[1:], np.diff(offsets))[:total]
    at = np.arange(total)
    valid = at + length <= end
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (v[1:] != v[:-1])
    starts = np.flatnonzero(new)
    if not len(starts):
        return none
    count = np.add.reduceat(valid.astype(np.int64), starts)
    # in a run of more windows than a window has grams the least place has moved to an equal hash
    again = np.logical_or.reduceat((first != last) & valid, starts) | (count > w)
    parts = -(-count // PIECE)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    at = np.repeat(starts, parts) + k * PIECE
    row = np.searchsorted(offsets, at, "right") - 1
    size = np.minimum(PIECE, np.repeat(count, parts) - k * PIECE)
    end = at + size + length - 1
    whole = mix((s[end] - s[at]) * powers(n + 1, _BASE)[end - 1] + size.astype(np.uint64))
    return row, at - offsets[row], size, v[at], whole, first[at] - at, np.repeat(again, parts)


def _slices(offsets: np.ndarray, length: int):
    """Blocks (row, start byte) -> bytes: rows, or slices of a long row that
    overlap by one byte less than a window."""
    for lo, hi in row_blocks(offsets, SLICE):
        a, b = offsets[lo], offsets[hi]
        if b - a <= SLICE:
            yield lo, 0, a, b, offsets[lo:hi + 1] - a
        else:
            for x in range(a, b - length + 1, SLICE - length + 1):
                y = min(x + SLICE, b)
                yield lo, x - a, x, y, np.array([0, y - x])


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key that equal rows share: hash of the text, and the id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    return docs.select(F.xxhash64(text, doc).alias("k1"), F.xxhash64(doc, F.lit("id"), text).alias("k2"), doc.alias("doc_id"),
                       text.alias("text"), F.struct("*").alias("row"))


def _runs(docs: DataFrame, length: int) -> DataFrame:
    def cut(batches):
        for b in batches:
            data, offs = text_bytes(b.column("text"))
            k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
            for lo, shift, x, y, inner in _slices(offs, length):
                row, start, n, v, sh, anchor, again = window_runs(data[x:y], inner, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[lo + row]), pa.array(k2[lo + row]), pa.array(v.view(np.int64)), pa.array(sh.view(np.int64)),
                     pa.array(start + shift, pa.int32()), pa.array(n, pa.int32()), pa.array(anchor, pa.int32()), pa.array(again)],
                    names=["k1", "k2", "v", "sh", "start", "n", "anchor", "again"])

    return docs.select("k1", "k2", "text").mapInArrow(cut, RUNS)


_FIELDS = ("v", "sh", "start", "n", "anchor", "again", "kinds")


def _segments(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """The runs with their bytes (``seg``)."""
    listed = runs.groupBy("k1", "k2").agg(F.collect_list(F.struct(*_FIELDS)).alias("runs"))

    def take(batches):
        for b in batches:
            col = b.column("text").cast(pa.binary())
            for i in range(0, b.num_rows, 256):
                part, texts = b.slice(i, 256), col.slice(i, 256)
                lists = part.column("runs")
                r = lists.flatten()
                size = np.diff(lists.offsets.to_numpy())
                start, n = (r.field(c).to_numpy() for c in ("start", "n"))
                seg, j = [], 0
                for t, m in zip(texts, size):
                    raw = t.as_py()
                    for _ in range(m):
                        seg.append(raw[start[j]:start[j] + n[j] + length - 1])
                        j += 1
                rep = pa.array(np.repeat(np.arange(part.num_rows), size))
                yield pa.RecordBatch.from_arrays(
                    [part.column("k1").take(rep), part.column("k2").take(rep), *(r.field(c) for c in _FIELDS),
                     pa.array(seg, pa.binary())], names=["k1", "k2", *_FIELDS, "seg"])

    texts = docs.select("k1", "k2", "text").join(listed, ["k1", "k2"])
    return texts.mapInArrow(take, RUNS + ", kinds long, seg binary")


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by at least their first ``depth`` bytes."""
    n = len(t)
    pad = np.concatenate([t, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | pad[k:n + k]
    sa = np.argsort(key, kind="stable")
    head = np.concatenate([[True], key[sa][1:] != key[sa][:-1]])
    h = 8
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while h < depth:
        # only places whose rank is shared are sorted again
        open_ = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(open_):
            break
        s = sa[open_]
        nxt = np.where(s + h < n, rank[np.minimum(s + h, n - 1)] + 1, 0)
        order = np.argsort(rank[s] * (n + 1) + nxt, kind="stable")
        sa[open_] = s = s[order]
        key = (rank[s], nxt[order])
        head[open_[1:]] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])
        head[open_[0]] = True
        rank[s] = np.maximum.accumulate(np.where(head[open_], open_, 0))
        h *= 2
    return sa


def repeated_windows(t: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether the ``length`` bytes from each place of ``t`` start at another
    place too (meaningful where they do not cross a separator)."""
    n = len(t)
    sa = suffix_order(t, length)
    bwt = t[sa - 1]
    order = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)                # backward extension of a place by its own byte
    step[order] = np.arange(n)
    before = np.full(n, -1, np.int64)           # last place with the same byte
    same = bwt[order][1:] == bwt[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    size = np.bincount(bwt, minlength=256)
    first = np.cumsum(size) - size
    occ = {c: order[first[c]:first[c] + size[c]] for c in np.flatnonzero(size)}
    known = np.zeros(n + 1, bool)               # borders found so far
    known[n] = True
    border = first[size > 0]                    # between first bytes: common prefix 0
    known[border] = True
    for _ in range(1, length):
        if not len(border):
            break
        found = []
        k, j = border, border
        for walked in range(NEAR):
            ok = before[j] < k
            to = step[j[ok]]
            found.append(to[~known[to] & (before[j[ok]] >= 0)])
            j = j + 1
            inside = ~known[j]
            k, j = k[inside], j[inside]
            if not len(k):
                break
        for c, places in occ.items() if len(k) else ():     # wide intervals: by rank, for each byte
            i = np.searchsorted(places, k)
            to = first[c] + i[(i > 0) & (i < len(places))]
            found.append(to[~known[to]])
        border = np.unique(np.concatenate(found))
        known[border] = True
    shared = np.flatnonzero(~known[1:n]) + 1
    out = np.zeros(n, bool)
    out[sa[shared]] = True
    out[sa[shared - 1]] = True
    return out


def _pooled(segs: DataFrame, length: int) -> DataFrame:
    """(k1, k2, start, n): repeated windows among pooled runs."""
    def search(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        col = t.column("seg").combine_chunks()
        size = pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.concatenate([[0], np.cumsum(size + 1)])
        text = np.full(cut[-1], 255, np.uint8)      # a byte that UTF-8 never has
        body = np.frombuffer(b"".join(col.to_pylist()), np.uint8)
        inside = np.ones(cut[-1], bool)
        inside[cut[1:] - 1] = False
        text[inside] = body
        hit = repeated_windows(text, length)
        valid = np.zeros(cut[-1] + 1, np.int64)
        n = t.column("n").to_numpy().astype(np.int64)
        np.add.at(valid, cut[:-1], 1)
        np.add.at(valid, cut[:-1] + n, -1)
        hit &= np.cumsum(valid)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        left, right = edge[::2], edge[1::2]
        of = np.searchsorted(cut, left, "right") - 1
        rep = pa.array(of)
        start = t.column("start").to_numpy()[of] + left - cut[of]
        return pa.Table.from_arrays([t.column("k1").take(rep), t.column("k2").take(rep), pa.array(start, pa.int32()),
                                     pa.array(right - left, pa.int32())], names=["k1", "k2", "start", "n"])

    pools = max(1, math.ceil((segs.agg(F.sum(F.length("seg"))).first()[0] or 0) / POOL))
    return segs.groupBy(F.pmod(F.xxhash64("v"), F.lit(pools)).alias("pool")).applyInArrow(search, "k1 long, k2 long, start int, n int")


def _split(segs: DataFrame, grid: int, length: int) -> DataFrame:
    """Parts of crowded runs: windows whose places relative to the anchor fall
    in the same cell of ``grid`` places, keyed by the bytes all windows of the
    cell share. Runs in which the hash repeats have no single anchor and are
    cut into windows."""
    def cut(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                seg, n, a = r["seg"], r["n"], r["anchor"]
                step = 1 if r["again"] else grid
                o = 0
                while o < n:
                    if step == 1:
                        e, core = o + 1, seg[o:o + length]
                    else:
                        cell = (a - o) // step
                        e = min(n, a - cell * step + 1)         # first window of the next cell
                        core = seg[a - cell * step:a - (cell + 1) * step + 1 + length]
                    part = seg[o:e - 1 + length]
                    out.append((r["k1"], r["k2"], _digest(core, r["v"]), _digest(part, 0), r["start"] + o, e - o, a - o, r["again"], part))
                    o = e
            cols = list(zip(*out)) or [()] * 9
            kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["k1", "k2", "v", "sh", "start", "n", "anchor", "again", "seg"])

    return segs.select("k1", "k2", "v", "start", "n", "anchor", "again", "seg").mapInArrow(cut, RUNS + ", seg binary")


def _digest(data: bytes, salt: int) -> int:
    h = hashlib.blake2b(data + salt.to_bytes(8, "little", signed=True), digest_size=8)
    return int.from_bytes(h.digest(), "little", signed=True)


def repeated(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(k1, k2, start, n): n consecutive repeated windows from byte ``start``."""
    runs = stored(_runs(docs, length), "runs")
    often = (runs.groupBy("v").agg(F.count(F.lit(1)).alias("_n"), F.max("again").alias("_again"))
             .filter("_n > 1 or _again").select("v"))
    rows = stored(runs.join(often, "v", "left_semi"), "runs")
    texts, found = None, None                 # first the runs without bytes, then parts with bytes
    for grid in (*GRIDS, 0):
        # one row for each kind of run; copies are repeated in full and stand for nothing more
        equal = stored(rows.groupBy("v", "sh").agg(
            F.count(F.lit(1)).alias("copies"), F.min(F.struct("k1", "k2", "start", "n", "anchor", "again")).alias("one")), "equal")
        kinds = stored(equal.groupBy("v").agg(F.count(F.lit(1)).alias("kinds"), F.max("one.again").alias("any"))
                       .filter("kinds > 1 or any"), "kinds")
        whole = (rows.select("k1", "k2", "v", "sh", "start", "n").join(equal.filter("copies > 1").select("v", "sh"), ["v", "sh"])
                 .select("k1", "k2", "start", "n"))
        ones = equal.join(kinds, "v").select("one.*", "v", "sh", "kinds")
        if texts is None:
            segs = _segments(docs, ones, length)
        else:
            segs = texts.join(ones.select("k1", "k2", "start", "v", "sh", "kinds"), ["k1", "k2", "start", "v", "sh"]).dropDuplicates(["v", "sh"])
        segs = stored(segs, "segments")
        pooled = segs if grid == 0 else segs.filter(F.col("kinds") <= crowd)
        part = stored(whole.unionByName(_pooled(pooled, length)), "repeated")
        found = part if found is None else found.unionByName(part)
        crowded = segs.filter(F.col("kinds") > crowd)
        if grid == 0 or crowded.isEmpty():
            return found
        texts = stored(_split(crowded, grid, length), "parts")
        rows = texts.drop("seg")
    return found


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _removed(docs: DataFrame, length: int, crowd: int, texts: bool, whole: int = 0, words: int = 0) -> DataFrame:
    """RESULT columns of every row; with ``texts`` the row itself (``row``) and
    its remaining bytes (``kept``, cut characters dropped). Spans of fewer than
    ``whole`` bytes stay unless they hold ``words`` words."""
    keyed = _keyed(docs)
    hits = repeated(keyed, length, crowd).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n")).alias("hits"))

    def remove(batches):
        for b in batches:
            col = b.column("text").cast(pa.binary())
            out, rest_texts = [], []
            for raw, hit, doc in zip(col, b.column("hits"), b.column("doc_id")):
                raw, doc = raw.as_py(), doc.as_py()
                spans: list[list[int]] = []
                for s, n in sorted((x["start"], x["n"]) for x in hit.as_py() or ()):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], s + n - 1 + length)
                    else:
                        spans.append([s, s + n - 1 + length])
                spans = [(s, e) for s, e in spans if e - s >= whole or len(_WORD.findall(raw, s, e)) >= words]
                kept, at = [], 0
                for s, e in spans:
                    kept.append(raw[at:s])
                    at = e
                rest = b"".join(kept) + raw[at:]
                out.append((doc, len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()))
                rest_texts.append(rest.decode("utf-8", "ignore"))
            cols = list(zip(*out)) or [()] * 5
            arrays = [pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.string()])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                arrays += [b.column("row"), pa.array(rest_texts, pa.string())]
                names += ["row", "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    carried = ["doc_id", "text", "hits"] + ["row"] * texts
    joined = keyed.join(hits, ["k1", "k2"], "left").select(*carried)
    kind = f", row {dict(keyed.dtypes)['row']}, kept string" if texts else ""
    return joined.mapInArrow(remove, RESULT + kind)


def deduplicate(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    return _removed(docs, length, crowd, False)


def without_repeats(docs: DataFrame, length: int = PASSAGE, whole: int = LENGTH, words: int = WORDS, crowd: int = CROWD) -> DataFrame:
    """``docs`` with the remaining text of every row (null stays null): maximal
    runs of bytes covered by repeated ``length``-byte strings go if they have
    ``whole`` bytes or ``words`` words (cut ones at the ends included), so a
    passage of over 50 words goes though it has fewer than 400 bytes, and a
    shorter common phrase stays. Every ``whole``-byte repeat is in such a run."""
    rows = _removed(docs, length, crowd, True, whole, words)
    return rows.select("row.*", F.when(F.col("row.text").isNotNull(), F.col("kept")).alias("_kept")).select(
        *[F.col("_kept").alias("text") if c == "text" else F.col(c) for c in docs.columns])
