"""Jaccard join of shingle sets with an R-tree over count vectors.

1. ``frequent``: shingles with a hash in the lowest third are counted over all
   documents. Those that occur in two different sets or more are the only ones
   of this zone that can join; the most frequent ``MOST_HOT`` are the hot ones.
2. ``profiles``: every text becomes a set id, its size, a point (its shingles
   hashed into ``GROUPS`` groups, and the count of each group) and its prefix.
   Shingles are ordered cold zone, hot zone, rest, each by hash; two sets with
   a similarity of s or more share a shingle among their first
   n - ceil(s n) + 1. A Bloom filter of the shared shingles (bounded, broadcast)
   leaves out prefix shingles that nobody else has.
3. Equal sets are one vertex. Sets that share a prefix shingle form a list;
   lists with the same members are taken once.
4. ``star_pairs``: members are compared with the least member of their list
   first, which joins most of a group of near copies without listing its pairs.
5. ``tree_pairs``: where a list still has several components, its points are
   indexed in an R-tree, and every member outside the largest component
   searches it. The sum over groups of the smaller coordinate of a point and a
   box's upper corner bounds the overlap with everything in the box; boxes and
   points whose bound is under 4/9 of the two sizes (a similarity of 0.8) are
   left out. Lists are dealt into blocks of ``BLOCK`` points. Points found are
   bounded again by ``Sketches``, whose groups follow the size of the set.
   A first search gives each member's pair of largest bound; once these are
   verified, members that had other pairs search again and give all pairs that
   still lie across components, so a group's links aren't listed as pairs.
6. The pairs of the second search are verified on the whole sets, in rounds: each
   component first tests its pair of largest bound, then 4, 16, ... of those left.
   Pairs that have come into one component need no test; no pair across
   components is left untested. Components of the links are the result.

A tree over all documents isn't built: in 64 dimensions the boxes of unlike
texts overlap, so every document would search every part. The shared prefix
shingles decide, without loss, which documents are in one tree.

Defined cases: null or wordless texts have an empty set and are linked with
nothing; a null id takes part and is never a component's id unless all ids of
it are null; repeated ids and rows are rows of their own; an empty table gives
no rows; extra columns are ignored. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.dedup import connected_components
from .common import NOT_SPACE, block_and_mask, list_array, mix, row_blocks, rows_of, stored, text_bytes, words

SHINGLE = 5
SHARE = (80, 100)           # least intersection of a linked pair, in the union
GROUPS = 64
ZONE = (1 << 64) // 3       # hashes below it are counted
MOST_HOT = 1 << 18
LEAST_HOT = 32
FILTER_BYTES = 16 << 20
FILTER_BITS = 12            # a key, while that fits
GROWTH = 4                  # pairs a component tests in a round, times those of the last round
BLOCK = 2048                # points of a tree
LEAF = 16
CHUNK = 1 << 16             # bounds computed at a time
LEVELS = 6, 14              # a sketch's groups, as powers of two
SKETCH_CHUNK = 1 << 21      # group counts held at a time
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE):
    """Distinct shingle hashes of each row, sorted within the row, and the
    first place of each row."""
    w = words(data, offsets, NOT_SPACE)
    row, many = rows_of(w.first), np.diff(w.first)
    left = w.first[1:][row] - np.arange(len(row))             # words from here to the row's end
    start = np.flatnonzero((left >= size) | ((left == many[row]) & (many[row] < size)))
    length = np.minimum(left[start], size)
    h = np.zeros(len(start), np.uint64)
    for k in range(size):
        on = length > k
        h[on] = h[on] * _GOLD + w.hash[start[on] + k]
    h = mix(h + length.astype(np.uint64))
    row = row[start]
    if 16 * len(offsets) > len(h):
        h = h[np.lexsort((h, row))]
    else:                                                     # rows are few: each by itself
        cuts = np.searchsorted(row, np.arange(len(offsets)))
        for lo, hi in zip(cuts, cuts[1:]):
            h[lo:hi].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, row, np.searchsorted(row, np.arange(len(offsets)))


def set_ids(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit id of each row's set."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ _GOLD))])
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64))


def _text_blocks(batches, size: int):
    for b in batches:
        data, offs = text_bytes(b.column("text"))
        for lo, hi in row_blocks(offs):
            yield b.slice(lo, hi - lo), *shingle_sets(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], size)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def frequent(docs: DataFrame, size: int, zone: int) -> DataFrame:
    """(h, n): shingles of the zone in at least two texts, and in how many (equal
    texts of one block of text count once)."""
    def count(batches):
        for _, h, row, first in _text_blocks(batches, size):
            ids = set_ids(h, first)
            _, one = np.unique(ids, return_index=True)
            keep = np.zeros(len(ids), bool)
            keep[one] = True
            found, n = np.unique(h[keep[row] & (h < np.uint64(zone))], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["h", "n"])

    return _texts(docs).select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")


def key_filter(keys: DataFrame, max_bytes: int) -> np.ndarray:
    """Blocked Bloom filter of a column of 64-bit keys; ``max_bytes`` bounds it."""
    blocks = max(1, min(max_bytes // 8, keys.count() * FILTER_BITS // 64))

    def set_bits(batches):
        for b in batches:
            block, mask = block_and_mask(b.column(0).to_numpy().view(np.uint64), np.array(blocks))
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(mask.view(np.int64))], names=["block", "mask"])

    rows = keys.mapInArrow(set_bits, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(blocks, np.uint64)
    bits[rows.column("block").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return bits


def in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    block, mask = block_and_mask(h, np.array(len(bits)))
    return (bits[block] & mask) == mask


def hot_shingles(shared: DataFrame, most: int) -> np.ndarray:
    """Shingles with the largest counts, ``most`` at most, by a cut between powers of two."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = {r["level"]: r["count"] for r in shared.filter(F.col("n") >= LEAST_HOT).groupBy(level.alias("level")).count().collect()}
    cut, total = None, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        cut = k
    if cut is None:
        return np.empty(0, np.uint64)
    rows = shared.filter((F.col("n") >= LEAST_HOT) & (level >= cut)).select("h").toArrow()
    return np.sort(rows.column("h").to_numpy().view(np.uint64))


def points_of(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Group counts of each row's set, 255 at most."""
    counts = np.bincount(row * GROUPS + (h & np.uint64(GROUPS - 1)).astype(np.int64), minlength=rows * GROUPS)
    return np.minimum(counts, 255).astype(np.uint8).reshape(rows, GROUPS)


def sketches_of(h: np.ndarray, row: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For each row's set, which groups hold a shingle, and which hold two: a
    power of two of groups, twice the set's size or more within ``LEVELS``."""
    level = np.clip(np.ceil(np.log2(np.maximum(2 * n, 1))), *LEVELS).astype(np.int64)
    first = np.cumsum(n) - n
    out: list[bytes] = [b""] * len(n)
    for k in np.unique(level).tolist():
        rows = np.flatnonzero(level == k)
        for lo in range(0, len(rows), SKETCH_CHUNK >> k):
            part = rows[lo:lo + (SKETCH_CHUNK >> k)]
            size = n[part]
            at = np.repeat(first[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            group = ((h[at] >> np.uint64(8)) & np.uint64((1 << k) - 1)).astype(np.int64)
            count = np.bincount((np.repeat(np.arange(len(part)), size) << k) + group, minlength=len(part) << k).reshape(len(part), 1 << k)
            planes = np.packbits(np.stack([count > 0, count > 1], 1), axis=2, bitorder="little")
            for i, x in zip(part.tolist(), planes):
                out[i] = x.tobytes()
    return out


def _fold(planes: np.ndarray) -> np.ndarray:
    """Planes of half as many groups."""
    half = planes.shape[2] // 2
    low, high = planes[:, :, :half], planes[:, :, half:]
    out = low | high
    out[:, 1] |= low[:, 0] & high[:, 0]
    return out


def _ones(planes: np.ndarray) -> np.ndarray:
    return np.bitwise_count(planes).sum((1, 2), dtype=np.int64)


class Sketches:
    """Sketches of sets of ``n`` shingles."""

    def __init__(self, sketches: list[bytes], n: np.ndarray):
        self.n = n
        self.level = np.array([4 * len(x) for x in sketches], np.int64)     # groups, then their power
        self.level = np.round(np.log2(np.maximum(self.level, 1))).astype(np.int64)
        self.place, self.planes = np.empty(len(n), np.int64), {}
        for k in np.unique(self.level).tolist():
            rows = np.flatnonzero(self.level == k)
            self.place[rows] = np.arange(len(rows))
            self.planes[k] = np.frombuffer(b"".join([sketches[i] for i in rows]), "<u8").reshape(len(rows), 2, -1)

    def at(self, rows: np.ndarray, k: int):
        """Planes of 2 ** k groups of the rows, and the shingles they leave out."""
        out = np.empty((len(rows), 2, (1 << k) // 64), np.uint64)
        for level in np.unique(self.level[rows]).tolist():
            mine = self.level[rows] == level
            planes = self.planes[level][self.place[rows[mine]]]
            for _ in range(level - k):
                planes = _fold(planes)
            out[mine] = planes
        return out, self.n[rows] - _ones(out)

    def bound(self, rows: np.ndarray, other: "Sketches", others: np.ndarray) -> np.ndarray:
        """The overlap of pairs of sets, or more."""
        level = np.minimum(self.level[rows], other.level[others])
        out = np.empty(len(rows), np.int64)
        for k in np.unique(level).tolist():
            pairs = np.flatnonzero(level == k)
            for lo in range(0, len(pairs), SKETCH_CHUNK >> k):
                part = pairs[lo:lo + (SKETCH_CHUNK >> k)]
                (a, over_a), (b, over_b) = self.at(rows[part], k), other.at(others[part], k)
                out[part] = _ones(a & b) + np.minimum(over_a, over_b)
        return out


PROFILE = "doc_id long, sid long, tid long, n int, point binary, sketch binary, prefix array<long>"


def profiles(docs: DataFrame, shared, hot, size: int, zone: int) -> DataFrame:
    """PROFILE of every row (broadcast filter of shared shingles, hot shingles)."""
    num, den = SHARE

    def profile(batches):
        bits, hots = shared.value, hot.value
        for b, h, row, first in _text_blocks(batches, size):
            n = np.diff(first)
            low = h < np.uint64(zone)
            at = np.minimum(np.searchsorted(hots, h), max(0, len(hots) - 1))
            is_hot = (hots[at] == h) if len(hots) else np.zeros(len(h), bool)
            zones = 3 * row + np.where(low, is_hot, 2)                # hashes are sorted within a row
            order = np.argsort(zones.astype(np.uint16) if 3 * len(n) < 1 << 16 else zones, kind="stable")
            h2, row2, low2 = h[order], row[order], low[order]
            rank = np.arange(len(h)) - first[row2]
            take = rank < (n - -(-num * n // den) + 1)[row2]
            take &= ~low2 | in_filter(bits, h2)
            cut = np.concatenate([[0], np.cumsum(np.bincount(row2[take], minlength=len(n)))])
            point = pa.FixedSizeBinaryArray.from_buffers(pa.binary(GROUPS), len(n), [None, pa.py_buffer(points_of(h, row, len(n)).tobytes())])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(set_ids(h, first).view(np.int64)), b.column("tid"), pa.array(n, pa.int32()), point.cast(pa.binary()),
                 pa.array(sketches_of(h, row, n), pa.binary()), list_array(h2[take].view(np.int64), cut, pa.int64())],
                names=["doc_id", "sid", "tid", "n", "point", "sketch", "prefix"])

    return _texts(docs).withColumn("tid", F.xxhash64("text")).mapInArrow(profile, PROFILE)


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int, max_bytes: int) -> DataFrame:
    """(sid, set) of the wanted sets, each by the hash of one of its texts
    (``tid``); other texts are left out before they are taken apart."""
    shared = docs.sparkSession.sparkContext.broadcast(key_filter(wanted.select("tid"), max_bytes))

    def pick(batches):
        few = (b.filter(pa.array(in_filter(shared.value, b.column("tid").to_numpy().view(np.uint64)))) for b in batches)
        for _, h, row, first in _text_blocks(few, size):
            ids = set_ids(h, first)
            keep = np.diff(first) > 0
            _, one = np.unique(ids, return_index=True)
            rows = one[keep[one]]
            cut = np.concatenate([[0], np.cumsum(np.diff(first)[rows])])
            at = np.repeat(first[rows] - cut[:-1], np.diff(cut)) + np.arange(cut[-1])
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows].view(np.int64)), list_array(h[at].view(np.int64), cut, pa.int64())], names=["sid", "set"])

    found = _texts(docs).select("text", F.xxhash64("text").alias("tid")).mapInArrow(pick, "sid long, set array<long>")
    return found.join(wanted.select("sid"), "sid", "left_semi").dropDuplicates(["sid"])


def may_link(bound, na, nb):
    """Whether an overlap of ``bound`` is enough for two sets of these sizes."""
    num, den = SHARE
    return bound * (num + den) >= num * (na + nb)


class Tree:
    """R-tree of count vectors: boxes by upper corner, least and largest size."""

    def __init__(self, points: np.ndarray, n: np.ndarray):
        self.excess = n - points.sum(1, dtype=np.int64)         # what counts over 255 leave out
        self.order = self._tiles(points, n, np.argsort(n, kind="stable"))
        self.points, self.n, self.excess = points[self.order], n[self.order], self.excess[self.order]
        self.levels = []
        upper, least, most, over = self.points, self.n, self.n, self.excess
        while len(upper) > LEAF:
            cut = np.arange(0, len(upper), LEAF)
            upper, least = np.maximum.reduceat(upper, cut), np.minimum.reduceat(least, cut)
            most, over = np.maximum.reduceat(most, cut), np.maximum.reduceat(over, cut)
            self.levels.append((upper, least, most, over))

    def _tiles(self, points, n, rows):
        """Rows split at the middle of their widest coordinate, down to leaves."""
        if len(rows) <= LEAF:
            return rows
        part = points[rows]
        width = part.max(0).astype(np.int64) - part.min(0)
        axis = int(width.argmax())
        size = n[rows]
        key = size if size.max() * 0.8 > size.min() else part[:, axis]
        rows = rows[np.argsort(key, kind="stable")]
        half = -(-len(rows) // (2 * LEAF)) * LEAF
        return np.concatenate([self._tiles(points, n, rows[:half]), self._tiles(points, n, rows[half:])])

    def search(self, points: np.ndarray, n: np.ndarray):
        """(query, row) of all pairs whose bound allows a link."""
        num, den = SHARE
        excess = n - points.sum(1, dtype=np.int64)
        levels = [*self.levels[::-1], (self.points, self.n, self.n, self.excess)]
        top = len(levels[0][0])
        q, node = np.repeat(np.arange(len(n)), top), np.tile(np.arange(top), len(n))
        for depth, (upper, least, most, over) in enumerate(levels):
            ok = np.zeros(len(q), bool)
            for lo in range(0, len(q), CHUNK):
                a, b = q[lo:lo + CHUNK], node[lo:lo + CHUNK]
                bound = np.minimum(points[a], upper[b]).sum(1, dtype=np.int64) + np.minimum(excess[a], over[b])
                smallest = np.maximum(least[b], -(-num * n[a] // den))
                ok[lo:lo + CHUNK] = may_link(bound, n[a], smallest) & (most[b] * den >= num * n[a]) & (least[b] * num <= den * n[a])
            q, node = q[ok], node[ok]
            if depth + 1 < len(levels):
                below = len(levels[depth + 1][0])
                size = np.minimum(below - node * LEAF, LEAF)
                node = np.repeat(node * LEAF - (np.cumsum(size) - size), size) + np.arange(size.sum())
                q = np.repeat(q, size)
        return q, self.order[node]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, GROUPS)


def _search_lists(left: pa.Table, right: pa.Table, best: bool) -> pa.Table:
    """Surviving pairs between the members of each list's block (``left``) and
    the members that ask (``right``). ``best``: the first of each asking member
    (h, sid), by bound, and whether it has more."""
    got: list[list] = [[], [], [], [], [], []]
    if left.num_rows and right.num_rows:
        left, right = left.sort_by("h"), right.sort_by("h")
        cols = [{c: t.column(c).to_numpy() for c in ("h", "sid", "comp")} | {"n": t.column("n").to_numpy().astype(np.int64), "point": _matrix(t.column("point"))}
                for t in (left, right)]
        a, b = cols
        sa, sb = (Sketches(t.column("sketch").to_pylist(), c["n"]) for t, c in zip((left, right), cols))
        keys, lo = np.unique(b["h"], return_index=True)
        hi = np.append(lo[1:], len(b["h"]))
        from_, to = np.searchsorted(a["h"], keys, "left"), np.searchsorted(a["h"], keys, "right")
        for key, i, j, x, y in zip(keys, lo, hi, from_, to):
            if x < y:
                q, row = Tree(a["point"][x:y], a["n"][x:y]).search(b["point"][i:j], b["n"][i:j])
                q, row = q + i, row + x
                ok = b["comp"][q] != a["comp"][row]
                q, row = q[ok], row[ok]
                bound, both = sb.bound(q, sa, row), b["n"][q] + a["n"][row]
                ok = may_link(bound, b["n"][q], a["n"][row])
                q, row, share = q[ok], row[ok], bound[ok] / both[ok]
                more = np.zeros(len(q), bool)
                if best:
                    order = np.lexsort((a["sid"][row], -share, q))
                    one, many = np.unique(q[order], return_index=True, return_counts=True)[1:]
                    q, row, share, more = q[order][one], row[order][one], share[order][one], many > 1
                s, d = b["sid"][q], a["sid"][row]
                for x_, v in zip(got, (np.minimum(s, d), np.maximum(s, d), share, np.full(len(q), key), s, more)):
                    x_.append(v)
    kinds = [np.int64, np.int64, np.float64, np.int64, np.int64, bool]
    src, dst, *rest = (np.concatenate([*x, np.empty(0, k)]).astype(k) for x, k in zip(got, kinds))
    if not best:                        # a pair may stand in many lists
        order = np.lexsort((dst, src))
        order = order[(np.diff(src[order], prepend=src[order][:1] - 1) != 0) | (np.diff(dst[order], prepend=dst[order][:1] - 1) != 0)]
        src, dst, rest = src[order], dst[order], [x[order] for x in rest]
    return pa.Table.from_arrays([pa.array(x) for x in (src, dst, *rest)], names=["src", "dst", "share", "h", "sid", "more"])


def _open_lists(members: DataFrame, asked: DataFrame | None, block: int) -> DataFrame:
    """Members (with ``comp``) of the lists to search, whether they ask, and the
    list's numbers of blocks. Those asked for (h, sid) ask, or else the members
    outside the largest component of a list of several."""
    blocks = [F.ceil(F.col("all") / block).alias("m_blocks"), F.ceil(F.col("ask") / block).alias("q_blocks")]
    if asked is not None:
        lists = members.groupBy("h").agg(F.count(F.lit(1)).alias("all")).join(asked.groupBy("h").agg(F.count(F.lit(1)).alias("ask")), "h")
        ask = asked.withColumn("asks", F.lit(True))
        return members.join(lists.select("h", *blocks), "h").join(ask, ["h", "sid"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    sizes = members.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("k"))
    lists = (sizes.groupBy("h").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.sum("k").alias("all"), (F.sum("k") - F.max("k")).alias("ask"),
                                    F.count(F.lit(1)).alias("parts")).filter("parts > 1"))
    return members.join(lists.select("h", "main", *blocks), "h").withColumn("asks", F.col("comp") != F.col("main"))


def star_pairs(members: DataFrame) -> DataFrame:
    """Pairs of each list's members with its least member."""
    hubs = members.groupBy("h").agg(F.min("sid").alias("src"))
    return members.select("h", F.col("sid").alias("dst")).join(hubs, "h").filter("src <> dst").select("src", "dst").distinct()


FOUND = "src long, dst long, share double, h long, sid long, more boolean"


def tree_pairs(members: DataFrame, points: DataFrame, block: int, asked: DataFrame | None = None) -> DataFrame:
    """FOUND of pairs of one list and different components that the tree and
    the sketches can't rule out: all pairs of the members asked for, or else of
    every member outside a list's largest component the one of largest bound,
    and whether it has more."""
    opened = stored(_open_lists(members, asked, block), "lists")
    pools = max(1, math.ceil(opened.count() / block))
    # lists of one block are dealt together into pools; a larger list's blocks are groups of their own
    alone = (F.col("m_blocks") > 1) | (F.col("q_blocks") > 1)
    pool = F.when(alone, F.col("h")).otherwise(F.pmod(F.xxhash64("h"), F.lit(pools))).alias("pool")
    full = opened.join(points, "sid")
    cols = [F.col(c).alias(c) for c in ("h", "sid", "n", "comp", "point", "sketch")]
    one = F.lit(1).cast("long")
    mine = lambda blocks, name: (F.pmod(F.xxhash64("sid"), F.col(blocks)) + 1).alias(name)
    every = lambda blocks, name: F.explode(F.sequence(one, F.col(blocks))).alias(name)
    left = full.select(pool, alone.alias("alone"), mine("m_blocks", "mb"), every("q_blocks", "qb"), *cols)
    right = full.filter("asks").select(pool, alone.alias("alone"), every("m_blocks", "mb"), mine("q_blocks", "qb"), *cols)
    keys = ["pool", "alone", "mb", "qb"]
    best = asked is None
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _search_lists(a, b, best), FOUND)


def bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """(src, dst, share): pairs whose sizes and summed coordinate minima allow
    a link; ``share``: the bound in the two sizes."""
    def check(batches):
        num, den = SHARE
        for b in batches:
            pa_, pb = _matrix(b.column("pa")), _matrix(b.column("pb"))
            na, nb = (b.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            bound = np.minimum(pa_, pb).sum(1, dtype=np.int64) + np.minimum(na - pa_.sum(1, dtype=np.int64), nb - pb.sum(1, dtype=np.int64))
            close = np.flatnonzero(may_link(bound, na, nb) & (np.minimum(na, nb) * den >= num * np.maximum(na, nb)))
            sa, sb = (Sketches(b.column(c).take(pa.array(close)).to_pylist(), n[close]) for c, n in (("ka", na), ("kb", nb)))
            at = np.arange(len(close))
            bound[close] = np.minimum(bound[close], sa.bound(at, sb, at))
            ok = may_link(bound, na, nb) & (np.minimum(na, nb) * den >= num * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([b.column("src"), b.column("dst"), pa.array(bound / (na + nb))], names=["src", "dst", "share"]).filter(pa.array(ok))

    a = points.select(F.col("sid").alias("src"), F.col("n").alias("na"), F.col("point").alias("pa"), F.col("sketch").alias("ka"))
    b = points.select(F.col("sid").alias("dst"), F.col("n").alias("nb"), F.col("point").alias("pb"), F.col("sketch").alias("kb"))
    return pairs.join(a, "src").join(b, "dst").mapInArrow(check, "src long, dst long, share double")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose whole sets are similar enough. Sets in no pair are left out
    by a filter before anything is shuffled."""
    num, den = SHARE
    ids = pairs.select(F.explode(F.array("src", "dst")).alias("sid")).distinct()
    wanted = pairs.sparkSession.sparkContext.broadcast(key_filter(ids, FILTER_BYTES))

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(in_filter(wanted.value, b.column("sid").to_numpy().view(np.uint64))))

    few = sets.select("sid", "set").mapInArrow(keep, "sid long, set array<long>")
    both = F.size(F.array_intersect("a", "b"))
    full = (pairs.join(few.select(F.col("sid").alias("src"), F.col("set").alias("a")), "src")
            .join(few.select(F.col("sid").alias("dst"), F.col("set").alias("b")), "dst"))
    return full.filter(both * (num + den) >= num * (F.size("a") + F.size("b"))).select("src", "dst")


def _own_sets(docs: DataFrame, pairs: DataFrame, points: DataFrame, size: int, filter_bytes: int) -> DataFrame:
    """Stored sets of the texts in a surviving pair."""
    wanted = pairs.select(F.explode(F.array("src", "dst")).alias("sid")).distinct().join(points.select("sid", "tid"), "sid")
    return stored(whole_sets(docs, stored(wanted, "wanted"), size, filter_bytes), "sets")


def _picked(open_: DataFrame, k: int) -> DataFrame:
    """The ``k`` open pairs of largest bound of each component."""
    order = [F.col("share").desc(), F.col("src"), F.col("dst")]
    parts = [open_.withColumn("_r", F.row_number().over(Window.partitionBy(side).orderBy(*order))).filter(F.col("_r") <= k)
             .select("src", "dst") for side in ("cs", "cd")]
    return parts[0].unionByName(parts[1]).distinct()


def _placed_pairs(pairs: DataFrame, at: DataFrame) -> DataFrame:
    """Pairs across components, with both components."""
    return (pairs.join(at.select(F.col("sid").alias("src"), F.col("comp").alias("cs")), "src")
            .join(at.select(F.col("sid").alias("dst"), F.col("comp").alias("cd")), "dst").filter("cs <> cd"))


def components(docs: DataFrame, size: int = SHINGLE, zone: int = ZONE, most_hot: int = MOST_HOT,
               filter_bytes: int = FILTER_BYTES, block: int = BLOCK, star: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    context = docs.sparkSession.sparkContext
    shared = stored(frequent(docs, size, zone), "shared")
    bits, hot = context.broadcast(key_filter(shared.select("h"), filter_bytes)), context.broadcast(hot_shingles(shared, most_hot))
    rows = stored(profiles(docs, bits, hot, size, zone), "profiles")
    points = rows.filter("n > 0").dropDuplicates(["sid"]).select("sid", "tid", "n", "point", "sketch", "prefix")
    entries = points.select(F.explode("prefix").alias("h"), "sid")
    marks = [F.count(F.lit(1)).alias("k"), F.min("sid").alias("low"), F.max("sid").alias("high"),
             F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y")]
    lists = entries.groupBy("h").agg(*marks).filter("k > 1").groupBy("k", "low", "high", "x", "y").agg(F.min("h").alias("h")).select("h")
    members = stored(entries.join(lists, "h"), "members")
    nodes = stored(members.select("sid").distinct(), "nodes")
    points = stored(points.select("sid", "tid", "n", "point", "sketch").join(nodes, "sid"), "points")
    vertices = nodes.withColumnRenamed("sid", "id")
    edges, at = None, vertices.select(F.col("id").alias("sid"), F.col("id").alias("comp"))

    def linked(more: DataFrame):
        found = more if edges is None else edges.unionByName(more)
        return found, stored(connected_components(vertices, found).select(F.col("id").alias("sid"), F.col("component").alias("comp")), "components")

    asked = None
    for step in (["star"] if star else []) + ["best", "tree"]:
        if step == "star":
            pairs = stored(bounded(star_pairs(members), points), "pairs")
        else:
            found = stored(tree_pairs(members.join(at, "sid"), points, block, asked), "found")
            pairs = found.select("src", "dst", "share").distinct()
            asked = found.filter("more").select("h", "sid").distinct()
        open_ = stored(_placed_pairs(pairs, at), "open")
        if open_.isEmpty():
            continue
        sets, k = _own_sets(docs, open_, points, size, filter_bytes), 1
        while not open_.isEmpty():
            picks = stored(_picked(open_, k) if step == "tree" else open_.select("src", "dst"), "picks")
            more = stored(verified(picks, sets), "links")
            if not more.isEmpty():
                edges, at = linked(more)
            if step != "tree":
                break
            left = open_.select("src", "dst", "share").join(picks, ["src", "dst"], "left_anti")
            open_, k = stored(_placed_pairs(left, at), "open"), k * GROWTH
    least = rows.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("low")).join(at, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    named = least.join(least.groupBy("comp").agg(F.min("low").alias("component_id")), "comp").select("sid", "component_id")
    return rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid")).join(named, "sid", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
