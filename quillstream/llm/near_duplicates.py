"""Near duplicates by BagMinHash signatures of word shingle multisets.

A text's shingles are its runs of ``SHINGLE`` lower-cased words (letters and
digits), counted; a shorter text is one shingle. The signature is the minimum,
in each of ``BANDS * ROWS`` slots, of Poisson processes over the weights: a
shingle of count c owns the levels 0 .. c - 1, levels 0, 1, 2-3, 4-7, ... are
one process each (its rate the number of levels), and each point falls on a
slot and on a level, so a smaller count keeps the points of a larger one that
lie below it. The share of equal slots is an unbiased estimate of the weighted
Jaccard similarity, sum of minima over sum of maxima. Points are drawn in
rising order up to a horizon at which all slots are filled, so a long text
draws about one point for each shingle.

Texts with equal multisets are one vertex. Bands of ``ROWS`` slots bucket the
vertices. In each bucket every member is verified, exactly, against two hubs
(linear in the bucket): the member that shares most buckets with others, which
for the copies of one text is that text, and the least one. Then each member
outside the hub's component is compared with the bucket's members of other
components, so that no link of the bands is lost. This works on blocks of
``BLOCK`` members inside tasks, a pair only in the first band it shares, and
gives out links alone: no table of pairs is made. At a similarity of 0.8 a pair
shares a band with probability 0.99995.

Defined cases: null, empty and wordless texts, and rows without an id, have no
class (null); repeated ids take the class of each row's own text; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.dedup import connected_components
from .common import ALNUM, list_array, mix, row_blocks, rows_of, stored, text_bytes, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 25
ROWS = 5
BLOCK = 500
_GOLD = 0x9E3779B97F4A7C15


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE):
    """Distinct shingles of each row of a block: (row, hash, count), by row."""
    w = words(data, offsets, ALNUM)
    n = np.diff(w.first)
    rows = len(n)
    if not len(w.hash):
        z = np.empty(0, np.int64)
        return z, np.empty(0, np.uint64), z
    # first word of each shingle; a short row has one that ends with the row
    of = rows_of(w.first)
    place = np.arange(len(w.hash)) - w.first[of]
    first = np.flatnonzero((place + size <= n[of]) | (place == 0))
    row = of[first]
    h = np.zeros(len(first), np.uint64)
    for k in range(size):
        at = first + k
        inside = place[first] + k < n[row]
        word = w.hash[np.minimum(at, len(w.hash) - 1)]
        h = np.where(inside, h * np.uint64(_GOLD) + word, h)
    h = mix(h + np.minimum(n[row], size).astype(np.uint64))
    key = h ^ mix(row.astype(np.uint64) + np.uint64(_GOLD))
    _, at, count = np.unique(key, return_index=True, return_counts=True)
    order = np.lexsort((h[at], row[at])) if rows > 1 else np.argsort(h[at], kind="stable")
    return row[at][order], h[at][order], count[order]


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def bag_minhash(row: np.ndarray, h: np.ndarray, count: np.ndarray, rows: int, slots: int) -> np.ndarray:
    """(rows, slots) signature of each row's multiset; rows without a shingle hold inf."""
    out = np.full(rows * slots, np.inf)
    weight = np.bincount(row, count, rows)
    horizon = slots * (math.log(slots) + 3) / np.maximum(weight, 1)
    todo = np.arange(rows)[weight > 0]
    # processes: level 0, and levels 2^(j-1) .. 2^j - 1 for each j needed
    top = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))), 0).astype(np.int64)
    while len(todo):
        mine = np.isin(row, todo) if len(todo) < rows else np.ones(len(row), bool)
        out.reshape(rows, slots)[todo] = np.inf
        for j in range(int(top[mine].max()) + 1):
            at = np.flatnonzero(mine & (top >= j))
            width = 1 << max(0, j - 1)
            low = 0 if j == 0 else width
            seed = mix(h[at] + np.uint64(j * 0x632BE59BD9B4E019 & (1 << 64) - 1))
            r, c, limit = row[at], count[at], horizon[row[at]]
            x, draw = np.zeros(len(at)), 0
            while len(seed):
                draw += 1
                point = mix(seed + np.uint64(draw * _GOLD & (1 << 64) - 1))
                x = x - np.log(_uniform(point)) / width
                alive = x <= limit
                seed, r, c, limit, x, point = seed[alive], r[alive], c[alive], limit[alive], x[alive], point[alive]
                where = mix(point ^ np.uint64(0xD1B54A32D192ED03))
                slot = (where >> np.uint64(32)).astype(np.int64) % slots
                level = low + (where & np.uint64(0xFFFFFFFF)).astype(np.int64) % width
                ok = level < c
                np.minimum.at(out, r[ok] * slots + slot[ok], x[ok])
        unfilled = ~np.isfinite(out.reshape(rows, slots)[todo]).all(1)
        todo = todo[unfilled]
        horizon[todo] *= 2
    return out.reshape(rows, slots)


def fingerprints(row: np.ndarray, h: np.ndarray, count: np.ndarray, rows: int) -> list[bytes | None]:
    """128 bits of each row's multiset, independent of its order (null without shingles)."""
    mark = np.zeros((rows, 2), np.uint64)
    for k in range(2):
        np.add.at(mark[:, k], row, mix(mix(h + np.uint64(k + 1)) + count.astype(np.uint64)))
    have = np.bincount(row, minlength=rows) > 0
    return [m.tobytes() if ok else None for m, ok in zip(mark, have)]


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, vertex, bands): each text's multiset fingerprint (null
    without words) and one hash for each band of its signature."""
    def sign(batches):
        for b in batches:
            data, offs = text_bytes(b.column("text"))
            for lo, hi in row_blocks(offs):
                n = hi - lo
                row, h, c = shingles(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], size)
                sig = bag_minhash(row, h, c, n, bands * rows)
                parts = mix(sig.view(np.uint64)).reshape(n, bands, rows)
                band = np.zeros((n, bands), np.uint64)
                for k in range(rows):
                    band = mix(band * np.uint64(_GOLD) + parts[:, :, k])
                band = mix(band + np.arange(bands, dtype=np.uint64))
                vertex = fingerprints(row, h, c, n)
                have = np.array([v is not None for v in vertex])
                cut = np.concatenate([[0], np.cumsum(np.where(have, bands, 0))])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, n), b.column("text_hash").slice(lo, n), pa.array(vertex, pa.binary()),
                     list_array(band[have].reshape(-1).view(np.int64), cut, pa.int64())], names=["doc_id", "text_hash", "vertex", "bands"])

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows_.mapInArrow(sign, "doc_id long, text_hash long, vertex binary, bands array<long>")


def bags(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(vertex, hashes, counts) of the rows whose text makes their vertex (an
    id's repeated rows may bring other texts)."""
    def count(batches):
        for b in batches:
            data, offs = text_bytes(b.column("text"))
            for lo, hi in row_blocks(offs):
                row, h, c = shingles(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], size)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                own = pa.array([x == y for x, y in zip(fingerprints(row, h, c, hi - lo), b.column("vertex").slice(lo, hi - lo).to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [b.column("vertex").slice(lo, hi - lo), list_array(h.view(np.int64), cut, pa.int64()), list_array(c, cut, pa.int32())],
                    names=["vertex", "hashes", "counts"]).filter(own)

    return docs.select("vertex", "text").mapInArrow(count, "vertex binary, hashes array<long>, counts array<int>")


def overlap(ah: np.ndarray, ac: np.ndarray, bh: np.ndarray, bc: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets with sorted hashes."""
    common, i, j = np.intersect1d(ah, bh, assume_unique=True, return_indices=True)
    low = np.minimum(ac[i], bc[j]).sum()
    return low / (ac.sum() + bc.sum() - low)


def verified(pairs: DataFrame, bag: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) whose multisets are similar enough."""
    def check(batches):
        for b in batches:
            cols = []
            for name in ("h1", "c1", "h2", "c2"):
                col = b.column(name)
                cols.append((col.flatten().to_numpy(zero_copy_only=False), col.offsets.to_numpy() - col.offsets[0].as_py()))
            ok = []
            for i in range(b.num_rows):
                h1, c1, h2, c2 = (v[o[i]:o[i + 1]] for v, o in cols)
                ok.append(overlap(h1.view(np.uint64), c1, h2.view(np.uint64), c2) >= similarity - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column("src"), b.column("dst"), pa.array(ok, pa.bool_())], names=["src", "dst", "ok"])

    a = bag.select(F.col("vertex").alias("src"), F.col("hashes").alias("h1"), F.col("counts").alias("c1"))
    b = bag.select(F.col("vertex").alias("dst"), F.col("hashes").alias("h2"), F.col("counts").alias("c2"))
    return (pairs.join(a, "src").join(b, "dst").select("src", "dst", "h1", "c1", "h2", "c2")
            .mapInArrow(check, "src binary, dst binary, ok boolean").filter("ok").select("src", "dst"))


def remaining_links(shared: DataFrame, components: DataFrame, vertices: DataFrame, bag: DataFrame,
                    similarity: float, block: int = BLOCK) -> DataFrame:
    """Links (src, dst) between members of a bucket that are in different
    components, one of them not in the component of the bucket's hub."""
    at = components.withColumnRenamed("id", "vertex")
    hub_at = components.select(F.col("id").alias("hub"), F.col("component").alias("_hub_component"))
    placed = (shared.join(at, "vertex").join(hub_at, "hub")
              .select("band", "bucket", "vertex", "n", "component", (F.col("component") != F.col("_hub_component")).alias("outside")))
    mixed = placed.filter("outside").groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n_outside"))
    placed = stored(placed.join(mixed, ["band", "bucket"]), "placed")
    pools = max(1, math.ceil(placed.count() / (2 * block)))
    pool = F.pmod(F.xxhash64("band", "bucket"), F.lit(pools)).alias("pool")
    full = (placed.join(bag, "vertex").join(vertices.select("vertex", "bands"), "vertex")
            .withColumn("_m", F.ceil(F.col("n") / block)).withColumn("_o", F.ceil(F.col("n_outside") / block)))
    cols = [F.col(c).alias(c) for c in ("band", "bucket", "vertex", "component", "outside", "hashes", "counts", "bands")]
    one = F.lit(1).cast("long")
    left = full.select(pool, (F.pmod(F.xxhash64("vertex"), "_m") + 1).alias("mb"), F.explode(F.sequence(one, "_o")).alias("ob"), *cols)
    right = full.filter("outside").select(pool, F.explode(F.sequence(one, "_m")).alias("mb"),
                                          (F.pmod(F.xxhash64("vertex"), "_o") + 1).alias("ob"), *cols)

    def columns(t: pa.Table):
        t = t.combine_chunks()
        lists = {c: t.column(c).combine_chunks() if t.num_rows else None for c in ("hashes", "counts", "bands")}
        order = np.lexsort((t.column("bucket").to_numpy(), t.column("band").to_numpy()))
        flat = {c: v.flatten().to_numpy(zero_copy_only=False) for c, v in lists.items()}
        cut = lists["hashes"].offsets.to_numpy() - lists["hashes"].offsets[0].as_py()
        key = np.stack([t.column("band").to_numpy(), t.column("bucket").to_numpy()], 1)
        return {"key": key, "order": order, "vertex": t.column("vertex").to_pylist(), "component": t.column("component").to_pylist(),
                "outside": t.column("outside").to_numpy(), "bands": flat["bands"].reshape(t.num_rows, -1), "cut": cut,
                "h": flat["hashes"].view(np.uint64), "c": flat["counts"], "w": np.add.reduceat(flat["counts"], cut[:-1])}

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        src, dst = [], []
        if left.num_rows and right.num_rows:
            a, b = columns(left), columns(right)
            rows = {}
            for i in a["order"]:
                rows.setdefault(tuple(a["key"][i]), []).append(i)
            held, entries = None, None
            for j in b["order"]:
                key = tuple(b["key"][j])
                if key != held:
                    held, mine = key, np.array(rows.get(key, []), np.int64)
                    parts = [slice(a["cut"][i], a["cut"][i + 1]) for i in mine]
                    if parts:
                        h = np.concatenate([a["h"][p] for p in parts])
                        order = np.argsort(h, kind="stable")
                        entries = (h[order], np.repeat(np.arange(len(mine)), a["cut"][mine + 1] - a["cut"][mine])[order],
                                   np.concatenate([a["c"][p] for p in parts])[order])
                if not len(mine):
                    continue
                v, comp, w = b["vertex"][j], b["component"][j], b["w"][j]
                ok = np.array([a["component"][i] != comp and not (a["outside"][i] and a["vertex"][i] > v) for i in mine])
                ok &= np.minimum(a["w"][mine], w) >= similarity * np.maximum(a["w"][mine], w) - 1e-9
                ok &= ~(a["bands"][mine, :key[0]] == b["bands"][j, :key[0]]).any(1)         # compared in an earlier band
                if not ok.any():
                    continue
                hj, cj = (b[c][b["cut"][j]:b["cut"][j + 1]] for c in "hc")
                lo, hi = np.searchsorted(entries[0], hj, "left"), np.searchsorted(entries[0], hj, "right")
                n = hi - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                low = np.bincount(entries[1][at], np.minimum(entries[2][at], np.repeat(cj, n)), len(mine))
                ok &= low >= (similarity - 1e-12) * (a["w"][mine] + w - low)
                src += [a["vertex"][i] for i in mine[ok]]
                dst += [v] * int(ok.sum())
        return pa.Table.from_arrays([pa.array(src, pa.binary()), pa.array(dst, pa.binary())], names=["src", "dst"])

    keys = ["pool", "mb", "ob"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "src binary, dst binary")


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE,
                           bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, class_id) of every row: the least id of its group."""
    signed = stored(signatures(docs, bands, rows, size), "signatures")
    # one row for each distinct multiset, whatever the number of copies
    vertices = (signed.filter("vertex is not null and doc_id is not null").groupBy("vertex")
                .agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")))
    vertices = stored(vertices, "vertices")
    members = vertices.select("vertex", F.posexplode("bands").alias("band", "bucket"))
    sizes = members.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(members.join(sizes, ["band", "bucket"]), "buckets")          # only buckets of several vertices
    rank = shared.groupBy("vertex").agg(F.sum("n").alias("rank"))
    hubs = (shared.join(rank, "vertex").groupBy("band", "bucket")
            .agg(F.max_by("vertex", F.struct("rank", "vertex")).alias("hub"), F.min("vertex").alias("low")))
    shared = stored(shared.join(hubs, ["band", "bucket"]), "buckets")
    stars = (shared.select(F.col("vertex").alias("src"), F.explode(F.array_distinct(F.array("hub", "low"))).alias("dst"))
             .filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    wanted = shared.select("vertex").distinct().join(vertices.select("vertex", "doc_id"), "vertex")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bag = stored(bags(texts.join(wanted, "doc_id"), size).dropDuplicates(["vertex"]), "bags")
    edges = stored(verified(stars, bag, similarity), "links")
    nodes = shared.select(F.col("vertex").alias("id")).distinct()
    first = stored(connected_components(nodes, edges), "components")
    more = stored(remaining_links(shared, first, vertices, bag, similarity), "links")
    classes = first if more.isEmpty() else connected_components(nodes, edges.unionByName(more))
    whole = (vertices.select("vertex", "doc_id").join(classes.withColumnRenamed("id", "vertex"), "vertex", "left")
             .select("vertex", "doc_id", F.coalesce("component", "vertex").alias("component")))
    least = whole.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    named = whole.join(least, "component").select("vertex", "class_id")
    return (signed.join(named, "vertex", "left")
            .select("doc_id", "text_hash", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id")))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group, the one with the least id (of its
    repeated rows the first by text hash); rows without a class stay."""
    classes = stored(near_duplicate_classes(docs, **options).filter("class_id is not null").distinct(), "classes")
    least = classes.filter("class_id = doc_id").groupBy("doc_id").agg(F.min("text_hash").alias("_first"))
    marks = classes.join(least, "doc_id", "left").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"),
        F.coalesce((F.col("class_id") == F.col("doc_id")) & (F.col("_first") == F.col("text_hash")), F.lit(False)).alias("_kept"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), F.struct("*").alias("_doc"))
    nth = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy("_hash"))
    rows = rows.join(marks, ["_id", "_hash"], "left").withColumn("_nth", nth)
    return rows.filter("_kept is null or (_kept and _nth = 1)").select("_doc.*")
