"""Nearest neighbours by adaptive dimension scan over inverted lists.

Fitting takes a bounded sample (``SAMPLE`` ids, ``SAMPLE_BYTES`` at most, drawn by a
hash of the id, the least vector of each): k-means centroids of the lists, and the number of lists to
probe, raised until the sample's own neighbours are found with ``RECALL``. Every
row is then put in the list of its nearest centroid. Vectors are rotated by a
random orthogonal matrix and compared in blocks of ``COLUMNS`` rotated columns:
after each block a candidate whose partial distance, scaled up to all columns,
exceeds the best known k-th distance by more than the sampling error allows
(a hypothesis test with ``EPSILON`` deviations) is abandoned. What is left is
measured on the original vectors in double precision.

A query's first bound is its k-th distance within the sample, where each id
stands once, so k different ids lie within it. Large lists are
split by a hash of the id into blocks of about ``ROWS`` vectors, many queries of
a list into blocks of about ``QUERIES``; a task takes one block of each, so a
list that holds most of the table still spreads. Only list sizes and the model
reach the driver.

Defined cases: vectors that are null, zero, hold null or non-finite components
or differ in length from the most frequent length (of equally frequent ones
the longer), and rows without an id, take no part; of a query id's repeated
rows the least vector asks; candidates that repeat an id count once, at their
least distance; ties go to the smaller id; fewer candidates than k are all
returned; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import received, send, stored

SAMPLE = 16_384
SAMPLE_BYTES = 32 << 20
MAX_LISTS = 4096
RECALL = 0.99
EPSILON = 2.1
COLUMNS = 16
ROWS = 8192
QUERIES = 1024


@dataclass
class Index:
    centroids: np.ndarray
    rotation: np.ndarray
    probes: int
    sample_ids: np.ndarray
    sample: np.ndarray


def usable(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that take part."""
    kind = table.schema[vec_col].dataType.elementType
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"),
                        (F.col(vec_col) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(vec_col).cast("array<double>")).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("vec") == (sizes[0] if sizes else 0))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances between two bounded sets."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def fit(vectors: DataFrame, k: int, n: int, n_ids: int, sample: int = SAMPLE, seed: int = 11, rounds: int = 8) -> Index | None:
    """Centroids, rotation and number of probes from a bounded sample of one row an id."""
    first = vectors.first()
    if first is None:
        return None
    d = len(first.vec)
    size = min(sample, max(1, SAMPLE_BYTES // (8 * d)))
    share = min(1.0, size / n_ids)
    drawn = vectors.filter(F.pmod(F.xxhash64(F.col("vec_id"), F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30))
    drawn = drawn.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    got = drawn.limit(2 * size).toPandas().sort_values("vec_id", kind="stable")     # 2 * size: far above the expected size
    if got.empty:
        got = vectors.limit(1).toPandas()
    ids, x = got.vec_id.to_numpy(), np.stack(got.vec.to_numpy()).astype(np.float64)
    rng = np.random.default_rng(seed)
    lists = max(1, min(MAX_LISTS, len(x) // 8, round(math.sqrt(n) / 2)))
    c = np.unique(x[rng.permutation(len(x))[:lists]], axis=0)
    for _ in range(rounds):
        near = _squares(x, c).argmin(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        have = np.bincount(near, minlength=len(c))
        c = np.where(have[:, None] > 0, total / np.maximum(have, 1)[:, None], c)
    c = np.unique(c, axis=0)
    # probes: how far down its order of lists each neighbour of a sample query lies
    ask = rng.permutation(len(x))[:256]
    dist = _squares(x[ask], x)
    dist[np.arange(len(ask)), ask] = np.inf
    near = np.argsort(dist, axis=1)[:, :min(k, max(1, len(x) - 1))]
    place = np.argsort(np.argsort(_squares(x[ask], c), axis=1), axis=1)
    depth = place[np.arange(len(ask))[:, None], _squares(x, c).argmin(1)[near]]
    probes = int(np.quantile(depth, RECALL, method="higher")) + 1
    q, r = np.linalg.qr(rng.normal(size=(d, d)))
    return Index(c, q * np.sign(np.diag(r)), probes, ids, x)


def assign(vectors: DataFrame, index: Index) -> DataFrame:
    """(vec_id, vec, list) of every row."""
    shared = vectors.sparkSession.sparkContext.broadcast(index.centroids)

    def put(batches):
        c = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                near = _squares(_matrix(part.column("vec")), c).argmin(1)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("vec"), pa.array(near, pa.int32())],
                                                 names=["vec_id", "vec", "list"])

    return vectors.mapInArrow(put, f"vec_id long, vec {vectors.schema['vec'].dataType.simpleString()}, list int")


def probe(queries: DataFrame, index: Index, ids_in: dict[int, int], k: int) -> DataFrame:
    """(query_id, vec, bound, list): the lists each query asks, and an upper
    bound of its k-th distance from the sample. ``ids_in``: ids of each list,
    an id counted in one list only."""
    shared = send(queries.sparkSession, index)

    def route(batches):
        ix = received(Index, shared)
        held = np.array([ids_in.get(i, 0) for i in range(len(ix.centroids))])
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                q, ids = _matrix(part.column("vec")), part.column("query_id").to_numpy()
                order = np.argsort(_squares(q, ix.centroids), axis=1, kind="stable")
                # always enough lists to hold k candidates besides the query
                need = np.maximum(ix.probes, 1 + np.argmax(np.cumsum(held[order], axis=1) >= min(k + 1, held.sum()), axis=1))
                dist = _squares(q, ix.sample)
                dist[ids[:, None] == ix.sample_ids[None, :]] = np.inf
                bound = np.sqrt(np.partition(dist, k - 1, axis=1)[:, k - 1]) if dist.shape[1] >= k else np.full(len(q), np.inf)
                bound = bound * (1 + 1e-6) + 1e-6 * np.sqrt((q * q).sum(1))
                need = np.minimum(need, len(ix.centroids))
                rep = pa.array(np.repeat(np.arange(len(q)), need))
                yield pa.RecordBatch.from_arrays(
                    [part.column("query_id").take(rep), part.column("vec").take(rep), pa.array(np.repeat(bound, need)),
                     pa.array(np.concatenate([order[i, :m] for i, m in enumerate(need)]), pa.int32())],
                    names=["query_id", "vec", "bound", "list"])

    return queries.mapInArrow(route, f"query_id long, vec {queries.schema['vec'].dataType.simpleString()}, bound double, list int")


def sample_neighbours(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, vec_id, score): each query's k nearest within the sample, the
    rows behind its first bound, so that abandoning never leaves fewer than k."""
    shared = send(queries.sparkSession, index)

    def near(batches):
        ix = received(Index, shared)
        for b in batches:
            out = []
            for q, own in zip(_matrix(b.column("vec")), b.column("query_id").to_pylist()):
                at = np.flatnonzero(ix.sample_ids != own)
                diff = ix.sample[at] - q
                dist = np.sqrt((diff * diff).sum(1))
                best = np.lexsort((ix.sample_ids[at], dist))[:k]
                out += [(own, int(ix.sample_ids[at[i]]), float(dist[i])) for i in best]
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())],
                                             names=["query_id", "vec_id", "score"])

    return queries.mapInArrow(near, "query_id long, vec_id long, score double")


def adaptive_scan(x: np.ndarray, columns: list[np.ndarray], ids: np.ndarray, q: np.ndarray, q_rot: np.ndarray,
                  own: int, bound: float, k: int, epsilon: float = EPSILON):
    """The k nearest of one block for one query: (ids, distances)."""
    d = x.shape[1]
    best_d, best_i = np.empty(0), np.empty(0, np.int64)
    slack = 1e-9 * float(q @ q)                       # rounding of the rotation
    for lo in range(0, len(x), 2048):
        alive = lo + np.flatnonzero(ids[lo:lo + 2048] != own)
        part, c0 = np.zeros(len(alive)), 0
        for block in columns:
            c1 = c0 + block.shape[1]
            diff = block[alive] - q_rot[c0:c1]
            part = part + (diff * diff).sum(1)
            c0 = c1
            if c1 < d:
                keep = part * (d / c1) <= (1 + epsilon / math.sqrt(c1)) ** 2 * bound * bound + slack
            else:
                keep = part <= bound * bound * (1 + 1e-9) + slack
            alive, part = alive[keep], part[keep]
            if not len(alive):
                break
        if len(alive):
            diff = x[alive] - q
            best_d = np.concatenate([best_d, np.sqrt((diff * diff).sum(1))])
            best_i = np.concatenate([best_i, ids[alive]])
            order = np.lexsort((best_d, best_i))
            order = order[np.unique(best_i[order], return_index=True)[1]]      # each id at its least distance
            order = order[np.lexsort((best_i[order], best_d[order]))][:k]
            best_d, best_i = best_d[order], best_i[order]
            if len(best_d) == k:
                bound = min(bound, best_d[-1] * (1 + 1e-9))
    return best_i, best_d


def search(table: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
           sample: int = SAMPLE, rows: int = ROWS, per_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found to each row
    of ``queries`` (same columns as ``table``), nearest first."""
    schema = "query_id long, vec_id long, score double"
    vectors = usable(table, id_col, vec_col)
    n, n_ids = vectors.agg(F.count(F.lit(1)), F.approx_count_distinct("vec_id")).first()
    index = fit(vectors, k, n, max(1, n_ids), sample)
    if index is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    listed = stored(assign(vectors, index), "lists")
    sizes = {r[0]: r[1] for r in listed.groupBy("list").count().collect()}       # one row for each list
    ids_in = {r[0]: r[1] for r in listed.groupBy("vec_id").agg(F.min("list").alias("list")).groupBy("list").count().collect()}
    d = len(index.rotation)
    asking = (usable(queries, id_col, vec_col).filter(F.size("vec") == d)
              .groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec")))
    probes = stored(probe(asking, index, ids_in, k), "probes")
    asked = {r[0]: r[1] for r in probes.groupBy("list").count().collect()}
    v_blocks = F.array(*[F.lit(max(1, math.ceil(sizes.get(i, 0) / rows))) for i in range(len(index.centroids))])
    q_blocks = F.array(*[F.lit(max(1, math.ceil(asked.get(i, 0) / per_block))) for i in range(len(index.centroids))])
    left = listed.select(
        "list", F.pmod(F.xxhash64("vec_id"), F.get(v_blocks, "list").cast("long")).alias("vb"),
        F.explode(F.sequence(F.lit(0), F.get(q_blocks, "list") - 1)).alias("qb"), "vec_id", "vec")
    right = probes.select(
        "list", F.explode(F.sequence(F.lit(0).cast("long"), F.get(v_blocks, "list").cast("long") - 1)).alias("vb"),
        F.pmod(F.xxhash64("query_id"), F.get(q_blocks, "list").cast("long")).cast("int").alias("qb"), "query_id", "vec", "bound")
    rotation = table.sparkSession.sparkContext.broadcast(index.rotation)

    def compare(block: pa.Table, ask: pa.Table) -> pa.Table:
        out_q, out_i, out_d = [], [], []
        if block.num_rows and ask.num_rows:
            x, q = _matrix(block.column("vec")), _matrix(ask.column("vec"))
            ids = block.column("vec_id").to_numpy()
            r, q_rot = x @ rotation.value, q @ rotation.value
            columns = [np.ascontiguousarray(r[:, c:c + COLUMNS]) for c in range(0, d, COLUMNS)]
            for j, (own, bound) in enumerate(zip(ask.column("query_id").to_pylist(), ask.column("bound").to_pylist())):
                i, s = adaptive_scan(x, columns, ids, q[j], q_rot[j], own, bound, k)
                out_q.append(np.full(len(i), own))
                out_i.append(i)
                out_d.append(s)
        cat = lambda p, t: pa.array(np.concatenate(p).astype(t) if p else np.empty(0, t))
        return pa.Table.from_arrays([cat(out_q, np.int64), cat(out_i, np.int64), cat(out_d, np.float64)],
                                    names=["query_id", "vec_id", "score"])

    keys = ["list", "vb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, schema)
    found = found.unionByName(sample_neighbours(asking, index, k)).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
