"""Event units and cross-day dedup.

* Exact units: items with the same canonical URL are one event whatever their
  title and day; each joins its group's smallest id (star edges, never all
  pairs). Items with the same normalised title are one event while no gap
  between their days is over ``window_days``.
* Near duplicates: MinHash signatures over word 3-shingles of the whole text
  bucket the texts by LSH bands; an edge is kept when the exact Jaccard
  similarity of two shingle sets of a bucket is at least ``threshold``. Members
  are compared with the bucket's smallest id first and then, in blocks, across
  the components that are left, so no link of the buckets is lost.
* Units are the connected components of those edges: least labels and pointer
  jumping with DataFrame joins, each round written to the session's
  ``spark.checkpoint.dir``.
* Cross-day rules keep a log of kept days per key, folded over its distinct
  days; "new facts" is a window over distinct (key, fact, day) rows.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, delete_folder

NUM_HASHES = 64
BANDS = 16
SHINGLE = 3
PIECE = 1 << 18         # shingles permuted, or common ones listed, at a time
POOL = 2048             # rows of small buckets compared in one group
_PRIME = (1 << 61) - 1


def event_key(title) -> Column:
    """Normalised title: lower case, runs of non-letters/digits to one space."""
    t = F.col(title) if isinstance(title, str) else title
    return F.trim(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def exact_edges(items: DataFrame, id_col: str = "idx", key_col: str = "event_key") -> DataFrame:
    """Star edges (id -> smallest id with the same key)."""
    k = items.filter(F.col(key_col) != "").select(id_col, key_col)
    mins = k.groupBy(key_col).agg(F.min(id_col).alias("_root"))
    return (k.join(mins, key_col).filter(F.col(id_col) != F.col("_root"))
            .select(F.col(id_col).alias("src"), F.col("_root").alias("dst")))


#: query keys that name a campaign or a click, not a document (own rule)
TRACKING_KEYS = r"(?i)^(utm_.*|fbclid|gclid|msclkid|mc_cid|mc_eid|spm|ref|ref_src|from)(=.*)?$"


def canonical_url(url) -> Column:
    """Host (lower case, without ``www.`` and a default port), path (without a
    last slash) and sorted query (without tracking keys) of an absolute URL;
    null if it has no host. Scheme and fragment don't count."""
    u = F.trim(F.col(url) if isinstance(url, str) else url)
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^:]+://[^/?#]*([^?#]*)", 1), r"/+$", "")
    parts = F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING_KEYS))
    query = F.array_join(F.array_sort(parts), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def title_edges(items: DataFrame, window_days: int) -> DataFrame:
    """Star edges between items (idx, event_key, day) of one title: a run of
    days without a gap over ``window_days`` is one event. The runs are found on
    distinct (title, day) rows. Items without a title or day have none."""
    named = items.filter("event_key <> '' and day is not null").select("idx", "event_key", "day")
    by_key = Window.partitionBy("event_key").orderBy("day")
    new = F.datediff("day", F.lag("day").over(by_key)) <= window_days
    days = named.select("event_key", "day").distinct().withColumn("_first", F.when(~F.coalesce(new, F.lit(False)), F.col("day")))
    runs = days.select("event_key", "day", F.max("_first").over(by_key).alias("_run"))
    keyed = named.join(runs, ["event_key", "day"]).withColumn("_key", F.concat_ws("@", F.col("_run").cast("string"), "event_key"))
    return exact_edges(keyed, key_col="_key")


def _coeffs(k: int, seed: int = 7):
    rng = np.random.default_rng(seed)
    a = rng.integers(1, _PRIME - 1, size=k, dtype=np.int64)
    b = rng.integers(0, _PRIME - 1, size=k, dtype=np.int64)
    return a.astype(object), b.astype(object)


def _minhash_udf(k: int):
    a, b = _coeffs(k)
    a64 = np.array([int(x) % (1 << 31) for x in a], dtype=np.uint64)
    b64 = np.array([int(x) % (1 << 31) for x in b], dtype=np.uint64)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def minhash(hashes: pd.Series) -> pd.Series:
        """Per text: k universal-hash permutations of the shingle hashes, min of
        each. A batch's shingles lie in one array and go through the
        permutations in pieces of bounded size."""
        p = np.uint64((1 << 31) - 1)
        size = np.array([0 if h is None else len(h) for h in hashes])
        have = np.flatnonzero(size)
        out = [None] * len(size)
        if len(have):
            v = np.concatenate([np.asarray(hashes.iloc[i], np.int64) for i in have]).astype(np.uint64) % p
            first = np.concatenate([[0], np.cumsum(size[have])])
            sig = np.full((k, len(have)), p, np.uint64)
            for lo in range(0, len(v), PIECE):
                hi = min(lo + PIECE, len(v))
                a, b = np.searchsorted(first, lo, "right") - 1, np.searchsorted(first, hi, "left")
                cut = np.maximum(first[a:b], lo) - lo
                for i in range(k):
                    sig[i, a:b] = np.minimum(sig[i, a:b], np.minimum.reduceat((a64[i] * v[lo:hi] + b64[i]) % p, cut))
            for j, i in enumerate(have):
                out[i] = sig[:, j].astype(np.int64).tolist()
        return pd.Series(out)
    return minhash


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int = NUM_HASHES, shingle: int = SHINGLE) -> DataFrame:
    """MinHash signature and sorted distinct shingle hashes of every text
    (whole text, word ``shingle``-grams). Shingle hashes are computed in the JVM; only the k-permutation minimum
    runs in an Arrow-batched pandas UDF."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+", " ")), " ")
    # the word array is materialised first: a lambda that referenced the
    # split expression would re-run it for every shingle
    w = docs.select(id_col, words.alias("_words"))
    n = F.size("_words")
    sh = F.when(n >= shingle, F.transform(F.sequence(F.lit(1), n - shingle + 1),
                                          lambda i: F.xxhash64(F.array_join(F.slice("_words", i, shingle), " ")))).when(
        F.col("_words")[0] != "", F.array(F.xxhash64(F.array_join("_words", " "))))
    staged = w.select(id_col, F.array_sort(F.array_distinct(sh)).alias("shingles"))
    # a text under ``shingle`` words is one shingle; one without words gets a null
    # signature and falls in no bucket
    return staged.select(id_col, _minhash_udf(k)(F.col("shingles")).alias("sig"), "shingles")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below ``spark.checkpoint.dir`` and read it back."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _similar(a: str, b: str, threshold: float) -> Column:
    """Whether the Jaccard similarity of two sets is at least ``threshold``."""
    both = F.size(F.array_intersect(a, b))
    return both >= threshold * (F.size(a) + F.size(b) - both) - 1e-9


def _overlaps(rest: list, others: list):
    """(i, j, common elements) of the sets of ``rest`` and ``others`` that have
    some, in pieces of bounded size."""
    h = np.concatenate(others)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], np.repeat(np.arange(len(others)), [len(x) for x in others])[order]
    mine = np.concatenate(rest)
    row = np.repeat(np.arange(len(rest)), [len(x) for x in rest])
    lo = np.searchsorted(h, mine, "left")
    n = np.searchsorted(h, mine, "right") - lo
    ends = np.cumsum(n)
    at = 0
    while at < len(rest):
        x = int(np.searchsorted(row, at))
        base = ends[x] - n[x]
        z = int(np.searchsorted(ends, base + PIECE))
        to = max(at + 1, int(row[z])) if z < len(row) else len(rest)
        y = int(np.searchsorted(row, to))
        i, k = np.repeat(row[x:y] - at, n[x:y]), n[x:y]
        j = owner[np.repeat(lo[x:y] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        both = np.bincount(i * len(others) + j, minlength=(to - at) * len(others))
        cell = np.flatnonzero(both)
        yield cell // len(others) + at, cell % len(others), both[cell]
        at = to


def _compare_lists(threshold: float, window_days: int | None = None):
    def links(t: pa.Table) -> pa.Table:
        """Links of the lists of one group between their members outside the
        largest component (``rest``) and all members of the block (``main``).
        A link that joins what earlier links of the group have joined is left out."""
        t = t.combine_chunks()
        cols = {c: t.column(c).to_numpy() for c in ("key", "id", "day", "comp", "rest", "main")}
        sets = t.column("set").combine_chunks()
        cut, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
        root: dict[int, int] = {}

        def find(c):
            while c in root:
                c = root[c]
            return c
        order = np.argsort(cols["key"], kind="stable")
        key = cols["key"][order]
        found = []
        for rows in np.split(order, np.flatnonzero(key[1:] != key[:-1]) + 1):
            comp = np.array([find(c) for c in cols["comp"][rows].tolist()])
            if (comp == comp[0]).all():
                continue
            r, m = np.flatnonzero(cols["rest"][rows]), np.flatnonzero(cols["main"][rows])
            if not len(r) or not len(m):
                continue
            size, day, ids = cut[rows + 1] - cut[rows], cols["day"][rows], cols["id"][rows]
            part = [flat[cut[x]:cut[x + 1]] for x in rows]
            for i, j, both in _overlaps([part[x] for x in r], [part[x] for x in m]):
                i, j = r[i], m[j]
                ok = (both >= threshold * (size[i] + size[j] - both) - 1e-9) & (comp[i] != comp[j])
                if window_days is not None:
                    ok &= np.abs(day[i] - day[j]) <= window_days
                i, j = i[ok], j[ok]
                _, one = np.unique(np.stack([comp[i], comp[j]]), axis=1, return_index=True)
                for x, y in zip(i[one], j[one]):
                    a, b = find(int(comp[x])), find(int(comp[y]))
                    if a != b:
                        root[a] = b
                        found.append((ids[x], ids[y]))
        src, dst = zip(*found) if found else ((), ())
        return pa.Table.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])
    return links


def lsh_edges(sigs: DataFrame, id_col: str, bands: int = BANDS, threshold: float = 0.8, block: int = 256,
              day_col: str | None = None, window_days: int | None = None) -> DataFrame:
    """Edges that connect all pairs of one LSH bucket whose shingle sets have a
    Jaccard similarity of at least ``threshold``. Signatures without a
    ``shingles`` column are compared position by position instead.

    Equal sets are linked to their least id, which stands for them. In a
    bucket, every member is compared with the least id (star edges). Where that
    leaves several components in a bucket, members outside its largest one are
    compared with all its members inside tasks, so no pair of rows is ever
    shuffled: buckets of one block are dealt together into pools, both sides of
    a larger one into blocks of about ``block`` rows. Buckets with the same
    members are taken once. Connected components of the result equal those of
    all such pairs.

    With ``day_col`` and ``window_days`` a pair's days are at most that far
    apart, and rows without a day have no edges."""
    rows = NUM_HASHES // bands
    day = F.unix_date(day_col) if day_col else F.lit(0)
    slot = F.floor(F.col("day") / max(1, window_days)) if day_col else F.lit(0)
    slots = F.array(slot, slot + 1) if day_col else F.array(slot)
    key = ["band", "bucket", "slot"]
    if "shingles" in sigs.columns:
        sets = F.col("shingles")
    else:
        least = int(threshold * NUM_HASHES)
        sets = F.array_sort(F.transform("sig", lambda v, i: F.xxhash64(i, v)))
        threshold = least / (2 * NUM_HASHES - least)        # the same agreement as a share of the union
    sigs = sigs.filter("sig is not null").select(F.col(id_col).alias("id"), day.alias("day"), "sig", sets.alias("set")).filter("day is not null")
    mark = [F.xxhash64("set").alias("m1"), F.xxhash64(F.lit("set"), "set").alias("m2")]
    marked = sigs.select("id", "day", *mark)
    reps = marked.groupBy("m1", "m2", "day").agg(F.min("id").alias("dst"))
    copies = marked.join(reps, ["m1", "m2", "day"]).filter("id <> dst").select(F.col("id").alias("src"), "dst")
    kept = sigs.select("id", "day", "sig", "set", *mark).join(reps.select(F.col("dst").alias("id"), "m1", "m2"), ["id", "m1", "m2"], "left_semi")
    reps = _stored(kept.select("id", "day", "sig", "set"), "lsh-sets")
    banded = reps.select("id", "day", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.xxhash64(F.slice("sig", b * rows + 1, rows)))).alias("band", "bucket"))
    buckets = _stored(banded.select("id", "day", "band", "bucket", F.explode(slots).alias("slot")), "lsh-buckets")
    # sums, not exclusive ors: a repeated id counts as often as it occurs
    marks = [F.sum(F.shiftright(F.xxhash64("id", "day", F.lit(i)), 28)).alias(f"x{i}") for i in (1, 2)]
    roots = (buckets.groupBy(*key).agg(F.min(F.struct("id", "day")).alias("root"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"), *marks)
             .filter("n > 1").groupBy("n", "root", "high", "x1", "x2").agg(F.min(F.struct(*key)).alias("k"))
             .select("k.*", F.col("root.id").alias("dst"), F.col("root.day").alias("dst_day")))
    shared = _stored(buckets.join(roots, key), "lsh-shared")
    near = F.abs(F.col("day") - F.col("dst_day")) <= window_days if day_col else F.lit(True)
    pairs = shared.filter("id <> dst").filter(near).select(F.col("id").alias("src"), "dst").distinct()
    star = _stored(pairs.join(reps.select(F.col("id").alias("src"), F.col("set").alias("_a")), "src")
                   .join(reps.select(F.col("id").alias("dst"), F.col("set").alias("_b")), "dst")
                   .filter(_similar("_a", "_b", threshold)).select("src", "dst").distinct(), "lsh-star")
    comp = connected_components(shared.select("id").distinct(), star).withColumnRenamed("component", "comp")
    members = _stored(shared.drop("dst", "dst_day").join(comp, "id"), "lsh-members")
    sizes = members.groupBy(*key, "comp").agg(F.count(F.lit(1)).alias("k"))
    open_ = (sizes.groupBy(*key).agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.sum("k").alias("n"),
                                                 F.max("k").alias("k"), F.count(F.lit(1)).alias("c")).filter("c > 1")
             .select(*key, "main", F.ceil(F.col("n") / block).cast("int").alias("all_blocks"),
                     F.ceil((F.col("n") - F.col("k")) / block).cast("int").alias("rest_blocks")))
    opened = _stored(members.join(open_, key).withColumn("key", F.xxhash64(*key)), "lsh-open")
    pools = max(1, math.ceil(opened.count() / POOL))
    outside = F.col("comp") != F.col("main")
    alone = F.col("all_blocks") > 1
    zero = F.lit(0)
    small = opened.filter(~alone).select(F.pmod(F.xxhash64("key", F.lit(0)), F.lit(pools)).alias("pool"), F.lit(-1).alias("i"), zero.alias("j"),
                                         "key", "id", "day", "comp", outside.alias("rest"), F.lit(True).alias("main"))

    def dealt(frame, rest, own, other, names):
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(names[0])
        spread = F.explode(F.sequence(zero, F.col(other) - 1)).alias(names[1])
        return frame.select(F.col("key").alias("pool"), "key", "id", "day", "comp", F.lit(rest).alias("rest"), F.lit(not rest).alias("main"), mine, spread)
    large = opened.filter(alone)
    rows_ = (small.unionByName(dealt(large.filter(outside), True, "rest_blocks", "all_blocks", ("i", "j")))
             .unionByName(dealt(large, False, "all_blocks", "rest_blocks", ("j", "i"))))
    remaining = (rows_.join(reps.select("id", "set"), "id").groupBy("pool", "i", "j")
                 .applyInArrow(_compare_lists(threshold, window_days), "src long, dst long"))
    return copies.unionByName(star).unionByName(remaining)


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest id of each vertex's component: (id, component).

    Each round takes the least label among a vertex and its neighbours, then
    the label of that label (pointer jumping), until no label changes; a path
    of n vertices needs about log n rounds. The edge list and each round's
    labels are tables in ``spark.checkpoint.dir``; a round's table is deleted
    when the next one is written, so the lineage and the disk stay small."""
    spark = vertices.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/components-{uuid.uuid4().hex}"
    und = (edges.select("src", "dst")
           .unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
           .filter("src <> dst").distinct())
    und.write.parquet(f"{base}/edges")
    und = spark.read.parquet(f"{base}/edges")
    # vertices without an edge are their own component and take no part
    labels = und.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("_nl")).select("id", F.least("id", "_nl").alias("label"))
    step, changed = 0, True
    labels.write.parquet(f"{base}/0")
    labels = spark.read.parquet(f"{base}/0")
    while changed:
        nbr = (und.join(labels.withColumnRenamed("id", "src"), "src")
               .groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("_nl")))
        low = labels.join(nbr, "id").select("id", F.col("label").alias("_old"), F.least("label", "_nl").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("_jump"))
        new = low.join(jump, "label", "left").select(
            "id", F.least("label", "_jump").alias("label"), (F.least("label", "_jump") < F.col("_old")).alias("_chg"))
        new.write.parquet(f"{base}/{step + 1}")
        new = spark.read.parquet(f"{base}/{step + 1}")
        changed = not new.filter("_chg").isEmpty()
        labels = new.select("id", "label")
        delete_folder(spark, f"{base}/{step}")
        step += 1
    return (vertices.select("id").join(labels, "id", "left")
            .select("id", F.coalesce("label", "id").alias("component")))


def event_units(scored: DataFrame, texts: DataFrame, threshold: float = 0.8, window_days: int = 14) -> DataFrame:
    """ddp_event_units: (idx, unit, is_representative, unit_size, n_sources)
    where the representative is the highest-priority member (ties: smallest idx).

    ``scored``: (idx, source, priority, title, url, day); ``texts``: (idx, text,
    day). One canonical URL is one event; equal titles and near-duplicate texts
    are one event within ``window_days``. Items without a day are linked by URL
    alone."""
    items = scored.select("idx", event_key("title").alias("event_key"), canonical_url("url").alias("place"), "day")
    same = exact_edges(items, key_col="place").unionByName(title_edges(items, window_days))
    signed = signatures(texts, "idx", "text").join(texts.select("idx", "day"), "idx")
    near = lsh_edges(_stored(signed, "signatures"), "idx", threshold=threshold, day_col="day", window_days=window_days)
    comp = connected_components(scored.select(F.col("idx").alias("id")), same.unionByName(near))
    u = scored.select("idx", "source", "priority").join(comp.withColumnRenamed("id", "idx"), "idx")
    rep = u.groupBy("component").agg(
        F.max_by("idx", F.struct(F.col("priority"), -F.col("idx"))).alias("_rep"),
        F.count(F.lit(1)).alias("unit_size"), F.countDistinct("source").alias("n_sources"))
    return (u.join(rep, "component")
            .select("idx", F.col("component").alias("unit"), (F.col("idx") == F.col("_rep")).alias("is_representative"),
                    "unit_size", "n_sources"))


FACT_PATTERN = r"\d+(?:[.,:/-]\d+)*"


def facts(text_col: str) -> Column:
    """Numbers, dates and versions of a text (the 'core facts' proxy)."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(FACT_PATTERN), 0))


def kept_log(days: DataFrame, window_days: int) -> DataFrame:
    """(event_key, day, before) of every distinct (key, day): ``before`` is the
    last day on which the key was kept. A day is kept if no kept day lies in
    the ``window_days`` before it, or if it brings a new fact (``any_new``).

    The days of one key are folded in order; their number is bounded by the
    calendar, not by the rows of the key."""
    none = F.struct(F.lit(None).cast("date").alias("last"),
                    F.array().cast("array<struct<day:date,before:date>>").alias("days"))

    def step(acc, d):
        keep = acc["last"].isNull() | (F.datediff(d["day"], acc["last"]) > window_days) | d["any_new"]
        seen = F.struct(d["day"].alias("day"), acc["last"].alias("before"))
        return F.struct(F.when(keep, d["day"]).otherwise(acc["last"]).alias("last"),
                        F.concat(acc["days"], F.array(seen)).alias("days"))
    per_key = days.groupBy("event_key").agg(F.array_sort(F.collect_list(F.struct("day", "any_new"))).alias("_d"))
    return per_key.select("event_key", F.inline(F.aggregate("_d", none, step, lambda acc: acc["days"])))


def cross_day(items: DataFrame, day: str = "day", window_days: int = 14) -> DataFrame:
    """ddp_cross_day + ddp_continuation over a whole history: an item whose
    key was kept in the previous ``window_days`` days is dropped unless it
    brings a fact that its key did not have in those days; kept repeats are
    continuations. Blank keys are never repeats.

    ``items``: (idx, event_key, day, facts ARRAY<STRING>). The history is first
    reduced to distinct (key, day) and (key, fact, day) rows, so windows and
    folds follow the number of days however hot a key is."""
    t = items.select("idx", "event_key", F.col(day).alias("t_day"), "facts")
    named = t.filter("event_key <> ''")
    facts_of = named.select("idx", "event_key", "t_day", F.explode("facts").alias("fact"))
    before = F.lag("t_day").over(Window.partitionBy("event_key", "fact").orderBy("t_day"))
    new = (facts_of.select("event_key", "fact", "t_day").distinct().withColumn("_b", before)
           .filter(F.col("_b").isNull() | (F.datediff("t_day", "_b") > window_days)).drop("_b"))
    fresh = facts_of.join(new, ["event_key", "fact", "t_day"]).select("idx").distinct().withColumn("_new", F.lit(True))
    flagged = t.join(fresh, "idx", "left").withColumn("has_new_fact", F.when(
        F.col("event_key") == "", F.size("facts") > 0).otherwise(F.coalesce("_new", F.lit(False)))).drop("_new")
    days = (flagged.filter("event_key <> ''").groupBy("event_key", F.col("t_day").alias("day"))
            .agg(F.max("has_new_fact").alias("any_new")))
    log = kept_log(days, window_days).withColumnRenamed("day", "t_day")
    seen = F.coalesce(F.datediff("t_day", "before") <= window_days, F.lit(False))
    return (flagged.join(log, ["event_key", "t_day"], "left").withColumn("seen", seen).drop("before")
            .withColumn("keep", ~F.col("seen") | F.col("has_new_fact"))
            .withColumn("is_continuation", F.col("seen") & F.col("has_new_fact")))


def rolling_keep(df: DataFrame, key: str = "event_key", ts: str = "event_ts", window_days: int = 14) -> DataFrame:
    """inc_rolling_dedup (batch): the first row of a key on a day is kept
    unless a row of the key was kept in the ``window_days`` days before. Rows
    with a blank key or without a time are never repeats."""
    named = df.filter((F.col(key) != "") & F.col(ts).isNotNull())
    firsts = (named.groupBy(F.col(key).alias("event_key"), F.to_date(ts).alias("day"))
              .agg(F.min(F.struct(ts, "idx")).alias("_first"), F.lit(False).alias("any_new")))
    log = kept_log(firsts, window_days)
    kept = log.filter(F.col("before").isNull() | (F.datediff("day", "before") > window_days))
    ids = firsts.join(kept, ["event_key", "day"]).select(F.col("_first.idx").alias("idx"), F.lit(True).alias("_kept"))
    free = (F.coalesce(F.col(key), F.lit("")) == "") | F.col(ts).isNull()
    return df.join(ids, "idx", "left").withColumn("keep", free | F.coalesce("_kept", F.lit(False))).drop("_kept")
