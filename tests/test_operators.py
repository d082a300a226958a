"""Invariants, brute-force comparisons and the skew-safe rewrites."""

import datetime as dt
import itertools
import os
import re

import duckdb
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from quillstream.operators import dedup as DD
from quillstream.operators import focus as FO
from quillstream.operators import normalize as N
from quillstream.operators import runstate as RS
from quillstream.operators import sections as SC
from quillstream.plans.adapters import builder_posts
from quillstream.session import table
from quillstream.sources import payloads as P

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 18
    assert {"source", "rank", "idx", "priority"} <= set(df.columns)


def test_kept_plus_dropped_is_input(spark):
    posts = builder_posts(spark, SF001)
    out = N.normalize_posts(posts)
    assert N.kept(out).count() + N.dropped(out).count() == posts.count()


def test_top_k_sizes(spark):
    t = E.queries()["top_per_source"](spark, SF001)
    assert max(r["count"] for r in t.groupBy("source").count().collect()) <= 8


def test_each_item_in_one_section(spark):
    s = E.queries()["win_section_quota"](spark, SF001)
    assert s.count() == s.select("idx").distinct().count()
    per = s.filter(F.col("section").isNotNull()).groupBy("day", "section").count().collect()
    caps = {"industry": 4, "personal": 5, "watch": 15}
    assert all(r["count"] <= caps[r["section"]] for r in per)


def _shingles(text):
    w = re.sub(r"[^\w]+|_", " ", text.lower()).split()
    return {" ".join(w[i:i + 3]) for i in range(len(w) - 2)}


def test_event_units_against_brute_force(spark):
    """All pairs of sf0.001: canonical URL, title runs, and texts at 0.8 within the window."""
    from quillstream.plans.dedup_queries import _event_items

    texts = {r.doc_id: r.text for r in table(spark, SF001, "documents").collect()}
    items = {r.idx: r for r in _event_items(spark, SF001).collect()}
    sets = {i: _shingles(t) for i, t in texts.items()}
    title = {i: re.sub(r"[\W_]+", " ", (r.title or "").lower()).strip() for i, r in items.items()}
    place = {i: re.sub(r"^https?://(www\.)?|/?(\?utm_source=feed)?(#top)?$", "", r.url.lower()) if r.url else None for i, r in items.items()}
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    apart = 0
    for a, b in itertools.combinations(sorted(items), 2):
        both = len(sets[a] & sets[b])
        alike = both > 0 and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9
        close = abs((items[a].day - items[b].day).days) <= 14
        apart += alike and not close
        if (place[a] and place[a] == place[b]) or (close and (alike or (title[a] and title[a] == title[b]))):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    units = {r.idx: r.unit for r in E.queries()["ddp_event_units"](spark, SF001).collect()}
    assert units == {i: find(i) for i in items}
    assert apart and any(find(i) != i for i in items if i % 10 == 5)


def test_canonical_urls(spark):
    same = ["https://News.example.com/a/b", "http://www.news.example.com:80/a/b/", "https://u:p@news.example.com/a/b?utm_source=x&fbclid=1#top",
            " https://news.example.com:443/a/b?gclid="]
    other = ["https://news.example.com/a/B", "https://news.example.com/a/b?id=1", "https://news.example.com:8080/a/b", "https://m.news.example.com/a/b"]
    none = [None, "", "/a/b", "news.example.com/a/b", "mailto:x@y"]
    rows = spark.createDataFrame([(u,) for u in same + other + none], "u string").select(DD.canonical_url("u").alias("c")).collect()
    got = [r.c for r in rows]
    assert set(got[:4]) == {"news.example.com/a/b"} and len(set(got[4:8])) == 4 and "news.example.com/a/b" not in got[4:8] and got[8:] == [None] * 5
    q = spark.createDataFrame([("http://x.com?b=2&a=1&utm_campaign=z",), ("https://x.com/?a=1&b=2",)], "u string").select(DD.canonical_url("u").alias("c")).collect()
    assert q[0].c == q[1].c == "x.com?a=1&b=2"


def test_event_units_over_days(spark):
    day = dt.date(2024, 1, 1)
    words = " ".join(f"w{j}" for j in range(60))
    rows = [(1, "One story", None, 0, words), (2, "One  STORY!", None, 14, "x"), (3, "one story", None, 29, "y"),      # a run of titles, then a gap of 15 days
            (4, "A", None, 100, words), (5, "B", None, 114, words + " more"), (6, "C", None, 129, words),              # texts: 14 days, then 15
            (7, "first title", "https://a.com/x", 0, "p"), (8, "second title", "http://www.a.com/x/?utm_medium=m", 300, "q"),
            (9, "One story", None, None, words), (10, "", None, 0, "r"), (11, None, None, 0, None)]
    items = spark.createDataFrame([(i, "s", 1.0, t, u, None if d is None else day + dt.timedelta(d), x) for i, t, u, d, x in rows],
                                  "idx long, source string, priority double, title string, url string, day date, text string")
    got = {r.idx: r.unit for r in DD.event_units(items.drop("text"), items.select("idx", "text", "day")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10, 11: 11}


def test_lists_are_compared_in_groups():
    """Links of several lists in one group join what all pairs join, with none left over."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    base = [rng.integers(0, 1 << 40, 60) for _ in range(4)]
    sets = [np.unique(np.concatenate([base[i % 4][:60 - i % 5], rng.integers(0, 1 << 40, 3)])) for i in range(40)]
    days = [int(d) for d in rng.integers(0, 40, 40)]
    lists = [(key, i) for key in range(6) for i in range(40) if (i + key) % 3]
    rows = pa.table({"key": [k for k, _ in lists], "id": [i for _, i in lists], "day": [days[i] for _, i in lists], "comp": [i for _, i in lists],
                     "rest": [i > 1 for _, i in lists], "main": [True] * len(lists), "set": pa.array([sets[i].tolist() for _, i in lists], pa.list_(pa.int64()))})
    got = DD._compare_lists(0.8, 14)(rows).to_pylist()

    def components(pairs):
        root = list(range(40))
        for a, b in pairs:
            root = [root[a] if r == root[b] else r for r in root]
        return [root.index(r) for r in root]
    both = {(k, i) for k, i in lists}
    want = [(a, b) for a, b in itertools.combinations(range(40), 2) if any((k, a) in both and (k, b) in both for k in range(6)) and b > 1
            and abs(days[a] - days[b]) <= 14 and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) - 1e-9]
    assert components([(r["src"], r["dst"]) for r in got]) == components(want)
    assert len(got) == 40 - len(set(components(want))) < len(want)


def test_vendor_names_are_whole_words(spark):
    items = spark.createDataFrame([(1, "Open-AI ships", None), (2, "openai", "by OPEN  ai."), (3, "reopen ai", "open air"), (4, None, None)],
                                  "idx long, title string, summary string")
    vendors = spark.createDataFrame([(1, "Open AI"), (2, "openai"), (3, "..."), (4, None)], "vendor long, name string")
    assert sorted(tuple(r) for r in SC.vendor_mentions(items, vendors).collect()) == [(1, 1), (2, 1), (2, 2)]


def _components(sets, threshold):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


def _near_components(texts, **kw):
    edges = DD.lsh_edges(DD._stored(DD.signatures(texts, "idx", "text"), "signatures"), "idx", **kw)
    return {r.id: r.component for r in DD.connected_components(texts.select(F.col("idx").alias("id")), edges).collect()}


def test_near_links_at_the_threshold_itself(spark):
    rows = []
    for i in range(60):       # 90 shingles each, 80 (0.8) or 79 (0.782) of them shared
        words = [f"w{i}x{j}" for j in range(92)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:82 - i % 2] + [f"v{i}x{j}" for j in range(10 + i % 2)]))]
    hub = [f"h{j}" for j in range(92)]       # none of these is close to the least id of its buckets
    rows += [(1000, " ".join(hub[:60] + [f"a{j}" for j in range(32)]))] + [(1001 + k, " ".join(hub + [f"k{k}"])) for k in range(5)]
    texts = spark.createDataFrame(rows, "idx long, text string")
    want = _components({i: _shingles(t) for i, t in rows}, 0.8)
    assert sum(want[i] != i for i in want) == 34
    assert _near_components(texts, block=2) == want


def test_near_links_of_a_table_against_brute_force(spark):
    docs = table(spark, SF001, "documents").select(F.col("doc_id").alias("idx"), "text")
    sets = {r.idx: _shingles(r.text) for r in docs.collect()}
    got = _near_components(docs)
    want = _components({i: s for i, s in sets.items() if s}, 0.8)
    assert {i: got[i] for i in want} == want


def test_publish_safety_against_brute_force(spark):
    got = {(r.doc_id, r.pattern_id) for r in E.queries()["flt_publish_safety"](spark, SF01).collect()}
    con = duckdb.connect()
    want = set(con.execute(f"select d.doc_id, b.item_id from '{SF01}/documents.parquet' d, '{SF01}/benchmark.parquet' b "
                           f"where contains(d.text, b.text)").fetchall())
    assert {g for g in got if g[1] >= 0} == want


def test_request_rate_chunks_match_plain_window(spark):
    ev = table(spark, SF001, "events").select("event_id", F.col("user_id").alias("token"), "ts")
    fast = FO.request_rate(ev, chunk_seconds=120).select("event_id", "requests_60s")
    w = Window.partitionBy("token").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-60_000_000, 0)
    plain = ev.select("event_id", F.count(F.lit(1)).over(w).alias("requests_60s"))
    assert fast.exceptAll(plain).count() == 0 and plain.exceptAll(fast).count() == 0


def _day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_rolling_keep_compares_with_kept_rows(spark):
    rows = [(i, "k", _day(10 * i)) for i in range(5)]
    rows += [(10, "", _day(0)), (11, "", _day(1)), (12, "j", _day(3)), (13, "j", _day(3)), (14, "m", None)]
    df = spark.createDataFrame(rows, "idx long, event_key string, event_ts timestamp")
    got = {r.idx: r.keep for r in DD.rolling_keep(df).collect()}
    assert [got[i] for i in range(5)] == [True, False, True, False, True]
    assert got[10] and got[11] and got[12] and not got[13] and got[14]


def test_cross_day_log_holds_kept_events_only(spark):
    rows = [(i, "k", _day(10 * i).date(), []) for i in range(5)] + [(9, "", _day(1).date(), []), (10, "", _day(2).date(), [])]
    df = spark.createDataFrame(rows, "idx long, event_key string, day date, facts array<string>")
    got = {r.idx: r.keep for r in DD.cross_day(df).collect()}
    assert [got[i] for i in range(5)] == [True, False, True, False, True] and got[9] and got[10]


def test_messages_follow_both_tables(spark, scratch):
    docs = spark.range(0, 700).selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang", "'src1' as source", "6L as n_chars")
    pages = spark.range(300, 900).selectExpr("id as page_id", "'http://x' as url", "concat('<p>', id, '</p>') as html")
    docs.write.parquet(f"{scratch}/documents.parquet")
    pages.write.parquet(f"{scratch}/pages.parquet")
    body = {r.idx: r.body for r in E.queries()["src_email_parts_to_body"](spark, scratch).collect()}
    assert set(body) == set(range(900))
    assert body[3] == "text 3" and body[301] == "text 301" and body[303] == "303" and body[899] == "899"


def test_publish_safety_with_many_short_patterns(spark):
    docs = spark.createDataFrame([(1, "one needle7 and tokenneedle1500x"), (2, ""), (3, None), (4, "Second Brain e")], "doc_id long, text string")
    pats = spark.range(0, 2000).selectExpr("id as pattern_id", "concat('needle', id) as pattern").union(
        spark.createDataFrame([(5000, "e"), (5001, ""), (5002, "nd tok")], "pattern_id long, pattern string"))
    got = {tuple(r) for r in SC.publish_safety(docs, pats, ("Second Brain",)).collect()}
    assert got == {(1, 7), (1, 15), (1, 150), (1, 1), (1, 1500), (1, 5000), (1, 5002), (4, -1), (4, 5000)}


def test_lsh_edges_link_members_that_fail_against_the_least_id(spark):
    base = list(range(64))
    near = base[:56] + [1000 + i for i in range(8)]
    least = base[:32] + [2000 + i for i in range(32)]
    sigs = spark.createDataFrame([(0, least), (1, base), (2, near), (3, near), (4, None)], "id long, sig array<long>")
    comp = {r.id: r.component for r in DD.connected_components(sigs.select("id"), DD.lsh_edges(sigs, "id", block=2)).collect()}
    assert comp == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4}


def test_cross_day_bounded_and_correct(spark):
    d = dt.date(2024, 1, 20)
    rows = [(1, "k", d - dt.timedelta(days=3), ["1", "2"]), (2, "k", d, ["2"]), (3, "k", d, ["9"]),
            (4, "j", d, ["1"]), (5, "k", d - dt.timedelta(days=20), ["9"])]
    df = spark.createDataFrame(rows, "idx long, event_key string, day date, facts array<string>")
    out = {r.idx: (r.seen, r.has_new_fact, r.keep) for r in DD.cross_day(df).collect()}
    assert out[2] == (True, False, False)        # repeat without new facts
    assert out[3] == (True, True, True)          # continuation
    assert out[4] == (False, True, True)
    assert out[1][0] is False                    # day-20 history is outside the window


def test_payload_reader_and_sink(spark, scratch):
    empty = P.read_json_cache(spark, os.path.join(scratch, "missing"), P.HOT_PAYLOAD_SCHEMA)
    assert empty.count() == 0
    os.makedirs(os.path.join(scratch, "hot"))
    for name, body in (("good", '{"id": "a", "title": "T", "score": 3}'), ("bad", '{"id": "b", '), ("none", "")):
        with open(os.path.join(scratch, "hot", name + ".json"), "w") as f:
            f.write(body)
    read = P.read_json_cache(spark, os.path.join(scratch, "hot"), P.HOT_PAYLOAD_SCHEMA)
    assert [(r.id, r.score) for r in read.collect()] == [("a", 3)] and read.count() == 1
    posts = N.normalize_posts(builder_posts(spark, SF001))
    path = os.path.join(scratch, "norm")
    P.write_normalized(posts.select("dt", "source", "idx", "reason"), path)
    back = spark.read.parquet(path)
    assert back.count() == posts.count()
    assert {r.outcome for r in back.select("outcome").distinct().collect()} == {"kept", "dropped"}


def test_binary_file_inventory(spark, scratch):
    day = os.path.join(scratch, "2024-01-30")
    os.makedirs(day)
    for name in ("aihot.json", "aihot-normalized.json", "notes.txt"):
        with open(os.path.join(day, name), "w") as f:
            f.write("{}")
    files = (spark.read.format("binaryFile").load(day).select("path", "length", "modificationTime")
             .select(F.lit(dt.date(2024, 1, 30)).alias("dt"), F.element_at(F.split("path", "/"), -1).alias("name"),
                     F.lit(None).cast("string").alias("content")))
    classes = {r.name: r.cls for r in RS.classify(files).collect()}
    assert classes == {"aihot.json": "raw", "aihot-normalized.json": "normalized", "notes.txt": "unknown"}


def test_output_quality(spark):
    df = spark.createDataFrame([("# T\n## A\n{{x}}",), ("## only",)], "text string")
    r = SC.output_quality(df).collect()
    assert r[0].has_residue and r[0].missing_headings == ""
    assert not r[1].has_residue and r[1].missing_headings == "#"


def test_every_task_of_a_session_gets_its_seconds(spark):
    rows = [("2024-01-01T10:00:00.000+0000", "2024-01-01T10:30:45.000+0000", 0, ["A", "B"]),
            ("2024-01-01T11:00:00.000+0000", "2024-01-01T11:01:40.000+0000", 10, ["B"])]
    df = spark.createDataFrame(rows, "start_time string, end_time string, pause_sec long, names array<string>")
    df = df.selectExpr("1L as id", "start_time", "end_time", "pause_sec", "transform(names, n -> named_struct('title', n)) as tasks")
    got = {r.task: r.focus_seconds for r in FO.focus_seconds(FO.focus_chunks(df)).collect()}
    assert got == {"A": 1845, "B": 1935}
