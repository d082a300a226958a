"""File-based sources: .eml files, cache folders, RSS files."""

import os

from pyspark.sql import functions as F

from quillstream.operators import mail as M
from quillstream.sources import feeds as SF
from quillstream.sources import inventory as INV
from quillstream.sources import mail as SM
from quillstream.sources import payloads as P

EML = (b"From: Letter Zero <src0@mail.example.com>\r\nSubject: Caf\xc3\xa9 news\r\n"
       b"Date: Mon, 29 Jan 2024 10:00:00 +0000\r\nMessage-ID: <1@x>\r\nMIME-Version: 1.0\r\n"
       b"Content-Type: multipart/alternative; boundary=\"b\"\r\n\r\n"
       b"--b\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>Hello &amp; bye</p>\r\n--b--\r\n")


def test_eml_files(spark, scratch):
    d = os.path.join(scratch, "mail")
    os.makedirs(d)
    with open(os.path.join(d, "a.eml"), "wb") as f:
        f.write(EML)
    body = M.parts_to_body(SM.read_eml_files(spark, d)).first()
    assert body.subject == "Café news" and body.body == "Hello & bye"


def test_headers_equal_the_parsers(spark):
    mails = [EML, b"From: =?utf-8?q?Caf=C3=A9?= <A@x.example>\nSubject: =?utf-8?b?Q2Fmw6k=?= and\n\tmore\nSUBJECT: second\n\nSubject: in the body\n",
             b"From: a@x.example\r\n\r\nDate: in the body\r\n", b"\r\nFrom: body@x.example\r\n", b"", b"Subject: =?nope?b?Q2Fm?= x\n\n.", b"Subject: caf\xe9\n\n."]
    raw = spark.createDataFrame([(i, bytearray(m)) for i, m in enumerate(mails)] + [(99, None)], "idx long, content binary")
    got = {r.idx: r for r in SM.decode_headers(SM.message_headers(raw)).collect()}
    parsed = {r.idx: r for r in SM.message_parts(raw.filter("idx < 5")).collect()}
    for i, p in parsed.items():
        assert [got[i][c] for c in SM.HEADERS] == [p[c] for c in SM.HEADERS]
    assert set(parsed) == {0, 1, 2, 3, 4} and got[1].subject == "Café and\tmore" and got[1].from_header == "Café <A@x.example>"
    assert got[5].subject == "=?nope?b?Q2Fm?= x" and got[6].subject == "caf\ufffd" and got[99].subject == ""


def test_senders_are_matched_without_a_shuffle(spark):
    registry = spark.createDataFrame([(0, "plain", "A@x", None, "c0"), (1, "needle", "a@X", "News", "c1"), (2, "late", "a@x", "news", "c2"), (3, "only", "b@x", "q", "c3")],
                                     "ordinal int, name string, sender string, subject_contains string, category string")
    m = spark.createDataFrame([(1, "N <a@x>", "the NEWS"), (2, "A@X", None), (3, "b@x", "none"), (4, "c@x", "news"), (5, None, "news"), (1, "b@x", "Q")],
                              "idx long, from_header string, subject string")
    out = M.match_senders(M.from_registered(m, registry), registry)
    assert sorted((r.idx, r.source, r.category, r["from"]) for r in out.collect()) == [(1, "needle", "c1", "a@x"), (1, "only", "c3", "b@x"), (2, "plain", "c0", "a@x")]


def test_cache_listing(spark, scratch):
    day = os.path.join(scratch, "cache", "2024-01-30")
    os.makedirs(day)
    for n in ("aihot.json", "run-manifest.json"):
        with open(os.path.join(day, n), "w") as f:
            f.write("{}")
    rows = {r.name: r for r in INV.list_cache(spark, os.path.join(scratch, "cache")).collect()}
    assert set(rows) == {"aihot.json", "run-manifest.json"} and str(rows["aihot.json"].dt) == "2024-01-30"


def test_feed_files(spark, scratch):
    p = os.path.join(scratch, "feed.xml")
    with open(p, "w") as f:
        f.write("<rss><channel><item><title>A &amp; B</title><link>https://e/1</link>"
                "<description>d</description><pubDate>Mon, 29 Jan 2024 10:00:00 +0000</pubDate></item>"
                "<item><title>C</title><link>https://e/2</link><summary>s</summary></item></channel></rss>")
    rows = sorted(SF.read_feed_files(spark, p).collect(), key=lambda r: r.link)
    assert [(r.title, r.summary) for r in rows] == [("A & B", "d"), ("C", "s")]


def test_partitioned_listing_and_notes(spark, scratch):
    root = os.path.join(scratch, "listed")
    rows = [("2024-01-30", "run-manifest.json", '{"status": "ok"}'), ("2024-01-30", "aihot.json", "[]"), ("2024-01-29", "raw.md", "# n"),
            ("2024-01-29", "x.tmp", "")]
    spark.createDataFrame(rows, "day string, name string, text string").write.partitionBy("day", "name").text(root)
    listed = INV.list_cache(spark, root, partitioned=True)
    got = {(str(r.dt), r.name): r for r in listed.collect()}
    assert set(got) == {(d, n) for d, n, _ in rows} and got["2024-01-29", "raw.md"].size_bytes == 4
    assert [k for k, r in got.items() if r.content is not None] == [("2024-01-30", "run-manifest.json")]
    notes = {str(r.dt): r for r in INV.note_state(listed, listed).collect()}
    assert notes["2024-01-29"].raw_note_exists and notes["2024-01-29"].raw_note_bytes == 4
    assert not notes["2024-01-29"].summary_note_exists and not notes["2024-01-30"].raw_note_exists


def test_payload_pages_keep_corrupt_files_apart(spark, scratch):
    root = os.path.join(scratch, "pages")
    bodies = {0: '{"items": [{"id": "a"},\n {"id": "b", "score": 2}], "hasNext": true, "nextCursor": "c1"}', 1: '{"items": [{"id": "lost"}, {"id',
              2: '{"items": [], "hasNext": true, "nextCursor": "c3"}', 3: ""}
    for page, body in bodies.items():
        os.makedirs(os.path.join(root, "dt=2024-01-30", f"page={page}"))
        with open(os.path.join(root, "dt=2024-01-30", f"page={page}", "p.json"), "w") as f:
            f.write(body)
    pages = P.read_payloads(spark, root, P.PAGE_SCHEMA)
    items = P.page_items(pages).orderBy("page", "pos").select("page", "pos", "id", "score").collect()
    assert [tuple(r) for r in items] == [(0, 0, "a", None), (0, 1, "b", 2)]
    s = P.page_stats(pages).first()
    assert (s.bad_pages, s.last_next_cursor, s.truncated) == (1, "c3", True)
    assert P.read_payloads(spark, os.path.join(scratch, "nowhere"), P.PAGE_SCHEMA).count() == 0


def test_snapshots_and_projects(spark, scratch):
    root = os.path.join(scratch, "snap")
    lines = ['{"syncTaskBean": {"update": [{"id": "t1", "tags": ["a/b"]}]}, "tags": [{"name": "a/b", "parent": "a"}]}',
             '{"syncTaskBean": {"update": [{"id": "t2"', '{"tags": [{"name": "a/b", "parent": "a"}, {"name": "c"}]}']
    spark.createDataFrame([(x,) for x in lines], "text string").coalesce(1).write.text(root)
    snap = P.read_payloads(spark, root, P.SNAPSHOT_SCHEMA, multiline=False)
    assert [r.id for r in P.snapshot_tasks(snap).collect()] == ["t1"]
    assert sorted((r.name, r.parent) for r in P.snapshot_tags(snap).collect()) == [("a/b", "a"), ("c", None)]
    root = os.path.join(scratch, "proj")
    lines = ['{"project": {"id": "p", "name": "P"}, "tasks": [{"id": "1"}, {"id": "2"}], "columns": [{"id": "x"}, {"id": "y"}]}',
             '{"project": {"id": "p", "name": "P"}, "tasks": [{"id": "3"}], "columns": [{"id": "x"}]}', '{"project": {"id": "q", "name": "Q"}}', '{"proj']
    spark.createDataFrame([(x,) for x in lines], "text string").coalesce(1).write.text(root)
    got = P.project_sizes(P.read_payloads(spark, root, P.PROJECT_SCHEMA, multiline=False)).collect()
    assert sorted((r.id, r.name, r.open_tasks, r.n_columns) for r in got) == [("p", "P", 3, 2), ("q", "Q", 0, 0)]


def _stamps(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def test_resume_rewrites_only_unfinished_partitions(spark, scratch):
    path = os.path.join(scratch, "sink")
    items = spark.createDataFrame([(d, s, "k", i, "bad" if i == 3 else None) for d in (1, 2) for s in ("aihot", "bestblogs") for i in range(6)],
                                  "d int, source string, kind string, idx long, reason string").selectExpr("date_add(date'2024-01-28', d) as dt", "* except (d)")
    P.write_normalized(items, path)
    before = _stamps(path)
    states = spark.createDataFrame([(1, "aihot", "raw_only", True), (1, "bestblogs", "complete", True), (2, "aihot", "complete", True), (2, "rss", "raw_only", False)],
                                   "d int, source string, status string, is_heavy boolean").selectExpr("date_add(date'2024-01-28', d) as dt", "* except (d)")
    fewer = items.filter("idx < 3")                       # the new payload no longer has its dropped row
    todo = P.resume_normalized(fewer, states, path).collect()
    assert [(str(r.dt), r.source) for r in todo] == [("2024-01-29", "aihot")]
    after = _stamps(path)
    mine = "dt=2024-01-29/source=aihot/"
    assert {f: t for f, t in before.items() if mine not in f} == {f: t for f, t in after.items() if mine not in f}
    got = {(str(r.dt), r.source): r["count"] for r in P.read_normalized(spark, path).groupBy("dt", "source").count().collect()}
    assert got == {("2024-01-29", "aihot"): 3, ("2024-01-29", "bestblogs"): 6, ("2024-01-30", "aihot"): 6, ("2024-01-30", "bestblogs"): 6}
    P.resume_normalized(fewer, states.filter("status = 'complete'"), path)
    assert _stamps(path) == after                         # nothing to do: no file touched


def test_notes_are_appended_never_rewritten(spark, scratch):
    path = os.path.join(scratch, "notes")
    lines = spark.sql("""select date'2024-01-30' as dt, source, line, struct(at is null as undated, cast(at as timestamp) as at, cast(idx as long) as idx) as ord
                         from values ('rss', 'b', null, 1), ('rss', 'a', '2024-01-30 10:00:00', 2), ('rss', 'a', '2024-01-30 09:00:00', 3),
                         ('aihot', 'a', null, 4) as t(source, line, at, idx)""")
    P.append_notes(lines.filter("source = 'rss'"), path)
    before = _stamps(path)
    P.append_notes(lines, path)
    assert before.items() <= _stamps(path).items()
    got = P.read_notes(spark, path).orderBy("source", "ord").collect()
    assert [(r.source, r.line) for r in got] == [("aihot", "a"), ("rss", "a"), ("rss", "b")]


def test_cache_folder_is_written_and_listed_by_many_tasks(spark, scratch):
    from pyspark.sql import functions as F
    from quillstream.plans import landed as L
    spark.createDataFrame([(i, 10) for i in range(300)], "doc_id long, n_chars long").write.parquet(f"{scratch}/documents.parquet")
    conf = "spark.sql.sources.parallelPartitionDiscovery.threshold"
    before, root = spark.conf.get(conf), L.cache_folder(spark, scratch)
    files = spark.read.format("binaryFile").load(root)
    assert files.select(F.regexp_extract("path", r"part-(\d+)", 1)).distinct().count() > 1
    listed = INV.list_cache(spark, root, partitioned=True)
    assert spark.conf.get(conf) == before and listed.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert listed.count() == files.select("day", "name").distinct().count() == files.count()
    assert listed.filter("content is not null and name in ('run-manifest.json', 'run-metadata.json')").count() == listed.filter("content is not null").count() > 0


def test_cache_written_and_listed_by_plain_files_equals_sparks(spark, scratch, monkeypatch):
    day = "2024-01-30"
    rows = [(day, "run-manifest.json", '{"status": "né"}'), (day, "a b%=:x.json", "[]"), (day, None, "t"), (None, "run-metadata.json", "{}"),
            (None, None, None), ("2024-01-29", "run-metadata.json", "{bad"), ("2024-01-29", "_hidden", "x"), ("2024-01-29", "", "x")]
    files = spark.createDataFrame(rows, "day string, name string, text string")
    plain, sparks = os.path.join(scratch, "plain"), os.path.join(scratch, "sparks")
    INV.write_cache(files.repartition(3), plain)
    files.write.partitionBy("day", "name").text(sparks)
    names = lambda root: sorted(os.path.relpath(d, root) for d, _, fs in os.walk(root) if any(f.startswith("part-") for f in fs))
    assert names(plain) == names(sparks) and sum(len(fs) for _, _, fs in os.walk(plain)) == len(rows)      # no checksum files or leftovers
    listing = lambda root: sorted((str(r.dt), str(r.name), r.size_bytes, r.modified_at is None, r.content) for r in INV.list_cache(spark, root, True).collect())
    got = listing(plain)
    assert listing(sparks) == got and len(got) == len(rows)
    assert not INV.list_cache(spark, plain, True).inputFiles()         # the driver holds no list of files
    monkeypatch.setattr(INV, "_mounted", lambda *_: None)              # Spark's own listing and writer
    assert listing(plain) == listing(sparks) == got
    INV.write_cache(files, os.path.join(scratch, "other"))
    assert listing(os.path.join(scratch, "other")) == got


def test_empty_cache_has_no_rows(spark, scratch):
    root = os.path.join(scratch, "empty-cache")
    INV.write_cache(spark.createDataFrame([], "day date, name string, text string"), root)
    assert INV.list_cache(spark, root, partitioned=True).collect() == []


def test_note_folder_is_written_by_plain_files(spark, scratch):
    from quillstream.plans import landed as L
    spark.createDataFrame([(i, 10) for i in range(0, 70, 7)] + [(None, 1)], "doc_id long, n_chars long").write.parquet(f"{scratch}/documents.parquet")
    root = L.note_folder(spark, scratch)
    assert all(f.startswith("part-") for _, _, fs in os.walk(root.removeprefix("file:")) for f in fs)
    got = sorted((str(r.dt), r.name) for r in INV.list_cache(spark, root, partitioned=True).collect())
    assert len(got) == 7 + 4 and {n for _, n in got} == {"raw.md", "summary.md"}


def test_resume_lists_the_cache_once(spark, monkeypatch):
    from quillstream.plans import normalize_queries as NQ
    from quillstream.plans import runstate_queries as RQ
    rows = [("2024-01-30", "aihot.json"), ("2024-01-30", "bestblogs.json"), ("2024-01-30", "bestblogs-normalized.json"), ("2024-01-29", "aihot.json")]
    listed, count = spark.createDataFrame(rows, "day string, name string"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            count.add(b.num_rows)
            yield b

    seen = listed.mapInArrow(counted, "day string, name string").selectExpr("cast(day as date) as dt", "name", "cast(null as string) as content")
    items = spark.createDataFrame([("2024-01-30", s, "k", i, None) for s in ("aihot", "bestblogs") for i in range(3)],
                                  "dt string, source string, kind string, idx long, reason string").withColumn("dt", F.col("dt").cast("date"))
    monkeypatch.setattr(RQ, "_listed", lambda *_: seen)
    monkeypatch.setattr(NQ, "all_normalized", lambda *_: items)
    got = sorted((str(r.dt), r.source, r.n_rows) for r in RQ.inc_resume(spark, "").collect())
    assert got == [("2024-01-29", "aihot", 0), ("2024-01-30", "aihot", 3)]
    assert count.value == len(rows)


def test_parts_go_back_in_bounded_pieces_and_a_header_value_is_parsed_once(monkeypatch):
    import pyarrow as pa
    from email.headerregistry import ContentTypeHeader
    body, parsed, parse = "x" * (SM.PIECE_BYTES // 4), [], ContentTypeHeader.parse.__func__
    monkeypatch.setattr(ContentTypeHeader, "parse", classmethod(lambda cls, value, kwds: (parsed.append(value), parse(cls, value, kwds))[1]))
    raw = [f"From: a@x\r\nSubject: s{i}\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n{body}".encode() for i in range(10)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(11), pa.int64()), pa.array([*raw, None], pa.binary())], ["idx", "content"])
    pieces = list(SM._parse_batches(iter([batch])))
    assert [p.num_rows for p in pieces] == [4, 4, 2] and len(parsed) == 1
    rows = [r for p in pieces for r in p.to_pylist()]
    assert [(r["idx"], r["subject"], r["part_idx"], r["content_type"]) for r in rows] == [(i, f"s{i}", 0, "text/plain") for i in range(10)]
    assert {r["content"] for r in rows} == {body}
