"""Adapter views: deterministic mappings from the driver tables to the model
tables of the digest and task engines (SURVEY section 5).

Each adapter derives every row of the model table from a row (or a join) of
the driver tables, so the work grows with the input. The same rules are
written in SQL in ``plans/oracle.py`` for the DuckDB check.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import DIGEST_SOURCES
from ..session import spread, table

# Fixed run parameters of the adapter world.
AS_OF = _dt.datetime(2024, 1, 31, 0, 0, 0)          # wall clock of the digest run, UTC
AS_OF_EPOCH = 1706659200                             # same instant in epoch seconds
TARGET_DATE = _dt.date(2024, 1, 30)                  # digest day (local)
FOCUS_DAY = _dt.date(2024, 1, 15)                    # "today" for focus/task queries
TASK_TODAY = _dt.date(1998, 6, 1)                    # "today" for due-date queries on orders


def as_of_col() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def _case(key: Column, values) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(key == i, F.lit(v)) if expr is None else expr.when(key == i, F.lit(v))
    return expr


def digest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised digest items from ``documents`` (one item per document)."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars"), "doc_id")
    doc = F.col("doc_id")
    src = _case(doc % 6, DIGEST_SOURCES)
    fb_kind = _case(F.expr("doc_id div 6") % 3, ("tweet", "podcast_episode", "blog_post"))
    kind = (F.when(src == "rss", "rss_entry").when(src == "email", "newsletter")
            .when(src == "follow-builders", fb_kind).when(src == "bestblogs", "article_candidate")
            .when(src == "ak-rss-digest", "rss_article").otherwise("aihot_item"))
    ts = F.timestamp_seconds(F.lit(AS_OF_EPOCH) - (doc % 45) * 86400 + (doc * 7919) % 86400)
    fmt = doc % 7
    published = (F.when(doc % 13 == 0, F.lit(None).cast("string"))
                 .when(fmt == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
                 .when(fmt == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
                 .when(fmt == 2, F.date_format(ts, "MMM dd, yyyy"))
                 .when(fmt == 3, F.date_format(ts, "yyyy-MM-dd"))
                 .when(fmt == 4, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
                 .when(fmt == 5, F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss '+0000'"))
                 .otherwise(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")))
    bb_status = _case(F.expr("doc_id div 6") % 5,
                      ("needs_deep_read", "summary_only", "deferred_rate_limited", "ready", "ready"))
    url = F.when(doc % 10 != 0, F.concat(F.lit("https://news.example.com/"), src, F.lit("/"),
                                          doc.cast("string")))
    summary = F.when(doc % 4 == 1, F.concat(F.col("text"), F.lit(" https://t.example.com/"), doc.cast("string"))
                     ).otherwise(F.col("text"))
    return d.select(
        F.lit(TARGET_DATE).alias("dt"),
        src.alias("source"),
        kind.alias("kind"),
        doc.alias("idx"),
        F.substring_index("text", "\n", 1).alias("title"),
        url.alias("url"),
        summary.alias("summary"),
        F.col("source").alias("source_name"),
        F.when(src.isin("bestblogs", "aihot"), (F.col("n_chars") % 101).cast("double")).alias("score"),
        F.when(src == "bestblogs", bb_status).otherwise(F.lit("ready")).alias("status"),
        _case(doc % 3, ("high", "medium", "low")).alias("confidence"),
        published.alias("published_at"),
        ts.alias("event_ts"),
        F.when(kind == "tweet", (doc % 5).cast("int")).alias("signal_score"),
        F.when(kind == "tweet", F.col("n_chars") % 50).alias("likes"),
        F.when(kind == "tweet", doc % 7).alias("retweets"),
        F.when(kind == "tweet", doc % 3).alias("replies"),
    )


# ---------------- task service ----------------

_SERVICE_FMT = "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'"


def _priority_from_order(col: Column) -> Column:
    d = F.substring(col, 1, 1)
    return (F.when(d.isin("1", "2"), 5).when(d == "3", 3).when(d == "4", 0)
            .when(d == "5", 1).otherwise(0)).cast("int")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task snapshot from ``orders`` x ``customer`` x ``nation``: one task per
    order; project = market segment; due = order date; status 2 for filled
    orders; tags = [segment, segment/nation]."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("o_orderkey")
    seg = F.lower(F.col("c_mktsegment"))
    odate = F.col("o_orderdate").cast("timestamp")      # stored without zone: read as UTC
    due_ts = F.timestamp_seconds(F.unix_seconds(odate) + (k % 24) * 3600)
    due = (F.when(k % 11 == 0, F.lit(None).cast("string"))
           .when(k % 11 == 1, F.date_format(odate, "yyyy-MM-dd"))
           .otherwise(F.date_format(due_ts, _SERVICE_FMT)))
    project = (F.when(k % 17 == 0, F.lit(None).cast("string"))
               .when(k % 17 == 1, F.concat(F.lit("inbox"), k.cast("string")))
               .when(k % 17 == 2, F.concat(F.lit("gone-"), seg))
               .otherwise(F.concat(F.lit("P-"), seg)))
    done = F.col("o_orderstatus") == "F"
    completed = F.when(done, F.date_format(F.timestamp_seconds(F.unix_seconds(odate) + k % 86400),
                                           _SERVICE_FMT))
    tags = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(
        F.array(seg, F.concat(F.col("c_mktsegment"), F.lit("/"), F.col("n_name"))))
    return (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
            .select(
                F.concat(F.lit("T"), k.cast("string")).alias("id"),
                project.alias("project_id"),
                F.concat(F.lit("C-"), seg, F.lit("-"), (k % 3).cast("string")).alias("column_id"),
                F.concat(F.col("c_name"), F.lit(" order "), k.cast("string")).alias("title"),
                F.concat(F.col("o_orderpriority"), F.lit(" "), F.col("n_name")).alias("content"),
                _priority_from_order(F.col("o_orderpriority")).alias("priority"),
                due.alias("due_date"),
                tags.alias("tags"),
                F.when(done, 2).otherwise(0).cast("int").alias("status"),
                completed.alias("completed_time"),
                k.alias("order_key"),
            ))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects: one per market segment found in ``customer``."""
    seg = F.col("c_mktsegment")
    views = F.when(F.length(seg) % 3 == 0, "list").when(F.length(seg) % 3 == 1, "kanban").otherwise("timeline")
    return (table(spark, sf_dir, "customer").select(seg).distinct()
            .select(F.concat(F.lit("P-"), F.lower(seg)).alias("id"),
                    F.concat(F.upper(F.substring(seg, 1, 1)), F.lower(F.substring(seg, 2, 1000))).alias("name"),
                    F.concat(F.lit("#"), F.substring(F.md5(seg), 1, 6)).alias("color"),
                    views.alias("view_mode")))


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board columns: three per project."""
    p = projects(spark, sf_dir)
    return (p.select("id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n"))
            .select(F.concat(F.lit("C-"), F.substring(F.col("id"), 3, 100), F.lit("-"), F.col("n").cast("string")).alias("id"),
                    F.col("id").alias("project_id"),
                    F.element_at(F.array(F.lit("Todo"), F.lit("Doing"), F.lit("Done")), F.col("n") + 1).alias("name")))


def checklist_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with checklist items: the lines of each order (at most 7) as items."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus")
    items = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        F.col("l_linenumber").alias("pos"),
        F.concat(F.lit("I"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("id"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("title"),
        F.when(F.col("l_linestatus") == "F", 2).otherwise(0).cast("int").alias("status"),
        F.lit(None).cast("string").alias("completed_time"),
    ))).alias("items"))
    t = tasks(spark, sf_dir)
    return t.join(items, t.order_key == items.l_orderkey, "left").drop("l_orderkey")


# ---------------- focus sessions ----------------

def focus_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Focus sessions from ``events``: start = ts, focused minutes =
    floor(value), pause = (event_id % 5) minutes, one task per session
    (user), project = event type, tag = props.k."""
    e = table(spark, sf_dir, "events")
    mins = F.floor(F.col("value")).cast("long")
    pause = (F.col("event_id") % 5) * 60
    start = F.col("ts").cast("timestamp")      # stored without zone: read as UTC
    end = F.timestamp_seconds(F.unix_seconds(start) + mins * 60 + pause)
    task = F.struct(F.concat(F.lit("task-"), F.col("user_id").cast("string")).alias("id"),
                    F.concat(F.lit("Task "), F.col("user_id").cast("string")).alias("title"),
                    F.col("event_type").alias("project_name"),
                    F.array(F.concat(F.lit("k"), F.get_json_object("props", "$.k"))).alias("tags"))
    return e.select(
        F.col("event_id").alias("id"),
        (F.col("event_id") % 2).cast("int").alias("type"),
        F.lit(1).alias("status"),
        F.date_format(start, _SERVICE_FMT).alias("start_time"),
        F.date_format(end, _SERVICE_FMT).alias("end_time"),
        pause.cast("long").alias("pause_sec"),
        F.array(task).alias("tasks"),
    )


# ---------------- landed raw payloads (one JSON element per row) ----------------

def _line(n: int) -> Column:
    """n-th line of the document text ('' when absent)."""
    return F.coalesce(F.try_element_at(F.split(F.col("text"), "\n"), F.lit(n)), F.lit(""))


def candidate_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated-candidate payload elements (JSON text per element); every 29th
    element is a bare string instead of an object."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    doc = F.col("doc_id")
    obj = F.to_json(F.struct(
        F.when(doc % 23 == 0, F.lit("")).otherwise(_line(1)).alias("title"),
        F.when(doc % 5 == 0, F.lit(None)).otherwise(_line(2)).alias("selectionReason"),
        F.when(doc % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("R"), doc.cast("string"))).alias("resourceId"),
        F.when(doc % 3 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("https://blogs.example.com/r/"), doc.cast("string"))).alias("readUrl"),
        F.col("source").alias("sourceName"),
        (F.col("n_chars") % 101).cast("double").alias("score"),
        F.col("lang").alias("language"),
        F.when(doc % 2 == 0, "featured").otherwise("search").alias("candidateSource"),
        (doc % 10 == 3).alias("fallbackApplied"),
        (doc % 4 == 2).alias("personalized"),
    ))
    raw = F.when(doc % 29 == 0, F.concat(F.lit('"junk-'), doc.cast("string"), F.lit('"'))).otherwise(obj)
    return d.select(F.lit(TARGET_DATE).alias("dt"), F.lit("bestblogs").alias("source"),
                    doc.alias("idx"), raw.alias("raw"))


def deep_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed detail-read responses per resource id (stdout, stderr, return
    code); the outcome kind cycles with the document id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    doc = F.col("doc_id")
    kind = doc % 6
    meta_url = F.when(kind == 0, F.concat(F.lit("https://origin.example.com/a/"), doc.cast("string")))
    ok_json = F.to_json(F.struct(F.lit(True).alias("success"), F.struct(F.struct(
        meta_url.alias("url"),
        F.concat(F.lit("https://blogs.example.com/read/"), doc.cast("string")).alias("readUrl"),
        _line(3).alias("oneSentenceSummary"),
        F.lit(None).cast("string").alias("summary"),
        F.lit("featured").alias("featuredReason"),
        F.array(F.lit("a1")).alias("authors"), F.array(F.lit("t1")).alias("tags"),
        F.lit("2024-01-29 08:00:00").alias("publishDateTimeStr"), F.lit(True).alias("qualified"),
        F.lit("done").alias("processFlowStatus")).alias("meta"),
        F.concat(F.lit("read 429 words of "), doc.cast("string")).alias("markdown")).alias("data")))
    stdout = (F.when(kind <= 1, ok_json).when(kind == 2, F.lit(""))
              .when(kind == 3, F.lit("")).when(kind == 4, F.lit("{not json"))
              .otherwise(F.lit('{"success": true, "data": {}}')))
    stderr = (F.when(kind == 2, F.lit("RATE_LIMITED: quota exceeded"))
              .when(kind == 3, F.lit("boom")).otherwise(F.lit("")))
    rc = F.when(kind.isin(2, 3), F.lit(1)).otherwise(F.lit(0))
    return d.select(F.concat(F.lit("R"), doc.cast("string")).alias("resource_id"),
                    stdout.alias("stdout"), stderr.alias("stderr"), rc.alias("returncode"))


def builder_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builder posts: one builder per document (name = source, bio = language
    line), one post per text line; some posts are URL-only, some carry a
    low-signal phrase, some lack a URL."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    b = d.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    doc, pos = F.col("doc_id"), F.col("pos")
    key = doc + pos
    text = (F.when(key % 11 == 0, F.concat(F.lit("https://x.example.com/s/"), doc.cast("string"), F.lit("/"), pos.cast("string")))
            .when(key % 13 == 0, F.concat(F.col("line"), F.lit(" Sign up here")))
            .otherwise(F.col("line")))
    url = F.when(key % 17 != 0, F.concat(F.lit("https://x.example.com/"), F.col("source"), F.lit("/status/"),
                                         doc.cast("string"), F.lit("-"), pos.cast("string")))
    return b.select(
        F.lit(TARGET_DATE).alias("dt"), doc.alias("builder_idx"), pos.alias("idx"),
        F.col("source").alias("builder_name"), F.concat(F.lit("@"), F.col("source")).alias("handle"),
        F.concat(F.lit("builder writing in "), F.col("lang")).alias("bio"),
        F.concat(doc.cast("string"), F.lit("-"), pos.cast("string")).alias("tweet_id"),
        text.alias("text"), url.alias("url"),
        F.date_format(F.timestamp_seconds(F.lit(AS_OF_EPOCH) - (key % 72) * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        (key % 50).alias("likes"), (key % 7).alias("retweets"), (key % 3).alias("replies"),
        (key % 19 == 0).alias("is_quote"),
    )


def podcast_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript lines of podcast episodes: one episode per conversation,
    transcript = ``Speaker <role> - <text>`` per turn in turn order."""
    c = table(spark, sf_dir, "conversations")
    turn_line = F.concat(F.lit("Speaker "), F.col("role"), F.lit(" - "), F.col("text"))
    return c.select("conv_id", "turn", turn_line.alias("turn_text"))


def podcast_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episode headers: one per conversation; every 9th lacks a URL."""
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    cid = F.col("conv_id")
    return c.select(F.lit(TARGET_DATE).alias("dt"), cid.alias("idx"),
                    F.concat(F.lit("Episode "), cid.cast("string")).alias("title"),
                    F.when(cid % 9 != 0, F.concat(F.lit("https://pod.example.com/ep/"), cid.cast("string"))).alias("url"),
                    F.concat(F.lit("guid-"), cid.cast("string")).alias("guid"),
                    F.lit("Builders Pod").alias("name"),
                    F.date_format(F.timestamp_seconds(F.lit(AS_OF_EPOCH) - (cid % 10) * 86400),
                                  "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"))


def blog_posts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blog payload rows from ``pages``: every 4th blog has no ``posts`` list
    (the blog itself is the post); others list one or two posts."""
    p = spread(table(spark, sf_dir, "pages"), "page_id")
    pid = F.col("page_id")
    title = F.regexp_extract("html", r"<title>(.*?)</title>", 1)
    para = F.regexp_extract("html", r"(?s)<p>(.*?)</p>", 1)
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    post1 = F.struct(title.alias("title"), F.col("url").alias("url"), F.lit(None).cast("string").alias("link"),
                     F.lit(None).cast("string").alias("summary"), para.alias("description"),
                     F.lit(None).cast("string").alias("content"), F.lit("2024-01-29T10:00:00Z").alias("published_at"),
                     host.alias("blog_name"))
    post2 = F.struct(F.lit("").alias("title"), F.concat(F.col("url"), F.lit("#2")).alias("url"),
                     F.lit(None).cast("string").alias("link"), F.lit(None).cast("string").alias("summary"),
                     F.lit(None).cast("string").alias("description"), F.col("html").alias("content"),
                     F.lit(None).cast("string").alias("published_at"), host.alias("blog_name"))
    self_post = F.struct(title.alias("title"), F.lit(None).cast("string").alias("url"), F.col("url").alias("link"),
                         F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("description"),
                         F.col("html").alias("content"), F.lit(None).cast("string").alias("published_at"),
                         host.alias("blog_name"))
    posts = (F.when(pid % 4 == 0, F.lit(None))
             .when(pid % 3 == 0, F.array(post1, post2)).otherwise(F.array(post1)))
    return p.select(F.lit(TARGET_DATE).alias("dt"), pid.alias("idx"), host.alias("name"),
                    posts.alias("posts"), self_post.alias("self_post"))


def rss_digest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregated-RSS payload items: one per document; every 8th lacks a link."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    doc = F.col("doc_id")
    ts = F.timestamp_seconds(F.lit(AS_OF_EPOCH) - (doc % 20) * 43200)
    return d.select(F.lit(TARGET_DATE).alias("dt"), doc.alias("idx"),
                    F.when(doc % 19 == 0, F.lit("")).otherwise(_line(1)).alias("title"),
                    F.when(doc % 8 != 0, F.concat(F.lit("https://feeds.example.com/"), F.col("source"), F.lit("/"),
                                                  doc.cast("string"))).alias("link"),
                    F.col("text").alias("summary"), F.col("source").alias("feed_name"),
                    F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com")).alias("site_url"),
                    F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/feed")).alias("feed_url"),
                    F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
                    F.date_format(F.from_utc_timestamp(ts, "Asia/Shanghai"), "yyyy-MM-dd HH:mm").alias("published_local"))


def hot_items_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot-item API items before the date filter: publishedAt missing for
    every 13th, invalid for every 17th, else spread over three days."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    doc = F.col("doc_id")
    ts = F.timestamp_seconds(F.lit(AS_OF_EPOCH) - 16 * 3600 - (doc * 3607) % (3 * 86400) + 86400)
    pub = (F.when(doc % 13 == 0, F.lit(None).cast("string")).when(doc % 17 == 0, F.lit("not-a-date"))
           .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    cats = F.element_at(F.array(*[F.lit(c) for c in ("ai-models", "ai-products", "industry", "paper", "tip")]),
                        (doc % 5 + 1).cast("int"))
    return d.select(F.lit(TARGET_DATE).alias("dt"), doc.alias("idx"),
                    F.concat(F.lit("H"), doc.cast("string")).alias("id"),
                    F.when(doc % 31 == 0, F.lit("")).otherwise(_line(1)).alias("title"),
                    F.when(doc % 12 == 5, F.lit(None)).otherwise(F.concat(F.lit("https://hot.example.com/i/"), doc.cast("string"))).alias("url"),
                    F.col("source").alias("source_name"), pub.alias("published_at"),
                    _line(2).alias("summary"), cats.alias("category"),
                    (F.col("n_chars") % 100).cast("int").alias("score"),
                    (doc % 3 == 0).alias("selected"),
                    F.substring(_line(1), 1, 20).alias("title_en"))


# ---------------- feeds ----------------

ERROR_FEEDS = ("src7", "src13")     # feeds whose fetch failed in the landed payload


def _xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def feed_entries_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed entries as landed: one feed per document source, one entry per
    document, RFC 2822 ``published`` (missing for every 13th; then an ISO
    ``updated`` for half of those). Entries span two days around the target."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    doc = F.col("doc_id")
    ts = F.timestamp_seconds(F.lit(AS_OF_EPOCH) - 2 * 86400 + (doc * 7919) % (2 * 86400))
    published = F.when(doc % 13 != 0, F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss '+0000'"))
    updated = F.when((doc % 13 == 0) & (doc % 2 == 0), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    cat = F.element_at(F.array(F.lit("AI"), F.lit("Tech"), F.lit("Research")),
                       (F.length("source") % 3 + 1).cast("int"))
    return d.select(
        doc.alias("idx"), F.col("source").alias("feed_name"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/rss.xml")).alias("feed_url"),
        cat.alias("category"),
        F.when(F.col("source").isin(*ERROR_FEEDS), F.lit("<unclosed token")).alias("error"),
        _line(1).alias("title"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/p/"), doc.cast("string")).alias("link"),
        F.col("text").alias("summary"), published.alias("published"), updated.alias("updated"))


def feed_item_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same entries as RSS ``<item>`` XML text; items of the failing
    feeds are cut short (malformed)."""
    e = feed_entries_raw(spark, sf_dir)
    xml = F.concat(F.lit("<item><title>"), _xml_escape(F.col("title")), F.lit("</title><link>"), F.col("link"),
                   F.lit("</link><description>"), _xml_escape(F.col("summary")), F.lit("</description>"),
                   F.when(F.col("published").isNotNull(),
                          F.concat(F.lit("<pubDate>"), F.col("published"), F.lit("</pubDate>"))).otherwise(F.lit("")),
                   F.lit("</item>"))
    xml = F.when(F.col("error").isNotNull(), F.substring(xml, 1, 40)).otherwise(xml)
    return e.select("idx", "feed_name", "feed_url", "category", xml.alias("xml"))


# ---------------- mail ----------------

def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RFC 822 messages built from every row of ``documents`` (plain part) and
    ``pages`` (HTML part), matched by equal ids; every 3rd message with an
    HTML part has no plain part, every 13th message no Date header, every 7th
    an attachment."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    doc = F.coalesce("doc_id", "page_id")
    j = d.join(p, d.doc_id == p.page_id, "full").withColumn(
        "source", F.coalesce("source", F.concat(F.lit("src"), (doc % 20).cast("string"))))
    ts = F.timestamp_seconds(F.lit(AS_OF_EPOCH) - 2 * 86400 + (doc * 6007) % (3 * 86400))
    date_hdr = F.when(doc % 13 != 0, F.concat(F.lit("Date: "), F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss '+0000'"),
                                              F.lit("\r\n"))).otherwise(F.lit(""))
    boundary = F.concat(F.lit("b"), doc.cast("string"))
    plain = F.when(F.col("text").isNotNull() & ((doc % 3 != 0) | F.col("html").isNull()), F.concat(
        F.lit("--"), boundary, F.lit("\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"),
        F.col("text"), F.lit("\r\n"))).otherwise(F.lit(""))
    html = F.when(F.col("html").isNotNull(), F.concat(
        F.lit("--"), boundary, F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"),
        F.col("html"), F.lit("\r\n"))).otherwise(F.lit(""))
    attach = F.when(doc % 7 == 0, F.concat(
        F.lit("--"), boundary, F.lit("\r\nContent-Type: text/plain\r\nContent-Disposition: attachment; filename=a.txt\r\n\r\nattached notes\r\n")
    )).otherwise(F.lit(""))
    msg = F.concat(
        F.lit("From: "), F.initcap(F.col("source")), F.lit(" Weekly <"), F.col("source"), F.lit("@mail.example.com>\r\n"),
        F.lit("To: reader@example.com\r\nSubject: "),
        F.coalesce(F.substring(_line(1), 1, 60), F.concat(F.lit("Page "), doc.cast("string"))), F.lit("\r\n"), date_hdr,
        F.lit("Message-ID: <"), doc.cast("string"), F.lit("@mail.example.com>\r\nMIME-Version: 1.0\r\n"),
        F.lit("Content-Type: multipart/alternative; boundary=\""), boundary, F.lit("\"\r\n\r\n"),
        plain, html, attach, F.lit("--"), boundary, F.lit("--\r\n"))
    return j.select(doc.alias("idx"), F.encode(msg, "UTF-8").alias("content"))


def mail_registry(spark: SparkSession) -> DataFrame:
    """Newsletter registry (configuration, not data): senders src0..src9 with
    a category and frequency; src3 and src5 have two rows, one with a subject
    needle; src10..src19 are not registered."""
    rows = []
    freqs = ("daily", "weekday", "weekly", "3x_week", "irregular")
    for i in range(10):
        rows.append((len(rows), f"Letter {i}", f"src{i}@mail.example.com", None, ("AI", "Tech")[i % 2], freqs[i % 5]))
        if i in (3, 5):
            rows.append((len(rows), f"Letter {i} special", f"Src{i}@Mail.example.com", "le", "Research", "weekly"))
    return spark.createDataFrame(rows, "ordinal int, name string, sender string, subject_contains string, "
                                       "category string, frequency string")


# ---------------- cache inventory ----------------

RAW_NAME_A = {"rss": "rss-raw.json", "email": "email-raw.json", "follow-builders": "follow-builders.json",
              "bestblogs": "bestblogs.json", "ak-rss-digest": "ak-rss.json", "aihot": "aihot.json"}
RAW_NAME_B = {"rss": "rss-raw.json", "email": "email-raw.json", "follow-builders": "follow-builders.json",
              "bestblogs": "bestblogs.json", "ak-rss-digest": "ak-rss-raw.json", "aihot": "aihot-raw.json"}


def _map_lookup(key: Column, mapping: dict) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr


def cache_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backlog of daily cache folders as a file listing: each document is
    one file (day = (doc_id div 7) % 30 days before the target, source by doc_id % 6,
    file class by doc_id % 5); a folder holds a name once (lowest doc wins).
    Manifest files carry their JSON text; every 7th manifest is corrupt."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    doc = F.col("doc_id")
    src = _case(doc % 6, DIGEST_SOURCES)
    cls = doc % 5
    heavy = src.isin("follow-builders", "bestblogs", "ak-rss-digest", "aihot")
    name = (F.when(cls == 0, _map_lookup(src, RAW_NAME_A))
            .when((cls == 1) & heavy, F.concat(src, F.lit("-normalized.json")))
            .when(cls == 1, F.concat(F.lit("notes-"), doc.cast("string"), F.lit(".md")))
            .when(cls == 2, F.when(doc % 2 == 0, F.lit("run-manifest.json")).otherwise(F.lit("run-metadata.json")))
            .when(cls == 3, F.concat(F.lit("scratch-"), doc.cast("string"), F.lit(".tmp")))
            .otherwise(F.when(doc % 2 == 1, F.lit("websites.json")).otherwise(_map_lookup(src, RAW_NAME_B))))
    statuses = F.array(F.lit("Complete"), F.lit("pending"), F.lit("ready"), F.lit("failed"))
    manifest = F.to_json(F.struct(
        F.lit("running").alias("status"),
        F.create_map(
            F.lit("aihot"), F.struct(F.element_at(statuses, (doc % 4 + 1).cast("int")).alias("status"),
                                     F.lit(None).cast("boolean").alias("completed")),
            F.lit("bestblogs"), F.struct(F.lit(None).cast("string").alias("status"), (doc % 3 == 0).alias("completed")),
            F.lit("rss"), F.struct(F.element_at(statuses, ((doc + 1) % 4 + 1).cast("int")).alias("status"),
                                   F.lit(None).cast("boolean").alias("completed")),
            F.lit("websites"), F.struct(F.lit("ready").alias("status"), F.lit(None).cast("boolean").alias("completed")),
            F.lit("follow-builders"), F.struct(F.element_at(statuses, ((doc + 2) % 4 + 1).cast("int")).alias("status"),
                                               F.lit(None).cast("boolean").alias("completed")),
        ).alias("sources")))
    content = F.when(cls == 2, F.when(doc % 7 == 0, F.lit("{bad json")).otherwise(manifest))
    files = d.select(F.date_sub(F.lit(TARGET_DATE), (F.expr("doc_id div 7") % 30).cast("int")).alias("dt"), name.alias("name"),
                     doc, F.col("n_chars").alias("size_bytes"), content.alias("content"))
    return (files.groupBy("dt", "name")
            .agg(F.min_by(F.struct("doc_id", "size_bytes", "content"), F.col("doc_id")).alias("f"))
            .select("dt", "name", F.col("f.doc_id").alias("doc_id"), F.col("f.size_bytes").alias("size_bytes"),
                    F.timestamp_seconds(F.lit(AS_OF_EPOCH) - F.col("f.doc_id") * 60).alias("modified_at"),
                    F.col("f.content").alias("content")))


def note_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and summary notes per backlog day: the raw note exists unless the
    day index is 2 mod 3; the summary note only when it is 0 mod 3."""
    days = cache_files(spark, sf_dir).select("dt").distinct()
    i = F.datediff(F.lit(TARGET_DATE), F.col("dt"))
    return days.select("dt", (i % 3 != 2).alias("raw_note_exists"), (i % 3 == 0).alias("summary_note_exists"))
