"""Mail and feed operators: part bodies, sender allow-list, date rules,
mail and feed entries, and their compact items.

The allow-list registry is configuration (a few rows per sender), joined with
an explicit broadcast; the choice among a sender's registry rows is made by
array functions in the message's own row.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X

HTML, PLAIN = "text/html", "text/plain"


def parts_to_body(parts: DataFrame) -> DataFrame:
    """src_email_parts_to_body: plain parts (mail-cleaned) joined by a blank
    line win; else HTML parts converted to text; attachments skipped.

    One aggregation per message (headers are equal on all its parts); the
    HTML path, whose entity unescape runs in Python, only sees HTML parts."""
    ok = (F.coalesce("disposition", F.lit("")) != "attachment") & F.col("content_type").isin(PLAIN, HTML)
    is_plain = ok & (F.col("content_type") == PLAIN)
    is_html = ok & (F.col("content_type") == HTML)
    p = parts.select("idx", "message_id", "from_header", "subject", "date", "part_idx",
                     X.clean_text_mail(F.when(is_plain, F.col("content"))).alias("_plain_t"),
                     X.html_to_text(F.when(is_html, F.col("content"))).alias("_html_t"))

    def joined(col):
        return X.strip_ws(F.array_join(F.transform(F.array_sort(F.collect_list(
            F.when(F.coalesce(F.col(col), F.lit("")) != "", F.struct("part_idx", F.col(col).alias("t"))))),
            lambda s: s["t"]), "\n\n"))
    out = p.groupBy("idx").agg(
        F.max("message_id").alias("message_id"), F.max("from_header").alias("from_header"),
        F.max("subject").alias("subject"), F.max("date").alias("date"),
        joined("_plain_t").alias("_plain"), joined("_html_t").alias("_html"))
    body = F.when(F.coalesce("_plain", F.lit("")) != "", F.col("_plain")).otherwise(F.coalesce("_html", F.lit("")))
    return out.withColumn("body", body).drop("_plain", "_html")


def _registry_rows(registry: DataFrame) -> DataFrame:
    """Registry rows of each sender, by ordinal (configuration: a few rows)."""
    row = F.struct("ordinal", F.col("name").alias("source"), "category", F.col("subject_contains").alias("needle"))
    return F.broadcast(registry.groupBy(X.normalize_sender("sender").alias("_sender")).agg(F.array_sort(F.collect_list(row)).alias("_rows")))


def from_registered(messages: DataFrame, registry: DataFrame) -> DataFrame:
    """Messages whose sender is registered, whatever the subject."""
    m = messages.withColumn("_sender", X.normalize_sender("from_header"))
    return m.join(_registry_rows(registry).select("_sender"), "_sender", "left_semi").drop("_sender")


def match_senders(messages: DataFrame, registry: DataFrame) -> DataFrame:
    """jn_sender_allowlist: registry rows of the sender; the first (by
    ordinal) whose needle occurs in the subject, else the first without a
    needle; messages without a match are dropped. A broadcast join and array
    functions: no message is shuffled."""
    m = messages.withColumn("_sender", X.normalize_sender("from_header"))
    j = m.join(_registry_rows(registry), "_sender")
    subject = F.lower(F.coalesce("subject", F.lit("")))

    def has(r):
        return F.coalesce(r["needle"], F.lit("")) != ""
    hit = F.filter("_rows", lambda r: has(r) & subject.contains(F.lower(r["needle"])))
    plain = F.filter("_rows", lambda r: ~has(r))
    row = F.coalesce(F.get(hit, F.lit(0)), F.get(plain, F.lit(0)))
    return (j.withColumn("_r", row).filter("_r is not null").withColumn("source", F.col("_r.source")).withColumn("category", F.col("_r.category"))
            .drop("_rows", "_r").withColumnRenamed("_sender", "from"))


def mail_date_keep(messages: DataFrame, target: _dt.date, zone: str) -> DataFrame:
    """flt_target_date_mail: a missing or unparseable Date keeps the message;
    otherwise its local date must be the target."""
    ts = D.parse_datetime("date", month_names=False)
    return messages.filter(ts.isNull() | (D.local_date(ts, zone) == F.lit(target)))


def _upto(col: str, n: int | None):
    return F.col(col) if n is None else F.substring(col, 1, n)


def mail_entries(matched: DataFrame, max_body_chars: int | None = None, summary_chars: int | None = None) -> DataFrame:
    """Mail payload entries; the body, and the summary taken from it, are
    whole unless a cut is asked for."""
    name = F.regexp_extract("from_header", r"^\s*\"?([^\"<]*?)\"?\s*<", 1)
    cut = matched.withColumn("body", _upto("body", max_body_chars))
    return cut.select("idx", "source", "category", "from", name.alias("from_name"), "subject", "date",
                      "message_id", "body", _upto("body", summary_chars).alias("summary"))


def newsletter_items(entries: DataFrame) -> DataFrame:
    """nrm_newsletters: mail entries -> items ready for compacting (url,
    name, summary and title fallback chains)."""
    cols = set(entries.columns)

    def opt(c):
        return F.col(c) if c in cols else F.lit(None).cast("string")
    url = X.first_nonempty(opt("link"), opt("url"), opt("source_url"))
    name = F.coalesce(X.first_nonempty(opt("newsletter"), opt("source_name"), opt("from_name"), opt("from")),
                      F.lit("Newsletter"))
    summary = F.coalesce(X.first_nonempty(opt("summary"), opt("excerpt"), opt("body_text"), opt("body"), opt("text")),
                         F.lit(""))
    title = F.coalesce(X.first_nonempty(opt("title"), opt("subject")), X.clean_text_nourl(summary, 80))
    return entries.select(
        F.lit("email").alias("source"), "idx", F.lit("newsletter").alias("kind"), title.alias("title"),
        url.alias("url"), summary.alias("summary"), name.alias("source_name"),
        X.first_nonempty(opt("date"), opt("published_at")).alias("published_at"))


def feed_date_keep(entries: DataFrame, target: _dt.date, zone: str) -> DataFrame:
    """flt_target_date_feed: published, else updated, must fall on the target
    local date; entries without either are dropped silently."""
    ts = F.coalesce(D.parse_datetime("published", month_names=False), D.parse_datetime("updated", month_names=False))
    return entries.filter(ts.isNotNull() & (D.local_date(ts, zone) == F.lit(target)))


def feed_items(entries: DataFrame, summary_chars: int | None = None) -> DataFrame:
    """nrm_feed_entries: feed entries -> items ready for compacting."""
    return entries.select(
        F.lit("rss").alias("source"), "idx", F.lit("rss_entry").alias("kind"), "title",
        F.col("link").alias("url"), _upto("summary", summary_chars).alias("summary"),
        F.col("feed_name").alias("source_name"), X.clean_text_nourl("category", 60).alias("category"),
        F.col("published").alias("published_at"))


def feed_stats(entries_on_day: DataFrame, feeds: DataFrame) -> DataFrame:
    """agg_feed_stats: feeds, entries, feeds with entries, feeds with errors."""
    per_feed = entries_on_day.groupBy("feed_name").agg(F.count(F.lit(1)).alias("n"))
    f = feeds.join(per_feed, "feed_name", "left")
    return f.agg(F.count(F.lit(1)).alias("total_feeds"),
                 F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_entries"),
                 F.count_if(F.coalesce("n", F.lit(0)) > 0).alias("feeds_with_entries"),
                 F.count_if(F.col("error").isNotNull()).alias("feeds_with_errors"))


def mail_stats(entries: DataFrame) -> DataFrame:
    """agg_mail_stats: entries and distinct sources."""
    return entries.agg(F.count(F.lit(1)).alias("total_entries"),
                       F.countDistinct("source").alias("sources_with_entries"))
