"""Registered mail and feed queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import digest as G
from ..operators import mail as M
from ..sources import feeds as SF
from ..sources import mail as SM
from . import oracle as O
from .adapters import (ERROR_FEEDS, TARGET_DATE, as_of_col, feed_entries_raw, feed_item_xml, mail_registry,
                       raw_messages)
from .registry import register

ZONE = "Asia/Shanghai"
NL = "chr(10)"
_ERR = ", ".join(O.q(s) for s in ERROR_FEEDS)

FEED_CTE = f"""
feed_raw AS (
  SELECT doc_id AS idx, source AS feed_name, source IN ({_ERR}) AS is_err,
         (['AI', 'Tech', 'Research'])[(length(source) % 3) + 1] AS category,
         split_part(text, {NL}, 1) AS title, 'https://' || source || '.example.com/p/' || doc_id AS link, text,
         make_timestamp((1706659200 - 2 * 86400 + (doc_id * 7919) % (2 * 86400)) * 1000000) AS ts,
         doc_id % 13 <> 0 AS has_pub, doc_id % 13 = 0 AND doc_id % 2 = 0 AS has_upd
  FROM documents
),
feed_entries AS (
  SELECT idx, feed_name, category, title, link, text AS summary,
         CASE WHEN has_pub THEN strftime(ts, '%a, %d %b %Y %H:%M:%S +0000') END AS published,
         CASE WHEN has_pub OR has_upd THEN ts END AS eff_ts
  FROM feed_raw WHERE NOT is_err
),
feed_day AS (SELECT * FROM feed_entries WHERE eff_ts IS NOT NULL AND (eff_ts + INTERVAL 8 HOUR)::DATE = DATE '{TARGET_DATE}')"""


def _feed_entries(spark, sf_dir):
    return feed_entries_raw(spark, sf_dir).filter(F.col("error").isNull())


def _feed_day(spark, sf_dir):
    return M.feed_date_keep(_feed_entries(spark, sf_dir), TARGET_DATE, ZONE)


@register("src_rss_xml", O.with_ctes(FEED_CTE, body=f"""
SELECT idx, feed_name, CASE WHEN is_err THEN NULL ELSE title END AS title,
       CASE WHEN is_err THEN NULL ELSE link END AS link,
       CASE WHEN is_err THEN NULL ELSE text END AS summary,
       CASE WHEN is_err THEN NULL ELSE coalesce(CASE WHEN has_pub THEN strftime(ts, '%a, %d %b %Y %H:%M:%S +0000') END, '') END AS published,
       CASE WHEN is_err THEN 'unparseable feed item' END AS error
FROM feed_raw"""))
def src_rss_xml(spark, sf_dir):
    """Feed items parsed from landed RSS XML; bad feeds become error rows."""
    parsed = SF.parse_items(feed_item_xml(spark, sf_dir))
    return parsed.select("idx", "feed_name", "title", "link", "summary", "published", "error")


@register("flt_target_date_feed", O.with_ctes(FEED_CTE, body="SELECT idx, feed_name FROM feed_day"))
def flt_target_date_feed(spark, sf_dir):
    """Entries published (else updated) on the target local date."""
    return _feed_day(spark, sf_dir).select("idx", "feed_name")


def _items_as(name_cte: str, select_sql: str) -> str:
    return f"""
items AS (
  SELECT source, idx, kind, title, url, summary, source_name, NULL AS status, NULL AS confidence,
         NULL::DOUBLE AS score, published_at, NULL::INTEGER AS signal_score, NULL::BIGINT AS likes,
         NULL::BIGINT AS retweets, NULL::BIGINT AS replies
  FROM ({select_sql}) {name_cte}
)"""


_COMPACT_OUT = "source, idx, kind, title, url, summary, source_name, status, confidence, published_at, has_direct_url, age_days, priority"


@register("nrm_feed_entries", O.with_ctes(FEED_CTE, _items_as("f", """
  SELECT 'rss' AS source, idx, 'rss_entry' AS kind, title, link AS url, summary, feed_name AS source_name,
         published AS published_at FROM feed_day"""), O.COMPACT_CTE, body=f"SELECT {_COMPACT_OUT} FROM scored"))
def nrm_feed_entries(spark, sf_dir):
    """Feed entries of the day -> scored compact items."""
    items = M.feed_items(_feed_day(spark, sf_dir))
    return G.score_items(G.compact_items(items), as_of_col()).select(*_COMPACT_OUT.split(", "))


@register("agg_feed_stats", O.with_ctes(FEED_CTE, body="""
SELECT count(*) AS total_feeds, coalesce(sum(n), 0)::BIGINT AS total_entries,
       count(*) FILTER (WHERE coalesce(n, 0) > 0) AS feeds_with_entries,
       count(*) FILTER (WHERE is_err) AS feeds_with_errors
FROM (SELECT DISTINCT feed_name, is_err FROM feed_raw) f
LEFT JOIN (SELECT feed_name, count(*) AS n FROM feed_day GROUP BY 1) d USING (feed_name)"""))
def agg_feed_stats(spark, sf_dir):
    feeds = feed_entries_raw(spark, sf_dir).groupBy("feed_name").agg(F.max("error").alias("error"))
    return M.feed_stats(_feed_day(spark, sf_dir), feeds)


# ---------------- mail ----------------

_REG_ROWS = []
for _i in range(10):
    _REG_ROWS.append((len(_REG_ROWS), f"Letter {_i}", f"src{_i}@mail.example.com", None, ("AI", "Tech")[_i % 2]))
    if _i in (3, 5):
        _REG_ROWS.append((len(_REG_ROWS), f"Letter {_i} special", f"Src{_i}@Mail.example.com", "le", "Research"))
_REG_VALUES = ", ".join(f"({o}, {O.q(n)}, {O.q(s)}, {'NULL' if c is None else O.q(c)}, {O.q(cat)})"
                        for o, n, s, c, cat in _REG_ROWS)

MAIL_CTE = f"""
mail_src AS (
  SELECT coalesce(d.doc_id, p.page_id) AS idx, coalesce(d.source, 'src' || (coalesce(d.doc_id, p.page_id) % 20)) AS sender, d.text, p.html
  FROM documents d FULL JOIN pages p ON d.doc_id = p.page_id
),
mail_raw AS (
  SELECT idx, upper(substr(sender, 1, 1)) || lower(substr(sender, 2)) || ' Weekly <' || sender || '@mail.example.com>' AS from_header,
         coalesce(substring(split_part(text, {NL}, 1), 1, 60), 'Page ' || idx) AS subject,
         CASE WHEN idx % 13 <> 0 THEN strftime(make_timestamp((1706659200 - 2 * 86400 + (idx * 6007) % (3 * 86400)) * 1000000), '%a, %d %b %Y %H:%M:%S +0000') END AS date,
         '<' || idx || '@mail.example.com>' AS message_id,
         CASE WHEN idx % 3 <> 0 OR html IS NULL THEN text END AS plain, html
  FROM mail_src
),
html_txt AS (
  SELECT idx, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
           '(?is)<script.*?>.*?</script>', ' ', 'g'), '(?is)<style.*?>.*?</style>', ' ', 'g'),
           '(?i)<br\\s*/?>', {NL}, 'g'), '(?i)</p\\s*>', {NL} || {NL}, 'g'), '(?s)<[^>]+>', ' ', 'g') AS h
  FROM mail_raw
),
html_unesc AS (
  SELECT idx, replace(replace(replace(replace(replace(h, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'),
                              '&amp;', '&'), '&amp', '&') AS h FROM html_txt
),
mail_body AS (
  SELECT m.*, {O.strip_ws(f"regexp_replace(regexp_replace(regexp_replace(m.plain, '\\r\\n?', {NL}, 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', {NL} || {NL}, 'g')")} AS plain_c,
         {O.strip_ws(f"regexp_replace(regexp_replace(regexp_replace(u.h, '\\r\\n?', {NL}, 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', {NL} || {NL}, 'g')")} AS html_c
  FROM mail_raw m JOIN html_unesc u USING (idx)
),
mail_msg AS (
  SELECT idx, from_header, subject, date, message_id,
         CASE WHEN coalesce(plain_c, '') <> '' THEN plain_c ELSE coalesce(html_c, '') END AS body
  FROM mail_body
),
registry AS (SELECT * FROM (VALUES {_REG_VALUES}) r(ordinal, name, sender, subject_contains, category)),
mail_match AS (
  SELECT * FROM (
    SELECT m.*, r.name AS source, r.category, lower(trim(regexp_extract(m.from_header, '<([^>]*)>', 1))) AS "from",
           row_number() OVER (PARTITION BY m.idx ORDER BY (r.subject_contains IS NOT NULL AND r.subject_contains <> ''
              AND contains(lower(coalesce(m.subject, '')), lower(r.subject_contains))) DESC, r.ordinal) AS n,
           (r.subject_contains IS NOT NULL AND r.subject_contains <> '' AND contains(lower(coalesce(m.subject, '')), lower(r.subject_contains))) AS hit,
           (r.subject_contains IS NULL OR r.subject_contains = '') AS fb
    FROM mail_msg m JOIN registry r ON lower(trim(regexp_extract(m.from_header, '<([^>]*)>', 1))) = lower(trim(r.sender))
    WHERE (r.subject_contains IS NOT NULL AND r.subject_contains <> '' AND contains(lower(coalesce(m.subject, '')), lower(r.subject_contains)))
       OR r.subject_contains IS NULL OR r.subject_contains = '')
  WHERE n = 1
),
mail_day AS (
  SELECT * FROM mail_match
  WHERE try_strptime(date, '%a, %d %b %Y %H:%M:%S +0000') IS NULL
     OR (try_strptime(date, '%a, %d %b %Y %H:%M:%S +0000') + INTERVAL 8 HOUR)::DATE = DATE '{TARGET_DATE}'
),
mail_entries AS (
  SELECT idx, source, category, "from", regexp_extract(from_header, '^\\s*"?([^"<]*?)"?\\s*<', 1) AS from_name,
         subject, date, message_id, body, body AS summary
  FROM mail_day
)"""


def _messages(spark, sf_dir):
    return M.parts_to_body(SM.message_parts(raw_messages(spark, sf_dir)))


def _matched(spark, sf_dir):
    """Headers and content of the messages on the allow-list; no body is parsed."""
    registry = mail_registry(spark)
    known = M.from_registered(SM.message_headers(raw_messages(spark, sf_dir)), registry)
    return M.match_senders(SM.decode_headers(known), registry)


def _on_day(spark, sf_dir):
    return M.mail_date_keep(_matched(spark, sf_dir), TARGET_DATE, ZONE)


def _entries(spark, sf_dir):
    """Entries of the day: only their messages' bodies are parsed."""
    kept = _on_day(spark, sf_dir)
    bodies = M.parts_to_body(SM.message_parts(kept)).select("idx", "body")
    return M.mail_entries(kept.drop("content").join(bodies, "idx"))


@register("src_email_messages", None)
def src_email_messages(spark, sf_dir):
    """Message bytes parsed into header and part rows (MIME parsing runs in
    ``mapInArrow``; no SQL form)."""
    return SM.message_parts(raw_messages(spark, sf_dir))


@register("src_email_parts_to_body", O.with_ctes(MAIL_CTE, body="SELECT idx, message_id, subject, body FROM mail_msg"))
def src_email_parts_to_body(spark, sf_dir):
    """Message bodies: plain parts win, else HTML converted to text."""
    return _messages(spark, sf_dir).select("idx", "message_id", "subject", "body")


@register("fn_html_to_text", O.with_ctes(MAIL_CTE, body="SELECT idx, html_c AS text FROM mail_body WHERE html IS NOT NULL"))
def fn_html_to_text(spark, sf_dir):
    """HTML parts (pages) converted to text."""
    m = raw_messages(spark, sf_dir)
    parts = SM.message_parts(m).filter(F.col("content_type") == "text/html")
    return parts.select("idx", X.html_to_text("content").alias("text"))


@register("jn_sender_allowlist", O.with_ctes(MAIL_CTE, body='SELECT idx, source, category, "from" FROM mail_match'))
def jn_sender_allowlist(spark, sf_dir):
    """Messages matched to the newsletter registry by sender and subject needle."""
    return _matched(spark, sf_dir).select("idx", "source", "category", "from")


@register("fn_normalize_sender", O.with_ctes(MAIL_CTE, body="""
SELECT idx, lower(trim(regexp_extract(from_header, '<([^>]*)>', 1))) AS sender FROM mail_raw"""))
def fn_normalize_sender(spark, sf_dir):
    """Sender address of every message, from its headers."""
    return SM.message_headers(raw_messages(spark, sf_dir)).select("idx", X.normalize_sender("from_header").alias("sender"))


@register("flt_target_date_mail", O.with_ctes(MAIL_CTE, body="SELECT idx, source FROM mail_day"))
def flt_target_date_mail(spark, sf_dir):
    """Matched messages of the target day; undated ones are kept."""
    return _on_day(spark, sf_dir).select("idx", "source")


@register("nrm_newsletters", O.with_ctes(MAIL_CTE, _items_as("m", """
  SELECT 'email' AS source, idx, 'newsletter' AS kind,
         coalesce(nullif(subject, ''), """ + O.cut(O.clean_nourl("coalesce(nullif(summary, ''), nullif(body, ''), '')"), 80) + """) AS title,
         NULL AS url, coalesce(nullif(summary, ''), nullif(body, ''), '') AS summary,
         coalesce(nullif(from_name, ''), nullif("from", ''), 'Newsletter') AS source_name, date AS published_at
  FROM mail_entries"""), O.COMPACT_CTE, body=f"SELECT {_COMPACT_OUT} FROM scored"))
def nrm_newsletters(spark, sf_dir):
    """Newsletter entries -> scored compact items."""
    items = M.newsletter_items(_entries(spark, sf_dir))
    return G.score_items(G.compact_items(items), as_of_col()).select(*_COMPACT_OUT.split(", "))


@register("agg_mail_stats", O.with_ctes(MAIL_CTE, body="""
SELECT count(*) AS total_entries, count(DISTINCT source) AS sources_with_entries FROM mail_entries"""))
def agg_mail_stats(spark, sf_dir):
    """Entries and sources of the day, from headers alone."""
    return M.mail_stats(_on_day(spark, sf_dir))
