"""Registered report, page and scalar-function queries."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import scoring as S
from ..functions import text as X
from ..functions.constants import AI_KEYWORDS
from ..operators import digest as G
from ..operators import normalize as N
from ..operators import report as R
from ..session import spread, table
from ..sources import payloads as P
from . import landed as L
from . import oracle as O
from .adapters import TARGET_DATE, as_of_col, digest_items, hot_items_raw
from .digest_queries import scored_items
from .normalize_queries import CAND_CTE, HOT_CTE, POSTS_CTE, _cand_out, upstream_errors
from .registry import register

_CTES = (O.ITEMS_CTE, O.COMPACT_CTE)


# ---------------- freshness ----------------

@register("nrm_freshness_view", O.with_ctes(O.ITEMS_CTE, body="SELECT source, idx, title, published_at, url FROM items"))
def nrm_freshness_view(spark, sf_dir):
    """Items reduced to (title, published_at, url) per source."""
    return digest_items(spark, sf_dir).select("source", "idx", "title", "published_at", "url")


_FRESH_PARSE = O.parse_datetime("published_at", month_names=False)
_BUCKET_SQL = f"""CASE WHEN ts IS NULL THEN 'undated' WHEN DATE '{TARGET_DATE}' - ts::DATE < 0 THEN 'future'
  WHEN DATE '{TARGET_DATE}' - ts::DATE <= 1 THEN 'fresh_48h' WHEN DATE '{TARGET_DATE}' - ts::DATE <= 7 THEN 'recent_7d'
  ELSE 'stale_gt7d' END"""
FRESH_CTE = f"""
fresh0 AS (SELECT source, idx, title, published_at, {_FRESH_PARSE} AS ts FROM items),
fresh AS (SELECT *, {_BUCKET_SQL} AS bucket FROM fresh0),
fresh_report AS (
  SELECT c.*, s.samples FROM (
    SELECT source, count(*) AS total,
           count(*) FILTER (WHERE bucket = 'fresh_48h') AS fresh_48h, count(*) FILTER (WHERE bucket = 'recent_7d') AS recent_7d,
           count(*) FILTER (WHERE bucket = 'stale_gt7d') AS stale_gt7d, count(*) FILTER (WHERE bucket = 'undated') AS undated,
           count(*) FILTER (WHERE bucket = 'future') AS future
    FROM fresh GROUP BY source) c
  LEFT JOIN (
    SELECT source, string_agg(concat_ws('|', title, bucket), ' ;; ' ORDER BY n) AS samples FROM (
      SELECT source, title, bucket, row_number() OVER (PARTITION BY source ORDER BY idx) AS n FROM fresh)
    WHERE n <= 3 GROUP BY source) s USING (source)
)"""


def _fresh_report(spark, sf_dir):
    return G.freshness_report(digest_items(spark, sf_dir), TARGET_DATE)


@register("agg_freshness_report", O.with_ctes(O.ITEMS_CTE, FRESH_CTE, body="SELECT * FROM fresh_report"))
def agg_freshness_report(spark, sf_dir):
    """Per source counts by UTC day distance to the target date, with samples."""
    return _fresh_report(spark, sf_dir)


@register("fn_age_bucket", O.with_ctes(O.ITEMS_CTE, FRESH_CTE, body="SELECT source, idx, bucket FROM fresh"))
def fn_age_bucket(spark, sf_dir):
    ts = D.parse_datetime("published_at", month_names=False)
    return digest_items(spark, sf_dir).select("source", "idx", D.age_bucket(ts, F.lit(TARGET_DATE)).alias("bucket"))


_H = "('rss', 'email', 'aihot')"
_DP = "('bestblogs', 'follow-builders', 'ak-rss-digest')"


@register("agg_freshness_verdict", O.with_ctes(O.ITEMS_CTE, FRESH_CTE, body=f"""
SELECT hard_fresh, hard_recent, deep_fresh, deep_recent,
  CASE WHEN hard_fresh = 0 AND hard_recent = 0 AND deep_fresh + deep_recent > 0 THEN {O.q(R.K.VERDICT_NO_HARD_7D)} || chr(10) || {O.q(R.K.VERDICT_DEEP_NEWER)}
       WHEN hard_fresh = 0 AND hard_recent = 0 THEN {O.q(R.K.VERDICT_NO_HARD_7D)}
       WHEN hard_fresh = 0 AND deep_fresh + deep_recent > 0 THEN {O.q(R.K.VERDICT_NO_HARD_48H)} || chr(10) || {O.q(R.K.VERDICT_DEEP_NEWER)}
       WHEN hard_fresh = 0 THEN {O.q(R.K.VERDICT_NO_HARD_48H)}
       ELSE {O.q(R.K.VERDICT_OK)} END AS conclusions
FROM (SELECT coalesce(sum(fresh_48h) FILTER (WHERE source IN {_H}), 0)::BIGINT AS hard_fresh,
             coalesce(sum(recent_7d) FILTER (WHERE source IN {_H}), 0)::BIGINT AS hard_recent,
             coalesce(sum(fresh_48h) FILTER (WHERE source IN {_DP}), 0)::BIGINT AS deep_fresh,
             coalesce(sum(recent_7d) FILTER (WHERE source IN {_DP}), 0)::BIGINT AS deep_recent FROM fresh_report)"""))
def agg_freshness_verdict(spark, sf_dir):
    """Hard vs deep source freshness and the rule-based conclusions."""
    return R.freshness_verdict(_fresh_report(spark, sf_dir))


# ---------------- item lines and the compact context ----------------

_LINE_SQL = f"""'- **' || CASE WHEN {O.nonempty('title')} THEN title ELSE '未命名条目' END || '**'
  || coalesce('（' || nullif(concat_ws(' · ', CASE WHEN {O.nonempty('source_name')} THEN source_name END,
        CASE WHEN {O.nonempty('kind')} THEN kind END, CASE WHEN score IS NOT NULL THEN 'score=' || score::VARCHAR END,
        CASE WHEN coalesce(engagement, 0) <> 0 THEN 'engagement=' || engagement::VARCHAR END,
        CASE WHEN {O.nonempty('status')} AND status <> 'ready' THEN 'status=' || status END,
        CASE WHEN {O.nonempty('published_at')} THEN 'published=' || published_at END,
        CASE WHEN age_days IS NULL THEN NULL WHEN age_days <= 1 THEN 'freshness=fresh' WHEN age_days <= 7 THEN 'freshness=recent'
             ELSE 'freshness=stale' END), '') || '）', '')
  || CASE WHEN {O.nonempty('summary')} THEN '：' || summary ELSE '' END
  || CASE WHEN {O.nonempty('url')} THEN ' [链接](' || url || ')' ELSE '' END"""


@register("snk_item_line", O.with_ctes(*_CTES, body=f"SELECT source, rank, {_LINE_SQL} AS line FROM winners"))
def snk_item_line(spark, sf_dir):
    """One formatted line per selected item."""
    w = G.top_per_source(scored_items(spark, sf_dir))
    return w.select("source", "rank", R.item_line(w).alias("line"))


def _limitations(spark, sf_dir):
    from .adapters import (builder_posts, candidate_elements, deep_reads, feed_entries_raw)
    from .mail_queries import _on_day
    cands = N.normalize_candidates(candidate_elements(spark, sf_dir), N.deep_read_outcome(deep_reads(spark, sf_dir)))
    cstats = cands.agg(F.count_if(F.col("outcome") == "rate_limited").alias("deep_read_rate_limited"),
                       F.count_if(F.col("reason").isNull() & F.col("status").isin(
                           "needs_deep_read", "deferred_rate_limited", "summary_only")).alias("items_needing_followup"))
    feeds = feed_entries_raw(spark, sf_dir).groupBy("feed_name").agg(F.max("error").alias("error"))
    # conditional counts, not filters on the reason column (see normalize.kept)
    tweets = N.normalize_posts(builder_posts(spark, sf_dir)).agg(F.count_if(F.col("reason").isNull()).alias("n"))
    hot = N.normalize_hot_items(N.target_date_strict(hot_items_raw(spark, sf_dir), TARGET_DATE, "Asia/Shanghai"))
    hot_n = hot.agg(F.count_if(F.col("reason").isNotNull()).alias("n"))
    errors = upstream_errors(spark, sf_dir).select(F.col("upstream_errors").alias("n"))
    request = P.page_stats(_pages(spark, sf_dir)).select("mode")
    return R.limitations(feeds, _on_day(spark, sf_dir), cstats, errors, tweets, request, hot_n, spark)


def _limit_sql() -> tuple:
    """CTEs that end in ``limits`` (pos, line)."""
    from .mail_queries import FEED_CTE, MAIL_CTE
    K = R.K
    counted = [(1, K.LIMIT_RSS_ERRORS, "count(DISTINCT feed_name) FROM feed_raw WHERE is_err"),
               (3, K.LIMIT_BB_RATE, "count(*) FROM cand_out WHERE outcome = 'rate_limited'"),
               (4, K.LIMIT_BB_FOLLOWUP, "count(*) FROM cand_out WHERE reason IS NULL AND status IN ('needs_deep_read', 'deferred_rate_limited', 'summary_only')"),
               (5, K.LIMIT_AK_ERRORS, "count(DISTINCT feed_name) FROM feed_raw WHERE is_err"),
               (6, K.LIMIT_FB_TWEETS, "count(*) FROM posts_out WHERE reason IS NULL"),
               (8, K.LIMIT_HOT_DROPPED, "count(*) FROM hot_out WHERE reason IS NOT NULL")]
    parts = [f"SELECT {pos} AS pos, replace({O.q(line)}, '{{n}}', n::VARCHAR) AS line FROM (SELECT {count.replace(' FROM', ' AS n FROM', 1)}) WHERE n > 0"
             for pos, line, count in counted]
    parts.append(f"SELECT 2, {O.q(K.LIMIT_EMAIL_MISSING)} FROM (SELECT count(*) AS n FROM mail_entries) WHERE n = 0")
    parts.append(f"SELECT 7, {O.q(K.LIMIT_HOT_MODE.replace('{mode}', 'selected'))} FROM documents WHERE (doc_id // {L.PAGE_ITEMS}) % 7 <> {L.BAD_PAGE} HAVING count(*) > 0")
    return (FEED_CTE, MAIL_CTE, CAND_CTE, _cand_out(True), POSTS_CTE, HOT_CTE, f"limits AS ({' UNION ALL '.join(parts)})")


@register("agg_limitations", O.with_ctes(*_limit_sql(), body="SELECT pos, line FROM limits"))
def agg_limitations(spark, sf_dir):
    """Warnings from the payload statistics, in report order."""
    return _limitations(spark, sf_dir)


def _context_lines(spark, sf_dir):
    scored = scored_items(spark, sf_dir)
    winners = G.top_per_source(scored)
    overall = G.top_overall(winners)
    stats = G.source_stats(scored)
    buckets = G.freshness_buckets(scored)
    return R.compact_context_lines(stats, buckets, R.freshness_warnings(buckets), _limitations(spark, sf_dir),
                                   winners, overall, TARGET_DATE.isoformat())


def _context_sql() -> str:
    K = R.K
    dim = ", ".join(f"({i}, {O.q(x)})" for i, x in enumerate(K.DIGEST_SOURCES))
    nl = "chr(10)"
    lines = f"string_agg({{}}, {nl} ORDER BY {{}})"
    hard, deep = (f"source IN ({', '.join(O.q(x) for x in xs)})" for xs in (K.BREAKING_SOURCES, K.DEEP_SOURCES))
    return O.with_ctes(O.ITEMS_CTE, O.COMPACT_CTE, *_limit_sql(), f"""
dim AS (SELECT * FROM (VALUES {dim}) d(ord, source)),
counts AS (
  SELECT d.ord, d.source, count(s.source) AS n, least(count(s.source), 8) AS chosen, count(*) FILTER (WHERE {O.nonempty('s.url')}) AS linked,
         count(*) FILTER (WHERE {O.nonempty('s.published_at')}) AS dated,
         count(*) FILTER (WHERE {O.nonempty('s.published_at')} AND coalesce(age_days, 0) <= 1) AS f48,
         count(*) FILTER (WHERE {O.nonempty('s.published_at')} AND (CASE WHEN age_days = 0 THEN 999 ELSE coalesce(age_days, 999) END) <= 7) AS r7,
         count(*) FILTER (WHERE age_days <= 1) AS fresh, count(*) FILTER (WHERE age_days > 1 AND age_days <= 7) AS recent,
         count(*) FILTER (WHERE age_days > 7) AS stale, count(*) FILTER (WHERE s.source IS NOT NULL AND age_days IS NULL) AS undated
  FROM dim d LEFT JOIN scored s USING (source) GROUP BY d.ord, d.source
),
sums AS (SELECT sum(fresh) FILTER (WHERE {hard}) AS hf, sum(recent) FILTER (WHERE {hard}) AS hr, sum(fresh + recent) FILTER (WHERE {deep}) AS dd FROM counts),
warn AS (
  SELECT 0 AS pos, CASE WHEN hr = 0 THEN {O.q(K.WARN_NO_HARD_7D)} ELSE {O.q(K.WARN_NO_HARD_48H)} END AS line FROM sums WHERE hf = 0
  UNION ALL SELECT 1, {O.q(K.WARN_DEEP_NEWER)} FROM sums WHERE dd > 0 AND hf = 0
),
item_lines AS (SELECT *, {_LINE_SQL} AS line FROM winners),
top AS (SELECT line, row_number() OVER (ORDER BY priority DESC, coalesce(score, 0) DESC, engagement DESC, coalesce(title, '') DESC, {O.source_ordinal()}, rank) AS n
        FROM item_lines)""", body=f"""
SELECT concat_ws({nl}, '# compact context {TARGET_DATE}', '', {O.q(K.HEAD_STATS)}, '',
  (SELECT {lines.format("'- ' || source || ': total=' || n || ', selected=' || chosen || ', linked=' || linked || ', dated=' || dated || ', fresh_48h=' || f48 || ', recent_7d=' || r7", 'ord')} FROM counts),
  '', {O.q(K.HEAD_FRESHNESS)}, '',
  (SELECT {lines.format("'- ' || source || ': fresh_48h=' || fresh || ', recent_7d=' || recent || ', stale_gt7d=' || stale || ', undated=' || undated", 'ord')} FROM counts),
  (SELECT {nl} || {O.q(K.HEAD_CONCLUSIONS)} || {nl} || {nl} || {lines.format("'- ' || line", 'pos')} FROM warn HAVING count(*) > 0),
  '', {O.q(K.HEAD_LIMITS)}, '', coalesce((SELECT {lines.format("'- ' || line", 'pos')} FROM limits), {O.q(K.NO_LIMITS)}),
  '', {O.q(K.HEAD_CANDIDATES)}, '',
  (SELECT {lines.format("'### ' || source || chr(10) || chr(10) || body || chr(10)", 'ord')} FROM (
     SELECT d.ord, d.source, coalesce({lines.format('i.line', 'i.rank')}, {O.q(K.NO_CANDIDATES)}) AS body FROM dim d LEFT JOIN item_lines i USING (source) GROUP BY d.ord, d.source)),
  {O.q(K.HEAD_OVERALL)}, '', (SELECT {lines.format('line', 'n')} FROM top WHERE n <= 18), '') AS markdown""")


@register("snk_compact_context", _context_sql())
def snk_compact_context(spark, sf_dir):
    """The compact context document as one Markdown row."""
    return R.render(_context_lines(spark, sf_dir))


# ---------------- API pages ----------------

def _pages(spark, sf_dir):
    return P.read_payloads(spark, L.hot_pages(spark, sf_dir), P.PAGE_SCHEMA)


_PAGES_SQL = f"""
pages AS (
  SELECT doc_id // {L.PAGE_ITEMS} AS page, list('H' || doc_id ORDER BY doc_id) AS ids FROM documents GROUP BY 1
),
pages2 AS (
  SELECT page, ids, page % 7 = {L.BAD_PAGE} AS bad, page + 1 IN (SELECT page FROM pages) AS hasNext FROM pages
)"""


@register("src_api_pages", O.with_ctes(_PAGES_SQL, body="""
SELECT page::INTEGER AS page, (pos - 1)::INTEGER AS pos, id
FROM (SELECT page, unnest(generate_series(1, len(ids))) AS pos, unnest(ids) AS id FROM pages2 WHERE NOT bad)"""))
def src_api_pages(spark, sf_dir):
    """Items of the landed cursor pages in order of arrival (page, position, item id)."""
    return P.page_items(_pages(spark, sf_dir)).select("page", "pos", "id")


@register("agg_hot_fetch_stats", O.with_ctes(_PAGES_SQL, HOT_CTE, body="""
SELECT (SELECT count(*) FROM hot2) AS raw_items, (SELECT count(*) FROM hot2 WHERE date_reason IS NULL) AS kept_items,
       (SELECT count(*) FROM hot2 WHERE date_reason IS NOT NULL) AS dropped_items,
       (SELECT count(*) FROM pages2 WHERE NOT bad) AS page_count, (SELECT count(*) FROM pages2 WHERE bad) AS bad_pages,
       (SELECT CASE WHEN hasNext THEN 'cursor-' || (page + 1) END FROM pages2 WHERE NOT bad ORDER BY page DESC LIMIT 1) AS last_next_cursor,
       (SELECT hasNext FROM pages2 WHERE NOT bad ORDER BY page DESC LIMIT 1) AS truncated"""))
def agg_hot_fetch_stats(spark, sf_dir):
    """raw / kept / dropped counts; pages, the last cursor and the truncation flag of the landed pages."""
    hot = N.target_date_strict(hot_items_raw(spark, sf_dir), TARGET_DATE, "Asia/Shanghai")
    counts = hot.agg(F.count(F.lit(1)).alias("raw_items"), F.count_if(F.col("reason").isNull()).alias("kept_items"),
                     F.count_if(F.col("reason").isNotNull()).alias("dropped_items"))
    # two single-row aggregates side by side: a union and one more aggregate, no join
    both = counts.unionByName(P.page_stats(_pages(spark, sf_dir)).drop("mode"), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


@register("flt_since", O.with_ctes(HOT_CTE, body=f"""
SELECT idx FROM hot1 WHERE ts >= TIMESTAMP '{_dt.datetime.combine(TARGET_DATE, _dt.time()) - _dt.timedelta(hours=8)}'"""))
def flt_since(spark, sf_dir):
    """Items at or after the target day's local midnight (in UTC)."""
    h = hot_items_raw(spark, sf_dir)
    since = D.day_start_utc(F.lit(TARGET_DATE), "Asia/Shanghai")
    return h.filter(D.parse_api_datetime("published_at") >= since).select("idx")


@register("flt_item_category", O.with_ctes(HOT_CTE, body="""
SELECT idx FROM hot0 WHERE selected AND category = 'ai-models'
  AND (contains(lower(title_raw), 'de') OR contains(lower(summary_raw), 'de'))"""))
def flt_item_category(spark, sf_dir):
    """Mode ``selected``, category ``ai-models``, keyword ``de``."""
    h = hot_items_raw(spark, sf_dir)
    kw = F.lower(F.col("title")).contains("de") | F.lower(F.col("summary")).contains("de")
    return h.filter(F.col("selected") & (F.col("category") == "ai-models") & kw).select("idx")


@register("fn_day_start_utc", O.with_ctes(HOT_CTE, body="""
SELECT DISTINCT (ts + INTERVAL 8 HOUR)::DATE AS day, strftime((ts + INTERVAL 8 HOUR)::DATE::TIMESTAMP - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS start_utc
FROM hot1 WHERE ts IS NOT NULL"""))
def fn_day_start_utc(spark, sf_dir):
    """Local midnight in UTC of every local day with hot items."""
    h = hot_items_raw(spark, sf_dir).select(D.parse_api_datetime("published_at").alias("ts")).filter(F.col("ts").isNotNull())
    days = h.select(D.local_date("ts").alias("day")).distinct()
    return days.select("day", F.date_format(D.day_start_utc("day"), "yyyy-MM-dd HH:mm:ss").alias("start_utc"))


# ---------------- scalar functions over the driver tables ----------------

@register("fn_parse_datetime", O.with_ctes(O.ITEMS_CTE, body=f"""
SELECT idx, strftime({O.parse_datetime('published_at')}, '%Y-%m-%d %H:%M:%S') AS parsed,
       strftime({O.parse_datetime('published_at', month_names=False)}, '%Y-%m-%d %H:%M:%S') AS parsed_fresh,
       {O.age_days(O.parse_datetime('published_at'))} AS age_days,
       CASE WHEN {O.age_days(O.parse_datetime('published_at'))} IS NULL THEN 'undated'
            WHEN {O.age_days(O.parse_datetime('published_at'))} <= 1 THEN 'fresh'
            WHEN {O.age_days(O.parse_datetime('published_at'))} <= 7 THEN 'recent' ELSE 'stale' END AS freshness
FROM items"""))
def fn_parse_datetime(spark, sf_dir):
    """fn_parse_datetime, fn_parse_datetime_fresh, fn_age_days and
    fn_freshness_bucket over every item's published string."""
    it = digest_items(spark, sf_dir).select("idx", "published_at")
    ts = D.parse_datetime("published_at")
    age = D.age_days(ts, as_of_col())
    return it.select("idx", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("parsed"),
                     F.date_format(D.parse_datetime("published_at", month_names=False), "yyyy-MM-dd HH:mm:ss").alias("parsed_fresh"),
                     age.alias("age_days"), D.freshness_bucket(age).alias("freshness"))


@register("fn_parse_api_datetime", O.with_ctes(HOT_CTE, body="""
SELECT idx, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed FROM hot1"""))
def fn_parse_api_datetime(spark, sf_dir):
    h = hot_items_raw(spark, sf_dir)
    return h.select("idx", F.date_format(D.parse_api_datetime("published_at"), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


_MAIL_CLEAN = O.strip_ws("regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")


@register("fn_clean_text", f"""
SELECT doc_id, {O.clean('text')} AS clean, {O.cut(O.clean_nourl('text'), 240)} AS clean_nourl_240,
       {_MAIL_CLEAN} AS clean_mail, substring(text, 1, 80) AS preview_80
FROM documents""")
def fn_clean_text(spark, sf_dir):
    """fn_clean_text, fn_clean_text_nourl (cut 240), fn_clean_text_mail and
    fn_preview over whole document texts."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return d.select("doc_id", X.clean_text("text").alias("clean"), X.clean_text_nourl("text", 240).alias("clean_nourl_240"),
                    X.clean_text_mail("text").alias("clean_mail"), X.preview("text", 80).alias("preview_80"))


@register("fn_strip_invisible", """
SELECT doc_id, regexp_replace(replace(text, ' ', chr(8203) || ' ') || chr(65279), '[\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{FEFF}]', '', 'g') AS stripped
FROM documents""")
def fn_strip_invisible(spark, sf_dir):
    """Zero-width and direction marks removed from whole texts (U+200B before every blank, U+FEFF appended)."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    marked = F.concat(F.replace("text", F.lit(" "), F.lit("\u200b ")), F.lit("\ufeff"))
    return d.select("doc_id", X.strip_invisible(marked).alias("stripped"))


@register("fn_ai_keyword_score", O.with_ctes(*_CTES, body=f"""
SELECT source, idx, {O.keyword_hits(O.joined_lower('title', 'summary', 'source_name'), AI_KEYWORDS)} AS kw,
       engagement FROM compact"""))
def fn_ai_keyword_score(spark, sf_dir):
    """fn_ai_keyword_score and fn_engagement of every compact item."""
    c = G.compact_items(digest_items(spark, sf_dir))
    return c.select("source", "idx", S.ai_keyword_score("title", "summary", "source_name").alias("kw"), "engagement")


# ---------------- first-match and ordered distinct ----------------

@register("win_first_match", O.with_ctes(O.ITEMS_CTE, body="""
SELECT source, idx, title FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY idx) AS n FROM items) WHERE n <= 3"""))
def win_first_match(spark, sf_dir):
    """First three items per source in input order (sample rows)."""
    w = Window.partitionBy("source").orderBy("idx")
    it = digest_items(spark, sf_dir)
    return it.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 3).select("source", "idx", "title")


@register("set_unique_ordered", """
SELECT source, min(doc_id) AS first_idx FROM documents GROUP BY source""")
def set_unique_ordered(spark, sf_dir):
    """Distinct source names keeping their first occurrence (ordered by it)."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.min("doc_id").alias("first_idx")).orderBy("first_idx")
