"""Registered normaliser queries: five payload shapes, drop reasons, stats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.constants import NOISE_PATTERNS, NORMALIZE_STATS, SIGNAL_KEYWORDS
from ..operators import normalize as N
from . import oracle as O
from .adapters import (ERROR_FEEDS, TARGET_DATE, blog_posts_raw, builder_posts, candidate_elements, deep_reads,
                       hot_items_raw, podcast_episodes, podcast_lines, rss_digest_items)
from .registry import register

NL = "chr(10)"


def _line(n: int) -> str:
    return f"split_part(text, {NL}, {n})"


def _item_id(source: str, *bits: str) -> str:
    return "concat_ws('|', " + ", ".join([O.q(source)] + [f"({b})::VARCHAR" for b in bits]) + ")"


def _word_count(e: str) -> str:
    return f"len(regexp_extract_all({e}, '[\\p{{L}}\\p{{N}}_''’-]+'))"


def _url_only(e: str) -> str:
    return f"coalesce(regexp_full_match({e}, '(?i)(https?://\\S+)(\\s+https?://\\S+)*'), false)"


def _noise_hit(e: str) -> str:
    return "(" + " OR ".join(f"contains({e}, {O.q(p)})" for p in NOISE_PATTERNS) + ")"


# ---------------- candidates ----------------

CAND_CTE = f"""
cand_raw AS (
  SELECT doc_id AS idx, doc_id % 29 = 0 AS not_obj,
    CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 23 = 0 THEN '' ELSE {_line(1)} END AS title_raw,
    CASE WHEN doc_id % 29 = 0 OR doc_id % 5 = 0 THEN NULL ELSE {_line(2)} END AS reason_raw,
    CASE WHEN doc_id % 29 = 0 OR doc_id % 7 = 0 THEN NULL ELSE 'R' || doc_id END AS resource_id,
    CASE WHEN doc_id % 29 = 0 OR doc_id % 3 = 0 THEN NULL ELSE 'https://blogs.example.com/r/' || doc_id END AS read_url,
    CASE WHEN doc_id % 29 = 0 THEN NULL ELSE source END AS sn,
    CASE WHEN doc_id % 29 = 0 THEN NULL ELSE (n_chars % 101)::DOUBLE END AS score,
    CASE WHEN doc_id % 29 = 0 THEN 'junk-' || doc_id END AS preview
  FROM documents
),
cand0 AS (
  SELECT idx, not_obj, preview, {O.clean('title_raw')} AS title, {O.clean('reason_raw')} AS reason_c,
         resource_id, read_url, {O.clean('sn')} AS source_name, score
  FROM cand_raw
),
cand1 AS (
  SELECT *, CASE WHEN reason_c <> '' THEN reason_c ELSE title END AS summary0,
         CASE WHEN not_obj THEN 'candidate_not_object' WHEN title = '' THEN 'missing_title' END AS reason,
         {O.nonempty('read_url')} AS has_url, {O.nonempty('resource_id')} AS has_rid
  FROM cand0
),
deep_out AS (
  SELECT 'R' || doc_id AS resource_id,
         CASE doc_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'rate_limited' WHEN 3 THEN 'nonzero_exit'
              WHEN 4 THEN 'invalid_json' ELSE 'missing_meta' END AS outcome,
         CASE WHEN doc_id % 6 = 0 THEN 'https://origin.example.com/a/' || doc_id END AS meta_url,
         CASE WHEN doc_id % 6 IN (0, 1) THEN 'https://blogs.example.com/read/' || doc_id END AS meta_read_url,
         CASE WHEN doc_id % 6 IN (0, 1) THEN {_line(3)} END AS meta_one,
         CASE WHEN doc_id % 6 IN (0, 1) THEN 'featured' END AS meta_featured,
         CASE WHEN doc_id % 6 IN (0, 1) THEN '2024-01-29 08:00:00' END AS meta_publish
  FROM documents
)"""


def _cand_out(deep: bool) -> str:
    tried = ("""
cand_tried AS (
  SELECT c.idx, coalesce(d.outcome, 'missing_meta') AS outcome, d.meta_url, d.meta_read_url, d.meta_one,
         d.meta_featured, d.meta_publish
  FROM (SELECT idx, resource_id FROM cand1 WHERE reason IS NULL AND NOT has_url AND has_rid) c
  LEFT JOIN deep_out d USING (resource_id)
),""" if deep else """
cand_tried AS (SELECT NULL::BIGINT AS idx, NULL AS outcome, NULL AS meta_url, NULL AS meta_read_url, NULL AS meta_one,
                      NULL AS meta_featured, NULL AS meta_publish WHERE false),""")
    canonical = f"(CASE WHEN t.outcome = 'ok' THEN {O.first_nonempty('t.meta_url', 't.meta_read_url', 'c.read_url')} ELSE c.read_url END)"
    return tried + f"""
cand2 AS (
  SELECT c.*, t.outcome, t.meta_publish, {canonical} AS canonical,
         CASE WHEN t.outcome = 'ok' THEN {O.clean(O.first_nonempty('t.meta_one', 't.meta_featured', 'c.summary0'))}
              ELSE c.summary0 END AS summary
  FROM cand1 c LEFT JOIN cand_tried t USING (idx)
),
cand_out AS (
  SELECT 'bestblogs' AS source, 'article_candidate' AS kind, idx,
    CASE WHEN reason IS NULL THEN {_item_id('bestblogs', "coalesce(nullif(resource_id, ''), idx::VARCHAR)", 'title')} END AS id,
    title, canonical AS url, summary, source_name, score, resource_id,
    CASE WHEN outcome = 'ok' THEN (CASE WHEN {O.nonempty('canonical')} THEN 'ready' ELSE 'summary_only' END)
         WHEN outcome = 'rate_limited' THEN 'deferred_rate_limited'
         WHEN outcome IS NOT NULL THEN 'summary_only'
         WHEN has_url THEN 'ready' WHEN has_rid THEN 'needs_deep_read' ELSE 'summary_only' END AS status,
    CASE WHEN outcome = 'ok' THEN (CASE WHEN {O.nonempty('canonical')} THEN 'high' ELSE 'medium' END)
         WHEN outcome IS NOT NULL THEN 'medium'
         WHEN has_url THEN 'high' ELSE 'medium' END AS confidence,
    {O.nonempty('canonical')} AS has_direct_url, outcome, meta_publish AS published_at, reason, preview
  FROM cand2
)"""


_CAND_COLS = ["idx", "id", "title", "url", "summary", "source_name", "score", "resource_id", "status",
              "confidence", "has_direct_url", "reason", "preview"]


@register("nrm_candidates", O.with_ctes(CAND_CTE, _cand_out(False), body=f"SELECT {', '.join(_CAND_COLS)} FROM cand_out"))
def nrm_candidates(spark, sf_dir):
    """Curated candidates -> items (status machine without deep reads)."""
    return N.normalize_candidates(candidate_elements(spark, sf_dir)).select(*_CAND_COLS)


@register("jn_deep_read", O.with_ctes(CAND_CTE, _cand_out(True),
                                      body=f"SELECT {', '.join(_CAND_COLS)}, outcome, published_at FROM cand_out"))
def jn_deep_read(spark, sf_dir):
    """Candidates with the URL-less ones enriched from landed detail reads."""
    out = N.normalize_candidates(candidate_elements(spark, sf_dir), N.deep_read_outcome(deep_reads(spark, sf_dir)))
    return out.select(*_CAND_COLS, "outcome", "published_at")


_DEEP_STDOUT = f"""CASE doc_id % 6
  WHEN 0 THEN json_object('success', true, 'data', json_object('meta', json_object('url', 'https://origin.example.com/a/' || doc_id,
       'readUrl', 'https://blogs.example.com/read/' || doc_id), 'markdown', 'read 429 words of ' || doc_id))::VARCHAR
  WHEN 1 THEN json_object('success', true, 'data', json_object('meta', json_object('readUrl', 'https://blogs.example.com/read/' || doc_id),
       'markdown', 'read 429 words of ' || doc_id))::VARCHAR
  WHEN 2 THEN '' WHEN 3 THEN '' WHEN 4 THEN '{{not json' ELSE '{{"success": true, "data": {{}}}}' END"""


@register("jn_deep_read_outcome", O.with_ctes(f"""
resp AS (SELECT 'R' || doc_id AS resource_id, {_DEEP_STDOUT} AS stdout,
                CASE doc_id % 6 WHEN 2 THEN 'RATE_LIMITED: quota exceeded' WHEN 3 THEN 'boom' ELSE '' END AS stderr,
                CASE WHEN doc_id % 6 IN (2, 3) THEN 1 ELSE 0 END AS returncode FROM documents)""", body="""
SELECT resource_id,
  CASE WHEN trim(stdout) <> '' AND json_valid(stdout) AND json_type(stdout, '$.data.meta') = 'OBJECT' THEN 'ok'
       WHEN contains(upper(stdout || chr(10) || stderr), 'RATE_LIMITED') OR contains(upper(stdout || chr(10) || stderr), '429') THEN 'rate_limited'
       WHEN returncode <> 0 THEN 'nonzero_exit'
       WHEN trim(stdout) <> '' AND NOT json_valid(stdout) THEN 'invalid_json'
       ELSE 'missing_meta' END AS outcome
FROM resp"""))
def jn_deep_read_outcome(spark, sf_dir):
    """Classification of every landed detail-read response."""
    return N.deep_read_outcome(deep_reads(spark, sf_dir)).select("resource_id", "outcome")


# ---------------- posts ----------------

POSTS_CTE = f"""
post_lines AS (
  SELECT doc_id, source, lang, pos - 1 AS pos, line FROM (
    SELECT doc_id, source, lang, unnest(generate_series(1, len(string_split(text, {NL})))) AS pos,
           unnest(string_split(text, {NL})) AS line FROM documents)
),
posts0 AS (
  SELECT doc_id AS builder_idx, pos AS idx, {O.clean('source')} AS builder_name, {O.clean("'@' || source")} AS handle,
         {O.clean("'builder writing in ' || lang")} AS bio, doc_id || '-' || pos AS tweet_id,
         {O.clean("CASE WHEN (doc_id + pos) % 11 = 0 THEN 'https://x.example.com/s/' || doc_id || '/' || pos WHEN (doc_id + pos) % 13 = 0 THEN line || ' Sign up here' ELSE line END")} AS text,
         CASE WHEN (doc_id + pos) % 17 <> 0 THEN 'https://x.example.com/' || source || '/status/' || doc_id || '-' || pos END AS url
  FROM post_lines
),
posts1 AS (SELECT *, {O.strip_ws(O.nourl('text'))} AS visible FROM posts0),
posts2 AS (
  SELECT *, {O.keyword_hits(O.joined_lower(O.clean('visible'), O.clean('bio')), SIGNAL_KEYWORDS)} AS sig,
         {_word_count('visible')} AS wc FROM posts1
),
posts_out AS (
  SELECT 'follow-builders' AS source, 'tweet' AS kind, builder_idx AS idx, idx AS part,
    {_item_id('follow-builders', "'tweet'", 'tweet_id', 'handle')} AS id,
    {O.first_nonempty('builder_name', 'handle')} || '：' || substring(visible, 1, 80) || CASE WHEN length(visible) > 80 THEN '…' ELSE '' END AS title,
    url, text AS summary, builder_name AS source_name, 'ready' AS status,
    CASE WHEN sig >= 3 THEN 'high' ELSE 'medium' END AS confidence, sig::INTEGER AS signal_score,
    NULL::BOOLEAN AS has_direct_url,
    CASE WHEN NOT {O.nonempty('url')} THEN 'missing_url'
         WHEN visible = '' OR {_url_only('text')} THEN 'url_only_or_empty_text'
         WHEN {_noise_hit('lower(visible)')} THEN 'known_low_signal_pattern'
         WHEN wc <= 4 AND sig < 2 THEN 'too_short_without_ai_builder_signal'
         WHEN wc <= 9 AND sig = 0 THEN 'short_without_ai_builder_signal'
         WHEN sig = 0 THEN 'missing_ai_builder_signal' END AS reason,
    visible, {O.first_nonempty('builder_name', 'handle')} AS builder
  FROM posts2
)"""

_POST_COLS = ["idx", "part", "id", "title", "url", "summary", "signal_score", "confidence", "reason", "preview", "builder"]


@register("nrm_posts", O.with_ctes(POSTS_CTE, body="""
SELECT idx, part, id, title, url, summary, signal_score, confidence, reason,
       CASE WHEN reason IS NOT NULL AND url IS NOT NULL AND url <> '' THEN substring(visible, 1, 160) END AS preview, builder
FROM posts_out"""))
def nrm_posts(spark, sf_dir):
    """Builder posts -> tweet items with noise filter and signal score."""
    return N.normalize_posts(builder_posts(spark, sf_dir)).select(*_POST_COLS)


@register("flt_post_noise", O.with_ctes(POSTS_CTE, body="""
SELECT idx, part, reason FROM posts_out WHERE url IS NOT NULL AND url <> ''"""))
def flt_post_noise(spark, sf_dir):
    """Noise reason of every post that has a URL (null = kept). Returned as a
    splitter column rather than filtered, so the reason is computed once."""
    p = builder_posts(spark, sf_dir).filter(X.nonempty("url"))
    out = N.with_noise_reason(p, "text", "bio", "reason")
    return out.select(F.col("builder_idx").alias("idx"), F.col("idx").alias("part"), "reason")


@register("fn_signal_score", O.with_ctes(POSTS_CTE, body="""
SELECT builder_idx AS idx, idx AS part, sig::INTEGER AS signal_score, wc::INTEGER AS word_count FROM posts2"""))
def fn_signal_score(spark, sf_dir):
    """fn_signal_score and fn_word_count of every post's visible text."""
    from ..functions import scoring as S
    p = builder_posts(spark, sf_dir).select(
        F.col("builder_idx").alias("idx"), F.col("idx").alias("part"),
        X.strip_ws(X.remove_urls(X.clean_text("text"))).alias("visible"), X.clean_text("bio").alias("bio"))
    return p.select("idx", "part", S.signal_score("visible", "bio").cast("int").alias("signal_score"),
                    X.word_count("visible").alias("word_count"))


@register("flt_url_only", O.with_ctes(POSTS_CTE, body=f"""
SELECT builder_idx AS idx, idx AS part, {_url_only('text')} AS url_only, visible AS visible_text FROM posts1"""))
def flt_url_only(spark, sf_dir):
    """flt_url_only and fn_visible_text over every post."""
    p = builder_posts(spark, sf_dir)
    t = X.clean_text("text")
    return p.select(F.col("builder_idx").alias("idx"), F.col("idx").alias("part"), X.is_url_only(t).alias("url_only"),
                    X.visible_text("text").alias("visible_text"))


# ---------------- podcasts ----------------

POD_CTE = f"""
pod_lines AS (
  SELECT conv_id, turn, pos, line FROM (
    SELECT conv_id, turn, unnest(generate_series(1, len(string_split(tt, {NL})))) AS pos,
           unnest(string_split(tt, {NL})) AS line
    FROM (SELECT conv_id, turn, 'Speaker ' || role || ' - ' || text AS tt FROM conversations))
),
pod_seg0 AS (SELECT conv_id, turn, pos, {O.strip_ws('line')} AS s FROM pod_lines),
pod_seg AS (
  SELECT conv_id, turn, pos,
         {O.clean("CASE WHEN starts_with(lower(s), 'speaker ') AND strpos(s, '-') > 0 THEN " + O.strip_ws("substring(s, strpos(s, '-') + 1)") + " ELSE s END")} AS seg
  FROM pod_seg0
),
pod_first AS (
  SELECT conv_id, string_agg(seg, ' ' ORDER BY n) AS joined FROM (
    SELECT conv_id, seg, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS n FROM pod_seg WHERE seg <> '')
  WHERE n <= 3 GROUP BY conv_id
),
pod_chars AS (
  SELECT conv_id, (sum(length('Speaker ' || role || ' - ' || text)) + count(*) - 1)::BIGINT AS transcript_chars
  FROM conversations GROUP BY conv_id
),
pod_out AS (
  SELECT 'follow-builders' AS source, 'podcast_episode' AS kind, c.conv_id AS idx,
    {_item_id('follow-builders', "'podcast'", "'guid-' || c.conv_id", "'Episode ' || c.conv_id")} AS id,
    'Episode ' || c.conv_id AS title,
    CASE WHEN c.conv_id % 9 <> 0 THEN 'https://pod.example.com/ep/' || c.conv_id END AS url,
    coalesce({O.cut('f.joined', 400)}, '') AS summary, 'Builders Pod' AS source_name,
    CASE WHEN coalesce(f.joined, '') <> '' THEN 'ready' ELSE 'needs_review' END AS status,
    'medium' AS confidence, NULL::BOOLEAN AS has_direct_url, c.transcript_chars,
    CASE WHEN c.conv_id % 9 = 0 THEN 'missing_title_or_url' END AS reason
  FROM pod_chars c LEFT JOIN pod_first f USING (conv_id)
)"""


@register("nrm_podcasts", O.with_ctes(POD_CTE, body="SELECT idx, id, title, url, summary, status, transcript_chars, reason FROM pod_out"))
def nrm_podcasts(spark, sf_dir):
    """Podcast episodes with transcript summaries."""
    out = N.normalize_podcasts(podcast_episodes(spark, sf_dir), podcast_lines(spark, sf_dir))
    return out.select("idx", "id", "title", "url", "summary", "status", "transcript_chars", "reason")


@register("fn_transcript_summary", O.with_ctes(POD_CTE, body="SELECT conv_id, coalesce(" + O.cut('f.joined', 400) + ", '') AS summary FROM pod_chars c LEFT JOIN pod_first f USING (conv_id)"))
def fn_transcript_summary(spark, sf_dir):
    return N.transcript_summaries(podcast_lines(spark, sf_dir)).select("conv_id", "summary")


# ---------------- blogs ----------------

_TITLE_RE = "'<title>(.*?)</title>'"
_PARA_RE = "'(?s)<p>(.*?)</p>'"

BLOG_CTE = f"""
blog0 AS (
  SELECT page_id, url AS page_url, html, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
         regexp_extract(html, {_TITLE_RE}, 1) AS ttl, regexp_extract(html, {_PARA_RE}, 1) AS para FROM pages
),
blog_posts AS (
  SELECT page_id AS idx, 0 AS part, CASE WHEN page_id % 4 = 0 THEN ttl ELSE ttl END AS t,
         CASE WHEN page_id % 4 = 0 THEN page_url ELSE page_url END AS u,
         CASE WHEN page_id % 4 = 0 THEN {O.first_nonempty('html')} ELSE {O.first_nonempty('para')} END AS s,
         CASE WHEN page_id % 4 = 0 THEN NULL ELSE '2024-01-29T10:00:00Z' END AS published_at, host
  FROM blog0
  UNION ALL
  SELECT page_id, 1, '', page_url || '#2', {O.first_nonempty('html')}, NULL, host FROM blog0
  WHERE page_id % 4 <> 0 AND page_id % 3 = 0
),
blog_out AS (
  SELECT 'follow-builders' AS source, 'blog_post' AS kind, idx, part,
    {_item_id('follow-builders', "'blog'", O.clean('t'), 'u')} AS id,
    {O.clean('t')} AS title, u AS url,
    CASE WHEN length({O.clean('s')}) > 400 THEN substring({O.clean('s')}, 1, 400) || '…' ELSE {O.clean('s')} END AS summary,
    published_at, {O.clean('host')} AS source_name, 'ready' AS status, 'medium' AS confidence,
    NULL::BOOLEAN AS has_direct_url,
    CASE WHEN {O.clean('t')} = '' OR u IS NULL THEN 'missing_title_or_url' END AS reason
  FROM blog_posts
)"""


@register("nrm_blog_posts", O.with_ctes(BLOG_CTE, body="SELECT idx, part, id, title, url, summary, published_at, source_name, reason FROM blog_out"))
def nrm_blog_posts(spark, sf_dir):
    """Blog posts (or blogs as posts) -> items."""
    out = N.normalize_blog_posts(blog_posts_raw(spark, sf_dir))
    return out.select("idx", "part", "id", "title", "url", "summary", "published_at", "source_name", "reason")


# ---------------- aggregated RSS ----------------

RSSD_CTE = f"""
rssd0 AS (
  SELECT doc_id AS idx, {O.clean(f"CASE WHEN doc_id % 19 = 0 THEN '' ELSE {_line(1)} END")} AS title,
         CASE WHEN doc_id % 8 <> 0 THEN 'https://feeds.example.com/' || source || '/' || doc_id END AS link,
         {O.clean('text')} AS summary, source AS feed_name,
         strftime(make_timestamp((1706659200 - (doc_id % 20) * 43200) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS published_at
  FROM documents
),
rssd_out AS (
  SELECT 'ak-rss-digest' AS source, 'rss_article' AS kind, idx,
    {_item_id('ak-rss-digest', 'feed_name', 'title', 'link')} AS id, title, link AS url, summary,
    {O.clean('feed_name')} AS source_name, 'ready' AS status, 'high' AS confidence, NULL::BOOLEAN AS has_direct_url,
    published_at,
    CASE WHEN title = '' OR NOT {O.nonempty('link')} THEN 'missing_title_or_url' END AS reason
  FROM rssd0
)"""


@register("nrm_rss_digest", O.with_ctes(RSSD_CTE, body="SELECT idx, id, title, url, summary, source_name, published_at, reason FROM rssd_out"))
def nrm_rss_digest(spark, sf_dir):
    out = N.normalize_rss_digest(rss_digest_items(spark, sf_dir))
    return out.select("idx", "id", "title", "url", "summary", "source_name", "published_at", "reason")


# ---------------- hot items ----------------

HOT_CTE = f"""
hot0 AS (
  SELECT doc_id AS idx, 'H' || doc_id AS hid,
    CASE WHEN doc_id % 31 = 0 THEN '' ELSE {_line(1)} END AS title_raw,
    CASE WHEN doc_id % 12 = 5 THEN NULL ELSE 'https://hot.example.com/i/' || doc_id END AS url,
    source AS sn, {_line(2)} AS summary_raw,
    (['ai-models', 'ai-products', 'industry', 'paper', 'tip'])[(doc_id % 5) + 1] AS category,
    (n_chars % 100)::DOUBLE AS score, doc_id % 3 = 0 AS selected,
    substring({_line(1)}, 1, 20) AS title_en_raw,
    CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN 'not-a-date'
         ELSE strftime(make_timestamp((1706659200 - 16 * 3600 - (doc_id * 3607) % (3 * 86400) + 86400) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS published_at
  FROM documents
),
hot1 AS (
  SELECT *, try_strptime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM hot0
),
hot2 AS (
  SELECT *, CASE WHEN NOT {O.nonempty('published_at')} THEN 'missing_published_at'
                 WHEN ts IS NULL THEN 'invalid_published_at'
                 WHEN (ts + INTERVAL 8 HOUR)::DATE <> DATE '{TARGET_DATE}' THEN 'outside_target_date' END AS date_reason
  FROM hot1
),
hot_out AS (
  SELECT 'aihot' AS source, 'aihot_item' AS kind, idx,
    {_item_id('aihot', O.first_nonempty('hid', 'url'), O.clean('title_raw'))} AS id,
    {O.clean('title_raw')} AS title, {O.clean('title_en_raw')} AS title_en, url, {O.clean('summary_raw')} AS summary,
    published_at, CASE WHEN {O.clean('sn')} <> '' THEN {O.clean('sn')} ELSE 'AI HOT' END AS source_name,
    category, score, selected, 'ready' AS status, CASE WHEN selected THEN 'high' ELSE 'medium' END AS confidence,
    true AS has_direct_url,
    coalesce(date_reason, CASE WHEN {O.clean('title_raw')} = '' OR NOT {O.nonempty('url')} THEN 'missing_title_or_url' END) AS reason
  FROM hot2
)"""


def _hot(spark, sf_dir):
    return N.normalize_hot_items(N.target_date_strict(hot_items_raw(spark, sf_dir), TARGET_DATE, "Asia/Shanghai"))


@register("flt_target_date_strict", O.with_ctes(HOT_CTE, body="SELECT idx, date_reason AS reason FROM hot2"))
def flt_target_date_strict(spark, sf_dir):
    """Hot items checked against the target local date (null reason = kept)."""
    return N.target_date_strict(hot_items_raw(spark, sf_dir), TARGET_DATE, "Asia/Shanghai").select("idx", "reason")


@register("nrm_hot_items", O.with_ctes(HOT_CTE, body="SELECT idx, id, title, title_en, url, summary, source_name, category, score, selected, confidence, reason FROM hot_out"))
def nrm_hot_items(spark, sf_dir):
    """Date-filtered hot items -> items; upstream drops kept with their reason."""
    return _hot(spark, sf_dir).select("idx", "id", "title", "title_en", "url", "summary", "source_name",
                                      "category", "score", "selected", "confidence", "reason")


# ---------------- all sources together ----------------

_ALL_CTES = (CAND_CTE, _cand_out(False), POSTS_CTE, POD_CTE, BLOG_CTE, RSSD_CTE, HOT_CTE)
_COMMON = "source, kind, idx, status, has_direct_url, reason"
_UNION = f"""all_rows AS (
  SELECT {_COMMON} FROM cand_out UNION ALL SELECT {_COMMON} FROM posts_out UNION ALL
  SELECT {_COMMON} FROM pod_out UNION ALL SELECT {_COMMON} FROM blog_out UNION ALL
  SELECT {_COMMON} FROM rssd_out UNION ALL SELECT {_COMMON} FROM hot_out)"""


def all_normalized(spark, sf_dir, deep: bool = False):
    """set_union_sources over the five normalisers (kept and dropped rows);
    ``deep``: candidates enriched from the landed detail reads."""
    reads = N.deep_read_outcome(deep_reads(spark, sf_dir)) if deep else None
    parts = [N.normalize_candidates(candidate_elements(spark, sf_dir), reads),
             N.normalize_posts(builder_posts(spark, sf_dir)),
             N.normalize_podcasts(podcast_episodes(spark, sf_dir), podcast_lines(spark, sf_dir)),
             N.normalize_blog_posts(blog_posts_raw(spark, sf_dir)),
             N.normalize_rss_digest(rss_digest_items(spark, sf_dir)),
             _hot(spark, sf_dir)]
    out = N.to_item_schema(parts[0])
    for p in parts[1:]:
        out = out.unionByName(N.to_item_schema(p))
    return out


def upstream_errors(spark, sf_dir):
    """(source, upstream_errors): failed feeds of the aggregated-RSS payload."""
    from .adapters import feed_entries_raw
    e = feed_entries_raw(spark, sf_dir).select("feed_name", "error").filter("error is not null")
    return e.agg(F.count_distinct("feed_name").alias("upstream_errors")).select(F.lit("ak-rss-digest").alias("source"), "upstream_errors")


def _stats(spark, sf_dir):
    return N.normalize_stats(all_normalized(spark, sf_dir, deep=True), upstream_errors(spark, sf_dir))


_FOLLOWUP = "status IN ('needs_deep_read', 'deferred_rate_limited', 'summary_only')"
_ERRORS_SQL = f"(SELECT count(DISTINCT source) FROM documents WHERE source IN ({', '.join(O.q(x) for x in ERROR_FEEDS)}))"


def _stats_sql(columns: str) -> str:
    some = "source, kind, idx, status, has_direct_url, reason, {} AS outcome, {} AS selected"
    rows = " UNION ALL ".join(f"SELECT {some.format(*x)} FROM {t}" for t, x in (
        ("cand_out", ("outcome", "NULL::BOOLEAN")), ("posts_out", ("NULL", "NULL")), ("pod_out", ("NULL", "NULL")), ("blog_out", ("NULL", "NULL")),
        ("rssd_out", ("NULL", "NULL")), ("hot_out", ("NULL", "selected"))))
    return O.with_ctes(CAND_CTE, _cand_out(True), *_ALL_CTES[2:], f"stat_rows AS ({rows})", f"""
stats AS (
  SELECT source, CASE WHEN b THEN count(*) END AS candidate_count, count(*) FILTER (WHERE reason IS NULL) AS normalized_items,
       count(*) FILTER (WHERE reason IS NOT NULL) AS dropped_items,
       CASE WHEN b THEN count(*) FILTER (WHERE reason IS NULL AND coalesce(has_direct_url, false))
            WHEN h THEN count(*) FILTER (WHERE reason IS NULL) END AS items_with_direct_url,
       CASE WHEN b THEN count(*) FILTER (WHERE reason IS NULL AND {_FOLLOWUP}) END AS items_needing_followup,
       CASE WHEN b THEN count(outcome) END AS deep_read_attempted,
       CASE WHEN b THEN count(*) FILTER (WHERE outcome = 'ok') END AS deep_read_completed,
       CASE WHEN b THEN count(*) FILTER (WHERE outcome = 'rate_limited') END AS deep_read_rate_limited,
       CASE WHEN f THEN count(*) FILTER (WHERE reason IS NULL AND kind = 'podcast_episode') END AS podcast_items,
       CASE WHEN f THEN count(*) FILTER (WHERE reason IS NULL AND kind = 'tweet') END AS tweet_items,
       CASE WHEN f THEN count(*) FILTER (WHERE reason IS NULL AND kind = 'blog_post') END AS blog_items,
       CASE WHEN source = 'ak-rss-digest' THEN {_ERRORS_SQL} END AS upstream_errors,
       CASE WHEN h THEN count(*) FILTER (WHERE reason IS NULL AND selected) END AS selected_items
  FROM (SELECT *, source = 'bestblogs' AS b, source = 'follow-builders' AS f, source = 'aihot' AS h FROM stat_rows)
  GROUP BY source, b, f, h
)""", body=f"SELECT {columns} FROM stats")


@register("agg_normalize_stats", _stats_sql("*"))
def agg_normalize_stats(spark, sf_dir):
    """Each source's normaliser statistics, detail reads included."""
    return _stats(spark, sf_dir)


@register("agg_drop_reasons", O.with_ctes(*_ALL_CTES, _UNION, body="""
SELECT source, reason, count(*) FILTER (WHERE reason IS NOT NULL) AS dropped FROM all_rows GROUP BY source, reason
HAVING count(*) FILTER (WHERE reason IS NOT NULL) > 0"""))
def agg_drop_reasons(spark, sf_dir):
    return N.drop_reasons(all_normalized(spark, sf_dir))


@register("flt_required_fields", O.with_ctes(*_ALL_CTES, _UNION, body="""
SELECT source, kind, idx,
       CASE WHEN reason IN ('missing_title', 'missing_title_or_url', 'missing_url') THEN reason END AS missing_field
FROM all_rows"""))
def flt_required_fields(spark, sf_dir):
    """Every row of the five sources with its missing-required-field reason
    (null when the required fields are present)."""
    a = all_normalized(spark, sf_dir)
    r = F.col("reason")
    return a.select("source", "kind", "idx",
                    F.when(r.isin("missing_title", "missing_title_or_url", "missing_url"), r).alias("missing_field"))


@register("flt_not_object", O.with_ctes(CAND_CTE, _cand_out(False), body="""
SELECT idx, reason, preview FROM cand_out WHERE reason = 'candidate_not_object'"""))
def flt_not_object(spark, sf_dir):
    """Payload elements that are not objects, with a preview."""
    out = N.normalize_candidates(candidate_elements(spark, sf_dir))
    return out.filter(F.col("reason") == "candidate_not_object").select("idx", "reason", "preview")


@register("set_union_dropped", O.with_ctes(HOT_CTE, body="SELECT idx, reason FROM hot_out WHERE reason IS NOT NULL"))
def set_union_dropped(spark, sf_dir):
    """Hot-item drops: the date filter's and the normaliser's own, unioned."""
    return N.dropped(_hot(spark, sf_dir)).select("idx", "reason")


@register("nrm_item_id", O.with_ctes(*_ALL_CTES, body="""
SELECT 'bestblogs' AS source, idx, id FROM cand_out WHERE id IS NOT NULL UNION ALL
SELECT 'ak-rss-digest', idx, id FROM rssd_out UNION ALL SELECT 'aihot', idx, id FROM hot_out"""))
def nrm_item_id(spark, sf_dir):
    """Stable item keys of three sources (null bits skipped)."""
    c = N.normalize_candidates(candidate_elements(spark, sf_dir)).filter(F.col("id").isNotNull())
    r = N.normalize_rss_digest(rss_digest_items(spark, sf_dir))
    h = _hot(spark, sf_dir)
    sel = lambda df, s: df.select(F.lit(s).alias("source"), "idx", "id")
    return sel(c, "bestblogs").unionByName(sel(r, "ak-rss-digest")).unionByName(sel(h, "aihot"))


def _fingerprint_sql() -> str:
    fields = sorted({f for fs in NORMALIZE_STATS.values() for f in fs})
    pairs = ", ".join(f"'\"{f}\":' || {f}" for f in fields)
    return _stats_sql(f"source, source || '|{{' || concat_ws(',', {pairs}) || '}}|' || normalized_items AS fingerprint")


@register("nrm_fingerprint", _fingerprint_sql())
def nrm_fingerprint(spark, sf_dir):
    """Run fingerprint per source: ``source|its stats as JSON (sorted keys)|count``."""
    return N.fingerprint(_stats(spark, sf_dir))
