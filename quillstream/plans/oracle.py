"""DuckDB oracle SQL for the correctness gate.

Each helper mirrors a Spark column function of ``quillstream.functions`` as a
SQL snippet; the adapter CTEs mirror ``plans.adapters``. DuckDB regexes are
RE2: no backreferences and ASCII ``\\s``; the driver tables only hold ASCII
whitespace, so results agree on them (Unicode cases are unit-tested).
"""

from __future__ import annotations

from ..functions.constants import (AI_KEYWORDS, CONFIDENCE_POINTS, DIGEST_SOURCES, KIND_POINTS,
                                   KIND_POINTS_DEFAULT, STATUS_PENALTY)

AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
TARGET_DATE_SQL = "DATE '2024-01-30'"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------- scalar helpers ----------

def nonempty(e: str) -> str:
    return f"({e} IS NOT NULL AND {e} <> '')"


def collapse(e: str) -> str:
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def nourl(e: str) -> str:
    return f"regexp_replace({e}, 'https?://\\S+', '', 'gi')"


def clean(e: str) -> str:
    return f"coalesce({collapse(e)}, '')"


def clean_nourl(e: str) -> str:
    return f"coalesce({collapse(nourl(e))}, '')"


def cut(e: str, n: int) -> str:
    return f"(CASE WHEN length({e}) > {n} THEN rtrim(substring({e}, 1, {n - 1})) || '…' ELSE {e} END)"


def strip_ws(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def first_nonempty(*es: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({e}, '')" for e in es) + ")"


def keyword_hits(t: str, keywords) -> str:
    return "(" + " + ".join(f"contains({t}, {q(k)})::INTEGER" for k in keywords) + ")"


def joined_lower(*es: str) -> str:
    return "concat_ws(' ', " + ", ".join(f"CASE WHEN {nonempty(e)} THEN lower({e}) END" for e in es) + ")"


def lookup(e: str, mapping: dict, default) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in mapping.items())
    return f"(CASE {e} {whens} ELSE {default} END)"


def engagement(likes: str, replies: str, retweets: str) -> str:
    return f"(coalesce({likes}, 0)::BIGINT + coalesce({replies}, 0)::BIGINT * 2 + coalesce({retweets}, 0)::BIGINT * 2)"


def parse_datetime(e: str, month_names: bool = True) -> str:
    s = strip_ws(e)
    fmts = ["%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%d %H:%M:%S.%f"]
    if month_names:
        fmts += ["%b %d, %Y", "%B %d, %Y"]
    fmts += ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%a, %d %b %Y %H:%M:%S +0000",
             "%a, %d %b %Y %H:%M:%S +0000 (UTC)"]
    parts = ", ".join(f"try_strptime({s}, {q(f)})" for f in fmts)
    return f"(CASE WHEN {s} = '' THEN NULL ELSE coalesce({parts}) END)"


def age_days(ts: str, as_of: str = AS_OF_SQL) -> str:
    return f"greatest(floor((epoch_us({as_of}) - epoch_us({ts})) / 86400000000.0), 0)::INTEGER"


def source_ordinal(e: str = "source") -> str:
    whens = " ".join(f"WHEN {q(s)} THEN {i}" for i, s in enumerate(DIGEST_SOURCES))
    return f"(CASE {e} {whens} ELSE {len(DIGEST_SOURCES)} END)"


def priority(kw: str, url: str, hdu: str, conf: str, kind: str, score: str, eng: str, sig: str,
             age: str, status: str) -> str:
    k = f"coalesce({kind}, '')"
    p0 = (f"least(({kw}) * 8, 48)::DOUBLE"
          f" + (CASE WHEN {nonempty(url)} THEN 18 ELSE -30 END)"
          f" + (CASE WHEN coalesce({hdu}, false) THEN 10 ELSE 0 END)"
          f" + {lookup(f"coalesce({conf}, '')", CONFIDENCE_POINTS, 0)}"
          f" + {lookup(k, KIND_POINTS, KIND_POINTS_DEFAULT)}"
          f" + (CASE WHEN {score} IS NOT NULL THEN least({score}::DOUBLE / 4.0, 25.0) ELSE 0.0 END)"
          f" + least({eng} / 20.0, CASE WHEN {k} = 'tweet' THEN 6.0 ELSE 14.0 END)")
    p1 = (f"(CASE WHEN {k} = 'tweet' THEN least(({p0}) + (CASE WHEN {sig} IS NOT NULL THEN "
          f"least({sig}::DOUBLE * 4.0, 16.0) ELSE 0.0 END), 82.0) ELSE ({p0}) END)")
    pen = f"(CASE WHEN {age} > 30 THEN 35 WHEN {age} > 14 THEN 24 WHEN {age} > 7 THEN 14 ELSE 0 END)"
    st = lookup(f"coalesce({status}, '')", STATUS_PENALTY, 0)
    return f"round_even({p1} - {pen} - {st}, 2)"


# ---------- adapter CTEs ----------

def _case_mod(e: str, values) -> str:
    return "(CASE " + e + " " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values)) + " END)"


ITEMS_CTE = f"""
items_base AS (
  SELECT doc_id, text, source AS doc_source, n_chars,
         {_case_mod('doc_id % 6', DIGEST_SOURCES)} AS src,
         make_timestamp((1706659200 - (doc_id % 45) * 86400 + (doc_id * 7919) % 86400) * 1000000) AS ts
  FROM documents
),
items_kind AS (
  SELECT *, CASE src WHEN 'rss' THEN 'rss_entry' WHEN 'email' THEN 'newsletter'
      WHEN 'follow-builders' THEN {_case_mod('(doc_id // 6) % 3', ('tweet', 'podcast_episode', 'blog_post'))}
      WHEN 'bestblogs' THEN 'article_candidate' WHEN 'ak-rss-digest' THEN 'rss_article'
      ELSE 'aihot_item' END AS kind
  FROM items_base
),
items AS (
  SELECT DATE '2024-01-30' AS dt, src AS source, kind, doc_id AS idx,
         split_part(text, chr(10), 1) AS title,
         CASE WHEN doc_id % 10 <> 0 THEN 'https://news.example.com/' || src || '/' || doc_id::VARCHAR END AS url,
         CASE WHEN doc_id % 4 = 1 THEN text || ' https://t.example.com/' || doc_id::VARCHAR ELSE text END AS summary,
         doc_source AS source_name,
         CASE WHEN src IN ('bestblogs', 'aihot') THEN (n_chars % 101)::DOUBLE END AS score,
         CASE WHEN src = 'bestblogs' THEN {_case_mod('(doc_id // 6) % 5', ('needs_deep_read', 'summary_only', 'deferred_rate_limited', 'ready', 'ready'))} ELSE 'ready' END AS status,
         {_case_mod('doc_id % 3', ('high', 'medium', 'low'))} AS confidence,
         CASE WHEN doc_id % 13 = 0 THEN NULL
              WHEN doc_id % 7 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
              WHEN doc_id % 7 = 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
              WHEN doc_id % 7 = 2 THEN strftime(ts, '%b %d, %Y')
              WHEN doc_id % 7 = 3 THEN strftime(ts, '%Y-%m-%d')
              WHEN doc_id % 7 = 4 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
              WHEN doc_id % 7 = 5 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S +0000')
              ELSE strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') END AS published_at,
         ts AS event_ts,
         CASE WHEN kind = 'tweet' THEN (doc_id % 5)::INTEGER END AS signal_score,
         CASE WHEN kind = 'tweet' THEN n_chars % 50 END AS likes,
         CASE WHEN kind = 'tweet' THEN doc_id % 7 END AS retweets,
         CASE WHEN kind = 'tweet' THEN doc_id % 3 END AS replies
  FROM items_kind
)"""

COMPACT_CTE = f"""
compact0 AS (
  SELECT source, idx, coalesce(nullif(kind, ''), 'item') AS kind, url,
         source NOT IN ('rss', 'email') AS plain,
         {cut(clean_nourl('title'), 140)} AS title_c,
         {cut(clean_nourl('summary'), 240)} AS summary_240,
         {cut(clean_nourl('summary'), 220)} AS summary_220,
         {cut(clean_nourl('title'), 120)} AS title_120,
         {cut(clean_nourl('source_name'), 80)} AS source_name_c,
         status, confidence, score, published_at, signal_score,
         {engagement('likes', 'replies', 'retweets')} AS engagement
  FROM items
),
compact AS (
  SELECT source, idx, kind, title_c AS title, url,
         CASE WHEN plain THEN (CASE WHEN summary_240 <> '' THEN summary_240 ELSE title_120 END) ELSE summary_220 END AS summary,
         source_name_c AS source_name,
         CASE WHEN plain THEN coalesce(nullif(status, ''), 'ready') ELSE 'ready' END AS status,
         CASE WHEN source = 'rss' THEN 'high'
              WHEN source = 'email' THEN (CASE WHEN {nonempty('url')} THEN 'high' ELSE 'medium' END)
              ELSE coalesce(nullif(confidence, ''), 'medium') END AS confidence,
         score, {first_nonempty('published_at')} AS published_at,
         {nonempty('url')} AS has_direct_url, engagement, signal_score
  FROM compact0
),
scored0 AS (
  SELECT *, {parse_datetime('published_at')} AS published_ts FROM compact
),
scored1 AS (
  SELECT *, {age_days('published_ts')} AS age_days,
         {keyword_hits(joined_lower('title', 'summary', 'source_name'), AI_KEYWORDS)} AS kw
  FROM scored0
),
scored AS (
  SELECT * EXCLUDE (kw), {priority('kw', 'url', 'has_direct_url', 'confidence', 'kind', 'score',
                                    'engagement', 'signal_score', 'age_days', 'status')} AS priority
  FROM scored1
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY priority DESC, coalesce(score, 0) DESC,
         engagement DESC, coalesce(title, '') DESC, idx ASC) AS rank
  FROM scored
),
winners AS (SELECT * FROM ranked WHERE rank <= 8)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + "\n" + body
