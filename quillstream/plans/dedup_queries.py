"""Registered dedup, section and safety queries.

The cross-day rules run for every day of the item history at once (each
day's items against that day's previous 14 days), which is the batch form of
the daily rolling dedup.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import dedup as DD
from ..operators import digest as G
from ..operators import report as R
from ..operators import sections as SC
from ..session import spread, table, work_path, work_table
from ..sources import payloads as P
from . import oracle as O
from .adapters import TARGET_DATE, digest_items
from .digest_queries import scored_items
from .registry import register

_FACT = "'\\d+(?:[.,:/-]\\d+)*'"
_IND = ["idx % 3", "(idx // 3) % 3", "(idx // 9) % 3", "(idx // 27) % 3", "coalesce(quality, 1) * 2"]
_PER = ["(idx // 2) % 3", "(idx // 5) % 3", "(idx // 7) % 3", "(idx // 11) % 3", "(1 - coalesce(toxic, 0)) * 2"]


def _clip_sum(exprs) -> str:
    return "(" + " + ".join(f"least(greatest(coalesce({e}, 0), 0), 2)" for e in exprs) + ")"


DD_CTE = f"""
dd AS (
  SELECT i.idx, i.source, i.title, i.url, i.event_ts::DATE AS day, s.priority,
         trim(regexp_replace(lower(coalesce(i.title, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS event_key,
         list_distinct(regexp_extract_all(coalesce(i.summary, ''), {_FACT})) AS facts, l.quality, l.toxic
  FROM items i JOIN scored s USING (idx) LEFT JOIN labels l ON l.doc_id = i.idx
),
tracks AS (SELECT *, {_clip_sum(_IND)} AS industry_score, {_clip_sum(_PER)} AS personal_score FROM dd),
prior_days AS (SELECT DISTINCT event_key, day AS p_day FROM dd),
seen AS (SELECT DISTINCT t.idx FROM dd t JOIN prior_days p USING (event_key) WHERE t.event_key <> '' AND p.p_day >= t.day - 14 AND p.p_day < t.day),
pf AS (SELECT DISTINCT event_key, day AS p_day, unnest(facts) AS fact FROM dd),
tf AS (SELECT idx, event_key, day AS t_day, unnest(facts) AS fact FROM dd),
known AS (SELECT DISTINCT tf.idx, tf.fact FROM tf JOIN pf USING (event_key, fact) WHERE tf.event_key <> '' AND p_day >= t_day - 14 AND p_day < t_day),
newf AS (SELECT DISTINCT tf.idx FROM tf LEFT JOIN known k ON k.idx = tf.idx AND k.fact = tf.fact WHERE k.idx IS NULL),
key_days AS (
  SELECT d.event_key, d.day, bool_or(n.idx IS NOT NULL) AS any_new, row_number() OVER (PARTITION BY d.event_key ORDER BY d.day) AS n
  FROM dd d LEFT JOIN newf n ON n.idx = d.idx WHERE d.event_key <> '' GROUP BY d.event_key, d.day
),
log AS (
  SELECT event_key, n, day, NULL::DATE AS before, day AS last FROM key_days WHERE n = 1
  UNION ALL
  SELECT k.event_key, k.n, k.day, l.last, CASE WHEN k.day - l.last > 14 OR k.any_new THEN k.day ELSE l.last END
  FROM log l JOIN key_days k ON k.event_key = l.event_key AND k.n = l.n + 1
),
xday0 AS (
  SELECT d.idx, d.event_key, d.day, d.priority, coalesce(d.day - l.before <= 14, false) AS seen, n.idx IS NOT NULL AS has_new_fact
  FROM dd d LEFT JOIN log l ON l.event_key = d.event_key AND l.day = d.day LEFT JOIN newf n ON n.idx = d.idx
),
xday AS (SELECT *, NOT seen OR has_new_fact AS keep, seen AND has_new_fact AS is_continuation FROM xday0),
sec1 AS (
  SELECT *, CASE WHEN industry_score >= {K.INDUSTRY_MIN} THEN row_number() OVER (PARTITION BY day, industry_score >= {K.INDUSTRY_MIN}
              ORDER BY industry_score DESC, priority DESC, idx) END AS r1 FROM tracks
),
sec2 AS (
  SELECT *, coalesce(r1 <= {K.INDUSTRY_CAP}, false) AS ind,
         NOT coalesce(r1 <= {K.INDUSTRY_CAP}, false) AND personal_score >= {K.PERSONAL_MIN} AS pok FROM sec1
),
sec3 AS (
  SELECT *, CASE WHEN pok THEN row_number() OVER (PARTITION BY day, pok ORDER BY personal_score DESC, priority DESC, idx) END AS r2
  FROM sec2
),
sec4 AS (SELECT *, coalesce(r2 <= {K.PERSONAL_CAP}, false) AS per FROM sec3),
sec5 AS (
  SELECT *, CASE WHEN NOT ind AND NOT per THEN row_number() OVER (PARTITION BY day, NOT ind AND NOT per ORDER BY priority DESC, idx) END AS r3
  FROM sec4
),
sections AS (
  SELECT idx, day, event_key, industry_score, personal_score,
         CASE WHEN ind THEN 'industry' WHEN per THEN 'personal' WHEN r3 <= {K.WATCH_CAP} THEN 'watch' END AS section
  FROM sec5
)"""

_ALL = (O.ITEMS_CTE, O.COMPACT_CTE, DD_CTE)


def _dd(spark, sf_dir):
    """Items with day, event key, facts, priority and label columns, written
    once: a query's rules all read this narrow table, not the texts."""
    it = digest_items(spark, sf_dir).select("idx", "source", "title", "url", F.to_date("event_ts").alias("day"),
                                            DD.event_key("title").alias("event_key"), DD.facts("summary").alias("facts"))
    pr = scored_items(spark, sf_dir).select("idx", "priority")
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), "quality", "toxic")
    return work_table(it.join(pr, "idx").join(lab, "idx", "left").select(
        "idx", "source", "title", "url", "day", "priority", "event_key", "facts", "quality", "toxic"), "dd")


def _tracks(df):
    i = F.col("idx")
    ind = [i % 3, F.floor(i / 3) % 3, F.floor(i / 9) % 3, F.floor(i / 27) % 3, F.coalesce("quality", F.lit(1)) * 2]
    per = [F.floor(i / 2) % 3, F.floor(i / 5) % 3, F.floor(i / 7) % 3, F.floor(i / 11) % 3,
           (1 - F.coalesce("toxic", F.lit(0))) * 2]
    return SC.with_track_scores(df, ind, per)


def _xday(dd):
    return DD.cross_day(dd.select("idx", "event_key", "day", "facts"))


@register("ddp_cross_day", O.with_ctes(*_ALL, body="SELECT idx, seen, has_new_fact, keep FROM xday"))
def ddp_cross_day(spark, sf_dir):
    """Every item against its previous 14 days: seen, new facts, kept."""
    return _xday(_dd(spark, sf_dir)).select("idx", "seen", "has_new_fact", "keep")


@register("jn_recent_semi", O.with_ctes(*_ALL, body="SELECT idx FROM seen"))
def jn_recent_semi(spark, sf_dir):
    """Items whose event key already appeared in the previous 14 days."""
    d = _dd(spark, sf_dir).select("idx", "event_key", "day").filter("event_key <> ''")
    before = F.lag("day").over(Window.partitionBy("event_key").orderBy("day"))
    again = (d.select("event_key", "day").distinct().withColumn("_b", before)
             .filter(F.datediff("day", "_b") <= 14).drop("_b"))
    return d.join(again, ["event_key", "day"]).select("idx")


@register("ddp_continuation", O.with_ctes(*_ALL, body=f"""
SELECT idx, is_continuation, CASE WHEN is_continuation THEN priority - {K.CONTINUATION_PENALTY} ELSE priority END AS adjusted_priority
FROM xday WHERE keep"""))
def ddp_continuation(spark, sf_dir):
    """Kept items; kept repeats are continuations and lose 2 points."""
    dd = _dd(spark, sf_dir)
    x = _xday(dd).filter(F.col("keep")).join(dd.select("idx", "priority"), "idx")
    adj = F.when(F.col("is_continuation"), F.col("priority") - K.CONTINUATION_PENALTY).otherwise(F.col("priority"))
    return x.select("idx", "is_continuation", adj.alias("adjusted_priority"))


@register("agg_track_score", O.with_ctes(*_ALL, body="SELECT idx, industry_score, personal_score FROM tracks"))
def agg_track_score(spark, sf_dir):
    """Industry and personal track scores (five clipped 0-2 factors each)."""
    return _tracks(_dd(spark, sf_dir)).select("idx", "industry_score", "personal_score")


def _sections(dd):
    return SC.place_sections(_tracks(dd))


@register("win_section_quota", O.with_ctes(*_ALL, body="SELECT idx, day, industry_score, personal_score, section FROM sections"))
def win_section_quota(spark, sf_dir):
    """Each item placed in one section per day: industry, personal, watch (caps)."""
    return _sections(_dd(spark, sf_dir)).select("idx", "day", "industry_score", "personal_score", "section")


@register("ddp_headline_3d", O.with_ctes(*_ALL, body=f"""
SELECT s.idx, s.section, CASE WHEN r.idx IS NOT NULL AND NOT x.has_new_fact THEN 'watch' ELSE s.section END AS final_section,
       r.idx IS NOT NULL AND NOT x.has_new_fact AS demoted
FROM sections s JOIN xday x USING (idx)
LEFT JOIN (SELECT DISTINCT t.idx FROM sections t JOIN (SELECT DISTINCT event_key, day AS h_day FROM sections WHERE section = 'industry') h
           USING (event_key) WHERE t.section = 'industry' AND h.h_day >= t.day - {K.HEADLINE_LOOKBACK_DAYS} AND h.h_day < t.day) r
  USING (idx)"""))
def ddp_headline_3d(spark, sf_dir):
    """Industry items that led the section in the last 3 days without new
    facts are demoted to watch."""
    dd = _dd(spark, sf_dir)
    s = work_table(_sections(dd).select("idx", "event_key", "day", "section"), "sections")
    t = s.join(_xday(dd).select("idx", "has_new_fact"), "idx")
    return SC.headline_repeat(t, s).select("idx", "section", "final_section", "demoted")


_T = TARGET_DATE


@register("ddp_log_upkeep", O.with_ctes(*_ALL, body=f"""
SELECT idx, event_key, day FROM xday WHERE day > DATE '{_T}' - 14 AND day <= DATE '{_T}' AND keep"""))
def ddp_log_upkeep(spark, sf_dir):
    """The rolling event log after the target day: the kept events of the
    days inside the window, the target day included."""
    x = _xday(_dd(spark, sf_dir)).select("idx", "event_key", F.col("t_day").alias("day"), "keep")
    return x.filter((F.col("day") > F.date_sub(F.lit(_T), 14)) & (F.col("day") <= F.lit(_T)) & F.col("keep")).drop("keep")


@register("inc_rolling_dedup", O.with_ctes(O.ITEMS_CTE, """
keyed AS (
  SELECT idx, event_ts, event_ts::DATE AS day, trim(regexp_replace(lower(coalesce(title, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS event_key FROM items
),
key_days AS (
  SELECT event_key, day, arg_min(idx, (event_ts, idx)) AS first_idx, row_number() OVER (PARTITION BY event_key ORDER BY day) AS n
  FROM keyed WHERE event_key <> '' GROUP BY event_key, day
),
log AS (
  SELECT event_key, n, day, first_idx, day AS last FROM key_days WHERE n = 1
  UNION ALL
  SELECT k.event_key, k.n, k.day, k.first_idx, CASE WHEN k.day - l.last > 14 THEN k.day ELSE l.last END
  FROM log l JOIN key_days k ON k.event_key = l.event_key AND k.n = l.n + 1
)""", body="SELECT idx, event_key = '' OR event_ts IS NULL OR idx IN (SELECT first_idx FROM log WHERE day = last) AS keep FROM keyed"))
def inc_rolling_dedup(spark, sf_dir):
    """Rolling 14-day dedup over the item stream (batch form)."""
    it = digest_items(spark, sf_dir).select("idx", "title", "event_ts").withColumn("event_key", DD.event_key("title"))
    return DD.rolling_keep(it, window_days=K.DEDUP_WINDOW_DAYS).select("idx", "keep")


def _event_items(spark, sf_dir):
    """Scored items with title, day and the URL they were posted with: one in
    ten is a repost of the item before it, under a link with tracking keys."""
    posted = F.when(F.col("idx") % 10 == 5, F.concat(F.lit("HTTP://www.News.example.com/story/"), (F.col("idx") - 1).cast("string"),
                                                      F.lit("/?utm_source=feed#top"))).when(
        F.col("idx") % 10 == 4, F.concat(F.lit("https://news.example.com/story/"), F.col("idx").cast("string"))).otherwise(F.col("url"))
    it = digest_items(spark, sf_dir).select("idx", "title", posted.alias("url"), F.to_date("event_ts").alias("day"))
    return scored_items(spark, sf_dir).select("idx", "source", "priority").join(it, "idx")


@register("ddp_event_units", None)
def ddp_event_units(spark, sf_dir):
    """Event units: items of one canonical URL, and items of one title or with
    near-duplicate texts within the 14-day window; components of those links,
    highest-priority representative."""
    items = work_table(_event_items(spark, sf_dir), "event-items")
    texts = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "text"), "idx")
    return DD.event_units(items, texts.join(items.select("idx", "day"), "idx"), window_days=K.DEDUP_WINDOW_DAYS)


@register("agg_event_coverage", None)
def agg_event_coverage(spark, sf_dir):
    """Distinct sources per event unit (units with more than one item)."""
    u = ddp_event_units(spark, sf_dir)
    return u.filter(F.col("is_representative") & (F.col("unit_size") > 1)).select("unit", "unit_size", "n_sources")


_PLAIN = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _vendors(spark, sf_dir):
    """Vendor table (vendor, name): each benchmark item is a vendor, named by
    the first two words of its text."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("vendor"), F.substring_index(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")), " ", 2).alias("name"))


@register("jn_vendor_coverage", O.with_ctes(O.ITEMS_CTE, O.COMPACT_CTE, f"""
vendors AS (SELECT item_id AS vendor, array_to_string(string_split({_PLAIN.format('text')}, ' ')[1:2], ' ') AS name FROM benchmark),
named AS (
  SELECT i.idx, v.vendor, s.priority FROM items i JOIN scored s USING (idx)
  JOIN vendors v ON v.name <> '' AND contains(' ' || {_PLAIN.format("concat_ws(' ', i.title, i.summary)")} || ' ', ' ' || v.name || ' ')
)""", body=f"""
SELECT v.vendor, v.idx FROM (SELECT vendor, arg_max(idx, (priority, -idx)) AS idx FROM named GROUP BY vendor) v
WHERE v.idx NOT IN (SELECT idx FROM winners ORDER BY priority DESC, coalesce(score, 0) DESC, engagement DESC,
                    coalesce(title, '') DESC, {O.source_ordinal()}, rank LIMIT 18)"""))
def jn_vendor_coverage(spark, sf_dir):
    """Vendors named in the items whose best item did not make the overall top 18."""
    scored = work_table(scored_items(spark, sf_dir), "scored")
    items = digest_items(spark, sf_dir).select("idx", "title", "summary")
    chosen = G.top_overall(G.top_per_source(scored)).select("idx")
    return SC.uncovered_vendors(SC.vendor_mentions(items, _vendors(spark, sf_dir)), scored, chosen)


_NOISE_SQL = " ".join(f"WHEN regexp_matches(t, {O.q('(?i)' + p)}) THEN {O.q(n)}" for n, p in K.EDITORIAL_NOISE_PATTERNS)


@register("flt_noise_editorial", O.with_ctes(O.ITEMS_CTE, body=f"""
SELECT idx, CASE {_NOISE_SQL}
  WHEN NOT (url IS NOT NULL AND url <> '') AND len(regexp_extract_all(coalesce(summary, ''), '[\\p{{L}}\\p{{N}}_''’-]+')) < {K.TEASER_MAX_WORDS} THEN 'vague_teaser'
  WHEN toxic = 1 THEN 'label_toxic' WHEN quality = 0 THEN 'label_low_quality' END AS noise_reason
FROM (SELECT i.*, lower(concat_ws(' ', coalesce(title, ''), coalesce(summary, ''))) AS t, l.quality, l.toxic
      FROM items i LEFT JOIN labels l ON l.doc_id = i.idx)"""))
def flt_noise_editorial(spark, sf_dir):
    """Editorial noise reason per item (ads, hiring, subscriptions, teasers,
    label verdicts); null = clean."""
    it = digest_items(spark, sf_dir)
    lab = table(spark, sf_dir, "labels")
    return SC.editorial_noise(it, lab).select("idx", "noise_reason")


_PRIVATE = ("/root/private", "Second Brain")


@register("flt_publish_safety", f"""
SELECT d.doc_id, b.item_id AS pattern_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)
UNION ALL SELECT doc_id, -1 FROM documents WHERE contains(text, {O.q(_PRIVATE[0])})
UNION ALL SELECT doc_id, -2 FROM documents WHERE contains(text, {O.q(_PRIVATE[1])})""")
def flt_publish_safety(spark, sf_dir):
    """One problem per (document, pattern): benchmark passages and fixed
    private strings found in document texts."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    pats = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pattern_id"), F.col("text").alias("pattern"))
    return SC.publish_safety(docs, pats, _PRIVATE)


def _quality_sql():
    from .runstate_queries import RUN_CTE, partial_sql
    text = "text"
    return O.with_ctes(RUN_CTE, f"half AS ({partial_sql()})", f"""
q AS (
  SELECT doc_id, coalesce(regexp_matches({text}, '\\{{\\{{.*?\\}}\\}}'), false) AS has_residue,
         concat_ws(',', CASE WHEN NOT regexp_matches({text}, '(?m)^# ') THEN '#' END, CASE WHEN NOT regexp_matches({text}, '(?m)^## ') THEN '##' END) AS missing_headings,
         DATE '{_T}' - (doc_id % 40)::INTEGER AS dt
  FROM documents
)""", body="""
SELECT doc_id, has_residue, missing_headings, coalesce(h.is_partial_run, true) AS day_partial,
       NOT has_residue AND missing_headings = '' AND NOT coalesce(h.is_partial_run, true) AS publishable
FROM q LEFT JOIN half h USING (dt)""")


@register("flt_output_quality", _quality_sql())
def flt_output_quality(spark, sf_dir):
    """Template residue and required headings of every text, and whether its
    day's run is only half done."""
    from .runstate_queries import half_done
    day = F.date_sub(F.lit(_T), (F.col("doc_id") % 40).cast("int")).alias("dt")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", day)
    return SC.output_quality(d, half_done(spark, sf_dir)).select("doc_id", "has_residue", "missing_headings", "day_partial", "publishable")


@register("snk_raw_note", O.with_ctes(O.ITEMS_CTE, O.COMPACT_CTE, body=f"""
SELECT DISTINCT source, '- **' || title || '** ' || coalesce(url, '') AS line FROM scored"""))
def snk_raw_note(spark, sf_dir):
    """The raw notes of the day, one for each source with its lines by time then id:
    appended to the note folder and read back."""
    s = scored_items(spark, sf_dir)
    line = F.concat(F.lit("- **"), F.col("title"), F.lit("** "), F.coalesce("url", F.lit("")))
    path = work_path(spark, "raw-notes")
    P.append_notes(s.select(F.lit(TARGET_DATE).alias("dt"), "source", F.struct(F.col("published_ts").isNull(), "published_ts", "idx").alias("ord"),
                            line.alias("line")), path)
    return P.read_notes(spark, path).select("source", "line")


@register("snk_summary_stats", O.with_ctes(*_ALL, body=f"""
SELECT count(*) AS raw_items, count(*) FILTER (WHERE x.keep) AS after_dedup,
       count(*) FILTER (WHERE s.section = 'industry') AS industry, count(*) FILTER (WHERE s.section = 'personal') AS personal,
       count(*) FILTER (WHERE s.section = 'watch') AS watch
FROM sections s JOIN xday x USING (idx) WHERE s.day = DATE '{_T}'"""))
def snk_summary_stats(spark, sf_dir):
    """Front-matter counts of the target day: raw, after dedup, per section."""
    dd = _dd(spark, sf_dir)
    s = _sections(dd.filter(F.col("day") == F.lit(_T))).select("idx", "section")
    j = s.join(_xday(dd).filter(F.col("t_day") == F.lit(_T)).select("idx", "keep"), "idx")
    return j.agg(F.count(F.lit(1)).alias("raw_items"), F.count_if("keep").alias("after_dedup"),
                 F.count_if(F.col("section") == "industry").alias("industry"),
                 F.count_if(F.col("section") == "personal").alias("personal"),
                 F.count_if(F.col("section") == "watch").alias("watch"))


def _late_mail_sql():
    from .mail_queries import MAIL_CTE
    lo = _dt.datetime.combine(_T - _dt.timedelta(days=2), _dt.time())
    hi = _dt.datetime.combine(_T + _dt.timedelta(days=2), _dt.time())
    ts = "try_strptime(date, '%a, %d %b %Y %H:%M:%S +0000')"
    return O.with_ctes(MAIL_CTE, body=f"""
SELECT idx, source FROM mail_match WHERE {ts} BETWEEN TIMESTAMP '{lo}' AND TIMESTAMP '{hi}'
  AND ({ts} + INTERVAL 8 HOUR)::DATE = DATE '{_T}'""")


@register("inc_late_mail", _late_mail_sql())
def inc_late_mail(spark, sf_dir):
    """Late and cross-midnight mail: messages dated (UTC) from two days
    before to one day after the target, kept when their local date is the
    target."""
    from ..functions import dates as D
    from .mail_queries import _matched
    m = _matched(spark, sf_dir)
    ts = D.parse_datetime("date", month_names=False)
    lo = _dt.datetime.combine(_T - _dt.timedelta(days=2), _dt.time())
    hi = _dt.datetime.combine(_T + _dt.timedelta(days=2), _dt.time())
    w = m.filter(ts.between(F.lit(lo), F.lit(hi)))
    return w.filter(D.local_date(ts, "Asia/Shanghai") == F.lit(_T)).select("idx", "source")
