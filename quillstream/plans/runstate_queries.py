"""Registered run-state, resume, retention and frequency queries."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import mail as M
from ..operators import runstate as RS
from ..session import work_path, work_table
from ..sources import inventory as INV
from ..sources import payloads as P
from . import landed as L
from . import oracle as O
from .adapters import RAW_NAME_A, RAW_NAME_B, TARGET_DATE, cache_files, mail_registry, note_files
from .registry import register


def _map_case(key: str, mapping: dict) -> str:
    return "(CASE " + key + " " + " ".join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in mapping.items()) + " END)"


_SRC = O._case_mod("doc_id % 6", K.DIGEST_SOURCES)
_LOOKUP = ", ".join([f"({O.q(n)}, {O.q(s)}, 'raw')" for n, s in K.RAW_CACHE_FILES.items()]
                    + [f"({O.q(n)}, {O.q(s)}, 'normalized')" for n, s in K.NORMALIZED_CACHE_FILES.items()]
                    + [f"({O.q(n)}, NULL, 'manifest')" for n in K.MANIFEST_FILES])
_ALL = ", ".join(O.q(s) for s in K.ALL_RUN_SOURCES)
_HEAVY = ", ".join(O.q(s) for s in K.HEAVY_SOURCES)
_MEMBERS = ", ".join(O.q(s) for s in K.EXTERNAL_GROUP_MEMBERS)
_STATUSES = "['Complete', 'pending', 'ready', 'failed']"

RUN_CTE = f"""
files0 AS (
  SELECT DATE '{TARGET_DATE}' - ((doc_id // 7) % 30)::INTEGER AS dt, doc_id, n_chars AS size_bytes, {_SRC} AS src,
         doc_id % 5 AS cls_i FROM documents
),
files1 AS (
  SELECT dt, doc_id, size_bytes, CASE
      WHEN cls_i = 0 THEN {_map_case('src', RAW_NAME_A)}
      WHEN cls_i = 1 AND src IN ({_HEAVY}) THEN src || '-normalized.json'
      WHEN cls_i = 1 THEN 'notes-' || doc_id || '.md'
      WHEN cls_i = 2 THEN (CASE WHEN doc_id % 2 = 0 THEN 'run-manifest.json' ELSE 'run-metadata.json' END)
      WHEN cls_i = 3 THEN 'scratch-' || doc_id || '.tmp'
      ELSE (CASE WHEN doc_id % 2 = 1 THEN 'websites.json' ELSE {_map_case('src', RAW_NAME_B)} END) END AS name
  FROM files0
),
files AS (SELECT dt, name, min(doc_id) AS doc_id FROM files1 GROUP BY dt, name),
lookup AS (SELECT * FROM (VALUES {_LOOKUP}) l(name, source, cls)),
classified AS (SELECT f.*, l.source, coalesce(l.cls, 'unknown') AS cls FROM files f LEFT JOIN lookup l USING (name)),
known AS (
  SELECT dt, source, cls FROM classified WHERE cls IN ('raw', 'normalized')
  UNION ALL SELECT dt, 'external_skills', cls FROM classified WHERE cls IN ('raw', 'normalized') AND source IN ({_MEMBERS})
),
flags AS (
  SELECT dt, source, count(*) FILTER (WHERE cls = 'raw') AS raw_files, count(*) FILTER (WHERE cls = 'normalized') AS normalized_files
  FROM known GROUP BY dt, source
),
man AS (
  SELECT dt, doc_id FROM (SELECT dt, doc_id, row_number() OVER (PARTITION BY dt ORDER BY name) AS n
                          FROM classified WHERE cls = 'manifest' AND doc_id % 7 <> 0) WHERE n = 1
),
man_src AS (
  SELECT dt, 'aihot' AS source, {_STATUSES}[(doc_id % 4) + 1] AS st, NULL::BOOLEAN AS done FROM man
  UNION ALL SELECT dt, 'bestblogs', NULL, doc_id % 3 = 0 FROM man
  UNION ALL SELECT dt, 'rss', {_STATUSES}[((doc_id + 1) % 4) + 1], NULL FROM man
  UNION ALL SELECT dt, 'websites', 'ready', NULL FROM man
  UNION ALL SELECT dt, 'follow-builders', {_STATUSES}[((doc_id + 2) % 4) + 1], NULL FROM man
),
grid AS (SELECT dt, unnest([{_ALL}]) AS source FROM (SELECT DISTINCT dt FROM files)),
st0 AS (
  SELECT g.dt, g.source, coalesce(f.raw_files, 0) > 0 AS has_raw, coalesce(f.normalized_files, 0) > 0 AS has_normalized,
         m.source IS NOT NULL AS has_manifest,
         coalesce(coalesce(m.done, false) OR lower(coalesce(m.st, '')) IN ('complete', 'completed', 'ready'), false) AS manifest_complete,
         g.source IN ({_HEAVY}) AS is_heavy
  FROM grid g LEFT JOIN flags f USING (dt, source) LEFT JOIN man_src m USING (dt, source)
),
st1 AS (
  SELECT *, CASE WHEN is_heavy THEN (CASE WHEN has_raw AND has_normalized THEN 'complete' WHEN has_raw THEN 'raw_only'
                                          WHEN has_normalized THEN 'normalized_only' WHEN manifest_complete THEN 'complete' ELSE 'missing' END)
                 ELSE (CASE WHEN has_raw OR manifest_complete THEN 'complete' ELSE 'missing' END) END AS status0
  FROM st0
),
grp AS (
  SELECT dt, bool_and(status0 = 'complete') AS all_c, bool_or(status0 = 'raw_only') AS any_raw_only FROM st1
  WHERE source IN ({_MEMBERS}) AND (has_raw OR has_normalized OR has_manifest) GROUP BY dt
),
states AS (
  SELECT s.dt, s.source, s.has_raw, s.has_normalized, s.manifest_complete,
         CASE WHEN s.source = 'external_skills' AND g.all_c IS NOT NULL
              THEN (CASE WHEN g.all_c THEN 'complete' WHEN g.any_raw_only THEN 'raw_only' ELSE 'partial' END)
              ELSE s.status0 END AS status
  FROM st1 s LEFT JOIN grp g USING (dt)
)"""


def _listed(spark, sf_dir):
    return INV.list_cache(spark, L.cache_folder(spark, sf_dir), partitioned=True)


def _states(spark, sf_dir):
    return RS.run_state(cache_files(spark, sf_dir))


@register("src_cache_inventory", O.with_ctes(RUN_CTE, body="SELECT dt, name, cls FROM classified"))
def src_cache_inventory(spark, sf_dir):
    """Every cached file of every day with its class, from a listing of the cache folder."""
    return RS.classify(_listed(spark, sf_dir)).select("dt", "name", "cls")


@register("jn_raw_vs_normalized", O.with_ctes(RUN_CTE, body="SELECT dt, source, raw_files, normalized_files FROM flags"))
def jn_raw_vs_normalized(spark, sf_dir):
    return RS.source_flags(RS.classify(cache_files(spark, sf_dir))).select("dt", "source", "raw_files", "normalized_files")


@register("jn_manifest", O.with_ctes(RUN_CTE, body="""
SELECT dt, source, coalesce(done, false) OR lower(coalesce(st, '')) IN ('complete', 'completed', 'ready') AS manifest_complete
FROM man_src"""))
def jn_manifest(spark, sf_dir):
    """Per day the first parseable manifest's per-source completeness."""
    return RS.manifest_entries(RS.classify(_listed(spark, sf_dir))).select("dt", "source", "manifest_complete")


@register("agg_run_state", O.with_ctes(RUN_CTE, body="""
SELECT dt, source, has_raw, has_normalized, manifest_complete, status FROM states WHERE source <> 'external_skills'"""))
def agg_run_state(spark, sf_dir):
    """Status per (day, source) by the truth table, over the whole backlog."""
    s = _states(spark, sf_dir)
    return s.filter(F.col("source") != "external_skills").select(
        "dt", "source", "has_raw", "has_normalized", "manifest_complete", "status")


@register("agg_run_group_rollup", O.with_ctes(RUN_CTE, body="SELECT dt, status FROM states WHERE source = 'external_skills'"))
def agg_run_group_rollup(spark, sf_dir):
    """Status of the external group per day (rolled up from its members)."""
    return _states(spark, sf_dir).filter(F.col("source") == "external_skills").select("dt", "status")


@register("src_note_state", O.with_ctes(RUN_CTE, body=f"""
SELECT dt, (DATE '{TARGET_DATE}' - dt) % 3 <> 2 AS raw_note_exists, (DATE '{TARGET_DATE}' - dt) % 3 = 0 AS summary_note_exists
FROM (SELECT DISTINCT dt FROM files)"""))
def src_note_state(spark, sf_dir):
    """Whether each listed day's notes exist, from a listing of the note folder."""
    notes = INV.list_cache(spark, L.note_folder(spark, sf_dir), partitioned=True)
    return INV.note_state(notes, _listed(spark, sf_dir)).select("dt", "raw_note_exists", "summary_note_exists")


def _reason_sql() -> str:
    heavy = " || ".join(
        f"CASE WHEN (SELECT status FROM states s WHERE s.dt = d.dt AND s.source = {O.q(h)}) = 'raw_only' "
        f"THEN [{O.q(h + K.REASON_RAW_ONLY.replace('{source}', ''))}] "
        f"WHEN (SELECT status FROM states s WHERE s.dt = d.dt AND s.source = {O.q(h)}) = 'normalized_only' "
        f"THEN [{O.q(h + K.REASON_NORMALIZED_ONLY.replace('{source}', ''))}] ELSE []::VARCHAR[] END"
        for h in K.HEAVY_SOURCES)
    return f"""
SELECT dt, len(r) > 0 AS is_partial_run, array_to_string(r, '; ') AS partial_reasons,
       CASE WHEN len(r) > 0 THEN {O.q(K.ACTION_INCREMENTAL)} ELSE {O.q(K.ACTION_EXISTING)} END AS recommended_action
FROM (
  SELECT d.dt, list_filter([CASE WHEN NOT raw_note THEN {O.q(K.REASON_RAW_NOTE_MISSING)} END,
                            CASE WHEN raw_note AND NOT summ THEN {O.q(K.REASON_SUMMARY_MISSING)} END,
                            CASE WHEN NOT summ THEN {O.q(K.REASON_SUMMARY_NOT_BUILT)} END], lambda x: x IS NOT NULL)
         || {heavy} AS r
  FROM (SELECT dt, (DATE '{TARGET_DATE}' - dt) % 3 <> 2 AS raw_note, (DATE '{TARGET_DATE}' - dt) % 3 = 0 AS summ
        FROM (SELECT DISTINCT dt FROM files)) d)"""


def partial_sql() -> str:
    """(dt, is_partial_run) of every listed day."""
    return f"SELECT dt, is_partial_run FROM ({_reason_sql()})"


def half_done(spark, sf_dir):
    """(dt, is_partial_run) of every listed day."""
    files = cache_files(spark, sf_dir)
    return RS.partial_reasons(RS.run_state(files), note_files(spark, sf_dir), files).select("dt", "is_partial_run")


@register("agg_partial_reasons", O.with_ctes(RUN_CTE, body=_reason_sql()))
def agg_partial_reasons(spark, sf_dir):
    """Why each day is half done, and the recommended action."""
    files = cache_files(spark, sf_dir)
    return RS.partial_reasons(RS.run_state(files), note_files(spark, sf_dir), files)


def _resume_sql():
    from .normalize_queries import _ALL_CTES, _UNION
    return O.with_ctes(RUN_CTE, *_ALL_CTES, _UNION, f"""
written AS (SELECT DATE '{TARGET_DATE}' AS dt, source, count(*) AS n_rows FROM all_rows GROUP BY source)""", body=f"""
SELECT s.dt, s.source, coalesce(w.n_rows, 0) AS n_rows FROM states s LEFT JOIN written w USING (dt, source)
WHERE s.status = 'raw_only' AND s.source IN ({_HEAVY})""")


@register("inc_resume", _resume_sql())
def inc_resume(spark, sf_dir):
    """(day, source) pairs with a raw file and no normalised one are normalised into
    the sink; the rows their partitions hold afterwards."""
    from .normalize_queries import all_normalized
    path = work_path(spark, "resumed")
    listed = work_table(_listed(spark, sf_dir), "listed")           # read four times
    states = work_table(RS.run_state(listed), "resume-states")
    items = all_normalized(spark, sf_dir).select("dt", "source", "kind", "idx", "reason")
    todo = P.resume_normalized(items, states, path)
    held = P.read_normalized(spark, path).groupBy("dt", "source").agg(F.count(F.lit(1)).alias("n_rows"))
    return todo.join(held, ["dt", "source"], "left").select("dt", "source", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


_FREQUENCIES = ("daily", "weekday", "weekly", "3x_week", "irregular")


def _due_sql(grid: str, got: str) -> str:
    """(source, frequency, day) of ``grid`` that are due, given ``got`` (source, d)."""
    return f"""SELECT g.source, g.frequency, g.day FROM {grid} g
  WHERE g.frequency IN ('daily', '3x_week', 'irregular') OR (g.frequency = 'weekday' AND dayofweek(g.day) BETWEEN 1 AND 5)
     OR (g.frequency = 'weekly' AND NOT EXISTS (SELECT 1 FROM {got} s WHERE s.source = g.source AND s.d BETWEEN g.day - 7 AND g.day - 1))"""


def _run_registry(spark):
    """Frequency of every run source (configuration, not data)."""
    rows = [(x, _FREQUENCIES[(i + 2) % 5]) for i, x in enumerate(K.ALL_RUN_SOURCES)]
    return spark.createDataFrame(rows, "source string, frequency string")


_RUN_REGISTRY_SQL = ", ".join(f"({O.q(x)}, {O.q(_FREQUENCIES[(i + 2) % 5])})" for i, x in enumerate(K.ALL_RUN_SOURCES))


@register("inc_weekly_skip", O.with_ctes(RUN_CTE, f"""
run_days AS (SELECT s.source, r.frequency, s.dt AS day FROM states s JOIN (VALUES {_RUN_REGISTRY_SQL}) r(source, frequency) USING (source)),
got AS (SELECT DISTINCT source, dt AS d FROM states WHERE has_raw),
due AS ({_due_sql('run_days', 'got')})""", body="""
SELECT s.dt, s.source, d.source IS NULL AS by_rule FROM states s LEFT JOIN due d ON d.source = s.source AND d.day = s.dt
WHERE s.status = 'complete' AND NOT s.has_raw AND NOT s.has_normalized AND s.manifest_complete"""))
def inc_weekly_skip(spark, sf_dir):
    """Sources without files that the manifest counts complete, and whether the
    frequency rule skips them on that day."""
    s = work_table(_states(spark, sf_dir), "states")
    grid = s.select("source", F.col("dt").alias("day")).join(_run_registry(spark), "source")
    due = RS.due_days(grid, s.filter("has_raw").select("source", F.col("dt").alias("d")))
    return RS.skipped_sources(s, due).select("dt", "source", "by_rule")


@register("inc_retention", O.with_ctes(RUN_CTE, body=f"""
SELECT DISTINCT dt, false AS deleted FROM files WHERE dt < DATE '{TARGET_DATE}' - INTERVAL {K.RETENTION_DAYS} DAY"""))
def inc_retention(spark, sf_dir):
    """Day partitions older than the retention window (dry run: listed, not deleted)."""
    f = cache_files(spark, sf_dir)
    cutoff = F.date_sub(F.lit(TARGET_DATE), K.RETENTION_DAYS)
    return f.filter(F.col("dt") < cutoff).select("dt").distinct().withColumn("deleted", F.lit(False))


# ---------------- frequency gating ----------------

_DAYS = [TARGET_DATE - _dt.timedelta(days=i) for i in range(6, -1, -1)]


def _frequency_sql():
    from .mail_queries import MAIL_CTE
    names = []
    for i in range(10):
        names.append((f"Letter {i}", _FREQUENCIES[i % 5]))
        if i in (3, 5):
            names.append((f"Letter {i} special", "weekly"))
    values = ", ".join(f"({O.q(n)}, {O.q(f)})" for n, f in names)
    ts = "try_strptime(date, '%a, %d %b %Y %H:%M:%S +0000')"
    return O.with_ctes(MAIL_CTE, f"""
grid AS (SELECT r.source, r.frequency, d.day::DATE AS day FROM (VALUES {values}) r(source, frequency)
         CROSS JOIN generate_series(DATE '{_DAYS[0]}', DATE '{_DAYS[-1]}', INTERVAL 1 DAY) d(day)),
got AS (SELECT DISTINCT source, ({ts} + INTERVAL 8 HOUR)::DATE AS d FROM mail_match WHERE {ts} IS NOT NULL)""",
                       body=_due_sql("grid", "got"))


@register("flt_frequency_due", _frequency_sql())
def flt_frequency_due(spark, sf_dir):
    """Which newsletter sources are due on each of the last seven days.
    Deliveries come from the matched mail."""
    from .mail_queries import _matched
    from ..functions import dates as D
    grid = mail_registry(spark).select(F.col("name").alias("source"), "frequency",
                                       F.explode(F.sequence(F.lit(_DAYS[0]), F.lit(_DAYS[-1]))).alias("day")).distinct()
    ts = D.parse_datetime("date", month_names=False)
    got = _matched(spark, sf_dir).select("source", D.local_date(ts, "Asia/Shanghai").alias("d"))
    return RS.due_days(grid, got).select("source", "frequency", "day")
