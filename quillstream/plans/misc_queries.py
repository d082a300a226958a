"""Column views of combined queries under their own inventory IDs, the
ordered listings, the union of all six sources, sinks and JSON sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mail as M
from ..operators import normalize as N
from ..session import work_path
from ..sources import payloads as P
from . import landed as L
from . import oracle as O
from .adapters import tasks
from .registry import ORACLE, QUERIES, register

# (new id, query it is a column view of, columns)
_VIEWS = [
    ("fn_clean_text_nourl", "fn_clean_text", ["doc_id", "clean_nourl_240"]),
    ("fn_clean_text_mail", "fn_clean_text", ["doc_id", "clean_mail"]),
    ("fn_preview", "fn_clean_text", ["doc_id", "preview_80"]),
    ("fn_visible_text", "flt_url_only", ["idx", "visible_text"]),
    ("fn_word_count", "fn_signal_score", ["idx", "word_count"]),
    ("fn_post_title", "nrm_posts", ["idx", "title"]),
    ("fn_engagement", "fn_ai_keyword_score", ["source", "idx", "engagement"]),
    ("fn_parse_datetime_fresh", "fn_parse_datetime", ["idx", "parsed_fresh"]),
    ("fn_age_days", "fn_parse_datetime", ["idx", "age_days"]),
    ("fn_freshness_bucket", "fn_parse_datetime", ["idx", "freshness"]),
    ("fn_local_time", "fn_local_date", ["id", "local_time"]),
    ("fn_session_type", "fn_session_minutes", ["id", "session_type"]),
    ("fn_pomodoros", "fn_session_minutes", ["id", "minutes", "pomodoros"]),
]


def _view(base, cols):
    def run(spark, sf_dir):
        return QUERIES[base](spark, sf_dir).select(*cols)
    return run


for _new, _base, _cols in _VIEWS:
    _sql = ORACLE.get(_base)
    register(_new, None if _sql is None else f"SELECT {', '.join(_cols)} FROM ({_sql}) q")(_view(_base, _cols))


# ---------------- ordered listings ----------------

from .normalize_queries import HOT_CTE  # noqa: E402
from .task_queries import TASKS_CTE  # noqa: E402


@register("srt_tasks_in_project", O.with_ctes(TASKS_CTE, body="""
SELECT id, due_date, priority FROM tasks WHERE project_id = 'P-building' AND status = 0
ORDER BY coalesce(due_date, ''), priority DESC, id"""))
def srt_tasks_in_project(spark, sf_dir):
    """A project's open tasks: due ascending (missing first), priority descending."""
    t = tasks(spark, sf_dir).filter((F.col("project_id") == "P-building") & (F.col("status") == 0))
    return t.orderBy(F.coalesce("due_date", F.lit("")), F.col("priority").desc(), "id").select("id", "due_date", "priority")


@register("srt_completed", O.with_ctes(TASKS_CTE, body="""
SELECT id, completed_time FROM tasks WHERE status = 2 ORDER BY completed_time, id"""))
def srt_completed(spark, sf_dir):
    """Completed tasks by completion time."""
    return tasks(spark, sf_dir).filter(F.col("status") == 2).orderBy("completed_time", "id").select("id", "completed_time")


# ---------------- all six sources ----------------

def _union_sql():
    from .mail_queries import FEED_CTE, MAIL_CTE
    from .normalize_queries import _ALL_CTES
    body = """
SELECT 'rss' AS source, 'rss_entry' AS kind, idx, title, link AS url FROM feed_day
UNION ALL SELECT 'email', 'newsletter', idx, coalesce(nullif(subject, ''), '') AS title, NULL FROM mail_entries
UNION ALL SELECT source, kind, idx, title, url FROM (
  SELECT source, kind, idx, title, url, reason FROM cand_out UNION ALL SELECT source, kind, idx, title, url, reason FROM posts_out
  UNION ALL SELECT source, kind, idx, title, url, reason FROM pod_out UNION ALL SELECT source, kind, idx, title, url, reason FROM blog_out
  UNION ALL SELECT source, kind, idx, title, url, reason FROM rssd_out UNION ALL SELECT source, kind, idx, title, url, reason FROM hot_out)
WHERE reason IS NULL"""
    return O.with_ctes(FEED_CTE, MAIL_CTE, *_ALL_CTES, body=body)


@register("set_union_sources", _union_sql())
def set_union_sources(spark, sf_dir):
    """Kept items of all six sources in one frame (feeds, mail and the four
    normalised payloads), unioned by name with missing columns as null."""
    from .mail_queries import _entries, _feed_day
    from .normalize_queries import all_normalized
    feeds = M.feed_items(_feed_day(spark, sf_dir)).select("source", "kind", "idx", "title", "url")
    mail = M.newsletter_items(_entries(spark, sf_dir)).select("source", "kind", "idx", "title", "url")
    norm = N.kept(all_normalized(spark, sf_dir)).select("source", "kind", "idx", "title", "url")
    return feeds.unionByName(mail, allowMissingColumns=True).unionByName(norm, allowMissingColumns=True)


# ---------------- sinks ----------------

def _snk_sql():
    from .normalize_queries import _ALL_CTES, _UNION
    return O.with_ctes(*_ALL_CTES, _UNION, body="""
SELECT source, kind, idx, CASE WHEN reason IS NULL THEN 'kept' ELSE 'dropped' END AS outcome FROM all_rows""")


@register("snk_normalized", _snk_sql())
def snk_normalized(spark, sf_dir):
    """Normalised rows written by day and source and read back from the sink."""
    from .normalize_queries import all_normalized
    path = work_path(spark, "normalized")
    P.write_normalized(all_normalized(spark, sf_dir).select("dt", "source", "kind", "idx", "reason"), path)
    return spark.read.parquet(path).select("source", "kind", "idx", "outcome")


@register("snk_json", O.with_ctes(TASKS_CTE, body="""
SELECT id, concat('{"id":', to_json(id), coalesce(',"project_id":' || to_json(project_id), ''), ',"column_id":', to_json(column_id),
  ',"title":', to_json(title), ',"content":', to_json(content), ',"priority":', priority, coalesce(',"due_date":' || to_json(due_date), ''),
  ',"tags":', to_json(tags), ',"status":', status, coalesce(',"completed_time":' || to_json(completed_time), ''), '}') AS json
FROM tasks"""))
def snk_json(spark, sf_dir):
    """Task rows as JSON text (the ``--json`` output form); null fields are left out."""
    t = tasks(spark, sf_dir)
    return t.select("id", F.to_json(F.struct(*[F.col(c) for c in t.columns if c != "order_key"])).alias("json"))


# ---------------- JSON sources ----------------

@register("src_json_cache", O.with_ctes(HOT_CTE, body=f"""
SELECT hid AS id, title_raw AS title, url, sn AS source, published_at AS publishedAt, category, score::INTEGER AS score, selected
FROM hot0 WHERE (idx // {L.PAGE_ITEMS}) % 7 <> {L.BAD_PAGE}"""))
def src_json_cache(spark, sf_dir):
    """Items of the landed hot-item payload files; a corrupt file gives none."""
    pages = P.read_payloads(spark, L.hot_pages(spark, sf_dir), P.PAGE_SCHEMA)
    return P.page_items(pages).select("id", "title", "url", "source", "publishedAt", "category", "score", "selected")


_SNAPSHOT = f"(order_key // {L.SNAPSHOT_KEYS}) % 11 <> {L.BAD_ENVELOPE}"


@register("src_task_snapshot", O.with_ctes(TASKS_CTE, body=f"SELECT id, title, len(tags) AS n_tags, status FROM tasks WHERE {_SNAPSHOT}"))
def src_task_snapshot(spark, sf_dir):
    """Tasks of the landed snapshot envelopes; a corrupt envelope gives none."""
    t = P.snapshot_tasks(P.read_payloads(spark, L.task_snapshots(spark, sf_dir), P.SNAPSHOT_SCHEMA, multiline=False))
    return t.select("id", "title", F.size(F.coalesce("tags", F.array().cast("array<string>"))).alias("n_tags"), "status")


@register("src_snapshot_tags", O.with_ctes(TASKS_CTE, body=f"""
SELECT DISTINCT name, CASE WHEN contains(name, '/') THEN split_part(name, '/', 1) END AS parent
FROM (SELECT unnest(tags) AS name FROM tasks WHERE {_SNAPSHOT})"""))
def src_snapshot_tags(spark, sf_dir):
    """The tags table of the landed snapshot envelopes."""
    return P.snapshot_tags(P.read_payloads(spark, L.task_snapshots(spark, sf_dir), P.SNAPSHOT_SCHEMA, multiline=False))


@register("src_project_data", O.with_ctes(TASKS_CTE, body="""
SELECT p.id, p.name, count(t.id) FILTER (WHERE t.status = 0) AS open_tasks, 3::BIGINT AS n_columns
FROM projects p LEFT JOIN tasks t ON t.project_id = p.id GROUP BY p.id, p.name"""))
def src_project_data(spark, sf_dir):
    """Per project its open tasks and board columns, from the landed project envelopes."""
    return P.project_sizes(P.read_payloads(spark, L.project_data(spark, sf_dir), P.PROJECT_SCHEMA, multiline=False))
