"""Registered task and focus queries over the task adapters."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..functions.constants import INBOX_LABEL
from ..operators import focus as FO
from ..operators import tasks as TK
from ..session import table
from . import oracle as O
from .adapters import FOCUS_DAY, TASK_TODAY, checklist_tasks, columns, focus_sessions, projects, tasks
from .registry import register

_SVC = "%Y-%m-%dT%H:%M:%S.%g+0000"

TASKS_CTE = f"""
tasks AS (
  SELECT 'T' || o_orderkey AS id,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 17 = 1 THEN 'inbox' || o_orderkey
         WHEN o_orderkey % 17 = 2 THEN 'gone-' || lower(c_mktsegment) ELSE 'P-' || lower(c_mktsegment) END AS project_id,
    'C-' || lower(c_mktsegment) || '-' || (o_orderkey % 3) AS column_id,
    c_name || ' order ' || o_orderkey AS title,
    o_orderpriority || ' ' || n_name AS content,
    (CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 5 WHEN '2' THEN 5 WHEN '3' THEN 3 WHEN '4' THEN 0
          WHEN '5' THEN 1 ELSE 0 END)::INTEGER AS priority,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 11 = 1 THEN strftime(o_orderdate, '%Y-%m-%d')
         ELSE strftime(o_orderdate + to_hours((o_orderkey % 24)::INTEGER), '{_SVC}') END AS due_date,
    CASE WHEN o_orderkey % 5 = 0 THEN []::VARCHAR[]
         ELSE [lower(c_mktsegment), c_mktsegment || '/' || n_name] END AS tags,
    (CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END)::INTEGER AS status,
    CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + to_seconds((o_orderkey % 86400)::INTEGER), '{_SVC}') END AS completed_time,
    o_orderkey AS order_key
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
),
projects AS (
  SELECT DISTINCT 'P-' || lower(c_mktsegment) AS id,
         upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS name,
         '#' || substr(md5(c_mktsegment), 1, 6) AS color,
         CASE length(c_mktsegment) % 3 WHEN 0 THEN 'list' WHEN 1 THEN 'kanban' ELSE 'timeline' END AS view_mode
  FROM customer
)"""

FOCUS_CTE = f"""
sessions AS (
  SELECT event_id AS id, (event_id % 2)::INTEGER AS type,
         strftime(ts, '{_SVC}') AS start_time,
         strftime(make_timestamp((epoch_us(ts) // 1000000 + floor(value)::BIGINT * 60 + (event_id % 5) * 60) * 1000000), '{_SVC}') AS end_time,
         ((event_id % 5) * 60)::BIGINT AS pause_sec,
         'task-' || user_id AS task_id, 'Task ' || user_id AS task_title, event_type AS project_name,
         'k' || json_extract_string(props, '$.k') AS tag
  FROM events
),
sessions_m AS (
  SELECT *, floor((epoch(try_strptime(substr(end_time, 1, 19), '%Y-%m-%dT%H:%M:%S'))::BIGINT
                 - epoch(try_strptime(substr(start_time, 1, 19), '%Y-%m-%dT%H:%M:%S'))::BIGINT - pause_sec) / 60)::BIGINT AS minutes,
         (try_strptime(substr(start_time, 1, 19), '%Y-%m-%dT%H:%M:%S') + INTERVAL 8 HOUR)::DATE AS local_date
  FROM sessions
)"""


def _bounds(day: _dt.date, days: int):
    start = _dt.datetime.combine(day, _dt.time()) - _dt.timedelta(hours=8)
    end = start + _dt.timedelta(days=days) - _dt.timedelta(microseconds=1)
    return (f"TIMESTAMP '{start.isoformat(sep=' ')}'", f"TIMESTAMP '{end.isoformat(sep=' ')}'")


def _svc_ts(e: str) -> str:
    return f"try_strptime(substr({e}, 1, 19), '%Y-%m-%dT%H:%M:%S')"


def _sql(body: str, *ctes: str) -> str:
    return O.with_ctes(*(ctes or (TASKS_CTE,)), body=body)


_TCOLS = ["id", "project_id", "title", "due_date", "priority"]
_TSEL = ", ".join(_TCOLS)


# ---------- filters ----------

@register("flt_due_range", _sql(f"SELECT {_TSEL} FROM tasks WHERE {_svc_ts('due_date')} BETWEEN "
                                 f"{_bounds(TASK_TODAY, 30)[0]} AND {_bounds(TASK_TODAY, 30)[1]}"))
def flt_due_range(spark, sf_dir):
    """Tasks due within 30 local days from the query day."""
    return TK.due_in_range(tasks(spark, sf_dir), *TK.local_day_bounds(TASK_TODAY, 30)).select(*_TCOLS)


@register("flt_due_today", _sql(f"SELECT {_TSEL} FROM tasks WHERE {_svc_ts('due_date')} BETWEEN "
                                 f"{_bounds(TASK_TODAY, 1)[0]} AND {_bounds(TASK_TODAY, 1)[1]} AND status = 0"))
def flt_due_today(spark, sf_dir):
    return TK.due_today(tasks(spark, sf_dir).filter(F.col("status") == 0), TASK_TODAY).select(*_TCOLS)


@register("flt_due_upcoming", _sql(f"SELECT {_TSEL} FROM tasks WHERE {_svc_ts('due_date')} BETWEEN "
                                    f"{_bounds(TASK_TODAY, 7)[0]} AND {_bounds(TASK_TODAY, 7)[1]} AND status = 0"))
def flt_due_upcoming(spark, sf_dir):
    return TK.due_upcoming(tasks(spark, sf_dir).filter(F.col("status") == 0), TASK_TODAY, 7).select(*_TCOLS)


@register("flt_tag", _sql(f"SELECT {_TSEL} FROM tasks WHERE len(list_filter(tags, lambda x: lower(coalesce(x, '')) = 'building')) > 0 AND status = 0"))
def flt_tag(spark, sf_dir):
    return TK.by_tag(tasks(spark, sf_dir).filter(F.col("status") == 0), "Building").select(*_TCOLS)


@register("flt_tag_prefix", _sql(f"SELECT {_TSEL} FROM tasks WHERE len(list_filter(tags, lambda x: lower(coalesce(x, '')) = 'build' OR starts_with(lower(coalesce(x, '')), 'build'))) > 0 AND status = 0"))
def flt_tag_prefix(spark, sf_dir):
    return TK.by_tag(tasks(spark, sf_dir).filter(F.col("status") == 0), "build", prefix=True).select(*_TCOLS)


@register("flt_task_search", _sql(f"SELECT {_TSEL}, status FROM tasks WHERE status = 0 AND (contains(lower(coalesce(title, '')), 'urgent') OR contains(lower(coalesce(content, '')), 'urgent'))"))
def flt_task_search(spark, sf_dir):
    return TK.search(tasks(spark, sf_dir).filter(F.col("status") == 0), "URGENT").select(*_TCOLS, "status")


@register("flt_project_tasks", _sql(f"""
SELECT t.id, t.title, t.priority FROM tasks t
JOIN (SELECT id FROM projects WHERE id = 'Machinery' OR name = 'Machinery' ORDER BY (id = 'Machinery') DESC LIMIT 1) p
  ON t.project_id = p.id WHERE t.status = 0"""))
def flt_project_tasks(spark, sf_dir):
    """Open tasks of the project named (by id or name) ``Machinery``."""
    wanted = spark.createDataFrame([("Machinery",)], "project string")
    pid = TK.resolve_project(projects(spark, sf_dir), wanted).filter(F.col("project_id").isNotNull())
    t = tasks(spark, sf_dir).filter(F.col("status") == 0)
    return t.join(pid.select(F.col("project_id").alias("_pid")), t.project_id == F.col("_pid")).select("id", "title", "priority")


@register("lst_projects", _sql("SELECT id, name, color FROM projects"))
def lst_projects(spark, sf_dir):
    return projects(spark, sf_dir).select("id", "name", "color")


@register("flt_project_columns", _sql("""
SELECT c.id, c.name, p.name AS project_name, p.view_mode FROM projects p
JOIN (SELECT 'C-' || substr(id, 3) || '-' || n AS id, id AS project_id,
             (['Todo', 'Doing', 'Done'])[n + 1] AS name FROM projects, range(3) r(n)) c ON c.project_id = p.id
WHERE p.name = 'Household'"""))
def flt_project_columns(spark, sf_dir):
    p = projects(spark, sf_dir).filter(F.col("name") == "Household")
    c = columns(spark, sf_dir)
    return (c.join(p.select(F.col("id").alias("_pid"), F.col("name").alias("project_name"), "view_mode"),
                   c.project_id == F.col("_pid")).select("id", "name", "project_name", "view_mode"))


@register("flt_task_by_id", _sql(f"SELECT {_TSEL}, content, status FROM tasks WHERE id = 'T4242'"))
def flt_task_by_id(spark, sf_dir):
    return tasks(spark, sf_dir).filter(F.col("id") == "T4242").select(*_TCOLS, "content", "status")


_COMPLETED_WHERE = (f"status = 2 AND ({_svc_ts('completed_time')} + INTERVAL 8 HOUR)::DATE "
                    "BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'")


def _completed(spark, sf_dir):
    t = tasks(spark, sf_dir).filter(F.col("status") == 2)
    d = D.local_date(D.service_ts("completed_time"))
    return t.filter(d.between(F.lit(_dt.date(1996, 1, 1)), F.lit(_dt.date(1996, 3, 31))))


@register("flt_completed_range", _sql(f"""
SELECT id, title, completed_time FROM tasks WHERE {_COMPLETED_WHERE}
ORDER BY completed_time, id"""))
def flt_completed_range(spark, sf_dir):
    """Completed in a local date range, by completion time (ties by id)."""
    return _completed(spark, sf_dir).orderBy("completed_time", "id").select("id", "title", "completed_time")


# ---------- joins ----------

_PNAME_SQL = f"""CASE WHEN t.project_id IS NULL OR t.project_id = '' THEN '{INBOX_LABEL}'
     WHEN p.name IS NOT NULL THEN p.name
     WHEN starts_with(t.project_id, 'inbox') THEN '{INBOX_LABEL}'
     ELSE '未知清单(' || t.project_id || ')' END"""


@register("jn_project_names", _sql(f"""
SELECT t.id, {_PNAME_SQL} AS project_name FROM tasks t LEFT JOIN projects p ON t.project_id = p.id"""))
def jn_project_names(spark, sf_dir):
    return TK.with_project_names(tasks(spark, sf_dir), projects(spark, sf_dir)).select("id", "project_name")


_PNAME_DONE_SQL = f"""CASE WHEN coalesce(nullif(t.project_id, ''), 'inbox') = 'inbox' THEN '{INBOX_LABEL}'
     ELSE coalesce(p.name, '未知') END"""


@register("jn_project_names_completed", _sql(f"""
SELECT t.id, {_PNAME_DONE_SQL} AS project_name FROM tasks t
LEFT JOIN projects p ON coalesce(nullif(t.project_id, ''), 'inbox') = p.id WHERE t.status = 2"""))
def jn_project_names_completed(spark, sf_dir):
    t = tasks(spark, sf_dir).filter(F.col("status") == 2)
    return TK.with_project_names_completed(t, projects(spark, sf_dir)).select("id", "project_name")


_WANTED_SQL = """wanted AS (
  SELECT DISTINCT upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS project FROM customer
  UNION ALL SELECT DISTINCT 'P-' || lower(c_mktsegment) FROM customer
  UNION ALL SELECT DISTINCT 'gone-' || lower(c_mktsegment) FROM customer
)"""


def _wanted(spark, sf_dir):
    seg = F.col("c_mktsegment")
    c = table(spark, sf_dir, "customer").select(seg).distinct()
    return (c.select(F.concat(F.upper(F.substring(seg, 1, 1)), F.lower(F.substring(seg, 2, 1000))).alias("project"))
            .unionByName(c.select(F.concat(F.lit("P-"), F.lower(seg)).alias("project")))
            .unionByName(c.select(F.concat(F.lit("gone-"), F.lower(seg)).alias("project"))))


@register("jn_resolve_project", O.with_ctes(TASKS_CTE, _WANTED_SQL, body="""
SELECT w.project, coalesce(pi.id, pn.id) AS project_id,
       CASE WHEN coalesce(pi.id, pn.id) IS NULL THEN 'project_not_found' END AS reason
FROM wanted w LEFT JOIN projects pi ON w.project = pi.id LEFT JOIN projects pn ON w.project = pn.name"""))
def jn_resolve_project(spark, sf_dir):
    """Project references (names, ids and unknown ids) resolved to ids."""
    return TK.resolve_project(projects(spark, sf_dir), _wanted(spark, sf_dir))


@register("jn_resolve_column", O.with_ctes(TASKS_CTE, """
cols AS (SELECT 'C-' || substr(id, 3) || '-' || n AS id, id AS project_id,
                (['Todo', 'Doing', 'Done'])[n + 1] AS name FROM projects, range(3) r(n))""", body="""
SELECT t.id, c.id AS column_id FROM tasks t
LEFT JOIN cols c ON c.project_id = t.project_id AND c.name = (['Todo', 'Doing', 'Done'])[(t.order_key % 3) + 1]
WHERE t.status = 0"""))
def jn_resolve_column(spark, sf_dir):
    """Column name (Todo/Doing/Done by order key) -> column id within the
    task's project; unknown projects give null."""
    t = tasks(spark, sf_dir).filter(F.col("status") == 0).drop("column_id")
    want = F.element_at(F.array(F.lit("Todo"), F.lit("Doing"), F.lit("Done")), (F.col("order_key") % 3 + 1).cast("int"))
    c = columns(spark, sf_dir).select(F.col("id").alias("column_id"), F.col("project_id").alias("_cp"), F.col("name").alias("_cn"))
    j = t.withColumn("_want", want).join(c, (F.col("project_id") == F.col("_cp")) & (F.col("_want") == F.col("_cn")), "left")
    return j.select("id", "column_id")


@register("jn_task_project", O.with_ctes(TASKS_CTE, body="""
SELECT DISTINCT 'T' || l_orderkey AS task_id, t.project_id FROM lineitem l JOIN tasks t ON t.id = 'T' || l.l_orderkey
WHERE l.l_returnflag = 'R'"""))
def jn_task_project(spark, sf_dir):
    """Which project holds each task named by a returned line item."""
    li = (table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
          .select(F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("task_id")).distinct())
    t = tasks(spark, sf_dir).select(F.col("id").alias("task_id"), "project_id")
    return li.join(t, "task_id")


@register("jn_checklist_match", O.with_ctes(TASKS_CTE, """
lines AS (SELECT l_orderkey, list(struct_pack(pos := l_linenumber, id := 'I' || l_orderkey || '-' || l_linenumber,
                                            title := 'part ' || l_partkey)
                 ORDER BY l_linenumber, 'I' || l_orderkey || '-' || l_linenumber, 'part ' || l_partkey,
                          CASE WHEN l_linestatus = 'F' THEN 2 ELSE 0 END) AS items
          FROM lineitem GROUP BY l_orderkey)""", body="""
SELECT id, m.id AS item_id, m.title AS item_title FROM (
  SELECT t.id, list_filter(l.items, lambda it: it.id = 'part 1' OR contains(lower(coalesce(it.title, '')), 'part 1'))[1] AS m
  FROM tasks t JOIN lines l ON t.order_key = l.l_orderkey) WHERE m.id IS NOT NULL"""))
def jn_checklist_match(spark, sf_dir):
    """First checklist item of each task matching an id or title keyword."""
    t = checklist_tasks(spark, sf_dir)
    m = TK.checklist_match(F.col("items"), "part 1")
    return t.select("id", m["id"].alias("item_id"), m["title"].alias("item_title")).filter(F.col("item_id").isNotNull())


# ---------- grouped listings ----------

@register("agg_tasks_by_project", _sql(f"""
SELECT * FROM (
  SELECT t.id, t.title, t.due_date, t.priority, {_PNAME_SQL} AS project_name,
         (CASE coalesce(t.priority, 0) WHEN 0 THEN ' ' WHEN 1 THEN '↓' WHEN 3 THEN '→' WHEN 5 THEN '↑' ELSE '?' END) AS glyph
  FROM tasks t LEFT JOIN projects p ON t.project_id = p.id WHERE t.status = 0) x
JOIN (SELECT {_PNAME_SQL} AS project_name, count(*) AS group_size
      FROM tasks t LEFT JOIN projects p ON t.project_id = p.id WHERE t.status = 0 GROUP BY 1) g USING (project_name)"""))
def agg_tasks_by_project(spark, sf_dir):
    """Open tasks grouped by project name with group sizes, ordered by due
    (missing first) and priority descending inside each group."""
    t = TK.with_project_names(tasks(spark, sf_dir).filter(F.col("status") == 0), projects(spark, sf_dir))
    t = t.withColumn("glyph", TK.priority_glyph("priority"))
    out = TK.grouped_listing(t, [F.coalesce("due_date", F.lit("")), F.col("priority").desc(), F.col("id")])
    return out.select("id", "title", "due_date", "priority", "project_name", "glyph", "group_size")


@register("agg_completed_by_project", _sql(f"""
SELECT x.*, g.group_size FROM (
  SELECT t.id, t.title, t.completed_time, {_PNAME_DONE_SQL} AS project_name
  FROM tasks t LEFT JOIN projects p ON coalesce(nullif(t.project_id, ''), 'inbox') = p.id WHERE {_COMPLETED_WHERE.replace('status', 't.status', 1)}) x
JOIN (SELECT {_PNAME_DONE_SQL} AS project_name, count(*) AS group_size
      FROM tasks t LEFT JOIN projects p ON coalesce(nullif(t.project_id, ''), 'inbox') = p.id
      WHERE {_COMPLETED_WHERE.replace('status', 't.status', 1)} GROUP BY 1) g USING (project_name)"""))
def agg_completed_by_project(spark, sf_dir):
    """Tasks completed in the range grouped by project, ordered by completion."""
    t = TK.with_project_names_completed(_completed(spark, sf_dir), projects(spark, sf_dir))
    out = TK.grouped_listing(t, [F.coalesce("completed_time", F.lit("")), F.col("id")])
    return out.select("id", "title", "completed_time", "project_name", "group_size")


@register("agg_tags", _sql("""
SELECT name, CASE WHEN regexp_extract(name, '^(.*)/[^/]+$', 1) <> '' THEN regexp_extract(name, '^(.*)/[^/]+$', 1) END AS parent,
       '#' || substr(md5(name), 1, 6) AS color
FROM (SELECT DISTINCT unnest(tags) AS name FROM tasks) WHERE name IS NOT NULL"""))
def agg_tags(spark, sf_dir):
    return TK.tag_listing(tasks(spark, sf_dir))


# ---------- scalar functions over tasks ----------

@register("fn_priority_glyph", _sql("""
SELECT id, priority, CASE coalesce(priority, 0) WHEN 0 THEN ' ' WHEN 1 THEN '↓' WHEN 3 THEN '→' WHEN 5 THEN '↑' ELSE '?' END AS glyph FROM tasks"""))
def fn_priority_glyph(spark, sf_dir):
    return tasks(spark, sf_dir).select("id", "priority", TK.priority_glyph("priority").alias("glyph"))


@register("fn_local_date", _sql(f"""
SELECT id, coalesce(strftime({_svc_ts('due_date')} + INTERVAL 8 HOUR, '%Y-%m-%d'), '') AS local_date,
       coalesce(strftime({_svc_ts('due_date')} + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S'), substr(coalesce(due_date, ''), 1, 19)) AS local_time
FROM tasks"""))
def fn_local_date(spark, sf_dir):
    """fn_local_date / fn_local_time over due strings."""
    return tasks(spark, sf_dir).select("id", D.fn_local_date("due_date").alias("local_date"),
                                       D.fn_local_time("due_date").alias("local_time"))


@register("fn_parse_due", _sql("""
SELECT id, CASE WHEN length(d) = 10 THEN d || 'T09:00:00.000+0000' WHEN length(d) = 16 THEN d || ':00.000+0000' ELSE d END AS due
FROM (SELECT id, CASE WHEN order_key % 3 = 0 THEN substr(due_date, 1, 10) WHEN order_key % 3 = 1 THEN substr(due_date, 1, 16)
                      ELSE due_date END AS d FROM tasks)"""))
def fn_parse_due(spark, sf_dir):
    """Due arguments of three shapes (date, minute, full) normalised."""
    t = tasks(spark, sf_dir)
    k = F.col("order_key") % 3
    d = F.when(k == 0, F.substring("due_date", 1, 10)).when(k == 1, F.substring("due_date", 1, 16)).otherwise(F.col("due_date"))
    return t.select("id", D.parse_due(d).alias("due"))


@register("fn_split_list", _sql("""
SELECT id, array_to_string(list_filter(list_transform(string_split(content, ' '), lambda x: trim(x)), lambda x: x <> ''), ',') AS parts
FROM tasks"""))
def fn_split_list(spark, sf_dir):
    """Task content split on spaces into a trimmed non-empty list."""
    return tasks(spark, sf_dir).select("id", F.array_join(X.split_list("content", " "), ",").alias("parts"))


@register("fn_tag_parent", _sql("""
SELECT name, CASE WHEN regexp_extract(name, '^(.*)/[^/]+$', 1) <> '' THEN regexp_extract(name, '^(.*)/[^/]+$', 1) END AS parent
FROM (SELECT unnest(tags) AS name FROM tasks)"""))
def fn_tag_parent(spark, sf_dir):
    return tasks(spark, sf_dir).select(F.explode("tags").alias("name")).select("name", X.tag_parent("name").alias("parent"))


# ---------- focus ----------

_F0, _F1 = _dt.date(2024, 1, 1), _dt.date(2024, 1, 31)


def _fsql(body: str) -> str:
    return O.with_ctes(FOCUS_CTE, body=body)


@register("flt_focus_day", _fsql(f"""
SELECT id, CASE WHEN type = 0 THEN '番茄' ELSE '正向计时' END AS session_type, start_time, minutes
FROM sessions_m WHERE local_date = DATE '{FOCUS_DAY}'"""))
def flt_focus_day(spark, sf_dir):
    s = FO.sessions_on_day(focus_sessions(spark, sf_dir), FOCUS_DAY)
    return s.select("id", FO.session_type("type").alias("session_type"), "start_time", "minutes")


@register("agg_focus_today", _fsql(f"""
SELECT coalesce(sum(minutes), 0)::BIGINT AS total_minutes, count(*) AS session_count,
       floor(coalesce(sum(minutes), 0) / 25)::BIGINT AS pomodoros, '{FOCUS_DAY.strftime('%Y%m%d')}' AS date
FROM sessions_m WHERE local_date = DATE '{FOCUS_DAY}'"""))
def agg_focus_today(spark, sf_dir):
    return FO.day_summary(focus_sessions(spark, sf_dir), FOCUS_DAY)


@register("agg_focus_heatmap", _fsql(f"""
SELECT strftime(local_date, '%Y%m%d') AS day, sum(minutes)::BIGINT AS duration, count(*) AS sessions
FROM sessions_m WHERE local_date BETWEEN DATE '{_F0}' AND DATE '{_F1}' GROUP BY 1"""))
def agg_focus_heatmap(spark, sf_dir):
    return FO.heatmap(focus_sessions(spark, sf_dir), _F0, _F1)


@register("agg_focus_by_project", _fsql(f"""
SELECT project_name AS project, sum(minutes)::BIGINT AS minutes FROM sessions_m
WHERE local_date BETWEEN DATE '{_F0}' AND DATE '{_F1}' GROUP BY 1"""))
def agg_focus_by_project(spark, sf_dir):
    return FO.by_project(focus_sessions(spark, sf_dir), _F0, _F1)


@register("agg_focus_by_tag", _fsql(f"""
SELECT tag, sum(minutes)::BIGINT AS minutes FROM sessions_m
WHERE local_date BETWEEN DATE '{_F0}' AND DATE '{_F1}' GROUP BY 1"""))
def agg_focus_by_tag(spark, sf_dir):
    return FO.by_tag(focus_sessions(spark, sf_dir), _F0, _F1)


@register("agg_focus_by_task", _fsql(f"""
SELECT task_title AS task, sum(minutes)::BIGINT AS minutes, floor(sum(minutes) / 25)::BIGINT AS pomodoros
FROM sessions_m WHERE local_date BETWEEN DATE '{_F0}' AND DATE '{_F1}' AND contains(lower(task_title), 'task 1')
GROUP BY 1"""))
def agg_focus_by_task(spark, sf_dir):
    return FO.by_task(focus_sessions(spark, sf_dir), _F0, _F1, keyword="Task 1")


@register("agg_focus_all_time", _fsql("SELECT count(*) AS count, sum(minutes)::BIGINT AS duration FROM sessions_m"))
def agg_focus_all_time(spark, sf_dir):
    return FO.all_time(focus_sessions(spark, sf_dir))


@register("top_focus_tasks", _fsql(f"""
SELECT task_title AS task, sum(minutes)::BIGINT AS minutes, floor(sum(minutes) / 25)::BIGINT AS pomodoros
FROM sessions_m WHERE local_date BETWEEN DATE '{_F0}' AND DATE '{_F1}'
GROUP BY 1 ORDER BY minutes DESC, task LIMIT 10"""))
def top_focus_tasks(spark, sf_dir):
    return FO.top_tasks(focus_sessions(spark, sf_dir), _F0, _F1)


@register("agg_focus_seconds", _fsql("""
SELECT task_title AS task, sum(minutes * 60)::BIGINT AS focus_seconds FROM sessions_m GROUP BY 1"""))
def agg_focus_seconds(spark, sf_dir):
    """Actual focus seconds per task from the per-session focus entries."""
    return FO.focus_seconds(FO.focus_chunks(focus_sessions(spark, sf_dir)))


@register("fn_session_minutes", _fsql("""
SELECT id, minutes, floor(minutes / 25)::BIGINT AS pomodoros,
       CASE WHEN type = 0 THEN '番茄' ELSE '正向计时' END AS session_type FROM sessions_m"""))
def fn_session_minutes(spark, sf_dir):
    """fn_session_minutes, fn_pomodoros and fn_session_type per session."""
    s = FO.with_minutes(focus_sessions(spark, sf_dir))
    return s.select("id", "minutes", FO.pomodoros("minutes").alias("pomodoros"),
                    FO.session_type("type").alias("session_type"))


@register("win_request_rate", O.with_ctes("""
req AS (SELECT event_id, user_id AS token, ts FROM events)""", body="""
SELECT event_id, token, count(*) OVER (PARTITION BY token ORDER BY ts
         RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS requests_60s,
       count(*) OVER (PARTITION BY token ORDER BY ts
         RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) > 100 AS over_limit
FROM req"""))
def win_request_rate(spark, sf_dir):
    """Rolling 60 s request count per token (user) against the 100/min limit."""
    r = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("token"), "ts")
    return FO.request_rate(r).select("event_id", "token", "requests_60s", "over_limit")
