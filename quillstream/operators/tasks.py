"""Task operators: due-date, tag, search and project filters, project-name
joins, grouped listings and tag listings.

Grouped listings never gather a group into one task: group sizes come from a
``groupBy`` (partial aggregation), the listing order from a global sort,
which Spark range-partitions so one big project is split across tasks.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..functions.constants import INBOX_LABEL, LOCAL_ZONE, PRIORITY_GLYPHS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def local_day_bounds(day: _dt.date, days: int = 1):
    """[local midnight, local midnight + days - 1 us] as UTC timestamps."""
    start = F.to_utc_timestamp(F.lit(_dt.datetime.combine(day, _dt.time())), LOCAL_ZONE)
    end = F.to_utc_timestamp(F.lit(_dt.datetime.combine(day + _dt.timedelta(days=days), _dt.time())
                                   - _dt.timedelta(microseconds=1)), LOCAL_ZONE)
    return start, end


def due_in_range(tasks: DataFrame, start: Column, end: Column) -> DataFrame:
    """flt_due_range: due time (first 19 chars read as UTC) within [start, end];
    empty or unparseable due dates never match."""
    ts = D.service_ts("due_date")
    return tasks.filter(ts.isNotNull() & ts.between(start, end))


def due_today(tasks: DataFrame, today: _dt.date) -> DataFrame:
    """flt_due_today."""
    return due_in_range(tasks, *local_day_bounds(today, 1))


def due_upcoming(tasks: DataFrame, today: _dt.date, days: int = 7) -> DataFrame:
    """flt_due_upcoming: due within ``days`` days including today."""
    return due_in_range(tasks, *local_day_bounds(today, days))


def by_tag(tasks: DataFrame, tag: str, prefix: bool = False) -> DataFrame:
    """flt_tag: case-insensitive exact tag, or any prefix match (no ``/``
    boundary, quirk Q12)."""
    t = tag.lower()

    def hit(x):
        lx = F.lower(F.coalesce(x, F.lit("")))
        return (lx == t) | (lx.startswith(t) if prefix else F.lit(False))
    return tasks.filter(F.exists(F.coalesce(F.col("tags"), F.array().cast("array<string>")), hit))


def search(tasks: DataFrame, keyword: str) -> DataFrame:
    """flt_task_search: case-insensitive substring in title or content."""
    kw = keyword.lower()
    return tasks.filter(F.lower(F.coalesce("title", F.lit(""))).contains(kw)
                        | F.lower(F.coalesce("content", F.lit(""))).contains(kw))


def resolve_project(projects: DataFrame, wanted: DataFrame, key: str = "project") -> DataFrame:
    """jn_resolve_project: id or name -> project id (first match by id, then
    name); rows without a match get a null ``project_id`` and a reason."""
    by_id = projects.select(F.col("id").alias("_k"), F.col("id").alias("_pid"), F.lit(0).alias("_rank"))
    by_name = projects.select(F.col("name").alias("_k"), F.col("id").alias("_pid"), F.lit(1).alias("_rank"))
    keys = by_id.unionByName(by_name)
    best = keys.groupBy("_k").agg(F.min_by("_pid", F.struct("_rank", "_pid")).alias("project_id"))
    out = wanted.join(best, wanted[key] == best["_k"], "left").drop("_k")
    return out.withColumn("reason", F.when(F.col("project_id").isNull(), F.lit("project_not_found")))


def project_name(pid: Column, name: Column) -> Column:
    """jn_project_names rule: null/'' -> inbox; ``inbox...`` -> inbox; known
    -> name; else ``未知清单(id)``."""
    return (F.when(pid.isNull() | (pid == ""), F.lit(INBOX_LABEL))
            .when(name.isNotNull(), name)
            .when(pid.startswith("inbox"), F.lit(INBOX_LABEL))
            .otherwise(F.concat(F.lit("未知清单("), pid, F.lit(")"))))


def with_project_names(tasks: DataFrame, projects: DataFrame) -> DataFrame:
    """jn_project_names: left join on project id, then the inbox / unknown rule."""
    p = projects.select(F.col("id").alias("_pid"), F.col("name").alias("_pname"))
    j = tasks.join(p, tasks.project_id == p._pid, "left")
    return j.withColumn("project_name", project_name(F.col("project_id"), F.col("_pname"))).drop("_pid", "_pname")


def with_project_names_completed(tasks: DataFrame, projects: DataFrame) -> DataFrame:
    """jn_project_names_completed: null/'' -> inbox; any other miss -> 未知
    (``inbox...`` ids are not special here, quirk Q15)."""
    p = projects.select(F.col("id").alias("_pid"), F.col("name").alias("_pname"))
    key = F.coalesce(F.nullif(F.col("project_id"), F.lit("")), F.lit("inbox"))
    j = tasks.withColumn("_key", key).join(p, F.col("_key") == p._pid, "left")
    name = F.when(F.col("_key") == "inbox", F.lit(INBOX_LABEL)).otherwise(F.coalesce(F.col("_pname"), F.lit("未知")))
    return j.withColumn("project_name", name).drop("_pid", "_pname", "_key")


def priority_glyph(col) -> Column:
    """fn_priority_glyph: 0/1/3/5 -> blank, down, right, up; other -> ?"""
    c = F.coalesce(_c(col), F.lit(0))
    expr = None
    for k, v in PRIORITY_GLYPHS.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr.otherwise(F.lit("?"))


def grouped_listing(named: DataFrame, order: list[Column]) -> DataFrame:
    """agg_tasks_by_project / agg_completed_by_project: every row with its
    group's size, globally sorted by (group, order...). Group sizes come from
    a partial aggregate joined back on the (small) per-group result."""
    sizes = named.groupBy("project_name").agg(F.count(F.lit(1)).alias("group_size"))
    return named.join(sizes, "project_name").orderBy("project_name", *order)


def tag_listing(tasks: DataFrame) -> DataFrame:
    """agg_tags: every tag used by a task, sorted by name, with its parent
    (prefix before the last ``/``) and a colour derived from the name."""
    names = tasks.select(F.explode("tags").alias("name")).filter(F.col("name").isNotNull()).distinct()
    return names.select("name", X.tag_parent("name").alias("parent"),
                        F.concat(F.lit("#"), F.substring(F.md5("name"), 1, 6)).alias("color")).orderBy("name")


def checklist_match(items: Column, key: str) -> Column:
    """jn_checklist_match: first checklist item whose id equals ``key`` or
    whose title contains it (case-insensitive)."""
    kw = key.lower()
    hits = F.filter(items, lambda it: (it["id"] == key) | F.lower(F.coalesce(it["title"], F.lit(""))).contains(kw))
    return F.try_element_at(hits, F.lit(1))
