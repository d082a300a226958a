"""Registered mutation queries: batches of change rows derived from the
driver tables, merged into the task and project snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mutations as MU
from ..session import table
from . import oracle as O
from .adapters import checklist_tasks, projects, tasks
from .registry import register
from .task_queries import TASKS_CTE

COMPLETED_AT = "2024-01-31T00:00:00.000+0000"


def task_changes(spark, sf_dir):
    """Change rows from ``lineitem``: return flag A -> update, R -> delete,
    N -> complete; seq orders by (ship date, line number, part key)."""
    li = table(spark, sf_dir, "lineitem")
    ln, pk = F.col("l_linenumber"), F.col("l_partkey")
    seq = (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) * 1_000_000_000 + ln * 100_000_000 + pk)
    op = F.when(F.col("l_returnflag") == "A", "update").when(F.col("l_returnflag") == "R", "delete").otherwise("complete")
    pr = F.element_at(F.array(F.lit(0), F.lit(1), F.lit(3), F.lit(5)), (ln % 4 + 1).cast("int"))
    return li.select(
        F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("id"), seq.alias("seq"), op.alias("op"),
        F.when(ln % 2 == 1, F.concat(F.lit("Updated part "), pk.cast("string"))).otherwise(F.lit("")).alias("title"),
        F.lit("").alias("content"),
        F.when(ln % 3 == 0, F.lit(None).cast("int")).otherwise(pr).alias("priority"),
        F.when(ln % 4 == 0, F.date_format(F.col("l_shipdate"), "yyyy-MM-dd")).alias("due"),
        F.when(ln % 5 == 0, F.lit("")).when(ln % 5 == 1, F.concat(F.lit("urgent, q"), ln.cast("string"))).alias("tags"),
        F.when(ln == 2, F.lit("P-building")).otherwise(F.lit("")).alias("project"),
        (ln % 2 == 0).alias("confirm"))


_CHANGES_SQL = """
changes AS (
  SELECT 'T' || l_orderkey AS id,
         epoch(l_shipdate)::BIGINT * 1000000000 + l_linenumber * 100000000 + l_partkey AS seq,
         CASE l_returnflag WHEN 'A' THEN 'update' WHEN 'R' THEN 'delete' ELSE 'complete' END AS op,
         CASE WHEN l_linenumber % 2 = 1 THEN 'Updated part ' || l_partkey ELSE '' END AS title, '' AS content,
         CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE ([0, 1, 3, 5])[(l_linenumber % 4) + 1] END AS priority,
         CASE WHEN l_linenumber % 4 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') END AS due,
         CASE WHEN l_linenumber % 5 = 0 THEN '' WHEN l_linenumber % 5 = 1 THEN 'urgent, q' || l_linenumber END AS tags,
         CASE WHEN l_linenumber = 2 THEN 'P-building' ELSE '' END AS project, l_linenumber % 2 = 0 AS confirm
  FROM lineitem
),
latest AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM changes) WHERE n = 1),
merged AS (
  SELECT t.id,
    CASE WHEN c.op = 'update' AND c.project IS NOT NULL AND c.project <> '' THEN c.project ELSE t.project_id END AS project_id,
    CASE WHEN c.op = 'update' AND c.title IS NOT NULL AND c.title <> '' THEN c.title ELSE t.title END AS title,
    CASE WHEN c.op = 'update' AND c.priority IS NOT NULL THEN c.priority ELSE t.priority END AS priority,
    CASE WHEN c.op = 'update' AND c.due IS NOT NULL AND c.due <> '' THEN
         (CASE WHEN length(c.due) = 10 THEN c.due || 'T09:00:00.000+0000' WHEN length(c.due) = 16 THEN c.due || ':00.000+0000' ELSE c.due END)
         ELSE t.due_date END AS due_date,
    CASE WHEN c.op = 'update' AND c.tags IS NOT NULL
         THEN list_filter(list_transform(string_split(c.tags, ','), lambda x: trim(x)), lambda x: x <> '') ELSE t.tags END AS tags,
    CASE WHEN c.op = 'complete' THEN 2 ELSE t.status END AS status,
    coalesce(c.op = 'delete' AND NOT coalesce(c.confirm, false), false) AS preview_delete,
    coalesce(c.op = 'delete' AND coalesce(c.confirm, false), false) AS deleted, c.op
  FROM tasks t LEFT JOIN latest c USING (id)
)"""


def _merged(spark, sf_dir):
    return MU.apply_task_changes(tasks(spark, sf_dir).drop("order_key", "column_id", "completed_time"),
                                 task_changes(spark, sf_dir))


def _ops(spark, sf_dir):
    return MU.latest_per_key(task_changes(spark, sf_dir), "id").select("id", "op")


_OUT = "id, project_id, title, priority, due_date, array_to_string(tags, ',') AS tags, status, preview_delete"


def _out(df):
    return df.select("id", "project_id", "title", "priority", "due_date", F.array_join("tags", ",").alias("tags"),
                     "status", "preview_delete")


@register("mut_apply_batch", O.with_ctes(TASKS_CTE, _CHANGES_SQL, body=f"SELECT {_OUT} FROM merged WHERE NOT deleted"))
def mut_apply_batch(spark, sf_dir):
    """The new task snapshot after the whole change batch."""
    return _out(_merged(spark, sf_dir))


@register("mut_update_task", O.with_ctes(TASKS_CTE, _CHANGES_SQL, body=f"SELECT {_OUT} FROM merged WHERE op = 'update'"))
def mut_update_task(spark, sf_dir):
    """Tasks whose latest change is an update, after the merge."""
    return _out(_merged(spark, sf_dir).join(_ops(spark, sf_dir).filter(F.col("op") == "update"), "id", "left_semi"))


@register("mut_complete_task", O.with_ctes(TASKS_CTE, _CHANGES_SQL, body="SELECT id, status FROM merged WHERE op = 'complete'"))
def mut_complete_task(spark, sf_dir):
    return _merged(spark, sf_dir).join(_ops(spark, sf_dir).filter(F.col("op") == "complete"), "id", "left_semi").select("id", "status")


@register("mut_delete_task", O.with_ctes(TASKS_CTE, _CHANGES_SQL, body="SELECT id, preview_delete FROM merged WHERE op = 'delete' AND NOT deleted"))
def mut_delete_task(spark, sf_dir):
    """Delete requests: confirmed ones are gone; unconfirmed ones stay as previews."""
    return _merged(spark, sf_dir).join(_ops(spark, sf_dir).filter(F.col("op") == "delete"), "id", "left_semi").select("id", "preview_delete")


def _creates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pr = F.element_at(F.array(*[F.lit(x) for x in (0, 1, 3, 5, 2)]), (k % 5 + 1).cast("int"))
    return p.select(F.concat(F.lit("N"), k.cast("string")).alias("id"),
                    F.when(k % 2 == 0, F.lit("")).otherwise(F.lit("P-building")).alias("project"),
                    F.col("p_name").alias("title"), F.col("p_type").alias("content"), pr.alias("priority"),
                    F.lit(None).cast("string").alias("due"), F.concat(F.lit("new, "), F.col("p_brand")).alias("tags"),
                    F.when(F.col("p_size") % 2 == 0, F.lit("a|b| ")).otherwise(F.lit("")).alias("items"))


@register("mut_create_task", """
SELECT 'N' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 'P-building' END AS project_id, p_name AS title,
       ([0, 1, 3, 5, 2])[(p_partkey % 5) + 1] AS priority, 'new,' || p_brand AS tags,
       CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END AS n_items, CASE WHEN p_size % 2 = 0 THEN 'CHECKLIST' END AS kind,
       CASE WHEN ([0, 1, 3, 5, 2])[(p_partkey % 5) + 1] NOT IN (0, 1, 3, 5) THEN 'invalid_priority' END AS reason
FROM part""")
def mut_create_task(spark, sf_dir):
    """New tasks, one create request per part row."""
    c = MU.create_tasks(_creates(spark, sf_dir))
    return c.select("id", "project_id", "title", "priority", F.array_join("tags", ",").alias("tags"),
                    F.coalesce(F.size("items"), F.lit(0)).alias("n_items"), "kind", "reason") \
        .withColumn("n_items", F.when(F.col("n_items") < 0, 0).otherwise(F.col("n_items")))


def _adds(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("id"),
                     (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("seq"),
                     F.concat(F.lit("check part "), F.col("l_partkey").cast("string")).alias("title"))


@register("mut_add_subtask", O.with_ctes(TASKS_CTE, body="""
SELECT 'T' || a.k AS id, coalesce(n.n, 0) + a.cnt AS n_items, a.last_title, 'CHECKLIST' AS kind FROM (
  SELECT l_orderkey AS k, count(*) AS cnt, arg_max('check part ' || l_partkey, l_linenumber * 1000000 + l_partkey) AS last_title
  FROM lineitem GROUP BY 1) a
LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) n USING (k)
JOIN tasks t ON t.id = 'T' || a.k"""))
def mut_add_subtask(spark, sf_dir):
    """Checklist items appended to tasks (one add request per order line)."""
    out = MU.add_subtasks(checklist_tasks(spark, sf_dir), _adds(spark, sf_dir))
    a = _adds(spark, sf_dir).select("id").distinct()
    return out.join(a, "id", "left_semi").select(
        "id", F.size("items").alias("n_items"), F.element_at("items", -1)["title"].alias("last_title"), "kind")


def _subtask_requests(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    key = (F.when(k % 30 == 0, F.lit("nomatch")).when(k % 20 == 0, F.concat(F.lit("I"), k.cast("string"), F.lit("-1")))
           .otherwise(F.lit("PART 1")))
    return o.select(F.concat(F.lit("T"), k.cast("string")).alias("id"), key.alias("subtask"))


@register("mut_complete_subtask", O.with_ctes(TASKS_CTE, """
items AS (SELECT l_orderkey AS k, 'I' || l_orderkey || '-' || l_linenumber AS iid, 'part ' || l_partkey AS title,
                 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'I' || l_orderkey || '-' || l_linenumber,
                   'part ' || l_partkey, CASE WHEN l_linestatus = 'F' THEN 2 ELSE 0 END) AS pos FROM lineitem),
req AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 30 = 0 THEN 'nomatch' WHEN o_orderkey % 20 = 0 THEN 'I' || o_orderkey || '-1'
                                     ELSE 'PART 1' END AS subtask FROM orders),
hit AS (SELECT r.k, min(i.pos) AS pos FROM req r JOIN items i ON i.k = r.k
        AND (i.iid = r.subtask OR contains(lower(i.title), lower(r.subtask))) GROUP BY r.k)""", body="""
SELECT 'T' || r.k AS id, r.subtask, i.title AS completed_title, CASE WHEN h.pos IS NULL THEN 'subtask_not_found' END AS reason
FROM req r LEFT JOIN hit h USING (k) LEFT JOIN items i ON i.k = r.k AND i.pos = h.pos"""))
def mut_complete_subtask(spark, sf_dir):
    """Complete the first checklist item matching a key; misses are errors."""
    out = MU.complete_subtask(checklist_tasks(spark, sf_dir), _subtask_requests(spark, sf_dir), COMPLETED_AT)
    return out.select("id", "subtask", "completed_title", "reason")


def _project_changes(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    seg = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    s = F.col("c_mktsegment")
    modes = F.element_at(F.array(*[F.lit(m) for m in ("list", "kanban", "timeline", "grid")]), (F.col("r_regionkey") % 4 + 1).cast("int"))
    creates = r.select(F.concat(F.lit("P-"), F.lower("r_name")).alias("id"), F.col("r_regionkey").cast("long").alias("seq"),
                       F.lit("create").alias("op"),
                       F.concat(F.upper(F.substring("r_name", 1, 1)), F.lower(F.substring("r_name", 2, 100))).alias("name"), F.lit("#00aa00").alias("color"),
                       modes.alias("view_mode"), F.lit(False).alias("confirm"))
    other = seg.select(F.concat(F.lit("P-"), F.lower(s)).alias("id"), F.lit(10).cast("long").alias("seq"),
                       F.when(F.length(s) % 2 == 0, "update").otherwise("delete").alias("op"),
                       F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 100)), F.lit(" Team")).alias("name"),
                       F.lit("").alias("color"), F.lit(None).cast("string").alias("view_mode"),
                       ((F.length(s) % 3 == 0) & ~s.startswith("M")).alias("confirm"))
    return creates.unionByName(other)


_PROJ_SQL = """
pchanges AS (
  SELECT 'P-' || lower(r_name) AS id, 'create' AS op, upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)) AS name,
         '#00aa00' AS color, (['list', 'kanban', 'timeline', 'grid'])[(r_regionkey % 4) + 1] AS view_mode, false AS confirm FROM region
  UNION ALL
  SELECT DISTINCT 'P-' || lower(c_mktsegment), CASE WHEN length(c_mktsegment) % 2 = 0 THEN 'update' ELSE 'delete' END,
         upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Team', '', NULL,
         length(c_mktsegment) % 3 = 0 AND NOT starts_with(c_mktsegment, 'M') FROM customer
),
pout AS (
  SELECT p.id, CASE WHEN c.op = 'update' AND c.name <> '' THEN c.name ELSE p.name END AS name,
         CASE WHEN c.op = 'update' AND c.color <> '' THEN c.color ELSE p.color END AS color, p.view_mode
  FROM projects p LEFT JOIN pchanges c ON c.id = p.id AND c.op <> 'create'
  WHERE NOT coalesce(c.op = 'delete' AND c.confirm, false)
  UNION ALL
  SELECT id, name, color, CASE WHEN view_mode IN ('list', 'kanban', 'timeline') THEN view_mode END FROM pchanges
  WHERE op = 'create' AND id NOT IN (SELECT id FROM projects)
)"""


def _projects_after(spark, sf_dir):
    return MU.apply_project_changes(projects(spark, sf_dir), _project_changes(spark, sf_dir))


@register("mut_create_project", O.with_ctes(TASKS_CTE, _PROJ_SQL, body="SELECT * FROM pout WHERE id NOT IN (SELECT id FROM projects)"))
def mut_create_project(spark, sf_dir):
    """Projects created from the region list (invalid view modes become null)."""
    after = _projects_after(spark, sf_dir)
    return after.join(projects(spark, sf_dir).select("id"), "id", "left_anti")


@register("mut_update_project", O.with_ctes(TASKS_CTE, _PROJ_SQL, body="SELECT * FROM pout WHERE id IN (SELECT id FROM projects)"))
def mut_update_project(spark, sf_dir):
    """Existing projects after the updates (supplied fields only)."""
    after = _projects_after(spark, sf_dir)
    return after.join(projects(spark, sf_dir).select("id"), "id", "left_semi")


@register("mut_delete_project", O.with_ctes(TASKS_CTE, _PROJ_SQL, body="SELECT id FROM projects WHERE id NOT IN (SELECT id FROM pout)"))
def mut_delete_project(spark, sf_dir):
    """Projects removed by confirmed deletes (unconfirmed ones remain)."""
    after = _projects_after(spark, sf_dir)
    return projects(spark, sf_dir).select("id").join(after.select("id"), "id", "left_anti")
