"""Task and project mutations as batch merges.

The task service takes one change at a time; here a batch of change rows is
applied to a snapshot: changes are reduced per key (latest ``seq`` wins, a
partial+final ``max_by`` aggregate, so a hot key costs one row per map task),
then joined to the snapshot on the key and the new snapshot is one
projection. Checklist edits act on the bounded item array of one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X

VALID_PRIORITIES = (0, 1, 3, 5)
VIEW_MODES = ("list", "kanban", "timeline")


def latest_per_key(changes: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """One change per key: the one with the greatest ``seq``."""
    cols = [c for c in changes.columns if c != key]
    return (changes.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(seq)).alias("_c"))
            .select(key, "_c.*"))


def create_tasks(requests: DataFrame) -> DataFrame:
    """mut_create_task: new task rows. Priority must be 0/1/3/5 (others are
    rejected with a reason); items make the task a CHECKLIST; no project ->
    inbox (null project id)."""
    items = X.split_list("items", r"\|")
    ok = F.col("priority").isNull() | F.col("priority").isin(*VALID_PRIORITIES)
    return requests.select(
        "id", F.nullif(F.col("project"), F.lit("")).alias("project_id"), "title",
        F.nullif(F.col("content"), F.lit("")).alias("content"), F.coalesce("priority", F.lit(0)).alias("priority"),
        F.when(X.nonempty("due"), D.parse_due("due")).alias("due_date"),
        X.split_list("tags").alias("tags"),
        F.when(F.size(items) > 0, F.transform(items, lambda t: F.struct(t.alias("title"), F.lit(0).alias("status")))).alias("items"),
        F.when(F.size(items) > 0, F.lit("CHECKLIST")).alias("kind"),
        F.lit(0).alias("status"),
        F.when(~ok, F.lit("invalid_priority")).alias("reason"))


def apply_task_changes(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """mut_update_task / mut_complete_task / mut_delete_task in one merge.

    ``changes``: (id, seq, op in update/complete/delete, title, content,
    priority, due, tags, project, confirm). Update changes only supplied
    fields: empty strings keep the old value, priority and tags apply when
    not null (priority 0 is a value; an empty tag string clears the tags).
    A delete removes the task only when confirmed; otherwise it is a preview
    and the task stays (``preview_delete``)."""
    red = latest_per_key(changes, "id")
    c = red.select(*[F.col(x).alias("c_" + x) if x != "id" else F.col(x) for x in red.columns])
    j = snapshot.join(c, "id", "left")
    op = F.col("c_op")
    upd = op == "update"

    def keep(col, new):
        return F.when(upd & X.nonempty(new), F.col(new)).otherwise(F.col(col))
    tags = F.when(upd & F.col("c_tags").isNotNull(), X.split_list("c_tags")).otherwise(F.col("tags"))
    out = j.select(
        "id",
        keep("project_id", "c_project").alias("project_id"),
        keep("title", "c_title").alias("title"),
        keep("content", "c_content").alias("content"),
        F.when(upd & F.col("c_priority").isNotNull(), F.col("c_priority")).otherwise(F.col("priority")).alias("priority"),
        F.when(upd & X.nonempty("c_due"), D.parse_due("c_due")).otherwise(F.col("due_date")).alias("due_date"),
        tags.alias("tags"),
        F.when(op == "complete", F.lit(2)).otherwise(F.col("status")).alias("status"),
        F.coalesce((op == "delete") & ~F.coalesce("c_confirm", F.lit(False)), F.lit(False)).alias("preview_delete"),
        ((op == "delete") & F.coalesce("c_confirm", F.lit(False))).alias("_deleted"))
    return out.filter(~F.coalesce(F.col("_deleted"), F.lit(False))).drop("_deleted")


def add_subtasks(tasks: DataFrame, adds: DataFrame) -> DataFrame:
    """mut_add_subtask: append items (status 0) in ``seq`` order; the task
    becomes a CHECKLIST. The appended list per task is bounded by its adds."""
    new = adds.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "title"))),
                                             lambda x: x["title"]).alias("_new"))
    j = tasks.join(new, "id", "left")
    item_t = "array<struct<id:string,title:string,status:int,completed_time:string>>"
    item = lambda t: F.struct(F.lit(None).cast("string").alias("id"), t.alias("title"),
                              F.lit(0).alias("status"), F.lit(None).cast("string").alias("completed_time"))
    norm = F.transform("items", lambda x: F.struct(
        x["id"].alias("id"), x["title"].alias("title"), x["status"].cast("int").alias("status"),
        x["completed_time"].alias("completed_time")))
    appended = F.concat(F.coalesce(norm, F.array().cast(item_t)), F.transform("_new", item))
    return j.select("id", F.when(F.col("_new").isNotNull(), appended).otherwise(norm).alias("items"),
                    F.when(F.col("_new").isNotNull(), F.lit("CHECKLIST")).alias("kind"))


def complete_subtask(tasks: DataFrame, requests: DataFrame, completed_at: str) -> DataFrame:
    """mut_complete_subtask: the first item whose id equals the key or whose
    title contains it (case-insensitive) gets status 2 and a completion time;
    no match -> an error row (``reason``)."""
    j = requests.join(tasks.select("id", "items"), "id", "left")
    key = F.col("subtask")
    hit = F.transform("items", lambda x: (x["id"] == key) | F.lower(F.coalesce(x["title"], F.lit(""))).contains(F.lower(key)))
    pos = F.array_position(hit, True)
    j = j.withColumn("_pos", F.coalesce(pos, F.lit(0)))
    new_items = F.transform("items", lambda x, i: F.when(i + 1 == F.col("_pos"), F.struct(
        x["id"].alias("id"), x["title"].alias("title"), F.lit(2).alias("status"),
        F.lit(completed_at).alias("completed_time"))).otherwise(F.struct(
        x["id"].alias("id"), x["title"].alias("title"), x["status"].alias("status"),
        x["completed_time"].alias("completed_time"))))
    return j.select("id", "subtask", F.when(F.col("_pos") > 0, new_items).alias("items"),
                    F.when(F.col("_pos") > 0, F.col("items")[F.col("_pos") - 1]["title"]).alias("completed_title"),
                    F.when(F.col("_pos") == 0, F.lit("subtask_not_found")).alias("reason"))


def apply_project_changes(projects: DataFrame, changes: DataFrame) -> DataFrame:
    """mut_create_project / mut_update_project / mut_delete_project: creates
    add rows (view mode list/kanban/timeline, others rejected), updates change
    supplied fields only, deletes remove the project only when confirmed."""
    c = latest_per_key(changes, "id")
    creates = c.filter(F.col("op") == "create").select(
        "id", "name", "color", F.when(F.col("view_mode").isin(*VIEW_MODES), F.col("view_mode")).alias("view_mode"))
    other = c.filter(F.col("op") != "create").select(
        "id", F.col("op").alias("c_op"), F.col("name").alias("c_name"), F.col("color").alias("c_color"),
        F.col("confirm").alias("c_confirm"))
    j = projects.join(other, "id", "left")
    upd = F.col("c_op") == "update"
    gone = (F.col("c_op") == "delete") & F.coalesce(F.col("c_confirm"), F.lit(False))
    kept = j.filter(~F.coalesce(gone, F.lit(False))).select(
        "id", F.when(upd & X.nonempty("c_name"), F.col("c_name")).otherwise(F.col("name")).alias("name"),
        F.when(upd & X.nonempty("c_color"), F.col("c_color")).otherwise(F.col("color")).alias("color"), "view_mode")
    new = creates.join(projects.select("id"), "id", "left_anti")
    return kept.unionByName(new)
