"""Stand-in landed folders: the adapter rows written as the files that the
readers of ``sources`` expect. Each folder is written once for a session and
table folder, below the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_path
from ..sources import inventory as INV
from . import adapters as A

_written: dict[tuple, str] = {}

WRITERS = 4                 # writing tasks for each core of a folder of many small files
PAGE_ITEMS = 100            # items of an API page
SNAPSHOT_KEYS = 500         # order keys covered by one snapshot envelope
BAD_PAGE, BAD_ENVELOPE = 3, 5        # remainders (of 7 and 11) of the pages and envelopes cut off while landing


def _once(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _written:
        path = work_path(spark, f"landed-{name}")
        write(path)
        _written[key] = path
    return _written[key]


def _cut(text: Column, when: Column) -> Column:
    """A payload whose download broke off."""
    return F.when(when, F.expr("substring(_text, 1, length(_text) div 2)")).otherwise(text)


def hot_pages(spark: SparkSession, sf_dir: str) -> str:
    """Cursor pages of hot items, one multi-line JSON file for each page of a day."""
    def write(path):
        h = A.hot_items_raw(spark, sf_dir)
        item = F.struct("id", "title", "title_en", "url", F.col("source_name").alias("source"), F.col("published_at").alias("publishedAt"),
                        "summary", "category", "score", "selected")
        pages = (h.groupBy("dt", F.expr(f"idx div {PAGE_ITEMS}").alias("page"))
                 .agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", item.alias("item")))), lambda x: x["item"]).alias("items")))
        later = pages.select("dt", (F.col("page") - 1).alias("page"), F.lit(True).alias("hasNext"))
        p = pages.join(later, ["dt", "page"], "left").withColumn("hasNext", F.coalesce("hasNext", F.lit(False)))
        cursor = F.when(F.col("hasNext"), F.concat(F.lit("cursor-"), F.col("page") + 1))
        text = F.to_json(F.struct("items", "hasNext", cursor.alias("nextCursor"), F.struct(F.lit("selected").alias("mode")).alias("request")), {"pretty": "true"})
        (p.withColumn("_text", text).select("dt", "page", _cut(F.col("_text"), F.col("page") % 7 == BAD_PAGE).alias("text"))
         .write.partitionBy("dt", "page").text(path))
    return _once(spark, sf_dir, "hot-pages", write)


def _task(t: DataFrame) -> Column:
    return F.struct("id", F.col("project_id").alias("projectId"), F.col("column_id").alias("columnId"), "title", "content", "priority",
                    F.col("due_date").alias("dueDate"), "tags", "status", F.col("completed_time").alias("completedTime"))


def task_snapshots(spark: SparkSession, sf_dir: str) -> str:
    """Snapshot envelopes, one JSON line for each range of order keys."""
    def write(path):
        t = A.tasks(spark, sf_dir)
        tag = F.transform("tags", lambda x: F.struct(x.alias("name"), F.when(F.instr(x, "/") > 0, F.substring_index(x, "/", 1)).alias("parent")))
        e = t.groupBy(F.expr(f"order_key div {SNAPSHOT_KEYS}").alias("part")).agg(
            F.struct(F.collect_list(_task(t)).alias("update")).alias("syncTaskBean"),
            F.array_distinct(F.flatten(F.collect_list(tag))).alias("tags"))
        text = F.to_json(F.struct("syncTaskBean", "tags"))
        e.withColumn("_text", text).select(_cut(F.col("_text"), F.col("part") % 11 == BAD_ENVELOPE).alias("text")).write.text(path)
    return _once(spark, sf_dir, "snapshots", write)


def project_data(spark: SparkSession, sf_dir: str) -> str:
    """Project envelopes: one JSON line with a project's columns, and one for each
    range of order keys with its open tasks."""
    def write(path):
        p, c, t = A.projects(spark, sf_dir), A.columns(spark, sf_dir), A.tasks(spark, sf_dir)
        project = F.struct("id", "name", F.col("view_mode").alias("viewMode"))
        cols = c.groupBy(F.col("project_id").alias("_p")).agg(F.collect_list(F.struct("id", "name")).alias("columns"))
        head = p.join(cols, p.id == F.col("_p")).select(project.alias("project"), "columns", F.array().cast("array<struct<id:string>>").alias("tasks"))
        some = (t.filter("status = 0").groupBy(F.col("project_id").alias("_p"), F.expr(f"order_key div {10 * SNAPSHOT_KEYS}").alias("part"))
                .agg(F.collect_list(F.struct("id")).alias("tasks")))
        body = p.join(some, p.id == F.col("_p")).select(project.alias("project"), F.array().cast("array<struct<id:string,name:string>>").alias("columns"), "tasks")
        head.unionByName(body).select(F.to_json(F.struct("project", "tasks", "columns")).alias("text")).write.text(path)
    return _once(spark, sf_dir, "projects", write)


def cache_folder(spark: SparkSession, sf_dir: str) -> str:
    """The backlog of cache files as ``day=/name=`` folders; manifests with their text.
    Its rows are small and its files many, so the number of writing tasks is given:
    by their bytes, all files would be made by one task."""
    def write(path):
        f = A.cache_files(spark, sf_dir).repartition(WRITERS * spark.sparkContext.defaultParallelism, "dt", "name")
        INV.write_cache(f.select(F.col("dt").alias("day"), "name", F.coalesce("content", F.concat(F.lit("document "), "doc_id")).alias("text")), path)
    return _once(spark, sf_dir, "cache", write)


def note_folder(spark: SparkSession, sf_dir: str) -> str:
    """The notes of the backlog days as ``day=/name=`` folders."""
    def write(path):
        n = A.note_files(spark, sf_dir)
        name = F.explode(F.array_compact(F.array(F.when(F.col("raw_note_exists"), "raw.md"), F.when(F.col("summary_note_exists"), "summary.md"))))
        INV.write_cache(n.select(F.col("dt").alias("day"), name.alias("name"), F.lit("# note").alias("text")), path)
    return _once(spark, sf_dir, "notes", write)
