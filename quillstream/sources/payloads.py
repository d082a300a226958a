"""Landed JSON payloads and the normalised-item sink.

``read_json_cache`` reads one day's payload per source with an explicit
schema; a missing path gives an empty DataFrame of that schema and a corrupt
file no rows, as a missing or unreadable cache file counts as "no payload".
``read_payloads`` reads envelopes (pages, snapshots, projects) and keeps what
doesn't parse in a column of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

HOT_PAYLOAD_SCHEMA = ("id string, title string, title_en string, url string, source string, publishedAt string, "
                      "summary string, category string, score int, selected boolean")
TASK_SCHEMA = ("id string, projectId string, columnId string, title string, content string, priority int, "
               "dueDate string, startDate string, isAllDay boolean, repeatFlag string, tags array<string>, "
               "items array<struct<id:string,title:string,status:int,completedTime:string>>, kind string, "
               "status int, completedTime string")


def read_json_cache(spark: SparkSession, path: str, schema: str, multiline: bool = True) -> DataFrame:
    """src_json_cache: payload files under ``path`` (``dt=`` partitions are
    discovered); missing path -> empty DataFrame of ``schema``, corrupt file
    -> no rows."""
    try:
        return (spark.read.schema(schema).option("multiLine", multiline).option("mode", "DROPMALFORMED").json(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


PAGE_SCHEMA = f"items array<struct<{HOT_PAYLOAD_SCHEMA.replace(' ', ':').replace(',:', ',')}>>, hasNext boolean, nextCursor string, request struct<mode:string>"
_TASK_STRUCT = ("struct<id:string,projectId:string,columnId:string,title:string,content:string,priority:int,dueDate:string,"
                "tags:array<string>,status:int,completedTime:string>")
SNAPSHOT_SCHEMA = f"syncTaskBean struct<update:array<{_TASK_STRUCT}>>, tags array<struct<name:string,parent:string>>"
PROJECT_SCHEMA = ("project struct<id:string,name:string,viewMode:string>, tasks array<struct<id:string>>, "
                  "columns array<struct<id:string,name:string>>")


def read_payloads(spark: SparkSession, path: str, schema: str, multiline: bool = True) -> DataFrame:
    """Payload envelopes under ``path``: fields, the folders' partition columns,
    ``file`` and ``corrupt``: the text of a payload that doesn't parse (its fields don't
    count). A missing path gives no rows."""
    full = f"{schema}, corrupt string"
    try:
        df = (spark.read.schema(full).option("multiLine", multiline).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", "corrupt").json(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{full}, file string")
    return df.withColumn("file", F.col("_metadata.file_path"))


def page_items(pages: DataFrame) -> DataFrame:
    """src_api_pages: the items of every readable page with page and position;
    their order is the order of arrival."""
    rows = pages.select("page", "corrupt", F.posexplode("items").alias("pos", "item"))
    return rows.filter("corrupt is null").select("page", "pos", "item.*")


def page_stats(pages: DataFrame) -> DataFrame:
    """Readable and unreadable pages, the last readable page's request mode and
    cursor, and whether more items were to come (one row)."""
    good = F.col("corrupt").isNull()
    last = F.max_by(F.struct("hasNext", "nextCursor", "request"), F.when(good, F.col("page")))
    return pages.agg(F.count_if(good).alias("page_count"), F.count_if(~good).alias("bad_pages"), last.alias("_l")).select(
        "page_count", "bad_pages", F.col("_l.request.mode").alias("mode"), F.col("_l.nextCursor").alias("last_next_cursor"),
        (F.col("_l.hasNext") & F.col("_l.nextCursor").isNotNull()).alias("truncated"))


def snapshot_tasks(snapshots: DataFrame) -> DataFrame:
    """src_task_snapshot: the tasks of readable snapshot envelopes."""
    return snapshots.select("corrupt", F.explode("syncTaskBean.update").alias("t")).filter("corrupt is null").select("t.*")


def snapshot_tags(snapshots: DataFrame) -> DataFrame:
    """The tags table of readable snapshot envelopes (name, parent)."""
    return snapshots.select("corrupt", F.explode("tags").alias("t")).filter("corrupt is null").select("t.*").distinct()


def project_sizes(envelopes: DataFrame) -> DataFrame:
    """src_project_data: (id, name, open_tasks, n_columns) of the projects of
    readable envelopes; a project's tasks and columns may come in several."""
    good = envelopes.filter("corrupt is null and project.id is not null")
    tasks = good.groupBy("project.id").agg(F.first("project.name").alias("name"), F.sum(F.size(F.coalesce("tasks", F.array()))).alias("open_tasks"))
    columns = good.select("project.id", F.explode_outer("columns.id").alias("c")).groupBy("id").agg(F.count_distinct("c").alias("n_columns"))
    return tasks.join(columns, "id").select("id", "name", "open_tasks", "n_columns")


def write_normalized(df: DataFrame, path: str) -> None:
    """snk_normalized: one write partitioned by day and source, ``outcome`` (kept /
    dropped) as a column, with dynamic partition overwrite: a re-run of a day and
    source replaces all its rows and touches no other partition."""
    out = df.withColumn("outcome", F.when(F.col("reason").isNull(), "kept").otherwise("dropped"))
    (out.repartition("dt", "source", F.pmod(F.xxhash64("idx"), F.lit(16))).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("dt", "source").parquet(path))


def read_normalized(spark: SparkSession, path: str) -> DataFrame:
    """The sink's rows; no rows before its first write."""
    return spark.read.schema("kind string, idx long, reason string, outcome string, dt date, source string").parquet(path)


def resume_normalized(items: DataFrame, states: DataFrame, path: str) -> DataFrame:
    """inc_resume: write only the (day, source) partitions whose raw file lacks
    its normalised one, and return those pairs."""
    todo = states.filter((F.col("status") == "raw_only") & F.col("is_heavy")).select("dt", "source").distinct()
    write_normalized(items.join(todo, ["dt", "source"], "left_semi"), path)
    return todo


NOTE_SCHEMA = "line string, ord struct<undated: boolean, at: timestamp, idx: long>, dt date, source string"


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the notes; no rows before the first write."""
    try:
        return spark.read.schema(NOTE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], NOTE_SCHEMA)


def append_notes(lines: DataFrame, path: str) -> None:
    """snk_raw_note: append lines (dt, source, line, ord) to the notes, one folder for
    each day and source. ``ord`` (undated, at, idx) is their order in a note. A line
    stands once in a note, at its first place; lines that a note holds stay."""
    first = lines.groupBy("dt", "source", "line").agg(F.min("ord").cast("struct<undated: boolean, at: timestamp, idx: long>").alias("ord"))
    new = first.join(read_notes(lines.sparkSession, path).select("dt", "source", "line"), ["dt", "source", "line"], "left_anti")
    (new.repartitionByRange("dt", "source", "ord").sortWithinPartitions("dt", "source", "ord").select("dt", "source", "line", "ord")
     .write.mode("append").partitionBy("dt", "source").parquet(path))
