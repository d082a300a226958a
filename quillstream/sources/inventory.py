"""Cache-folder inventory from the file system.

Two layouts are known: day folders ``YYYY-MM-DD/<file>``, and
``day=YYYY-MM-DD/name=<file>/`` as Spark writes them. ``binaryFile`` lists files with
path, length and modification time; ``content`` is not selected in a listing, so Spark
does not read the files. But its driver holds a status of every file, and Spark's
writer makes a file's folder, checksum and permissions one by one, the last by a
process of its own. So ``day=/name=`` folders below a mounted root (``file:``, on a
cluster shared storage) are written and listed by tasks with plain file calls, and the
driver holds the days only; other file systems go through Spark.
"""

from __future__ import annotations

import os
import re
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K


NO_VALUE = "__HIVE_DEFAULT_PARTITION__"       # a null in a folder's name, as Spark writes it
LISTED_ROWS = 10_000                          # names in a batch of a day's listing


def _mounted(spark: SparkSession, root: str) -> str | None:
    """The path of a root that tasks reach by plain file calls, else None."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _folder(column: str, value: str | None) -> str:
    """The folder of a value, named as Spark does."""
    return f"{column}=" + (re.sub(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value) if value else NO_VALUE)


def _value(folder: str) -> str | None:
    value = folder.split("=", 1)[1]
    return None if value == NO_VALUE else re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), value)


def write_cache(files: DataFrame, root: str) -> None:
    """Write (day, name, text), a row for each file, as ``day=/name=`` folders. A file is
    put in place whole under a name that its task's attempts share."""
    spark = files.sparkSession
    path = _mounted(spark, root)
    if path is None:
        files.write.partitionBy("day", "name").text(root)
        return
    os.makedirs(path, exist_ok=True)

    def put(batches):
        task = TaskContext.get()
        part, attempt = f"part-{task.partitionId():05d}.txt", f".{task.taskAttemptId()}"
        for b in batches:
            for day, name, text in zip(*(b.column(c).to_pylist() for c in ("day", "name", "text"))):
                folder = f"{path}/{_folder('day', day)}/{_folder('name', name)}"
                os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/{attempt}", "wb") as f:
                    f.write((text or "").encode() + b"\n")
                os.replace(f"{folder}/{attempt}", f"{folder}/{part}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["files"])

    rows = files.select(F.col("day").cast("string").alias("day"), "name", "text")
    rows.mapInArrow(put, "files long").write.format("noop").mode("overwrite").save()


def _listed_by_tasks(spark: SparkSession, path: str) -> DataFrame:
    """list_cache of ``day=/name=`` folders: a task for each day lists its names,
    then tasks for all names their files."""
    days = sorted(x for x in os.listdir(path) if x.startswith("day="))
    tasks = 4 * spark.sparkContext.defaultParallelism
    texts_of = K.MANIFEST_FILES

    def names(batches):
        for day in (x for b in batches for x in b.column("day").to_pylist()):
            found = []
            with os.scandir(f"{path}/{day}") as entries:
                for e in entries:
                    if e.name.startswith("name="):
                        found.append(e.name)
                    if len(found) == LISTED_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array([day] * len(found)), pa.array(found)], names=["day", "name"])
                        found = []
            yield pa.RecordBatch.from_arrays([pa.array([day] * len(found), pa.string()), pa.array(found, pa.string())], names=["day", "name"])

    def files(batches):
        for b in batches:
            rows = []
            for day, name in zip(b.column("day").to_pylist(), b.column("name").to_pylist()):
                folder, value = f"{path}/{day}/{name}", _value(name)
                for file in os.listdir(folder):
                    if file[0] not in "._":
                        at = os.stat(f"{folder}/{file}")
                        text = None
                        if value in texts_of:
                            with open(f"{folder}/{file}", "rb") as f:
                                text = f.read()
                        rows.append((_value(day), value, at.st_size, at.st_mtime_ns // 1_000_000, text))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], x) for i, x in enumerate(kinds)],
                                             names=["day", "name", "size_bytes", "ms", "content"])

    root = spark.createDataFrame([(d,) for d in days], "day string").repartition(max(1, min(len(days), tasks)), "day")
    folders = root.mapInArrow(names, "day string, name string").repartition(tasks, "day", "name")
    listed = folders.mapInArrow(files, "day string, name string, size_bytes long, ms long, content binary")
    dt = F.try_to_date(F.col("day"), "yyyy-MM-dd")
    return listed.select(dt.alias("dt"), "name", "size_bytes", F.timestamp_millis("ms").alias("modified_at"),
                         F.when(dt.isNotNull(), F.col("content").cast("string")).alias("content"))


@contextmanager
def _days_listed_by_tasks(spark: SparkSession):
    """Below a root, Spark lists a few day folders one after another, with a job of
    a task for each file's folder; so it is one job, with a task for each day."""
    conf = {"spark.sql.sources.parallelPartitionDiscovery.threshold": "1",
            "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(8 * spark.sparkContext.defaultParallelism)}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _files(spark: SparkSession, root: str, partitioned: bool, names=None) -> DataFrame:
    """binaryFile rows with ``dt`` and ``name``; in day folders, only files of
    ``names`` if given."""
    reader = spark.read.format("binaryFile")
    if names is not None:
        reader = reader.option("pathGlobFilter", "{" + ",".join(names) + "}")
    with _days_listed_by_tasks(spark):
        files = (reader if partitioned else reader.option("recursiveFileLookup", "true")).load(root)
    if partitioned:
        if "name" not in files.columns:                 # an empty root
            files = files.withColumn("day", F.lit(None).cast("date")).withColumn("name", F.lit(None).cast("string"))
        return files.withColumn("dt", F.try_to_date(F.col("day").cast("string"), "yyyy-MM-dd"))
    parts = F.split(F.col("path"), "/")
    return files.withColumn("dt", F.try_to_date(F.element_at(parts, -2), "yyyy-MM-dd")).withColumn("name", F.element_at(parts, -1))


def list_cache(spark: SparkSession, root: str, partitioned: bool = False) -> DataFrame:
    """src_cache_inventory: (dt, name, size_bytes, modified_at) of every file, with
    the text of manifests only; no other file is read. Spark plans a split for a few
    dozen files; ``coalesce`` lets a task go through many of them."""
    mounted = _mounted(spark, root) if partitioned else None
    if mounted is not None:
        return _listed_by_tasks(spark, mounted)
    files = _files(spark, root, partitioned)
    listed = files.select("dt", "name", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    listed = listed.coalesce(4 * spark.sparkContext.defaultParallelism)
    # conditions on a partition column prune folders of the one listing; a name in a path has to be listed by itself
    manifests = files.filter(F.col("name").isin(*K.MANIFEST_FILES)) if partitioned else _files(spark, root, False, K.MANIFEST_FILES)
    texts = manifests.select("dt", "name", F.col("content").cast("string").alias("content"))
    return listed.join(texts, ["dt", "name"], "left")


def note_state(notes: DataFrame, days: DataFrame, raw: str = "raw.md", summary: str = "summary.md") -> DataFrame:
    """src_note_state: for each day of ``days`` whether a listing holds the raw
    and the summary note, with size and time."""
    def has(name: str) -> Column:
        return F.coalesce(F.bool_or(F.col("name") == name), F.lit(False))

    def value(column: str, name: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col(column)))

    found = notes.filter(F.col("name").isin(raw, summary)).select("dt", "name", "size_bytes", "modified_at")
    return days.select("dt").distinct().join(found, "dt", "left").groupBy("dt").agg(
        has(raw).alias("raw_note_exists"), has(summary).alias("summary_note_exists"),
        value("size_bytes", raw).alias("raw_note_bytes"), value("size_bytes", summary).alias("summary_note_bytes"),
        value("modified_at", raw).alias("raw_note_at"), value("modified_at", summary).alias("summary_note_at"))
