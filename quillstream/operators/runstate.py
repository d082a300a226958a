"""Run-state operators over a listing of daily cache folders: file classes,
per-(day, source) flags, the manifest join, the status truth table, the
external-group rollup and the partial-run reasons.

Built over every day at once (a completeness audit of a backlog), so each
step is a ``groupBy(dt, ...)``; the file-name lookup and the source list are
fixed configuration (a few rows), generated with ``explode`` or broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K

MANIFEST_SCHEMA = ("status string, sources map<string, struct<status: string, completed: boolean, "
                   "item_count: int, notes: string>>")


def file_lookup(spark: SparkSession) -> DataFrame:
    """File name -> (source, class) for the known cache file names."""
    rows = [(n, s, "raw") for n, s in K.RAW_CACHE_FILES.items()]
    rows += [(n, s, "normalized") for n, s in K.NORMALIZED_CACHE_FILES.items()]
    rows += [(n, None, "manifest") for n in K.MANIFEST_FILES]
    return spark.createDataFrame(rows, "name string, source string, cls string")


def classify(files: DataFrame) -> DataFrame:
    """src_cache_inventory classes: raw / normalized / manifest / unknown."""
    lk = F.broadcast(file_lookup(files.sparkSession))   # fixed 17-row configuration table
    return files.join(lk, "name", "left").withColumn("cls", F.coalesce("cls", F.lit("unknown")))


def source_flags(classified: DataFrame) -> DataFrame:
    """jn_raw_vs_normalized: per (dt, source) raw / normalised file counts and
    flags; files of the external group's members also count for the group."""
    known = classified.filter(F.col("cls").isin("raw", "normalized")).select("dt", "source", "cls")
    members = known.filter(F.col("source").isin(*K.EXTERNAL_GROUP_MEMBERS)).withColumn("source", F.lit("external_skills"))
    return known.unionByName(members).groupBy("dt", "source").agg(
        F.count_if(F.col("cls") == "raw").alias("raw_files"),
        F.count_if(F.col("cls") == "normalized").alias("normalized_files"),
    ).withColumn("has_raw", F.col("raw_files") > 0).withColumn("has_normalized", F.col("normalized_files") > 0)


def manifest_entries(classified: DataFrame) -> DataFrame:
    """jn_manifest: per day the first parseable manifest in name order, its
    ``sources`` map exploded to (dt, source, status, completed)."""
    m = (classified.filter(F.col("cls") == "manifest")
         .withColumn("_m", F.from_json("content", MANIFEST_SCHEMA))
         .filter(F.col("_m.status").isNotNull() | F.col("_m.sources").isNotNull()))
    first = m.groupBy("dt").agg(F.min_by(F.col("_m"), F.col("name")).alias("_m"))
    e = first.select("dt", F.explode("_m.sources").alias("source", "entry"))
    complete = (F.coalesce(F.col("entry.completed"), F.lit(False))
                | F.lower(F.coalesce(F.col("entry.status"), F.lit(""))).isin(*K.MANIFEST_COMPLETE_STATUSES))
    return e.select("dt", "source", F.col("entry.status").alias("manifest_status"),
                    F.col("entry.completed").alias("manifest_completed"), complete.alias("manifest_complete"))


def _status(heavy: Column, raw: Column, norm: Column, man: Column) -> Column:
    heavy_s = (F.when(raw & norm, "complete").when(raw, "raw_only").when(norm, "normalized_only")
               .when(man, "complete").otherwise("missing"))
    light_s = F.when(raw | man, "complete").otherwise("missing")
    return F.when(heavy, heavy_s).otherwise(light_s)


def run_state(files: DataFrame) -> DataFrame:
    """agg_run_state (+ agg_run_group_rollup): status per (dt, source) for
    every known source of every listed day."""
    c = classify(files)
    days = files.select("dt").distinct()
    grid = days.select("dt", F.explode(F.array(*[F.lit(s) for s in K.ALL_RUN_SOURCES])).alias("source"))
    flags = source_flags(c).select("dt", "source", "has_raw", "has_normalized")
    man = manifest_entries(c)
    s = (grid.join(flags, ["dt", "source"], "left").join(man, ["dt", "source"], "left")
         .withColumn("has_raw", F.coalesce("has_raw", F.lit(False)))
         .withColumn("has_normalized", F.coalesce("has_normalized", F.lit(False)))
         .withColumn("has_manifest", F.col("manifest_complete").isNotNull())
         .withColumn("manifest_complete", F.coalesce("manifest_complete", F.lit(False)))
         .withColumn("is_heavy", F.col("source").isin(*K.HEAVY_SOURCES)))
    s = s.withColumn("status", _status(F.col("is_heavy"), F.col("has_raw"), F.col("has_normalized"),
                                       F.col("manifest_complete")))
    # external group: heavy members with any signal decide the group status
    sig = F.col("has_raw") | F.col("has_normalized") | F.col("has_manifest")
    grp = (s.filter(F.col("source").isin(*K.EXTERNAL_GROUP_MEMBERS) & sig).groupBy("dt")
           .agg(F.bool_and(F.col("status") == "complete").alias("_all"),
                F.bool_or(F.col("status") == "raw_only").alias("_any_raw_only")))
    rolled = F.when(F.col("_all"), "complete").when(F.col("_any_raw_only"), "raw_only").otherwise("partial")
    s = s.join(grp, "dt", "left")
    s = s.withColumn("status", F.when((F.col("source") == "external_skills") & F.col("_all").isNotNull(), rolled)
                     .otherwise(F.col("status"))).drop("_all", "_any_raw_only")
    return s.withColumn("is_complete", F.col("status") == "complete")


def partial_reasons(states: DataFrame, notes: DataFrame, files: DataFrame) -> DataFrame:
    """agg_partial_reasons: per day the reasons a run is half done (in the
    fixed order) and the recommended action."""
    cache = files.groupBy("dt").agg(F.count(F.lit(1)).alias("_files"))
    d = notes.join(cache, "dt", "left").withColumn("cache_exists", F.coalesce(F.col("_files"), F.lit(0)) > 0)
    raw, summ, cache_ok = F.col("raw_note_exists"), F.col("summary_note_exists"), F.col("cache_exists")
    base = F.array_compact(F.array(
        F.when(cache_ok & ~raw, F.lit(K.REASON_RAW_NOTE_MISSING)),
        F.when(raw & ~summ, F.lit(K.REASON_SUMMARY_MISSING)),
        F.when(cache_ok & ~summ, F.lit(K.REASON_SUMMARY_NOT_BUILT))))
    order = {s: i for i, s in enumerate(K.HEAVY_SOURCES)}
    h = states.filter(F.col("source").isin(*K.HEAVY_SOURCES) & F.col("status").isin("raw_only", "normalized_only"))
    pos = None
    for s_, i in order.items():
        pos = F.when(F.col("source") == s_, F.lit(i)) if pos is None else pos.when(F.col("source") == s_, F.lit(i))
    msg = F.when(F.col("status") == "raw_only",
                 F.concat(F.col("source"), F.lit(K.REASON_RAW_ONLY.replace("{source}", "")))) \
        .otherwise(F.concat(F.col("source"), F.lit(K.REASON_NORMALIZED_ONLY.replace("{source}", ""))))
    # at most four heavy sources per day: a bounded list
    hs = h.groupBy("dt").agg(F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), msg.alias("m")))),
                                         lambda x: x["m"]).alias("_heavy"))
    out = d.join(hs, "dt", "left")
    reasons = F.concat(base, F.coalesce(F.col("_heavy"), F.array().cast("array<string>")))
    has_existing = raw | summ | cache_ok
    partial = F.size(reasons) > 0
    action = (F.when(has_existing & partial, F.lit(K.ACTION_INCREMENTAL)).when(has_existing, F.lit(K.ACTION_EXISTING))
              .otherwise(F.lit(K.ACTION_FRESH)))
    return out.select("dt", partial.alias("is_partial_run"), F.array_join(reasons, "; ").alias("partial_reasons"),
                      action.alias("recommended_action"))


def due_days(calendar: DataFrame, successes: DataFrame, look_back: int = 7) -> DataFrame:
    """flt_frequency_due: rows of ``calendar`` (source, frequency, day) on which
    the source is due. daily / 3x_week / irregular always are, weekday skips
    Saturday and Sunday, weekly skips a day with a success (source, d) in the
    ``look_back`` days before it. Each success is expanded to the days it
    covers and anti-joined; distinct (source, day) rows bound the expansion."""
    covered = (successes.filter("d is not null").distinct()
               .select("source", F.explode(F.sequence(F.date_add("d", 1), F.date_add("d", look_back))).alias("day")).distinct())
    weekly = calendar.filter(F.col("frequency") == "weekly").join(covered, ["source", "day"], "left_anti")
    weekday = calendar.filter((F.col("frequency") == "weekday") & F.dayofweek("day").between(2, 6))
    always = calendar.filter(F.col("frequency").isin("daily", "3x_week", "irregular"))
    return always.unionByName(weekday, allowMissingColumns=False).unionByName(weekly.select(*calendar.columns))


def skipped_sources(states: DataFrame, due: DataFrame) -> DataFrame:
    """inc_weekly_skip: (dt, source, by_rule) of the sources without cache files
    whose manifest entry says complete; ``by_rule``: the source isn't due that day."""
    done = states.filter((F.col("status") == "complete") & ~F.col("has_raw") & ~F.col("has_normalized") & F.col("manifest_complete"))
    days = due.select("source", F.col("day").alias("dt"), F.lit(False).alias("_free")).distinct()
    return done.join(days, ["dt", "source"], "left").select("dt", "source", F.coalesce("_free", F.lit(True)).alias("by_rule"))
