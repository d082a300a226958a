"""Focus-time operators over focus sessions: day filter, day summary,
heat map, per project / tag / task minutes, all-time totals, top tasks,
focus seconds from per-task focus lists and the rolling request-rate check.

Every statistic is a partial+final ``groupBy``; sessions are exploded to
(session, task) and (session, task, tag) rows first. A session with several
tasks gives its full duration to each of them (the service's split rule is
not visible; SURVEY hard part (f)).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.constants import LOCAL_ZONE, POMODORO_MINUTES, REQUEST_LIMIT_PER_MINUTE


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def session_type(col) -> Column:
    """fn_session_type: 0 -> pomodoro (番茄), else stopwatch (正向计时)."""
    return F.when(_c(col) == 0, F.lit("番茄")).otherwise(F.lit("正向计时"))


def session_minutes(start, end, pause) -> Column:
    """fn_session_minutes: (end - start - pause) / 60, whole minutes."""
    secs = (F.unix_seconds(D.service_ts(start)) * -1 + F.unix_seconds(D.service_ts(end))
            - F.coalesce(_c(pause), F.lit(0)))
    return F.floor(secs / 60).cast("long")


def pomodoros(minutes) -> Column:
    """fn_pomodoros: minutes // 25."""
    return F.floor(_c(minutes) / POMODORO_MINUTES).cast("long")


def with_minutes(sessions: DataFrame) -> DataFrame:
    return (sessions
            .withColumn("minutes", session_minutes("start_time", "end_time", "pause_sec"))
            .withColumn("local_date", D.local_date(D.service_ts("start_time"), LOCAL_ZONE)))


def sessions_on_day(sessions: DataFrame, day: _dt.date) -> DataFrame:
    """flt_focus_day: sessions whose start falls on the local day."""
    return with_minutes(sessions).filter(F.col("local_date") == F.lit(day))


def day_summary(sessions: DataFrame, day: _dt.date) -> DataFrame:
    """agg_focus_today: minutes, session count, whole pomodoros."""
    s = sessions_on_day(sessions, day)
    return (s.agg(F.coalesce(F.sum("minutes"), F.lit(0)).cast("long").alias("total_minutes"),
                  F.count(F.lit(1)).alias("session_count"))
            .withColumn("pomodoros", pomodoros("total_minutes"))
            .withColumn("date", F.lit(day.strftime("%Y%m%d"))))


def heatmap(sessions: DataFrame, start: _dt.date, end: _dt.date) -> DataFrame:
    """agg_focus_heatmap: minutes per local day in [start, end]."""
    s = with_minutes(sessions).filter(F.col("local_date").between(F.lit(start), F.lit(end)))
    return s.groupBy(F.date_format("local_date", "yyyyMMdd").alias("day")).agg(
        F.sum("minutes").cast("long").alias("duration"), F.count(F.lit(1)).alias("sessions"))


def _task_rows(sessions: DataFrame, start: _dt.date, end: _dt.date) -> DataFrame:
    s = with_minutes(sessions).filter(F.col("local_date").between(F.lit(start), F.lit(end)))
    return s.select("id", "minutes", F.explode("tasks").alias("task"))


def by_project(sessions: DataFrame, start: _dt.date, end: _dt.date) -> DataFrame:
    """agg_focus_by_project: minutes per project, descending."""
    t = _task_rows(sessions, start, end)
    return (t.groupBy(F.col("task.project_name").alias("project"))
            .agg(F.sum("minutes").cast("long").alias("minutes"))
            .orderBy(F.col("minutes").desc(), "project"))


def by_tag(sessions: DataFrame, start: _dt.date, end: _dt.date) -> DataFrame:
    """agg_focus_by_tag: minutes per tag."""
    t = _task_rows(sessions, start, end).select("minutes", F.explode("task.tags").alias("tag"))
    return t.groupBy("tag").agg(F.sum("minutes").cast("long").alias("minutes"))


def by_task(sessions: DataFrame, start: _dt.date, end: _dt.date, keyword: str | None = None) -> DataFrame:
    """agg_focus_by_task: minutes per task title (optionally matching a
    keyword, case-insensitive), descending, with pomodoros."""
    t = _task_rows(sessions, start, end)
    if keyword is not None:
        t = t.filter(F.lower(F.col("task.title")).contains(keyword.lower()))
    return (t.groupBy(F.col("task.title").alias("task")).agg(F.sum("minutes").cast("long").alias("minutes"))
            .withColumn("pomodoros", pomodoros("minutes"))
            .orderBy(F.col("minutes").desc(), "task"))


def top_tasks(sessions: DataFrame, start: _dt.date, end: _dt.date, k: int = 10) -> DataFrame:
    """top_focus_tasks: top k tasks by minutes (ties by title)."""
    return by_task(sessions, start, end).limit(k)


def all_time(sessions: DataFrame) -> DataFrame:
    """agg_focus_all_time: session count and minutes overall."""
    s = with_minutes(sessions)
    return s.agg(F.count(F.lit(1)).alias("count"), F.sum("minutes").cast("long").alias("duration"))


def focus_chunks(sessions: DataFrame) -> DataFrame:
    """Per-task focus summaries: each session split into pomodoro-sized focus
    entries ``[id, start_sec, end_sec]`` (a bounded array per session). Every
    task of a session gets its full time, to the second."""
    start = F.unix_seconds(D.service_ts("start_time"))
    s = sessions.withColumn("_secs", F.unix_seconds(D.service_ts("end_time")) - start - F.coalesce("pause_sec", F.lit(0)))
    entry = POMODORO_MINUTES * 60
    n = F.greatest(F.ceil(F.col("_secs") / entry), F.lit(1)).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.concat(F.col("id").cast("string"), F.lit("-"), i.cast("string")).alias("id"),
        (start + i * entry).alias("start_sec"),
        (start + F.least((i + 1) * entry, F.col("_secs"))).alias("end_sec")))
    rows = s.select("tasks", n.alias("pomo_count"), chunks.alias("focuses"))
    return rows.select(F.explode("tasks").alias("_task"), "pomo_count", "focuses").select(
        F.col("_task.title").alias("task"), "pomo_count", "focuses")


def focus_seconds(summaries: DataFrame) -> DataFrame:
    """agg_focus_seconds: actual seconds per task = sum(end - start) over the
    focus entries (``pomo_count`` is an estimate and is not used)."""
    per_row = F.aggregate(F.transform("focuses", lambda f: f["end_sec"] - f["start_sec"]),
                          F.lit(0).cast("long"), lambda acc, x: acc + x)
    return summaries.groupBy("task").agg(F.sum(per_row).cast("long").alias("focus_seconds"))


def request_rate(requests: DataFrame, token: str = "token", ts: str = "ts",
                 limit: int = REQUEST_LIMIT_PER_MINUTE, chunk_seconds: int = 3600) -> DataFrame:
    """win_request_rate: requests per token in the rolling 60 s ending at each
    request (inclusive), flagged when above the limit.

    Skew-safe: the window is partitioned by (token, hour chunk) instead of by
    token, so one hot token is split across tasks. Each chunk also receives
    copies of the previous chunk's last 60 s of requests (marked ``_carry``)
    so windows crossing a chunk edge still count them; copies are dropped
    after counting. The result is exact.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    base = requests.withColumn("_us", micros).withColumn(
        "_chunk", F.floor(F.col("_us") / (chunk_seconds * 1_000_000)))
    in_tail = (F.col("_us") - F.col("_chunk") * chunk_seconds * 1_000_000) >= (chunk_seconds - 60) * 1_000_000
    carry = (base.filter(in_tail).withColumn("_chunk", F.col("_chunk") + 1).withColumn("_carry", F.lit(True)))
    rows = base.withColumn("_carry", F.lit(False)).unionByName(carry)
    w = Window.partitionBy(token, "_chunk").orderBy("_us").rangeBetween(-60_000_000, 0)
    counted = rows.withColumn("requests_60s", F.count(F.lit(1)).over(w)).filter(~F.col("_carry"))
    return (counted.withColumn("over_limit", F.col("requests_60s") > limit)
            .drop("_us", "_chunk", "_carry"))
