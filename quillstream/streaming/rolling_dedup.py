"""Streaming form of the rolling 14-day event dedup (inc_rolling_dedup).

Items arrive as files (one or more landed days per batch). For each event key
the state holds the last day on which an item was kept, and nothing else: the
first item of a later day is kept if that day lies more than the window after
it. A key's state goes when the watermark has passed its day plus the window;
the watermark also drops items that arrive later than the window. Items with a
blank key are never repeats.

The batch form (``operators.dedup.rolling_keep``) answers the same question over
a stored history; they agree when days arrive in order.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.constants import DEDUP_WINDOW_DAYS
from ..operators.dedup import event_key


def _keep_firsts(ts: str, columns: list[str], window_days: int):
    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        firsts: dict[dt.date, pd.DataFrame] = {}
        for rows in batches:                                # at most one row for each day is held
            for day, of_day in rows.groupby(rows[ts].dt.date):
                both = pd.concat([firsts[day], of_day]) if day in firsts else of_day
                firsts[day] = both.sort_values([ts, "idx"]).head(1)
        last = state.get[0] if state.exists else None
        for day in sorted(firsts):
            if last is None or (day - last).days > window_days:
                last = day
                yield firsts[day][columns]
        if last is not None:
            state.update((last,))
            end = dt.datetime.combine(last, dt.time(), dt.timezone.utc) + dt.timedelta(days=window_days + 1)
            state.setTimeoutTimestamp(max(int(end.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
    return keep


def rolling_dedup(stream: DataFrame, ts: str = "event_ts", title: str = "title",
                  window_days: int = DEDUP_WINDOW_DAYS) -> DataFrame:
    """Kept items of a stream (with ``idx`` and ``ts``), by normalised title
    key and kept day."""
    keyed = stream.withColumn("event_key", event_key(title)).withWatermark(ts, f"{window_days} days")
    named = keyed.filter("event_key <> ''").groupBy("event_key").applyInPandasWithState(
        _keep_firsts(ts, keyed.columns, window_days), keyed.schema, "last date", "append", GroupStateTimeout.EventTimeTimeout)
    return named.unionByName(keyed.filter("event_key = ''"))


def item_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Landed item files as a stream, ``files_per_batch`` files per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def start(df: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append the kept items to ``sink_path``; progress and dedup state live
    in ``checkpoint`` (on shared storage in a cluster), so a restarted query
    resumes where it stopped."""
    return (df.writeStream.format(fmt).option("path", sink_path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())
