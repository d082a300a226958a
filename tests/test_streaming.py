"""Streaming rolling dedup against its rule, worked out by the batch form."""

import datetime as dt
import os

from quillstream.operators import dedup as DD
from quillstream.streaming import rolling_dedup as RD

SCHEMA = "idx long, title string, event_ts timestamp"


def test_stream_keeps_what_the_rule_keeps(spark, scratch):
    src = os.path.join(scratch, "in")
    start = dt.datetime(2024, 1, 1)
    rows = [(d * 10 + j, f"topic / {step}", start + dt.timedelta(days=d, hours=j))
            for d in range(40) for j, step in enumerate((3, 10, 20)) if d % step == 0]
    rows += [(1000 + i, "Late one", start + dt.timedelta(days=d)) for i, d in enumerate((0, 20, 35))]
    rows += [(2000, "topic / 10", start + dt.timedelta(hours=5)), (2001, " -- ", start), (2002, "", start + dt.timedelta(days=1))]
    for lo in range(0, 40, 5):                               # file order = arrival order for the stream
        part = [r for r in rows if lo <= (r[2] - start).days < lo + 5]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    q = RD.start(RD.rolling_dedup(RD.item_stream(spark, src, SCHEMA)), os.path.join(scratch, "out"), os.path.join(scratch, "ckpt"))
    q.awaitTermination(300)
    got = {r.idx for r in spark.read.parquet(os.path.join(scratch, "out")).collect()}

    items = spark.read.schema(SCHEMA).parquet(src).withColumn("event_key", DD.event_key("title"))
    assert got == {r.idx for r in DD.rolling_keep(items).filter("keep").collect()}
    assert {1000, 1001, 1002, 2001, 2002} <= got and 2000 not in got
    assert {r[0] for r in rows if r[1] == "topic / 10" and r[0] in got} == {1, 201}
