"""The digest's own test cases, re-expressed as DataFrame tests."""

import datetime as dt
import json

from pyspark.sql import functions as F

from quillstream.operators import normalize as N
from quillstream.operators import runstate as RS


def test_deep_read_success_wins_over_429_text(spark):
    ok = json.dumps({"success": True, "data": {"meta": {"id": "r1", "title": "T", "url": "https://a/1", "readUrl": "https://b/1"},
                                                "markdown": "status code 429 appears in the article"}})
    rows = [("r1", ok, "", 0), ("r2", "", "RATE_LIMITED: quota exceeded", 1), ("r3", "", "boom", 2),
            ("r4", "{not json", "", 0), ("r5", '{"data": {}}', "", 0)]
    df = spark.createDataFrame(rows, "resource_id string, stdout string, stderr string, returncode int")
    got = {r.resource_id: r.outcome for r in N.deep_read_outcome(df).collect()}
    assert got == {"r1": "ok", "r2": "rate_limited", "r3": "nonzero_exit", "r4": "invalid_json", "r5": "missing_meta"}


def test_hot_item_date_filter_reasons(spark):
    rows = [(0, "a", "2026-05-08T16:30:00Z"), (1, "b", "2026-05-07T10:00:00Z"), (2, "c", None), (3, "d", "not-a-date")]
    df = spark.createDataFrame(rows, "idx long, id string, published_at string")
    out = N.target_date_strict(df, dt.date(2026, 5, 9), "Asia/Shanghai")
    got = {r.id: r.reason for r in out.collect()}
    assert got == {"a": None, "b": "outside_target_date", "c": "missing_published_at", "d": "invalid_published_at"}


def test_hot_item_normalize(spark):
    rows = [(0, "x1", "  Model  launch ", "https://e/1", "AI HOT source", "s", True, 59, "English title", None),
            (1, "x2", "No url", None, "", "s", False, 1, None, None)]
    df = spark.createDataFrame(rows, "idx long, id string, title string, url string, source_name string, summary string, "
                                     "selected boolean, score int, title_en string, reason string")
    df = df.withColumn("dt", F.lit(dt.date(2026, 5, 9))).withColumn("published_at", F.lit("2026-05-08T17:00:00Z")) \
        .withColumn("category", F.lit("ai-models"))
    out = {r.idx: r for r in N.normalize_hot_items(df).collect()}
    assert out[0].reason is None and out[0].kind == "aihot_item" and out[0].confidence == "high"
    assert out[0].has_direct_url and out[0].title == "Model launch" and out[0].id == "aihot|x1|Model launch"
    assert out[1].reason == "missing_title_or_url"


def test_run_state_raw_only_then_complete(spark):
    day = dt.date(2026, 5, 9)
    raw_only = spark.createDataFrame([(day, "aihot.json", None)], "dt date, name string, content string")
    s = {r.source: r.status for r in RS.run_state(raw_only).collect()}
    assert s["aihot"] == "raw_only"
    both = spark.createDataFrame([(day, "aihot.json", None), (day, "aihot-normalized.json", None)],
                                 "dt date, name string, content string")
    s = {r.source: r.status for r in RS.run_state(both).collect()}
    assert s["aihot"] == "complete"
    notes = spark.createDataFrame([(day, True, True)], "dt date, raw_note_exists boolean, summary_note_exists boolean")
    p = RS.partial_reasons(RS.run_state(both), notes, both).first()
    assert not p.is_partial_run and p.recommended_action == "ask_user_use_existing_or_overwrite"
    p = RS.partial_reasons(RS.run_state(raw_only), notes, raw_only).first()
    assert p.is_partial_run and "aihot" in p.partial_reasons


def test_manifest_completes_missing_heavy_source(spark):
    day = dt.date(2026, 5, 9)
    m = json.dumps({"status": "done", "sources": {"bestblogs": {"status": "Completed"}, "rss": {"completed": True}}})
    files = spark.createDataFrame([(day, "run-manifest.json", m), (day, "run-metadata.json", "{bad")],
                                  "dt date, name string, content string")
    s = {r.source: r.status for r in RS.run_state(files).collect()}
    assert s["bestblogs"] == "complete" and s["rss"] == "complete" and s["aihot"] == "missing"
