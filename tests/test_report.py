"""The compact report's scaffold and the normalisers' statistics."""

from quillstream.functions import constants as K
from quillstream.operators import digest as G
from quillstream.operators import normalize as N
from quillstream.operators import report as R
from quillstream.plans.adapters import as_of_col

ITEM = ("source string, idx long, kind string, title string, url string, summary string, source_name string, status string, confidence string, "
        "score double, published_at string, signal_score int, likes long, retweets long, replies long")


def document(spark, rows, limits=()):
    items = spark.createDataFrame(rows, ITEM)
    scored = G.score_items(G.compact_items(items), as_of_col())
    winners = G.top_per_source(scored)
    buckets = G.freshness_buckets(scored)
    limit_rows = spark.createDataFrame(list(limits), "pos int, line string")
    lines = R.compact_context_lines(G.source_stats(scored), buckets, R.freshness_warnings(buckets), limit_rows, winners, G.top_overall(winners), "2024-01-30")
    return R.render(lines).first().markdown.split("\n")


def test_every_source_has_its_section(spark):
    rows = [("aihot", 1, "aihot_item", "Title", "https://e/1", "S", "n", "ready", "high", 5.0, "2024-01-30T10:00:00Z", None, None, None, None)]
    doc = document(spark, rows, [(1, "one"), (3, "two")])
    heads = [x for x in doc if x.startswith("#")]
    assert heads == ["# compact context 2024-01-30", K.HEAD_STATS, K.HEAD_FRESHNESS, K.HEAD_LIMITS, K.HEAD_CANDIDATES,
                     *[f"### {x}" for x in K.DIGEST_SOURCES], K.HEAD_OVERALL]
    at = doc.index("### rss")
    assert doc[at:at + 5] == ["### rss", "", K.NO_CANDIDATES, "", "### email"]
    at = doc.index("### aihot")
    assert doc[at + 1] == "" and doc[at + 2].startswith("- **Title**") and doc[at + 3:at + 5] == ["", K.HEAD_OVERALL]
    assert "- rss: total=0, selected=0, linked=0, dated=0, fresh_48h=0, recent_7d=0" in doc
    assert "- rss: fresh_48h=0, recent_7d=0, stale_gt7d=0, undated=0" in doc
    assert doc[doc.index(K.HEAD_LIMITS):][2:4] == ["- one", "- two"] and doc[-1] == ""


def test_report_without_items(spark):
    doc = document(spark, [])
    assert doc.count(K.NO_CANDIDATES) == len(K.DIGEST_SOURCES) and K.NO_LIMITS in doc
    assert doc[doc.index(K.HEAD_CONCLUSIONS) + 2] == "- " + K.WARN_NO_HARD_7D


def test_statistics_have_each_sources_fields(spark):
    rows = spark.createDataFrame([("bestblogs", None, "ready", True, "ok", None), ("bestblogs", None, "deferred_rate_limited", False, "rate_limited", None),
                                  ("bestblogs", "missing_title", "ready", True, None, None), ("aihot", None, "ready", True, None, True)],
                                 "source string, reason string, status string, has_direct_url boolean, outcome string, selected boolean").selectExpr("*", "'k' as kind")
    got = {r.source: r.fingerprint for r in N.fingerprint(N.normalize_stats(rows)).collect()}
    assert got["aihot"] == 'aihot|{"dropped_items":0,"items_with_direct_url":1,"normalized_items":1,"selected_items":1}|1'
    assert got["bestblogs"] == ('bestblogs|{"candidate_count":3,"deep_read_attempted":2,"deep_read_completed":1,"deep_read_rate_limited":1,"dropped_items":1,'
                                '"items_needing_followup":1,"items_with_direct_url":1,"normalized_items":2}|2')
    errors = spark.createDataFrame([("ak-rss-digest", 2)], "source string, upstream_errors long")
    assert N.normalize_stats(rows.withColumn("source", rows.source.substr(1, 0)), errors).count() == 1
