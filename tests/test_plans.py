"""Plan-shape guards over every registered query."""

import __spark_entry__ as E

SF001 = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_joins_in_any_query(spark):
    bad = {}
    for name, q in sorted(E.queries().items()):
        plan = _plan(q(spark, SF001))
        hits = [k for k in ("CartesianProduct", "BroadcastNestedLoopJoin") if k in plan]
        if hits:
            bad[name] = hits
    assert not bad, bad


def test_top_k_limits_before_shuffle(spark):
    df = E.queries()["top_per_source"](spark, SF001)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_sections_rank_few_rows_and_read_the_texts_once(spark):
    from quillstream.plans import dedup_queries as Q

    dd = Q._dd(spark, SF001)
    df = Q._sections(dd)
    plan = _plan(df)
    assert plan.count("WindowGroupLimit") >= 3
    for name in ("ddp_headline_3d", "snk_summary_stats", "ddp_continuation"):
        assert _plan(E.queries()[name](spark, SF001)).count("documents.parquet") <= 2


def test_vendor_anchors_meet_words_before_any_shuffle(spark):
    from quillstream.plans import dedup_queries as Q

    m = Q.SC.vendor_mentions(Q.digest_items(spark, SF001).select("idx", "title", "summary"), Q._vendors(spark, SF001))
    plan = _plan(m)
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "BroadcastHashJoin" in plan
