"""Report operators: freshness verdicts, limitation messages, item lines and
the compact context document.

Everything is computed as DataFrames; only the final document assembly
gathers rows, and those rows are already bounded (per-source stats, at most
k items per source, the overall top 18, a handful of messages).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import dates as D
from ..functions import text as X


def _in(col: str, values) -> Column:
    return F.col(col).isin(*values)


def freshness_verdict(report: DataFrame) -> DataFrame:
    """agg_freshness_verdict: hard vs deep source freshness sums and the
    rule-based conclusions (one row)."""
    s = report.agg(
        F.coalesce(F.sum(F.when(_in("source", K.BREAKING_SOURCES), F.col("fresh_48h"))), F.lit(0)).cast("long").alias("hard_fresh"),
        F.coalesce(F.sum(F.when(_in("source", K.BREAKING_SOURCES), F.col("recent_7d"))), F.lit(0)).cast("long").alias("hard_recent"),
        F.coalesce(F.sum(F.when(_in("source", K.DEEP_SOURCES), F.col("fresh_48h"))), F.lit(0)).cast("long").alias("deep_fresh"),
        F.coalesce(F.sum(F.when(_in("source", K.DEEP_SOURCES), F.col("recent_7d"))), F.lit(0)).cast("long").alias("deep_recent"))
    hf, hr, df_, dr = (F.col(c) for c in ("hard_fresh", "hard_recent", "deep_fresh", "deep_recent"))
    first = F.when((hf == 0) & (hr == 0), F.lit(K.VERDICT_NO_HARD_7D)).when(hf == 0, F.lit(K.VERDICT_NO_HARD_48H))
    second = F.when((df_ + dr > 0) & (hf == 0), F.lit(K.VERDICT_DEEP_NEWER))
    lst = F.array_compact(F.array(first, second))
    lst = F.when(F.size(lst) == 0, F.array(F.lit(K.VERDICT_OK))).otherwise(lst)
    return s.withColumn("conclusions", F.array_join(lst, "\n"))


def freshness_warnings(buckets: DataFrame) -> DataFrame:
    """Compact-report variant of the verdict (no default conclusion)."""
    s = buckets.agg(
        F.coalesce(F.sum(F.when(_in("source", K.BREAKING_SOURCES), F.col("fresh_48h"))), F.lit(0)).alias("hf"),
        F.coalesce(F.sum(F.when(_in("source", K.BREAKING_SOURCES), F.col("recent_7d"))), F.lit(0)).alias("hr"),
        F.coalesce(F.sum(F.when(_in("source", K.DEEP_SOURCES), F.col("fresh_48h") + F.col("recent_7d"))), F.lit(0)).alias("dd"))
    first = (F.when((F.col("hf") == 0) & (F.col("hr") == 0), F.lit(K.WARN_NO_HARD_7D))
             .when(F.col("hf") == 0, F.lit(K.WARN_NO_HARD_48H)))
    second = F.when((F.col("dd") > 0) & (F.col("hf") == 0), F.lit(K.WARN_DEEP_NEWER))
    return s.select(F.posexplode(F.array_compact(F.array(first, second))).alias("pos", "line"))


def item_line(scored: DataFrame) -> Column:
    """snk_item_line: ``- **title**（meta · ...）：summary [链接](url)``."""
    eng = F.col("engagement")
    bucket = D.freshness_bucket(F.col("age_days"))
    meta = F.concat_ws(
        " · ",
        F.when(X.nonempty("source_name"), F.col("source_name")),
        F.when(X.nonempty("kind"), F.col("kind")),
        F.when(F.col("score").isNotNull(), F.concat(F.lit("score="), F.col("score").cast("string"))),
        F.when(F.coalesce(eng, F.lit(0)) != 0, F.concat(F.lit("engagement="), eng.cast("string"))),
        F.when(X.nonempty("status") & (F.col("status") != "ready"), F.concat(F.lit("status="), F.col("status"))),
        F.when(X.nonempty("published_at"), F.concat(F.lit("published="), F.col("published_at"))),
        F.when(bucket != "undated", F.concat(F.lit("freshness="), bucket)))
    title = F.when(X.nonempty("title"), F.col("title")).otherwise(F.lit(K.UNTITLED))
    return F.concat(
        F.lit("- **"), title, F.lit("**"),
        F.when(meta != "", F.concat(F.lit("（"), meta, F.lit("）"))).otherwise(F.lit("")),
        F.when(X.nonempty("summary"), F.concat(F.lit("："), F.col("summary"))).otherwise(F.lit("")),
        F.when(X.nonempty("url"), F.concat(F.lit(f" [{K.LINK_LABEL}]("), F.col("url"), F.lit(")"))).otherwise(F.lit("")))


def limitations(rss_feeds: DataFrame | None, mail_entries: DataFrame | None, candidate_stats: DataFrame | None,
                digest_errors: DataFrame | None, tweet_items: DataFrame | None, hot_request: DataFrame | None,
                hot_dropped: DataFrame | None, spark) -> DataFrame:
    """agg_limitations: message rows (pos, line) from payload statistics, in
    the fixed order of the report. Each input is a small aggregate."""
    parts = []

    def add(pos, df_line):
        parts.append(df_line.select(F.lit(pos).alias("pos"), F.col("line")))
    one = spark.range(1)
    if rss_feeds is None:
        add(0, one.select(F.lit(K.LIMIT_RSS_MISSING).alias("line")))
    else:
        n = rss_feeds.agg(F.count_if(F.col("error").isNotNull()).alias("n"))
        add(1, n.filter(F.col("n") > 0).select(F.format_string(K.LIMIT_RSS_ERRORS.replace("{n}", "%d"), "n").alias("line")))
    if mail_entries is None:
        add(2, one.select(F.lit(K.LIMIT_EMAIL_MISSING).alias("line")))
    else:
        n = mail_entries.agg(F.count(F.lit(1)).alias("n"))
        add(2, n.filter(F.col("n") == 0).select(F.lit(K.LIMIT_EMAIL_MISSING).alias("line")))
    if candidate_stats is not None:
        add(3, candidate_stats.filter(F.col("deep_read_rate_limited") > 0).select(
            F.format_string(K.LIMIT_BB_RATE.replace("{n}", "%d"), "deep_read_rate_limited").alias("line")))
        add(4, candidate_stats.filter(F.col("items_needing_followup") > 0).select(
            F.format_string(K.LIMIT_BB_FOLLOWUP.replace("{n}", "%d"), "items_needing_followup").alias("line")))
    if digest_errors is not None:   # one-row count ``n`` of upstream errors
        n = digest_errors
        add(5, n.filter(F.col("n") > 0).select(F.format_string(K.LIMIT_AK_ERRORS.replace("{n}", "%d"), "n").alias("line")))
    if tweet_items is not None:    # one-row count ``n`` of kept tweets
        add(6, tweet_items.filter(F.col("n") > 0).select(F.lit(K.LIMIT_FB_TWEETS).alias("line")))
    if hot_request is not None:     # one row ``mode`` of the payload's request, null without a request
        mode = F.when(F.col("mode") == "", F.lit("selected")).otherwise(F.col("mode"))
        add(7, hot_request.filter("mode is not null").select(F.format_string(K.LIMIT_HOT_MODE.replace("{mode}", "%s"), mode).alias("line")))
    if hot_dropped is not None:     # one-row count ``n`` of dropped hot items
        n = hot_dropped
        add(8, n.filter(F.col("n") > 0).select(F.format_string(K.LIMIT_HOT_DROPPED.replace("{n}", "%d"), "n").alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compact_context_lines(stats: DataFrame, buckets: DataFrame, warnings: DataFrame, limits: DataFrame,
                          winners: DataFrame, overall: DataFrame, date: str) -> DataFrame:
    """snk_compact_context as ordered rows ``(section, source_ord, pos, line)``;
    ``render`` joins them. Every source of the fixed list has its statistics,
    freshness and heading, also without items. All inputs are bounded by the number of
    sources and the top-k limits."""
    from .digest import source_ordinal
    spark = stats.sparkSession
    layout = "section int, source_ord int, pos bigint, line string"
    sources = spark.createDataFrame([(x,) for x in K.DIGEST_SOURCES], "source string")

    def rows(section: int, line: Column, source_ord: Column | None = None, pos: Column | None = None) -> list[Column]:
        return [F.lit(section).alias("section"), (F.lit(0) if source_ord is None else source_ord).alias("source_ord"),
                (F.lit(0) if pos is None else pos).cast("bigint").alias("pos"), line.alias("line")]

    def counts(df: DataFrame, section: int, form: str, fields: tuple) -> DataFrame:
        dense = sources.join(df, "source", "full").fillna(0, list(fields))
        return dense.select(*rows(section, F.format_string(form, "source", *fields), source_ordinal()))

    def bullets(df: DataFrame, section: int) -> DataFrame:
        return df.select(*rows(section, F.concat(F.lit("- "), "line"), pos=F.col("pos")))

    fixed = [(0, f"# compact context {date}"), (0, ""), (0, K.HEAD_STATS), (0, ""), (2, ""), (2, K.HEAD_FRESHNESS), (2, ""),
             (6, ""), (6, K.HEAD_LIMITS), (6, ""), (8, ""), (8, K.HEAD_CANDIDATES), (8, ""), (10, K.HEAD_OVERALL), (10, ""), (12, "")]
    titles = spark.createDataFrame([(x, 0, i, line) for i, (x, line) in enumerate(fixed)], layout)
    some = warnings.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    conclusions = some.select(F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(x).alias("line"))
                                                  for i, x in enumerate(("", K.HEAD_CONCLUSIONS, ""))])).alias("t"))
    none = limits.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    held = winners.select("source").distinct().withColumn("held", F.lit(True))
    empty = F.when(F.col("held").isNull(), F.struct(F.lit(0).alias("pos"), F.lit(K.NO_CANDIDATES).alias("line")))
    frame = sources.join(held, "source", "full").select("source", F.explode(F.array_compact(F.array(
        F.struct(F.lit(-2).alias("pos"), F.concat(F.lit("### "), "source").alias("line")), F.struct(F.lit(-1).alias("pos"), F.lit("").alias("line")),
        empty, F.struct(F.lit((1 << 31) - 1).alias("pos"), F.lit("").alias("line"))))).alias("t"))
    w = Window.orderBy(F.col("priority").desc(), F.coalesce(F.col("score"), F.lit(0.0)).desc(), F.col("engagement").desc(),
                       F.coalesce(F.col("title"), F.lit("")).desc(), source_ordinal().asc(), F.col("rank").asc())
    parts = [
        counts(stats, 1, "- %s: total=%d, selected=%d, linked=%d, dated=%d, fresh_48h=%d, recent_7d=%d",
               ("total_items", "selected_items", "linked_items", "dated_items", "fresh_48h_items", "recent_7d_items")),
        counts(buckets, 3, "- %s: fresh_48h=%d, recent_7d=%d, stale_gt7d=%d, undated=%d", ("fresh_48h", "recent_7d", "stale_gt7d", "undated")),
        conclusions.select(*rows(4, F.col("t.line"), pos=F.col("t.pos"))),
        bullets(warnings, 5), bullets(limits, 7), none.select(*rows(7, F.lit(K.NO_LIMITS))),
        frame.select(*rows(9, F.col("t.line"), source_ordinal(), F.col("t.pos"))),
        winners.select(*rows(9, item_line(winners), source_ordinal(), F.col("rank"))),
        overall.select(*rows(11, item_line(overall), pos=F.row_number().over(w))),
    ]
    out = titles
    for p in parts:
        out = out.unionByName(p)
    return out


def render(lines: DataFrame) -> DataFrame:
    """Join bounded report rows into one Markdown document (one row)."""
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("section", "source_ord", "pos", "line"))), lambda r: r["line"]), "\n").alias("markdown"))
