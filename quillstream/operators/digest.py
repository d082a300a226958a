"""Digest operators: compact + score, per-source top-k, overall top-k and the
per-source statistics of the compact report.

Partitioning: the per-source window ranks with ``row_number() <= k``; Spark
plans a partial ``WindowGroupLimit`` before the shuffle, so each map task
sends at most k rows per source however skewed the sources are. The overall
top-k is a ``TakeOrderedAndProject`` over those winners only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import scoring as S
from ..functions import text as X
from ..functions.constants import AI_KEYWORDS, DIGEST_SOURCES, OVERALL_LIMIT, PER_SOURCE_LIMIT


def source_ordinal(col="source") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for i, s in enumerate(DIGEST_SOURCES):
        expr = F.when(c == s, F.lit(i)) if expr is None else expr.when(c == s, F.lit(i))
    return expr.otherwise(F.lit(len(DIGEST_SOURCES)))


def compact_items(items: DataFrame) -> DataFrame:
    """nrm_compact: normalised items -> compact items (truncations 140/240/80,
    defaults, published_at fallback chain, has_direct_url). Feed and mail
    rows (sources ``rss`` / ``email``) follow their own compact rules: summary
    cut at 220, fixed status, confidence from the link.

    Whole texts are cleaned once in a first projection; the cuts read the
    cleaned columns, so no regex runs twice on the same text."""
    cols = set(items.columns)

    def opt(name, dtype="string"):
        return F.col(name) if name in cols else F.lit(None).cast(dtype)

    deep_pub = F.col("deep_read.publish_datetime") if "deep_read" in cols else F.lit(None).cast("string")
    cleaned = items.select(
        "source", "idx", F.col("kind"), F.col("url"),
        X.clean_text_nourl(F.col("title")).alias("_title"),
        X.clean_text_nourl(F.col("summary")).alias("_summary"),
        X.clean_text_nourl(opt("source_name")).alias("_source_name"),
        opt("status").alias("_status"), opt("confidence").alias("_confidence"),
        opt("score", "double").alias("score"),
        X.first_nonempty(opt("published_at"), opt("published_local"), deep_pub).alias("published_at"),
        opt("has_direct_url", "boolean").alias("_hdu"),
        S.engagement(opt("likes", "long"), opt("replies", "long"), opt("retweets", "long")).alias("engagement"),
        opt("signal_score", "int").alias("signal_score"),
    )
    src = F.col("source")
    is_feed = src == "rss"
    is_mail = src == "email"
    plain = ~(is_feed | is_mail)
    url_ok = X.nonempty("url")
    summary_240 = X.cut(F.col("_summary"), 240)
    summary = (F.when(plain, F.when(summary_240 != "", summary_240).otherwise(X.cut(F.col("_title"), 120)))
               .otherwise(X.cut(F.col("_summary"), 220)))
    status = F.when(plain, F.coalesce(F.nullif(F.col("_status"), F.lit("")), F.lit("ready"))).otherwise(F.lit("ready"))
    confidence = (F.when(is_feed, F.lit("high"))
                  .when(is_mail, F.when(url_ok, F.lit("high")).otherwise(F.lit("medium")))
                  .otherwise(F.coalesce(F.nullif(F.col("_confidence"), F.lit("")), F.lit("medium"))))
    return cleaned.select(
        "source", "idx",
        F.coalesce(F.nullif(F.col("kind"), F.lit("")), F.lit("item")).alias("kind"),
        X.cut(F.col("_title"), 140).alias("title"), "url", summary.alias("summary"),
        X.cut(F.col("_source_name"), 80).alias("source_name"),
        status.alias("status"), confidence.alias("confidence"), "score", "published_at",
        (F.coalesce(F.col("_hdu"), F.lit(False)) | url_ok).alias("has_direct_url"),
        "engagement", "signal_score",
    )


def score_items(compact: DataFrame, as_of: Column) -> DataFrame:
    """fn_priority over compact items; adds ``published_ts``, ``age_days``
    and ``priority``. Compact fields are already cleaned and cut below 500
    chars, so the keyword text is their lower-cased join (cleaning again would
    change nothing)."""
    kw_text = F.concat_ws(" ", *[F.when(X.nonempty(c), F.lower(F.col(c)))
                                 for c in ("title", "summary", "source_name")])
    staged = (compact
              .withColumn("published_ts", D.parse_datetime("published_at"))
              .withColumn("age_days", D.age_days("published_ts", as_of))
              .withColumn("_kw_text", kw_text))
    kw = S.keyword_hits("_kw_text", AI_KEYWORDS)
    return staged.withColumn("priority", S.priority(
        kw, "url", "has_direct_url", "confidence", "kind", "score", "engagement",
        "signal_score", "age_days", "status")).drop("_kw_text")


def rank_order() -> list[Column]:
    """Sort of the digest: priority, score or 0, engagement, title, all
    descending; ties keep input order (idx)."""
    return [F.col("priority").desc(), F.coalesce(F.col("score"), F.lit(0.0)).desc(),
            F.col("engagement").desc(), F.coalesce(F.col("title"), F.lit("")).desc(),
            F.col("idx").asc()]


def top_per_source(scored: DataFrame, k: int = PER_SOURCE_LIMIT) -> DataFrame:
    """top_per_source: first k per source in digest order."""
    w = Window.partitionBy("source").orderBy(*rank_order())
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_overall(winners: DataFrame, k: int = OVERALL_LIMIT) -> DataFrame:
    """top_overall: top k over the union of per-source winners. Ties keep the
    order of the concatenated per-source lists (source order, then rank)."""
    ordered = winners.orderBy(*rank_order()[:-1], source_ordinal().asc(), F.col("rank").asc())
    return ordered.limit(k)


def source_stats(scored: DataFrame, k: int = PER_SOURCE_LIMIT) -> DataFrame:
    """agg_source_stats: per source total, selected, linked, dated, fresh_48h
    (undated but present dates count, quirk Q5), recent_7d (age 0 excluded,
    quirk Q6) and the top priority."""
    dated = X.nonempty("published_at")
    age = F.col("age_days")
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("total_items"),
        F.least(F.count(F.lit(1)), F.lit(k)).alias("selected_items"),
        F.count_if(X.nonempty("url")).alias("linked_items"),
        F.count_if(dated).alias("dated_items"),
        F.count_if(dated & (F.coalesce(age, F.lit(0)) <= 1)).alias("fresh_48h_items"),
        F.count_if(dated & (F.when(age == 0, F.lit(999)).otherwise(F.coalesce(age, F.lit(999))) <= 7)
                   ).alias("recent_7d_items"),
        F.max("priority").alias("top_priority"),
    )


def freshness_buckets(scored: DataFrame) -> DataFrame:
    """agg_freshness_buckets: per source fresh / recent / stale / undated by
    age against the run clock."""
    b = D.freshness_bucket(F.col("age_days"))
    return scored.groupBy("source").agg(
        F.count_if(b == "fresh").alias("fresh_48h"),
        F.count_if(b == "recent").alias("recent_7d"),
        F.count_if(b == "stale").alias("stale_gt7d"),
        F.count_if(b == "undated").alias("undated"),
    )


def freshness_report(view: DataFrame, target_date) -> DataFrame:
    """agg_freshness_report: per source counts by UTC day distance to the
    target date, total, and the first three samples in input order."""
    ts = D.parse_datetime("published_at", month_names=False)
    b = D.age_bucket(ts, F.lit(target_date).cast("date"))
    v = view.withColumn("bucket", b)
    counts = v.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("bucket") == "fresh_48h").alias("fresh_48h"),
        F.count_if(F.col("bucket") == "recent_7d").alias("recent_7d"),
        F.count_if(F.col("bucket") == "stale_gt7d").alias("stale_gt7d"),
        F.count_if(F.col("bucket") == "undated").alias("undated"),
        F.count_if(F.col("bucket") == "future").alias("future"),
    )
    w = Window.partitionBy("source").orderBy("idx")
    samples = (v.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= 3)
               .groupBy("source")
               .agg(F.array_join(F.transform(
                   F.array_sort(F.collect_list(F.struct("n", "title", "bucket"))),
                   lambda s: F.concat_ws("|", s["title"], s["bucket"])), " ;; ").alias("samples")))
    return counts.join(samples, "source", "left")
