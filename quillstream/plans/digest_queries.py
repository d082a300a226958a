"""Registered digest queries: compact, score, top-k, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import digest as G
from . import oracle as O
from .adapters import as_of_col, digest_items
from .registry import register

_CTES = (O.ITEMS_CTE, O.COMPACT_CTE)


def scored_items(spark, sf_dir):
    return G.score_items(G.compact_items(digest_items(spark, sf_dir)), as_of_col())


_ITEM_COLS = ["source", "idx", "kind", "title", "url", "summary", "source_name", "status",
              "confidence", "score", "published_at", "has_direct_url", "engagement", "signal_score"]


@register("nrm_compact", O.with_ctes(*_CTES, body=f"SELECT {', '.join(_ITEM_COLS)} FROM compact"))
def nrm_compact(spark, sf_dir):
    """Normalised items -> compact items."""
    return G.compact_items(digest_items(spark, sf_dir)).select(*_ITEM_COLS)


@register("fn_priority", O.with_ctes(*_CTES, body="SELECT source, idx, age_days, priority FROM scored"))
def fn_priority(spark, sf_dir):
    """Priority of every compact item."""
    return scored_items(spark, sf_dir).select("source", "idx", "age_days", "priority")


_TOP_COLS = ["source", "rank", "idx", "title", "priority", "score", "engagement", "url", "kind", "status"]


@register("top_per_source", O.with_ctes(*_CTES, body=f"SELECT {', '.join(_TOP_COLS)} FROM winners"))
def top_per_source(spark, sf_dir):
    """Top 8 per source in digest order."""
    return G.top_per_source(scored_items(spark, sf_dir)).select(*_TOP_COLS)


@register("top_overall", O.with_ctes(*_CTES, body=f"""
SELECT {', '.join(_TOP_COLS)} FROM winners
ORDER BY priority DESC, coalesce(score, 0) DESC, engagement DESC, coalesce(title, '') DESC,
         {O.source_ordinal()}, rank
LIMIT 18"""))
def top_overall(spark, sf_dir):
    """Top 18 over the per-source winners (the flagship query)."""
    return G.top_overall(G.top_per_source(scored_items(spark, sf_dir))).select(*_TOP_COLS)


@register("agg_source_stats", O.with_ctes(*_CTES, body="""
SELECT source, count(*) AS total_items, least(count(*), 8) AS selected_items,
       count(*) FILTER (WHERE url IS NOT NULL AND url <> '') AS linked_items,
       count(*) FILTER (WHERE published_at IS NOT NULL AND published_at <> '') AS dated_items,
       count(*) FILTER (WHERE published_at IS NOT NULL AND published_at <> '' AND coalesce(age_days, 0) <= 1) AS fresh_48h_items,
       count(*) FILTER (WHERE published_at IS NOT NULL AND published_at <> ''
                        AND (CASE WHEN age_days = 0 THEN 999 ELSE coalesce(age_days, 999) END) <= 7) AS recent_7d_items,
       max(priority) AS top_priority
FROM scored GROUP BY source"""))
def agg_source_stats(spark, sf_dir):
    """Per-source statistics of the compact report."""
    return G.source_stats(scored_items(spark, sf_dir))


@register("agg_freshness_buckets", O.with_ctes(*_CTES, body="""
SELECT source,
       count(*) FILTER (WHERE age_days IS NOT NULL AND age_days <= 1) AS fresh_48h,
       count(*) FILTER (WHERE age_days > 1 AND age_days <= 7) AS recent_7d,
       count(*) FILTER (WHERE age_days > 7) AS stale_gt7d,
       count(*) FILTER (WHERE age_days IS NULL) AS undated
FROM scored GROUP BY source"""))
def agg_freshness_buckets(spark, sf_dir):
    """Fresh / recent / stale / undated per source against the run clock."""
    return G.freshness_buckets(scored_items(spark, sf_dir))
