"""Scoring column functions: keyword scores, engagement and the priority
formula. Keyword scores are flat sums of ``contains`` tests so the whole
expression stays inside whole-stage codegen (no higher-order lambdas)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import (AI_KEYWORDS, CONFIDENCE_POINTS, KIND_POINTS, KIND_POINTS_DEFAULT,
                        SIGNAL_KEYWORDS, STATUS_PENALTY)
from .text import clean_text, clean_text_nourl, nonempty


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def keyword_hits(text, keywords) -> Column:
    """Number of keywords occurring as substrings of ``text`` (quirk Q1)."""
    t = _c(text)
    return reduce(lambda a, b: a + b, [t.contains(k).cast("int") for k in keywords])


def _joined(fields, clean) -> Column:
    """Python ``" ".join(clean(f).lower() for f in fields if f)``."""
    parts = [F.when(nonempty(f), F.lower(clean(_c(f)))) for f in fields]
    return F.concat_ws(" ", *parts)


def ai_keyword_score(*fields) -> Column:
    """fn_ai_keyword_score over title, summary and source name, each cleaned
    without URLs and cut at 500 chars."""
    return keyword_hits(_joined(fields, lambda c: clean_text_nourl(c, 500)), AI_KEYWORDS)


def signal_score(*fields) -> Column:
    """fn_signal_score: builder keywords over whole cleaned texts (URLs kept)."""
    return keyword_hits(_joined(fields, clean_text), SIGNAL_KEYWORDS)


def engagement(likes, replies, retweets) -> Column:
    """fn_engagement: likes + 2*replies + 2*retweets, nulls as 0."""
    z = F.lit(0).cast("long")
    return (F.coalesce(_c(likes).cast("long"), z) + F.coalesce(_c(replies).cast("long"), z) * 2
            + F.coalesce(_c(retweets).cast("long"), z) * 2)


def _lookup(col, mapping: dict, default) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v)))
    return expr.otherwise(F.lit(default))


def priority(kw_score, url, has_direct_url, confidence, kind, score, engagement_score,
             signal, age, status) -> Column:
    """fn_priority, in the fixed order of the digest rules; rounded half-even
    to 2 places (quirk Q18). ``age`` is whole days or null when undated."""
    kind_c = F.coalesce(_c(kind), F.lit(""))
    is_tweet = kind_c == "tweet"
    p = F.least(_c(kw_score) * 8, F.lit(48)).cast("double")
    p = p + F.when(nonempty(url), F.lit(18)).otherwise(F.lit(-30))
    p = p + F.when(F.coalesce(_c(has_direct_url), F.lit(False)), F.lit(10)).otherwise(F.lit(0))
    p = p + _lookup(F.coalesce(_c(confidence), F.lit("")), CONFIDENCE_POINTS, 0)
    p = p + _lookup(kind_c, KIND_POINTS, KIND_POINTS_DEFAULT)
    s = _c(score).cast("double")
    p = p + F.when(s.isNotNull(), F.least(s / 4.0, F.lit(25.0))).otherwise(F.lit(0.0))
    p = p + F.least(_c(engagement_score) / 20.0, F.when(is_tweet, F.lit(6.0)).otherwise(F.lit(14.0)))
    sig = _c(signal).cast("double")
    tweet_p = F.least(p + F.when(sig.isNotNull(), F.least(sig * 4.0, F.lit(16.0))).otherwise(F.lit(0.0)),
                      F.lit(82.0))
    p = F.when(is_tweet, tweet_p).otherwise(p)
    a = _c(age)
    p = p - F.when(a > 30, F.lit(35)).when(a > 14, F.lit(24)).when(a > 7, F.lit(14)).otherwise(F.lit(0))
    p = p - _lookup(F.coalesce(_c(status), F.lit("")), STATUS_PENALTY, 0)
    return F.bround(p, 2)


def track_score(*factors) -> Column:
    """agg_track_score: sum of 0-2 factors, each clipped to [0, 2]."""
    clipped = [F.least(F.greatest(F.coalesce(_c(f), F.lit(0)), F.lit(0)), F.lit(2)) for f in factors]
    return reduce(lambda a, b: a + b, clipped)
