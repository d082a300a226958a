"""Normalisers: the five landed payload shapes -> one item schema, with a
reason recorded for every dropped element.

Each normaliser returns ONE DataFrame with a nullable ``reason`` column
(null = kept). ``kept`` / ``dropped`` are two filters over the same plan, so a
writer that partitions by outcome scans the input once. Payload elements that
arrive as JSON text are parsed to VARIANT, so elements that are not objects
are detected and dropped with a preview, as in the digest rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import dates as D
from ..functions import scoring as S
from ..functions import text as X

ITEM_COLUMNS = {
    "dt": "date", "source": "string", "kind": "string", "idx": "bigint", "part": "int", "id": "string",
    "title": "string", "url": "string", "summary": "string", "source_name": "string",
    "status": "string", "confidence": "string", "score": "double", "published_at": "string",
    "has_direct_url": "boolean", "signal_score": "int", "likes": "bigint", "retweets": "bigint",
    "replies": "bigint", "outcome": "string", "selected": "boolean", "reason": "string", "preview": "string",
}


def to_item_schema(df: DataFrame) -> DataFrame:
    cols = set(df.columns)
    return df.select(*[(F.col(c) if c in cols else F.lit(None)).cast(t).alias(c) for c, t in ITEM_COLUMNS.items()])


def kept(df: DataFrame) -> DataFrame:
    """Kept rows (null ``reason``)."""
    return df.select(F.inline(F.when(F.col("reason").isNull(), F.array(F.struct(*[F.col(c) for c in df.columns])))))


def dropped(df: DataFrame) -> DataFrame:
    """Dropped rows (a ``reason``)."""
    return df.select(F.inline(F.when(F.col("reason").isNotNull(), F.array(F.struct(*[F.col(c) for c in df.columns])))))


def item_id(source: str, *bits) -> Column:
    """nrm_item_id: ``source|bit|bit`` skipping null bits."""
    return F.concat_ws("|", F.lit(source), *[b.cast("string") for b in bits])


def _vs(path: str) -> Column:
    return F.try_variant_get(F.col("_v"), path, "string")


def parse_elements(df: DataFrame, raw: str = "raw") -> DataFrame:
    """flt_not_object support: parse JSON text to VARIANT and flag objects."""
    v = F.try_parse_json(F.col(raw))
    return (df.withColumn("_v", v)
            .withColumn("_is_obj", F.coalesce(F.schema_of_variant(F.col("_v")).startswith("OBJECT"), F.lit(False))))


def deep_read_outcome(responses: DataFrame) -> DataFrame:
    """jn_deep_read_outcome: classify a detail-read response. A ``data.meta``
    object wins (even when "429" appears in the text), then rate_limited,
    nonzero_exit, invalid_json, missing_meta."""
    out = F.coalesce(F.col("stdout"), F.lit(""))
    err = F.coalesce(F.col("stderr"), F.lit(""))
    has_out = X.strip_ws(out) != ""
    v = F.when(has_out, F.try_parse_json(out))
    meta = F.try_variant_get(v, "$.data.meta", "variant")
    is_meta = F.coalesce(F.schema_of_variant(meta).startswith("OBJECT"), F.lit(False))
    combined = F.upper(F.concat(out, F.lit("\n"), err))
    status = (F.when(is_meta, F.lit("ok"))
              .when(combined.contains("RATE_LIMITED") | combined.contains("429"), F.lit("rate_limited"))
              .when(F.coalesce(F.col("returncode"), F.lit(0)) != 0, F.lit("nonzero_exit"))
              .when(has_out & v.isNull(), F.lit("invalid_json"))
              .otherwise(F.lit("missing_meta")))

    def mv(name):
        return F.when(is_meta, F.try_variant_get(meta, f"$.{name}", "string"))
    message = F.when(~is_meta, X.strip_ws(X.first_nonempty(err, out)))
    return responses.select(
        "resource_id", status.alias("outcome"),
        mv("url").alias("meta_url"), mv("readUrl").alias("meta_read_url"),
        mv("oneSentenceSummary").alias("meta_one_sentence"), mv("summary").alias("meta_summary"),
        mv("featuredReason").alias("meta_featured_reason"), mv("publishDateTimeStr").alias("meta_publish"),
        message.alias("message"))


def normalize_candidates(elements: DataFrame, outcomes: DataFrame | None = None,
                         limit: int | None = None) -> DataFrame:
    """nrm_candidates (+ jn_deep_read when ``outcomes`` is given).

    Deep reads go to the titled, URL-less candidates with a resource id, by a
    left join to the landed outcomes. A service quota on them can be given as
    ``limit``: the first ones per day payload in element order (quirk Q17), a
    ``row_number`` per ``dt`` that Spark plans as a partial group limit.
    """
    e = parse_elements(elements)
    title = X.clean_text(_vs("$.title"))
    reason_raw = X.clean_text(_vs("$.selectionReason"))
    rid = _vs("$.resourceId")
    read_url = _vs("$.readUrl")
    base = e.select(
        "dt", "source", "idx", "_is_obj",
        F.when(~F.col("_is_obj"), F.substring(F.coalesce(_vs("$"), F.col("raw")), 1, 200)).alias("preview"),
        title.alias("title"),
        F.when(reason_raw != "", reason_raw).otherwise(title).alias("summary0"),
        rid.alias("resource_id"), read_url.alias("read_url"),
        X.clean_text(_vs("$.sourceName")).alias("source_name"),
        F.try_variant_get(F.col("_v"), "$.score", "double").alias("score"),
        _vs("$.language").alias("language"),
    )
    reason = (F.when(~F.col("_is_obj"), F.lit("candidate_not_object"))
              .when(F.col("title") == "", F.lit("missing_title")))
    base = base.withColumn("reason", reason)
    has_url = X.nonempty("read_url")
    has_rid = X.nonempty("resource_id")
    eligible = F.col("reason").isNull() & ~has_url & has_rid
    if outcomes is not None:
        attempted = base.filter(eligible).select("dt", "idx", "resource_id")
        if limit is not None:
            w = Window.partitionBy("dt").orderBy("idx")
            attempted = attempted.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")
        tried = attempted.join(outcomes, "resource_id", "left").select(
            "dt", "idx", F.coalesce("outcome", F.lit("missing_meta")).alias("outcome"), "meta_url",
            "meta_read_url", "meta_one_sentence", "meta_summary", "meta_featured_reason", "meta_publish")
        base = base.join(tried, ["dt", "idx"], "left")
    else:
        for c in ("outcome", "meta_url", "meta_read_url", "meta_one_sentence", "meta_summary",
                  "meta_featured_reason", "meta_publish"):
            base = base.withColumn(c, F.lit(None).cast("string"))
    oc = F.col("outcome")
    ok = oc == "ok"
    canonical = F.when(ok, X.first_nonempty("meta_url", "meta_read_url", "read_url")).otherwise(F.col("read_url"))
    summary = F.when(ok, X.clean_text(X.first_nonempty("meta_one_sentence", "meta_summary",
                                                       "meta_featured_reason", "summary0"))).otherwise(F.col("summary0"))
    can_ok = X.nonempty(canonical)
    status = (F.when(ok, F.when(can_ok, "ready").otherwise("summary_only"))
              .when(oc == "rate_limited", "deferred_rate_limited")
              .when(oc.isNotNull(), "summary_only")
              .when(has_url, "ready").when(has_rid, "needs_deep_read").otherwise("summary_only"))
    confidence = (F.when(ok, F.when(can_ok, "high").otherwise("medium"))
                  .when(oc.isNotNull(), "medium")
                  .otherwise(F.when(has_url, "high").otherwise("medium")))
    return base.select(
        "dt", "source", F.lit("article_candidate").alias("kind"), "idx",
        F.when(F.col("reason").isNull(), item_id("bestblogs", F.coalesce(F.nullif("resource_id", F.lit("")), F.col("idx").cast("string")), F.col("title"))).alias("id"),
        "title", canonical.alias("url"), summary.alias("summary"), "source_name", "score",
        "resource_id", status.alias("status"), confidence.alias("confidence"),
        can_ok.alias("has_direct_url"), "outcome", F.col("meta_publish").alias("published_at"),
        "reason", "preview")


def with_noise_reason(df: DataFrame, text: str = "text", bio: str = "bio", out: str = "noise_reason") -> DataFrame:
    """flt_post_noise: first matching drop reason for a post, or null.

    The visible text, its signal score and word count are materialised as
    columns first, so each regex and the 63 substring tests run once per row."""
    staged = (df.withColumn("_visible", X.strip_ws(X.remove_urls(X.clean_text(text))))
              .withColumn("_sig", S.signal_score("_visible", X.clean_text(bio)))
              .withColumn("_wc", X.word_count("_visible")))
    v, sig, wc = F.col("_visible"), F.col("_sig"), F.col("_wc")
    reason = (F.when((v == "") | X.is_url_only(X.clean_text(text)), F.lit("url_only_or_empty_text"))
              .when(X.noise_pattern_hit(F.lower(v)), F.lit("known_low_signal_pattern"))
              .when((wc <= 4) & (sig < 2), F.lit("too_short_without_ai_builder_signal"))
              .when((wc <= 9) & (sig == 0), F.lit("short_without_ai_builder_signal"))
              .when(sig == 0, F.lit("missing_ai_builder_signal")))
    return staged.withColumn(out, reason)


def normalize_posts(posts: DataFrame) -> DataFrame:
    """nrm_posts: social posts -> tweet items (url required, noise filter,
    signal score, title, confidence, engagement)."""
    p = posts.select(
        "dt", "idx", "builder_idx", X.clean_text("builder_name").alias("builder_name"),
        X.clean_text("handle").alias("handle"), X.clean_text("bio").alias("bio"),
        "tweet_id", X.clean_text("text").alias("text"), "url", "created_at", "likes", "retweets", "replies",
        "is_quote")
    p = with_noise_reason(p, "text", "bio", "_noise").withColumnRenamed("_visible", "visible")
    sig = F.col("_sig")
    noise = F.col("_noise")
    reason = F.when(~X.nonempty("url"), F.lit("missing_url")).otherwise(noise)
    who = X.first_nonempty("builder_name", "handle")
    return p.select(
        "dt", F.lit("follow-builders").alias("source"), F.lit("tweet").alias("kind"),
        F.col("builder_idx").alias("idx"), F.col("idx").alias("part"),
        item_id("follow-builders", F.lit("tweet"), F.col("tweet_id"), F.col("handle")).alias("id"),
        X.post_title(who, F.col("visible")).alias("title"), "url", F.col("text").alias("summary"),
        F.col("builder_name").alias("source_name"), F.col("handle").alias("author_handle"),
        F.col("bio").alias("author_bio"), F.lit("ready").alias("status"),
        F.when(sig >= 3, "high").otherwise("medium").alias("confidence"),
        sig.cast("int").alias("signal_score"), F.col("created_at").alias("published_at"),
        "likes", "retweets", "replies", "is_quote",
        reason.alias("reason"),
        F.when(reason.isNotNull() & X.nonempty("url"), F.substring("visible", 1, 160)).alias("preview"),
        who.alias("builder"))


def transcript_summaries(lines: DataFrame, max_chars: int = 400, max_segments: int = 3) -> DataFrame:
    """fn_transcript_summary per episode without gathering whole transcripts:
    explode every transcript line, keep the first ``max_segments`` non-blank
    processed lines per episode (a partial group limit), join them; the
    transcript length comes from a sum over turns."""
    exploded = lines.select("conv_id", "turn", F.posexplode(F.split("turn_text", r"\R")).alias("pos", "line"))
    s = X.strip_ws(F.col("line"))
    dash = F.instr(s, "-")
    s = F.when(F.lower(s).startswith("speaker ") & (dash > 0),
               X.strip_ws(F.substring(s, dash + 1, 1 << 30))).otherwise(s)
    seg = exploded.select("conv_id", "turn", "pos", X.clean_text(s).alias("seg")).filter(F.col("seg") != "")
    w = Window.partitionBy("conv_id").orderBy("turn", "pos")
    first = seg.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_segments)
    summ = (first.groupBy("conv_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "seg"))), lambda x: x["seg"]),
                              " ").alias("_joined"))
            .select("conv_id", X.cut(F.col("_joined"), max_chars).alias("summary")))
    chars = lines.groupBy("conv_id").agg(
        (F.sum(F.char_length("turn_text")) + F.count(F.lit(1)) - 1).cast("long").alias("transcript_chars"))
    return chars.join(summ, "conv_id", "left").withColumn("summary", F.coalesce("summary", F.lit("")))


def normalize_podcasts(episodes: DataFrame, lines: DataFrame) -> DataFrame:
    """nrm_podcasts: title and url required; summary from the transcript;
    needs_review when the summary is empty."""
    t = transcript_summaries(lines)
    e = episodes.join(t, episodes.idx == t.conv_id, "left")
    title = X.clean_text("title")
    reason = F.when((title == "") | ~X.nonempty("url"), F.lit("missing_title_or_url"))
    summary = F.coalesce(F.col("summary"), F.lit(""))
    return e.select(
        "dt", F.lit("follow-builders").alias("source"), F.lit("podcast_episode").alias("kind"), "idx",
        item_id("follow-builders", F.lit("podcast"), F.col("guid"), title).alias("id"),
        title.alias("title"), "url", summary.alias("summary"), "published_at",
        X.clean_text("name").alias("source_name"),
        F.when(summary != "", "ready").otherwise("needs_review").alias("status"),
        F.lit("medium").alias("confidence"),
        F.coalesce(F.col("transcript_chars"), F.lit(0)).alias("transcript_chars"),
        reason.alias("reason"))


def normalize_blog_posts(blogs: DataFrame) -> DataFrame:
    """nrm_blog_posts: a blog's ``posts`` list, or the blog itself as one
    post; title and url (url or link) required; summary cut at 400 + …"""
    posts = F.when(F.col("posts").isNotNull(), F.col("posts")).otherwise(F.array(F.col("self_post")))
    b = blogs.select("dt", F.col("idx").alias("blog_idx"), "name", F.posexplode(posts).alias("part", "p"))
    title = X.clean_text(F.col("p.title"))
    url = X.first_nonempty(F.col("p.url"), F.col("p.link"))
    summary = X.clean_text(X.first_nonempty(F.col("p.summary"), F.col("p.description"), F.col("p.content")))
    summary = F.when(F.char_length(summary) > 400, F.concat(F.substring(summary, 1, 400), F.lit("…"))).otherwise(summary)
    reason = F.when((title == "") | url.isNull(), F.lit("missing_title_or_url"))
    return b.select(
        "dt", F.lit("follow-builders").alias("source"), F.lit("blog_post").alias("kind"),
        F.col("blog_idx").alias("idx"), "part",
        item_id("follow-builders", F.lit("blog"), title, url).alias("id"),
        title.alias("title"), url.alias("url"), summary.alias("summary"),
        F.col("p.published_at").alias("published_at"),
        X.clean_text(X.first_nonempty(F.col("p.blog_name"), F.col("name"))).alias("source_name"),
        F.lit("ready").alias("status"), F.lit("medium").alias("confidence"), reason.alias("reason"))


def normalize_rss_digest(items: DataFrame) -> DataFrame:
    """nrm_rss_digest: aggregated RSS items; title and link required."""
    title = X.clean_text("title")
    reason = F.when((title == "") | ~X.nonempty("link"), F.lit("missing_title_or_url"))
    return items.select(
        "dt", F.lit("ak-rss-digest").alias("source"), F.lit("rss_article").alias("kind"), "idx",
        item_id("ak-rss-digest", F.col("feed_name"), title, F.col("link")).alias("id"),
        title.alias("title"), F.col("link").alias("url"), X.clean_text("summary").alias("summary"),
        "published_at", "published_local", X.clean_text("feed_name").alias("source_name"),
        "site_url", "feed_url", F.lit("ready").alias("status"), F.lit("high").alias("confidence"),
        reason.alias("reason"))


def target_date_strict(raw: DataFrame, target_date, zone: str) -> DataFrame:
    """flt_target_date_strict: keep items whose timestamp falls on the target
    local date; drop reasons missing_published_at, invalid_published_at,
    outside_target_date, in that order."""
    ts = D.parse_api_datetime("published_at")
    reason = (F.when(~X.nonempty("published_at"), F.lit("missing_published_at"))
              .when(ts.isNull(), F.lit("invalid_published_at"))
              .when(D.local_date(ts, zone) != F.lit(target_date), F.lit("outside_target_date")))
    return raw.withColumn("reason", reason)


def normalize_hot_items(filtered: DataFrame) -> DataFrame:
    """nrm_hot_items over the date-filtered items: title and url required;
    source name default; confidence high iff selected. Rows the date filter
    dropped keep their reason (set_union_dropped)."""
    title = X.clean_text("title")
    own = F.when((title == "") | ~X.nonempty("url"), F.lit("missing_title_or_url"))
    reason = F.coalesce(F.col("reason"), own)
    selected = F.coalesce(F.col("selected"), F.lit(False))
    sn = X.clean_text("source_name")
    return filtered.select(
        "dt", F.lit("aihot").alias("source"), F.lit("aihot_item").alias("kind"), "idx",
        item_id("aihot", X.first_nonempty("id", "url"), title).alias("id"),
        title.alias("title"), X.clean_text("title_en").alias("title_en"), "url",
        X.clean_text("summary").alias("summary"), "published_at",
        F.when(sn != "", sn).otherwise(F.lit("AI HOT")).alias("source_name"), "category",
        F.col("score").cast("double").alias("score"), selected.alias("selected"),
        F.lit("ready").alias("status"), F.when(selected, "high").otherwise("medium").alias("confidence"),
        F.lit(True).alias("has_direct_url"), reason.alias("reason"))


def normalize_stats(all_rows: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """agg_normalize_stats: each source's own statistics (``NORMALIZE_STATS``; a
    field that a source's normaliser doesn't report is null), in one aggregation.
    ``errors``: (source, upstream_errors), one row for each source; 0 if it has none."""
    k = F.col("reason").isNull()
    kind, outcome = F.col("kind"), F.col("outcome")
    direct = F.coalesce(F.col("has_direct_url"), F.lit(False)) | (F.col("source") == "aihot")
    s = all_rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.count_if(k).alias("normalized_items"),
        F.count_if(~k).alias("dropped_items"),
        F.count_if(k & direct).alias("items_with_direct_url"),
        F.count_if(k & F.col("status").isin("needs_deep_read", "deferred_rate_limited", "summary_only")).alias("items_needing_followup"),
        F.count_if(outcome.isNotNull()).alias("deep_read_attempted"),
        F.count_if(outcome == "ok").alias("deep_read_completed"),
        F.count_if(outcome == "rate_limited").alias("deep_read_rate_limited"),
        F.count_if(k & (kind == "podcast_episode")).alias("podcast_items"),
        F.count_if(k & (kind == "tweet")).alias("tweet_items"),
        F.count_if(k & (kind == "blog_post")).alias("blog_items"),
        F.count_if(k & F.coalesce(F.col("selected"), F.lit(False))).alias("selected_items"),
    )
    if errors is None:
        s = s.withColumn("upstream_errors", F.lit(0).cast("long"))
    else:   # a union of the few rows: the sources are literals, which a join on them would turn into a nested loop
        both = s.unionByName(errors.select("source", F.col("upstream_errors").cast("long")), allowMissingColumns=True)
        s = (both.groupBy("source").agg(*[F.max(c).alias(c) for c in both.columns if c != "source"])
             .filter("candidate_count is not null").withColumn("upstream_errors", F.coalesce("upstream_errors", F.lit(0).cast("long"))))
    fields = dict.fromkeys(f for fs in K.NORMALIZE_STATS.values() for f in fs)
    return s.select("source", *[F.when(F.col("source").isin(*[x for x, fs in K.NORMALIZE_STATS.items() if f in fs]), F.col(f)).alias(f)
                                for f in fields])


def drop_reasons(all_rows: DataFrame) -> DataFrame:
    """agg_drop_reasons: dropped rows per (source, reason). The count is
    conditional and the filter applies to the aggregate, so the (costly)
    reason expression is evaluated once per row."""
    return (all_rows.groupBy("source", "reason")
            .agg(F.count_if(F.col("reason").isNotNull()).alias("dropped"))
            .filter(F.col("dropped") > 0))


def fingerprint(stats: DataFrame) -> DataFrame:
    """nrm_fingerprint: ``source|<stats JSON with sorted keys>|<item count>``; the
    JSON holds the source's own fields (null fields are left out)."""
    js = F.to_json(F.struct(*sorted(c for c in stats.columns if c != "source")))
    return stats.select("source", F.concat_ws("|", F.col("source"), js,
                                              F.col("normalized_items").cast("string")).alias("fingerprint"))
