"""Track scores, section placement, headline repeat rule, editorial noise
and publish-safety scan.

Section placement is per day: three ranks with caps, each over what the
previous section left (quotas are caps, not targets; overflow falls to the next
section). A section's winners are among the day's first rows in its own order,
as many as its cap and the caps before it allow. Those few rows are found by
``row_number() <= k`` filters, which Spark plans as group limits before the
shuffle; the cascade runs on them alone, so a day's items are never gathered
into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scoring as S
from ..functions import text as X


def with_track_scores(df: DataFrame, industry: list[str], personal: list[str]) -> DataFrame:
    """agg_track_score: industry and personal track = sum of five factors,
    each clipped to 0-2."""
    return df.withColumn("industry_score", S.track_score(*industry)).withColumn("personal_score", S.track_score(*personal))


def section_winners(df: DataFrame, day: str = "day") -> DataFrame:
    """(idx, section) of the items that get a section: industry (score >= 8,
    at most 4), then personal (>= 7, at most 5) among the rest, then watch (at
    most 15 by priority). ``idx`` is unique."""
    order = {"industry": [F.col("industry_score").desc(), F.col("priority").desc(), F.col("idx")],
             "personal": [F.col("personal_score").desc(), F.col("priority").desc(), F.col("idx")],
             "watch": [F.col("priority").desc(), F.col("idx")]}
    eligible = {"industry": F.col("industry_score") >= K.INDUSTRY_MIN, "personal": F.col("personal_score") >= K.PERSONAL_MIN,
                "watch": F.lit(True)}
    caps = {"industry": K.INDUSTRY_CAP, "personal": K.PERSONAL_CAP, "watch": K.WATCH_CAP}
    first, reach = None, 0
    for name in order:
        reach += caps[name]                 # earlier sections take at most the caps before this one
        rank = F.row_number().over(Window.partitionBy(day).orderBy(*order[name]))
        part = (df.filter(eligible[name]).select(F.col(day).alias("day"), "idx", "industry_score", "personal_score", "priority", rank.alias("rank"))
                .filter(F.col("rank") <= reach).select("day", "idx", F.lit(name).alias("section"), "rank"))
        first = part if first is None else first.unionByName(part)
    # at most as many rows a day as the reaches add to
    few = first.groupBy("day", "idx").agg(*[F.min(F.when(F.col("section") == name, F.col("rank"))).alias(name) for name in order])
    taken = F.lit(None).cast("string")
    for name in order:
        open_ = F.col("section").isNull() & F.col(name).isNotNull()
        few = few.withColumn("section", taken) if name == "industry" else few
        place = F.row_number().over(Window.partitionBy("day", open_).orderBy(name))
        few = few.withColumn("section", F.when(open_ & (place <= caps[name]), F.lit(name)).otherwise(F.col("section")))
    return few.filter("section is not null").select("idx", "section")


def place_sections(df: DataFrame, day: str = "day") -> DataFrame:
    """win_section_quota: every item with its ``section`` (null: none)."""
    return df.join(section_winners(df, day), "idx", "left")


def headline_repeat(today: DataFrame, history: DataFrame, day: str = "day",
                    lookback: int = K.HEADLINE_LOOKBACK_DAYS) -> DataFrame:
    """ddp_headline_3d: today's industry items whose key led the industry
    section in the previous ``lookback`` days and bring no new fact are
    demoted to watch (distinct (key, day) history rows: bounded fan-out)."""
    h = (history.filter(F.col("section") == "industry").select("event_key", F.col(day).alias("h_day")).distinct())
    t = today.select("idx", "event_key", F.col(day).alias("t_day"), "section", "has_new_fact")
    hit = (t.filter(F.col("section") == "industry").join(h, "event_key")
           .filter((F.col("h_day") >= F.date_sub("t_day", lookback)) & (F.col("h_day") < F.col("t_day")))
           .select("idx").distinct().withColumn("_repeat", F.lit(True)))
    out = t.join(hit, "idx", "left").withColumn("_repeat", F.coalesce("_repeat", F.lit(False)))
    demote = F.col("_repeat") & ~F.coalesce(F.col("has_new_fact"), F.lit(False))
    return out.withColumn("final_section", F.when(demote, F.lit("watch")).otherwise(F.col("section"))) \
        .withColumn("demoted", demote).drop("_repeat")


def editorial_noise(items: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """flt_noise_editorial: first matching reason among ads, hiring,
    subscription mail, link-less vague teaser, or a label saying low quality
    / toxic (labels are an optional input)."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    reason = None
    for name, pat in K.EDITORIAL_NOISE_PATTERNS:
        cond = text.rlike(pat)
        reason = F.when(cond, F.lit(name)) if reason is None else reason.when(cond, F.lit(name))
    teaser = ~X.nonempty("url") & (X.word_count("summary") < K.TEASER_MAX_WORDS)
    reason = reason.when(teaser, F.lit("vague_teaser"))
    df = items
    if labels is not None:
        df = df.join(labels.select(F.col("doc_id").alias("idx"), "quality", "toxic"), "idx", "left")
        reason = reason.when(F.col("toxic") == 1, F.lit("label_toxic")).when(F.col("quality") == 0, F.lit("label_low_quality"))
    return df.withColumn("noise_reason", reason)


def vendor_mentions(items: DataFrame, vendors: DataFrame) -> DataFrame:
    """(idx, vendor) of every item whose title or summary names a vendor: the
    name's words stand there one after another, whatever their case and the
    signs between them. Names without a letter or digit are none.

    A name is anchored on its first word: texts emit their distinct words, an
    equi-join with the anchors (before any shuffle while Spark finds the vendor
    table small enough to broadcast) leaves few candidates, and only their
    texts are searched for the whole name."""
    def plain(c):
        return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))

    v = vendors.select("vendor", plain(F.col("name")).alias("name")).filter("name <> ''").withColumn(
        "word", F.substring_index("name", " ", 1))
    t = items.select("idx", plain(F.concat_ws(" ", "title", "summary")).alias("plain"))
    words = t.select("idx", F.explode(F.array_distinct(F.split("plain", " "))).alias("word"))
    cand = words.join(v, "word").select("idx", "vendor", "name")
    space = F.lit(" ")
    return (cand.join(t, "idx").filter(F.instr(F.concat(space, "plain", space), F.concat(space, "name", space)) > 0)
            .select("idx", "vendor").distinct())


def uncovered_vendors(mentions: DataFrame, scored: DataFrame, chosen: DataFrame) -> DataFrame:
    """jn_vendor_coverage: vendors whose best item (priority, then least idx)
    isn't among the chosen ones: (vendor, idx)."""
    best = (mentions.join(scored.select("idx", "priority"), "idx").groupBy("vendor")
            .agg(F.max_by("idx", F.struct("priority", -F.col("idx"))).alias("idx")))
    return best.join(chosen.select("idx"), "idx", "left_anti").select("vendor", "idx")


def publish_safety(docs: DataFrame, patterns: DataFrame, fixed: tuple[str, ...] = (), anchor_words: int = 4,
                   anchor_chars: int = 8) -> DataFrame:
    """flt_publish_safety: one problem per (document, pattern) where the
    pattern occurs in the text. Empty patterns are none.

    Exact and without a cross join: a pattern's words after its first space
    start at a word boundary of any text containing it, so a pattern of more
    than ``anchor_words`` + 1 words is anchored on that window of words, and a
    shorter one on its first ``anchor_chars`` characters (all, if fewer). Texts
    emit the hashes of such windows, an equi-join gives candidates, and
    ``instr`` verifies them. The join comes before any shuffle of windows when
    the anchors are small enough for Spark to broadcast. ``fixed`` patterns are
    literal tests, numbered -1, -2, ..."""
    def pieces(words, i, n, sep):
        return F.xxhash64(F.lit(sep), F.array_join(F.slice(words, i, n), sep))

    def windows(units, n, sep):
        u = docs.select("doc_id", units.alias("_u"))
        count = F.size("_u") - n + 1
        return u.select("doc_id", F.explode(F.array_distinct(F.when(count >= 1, F.transform(
            F.sequence(F.lit(1), count), lambda i: pieces("_u", i, n, sep))))).alias("h"))

    p = patterns.filter("pattern <> ''").select("pattern_id", "pattern", F.split("pattern", r"\s").alias("_w"),
                                                F.char_length("pattern").alias("_n"))
    long = F.size("_w") > anchor_words + 1
    anchors = p.select("pattern_id", "pattern", F.when(long, pieces("_w", F.lit(2), F.lit(anchor_words), " ")).otherwise(
        F.xxhash64(F.lit(""), F.substring("pattern", 1, anchor_chars))).alias("h"))
    # at most anchor_chars different widths, whatever the number of patterns
    widths = sorted(r[0] for r in p.filter(~long).select(F.least("_n", F.lit(anchor_chars))).distinct().collect())
    found = windows(F.split("text", r"\s"), anchor_words, " ")
    for n in widths:
        found = found.unionByName(windows(F.slice(F.split("text", ""), F.lit(1), F.char_length("text")), n, ""))
    cand = found.join(anchors, "h").select("doc_id", "pattern_id", "pattern").distinct()
    hits = (cand.join(docs.select("doc_id", "text"), "doc_id")
            .filter(F.instr("text", F.col("pattern")) > 0).select("doc_id", "pattern_id"))
    if not fixed:
        return hits
    literal = F.array(*[F.when(F.instr("text", t) > 0, F.lit(-(i + 1)).cast("long")) for i, t in enumerate(fixed)])
    return hits.unionByName(docs.select("doc_id", F.explode(F.array_compact(literal)).alias("pattern_id")))


def output_quality(texts: DataFrame, days: DataFrame | None = None, text_col: str = "text", headings=K.REQUIRED_HEADINGS) -> DataFrame:
    """flt_output_quality: template residue ``{{...}}``, required headings (at
    the start of a line), and with ``days`` (dt, is_partial_run) whether the
    text's day (``dt``) is only half done; a day without a run is half done."""
    t = F.col(text_col)
    missing = F.array_compact(F.array(*[F.when(~t.rlike(f"(?m)^{h}"), F.lit(h.strip())) for h in headings]))
    out = texts.withColumn("has_residue", F.coalesce(t.rlike(r"\{\{.*?\}\}"), F.lit(False))) \
        .withColumn("missing_headings", F.array_join(missing, ","))
    if days is None:
        return out
    half = days.select("dt", F.col("is_partial_run").alias("_half"))
    out = out.join(half, "dt", "left").withColumn("day_partial", F.coalesce("_half", F.lit(True))).drop("_half")
    return out.withColumn("publishable", ~F.col("has_residue") & (F.col("missing_headings") == "") & ~F.col("day_partial"))
