"""Feed source: landed RSS ``<item>`` XML -> entry rows with ``from_xml``.

A malformed item (a feed whose fetch or parse failed) becomes an error row
through the PERMISSIVE corrupt-record column; the other feeds continue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM_SCHEMA = ("title string, link string, summary string, description string, pubDate string, "
               "updated string, _corrupt_record string")


def parse_items(df: DataFrame, col: str = "xml") -> DataFrame:
    """src_rss_xml: title, link, summary (``summary`` else ``description``),
    published; ``error`` set for unparseable items."""
    p = F.from_xml(F.col(col), ITEM_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    out = df.withColumn("_p", p)
    summary = F.coalesce(F.nullif("_p.summary", F.lit("")), F.col("_p.description"), F.lit(""))
    bad = F.col("_p._corrupt_record").isNotNull()
    return out.select(
        *[c for c in df.columns if c != col],
        F.when(~bad, F.coalesce("_p.title", F.lit(""))).alias("title"),
        F.when(~bad, F.coalesce("_p.link", F.lit(""))).alias("link"),
        F.when(~bad, summary).alias("summary"),
        F.when(~bad, F.coalesce("_p.pubDate", F.lit(""))).alias("published"),
        F.when(bad, F.lit("unparseable feed item")).alias("error"))


def read_feed_files(spark, path: str) -> DataFrame:
    """src_rss_xml over landed feed files: the built-in XML source with
    ``rowTag=item``; unparseable items land in the corrupt-record column."""
    schema = "title string, link string, summary string, description string, pubDate string, _corrupt_record string"
    df = (spark.read.format("xml").option("rowTag", "item").option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").schema(schema).load(path))
    bad = F.col("_corrupt_record").isNotNull()
    summary = F.coalesce(F.nullif("summary", F.lit("")), F.col("description"), F.lit(""))
    return df.select(F.when(~bad, F.coalesce("title", F.lit(""))).alias("title"),
                     F.when(~bad, F.coalesce("link", F.lit(""))).alias("link"),
                     F.when(~bad, summary).alias("summary"),
                     F.when(~bad, F.coalesce("pubDate", F.lit(""))).alias("published"),
                     F.when(bad, F.lit("unparseable feed item")).alias("error"))
