"""Training corpus pipeline over the documents table.

Each stage calls one operator of ``quillstream.llm`` on all documents that the
stage before it kept, and its decisions take effect: toxic documents go, one
document of each near-duplicate group stays, repeated 400-byte strings are cut
out of the texts, documents that hold a benchmark passage go, and the rest is
packed. Every stage's result is written to shared storage and read again.

Null and empty texts pass through to packing as sequences of length 1; rows
without an id are never duplicates; extra columns stay with their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import decontaminate, near_duplicates, packing, suffix_dedup, toxicity
from quillstream.llm.common import stored
from quillstream.llm.queries import ranks
from quillstream.session import prepare, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the model's cut; the model learns from the label table."""
    model = toxicity.fit(docs, toxicity.label_grades(table(spark, sf_dir, "labels")))
    rows = docs.select("text", F.struct("*").alias("_row"))
    return toxicity.score(rows, model, keep=("_row",)).filter("not toxic").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated 400-byte strings."""
    kept = suffix_dedup.without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item."""
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")         # whether a document goes depends on its text alone
    found = decontaminate.decontaminate(texts, table(spark, sf_dir, "benchmark"))
    hit = found.filter("contaminated").select(F.col("doc_id").alias("_hash")).distinct()
    return docs.withColumn("_hash", F.xxhash64("text")).join(hit, "_hash", "left_anti").drop("_hash")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batch of every remaining document."""
    return packing.pack(docs, *ranks())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# tokenization and the fitted toxicity model have no SQL form; tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
