"""The registered queries of the operators, and their DuckDB SQL.

Each query applies one operator with its production parameters to the whole
of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare, table
from . import conversations as op13
from . import decontaminate as op10
from . import id_files as op5
from . import katz as op6
from . import language as op7
from . import near_duplicates as op8
from . import neighbours as op1
from . import packing as op2
from . import shingle_join as op12
from . import spelling as op11
from . import suffix_dedup as op3
from . import tokens as op4
from . import toxicity as op9
from .common import stored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run
    return register


_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"coalesce(regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"


@query("op10_decontamination", sql=rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS n
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, i, n FROM dw SEMI JOIN bw USING (win, n)),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM dw JOIN bw USING (win, n)) GROUP BY 1),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN words USING (doc_id)""")
def decontamination(spark, sf_dir):
    """Words of documents inside a benchmark window of ten words."""
    return op10.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def ranks() -> tuple[str, str]:
    """The byte-level vocabulary as ranks, and its split pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op2_packing")
def packing(spark, sf_dir):
    """Batch of every document, with length buckets of the least padding."""
    return op2.pack(table(spark, sf_dir, "documents"), *ranks())


@query("op4_token_counts")
def token_counts(spark, sf_dir):
    """Totals, quantile and truncated totals at every encoded length."""
    lengths = op4.encoded_lengths(table(spark, sf_dir, "documents"), *ranks())
    return op4.suffix_sums(stored(op4.length_histogram(lengths), "histogram"))     # read twice


@query("op7_language_id")
def language_id(spark, sf_dir):
    """Language of every document; learned outside the held-out fold."""
    return op7.identify(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def toxicity(spark, sf_dir):
    """Severity of every document; learned from the label table."""
    docs = table(spark, sf_dir, "documents")
    model = op9.fit(docs, op9.label_grades(table(spark, sf_dir, "labels")))
    return op9.score(docs, model)


@query("op1_neighbours")
def neighbours(spark, sf_dir):
    """The 10 nearest vectors to each vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return op1.search(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


@query("op8_near_duplicates")
def near_duplicates(spark, sf_dir):
    """Near-duplicate class of every document (five-word shingles, 0.8)."""
    return op8.near_duplicate_classes(table(spark, sf_dir, "documents"))


@query("op3_suffix_dedup")
def suffix_dedup(spark, sf_dir):
    """Bytes of documents covered by repeated 400-byte strings."""
    return op3.deduplicate(table(spark, sf_dir, "documents"))


@query("op6_katz_backoff")
def katz_backoff(spark, sf_dir):
    """Katz backoff log probability of every document."""
    return op6.score(table(spark, sf_dir, "documents"))


@query("op5_id_files")
def id_file_round_trip(spark, sf_dir):
    """Place, length and checksum of every document's ids, read back from files."""
    import public_tokenizers

    return op5.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op13_conversation_repair")
def conversation_repair(spark, sf_dir):
    """Faults, cheapest repair and repaired text hash of every damaged conversation."""
    rows = table(spark, sf_dir, "conversations")
    return op13.report(rows, op13.damage(rows))


@query("op11_spelling_variants")
def spelling_variants(spark, sf_dir):
    """Near words, form and root of every word of the documents."""
    return op11.variants(table(spark, sf_dir, "documents"))


@query("op12_shingle_join")
def shingle_join(spark, sf_dir):
    """Component of every document under links of five-word shingle sets."""
    return op12.components(table(spark, sf_dir, "documents"))
