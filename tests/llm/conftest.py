import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("n_chars", T.LongType())])


@pytest.fixture()
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang) tuples, with an extra column
    whose name clashes with the operators' own."""
    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOC).repartition(parts)
        return df.selectExpr("*", "1 as row", "'x' as batch", "2 as bucket", "3 as length", "4 as n_tokens", "5 as score")
    return make
