import math
import random
import zlib

import numpy as np
import pytest

from quillstream.llm import language, toxicity
from quillstream.session import table

ODD = [(None, "le chat"), (1, None), (2, ""), (3, "123 !"), (3, "123 !"), (4, "x" * 300000)]


def ppm(text: bytes, train: list[bytes]) -> float:
    """Code length by plain recursion over the training texts' contexts."""
    def counts(ctx):
        out = [0] * 256
        for t in train:
            p = b"\n\n\n" + t
            for i in range(3, len(p)):
                if p[i - len(ctx):i] == ctx:
                    out[p[i]] += 1
        return out

    def probs(ctx):
        parent = [1 / 256] * 256 if not ctx else probs(ctx[1:])
        if ctx == b"":
            parent = [1 / 256] * 256
        c = counts(ctx)
        n, d = sum(c), sum(x > 0 for x in c)
        if not n:
            return parent
        left = sum(p for p, x in zip(parent, c) if not x)
        return [x / (n + d) if x else d / (n + d) * p / left for p, x in zip(parent, c)]

    p = b"\n\n\n" + text
    return -sum(math.log2(probs(p[i - 3:i])[p[i]]) for i in range(3, len(p)))


def test_code_lengths_equal_plain_recursion(docs_of):
    train = {"aa": ["abab abac", "ba"], "bb": ["né née", "abé"]}
    rows = [(i, t, k) for k, v in train.items() for i, t in enumerate(v)]
    m = language.fit(docs_of(rows))
    assert m.langs == ["aa", "bb"]
    texts = ["abac né", "zz", "b", ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = language.code_lengths(m, data, offs)
    for i, t in enumerate(texts):
        for j, k in enumerate(m.langs):
            assert got[i, j] == pytest.approx(ppm(t.encode(), [x.encode() for x in train[k]]), rel=1e-5)


def test_language_cases(docs_of):
    out = {(r.doc_id, r.lang_pred, r.score) for r in language.identify(docs_of(ODD + [(9, "le la les"), (10, "the of")])).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)} <= out and len(out) >= 6
    none = language.identify(docs_of(ODD).filter("false"))
    assert none.collect() == []
    untaught = language.identify(docs_of([(1, "le chat")]).withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string")))
    assert [tuple(r)[2:4] for r in untaught.collect()] == [("und", 0.0)]


def test_language_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(out) == 1000
    want = out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)
    assert (out.held_out == want).all()
    h = out[out.held_out]
    assert (h.lang == h.lang_pred).mean() > 0.97


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    z = x @ np.array([2.0, -1.0, 0.0])
    y = (z + rng.logistic(size=3000) > -1).astype(int) + (z + rng.logistic(size=3000) > 9).astype(int)
    w, theta = toxicity.fit_ordinal(x, y, np.ones(3000), 3, ridge=1e-6)
    assert theta[0] < theta[1] and w[0] == pytest.approx(2, abs=0.3) and w[1] == pytest.approx(-1, abs=0.3)


def test_toxicity_cases(docs_of, spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(99, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    m = toxicity.fit(docs_of(ODD), toxicity.label_grades(labels))
    out = toxicity.score(docs_of(ODD), m).collect()
    assert len(out) == len(ODD) and not any(r.toxic for r in out)
    clean = toxicity.fit(docs_of(ODD), toxicity.label_grades(labels.filter("toxic = 0")))
    assert {(r.grade, r.severity) for r in toxicity.score(docs_of(ODD), clean).collect()} == {(0, 0.0)}
    assert toxicity.score(docs_of(ODD).limit(0), m).collect() == []


def test_toxicity_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    m = toxicity.fit(docs, toxicity.label_grades(labels.filter("doc_id % 2 = 0")))
    out = toxicity.score(docs, m).join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    out.columns = ["doc_id", "grade", "severity", "p", "said", "quality", "label"]
    clean, bad = out[out.label == 0], out[out.label == 1]
    assert bad.said.mean() > 0.9
    assert clean.said.mean() < 0.005
