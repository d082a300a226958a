import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import types as T

from quillstream.llm import decontaminate as D

ITEM = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
FOLD = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def windows(items, size=10):
    out = {}
    for i, text in items:
        w = words(text)
        if i is not None and w:
            for k in range(max(1, len(w) - size + 1)):
                out.setdefault(tuple(w[k:k + size]), set()).add(str(i))
    return out


def brute(docs, items):
    wins, out = windows(items), []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for win, ids in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def near(docs, items, distance, counts):
    out = set()
    for d, text in docs:
        w = words(text)
        for win, ids in windows(items).items():
            rare = min(win, key=lambda t: counts.get(t, 0))
            for p, x in enumerate(w):
                if x == rare and all(t in w[max(0, p - distance):p + distance + 1] for t in win):
                    out |= {(d, i, p) for i in ids}
    return out


DOCS = [(None, None), (1, ""), (2, "... !!"), (3, "One two three four five six seven eight nine ten eleven twelve"),
        (4, "zero ONE-two.three four five six seven eight nine ten eleven"), (4, "short item"), (5, "a short item, and another Short ITEM"),
        (6, "été naïve 42 x"), (7, "word " * 60000 + "one two three four five six seven eight nine ten"), (8, "ten nine eight seven six five four three two one"),
        (9, "item short"), (None, "short item")]
ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (1, "one two three four five six seven eight nine ten eleven"),
         (10, "Short item!"), (2, "short ITEM"), (3, None), (4, "?!"), (None, "été"), (5, "Été naïve"), (6, "two three four five six seven eight nine ten eleven twelve")]


@pytest.mark.parametrize("block", [D.BLOCK_WINDOWS, 2, 1])
def test_phrases_against_brute_force(spark, docs_of, block):
    items = spark.createDataFrame(ITEMS, ITEM).selectExpr("*", "1 as key", "'x' as terms", "2 as row")
    got = sorted((tuple(r) for r in D.decontaminate(docs_of(DOCS), items, block_windows=block).collect()), key=str)
    assert got == brute(DOCS, ITEMS)


def test_proximity_against_brute_force(spark, docs_of):
    docs = [x for x in DOCS if x[0] != 7] + [(20, "beta x x gamma alpha beta beta"), (21, "delta " + "x " * 9 + "beta beta"), (22, "beta"),
                                             (23, "alpha"), (24, "ten ten ten ten"), (25, "nine one x ten")]
    counts = Counter(w for _, t in docs for w in words(t))
    unique = [(1, "alpha beta gamma"), (2, "delta beta"), (3, "one ten")]       # each with one rarest term
    for distance in (1, 3, 9, 10):
        got = [tuple(r) for r in D.proximity_matches(docs_of(docs), spark.createDataFrame(unique, ITEM), distance, block_windows=2).collect()]
        assert len(got) == len(set(got)) and set(got) == near(docs, unique, distance, counts)


def test_empty_tables(spark, docs_of):
    items = spark.createDataFrame(ITEMS, ITEM)
    assert D.decontaminate(docs_of([]), items).collect() == []
    got = sorted((tuple(r) for r in D.decontaminate(docs_of(DOCS), items.limit(0)).collect()), key=str)
    assert got == brute(DOCS, [])
