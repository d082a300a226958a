import random
import re
from collections import Counter

import numpy as np
import pytest

from quillstream.llm import near_duplicates as nd
from quillstream.operators.dedup import connected_components
from quillstream.session import table


def bag(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return None
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def jaccard(a, b):
    low = sum((a & b).values())
    return low / (sum(a.values()) + sum(b.values()) - low)


def brute(rows, similarity=0.8):
    """Least id of each id's component by comparing all pairs that share a shingle."""
    bags = {i: bag(t) for i, t in rows}
    group = {i: i for i in bags}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    holders = {}
    for i, b in bags.items():
        for s in b or ():
            holders.setdefault(s, []).append(i)
    for a, b in {(min(x, y), max(x, y)) for h in holders.values() for x in h for y in h if x != y}:
        if jaccard(bags[a], bags[b]) >= similarity:
            x, y = root(a), root(b)
            group[max(x, y)] = min(x, y)
    return {i: root(i) if bags[i] else None for i in bags}


def test_equals_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: r.class_id for r in nd.near_duplicate_classes(docs).collect()}
    assert got == want and len(set(want.values())) < 990


def test_chain_and_star_groups(docs_of):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 500)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):                  # copies with edits of their own: not all similar to each other
        w = list(base)
        for _ in range(5):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    w = [f"c{i}" for i in range(200)]
    for i in range(100, 140):               # a chain, each similar to the next
        rows.append((i, " ".join(w)))
        w = w[4:] + [f"d{i}{k}" for k in range(4)]
    rows += [(i, f"alone {i} " * 30) for i in range(200, 220)] + [(300, "a b a b " * 200), (301, "a b a b " * 190), (302, "a b a b " * 100)]
    got = {r.doc_id: r.class_id for r in nd.near_duplicate_classes(docs_of(rows)).collect()}
    want = brute(rows)
    assert got == want
    assert want[301] == 300 and want[302] == 302


def test_estimate_is_unbiased():
    rng = np.random.default_rng(0)
    est, true = [], []
    for _ in range(30):
        n = 60
        h = rng.integers(1, 2**63, n).astype(np.uint64)
        a, b = rng.integers(0, 9, n), rng.integers(0, 9, n)
        true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
        sig = [nd.bag_minhash(np.zeros((c > 0).sum(), np.int64), h[c > 0], c[c > 0], 1, 1024)[0] for c in (a, b)]
        est.append((sig[0] == sig[1]).mean())
    est, true = np.array(est), np.array(true)
    assert abs((est - true).mean()) < 0.006 and np.abs(est - true).max() < 0.08


def test_cases(docs_of):
    rows = [(None, "one two three four five six"), (1, "one two three four five six"), (1, "one two three four five six"), (1, "other text here"),
            (2, "ONE two, three four five SIX"), (3, None), (4, ""), (5, " .,; "), (6, "x " * 50000), (7, "x " * 49000), (8, "other text here"), (9, "short")]
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in nd.near_duplicate_classes(docs_of(rows)).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (1, 1), (2, 1), (3, 0), (4, 0), (5, 0), (6, 6), (7, 6), (8, 1), (9, 9)]
    assert nd.near_duplicate_classes(docs_of(rows).limit(0)).collect() == []


@pytest.mark.parametrize("n", [61, 1000])
def test_components_of_a_path(spark, n):
    v = spark.range(n).selectExpr("id")
    e = spark.range(n - 1).selectExpr("id as src", "id + 1 as dst")
    out = connected_components(v, e).collect()
    assert len(out) == n and {r.component for r in out} == {0}
