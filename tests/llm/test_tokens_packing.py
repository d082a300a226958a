import itertools
import random

import public_tokenizers
import pytest

from quillstream.llm import packing, tokens

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [(0, None), (1, ""), (2, "the the cat"), (2, "the the cat"), (None, "x"), (3, "a" * 30000), (4, "né 1\n\n 22")]


def test_lengths_equal_the_library(docs_of):
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    got = tokens.encoded_lengths(docs_of(TEXTS), *RANKS, keep=("doc_id",)).collect()
    want = [(i, len(tk.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_suffix_sums(spark):
    rng = random.Random(1)
    n = [rng.choice([0, 1, 5, 900, 1024, 1025, 5000]) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in n], "n_tokens long")
    sums = tokens.suffix_sums(tokens.length_histogram(df)).cache()
    for r in sums.collect():
        L = r.length
        assert (r.docs, r.tokens) == (n.count(L), L * n.count(L))
        assert r.docs_from == sum(x >= L for x in n) and r.tokens_from == sum(x for x in n if x >= L)
        assert r.docs_upto == sum(x <= L for x in n) and r.tokens_upto == sum(x for x in n if x <= L)
        assert r.truncated_tokens == sum(min(x, L) for x in n) and r.cut_docs == sum(x > L for x in n)
        assert r.quantile == pytest.approx(r.docs_upto / len(n))
    for limit in (0, 3, 1000, 10**6):
        assert tokens.truncated_total(sums, limit).first().truncated_tokens == sum(min(x, limit) for x in n)
    assert tokens.length_quantile(sums, 0.5).first()[0] == sorted(n)[149]


def test_empty_tables(spark, docs_of):
    none = docs_of([(1, "x")]).limit(0)
    sums = tokens.suffix_sums(tokens.length_histogram(tokens.encoded_lengths(none, *RANKS)))
    assert sums.collect() == [] and tokens.truncated_total(sums, 5).first().docs == 0
    assert packing.pack(none, *RANKS).collect() == []


def test_bounds_are_optimal():
    rng = random.Random(2)
    for _ in range(60):
        sizes = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        docs = [rng.randint(1, 30) for _ in sizes]
        k = rng.randint(1, 5)
        cost = lambda bs: sum(d * (min(b for b in bs if b >= s) - s) for s, d in zip(sizes, docs))
        got = packing.best_bounds(sizes, docs, k)
        assert len(got) <= k and got[-1] == sizes[-1]
        want = min(cost(c + (sizes[-1],)) for r in range(k) for c in itertools.combinations(sizes[:-1], r))
        assert cost(got) == want


def test_batches(docs_of):
    rng = random.Random(3)
    rows = TEXTS + [(i, "word " * rng.randint(1, 120)) for i in range(10, 400)]
    out = packing.pack(docs_of(rows), *RANKS, buckets=4, budget=500, group=50).toPandas()
    assert len(out) == len(rows) and (out.padding >= 0).all()
    for _, g in out.groupby("batch"):
        bound = g.bound.iloc[0]
        assert (g.bound == bound).all() and sorted(g.slot) == list(range(len(g)))
        assert len(g) * bound <= 500 or len(g) == 1
    big = out[out.n_tokens > 500]
    assert len(big) == 1 and (big.padding == 0).all()
    assert out[out.bucket < 4].bound.nunique() == 4
