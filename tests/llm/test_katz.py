import math
import re
import zlib
from collections import Counter

import pytest

from quillstream.llm import katz
from quillstream.session import table


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]


def brute(rows, order=3):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    texts = [tokens(t) for _, t in rows]
    train = [x for x, h in zip(texts, held) if not h]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    starts = ["<s>"] * (order - 1)
    grams = {k: Counter(tuple(x[i:i + k]) for t in train for x in [(starts + t)[order - k:]] for i in range(len(t))) for k in range(2, order + 1)}
    d = {k: katz.discounts(Counter(g.values())) for k, g in grams.items()}
    after = {}
    for g in grams.values():
        for x, m in g.items():
            after.setdefault(x[:-1], {})[x[-1]] = m
    base = lambda w: (c[w] + 1) / (n + v + 1)
    cache = {}

    def weights(h):
        if h not in cache:
            f, dk = after[h], d[len(h) + 1]
            total = sum(f.values())
            scale = 1 if any(m <= 5 and dk[m - 1] < 1 for m in f.values()) else 1 - 0.5 / total
            star = {w: scale * (dk[m - 1] if m <= 5 else 1) * m / total for w, m in f.items()}
            cache[h] = star, (1 - sum(star.values())) / (1 - sum(p(h[1:], w) for w in f))
        return cache[h]

    def p(h, y):
        if not h:
            return base(y)
        if h not in after:
            return p(h[1:], y)
        star, alpha = weights(h)
        return star[y] if y in star else alpha * p(h[1:], y)

    for h in sorted(after, key=str)[:60] + [("unseen",) * (order - 1)]:          # exactly normalised, the unknown class included
        assert sum(p(h, w) for w in c) + p(h, "never seen") == pytest.approx(1)
    out = []
    for (i, _), t, h in zip(rows, texts, held):
        out.append((i, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(base(w)) for w in t),
                    sum(math.log10(p(tuple((starts + t)[i:i + order - 1]), y)) for i, y in enumerate(t))))
    return out


def same(got, rows, order=3):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, want = sorted(map(tuple, got), key=key), sorted(brute(rows, order), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


ROWS = [(i, t) for i, t in enumerate(["the cat sat", "The Cat sat on the mat", "", None, "a a a a a a a a b a", "the dog x \x0b sat", "x " * 3000,
                                      "on the mat the cat", "the cat sat on", "new words here"] * 3)] + [(None, "the cat"), (5, "the cat"), (5, "the cat")]


@pytest.mark.parametrize("block,bucket,vocab,order", [(10**6, 10**6, 10**6, 3), (50, 400, 1, 3), (400, 400, 1, 2), (400, 400, 30, 4)])
def test_equals_plain_katz(docs_of, monkeypatch, block, bucket, vocab, order):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", bucket)
    monkeypatch.setattr(katz, "VOCAB_BUCKET", vocab)
    same(katz.score(docs_of(ROWS), order=order).collect(), ROWS, order)


def test_whole_table(spark, monkeypatch):
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 5000)
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    same(katz.score(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_empty(docs_of):
    assert katz.score(docs_of(ROWS).limit(0)).collect() == []
    one = katz.score(docs_of([(2, "a b")]).filter("true")).collect()
    assert len(one) == 1


def test_packing_round_trip():
    import numpy as np
    for a in ([], [0], [1, 2**40, 3, 2**63], list(range(1000))):
        a = np.array(a, np.uint64)
        assert (katz.unpack(katz.pack(a)) == a).all()


def test_order_is_lexsorts(monkeypatch):
    import numpy as np
    rng = np.random.default_rng(0)
    for n, tops in ((0, (5,)), (1, (9, 9)), (5000, (3, 70)), (5000, (2**40, 2**30, 2**20, 5)), (5000, (2**40, 2**40)), (5000, (40, 2**26, 40, 40))):
        keys = [rng.integers(0, t, n).astype(np.uint64) for t in tops]
        for k in keys:
            k[rng.random(n) < 0.1] = min(katz.START, k.max(initial=katz.START))
        assert (katz._order(keys) == np.lexsort(keys)).all()
    keys = [rng.integers(0, 40, 800_000).astype(np.uint64) + np.uint64(2**24) for _ in range(3)]
    want, stable, sort = np.lexsort(keys), [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, kind=None: (stable.append(kind), sort(x, kind=kind))[1])
    monkeypatch.setattr(np, "lexsort", lambda *_: pytest.fail("stable sorts of each key"))
    assert (katz._order(keys) == want).all() and set(stable) == {None} and len(stable) <= 3
