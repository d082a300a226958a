import random

import numpy as np
import pytest

from quillstream.llm import shingle_join as J
from quillstream.llm.queries import QUERIES
from quillstream.session import table

SF = "/root/testdata/sf0.001"
FOLD = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = [x for x in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").translate(FOLD).split(" ") if x]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        both = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    both[j] = both.get(j, 0) + 1
        for j, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(doc, low.get(find(i), doc))
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def shown(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_whole_table_against_brute_force(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    want = brute(rows)
    assert shown(QUERIES["op12_shingle_join"](spark, "/root/testdata/sf0.01")) == want
    assert sum(c != d for d, _, c in want) > 20


def _texts(rng, near, words=60):
    """Copies with a few changed words of one text, and texts that share a passage."""
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    base, passage = [word() for _ in range(words)], [word() for _ in range(words // 2)]
    out = []
    for i in range(near):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(words)] = word()
        out.append(" ".join(t))
        out.append(" ".join([word() for _ in range(words // 2)] + passage))
    return out


@pytest.mark.parametrize("options", [{}, {"star": False, "block": 40}, {"block": 20, "most_hot": 5, "filter_bytes": 64, "zone": 1 << 61}])
def test_groups_at_the_threshold(spark, docs_of, options):
    """Chains of near copies around 0.8, in lists of several blocks, with tiny filters, few hot shingles and a small zone."""
    rows = list(enumerate(_texts(random.Random(3), 120)))
    want = brute(rows)
    assert len({c for *_, c in want}) > 125
    assert shown(J.components(docs_of(rows), **options)) == want


def test_odd_rows(spark, docs_of):
    rows = [(None, None), (1, ""), (1, " \t"), (None, "one two three four five six"), (7, "one two three four five six"), (7, "ONE two\nthree four five six"),
            (3, "one two"), (4, "one  two"), (5, "two one"), (None, "only null"), (8, "word " * 90000), (9, "Word " * 5), (None, "one two"),
            (10, " ".join(map(str, range(40000)))), (11, " ".join(map(str, range(39000)))), (7, "other text of the same id entirely")]
    assert shown(J.components(docs_of(rows))) == brute(rows)
    assert J.components(docs_of([])).collect() == []


def test_tree_keeps_every_pair_that_the_bound_allows():
    rng = np.random.default_rng(5)
    base = rng.poisson(4, (12, J.GROUPS))
    points = np.minimum(np.maximum(base[rng.integers(0, 12, 900)] + rng.integers(-1, 2, (900, J.GROUPS)), 0), 255).astype(np.uint8)
    n = points.sum(1).astype(np.int64) + rng.integers(0, 2, 900) * 40
    q, row = J.Tree(points, n).search(points[:200], n[:200])
    over = n - points.sum(1)
    bound = np.minimum(points[:200, None, :], points[None]).sum(2) + np.minimum(over[:200, None], over[None])
    ok = (9 * bound >= 4 * (n[:200, None] + n[None])) & (np.minimum(n[:200, None], n[None]) * 10 >= 8 * np.maximum(n[:200, None], n[None]))
    assert set(zip(q.tolist(), row.tolist())) == set(zip(*np.nonzero(ok)))
    assert 0 < len(q) < 0.3 * 200 * 900


def test_sketch_bounds_the_overlap_closely():
    rng = np.random.default_rng(7)
    sets = []
    for size in (0, 1, 30, 150, 240, 256, 260, 500, 900, 20000):
        base = rng.integers(0, 1 << 63, size).astype(np.uint64)
        for share in (1, 0.9, 0.6):
            new = rng.random(size) > share
            sets.append(np.unique(np.where(new, rng.integers(0, 1 << 63, size).astype(np.uint64), base)))
    n = np.array([len(x) for x in sets])
    sketches = J.Sketches(J.sketches_of(np.concatenate(sets), np.repeat(np.arange(len(n)), n), n), n)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(n)), np.arange(len(n))))
    near = np.abs(sketches.level[a] - sketches.level[b]) <= 1
    a, b = a[near], b[near]
    true = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)])
    bound = sketches.bound(a, sketches, b)
    assert (bound >= true).all() and (bound <= np.minimum(n[a], n[b])).all()
    own = (a // 3 == b // 3) & (n[a] < 5000) & (true >= 0.75 * n[a])
    assert (bound[own] - true[own] <= 0.06 * n[a][own] + 2).all()


def test_a_groups_links_are_not_listed_as_pairs(spark, docs_of, monkeypatch):
    """Members that only their neighbours link: pairs left for the rounds don't follow the square of the group."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base, far = [word() for _ in range(200)], [word() for _ in range(30)]
    rows = []
    for i in range(240):
        t = base[:170] + far if i % 2 else list(base)
        t[rng.randrange(160)] = word()
        rows.append((i, " ".join(t)))
    made, stored = {}, J.stored

    def counted(df, name):
        out = stored(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(J, "stored", counted)
    assert shown(J.components(docs_of(rows), star=False)) == brute(rows)
    assert max(made["open"]) < 6 * len(rows) and max(made["picks"]) < 6 * len(rows), made
