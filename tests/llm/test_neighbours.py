import numpy as np
import pytest

from quillstream.llm import neighbours
from quillstream.session import table


def brute(ids, x, asks, k):
    out = {}
    for a in asks:
        q = x[list(ids).index(a)]
        d = np.sqrt(((x - q) ** 2).sum(1))
        order = sorted((d[i], ids[i]) for i in range(len(ids)) if ids[i] != a)[:k]
        out[a] = [(i, s) for s, i in order]
    return out


@pytest.mark.parametrize("sf,rows,per_block", [("sf0.01", 100, 2), ("sf0.1", 8192, 1024)])
def test_recall_and_scores(spark, sf, rows, per_block):
    t = table(spark, f"/root/testdata/{sf}", "embeddings")
    p = t.toPandas()
    x = np.stack(p.embedding.to_numpy()).astype(np.float64)
    want = brute(p.vec_id.tolist(), x, [i for i in p.vec_id if i % 25 == 0], 10)
    got = neighbours.search(t, t.filter("vec_id % 25 = 0"), 10, rows=rows, per_block=per_block).toPandas()
    hits = 0
    for a, g in got.sort_values("rank").groupby("query_id"):
        assert g["rank"].tolist() == list(range(1, 11))
        truth = dict(want[a])
        hits += len(set(g.vec_id) & set(truth))
        assert sorted(zip(g.score, g.vec_id)) == list(zip(g.score, g.vec_id))
        for i, s in zip(g.vec_id, g.score):
            if i in truth:
                assert s == pytest.approx(truth[i], rel=1e-12)
    assert len(got) == 10 * len(want) and hits >= 0.95 * len(got)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]),
            (6, [1.0, inf]), (7, [1.0, None]), (None, [1.0, 1.0]), (8, [3.0, 4.0]), (9, [1.0, 2.0, 3.0]), (100, [0.0, 2.0]), (100, [5.0, 5.0]), (200, [])]
    t = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, list string")
    got = neighbours.search(t, t.filter("vec_id % 100 = 0"), 10).toPandas().sort_values(["query_id", "rank"])
    assert set(got.query_id) == {0, 100}
    assert got[got.query_id == 0].vec_id.tolist() == [1, 2, 100, 8]
    assert got[got.query_id == 0].score.tolist()[:2] == [0.0, 0.0]
    assert got[got.query_id == 100].vec_id.tolist() == [0, 1, 2, 8]
    assert neighbours.search(t.limit(0), t.limit(0)).collect() == []
    assert neighbours.search(t, t.limit(0)).collect() == []


def test_an_id_repeated_more_than_k_times_counts_once(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 32)).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(300)] + [(299, (x[0] + 0.001 * j).tolist()) for j in range(1, 13)] + [(298, x[5].tolist())] * 150
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = neighbours.search(t, t.filter("vec_id in (0, 5, 100)"), 10, sample=200).toPandas()
    assert got.groupby("query_id").size().to_dict() == {0: 10, 5: 10, 100: 10}
    for a, g in got.sort_values("rank").groupby("query_id"):
        least = {}
        for i, v in rows:
            if i != a:
                least[i] = min(least.get(i, np.inf), float(np.sqrt(((np.array(v, np.float32).astype(np.float64) - x[a]) ** 2).sum())))
        best = sorted((s, i) for i, s in least.items())[:10]
        assert (g.vec_id.iloc[0], g["rank"].tolist()) == (best[0][1], list(range(1, 11)))
        assert len(set(g.vec_id) & {i for _, i in best}) >= 9


def test_abandoning_keeps_the_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5000, 64)) + 3 * rng.normal(size=(20, 64))[rng.integers(0, 20, 5000)]
    q, _ = np.linalg.qr(rng.normal(size=(64, 64)))
    cols = [(x @ q)[:, c:c + 16] for c in range(0, 64, 16)]
    ids, hits = np.arange(5000), 0
    for a in range(50):
        i, d = neighbours.adaptive_scan(x, cols, ids, x[a], x[a] @ q, a, np.inf, 10)
        truth = np.argsort(((x - x[a]) ** 2).sum(1), kind="stable")[1:11]
        hits += len(set(i) & set(truth))
    assert hits >= 490
