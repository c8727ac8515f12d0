import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import neighbours as N


def brute(rows, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float32).astype(float)
    out = []
    for i, q in enumerate(ids.tolist()):
        if q % 20 == 0:
            score = (x * x[i]).sum(axis=1)
            score[ids == q] = -np.inf
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
            out += [(q, r + 1, int(ids[j]), float(score[j])) for r, j in enumerate(order)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(int(i), None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<float>")


def test_all_leaves_give_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "QUERY_BLOCK", 2)
    monkeypatch.setattr(N, "LEAF", 10)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).round(2) * rng.uniform(0.2, 3, size=(300, 1)).round(1)
    x[100:180] = x[100]  # one very common vector
    rows = list(enumerate(x.tolist()))
    out = N.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, k=7, recall=1.0)
    got = sorted(tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect())
    want = brute(rows, 7)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    rows = list(enumerate(x.tolist()))
    got = {(r.query_id, r.vec_id) for r in N.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()}
    want = {(q, v) for q, _, v, _ in brute(rows, 20)}
    assert len(got) == len(want) and len(got & want) >= 0.93 * len(want)


def test_few_candidates_in_near_leaves(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 16)
    rng = np.random.default_rng(7)
    large, small = 5 + rng.normal(size=(20, 6)), -5 + 0.1 * rng.normal(size=(20, 6))
    x = np.concatenate([np.repeat(large, 100, axis=0), np.repeat(small, 5, axis=0)])
    x[::20] = x[::20].round(3)
    rows = list(enumerate(x.tolist()))
    counts = {r.query_id: r["count"] for r in N.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, recall=0.5).groupBy("query_id").count().collect()}
    assert len(counts) == 105 and set(counts.values()) == {20}


@pytest.mark.parametrize("recall", [0.9, 1.0])
def test_grafted_trees(spark, monkeypatch, recall):
    monkeypatch.setattr(N, "GRAFT", 60)
    monkeypatch.setattr(N, "LEAF", 10)
    monkeypatch.setattr(N, "BIN", 32)
    monkeypatch.setattr(N, "BLOCK", 32)
    x = np.random.default_rng(3).normal(size=(1500, 4))
    rows = list(enumerate(x.tolist()))
    got = sorted(tuple(r)[:3] for r in N.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, k=5, recall=recall, sample=60).collect())
    want = [w[:3] for w in brute(rows, 5)]
    assert len({(q, v) for q, _, v in got} & {(q, v) for q, _, v in want}) >= (recall - 0.03) * len(want) and len(got) == len(want)
    tree = N.Tree(x[:60])
    whole = tree.grafted({k: N.Tree(x[60 + 50 * k : 110 + 50 * k], k) for k in (0, 2)})
    assert sorted(whole.leaf.values()) == list(range(len(whole.leaf))) and len(whole.leaf) > len(tree.leaf)
    assert set(whole.file(x).tolist()) <= set(whole.leaf.values())


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_vectors(spark, n):
    rows = [(20 * i, [1.0, float(i)]) for i in range(n)]
    assert N.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0).count() == n * (n - 1)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (0, [3, 0]), (0, [1, 0]), (1, [2, 1]), (1, [2, 1]), (2, None), (3, []), (4, [0, 0]), (5, [nan, 1]), (6, [inf, 1]), (7, [None, 1]), (8, [1, 2, 3]), (20, [1, 1]), (40, [0, 0]), (9, [-1, -1])]
    got = sorted(tuple(r) for r in N.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0).collect())
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 20), (0, 3, 9), (20, 1, 1), (20, 2, 0), (20, 3, 9)]
