"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import ann, search, topk


def table(spark, ids, vectors):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>, label int, rank int")


def best(ids, x, every, k, whole):
    rows = [(i, np.floor(64 * v) if whole else v) for i, v in zip(ids, x)]
    out = []
    for q, v in rows:
        if q % every == 0:
            scores = sorted((-float(np.einsum("i,i->", v, w)), i) for i, w in rows if i != q)[:k]
            out += [(q, r + 1, i, int(-s) if whole else -s) for r, (s, i) in enumerate(scores)]
    return out


@pytest.fixture
def vectors():
    r = np.random.default_rng(6)
    x = r.standard_normal((900, 16)).astype(np.float32)
    x[300:600] = x[300]  # a third of all rows is one vector
    return np.arange(900), x.astype(np.float64)


def test_exact_top(spark, vectors, monkeypatch):
    ids, x = vectors
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(search, "STRIPE", 2)
    got = topk.exact_top(table(spark, ids.tolist(), x.tolist()), 20, 20)
    assert sorted(map(tuple, got.collect())) == sorted(best(ids, x, 20, 20, True))


@pytest.mark.parametrize("scale", [False, True])
def test_nearest(spark, vectors, scale, monkeypatch):
    ids, x = vectors
    if not scale:
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(np.float64)
    monkeypatch.setattr(ann, "SHARD_ROWS", 200)
    got = [tuple(r) for r in ann.nearest(table(spark, ids.tolist(), x.tolist()), 20, 20).collect()]
    want = best(ids, x, 20, 20, False)
    assert len(got) == len(want)
    found = {(q, i): s for q, _, i, s in got}
    assert np.mean([(q, i) in found for q, _, i, _ in want]) > 0.9
    assert all(abs(found[q, i] - s) < 1e-12 for q, _, i, s in want if (q, i) in found)
    by = {}
    for q, r, i, s in sorted(got):
        assert q != i and (r == 1 or by[q, r - 1] <= (-s, i))
        by[q, r] = (-s, i)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 1.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [3.0]), (None, [9.0, 9.0]), (40, []), (-20, [0.5, 0.0])]
    t = table(spark, [i for i, _ in rows], [v for _, v in rows])
    got = [tuple(r) for r in topk.exact_top(t, 20, 3).collect()]
    assert sorted(got) == [(-20, 1, 8, 6144), (-20, 2, 1, 4096), (-20, 3, 2, 4096), (0, 1, 8, 12288), (0, 2, 1, 8192), (0, 3, 2, 8192), (20, 1, 8, 12288), (20, 2, 1, 8192), (20, 3, 2, 8192)]
    near = [tuple(r) for r in ann.nearest(t, 20, 9, tables=40, probed=1.0).collect()]
    assert {i for _, _, i, _ in near} == {0, 20, 1, 2, 8, -20} and [r[2] for r in sorted(near) if r[0] == 0] == [8, 1, 2, 20, -20]
    assert topk.exact_top(t.limit(0)).count() == 0 and ann.nearest(t.limit(0)).count() == 0
    assert topk.exact_top(t.filter("vec_id = 0")).count() == 0 and ann.nearest(t.filter(F.col("embedding").isNull())).count() == 0


def test_hadamard():
    x = np.eye(8)
    assert np.allclose(ann.hadamard(ann.hadamard(x)), x)
    y = ann.rotated(np.random.default_rng(0).standard_normal((5, 64)), 3)
    assert np.allclose(np.linalg.norm(y, axis=1), np.linalg.norm(np.random.default_rng(0).standard_normal((5, 64)), axis=1))


def test_ball_tree_bounds():
    r = np.random.default_rng(1)
    x = r.standard_normal((1000, 8))
    t = topk.ball_tree(np.arange(1000), x)
    assert sorted(t["ids"].tolist()) == list(range(1000))
    for (lo, hi), c, rad in zip(t["bounds"], t["centres"], t["radii"]):
        assert np.linalg.norm(t["x"][lo:hi] - c, axis=1).max() <= rad + 1e-9
