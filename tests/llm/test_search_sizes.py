"""Searches with their own parameters at several sizes, whole numbers beyond doubles, what is sent."""

import pickle

import numpy as np
import pytest

from sparkloom.llm import ann, search, topk
from sparkloom.llm.search import Best


def table(spark, ids, vectors, kind="float"):
    return spark.createDataFrame([(int(i), [float(y) for y in v]) for i, v in zip(ids, vectors)], f"vec_id long, embedding array<{kind}>")


def unit(r, n, d=64):
    x = r.standard_normal((n, d)).astype(np.float32)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def nearest_by_hand(x, every, k):
    out = {}
    y = x.astype(np.float64)
    for q in range(0, len(x), every):
        s = y @ y[q]
        s[q] = -np.inf
        out[q] = np.lexsort((np.arange(len(x)), -s))[: min(k, len(x) - 1)].tolist()
    return out


@pytest.mark.parametrize("n, least", [(12, 1.0), (25, 1.0), (10_000, 0.9)])
def test_defaults_find_nearly_all(spark, n, least):
    x = unit(np.random.default_rng(n), n)
    rows = ann.nearest(table(spark, range(n), x)).collect()
    want = nearest_by_hand(x, 20, 20)
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [r for r, _, _ in sorted(found)] == list(range(1, len(want[q]) + 1))
        assert all(abs(s - float(x[q].astype(np.float64) @ x[i].astype(np.float64))) < 1e-12 for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(want[q]))
    assert hits >= least * sum(map(len, want.values()))


def test_few_pairs_are_ranked_exactly():
    x = unit(np.random.default_rng(1), 8192).astype(np.float64)
    shard = ann._shard(1.0, True, ann.TABLES)(np.arange(8192), x)
    block = ann._block(True, ann.TABLES, ann.PROBED)(np.arange(0, 8192, 64), x[::64])
    q, _ = ann.candidates(block, shard, slice(0, 128), ann.RANKED, 21)
    assert len(q) < 0.1 * 128 * 8192


def test_what_is_sent_is_no_larger_than_its_vectors(spark):
    """Blocks and shards go to many tasks: the queries' weights are made there, and single precision stays single."""
    x = unit(np.random.default_rng(7), 1024).astype(np.float64)
    block, shard = ann._block(True, ann.TABLES, ann.PROBED)(np.arange(1024), x), ann._shard(1.0, True, ann.TABLES)(np.arange(1024), x)
    assert len(pickle.dumps(block)) < x.nbytes and len(pickle.dumps(shard)) < x.nbytes
    q, row = ann.candidates(block, shard, slice(64, 128), ann.RANKED, 21)
    assert block["weights"].shape == (ann.TABLES, 1024, 128) and q.min() == 64 and q.max() == 127
    assert ann.narrowed(np.array([[1 / 3, 1e300]])).dtype == np.float64 and ann.narrowed(np.array([[0.25, 3.0]])).dtype == np.float32


def test_near_copies_are_all_ranked():
    r = np.random.default_rng(2)
    x = unit(r, 4000).astype(np.float64)
    x[:1500] = x[0] + 0.02 * r.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    shard = ann._shard(1.0, True, ann.TABLES)(np.arange(4000), x)
    block = ann._block(True, ann.TABLES, ann.PROBED)(np.arange(4), x[:4])
    q, row = ann.candidates(block, shard, slice(0, 4), ann.RANKED, 21)
    assert all(set(range(1500)) <= set(row[q == k].tolist()) for k in range(4))


def test_whole_numbers_beyond_doubles(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 16)
    r = np.random.default_rng(3)
    x = np.floor(r.uniform(-1, 1, (90, 4)) * 6e6) + 1 / 64
    rows = topk.exact_top(table(spark, range(90), x, "double"), 30, 5).collect()
    z = [[int(np.floor(64 * y)) for y in v] for v in x]
    want = []
    for q in range(0, 90, 30):
        s = sorted((-sum(a * b for a, b in zip(z[q], z[i])), i) for i in range(90) if i != q)[:5]
        want += [(q, k, i, -v) for k, (v, i) in enumerate(s, 1)]
    assert max(abs(w[3]) for w in want) > 2**56 and sorted(map(tuple, rows)) == sorted(want)


def test_sums_beyond_a_long_are_an_error(spark):
    with pytest.raises(Exception, match="may pass 2\\^63"):
        topk.exact_top(table(spark, [0, 1], [[1e9, 0.0], [1e9, 1.0]], "double")).collect()


def test_only_shards_that_may_hold_a_better_row_are_sent(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 64)
    r, sent = np.random.default_rng(4), []
    centres = 40 * unit(r, 16, 8)
    x = np.repeat(centres, 120, axis=0) + r.standard_normal((1920, 8)).astype(np.float32) * 0.01
    ids = np.arange(1920) * 20 + 1
    ids[5] = 0  # one query, from the first cluster
    plain = search._routes
    monkeypatch.setattr(search, "_routes", lambda *a: sent.append((a[3], plain(*a))) or sent[-1][1])
    got = topk.exact_top(table(spark, ids, x), 20, 20).orderBy("rank").collect()
    z = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    order = sorted((-int(z[5] @ z[i]), int(ids[i])) for i in range(1920) if i != 5)[:20]
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, -s) for s, i in order]
    (n_shards, guessed), (_, rest) = sent
    assert guessed.count() == 2 and 0 < rest.count() < n_shards / 2


def test_coarse_cells_part_all_rows():
    x = np.random.default_rng(5).standard_normal((500, 6))
    cell = topk.cells_of(x, topk.coarse_tree(x, 16))
    assert len(np.unique(cell)) == 16 and np.bincount(cell).min() >= 500 // 16 - 1
    one = topk.cells_of(np.ones((9, 3)), topk.coarse_tree(np.ones((9, 3)), 4))
    assert len(one) == 9 and (one >= 0).all()


def test_best_keeps_whole_numbers():
    best = Best(1, 2, np.int64)
    best.take(np.array([0]), np.array([[2**60 + 1, 2**60, 2**60 + 1]]), np.array([9, 1, 4]))
    assert best.score.tolist() == [[2**60 + 1, 2**60 + 1]] and best.id.tolist() == [[4, 9]]
