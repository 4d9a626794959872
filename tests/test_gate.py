"""The exact gate against a plain fold, however sessions are dealt."""

import random

import pytest

from sparkloom.operators import history


def plain(rows, budget, every):
    out, counts = [], {}
    for k, o, ok in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        n = counts.get(k, 0)
        what = "blocked" if n >= budget else "checkpoint" if not ok and n > 0 and n % every == 0 else "allowed"
        out.append((k, o, n, what))
        counts[k] = n + (what == "allowed")
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "keys", "budget", "every"), [(1, [1], 20, 5), (2, [1, 2, 3], 7, 2), (3, list(range(300)), 20, 5), (4, [None, 4], 50, 1), (5, [1] * 20 + list(range(2, 90)), 20, 3)])
def test_same_as_a_fold(spark, seed, keys, budget, every):
    r = random.Random(seed)
    rows = [(r.choice(keys), i, r.choice([True, False, False, None])) for i in range(700)]
    frame = spark.createDataFrame(rows, "part long, o long, ok boolean").repartition(5)
    got = history.gate_exact(frame, "part", "o", "ok", budget, every)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, budget, every)


def test_one_session_is_shared_out(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.range(4000).selectExpr("1 AS k", "id AS o", "id % 3 = 0 AS ok")
        got = history.gate_exact(frame, "k", "o", "ok", 1000, 5)
        sizes = got.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 2000
    assert history.gate_exact(frame.limit(0), "k", "o", "ok").count() == 0
