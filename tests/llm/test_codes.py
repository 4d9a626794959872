"""Codes against plain k-means in whole numbers, and annuli against all entries."""

import math

import numpy as np
import pytest

from sparkloom.llm import codes
from sparkloom.llm.queries import op11_annular_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error double, part int, entry int, v int, evaluated string"


def plain_codes(rows, parts, entries, rounds, scale):
    """[(vec_id, label, code, error)] and codebooks, by loops over everything."""
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    ids = sorted({i for i, _, _ in kept}, key=lambda i: (i is None, i or 0))
    first = [min(v for j, _, v in kept if j == i) for i in ids]
    width = len(first[0]) // parts if first else 0
    kept = [r for r in kept if width and len(r[2]) == parts * width and len(first[0]) % parts == 0]
    books = [[v[k * width : (k + 1) * width] for v in first[:entries]] for k in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            own = {}
            for _, _, v in kept:
                part = v[k * width : (k + 1) * width]
                own.setdefault(near(part, books[k])[1], []).append(part)
            for e, group in own.items():
                books[k][e] = [sum(c) // len(group) for c in zip(*group)]
    out = []
    for i, label, v in kept:
        found = [near(v[k * width : (k + 1) * width], books[k]) for k in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, books


def some_rows(random, n, width=8):
    rows = [(i, [random.gauss(0, 1) for _ in range(width)], random.choice([0, 1, None])) for i in range(n)]
    rows += [(i, [1.0] * width, 7) for i in range(500, 530)]  # a hot group of copies
    rows += [(600, None, 1), (601, [], 1), (602, [0.0, None] + [1.0] * (width - 2), 1), (603, [float("nan")] * width, 1), (604, [float("inf")] * width, 1)]
    rows += [(None, [0.25] * width, None), (None, [0.5] * width, 2), (3, [9.0] * width, 2), (4, rows[4][1], rows[4][2]), (605, [1.0] * (width - 1), 1), (606, [0.0] * width, 3)]
    return rows


def test_same_as_plain(spark):
    import random

    rows = some_rows(random.Random(5), 120)
    frame = spark.createDataFrame([(*r, "x", 0.5, 1, 2, 3, "y") for r in rows], SCHEMA).repartition(5)
    coded, books = codes.compress(frame, parts=4, entries=6, rounds=3, scale=64)
    want, want_books = plain_codes(rows, 4, 6, 3, 64)
    by_label = {}
    for _, label, _, error in want:
        by_label[label] = by_label.get(label, 0) + error
    got = [(r["vec_id"], r["label"], r["code"], r["error"], r["label_error"]) for r in coded.collect()]
    assert sorted(got, key=repr) == sorted([(*r, by_label[r[1]]) for r in want], key=repr)
    assert books.tolist() == want_books
    vectors = {r["vec_id"]: r["v"] for r in coded.filter("vec_id = 7").select("vec_id", codes.decoded(coded["code"], books).alias("v")).collect()}
    code = next(r[2] for r in want if r[0] == 7)
    assert vectors[7] == [x for k in range(4) for x in want_books[k][int(code[2 * k : 2 * k + 2], 16)]]


@pytest.mark.parametrize("seed", range(6))
def test_annulus_loses_nothing(seed):
    """Nearest by annuli are the nearest of all, ties to the lower index, also far from the origin."""
    r = np.random.default_rng(seed)
    spread, away = (3, 0) if seed < 3 else (900, 4_000_000)
    entries, points = r.integers(-spread, spread + 1, (40, 4)) + away, r.integers(-spread, spread + 1, (700, 4)) + away
    points[:40], entries[30:] = entries, entries[:10]  # exact hits and repeated entries
    which, d, evaluated = codes.Codebook(entries).nearest(points)
    every = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (which == every.argmin(1)).all() and (d == every.min(1)).all()
    assert evaluated <= 700 * 40


def test_annulus_prunes():
    """Norms far apart leave few entries to evaluate."""
    r = np.random.default_rng(1)
    entries = r.integers(-5, 6, (64, 8)) + 1000 * np.arange(1, 65)[:, None]
    _, _, evaluated = codes.Codebook(entries).nearest(np.repeat(entries, 10, axis=0) + 1)
    assert evaluated < 640 * 3


def test_nothing_and_little(spark):
    none = spark.createDataFrame([], SCHEMA)
    coded, books = codes.compress(none)
    assert coded.count() == 0 and books.size == 0 and codes.books_digest(books)
    odd, _ = codes.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0)], "vec_id long, embedding array<double>, label int"))
    assert odd.count() == 0  # 8 parts do not divide 3 components
    one, books = codes.compress(spark.createDataFrame([(1, [1.0] * 8, None)], "vec_id long, embedding array<double>, label int"))
    assert [tuple(r)[:5] for r in one.collect()] == [(1, None, "00" * 8, 0, 0)] and books.shape == (8, 1, 1)
    with pytest.raises(Exception, match="beyond"):
        codes.compress(spark.createDataFrame([(1, [1e30] * 8, 0)], "vec_id long, embedding array<double>, label int"))


def test_whole_table_same_as_plain(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    want, _ = plain_codes(rows, 8, 16, 6, 4096)
    got = op11_annular_codes(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == sorted((i, c, e) for i, _, c, e in want)
