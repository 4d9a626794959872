"""Strings that polynomials modulo a power of two cannot tell apart, and pairs that hashes bring together."""

import numpy as np

from sparkloom.llm import lines, neardup

FIRST = "a"
while len(FIRST) < 1024:
    FIRST += FIRST.translate(str.maketrans("ab", "ba"))
SECOND = FIRST.translate(str.maketrans("ab", "ba"))


def test_documents_of_different_words_are_not_linked(spark):
    docs = spark.createDataFrame([(i, f"one two {w} three four") for i, w in enumerate((FIRST, SECOND))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs, 3, 85, 100).collect()}
    assert [(got[i]["component_id"], got[i]["kept"], got[i]["n_shingles"]) for i in (0, 1)] == [(0, True, 3), (1, True, 3)]


def near(spark, rows):
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(docs).collect()}


def test_a_line_finds_its_witness_among_strings_alike(spark):
    assert near(spark, [SECOND + "x", SECOND + "y", FIRST + "x", FIRST + "y"]) == {0: 0, 1: 1, 2: 0, 3: 1}


def test_a_failed_witness_loses_no_link(spark, monkeypatch):
    """All hashes of one length alike: every key has false witnesses, and the strings decide."""
    monkeypatch.setattr(lines, "deletions", lambda text, lo, hi: (len(text), np.full(hi - lo, len(text) - 1)))
    stem = "the quick brown fox jumps over"
    rows = [stem + " a lazy dog", stem + " the hungry cow", stem + " the hungry cows", stem + " the hungry cat", stem + " b lazy dog", stem]
    assert near(spark, rows) == {0: 0, 1: 0, 2: 1, 3: 0, 4: 1, 5: 0}


def test_sets_keep_shingles_that_share_half_of_their_bits():
    a, b = np.array([5, 5, 5, 1], np.uint64), np.array([7, 8, 7, 1], np.uint64)
    assert neardup._set_of(a, b).tolist() == [(1, 1), (5, 7), (5, 8)]
    x, y = neardup._set_of(a, b), neardup._set_of(a[1:], b[1:] + np.uint64(1))
    assert neardup.intersections([x, y])[0, 1] == 1


def test_products_modulo_the_prime():
    r = np.random.default_rng(1)
    a, b = (r.integers(0, (1 << 61) - 1, 500, dtype=np.uint64) for _ in range(2))
    assert lines._times(a, b).tolist() == [int(x) * int(y) % ((1 << 61) - 1) for x, y in zip(a, b)]
