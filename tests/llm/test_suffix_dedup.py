"""Suffix-array dedup at sizes and on strings that the small corpus does not have."""

import hashlib
import os

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import substrings, suffixes


def covered(texts, length):
    """For each text, True at the bytes that a repeated string covers, by digests of all strings."""
    name = lambda t, p: hashlib.blake2b(t[p : p + length], digest_size=16).digest()
    met, again = set(), set()
    for t in texts:
        for p in range(len(t) - length + 1):
            d = name(t, p)
            (again if d in met else met).add(d)
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if name(t, p) in again:
                gone[p : p + length] = True
        out.append(gone)
    return out


def held_against_brute_force(spark, texts, length=400):
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substrings.remove_repeats(docs, length).collect()}
    for i, (t, gone) in enumerate(zip(texts, covered(texts, length))):
        left = bytes(np.frombuffer(t, np.uint8)[~gone])
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (int(gone.sum()), hashlib.sha256(left).hexdigest()), i
    return got


def letters(random, n, of=b"abcdefghijklmnopqrstuvwxyz "):
    return np.frombuffer(of, np.uint8)[random.integers(0, len(of), n)].tobytes()


def test_a_header_of_many_documents_that_is_just_too_short(spark):
    r = np.random.default_rng(3)
    header = letters(r, 390)
    texts = [letters(r, 30) + header + letters(r, 40) for _ in range(5000)]
    texts[7] = texts[4000][:25] + texts[4000][25:430] + letters(r, 20)  # one longer repeat among them
    got = held_against_brute_force(spark, texts)
    assert got[7]["n_removed"] > 0 == got[8]["n_removed"]


def test_strings_whose_polynomials_are_alike(spark):
    r, word = np.random.default_rng(4), "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [letters(r, 500, b"cdefg") + x.encode() + letters(r, 500, b"cdefg") for x in (word[:1024], other[:1024])]
    held_against_brute_force(spark, [*texts, texts[0][100:1200]])


def test_long_and_repetitive_texts(spark):
    r = np.random.default_rng(5)
    page = letters(r, 70_000)
    texts = [b"x" * 30_000, letters(r, 9) + b"x" * 500, b"ab" * 5000, page, letters(r, 1000) + page[500:69_000] + letters(r, 1000), b"", b"y" * 400]
    held_against_brute_force(spark, texts)


def test_anchors_do_not_depend_on_steps(monkeypatch):
    r = np.random.default_rng(6)
    text = np.frombuffer(letters(r, 9000, b"ab"), np.uint8)
    ends = np.array([10, 10, 4000, 9000])
    whole = substrings.anchors(text, ends, 400, 100)
    monkeypatch.setattr(substrings, "STEP", 700)
    assert all((a == b).all() for a, b in zip(whole, substrings.anchors(text, ends, 400, 100)))


@pytest.mark.parametrize("short", [0, 1 << 18])
@pytest.mark.parametrize("block", [16, 1 << 16])
def test_recursion_and_disk_change_nothing(short, block, monkeypatch):
    monkeypatch.setattr(suffixes, "SHORT", short)
    monkeypatch.setattr(suffixes, "BLOCK", block)
    r = np.random.default_rng(7)
    for _ in range(25):
        part = r.integers(1, 4, int(r.integers(1, 40)))
        t = np.append(np.concatenate([part, part[::-1], np.repeat(part, 3), part]), 0)
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist(), reverse=True)
        for memory in (0, 1 << 24):
            assert np.concatenate([a for a, _ in suffixes.suffix_array(t, 10**4, memory)]).tolist() == want


def test_a_usual_block_goes_to_disk(monkeypatch):
    """The sort of one block as the query makes it: its arrays and runs outgrow the memory."""
    r, moved = np.random.default_rng(8), []
    plain = suffixes.Shelf._mapped
    monkeypatch.setattr(suffixes.Shelf, "_mapped", lambda self, n, dtype: moved.append(n) or plain(self, n, dtype))
    shared = letters(r, 600)
    bodies = [letters(r, int(r.integers(300, 900))) + shared[:450] + letters(r, 50) for _ in range(900)]
    assert sum(map(len, bodies)) > substrings.BLOCK
    rows = [(5, i, i, 0, b, []) for i, b in enumerate(bodies)]
    names = ["key", "doc_id", "row_key", "base", "body", "kinds"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(substrings._KIND)]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names)
    before = set(os.listdir("/proc/self/fd"))
    got = [x for b in substrings._sort_shard(400)([batch]) for x in b.to_pylist()]
    assert moved and len(set(os.listdir("/proc/self/fd")) - before) == 0
    gone = [np.zeros(len(b), bool) for b in bodies]
    for x in got:
        gone[x["doc_id"]][x["start"] : x["stop"]] = True
    assert all((a == b).all() for a, b in zip(gone, covered(bodies, 400)))
