"""The net's score against a forward pass written out, and what it is fitted on."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F


from sparkloom.llm import quality


def slow_score(net, text):
    """One text, one filter place at a time."""
    p, step = net.p, quality.CHUNK - quality.OVERLAP
    starts, hidden = list(range(0, max(1, len(text) - quality.OVERLAP), step)), []
    for a in starts:
        part = list(text[a : a + quality.CHUNK])
        codes = part + [quality.PAD] * (quality.CHUNK - len(part))
        best = [-math.inf] * quality.FILTERS
        for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
            window = np.concatenate([p["vectors"][c] for c in codes[at : at + quality.WIDTH]]).astype(np.float64)
            for f in range(quality.FILTERS):
                best[f] = max(best[f], float(window @ p["filters"][:, f]))
        features = [max(0.0, b + float(c)) for b, c in zip(best, p["fbias"])] + [len(part) / quality.CHUNK]
        hidden.append([max(0.0, sum(x * float(w) for x, w in zip(features, p["layer"][:, h])) + float(p["lbias"][h])) for h in range(quality.HIDDEN)])
    mean = [sum(h[k] for h in hidden) / len(hidden) for k in range(quality.HIDDEN)]
    z = sum(m * float(w) for m, w in zip(mean, p["last"])) + float(p["bias"][0])
    return 1 / (1 + math.exp(-z))


def test_scores_are_those_of_a_slow_forward_pass():
    net = quality.ByteNet.fresh(3)
    r = np.random.default_rng(4)
    for k in ("fbias", "lbias", "bias"):
        net.p[k] = r.standard_normal(net.p[k].shape).astype(np.float32) * 0.1
    texts = [b"", b"a", b"short text", bytes(r.integers(0, 256, 300, dtype=np.uint8)), ("naïve Étude " * 70).encode(), b"x" * 225]
    got = net.scores(texts)
    assert np.allclose(got, [slow_score(net, t) for t in texts], atol=1e-5)


def test_blocks_change_no_gradient(monkeypatch):
    net = quality.ByteNet.fresh()
    chunks, numbers = quality.chunks_of([b"some words here " * 90, b"", b"others " * 40])
    y, w = np.array([1.0, 0.0, 1.0], np.float32), np.ones(3, np.float32)
    whole = net.gradients(chunks, numbers, y, w)
    monkeypatch.setattr(quality, "BLOCK", 2)
    parts = net.gradients(chunks, numbers, y, w)
    assert all(np.allclose(whole[k], parts[k], atol=1e-5) for k in whole)


def test_a_net_learns_from_the_end_of_a_long_text(spark, monkeypatch):
    """Only the last bytes of each text tell its label."""
    r, rows, labels = np.random.default_rng(5), [], []
    for i in range(240):
        good = i % 2
        filler = "".join(r.choice(list("abcdefgh "), 2400))
        rows.append((i, filler + (" verified and sound." if good else " @@## $$%% !!!! ~~~~")))
        labels.append((i, good, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r["held_out"]]
    assert np.mean([(r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in held]) > 0.9


def test_rows_beyond_the_byte_bound_are_left_out_whole(spark):
    docs = spark.createDataFrame([(i, "x" * 1000 if i % 2 else "y z" * 300) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert isinstance(quality.train(docs, labels, most_bytes=5000), quality.ByteNet)
    known = [i % 2 for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert quality.train(docs, labels, most_bytes=10) == sum(known) / len(known)


def test_a_text_beyond_the_bound_makes_way_for_those_after_it(spark):
    """The first row of a label by hash does not fit; the others are learnt from all the same."""
    rows = [(i, ("sound words %d " % i) * 20 if i % 2 else ("#@! junk %d " % i) * 20) for i in range(200)]
    known = [i for i in range(0, 200, 2) if zlib.crc32(str(i).encode()) % 4 != 2]
    first = spark.createDataFrame([(i,) for i in known], "doc_id long").orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    rows = [(i, "junk " * 60_000 if i == first else t) for i, t in rows] + [(1, None), (3, "sound too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    net = quality.train(docs, labels, most_bytes=200_000)
    assert isinstance(net, quality.ByteNet)
    good, bad = net.scores([b"sound words 5 " * 20]), net.scores([b"#@! junk 8 " * 20])
    assert good[0] > 0.7 > 0.3 > bad[0]
