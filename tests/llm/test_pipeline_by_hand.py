"""The pipeline against its stages written out in plain Python, but for what the net rejects."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import stages
from sparkloom.llm.tokens import vocabulary_path

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def without_old_lines(rows):
    seen, by_size, out = set(), {}, []
    for i, text in rows:
        kept, lines = [], text.split("\n")
        for line in lines:
            low = line.strip(" \t\r\x0b\x0c").lower()
            if len(low) < 20:
                kept.append(line)
                continue
            near = (o for n in (-1, 0, 1) for o in by_size.get(len(low) + n, ()))
            if low not in seen and not any(one_edit(low, o) for o in near):
                kept.append(line)
            if low not in seen:
                seen.add(low)
                by_size.setdefault(len(low), []).append(low)
        left = "\n".join(kept)
        if len(kept) == len(lines) or left.strip(" \t\r\x0b\x0c") != "":
            out.append((i, left))
    return out


def one_of_each_group(rows):
    sets = []
    for _, text in rows:
        ws = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        sets.append({tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    head = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                old, new = max(head[a], head[b]), min(head[a], head[b])
                head = [new if h == old else h for h in head]
    return [r for k, r in enumerate(rows) if head[k] == k]


def without_repeats(rows, length=400):
    raw = [(i, t.encode()) for i, t in rows]
    seen = Counter(hash(t[p : p + length]) for _, t in raw for p in range(len(t) - length + 1))
    out = []
    for i, t in raw:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[hash(t[p : p + length])] > 1:
                gone[p : p + length] = True
        out.append((i, bytes(np.frombuffer(t, np.uint8)[~gone]).decode("utf-8", "ignore")))
    return out


def pieces(rows):
    t, out = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json")), []
    for i, text in rows:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            out.append((i, piece, at, len(part), zlib.crc32(part.tobytes())))
    return out


def test_rows_are_those_of_the_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = stages.keep_good(spark, docs, SF).select("doc_id", "text").orderBy("doc_id").collect()
    rows = [(r["doc_id"], r["text"]) for r in good]
    assert len({i for i, _ in rows}) == len(rows) and all(t is not None for _, t in rows)
    now = without_old_lines(rows)
    assert len(now) <= len(rows)
    now = one_of_each_group(now)
    now = without_repeats(now)
    got = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(pieces(now))


@pytest.mark.parametrize("k", range(5))
def test_stages_bear_columns_of_any_name(spark, corpus, k):
    names = ["row", "key", "id", "d", "k", "__key", "__new_text", "spans", "sid", "comp", "kept", "gone", "bucket", "length", "a.b"]
    plain = spark.createDataFrame([(i, t) for i, t in corpus], "doc_id long, text string")
    docs = plain.select("doc_id", "text", *[F.lit(j).alias(n) for j, n in enumerate(names)])
    stage = corpus_pipeline.STAGES[k][1]
    got, want = stage(spark, docs, SF), stage(spark, plain, SF)
    if k < 4:
        assert got.columns == docs.columns
        assert all(r[n] == j for r in got.collect() for j, n in enumerate(names))
    assert sorted(map(repr, got.select("doc_id", *want.columns[1:5][: 1 if k < 4 else 4]).collect())) == sorted(map(repr, want.select("doc_id", *want.columns[1:5][: 1 if k < 4 else 4]).collect()))


def test_packing_makes_no_sequences_of_nothing(spark, nothing):
    assert corpus_pipeline.STAGES[4][1](spark, nothing, SF).count() == 0
