"""The tokenizing queries on a whole table against the libraries."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from sparkloom.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


@pytest.fixture(scope="module")
def word_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: t.encode(x, add_special_tokens=False).ids for i, x in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_byte_bpe(spark, texts):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    want = []
    for i, x in texts.items():
        ids = enc.encode_ordinary(x)
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(x.encode())))
    assert sorted(map(tuple, queries.op2_bpe_roundtrip(spark, SF).collect())) == sorted(want)


def test_pieces_of_all_documents(spark, word_ids):
    want = [(i, k, at, len(part), crc(part)) for i, x in word_ids.items() for k, at in enumerate(range(0, len(x) + 1, 2048)) for part in ([*x, 0][at : at + 2048],)]
    got = queries.op6_pattern_packing(spark, SF).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    total = sum(len(x) + 1 for x in word_ids.values())
    assert len({r["sequence_id"] for r in got}) <= 1.01 * -(-total // 2048) + 1


def test_ids_from_the_store(spark, word_ids):
    want, at = [], 0
    for i in sorted(word_ids):
        ids = [*word_ids[i], 1]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    got = queries.op7_content_store(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want
