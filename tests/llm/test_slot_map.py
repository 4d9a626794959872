"""Every column of the sharding, computed again; and the stored map over its versions."""

import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from sparkloom.llm import sharding

SEED = 42  # with which Spark's xxhash64 begins


def hashed(value, seed):
    if value is None:
        return seed
    raw = value.encode() if isinstance(value, str) else struct.pack("<q", value)
    return xxhash.xxh64_intdigest(raw, seed)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def by_hand(rows, n_shards, n_slots):
    own = []
    for i, t in rows:
        key = signed(hashed(t, hashed(i, SEED)))
        slot = signed(hashed(key, hashed(i, SEED))) % n_slots
        raw = (t or "").encode()
        own.append((slot, (i is not None, i or 0, key), i, len(raw) + 16, zlib.crc32(raw)))
    weight = Counter()
    for slot, _, _, size, _ in own:
        weight[slot] += size
    to = sharding.assign({s: weight[s] for s in range(n_slots)}, n_shards)
    places, out = defaultdict(int), []
    for slot, _, i, size, crc in sorted(own):
        out.append((i, size, crc, "bytes", to[slot], places[to[slot]], None, slot, 1))
        places[to[slot]] += 1
    return out


@pytest.mark.parametrize("n_shards, n_slots", [(5, 64), (40, 4096)])
def test_all_columns(docs, corpus, n_shards, n_slots):
    got = [tuple(r) for r in sharding.shard_documents(docs, n_shards, n_slots).collect()]
    assert sorted(got, key=repr) == sorted(by_hand(corpus, n_shards, n_slots), key=repr)


def test_a_stated_map_is_kept_and_edited(spark, docs, corpus, tmp_path):
    path = f"file://{tmp_path}/map"

    def shards(n, table=docs):
        rows = sharding.shard_documents(table, n, 64, path).collect()
        for s in {r["shard"] for r in rows}:
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
        return {(r["doc_id"], r["text_crc32"]): r["shard"] for r in rows}, {r["map_version"] for r in rows}

    first, one = shards(5)
    again, same = shards(5)
    assert first == again and one == same == {1}
    more = spark.createDataFrame([(9000 + i, "more text " * i) for i in range(50)], "doc_id long, text string")
    later, still = shards(5, docs.select("doc_id", "text").union(more))
    assert still == {1} and all(later[k] == s for k, s in first.items())
    grown, two = shards(6)
    assert two == {2} and all(grown[k] in (s, 5) for k, s in first.items()) and 5 in grown.values()
    assert sharding.read_map(spark, path, 1).count() == sharding.read_map(spark, path).count() == 64
    with pytest.raises(ValueError, match="more than 5"):
        sharding.shard_documents(docs, 5, 64, path)
    with pytest.raises(ValueError, match="slots"):
        sharding.shard_documents(docs, 7, 32, path)


def test_a_version_that_was_not_finished_does_not_count(spark, docs, tmp_path):
    path = f"file://{tmp_path}/map"
    sharding.shard_documents(docs, 5, 64, path)
    (tmp_path / "map" / "version=2").mkdir()
    assert sharding.latest_version(spark, path) == 1


def test_slots_move_when_weights_drift(spark, tmp_path):
    """Rows that weigh more in half of the shards: the next version evens them out, and moves what it has to."""
    path = f"file://{tmp_path}/map"

    def dealt(rows):
        got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4, 256, path).collect()
        weight = [sum(r["size"] for r in got if r["shard"] == s) for s in range(4)]
        return {r["doc_id"]: (r["shard"], r["map_version"]) for r in got}, max(weight) / (sum(weight) / 4)

    rows = [(i, "x" * 100) for i in range(2000)]
    first, even = dealt(rows)
    assert even < 1.01 and {v for _, v in first.values()} == {1}
    assert dealt(rows) == (first, even) and dealt(rows[:1990])[0] == {i: x for i, x in first.items() if i < 1990}
    heavy = rows + [(10_000 + i, "z" * 20_000) for i in range(60)]
    second, even = dealt(heavy)
    assert even <= 1.05 and {v for _, v in second.values()} == {2}
    now, before = ({r["virtual_slot"]: r["shard"] for r in sharding.read_map(spark, path, v).collect()} for v in (2, 1))
    moved = sum(now[x] != before[x] for x in now)
    assert 0 < moved < 128  # of 256 slots
    assert dealt(heavy) == (second, even)
    one = [*rows, (7, "w" * 5_000_000)]  # a row that no move can make light
    dealt(one)
    version = sharding.latest_version(spark, path)
    dealt(one)
    assert sharding.latest_version(spark, path) <= version + 1
