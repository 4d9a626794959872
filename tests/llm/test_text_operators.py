"""Operators on texts against brute force."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import bpe, lines, neardup, packing, quality, sharding, store, substrings
from sparkloom.llm.suffixes import suffix_array
from sparkloom.llm.tokens import vocabulary_path

MULTI, WORDS = vocabulary_path("byte_bpe_multi_50k.tiktoken"), vocabulary_path("word_bpe_49k.json")


def same(got, want):
    order = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert order(got) == order(want)


# -- 1 --------------------------------------------------------------------------------------


@pytest.mark.parametrize("cap", [6, 1000])
@pytest.mark.parametrize("memory", [0, 1 << 20])
def test_suffix_array(cap, memory):
    r = np.random.default_rng(0)
    for _ in range(60):
        t = np.append(r.integers(1, int(r.integers(2, 5)), int(r.integers(1, 60))), 0)
        parts = list(suffix_array(t, cap, memory))
        sa, lcp = np.concatenate([a for a, _ in parts])[::-1].tolist(), np.concatenate([b for _, b in parts])[1:][::-1].tolist()
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert [t[i : i + cap].tolist() for i in sa] == [t[i : i + cap].tolist() for i in want]
        for a, b, n in zip(sa, sa[1:], lcp):
            k = 0
            while k < cap and a + k < len(t) and b + k < len(t) and t[a + k] == t[b + k]:
                k += 1
            assert k == n


def repeats(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + length] for _, t in raw for p in range(len(t) - length + 1))
    out = []
    for i, t in raw:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("length, hot", [(20, 1000), (60, 1000), (60, 2), (400, 1000)])
def test_repeated_substrings(docs, corpus, length, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    same(substrings.remove_repeats(docs, length).collect(), repeats(corpus, length))


@pytest.mark.parametrize("length", [20, 60])
def test_no_task_sorts_a_crowd(docs, corpus, length, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 2)
    monkeypatch.setattr(substrings, "CROWD", 4, raising=False)
    plain = substrings._sort_shard

    def checked(length):
        inner = plain(length)

        def run(batches):
            held = list(batches)
            if max(Counter(k for b in held for k in b.column(0).to_pylist()).values(), default=0) > 4:
                raise ValueError("a crowd in one task")
            yield from inner(iter(held))

        return run

    monkeypatch.setattr(substrings, "_sort_shard", checked)
    same(substrings.remove_repeats(docs, length).collect(), repeats(corpus, length))


# -- 2 --------------------------------------------------------------------------------------


def test_bpe_as_tiktoken_has_it(docs, corpus):
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in corpus:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    same(bpe.roundtrip_digests(docs, MULTI).collect(), want)
    encoded = bpe.encode_texts(docs, MULTI)
    same([(r["doc_id"], bytes(r["decoded"])) for r in bpe.decode_ids(encoded, MULTI).collect()], [(i, (t or "").encode()) for i, t in corpus])


# -- 3 --------------------------------------------------------------------------------------


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def test_deletions_are_those_of_the_strings():
    own, left = lines.deletions("naïve\U0001f642", 0, 6)
    for i, h in enumerate(left.tolist()):
        t = "naïve\U0001f642"
        assert lines.deletions(t[:i] + t[i + 1 :], 0, 0)[0] == h != own


def test_line_dedup(spark):
    import random

    r = random.Random(5)
    pool = ["".join(r.choice("ab ") for _ in range(r.randrange(3, 12))) for _ in range(60)] + ["ab" * 40]
    rows = []
    for i in range(70):
        own = []
        for _ in range(r.randrange(6)):
            x = r.choice(pool)
            k = r.randrange(len(x))
            own.append(r.choice(["", " \t"]) + (x[:k] + r.choice(["", "z", "É", "b"]) + x[k + r.randrange(2) :] if r.random() < 0.5 else x))
        rows.append((i, "\n".join(own) if i % 13 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit(1)).withColumn("row", F.lit(1))
    seen, want = [], []
    for i, t in rows:
        kept, n = [], 0
        for x in [] if t is None else t.split("\n"):
            n += 1
            low = x.strip(" \t\r\x0b\x0c").lower()
            if len(low) < 4:
                kept.append(x)
                continue
            if not any(within_one(low, o) for o in seen):
                kept.append(x)
            seen.append(low)
        want.append((i, None if t is None else "\n".join(kept), n, n - len(kept)))
    same(lines.dedup_lines(docs, least_chars=4).drop("row").collect(), want)


def test_line_dedup_of_odd_rows(docs, corpus, nothing):
    got = lines.dedup_lines(docs)
    assert got.count() == len(corpus) and lines.dedup_lines(nothing).count() == 0
    by_id = defaultdict(list)
    for r in got.collect():
        by_id[r["doc_id"]].append(r)
        assert r["row"]["score"] == "y"
    assert by_id[400][0]["text"] is None and by_id[401][0]["n_lines"] == 1
    assert sum(bool(by_id[100 + i][0]["text"]) for i in range(30)) == 1  # the earliest copy stays
    assert len({tuple(r)[1:] for r in by_id[500] if r["text"] != "other text, same id"}) == 1


# -- 4 --------------------------------------------------------------------------------------


def test_shards(docs, corpus):
    got = sharding.shard_documents(docs, n_shards=5, n_slots=64).collect()
    want = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in corpus]
    same([r[:3] for r in got], want)
    places, load, of_slot = defaultdict(list), Counter(), {}
    for r in got:
        places[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        assert of_slot.setdefault(r["virtual_slot"], r["shard"]) == r["shard"] and r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    heaviest = max(Counter({s: sum(r["size"] for r in got if r["virtual_slot"] == s) for s in of_slot}).values())
    assert max(load.values()) <= max(heaviest, sum(load.values()) / 5 * 1.05)


def test_growing_moves_slots_only_into_new_shards():
    r = np.random.default_rng(1)
    sizes = {s: int(x) for s, x in enumerate(r.integers(0, 1000, 500))}
    old = sharding.assign(sizes, 8)
    new = sharding.rebalance(old, sizes, 9)
    assert all(new[s] in (old[s], 8) for s in sizes)
    load = Counter()
    for s, b in sizes.items():
        load[new[s]] += b
    assert load[8] > 0.9 * sum(sizes.values()) / 9 and max(load.values()) < 1.2 * sum(sizes.values()) / 9


# -- 5 --------------------------------------------------------------------------------------


def graph(rows, width, num, den):
    word, sets = re.compile(rb"[^\x20\x09-\x0D]+"), []
    for _, t in rows:
        ws = word.findall((t or "").encode().lower())
        sets.append({tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)} if len(ws) >= width else {tuple(ws)} if ws else set())
    at = list(range(len(rows)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and den * n >= num * (len(sets[a]) + len(sets[b]) - n):
                at[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    comp = [i if not sets[k] else least.get(root(k)) for k, (i, _) in enumerate(rows)]
    return [(i, len(sets[k]), comp[k], i == comp[k]) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("width, num, den", [(3, 85, 100), (5, 80, 100), (1, 50, 100)])
def test_near_duplicates(docs, corpus, width, num, den):
    same(neardup.near_duplicates(docs, width, num, den).drop("row_key").collect(), graph(corpus, width, num, den))


def test_near_duplicates_where_nodes_branch(docs, corpus, monkeypatch):
    monkeypatch.setattr(neardup, "MOST_MEMBERS", 5)
    same(neardup.near_duplicates(docs, 3, 85, 100).drop("row_key").collect(), graph(corpus, 3, 85, 100))


def test_large_nodes_are_compared_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MOST_MEMBERS", 40)
    sig = np.arange(64, dtype=np.uint32).tobytes()
    shape = spark.createDataFrame([(bytes([i, 1]), 9, sig) for i in range(200)], "sid binary, n long, sig binary")
    of_node = defaultdict(set)
    for r in neardup._leaves(shape, 2).collect():
        of_node[r["node"]].add(bytes(r["sid"]))
    assert max(map(len, of_node.values())) <= 60
    assert len({(a, b) for x in of_node.values() for a in x for b in x if a < b}) == 200 * 199 // 2


def test_trees_branch_by_coordinates_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MOST_MEMBERS", 20)
    r = np.random.default_rng(6)
    sigs = r.integers(0, 1 << 32, (62, 64), dtype=np.uint32)
    sigs[:, :9] = 1  # all are in one large node of every tree
    sigs[1] = sigs[0]
    sigs[1, 9:25] += np.uint32(1)  # what all trees once branched by
    shape = spark.createDataFrame([(bytes([i]), 9, x.tobytes()) for i, x in enumerate(sigs)], "sid binary, n long, sig binary")
    of_node = defaultdict(set)
    for row in neardup._leaves(shape, 9).collect():
        of_node[row["node"]].add(row["sid"][0])
    assert any({0, 1} <= x for x in of_node.values())
    for trees, threshold in ((8, 0.85), (9, 0.8), (20, 0.5)):
        levels = neardup._coordinates(trees, threshold)
        assert all(len({t, *(k for level in levels for k in level[t])}) == 1 + sum(len(level[t]) for level in levels) for t in range(trees))
        n = len(levels[0][0])
        assert (1 - threshold + threshold * len(levels) * (1 - threshold) ** n) ** trees <= 1e-6


def test_near_copies_beyond_a_node_are_linked_by_pivots(spark, corpus, monkeypatch):
    monkeypatch.setattr(neardup, "MOST_MEMBERS", 8)
    words = [f"w{k}" for k in range(150)]
    rows = [(i, " ".join([*words[:i], f"own{i}", *words[i + 1 :]])) for i in range(60)]
    rows += [(100 + i, " ".join([*words[: 75 + i], *(f"x{i}.{k}" for k in range(30))])) for i in range(30)]
    docs = spark.createDataFrame([*rows, *corpus], "doc_id long, text string")
    same(neardup.near_duplicates(docs, 3, 85, 100).drop("row_key").collect(), graph([*rows, *corpus], 3, 85, 100))


def test_intersections():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 300, n).astype(np.uint64)) for n in (1, 40, 80, 200, 3)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = neardup.intersections(sets, block=32)
    assert all(got[i][j] == want[i][j] for i in range(5) for j in range(5) if i != j)


# -- 6 --------------------------------------------------------------------------------------


def ids_of(corpus, end):
    t = Tokenizer.from_file(WORDS)
    return [(i, np.array(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4")) for i, x in corpus]


def test_packing(docs, corpus):
    got = packing.pack_documents(docs, WORDS, capacity=256).collect()
    want = []
    for i, ids in ids_of(corpus, 0):
        for piece, at in enumerate(range(0, len(ids), 256)):
            want.append((i, piece, at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes())))
    same([tuple(r)[:5] for r in got], want)
    placed = defaultdict(list)
    for r in got:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in placed.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    room: list[int] = []  # no worse than first fit, longest first
    for n in sorted((w[3] for w in want), reverse=True):
        k = next((k for k, x in enumerate(room) if x >= n), len(room))
        room[k:] = [room[k] - n, *room[k + 1 :]] if k < len(room) else [256 - n]
    assert len(placed) <= len(room)


@pytest.mark.parametrize("histogram, best", [({}, 0), ({1: 10}, 1), ({2048: 4}, 4), ({1025: 7}, 7), ({1024: 7}, 4), ({683: 300, 682: 600}, 300), ({1366: 500, 682: 500}, 500)])
def test_plans(histogram, best):
    runs = packing.plan_runs(histogram, 2048)
    placed, filled = Counter(), defaultdict(int)
    for length, _, n, sequence, _ in runs:
        placed[length] += n
        for s in range(sequence, sequence + n):
            filled[s] += length
    assert placed == Counter(histogram) and len(filled) == best and max(filled.values(), default=0) <= 2048


# -- 7 --------------------------------------------------------------------------------------


def test_store(spark, docs, corpus, tmp_path):
    path = store.write_store(docs, f"file://{tmp_path}/store", WORDS)
    got = store.read_digests(spark, path).orderBy("start").collect()
    at, want = 0, defaultdict(list)
    for i, ids in ids_of(corpus, 1):
        want[i].append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in corpus), key=lambda i: (i is not None, i))
    for r in got:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in want[r["doc_id"]]
        at += r["n_tokens"]
    same([(r["doc_id"], tuple(r["ids"])) for r in store.read_ids(spark, path).collect()], [(i, tuple(ids.tolist())) for i, ids in ids_of(corpus, 1)])
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count() < len(corpus)
    broken = chunks.withColumn("data", F.when(F.col("n") == chunks.agg(F.max("n")).first()[0], F.concat(F.substring("data", 3, 1 << 20), F.lit(b"\x01\x01"))).otherwise(F.col("data")))
    broken.write.parquet(f"file://{tmp_path}/bad/chunks")
    spark.read.parquet(f"{path}/recipes").write.parquet(f"file://{tmp_path}/bad/recipes")
    with pytest.raises(Exception, match="damaged"):
        store.read_digests(spark, f"file://{tmp_path}/bad").collect()


def test_cuts_follow_content():
    r = np.random.default_rng(4)
    a = r.integers(0, 40_000, 60_000)
    b = np.concatenate([r.integers(0, 40_000, 777), a])

    def cut(x):
        ends = store.cut_points(len(x), store.marks_of(x).tolist())
        return {x[i:j].tobytes() for i, j in zip([0, *ends[:-1]], ends)}

    assert len(cut(a) & cut(b)) >= len(cut(a)) - 3
    whole = bytes(range(256)) * 9
    parts = [whole[i : i + 100] for i in range(0, len(whole), 100)]
    assert store.joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(whole)


def test_short_near_copies_share_chunks():
    r = np.random.default_rng(12)

    def cut(x):
        ends = store.cut_points(len(x), store.marks_of(x).tolist())
        return {x[i:j].tobytes() for i, j in zip([0, *ends[:-1]], ends)}

    shared = 0
    for _ in range(40):
        a = r.integers(0, 40_000, 568)
        b = a.copy()
        b[r.integers(500, 568)] += 1
        shared += bool(cut(a) & cut(b))
    assert shared > 20


# -- 8 --------------------------------------------------------------------------------------


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"]]
    good, bad = [r["score"] for r in held if r["quality"] == 1], [r["score"] for r in held if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.85
    assert np.mean([r["predicted"] == 1 for r in held if r["quality"] == 1]) > 0.97


def test_quality_of_odd_rows(spark, docs, corpus, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 7, 0), (3, 1, 0), (3, 0, 0), (4, 1, 0), (100, 1, 1), (101, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    got = quality.classify(docs, odd).collect()
    assert len(got) == len(corpus) and all(0 <= r["score"] <= 1 for r in got)
    empty = [r["score"] for r in got if r["doc_id"] in (400, 401)]
    assert empty[0] == empty[1] and not [r for r in got if r["doc_id"] is None and r["held_out"]]
    assert quality.classify(nothing, odd).count() == 0


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 255, 256, 257, 480, 481, 3000):
        t = bytes(i % 251 for i in range(n))
        chunks, numbers = quality.chunks_of([t])
        step = quality.CHUNK - quality.OVERLAP
        assert numbers[0] == len(chunks)
        back = b"".join(bytes(c[: step if k < len(chunks) - 1 else quality.CHUNK][c[: step if k < len(chunks) - 1 else quality.CHUNK] < 256].astype(np.uint8)) for k, c in enumerate(chunks))
        assert back == t


def test_filters_see_every_place():
    net = quality.ByteNet.fresh()
    net.p["filters"][:, 0] = net.p["vectors"][list(b"phrase")].reshape(-1)
    net.p["filters"][:, 0] -= net.p["filters"][:, 0].mean()
    pooled = [net.pooled(quality.chunks_of([b"." * n + b"phrase" + b"." * (40 - n)])[0])[0, :-1] for n in (8, 9)]
    assert np.allclose(*pooled, atol=1e-4)


def test_gradients():
    net = quality.ByteNet.fresh()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    chunks, numbers = quality.chunks_of([b"hello there, this is text" * 20, b"!!! ???"])
    y, w = np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss():
        h = np.maximum(net.pooled(chunks) @ net.p["layer"] + net.p["lbias"], 0)
        mean = np.add.reduceat(h, np.cumsum(numbers) - numbers, axis=0) / numbers[:, None]
        p = 1 / (1 + np.exp(-(mean @ net.p["last"] + net.p["bias"][0])))
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    g = net.gradients(chunks, numbers, y, w)
    for k, at in (("last", 3), ("layer", (2, 5)), ("filters", (7, 4)), ("vectors", (101, 2)), ("bias", 0)):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-3
        up = loss()
        net.p[k][at] = old - 1e-3
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / 2e-3 - g[k][at]) < 2e-3


# -- all ------------------------------------------------------------------------------------


def test_empty_tables(nothing):
    for got in (
        substrings.remove_repeats(nothing), bpe.roundtrip_digests(nothing, MULTI), sharding.shard_documents(nothing),
        neardup.near_duplicates(nothing), packing.pack_documents(nothing, WORDS), store.store_documents(nothing, WORDS),
    ):
        assert got.count() == 0
