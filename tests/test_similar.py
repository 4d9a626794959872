"""The set-similarity join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import similar


def all_pairs(rows, num, den):
    sets = {}
    for i, tokens in rows:
        s = frozenset(t for t in tokens or [] if t is not None)
        if s and i is not None:
            sets.setdefault(s, []).append(i)
    classes = sorted(((min(ids), s) for s, ids in sets.items()), key=lambda c: c[0])  # an id of two rows may name two classes
    members = sorted({(i, min(ids)) for ids in sets.values() for i in ids})
    pairs = [(a, b, len(s & t)) for k, (a, s) in enumerate(classes) for b, t in classes[k + 1 :] if len(s & t) * den >= len(s | t) * num]
    return sorted(pairs), members


@pytest.mark.parametrize(("seed", "num", "den"), [(1, 4, 5), (2, 1, 2), (3, 9, 10), (4, 1, 1), (5, 2, 3)])
def test_same_as_all_pairs(spark, seed, num, den):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):
        own = set(r.choices(words, weights=[60 - k for k in range(60)], k=r.randrange(1, 30)))
        rows.append((i, [*own, *list(own)[:2], None]))
        for j in range(r.randrange(3)):  # near copies
            near = set(own) ^ set(r.sample(words, r.randrange(3)))
            rows.append((1000 + 10 * i + j, list(near)))
    base = ["x", "y", "z", "w0", "w1"]
    rows += [(5000 + k, base) for k in range(40)] + [(6000 + k, [*base, f"own{k}"]) for k in range(15)]  # copies, and a hot group
    rows += [(7000, None), (7001, []), (7002, [None]), (None, base), (7003, ["a", "1:b"]), (7004, ["a1", ":b"]), (3, rows[3][1])]
    frame = spark.createDataFrame(rows, "id long, class_id array<string>").select("id", "class_id", F.lit(1).alias("n"), F.lit("t").alias("token"))
    got = similar.similar_sets(frame, F.col("id"), F.col("class_id"), num, den)
    pairs, members = all_pairs(rows, num, den)
    assert sorted((x["first_id"], x["second_id"], x["shared"]) for x in got.pairs.collect()) == pairs
    assert sorted({tuple(x) for x in got.members.collect()}) == members
    links = {i: sum(c in (a, b) for a, b, _ in pairs) for i, c in members}
    assert {x["id"]: x["links"] for x in got.counted().collect()} == links


def test_nothing(spark):
    got = similar.similar_sets(spark.createDataFrame([], "i long, t array<string>"), F.col("i"), F.col("t"))
    assert got.pairs.count() == 0 and got.counted().count() == 0


def test_functions_of_a_tree(spark, tree):
    from sparkloom.plans.scan import scan

    body = "    total = 0\n    for item in {}:\n        total = total + item.price * item.count\n    return round(total, 2)\n"
    root = tree({"a.py": "def one(rows):\n" + body.format("rows"), "b.py": "# x\ndef two(lines):\n" + body.format("lines"), "c.py": "def three(x):\n    return x\n", "d.py": "def four(rows):\n" + body.format("rows")})
    s = scan(spark, root)
    got = s.similar().collect()
    s.release()
    assert [(r["first"]["file"], r["first"]["line"], r["second"]["name"]) for r in got] == [("a.py", 1, "two")] and 0.8 <= got[0]["score"] < 1


def test_sets_that_differ_in_two_rare_tokens_meet_few_others(spark):
    """Sets of ten, eight of them common to all: only what shares one of the two rare ones is looked at."""
    marks = list("abcdefgh")
    rows = [(i, [*marks, f"own{i // 3}", f"size{i % 50}"]) for i in range(3000)]
    frame = spark.createDataFrame(rows, "class_id long, words array<string>")
    got = similar.similar_sets(frame, F.col("class_id"), F.col("words"))
    assert got.links.count() == 50 * 60 * 59 // 2 + 3000
    sets = similar.numbered(frame.select(F.col("class_id").alias("row"), F.col("words").alias("tokens"))).withColumnRenamed("row", "class_id")
    assert similar._meet(sets, F.lit(True), F.lit(True), 4, 5, "tokens").count() < 100_000  # of 4.5 million pairs


def test_long_sets_and_crowds(spark, monkeypatch):
    monkeypatch.setattr(similar, "CROWD", 5)
    r = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(40):
        own = set(r.sample(words, r.randrange(25, 90)))
        rows += [(100 * i + j, sorted(own ^ set(r.sample(words, r.randrange(9))))) for j in range(6)]
    got = similar.similar_sets(spark.createDataFrame(rows, "i long, t array<string>"), F.col("i"), F.col("t"))
    pairs, members = all_pairs(rows, 4, 5)
    assert len(pairs) > 300 and sorted((x["first_id"], x["second_id"], x["shared"]) for x in got.pairs.collect()) == pairs
    assert sorted(tuple(x) for x in got.members.collect()) == members


def test_sets_of_a_pair_are_intersected_once(spark):
    """Once where short sets meet and once for whole ones: not again for each filter and column."""
    sets = similar.numbered(spark.createDataFrame([(1, ["a", "b"]), (2, ["a"])], "row long, tokens array<string>")).withColumnRenamed("row", "class_id")
    plan = similar.linked(sets, 4, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 2


def test_long_sets_that_share_a_passage_alone_are_no_pairs(spark, monkeypatch):
    """Two hundred long texts have one rare passage in common: sketches tell them apart where they meet, near
    copies are found, and each set goes to a few groups, not to its pairs."""
    monkeypatch.setattr(similar, "BIN", 4)
    r = random.Random(3)
    common = [f"w{i}" for i in range(2000)]
    rows = [(i, [f"passage{k}" for k in range(40)] + r.sample(common, 300)) for i in range(200)]
    near = [(1000 + i, [*rows[7][1][:-1], f"own{i}"]) for i in range(30)] + [(2000 + i, r.sample(common, 300)) for i in range(300)]
    looked = []
    monkeypatch.setattr(similar, "_whole", lambda pairs, sets, whole=similar._whole: (looked.append(pairs.count()), whole(pairs, sets))[1])
    got = similar.similar_sets(spark.createDataFrame(rows + near, "id long, words array<string>"), F.col("id"), F.col("words")).pairs.collect()
    want = {(a, b) for ids in [[7, *range(1000, 1030)]] for a in ids for b in ids if a < b}
    assert {(x["first_id"], x["second_id"]) for x in got} == want and {x["shared"] for x in got} == {339}
    assert looked[0] < 1000  # of 26,000 pairs that share the passage


def test_sets_that_differ_in_rare_tokens_alone_are_compared_once(spark, monkeypatch):
    """Of 2,000 sets with nine tokens of ten in common all pairs are links, and none of them is met one by one."""
    marks, met = list("abcdefghi"), []
    monkeypatch.setattr(similar, "_meet", lambda *a, meet=similar._meet, **k: met.append(meet(*a, **k)) or met[-1])
    frame = spark.createDataFrame([(i, [*marks, f"own{i // 2}"]) for i in range(0, 4000, 2)], "id long, words array<string>")
    got = similar.similar_sets(frame, F.col("id"), F.col("words"))
    assert got.links.count() == 2000 * 1999 // 2 and sum(m.count() for m in met) == 0
    pair = got.pairs.filter("first_id = 10 and second_id = 3998").collect()
    assert [tuple(p) for p in pair] == [(10, 3998, 9, 9 / 11)]


@pytest.mark.parametrize(("seed", "num", "den"), [(1, 4, 5), (2, 1, 2), (3, 9, 10)])
def test_kinds_in_blocks(spark, monkeypatch, seed, num, den):
    """Kinds of several sets, in blocks, with tokens of their own that two or three sets hold, and others alike."""
    monkeypatch.setattr(similar, "COMMON", 3)
    monkeypatch.setattr(similar, "CROWD", 4)
    r = random.Random(seed)
    rows = []
    for k in range(8):
        base = r.sample([f"w{i}" for i in range(14)], r.randrange(6, 11))
        rows += [(100 * k + i, [*base, *{f"own{r.randrange(60)}" for _ in range(r.randrange(3))}]) for i in range(25)]
    rows += [(1000 + i, r.sample([f"w{i}" for i in range(14)], 8)) for i in range(30)]
    got = similar.similar_sets(spark.createDataFrame(rows, "i long, t array<string>"), F.col("i"), F.col("t"), num, den)
    pairs, members = all_pairs(rows, num, den)
    assert got.kinds.units.filter("i > 0 or j > 0").count() > 0
    assert sorted((x["first_id"], x["second_id"], x["shared"]) for x in got.pairs.collect()) == pairs
    links = {i: sum(c in (a, b) for a, b, _ in pairs) for i, c in members}
    assert {x["id"]: x["links"] for x in got.counted().collect()} == links


def test_large_sets_are_ruled_out_by_wider_sketches(spark, monkeypatch):
    """Sets of 1,700 tokens may differ in some 377, so sketches of 512 bits leave open all pairs of sixty that share
    a passage alone; near copies among them, whose families meet, are found all the same."""
    r = random.Random(4)
    words, passage = [f"w{i}" for i in range(20000)], [f"passage{k}" for k in range(200)]
    rows = [(i, passage + r.sample(words, 1500)) for i in range(60)]
    for i in range(6):  # chains: each copy has 150 tokens less than the one before, so ends are no pair
        rows += [(100 + 10 * i + j, rows[i][1][: 1700 - 150 * j]) for j in range(1, 4)]
    looked = []
    monkeypatch.setattr(similar, "BIN", 2)
    monkeypatch.setattr(similar, "_whole", lambda pairs, sets, whole=similar._whole: (looked.append(pairs.count()), whole(pairs, sets))[1])
    got = similar.similar_sets(spark.createDataFrame(r.sample(rows, len(rows)), "id long, words array<string>"), F.col("id"), F.col("words")).pairs.collect()
    pairs, _ = all_pairs(rows, 4, 5)
    assert len(pairs) > 24 and sorted((x["first_id"], x["second_id"], x["shared"]) for x in got) == pairs
    assert looked[0] < 100  # of 1,770 pairs that share the passage
