"""Base spans against the plain expressions, the label model and the classifier on planted forms."""

import hashlib
import random
import re
import time

import numpy as np

from sparkloom.llm import private
from sparkloom.llm.queries import op12_weak_private_spans

PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda d, m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda d, m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda d, m: 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, d[::-1]))) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda d, m: 9 <= len(d) <= 15),
)


def plain_spans(text):
    out = []
    for k, (kind, form, passes) in enumerate(PLAIN):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(form, text or "") if passes("".join(c for c in m[0] if c in "0123456789"), m[0])]
    return sorted(out)


def base_of(text):
    return [s[:3] for s in private.candidates(text) if s[3]]


def test_base_is_the_plain_expressions():
    r = random.Random(2)
    bits = ["a", "b.c", "@", ".", "-", "+", " ", "1", "25", "256", "4111111111111111", "(", ")", "é", "\n", "%", "_", "0", "7", "10.0.0.1", "x@y.z", "+1 ("]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 60))) for _ in range(6000)]
    texts += ["a@b.c@d.e", "a@b", "@b.c", "a@@b.c d@e.f.", "1.2.3.4.5.6.7.8.9", "001.2.3.0255", "999.1.1.1.1.1.1.1", "4111 1111-1111 1111", "4111  1111 1111 1111", "+1--------2", "٣.1.2.3", "é@é.com", "x" * 200 + "@y.zz"]
    for t in texts:
        assert base_of(t) == [s[:3] for s in plain_spans(t)], t


def test_long_runs_take_linear_time():
    began = time.perf_counter()
    n = 1_000_000
    for t in ("z" * n, "1" * n, "1 " * (n // 2), "1." * (n // 2), "@" * n, "a@" * (n // 2), "+1" * (n // 2), "a at " * (n // 5), "1-" * (n // 2), " at" * (n // 3), "a.b@c" * (n // 5), ": " * (n // 2), "(12) " * (n // 5)):
        private.candidates(t)
    assert time.perf_counter() - began < 60
    assert base_of("z" * 300_000 + "@y.zz") == [(0, 0, 300_005)]


def test_rows_and_digests(spark, corpus):
    rows = [*corpus, (700, "mail a@b.cd, 10.0.0.1 or +1 (017) 555-7713\n4111 1111 1111 1111"), (701, "été 1.2.3.4"), (702, "4111111111111112"), (703, "x " * 400_000 + "a@b.cd")]
    frame = spark.createDataFrame([(i, t, "x", 1, True) for i, t in rows], "doc_id long, text string, spans string, kind int, base boolean").repartition(3)
    got = sorted((tuple(r) for r in private.digests(frame).drop("n_added").collect()), key=repr)
    want = []
    for i, t in rows:
        spans = plain_spans(t)
        told = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        want.append((i, *(sum(k == name for *_, k in spans) for name in private.KINDS), hashlib.sha256(told.encode()).hexdigest(), told))
    assert [r[:6] for r in got] == [r[:6] for r in sorted(want, key=repr)]
    for g, w in zip(got, sorted(want, key=repr)):
        assert set(filter(None, w[6].split(","))) <= set(filter(None, g[6].split(",")))
    assert private.digests(frame.limit(0)).count() == 0


def test_nothing_private(spark):
    got = private.private_spans(spark.createDataFrame([(1, "plain words"), (2, None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], len(r["spans"])) for r in got) == [(1, 0), (2, 0)]


def planted(n=300, seed=4):
    """Texts with strict forms, spelt-out ones, and numbers that are nobody's; [(id, text, [looser])]."""
    r = random.Random(seed)
    names, hosts, out = ["ann", "bob.k", "eve_9", "tom"], ["example.com", "mail.org", "post.net"], []

    def number(good):
        digits = [4, *(r.randrange(10) for _ in range(14))]
        check = next(c for c in range(10) if private.luhn("".join(map(str, [*digits, c]))))
        return "".join(map(str, [*digits, check if good else (check + r.randrange(1, 10)) % 10]))

    for i in range(n):
        name, host = r.choice(names), r.choice(hosts)
        phone = f"({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"
        text, looser = r.choice(
            [
                (f"please write to {name}@{host} today", []),
                (f"email {name} [at] {host.replace('.', ' [dot] ')} or not", [f"{name} [at] {host.replace('.', ' [dot] ')}"]),
                (f"call +1 {phone} now", []),
                (f"phone {phone} now", [phone]),
                (f"my card {number(True)} is new", []),
                ("cards " + " ".join(two := [number(True), number(True), number(False)]), two[:2]),
                (f"order {number(False)} was sent", []),
                (f"new +1 {phone} {number(False)} there", [f"+1 {phone}"]),  # the strict form runs over both
                (f"fax +1\n{phone} now", [f"+1\n{phone}"]),
                (f"years 1990 1991 1992 and {r.randrange(100, 999)} 4567 1234", []),
                (f"hash {r.randrange(10**9)}a{number(False)}", []),
                (f"see version {r.randrange(300, 900)}.{r.randrange(9)}.{r.randrange(9)}.{r.randrange(9)} of it", []),
                (f"host {r.randrange(1, 255)}.{r.randrange(255)}.{r.randrange(255)}.{r.randrange(255)} is up", []),
                ("they met at noon. Then at last nothing happened", []),
            ]
        )
        out.append((i, text, looser))
    return out


def test_looser_forms_are_added_and_others_left(spark):
    rows = planted()
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    text = {i: t for i, t, _ in rows}
    added = {r["doc_id"]: [text[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if not s["base"]] for r in private.private_spans(frame).collect()}
    want = {i: looser for i, _, looser in rows}
    hit = sum(len(set(added[i]) & set(want[i])) for i in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    assert sum(len(set(added[i]) - set(want[i])) for i in want) <= 0.02 * len(rows)
    report, _ = private.train(private.scanned(frame))
    assert report["card"]["check"]["against_if_not"] > 0.8 and report["card"]["check"]["for_if_private"] > 0.9


def test_reliabilities_are_recovered():
    """Votes drawn from known reliabilities: the estimates come near, and so do the classes."""
    r = np.random.default_rng(3)
    truth, n = r.random(40_000) < 0.4, 40_000
    right = np.array([0.95, 0.9, 0.7, 0.8, 0.85, 0.6, 0.75])
    silent = r.random((n, 7)) < 0.2
    agree = r.random((n, 7)) < right
    votes = np.where(silent, private.NO_VOTE, np.where(agree == truth[:, None], private.FOR, private.AGAINST))
    packed, back, counts = np.unique((votes * 3 ** np.arange(7)).sum(1), return_inverse=True, return_counts=True)
    p, share, belief = private.reliabilities(private.unpacked(packed), counts.astype(float))
    assert abs(share - 0.4) < 0.03
    assert np.abs(p[1, :, private.FOR] / (1 - p[1, :, private.NO_VOTE]) - right).max() < 0.05
    assert ((belief[back] > 0.5) == truth).mean() > 0.95


def test_redacted():
    t = "mail a@b.cd, 10.0.0.1 ok"
    spans = [(private.KINDS[k], a, b) for a, k, b, _ in private.candidates(t)]
    assert private.redacted(t, spans) == "mail [email], [ip] ok" and private.redacted(None, []) is None


def test_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op12_weak_private_spans(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        told = ",".join(f"{k}:{a}:{b}" for a, _, b, k in plain_spans(t))
        assert got[i]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
    assert sum(r["n_added"] for r in got.values()) <= 5
