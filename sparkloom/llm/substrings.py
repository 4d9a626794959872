"""Suffix-array dedup: removes bytes of strings that also start anywhere else in the corpus.

Two equal strings of `length` bytes choose the same anchor: the least-hashed short gram among
those that they hold. So documents emit their anchors with what lies around each, and only
anchors met twice are looked at. Surroundings that are the same at several places, by a digest of
128 bits, are one kind, with a count; one of each kind goes to a shard, where a suffix array by
external induced sorting, with common prefixes, tells which strings are at two places or of a kind
that is; what it finds in a kind holds for all places of the kind. Anchors that follow each other in
some document are one cluster and go to one shard, so that what lies between them is sorted once; a
cluster or a key that too many surroundings have is dealt out further, down to single strings. Every
string lies around an anchor, and all kinds of an anchor meet, so no repeat is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import sized, slices, split_by_keys, stored, text_key, texts_of, to_bytes, worker_cache
from .suffixes import MEMORY, Shelf, suffix_array

LENGTH, GRAM = 400, 128
#: Surroundings of one anchor beyond which they are dealt out by what they share around it; shares
#: of the starts of a string that each such deal has; bytes of text that begin a suffix sort; bytes
#: of text that are hashed at a time.
HOT, DEALS, BLOCK, STEP = 1000, 8, 3 << 18, 1 << 20
#: Bytes that a suffix sort keeps in memory: less than a block's arrays take, the rest is on disk.
SORT_MEMORY = MEMORY // 2
#: One anchor in so many begins a stretch, wherever it stands, so that clusters stay short; rounds in
#: which stretches that share an anchor become one cluster.
CUT, ROUNDS = 8, 2
#: Surroundings that may meet in one task: a larger cluster falls into its anchors, and of a share
#: of a hot anchor with more, bodies alike are counted and single strings compared by digest.
CROWD = 2000
_U = np.uint64
KIND = "struct<anchor:long,around:binary,a:int,b:int,rel:int>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def window_hashes(text: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of `width` bytes, from those of windows half as wide."""
    h, done = _BYTES[text], 1
    while done < width:
        step = min(done, width - done)  # the last step's halves may overlap
        wider = h[:-step] * _U(0xD1342543DE82EF95)
        wider += h[step:]
        wider ^= wider >> _U(29)
        h, done = wider, done + step
    return _mix(h)


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64))


def digest(body: bytes, *more: int) -> bytes:
    return blake2b(body, digest_size=16, salt=b"".join(x.to_bytes(8, "little", signed=True) for x in more)).digest()


def _least_in(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every window of `width`, by windows of doubling width."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(text: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For joined documents that end at `ends`: the place of each anchor, its hash, and the first and
    the last start of the strings that chose it. A string of `length` bytes within a document chooses
    its gram of least hash, the leftmost of several; so each string has one anchor."""
    found: list[tuple[np.ndarray, ...]] = []
    fits = np.ones(len(text), bool)
    for first, end in zip([0, *ends.tolist()], ends.tolist()):
        fits[max(first, end - length + 1) : end] = False
    for low in range(0, max(0, len(text) - length + 1), STEP):
        part = text[low : low + STEP + length - 1]
        own = window_hashes(part, gram)
        ranked = own & _U(0xFFFFFFFF00000000)
        ranked |= np.arange(len(own), dtype=np.uint64)
        chosen = (_least_in(ranked, length - gram + 1) & _U(0xFFFFFFFF)).astype(np.int64)
        inside = np.nonzero(fits[low : low + len(chosen)])[0]
        place = chosen[inside]
        if len(place):
            cut = np.nonzero(np.append(True, place[1:] != place[:-1]))[0]
            found.append((place[cut] + low, own[place[cut]], inside[cut] + low, inside[np.append(cut[1:], len(inside)) - 1] + low))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, value, first, last = (np.concatenate(c) for c in zip(*found))
    cut = np.nonzero(np.append(True, place[1:] != place[:-1]))[0]  # an anchor of two steps is one
    return place[cut], value[cut], first[cut], last[np.append(cut[1:], len(place)) - 1]


def _emit_anchors(length: int, gram: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        worker_cache("")
        for part in slices(batches, STEP):
            texts = to_bytes(part.column(1))
            joined = b"".join(texts)
            ends = np.cumsum([len(t) for t in texts])
            place, value, start, stop = anchors(np.frombuffer(joined, np.uint8), ends, length, gram)
            stop = stop + length
            doc = np.searchsorted(ends, place, side="right")
            first = np.concatenate([[0], ends])[doc]
            view = memoryview(joined)
            around = [blake2b(view[a:b], digest_size=16, salt=p.to_bytes(8, "little")).digest() for a, b, p in zip(start.tolist(), stop.tolist(), (place - start).tolist())]
            ids = part.column(0).take(pa.array(doc))
            keys = part.column(2).take(pa.array(doc))
            cols = [ids, keys, pa.array(value.view(np.int64)), pa.array(around, pa.binary()), pa.array((place - first).astype(np.int32)), pa.array((start - first).astype(np.int32)), pa.array((stop - first).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row_key", "anchor", "around", "place", "start", "stop"])

    return run


SURROUNDINGS = f"key long, doc_id long, row_key long, base int, body binary, kinds array<{KIND}>"
_KIND = pa.struct([("anchor", pa.int64()), ("around", pa.binary()), ("a", pa.int32()), ("b", pa.int32()), ("rel", pa.int32())])


def _cut_surroundings(length: int, gram: int):
    """Rows (doc_id, row_key, text, asked): a document's surroundings of the anchors of one
    cluster, put together where they touch, and in `kinds` those that several places have. Around a
    hot anchor, a row for each share of the starts, keyed by what all strings of the share hold."""
    side = length - gram
    edges = np.linspace(0, side + 1, DEALS + 1).astype(int).tolist()

    def of(x: dict, base: int, first: int, stop: int) -> list[tuple]:
        return [(x["anchor"], x["around"], first - base, stop - base, first - x["start"])] if x["several"] else []

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, STEP):
            out: list[tuple] = []
            for doc_id, key, text, asked in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), to_bytes(part.column(2)), part.column(3).to_pylist()):
                open_: dict[int, list] = {}

                def closed(cluster: int, at: list) -> tuple:
                    return cluster, doc_id, key, at[0], text[at[0] : at[1]], at[2]

                for x in sorted(asked, key=lambda x: (x["start"], x["stop"])):
                    if not x["hot"]:
                        at = open_.get(x["cluster"])
                        if not at or x["start"] > at[1]:
                            if at:
                                out.append(closed(x["cluster"], at))
                            at = open_[x["cluster"]] = [x["start"], x["stop"], []]
                        at[1] = max(at[1], x["stop"])
                        at[2] += of(x, at[0], x["start"], x["stop"])
                        continue
                    for lo, hi in zip(edges[:-1], [e - 1 for e in edges[1:]]):  # starts from place - hi to place - lo
                        first, last = max(x["start"], x["place"] - hi), min(x["place"] - lo, x["stop"] - length)
                        if first > last:
                            continue
                        deal = digest(text[x["place"] - lo : x["place"] - hi + length], x["anchor"], lo)
                        out.append((int.from_bytes(deal[:8], "little", signed=True), doc_id, key, first, text[first : last + length], of(x, first, first, last + length)))
                out += [closed(c, at) for c, at in open_.items()]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(_KIND)]
            cols = list(zip(*out)) if out else [[]] * 6
            cols[5] = [[dict(zip(_KIND.names, k)) for k in ks] for ks in cols[5]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["key", "doc_id", "row_key", "base", "body", "kinds"])

    return run


def shared_starts(bodies: list[bytes], where: np.ndarray, several: list[tuple[int, int, int]], length: int, memory: int = SORT_MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Over joined bodies (a separator after each): where each begins, and True where a string
    starts that is repeated: at two places, or at one that stands for several. `where` tells the
    corpus place of each body's first byte, so that a place seen in two bodies counts once; `several`
    has (body, first, last) of starts that stand for more than one place."""
    sizes = np.array([len(b) for b in bodies])
    first = np.cumsum(sizes + 1) - sizes - 1
    n = int((sizes + 1).sum()) + 1
    shelf = Shelf(memory)
    try:
        text, place = shelf.array(n, np.uint16), shelf.array(n, np.int64)
        valid, found = shelf.array(n, np.bool_), shelf.array(n, np.bool_)
        for body, at, size, base in zip(bodies, first.tolist(), sizes.tolist(), where.tolist()):
            text[at : at + size] = np.frombuffer(body, np.uint8)
            text[at : at + size] += 2
            text[at + size] = 1
            if size >= length:
                valid[at : at + size - length + 1] = True
                place[at : at + size - length + 1] = np.arange(base, base + size - length + 1)
        many_at = shelf.array(n, np.bool_)
        for k, a, b in several:
            many_at[first[k] + a : first[k] + b + 1] = True

        def close(run: np.ndarray, begins: np.ndarray) -> None:
            """Runs of suffixes that share `length` symbols: repeated if they have two places."""
            group = np.zeros(len(run), np.int64)
            group[begins[begins < len(run)]] = 1
            keep = valid[run]
            run, group = run[keep], np.cumsum(group)[keep]
            if not len(run):
                return
            begins = np.nonzero(np.concatenate([[True], group[1:] != group[:-1]]))[0]
            p = place[run]
            many = np.minimum.reduceat(p, begins) != np.maximum.reduceat(p, begins)
            many |= np.logical_or.reduceat(many_at[run], begins)
            found[run[np.repeat(many, np.diff(np.append(begins, len(run))))]] = True

        tail: list[np.ndarray] = []
        for at, lcp in suffix_array(text, length, shelf=shelf):
            starts = np.nonzero(lcp < length)[0]
            if not len(starts):
                tail.append(at)
                continue
            before = sum(map(len, tail))
            close(np.concatenate([*tail, at[: starts[-1]]]), np.concatenate([[0], before + starts[:-1]]))
            tail = [at[starts[-1] :]]
        close(np.concatenate(tail), np.array([0]))
        return first, np.array(found)
    finally:
        shelf.close()


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each stretch of successive places."""
    if not len(starts):
        return []
    cut = np.nonzero(np.diff(starts) > 1)[0]
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.append(cut, len(starts) - 1)].tolist()))


VERDICT = "doc_id long, row_key long, start int, stop int, anchor long, around binary"
_VERDICT = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]


def _verdicts(rows: list[tuple]) -> pa.RecordBatch:
    """Ranges that repeated strings cover: of a document, or of a kind (from where it starts)."""
    cols = list(zip(*rows)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _VERDICT)], ["doc_id", "row_key", "start", "stop", "anchor", "around"])


def _sort_shard(length: int):
    """Rows sorted by key: whole groups are sorted together, in blocks of bounded text unless one
    group alone is larger (what the sort keeps is on disk beyond `SORT_MEMORY`)."""

    def judged(groups: list[list[tuple]]) -> list[tuple]:
        """Of rows with one body each group, the first is sorted; all share what is found."""
        heads = [g[0] for g in groups]
        docs: dict[tuple, int] = {}
        for r in heads:
            docs.setdefault(r[1:3], len(docs))
        several = [(k, 0, len(g[0][4]) - length) for k, g in enumerate(groups) if len({r[1:4] for r in g}) > 1]
        several += [(k, x["a"], x["b"] - length) for k, g in enumerate(groups) for r in g for x in r[5]]
        first, found = shared_starts([r[4] for r in heads], np.array([docs[r[1:3]] << 40 | r[3] for r in heads], np.int64), several, length)
        out: list[tuple] = []
        for at, group in zip(first.tolist(), groups):
            runs = _runs(np.nonzero(found[at : at + len(group[0][4])])[0])
            for _, doc_id, key, base, _, kinds in group:
                out += [(doc_id, key, base + a, base + b + length, None, None) for a, b in runs]
                for x in kinds:
                    own = [(max(a, x["a"]), min(b + length, x["b"])) for a, b in runs]
                    out += [(None, None, a - x["a"] + x["rel"], b - x["a"] + x["rel"], x["anchor"], x["around"]) for a, b in own if b - a >= length]
        return out

    def run(batches) -> Iterator[pa.RecordBatch]:
        worker_cache("")
        held: list[list[tuple]] = []
        size = 0
        every = (row for part in slices(batches, STEP) for row in zip(*(c.to_pylist() for c in part.columns)))
        for _, group in groupby(every, key=lambda r: r[0]):
            bodies: dict[bytes, list[tuple]] = {}
            for r in group:
                bodies.setdefault(r[4], []).append(r)
            held += bodies.values()
            size += sum(len(b) + 1 for b in bodies)
            if size >= BLOCK:
                yield _verdicts(judged(held))
                held, size = [], 0
        yield _verdicts(judged(held) if held else [])

    return run


def _single_strings(length: int):
    """Rows (doc_id, row_key, base, body) to the digest of each string of `length` bytes, and where
    it starts."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        worker_cache("")
        for part in slices(batches, 1 << 18):
            bodies = part.column(3).to_pylist()
            n = np.maximum(np.array([len(b) for b in bodies]) - length + 1, 0)
            own = np.repeat(np.arange(len(bodies)), n)
            offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            value = [digest(memoryview(b)[i : i + length]) for b in bodies for i in range(len(b) - length + 1)]
            base = np.asarray(part.column(2))[own] + offset
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays([pa.array(value, pa.binary()), part.column(0).take(take), part.column(1).take(take), pa.array(base.astype(np.int32))], ["string", "doc_id", "row_key", "start"])

    return run


def crowded_spans(rows: DataFrame, length: int) -> DataFrame:
    """What `_sort_shard` finds, for surroundings of keys that too many have: bodies alike are one
    from partial sums on, and single strings of the different ones are grouped by digest, so that
    neither waits for one task. All strings of a body that two places have are repeated."""
    rows = rows.withColumn("alike", F.sha2("body", 256))
    kinds = stored(rows.groupBy("key", "alike").agg(F.count("*").alias("n"), F.first(F.struct("doc_id", "row_key", "base", "body")).alias("one")), "bodies")
    several = stored(kinds.filter("n > 1").select("key", "alike"), "bodies-alike")
    none = (F.lit(None).cast("long").alias("anchor"), F.lit(None).cast("binary").alias("around"))
    nobody = (F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("row_key"))
    own = ("doc_id", "row_key", F.col("base").alias("start"), (F.col("base") + F.length("body")).alias("stop"), *none)
    whole = rows.join(several.hint("merge"), ["key", "alike"]).select(*own)
    of_kinds = rows.filter(F.size("kinds") > 0).select("doc_id", "row_key", "base", "body", F.explode("kinds").alias("k"))
    whole = whole.union(of_kinds.select(*own)).union(of_kinds.select(*nobody, F.col("k.rel").alias("start"), (F.col("k.rel") + F.col("k.b") - F.col("k.a")).alias("stop"), "k.anchor", "k.around"))
    singles = stored(kinds.select("one.*").mapInArrow(_single_strings(length), "string binary, doc_id long, row_key long, start int"), "strings")
    place = F.struct("doc_id", "row_key", "start")
    again = stored(singles.groupBy("string").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("not (lo <=> hi)").select("string"), "strings-again")
    found = singles.join(again.hint("merge"), "string").select("doc_id", "row_key", "start", (F.col("start") + length).alias("stop"), *none)
    return whole.union(found)


def clustered(asked: DataFrame, length: int) -> DataFrame:
    """Adds `cluster`, the same for all places of an anchor, and often for anchors that follow each
    other: a stretch of a document takes the least of its anchors, an anchor the least of its
    stretches, and so on. Any such choice gives right results; further rounds only sort less text.
    A group is as long as a stretch, or has as many rows as an anchor that is not hot."""
    before = W.partitionBy("doc_id", "row_key").orderBy("place", "anchor")
    gap = F.coalesce(F.col("place") - F.lag("place").over(before) >= length, F.lit(True)) | (F.pmod("anchor", F.lit(CUT)) == 0)
    plain = asked.filter("not hot").withColumn("gap", gap.cast("int")).withColumn("stretch", F.sum("gap").over(before)).drop("gap")
    plain = plain.withColumn("cluster", F.col("anchor"))
    for _ in range(ROUNDS):
        plain = plain.withColumn("cluster", F.min("cluster").over(W.partitionBy("doc_id", "row_key", "stretch")))
        plain = plain.withColumn("cluster", F.min("cluster").over(W.partitionBy("anchor")))
    return plain.drop("stretch").unionByName(asked.filter("hot").withColumn("cluster", F.col("anchor")))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """(doc_id, row_key, start, stop): byte ranges of documents that repeated strings cover; they
    may overlap. `docs` has doc_id, text, row_key."""
    gram = gram or max(1, min(GRAM, length // 4))
    emitted = docs.mapInArrow(_emit_anchors(length, gram), "doc_id long, row_key long, anchor long, around binary, place int, start int, stop int")
    every = stored(emitted, "anchors")
    # stored, so that the join has a plain exchange on either side and a hot anchor can be split
    common = stored(every.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "common")
    met = stored(every.join(common.hint("merge"), "anchor"), "met")
    kinds = stored(met.groupBy("anchor", "around").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row_key", "place", "start", "stop")).alias("one")), "kinds")
    many = stored(kinds.groupBy("anchor").agg(F.count("*").alias("m")).filter(F.col("m") > HOT).select("anchor"), "hot").withColumn("hot", F.lit(True))
    asked = stored(kinds.join(sized(many), "anchor", "left").select("anchor", "around", (F.col("n") > 1).alias("several"), F.coalesce("hot", F.lit(False)).alias("hot"), "one.*"), "asked")
    placed = stored(clustered(asked, length), "placed")
    wide = placed.filter("not hot").groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("cluster")
    wide = stored(wide, "wide-clusters").withColumn("wide", F.lit(True))
    ask = F.struct("anchor", "hot", "place", "start", "stop", F.when(F.col("wide"), F.col("anchor")).otherwise(F.col("cluster")).alias("cluster"), "several", F.when(F.col("several"), F.col("around")).alias("around"))
    of_doc = stored(
        placed.join(sized(wide), "cluster", "left").groupBy(F.col("doc_id").alias("d"), F.col("row_key").alias("k")).agg(F.collect_list(ask).alias("asked")),
        "asked-of",
    )
    wanted, _ = split_by_keys(docs, of_doc.select(F.col("k").alias("row_key")).distinct())
    one = wanted.dropDuplicates(["doc_id", "row_key"])
    texts = one.join(of_doc, (one["row_key"] == of_doc["k"]) & one["doc_id"].eqNullSafe(of_doc["d"])).select("doc_id", "row_key", "text", "asked")
    around = texts.mapInArrow(_cut_surroundings(length, gram), SURROUNDINGS)

    def judged(rows: DataFrame) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_sort_shard(length), VERDICT)

    if many.isEmpty():
        verdicts = judged(around)
    else:
        around = stored(around, "around")
        crowded = stored(around.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("key"), "crowded")
        dense, plain = split_by_keys(around, crowded, "key")
        verdicts = judged(plain).union(crowded_spans(dense, length))
    verdicts = stored(verdicts, "verdicts")
    of_kinds = verdicts.filter("around is not null").select("anchor", "around", F.col("start").alias("a"), F.col("stop").alias("b"))
    places = met.join(of_kinds.hint("merge"), ["anchor", "around"]).select("doc_id", "row_key", (F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("b")).alias("stop"))
    return verdicts.filter("around is null").select("doc_id", "row_key", "start", "stop").union(places)


def _kept(batches) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, spans): what is left of each text, and figures of what went."""
    for part in slices(batches, 4 << 20):
        out: list[tuple] = []
        spans_col = part.column(2).to_pylist() if part.num_columns > 2 else [None] * part.num_rows
        for doc_id, text, spans in zip(part.column(0).to_pylist(), to_bytes(part.column(1)), spans_col):
            at, kept, removed, runs, end = 0, [], 0, 0, -1
            for s in sorted(spans or [], key=lambda s: s["start"]):
                if s["start"] > end:
                    runs += 1
                    kept.append(text[at : s["start"]])
                if s["stop"] > end:
                    end = at = s["stop"]
            kept.append(text[at:])
            left = b"".join(kept)
            removed = len(text) - len(left)
            out.append((doc_id, len(text), removed, runs, hashlib.sha256(left).hexdigest(), left))
        cols = list(zip(*out)) if out else [[]] * 6
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, plus the remaining bytes
    as `kept` if asked for.

    Each byte goes that is covered by a string of `length` bytes which also starts anywhere else,
    the same document included, judged on the input. A null text is empty; texts shorter than
    `length` stay whole; repeated rows are copies of each other and go whole if long enough; a
    null doc_id is a value like others. What is left of a text may cut a character in two.
    """
    base = texts_of(docs).withColumn("row_key", text_key())
    spans = repeated_spans(base, length)
    per = stored(
        spans.groupBy(F.col("doc_id").alias("d"), F.col("row_key").alias("k")).agg(F.collect_list(F.struct("start", "stop")).alias("spans")),
        "spans",
    )
    touched, clean = split_by_keys(base, per.select(F.col("k").alias("row_key")).distinct())
    joined = touched.join(per, (touched["row_key"] == per["k"]) & touched["doc_id"].eqNullSafe(per["d"]), "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = joined.mapInArrow(_kept, schema).union(clean.select("doc_id", "text").mapInArrow(_kept, schema))
    return out if with_text else out.drop("kept")
