"""MinHash near-duplicates by chosen-path set similarity join.

Every document becomes a set of shingle hashes and a sketch of minwise values. Trees branch the
distinct sets by chosen minwise coordinates: sets that share the value of a coordinate share a
node. Small nodes are compared exhaustively on their sketches. Members of large ones are first
linked to a few pivots; what is one component then is done, and the rest branches by further
coordinates or, where that would not shrink it, is compared in pairs of bounded blocks. Pairs that
pass are confirmed on full sets.

A group of copies never becomes all of its pairs: equal sets are one vertex from the start, members
are linked to pivots and centres, and only members that no confirmed link has joined yet are
compared further; a node closes once all of it is one component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, split_by_keys, stored, text_key, texts_of, to_bytes, worker_cache
from .graph import components

#: Minwise values of a sketch; members beyond which a node is never compared in one task; by how
#: many coordinates it branches then at least, and in how many levels at most; pivots of a large
#: node.
COORDINATES, MOST_MEMBERS, BRANCHES, MOST_DEPTH, PIVOTS = 64, 2000, 4, 5, 4
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += np.uint8(32)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A shingle: 128 bits of its words' digests.
SHINGLE = np.dtype([("a", "<u8"), ("b", "<u8")])
_FOLDS = (_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F))


def _set_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct (a, b) in order."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    new = np.append(True, a[1:] != a[:-1])
    if not new.all() and (b[1:] != b[:-1])[~new[1:]].any():
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    out = np.empty(int(new.sum()), SHINGLE)
    out["a"], out["b"] = a[new], b[new]
    return out


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles of `width` words in order; of a text with fewer words its
    whole sequence, of one without words none. Words are what ASCII white space parts, in ASCII
    lower case; a slice's distinct words are digested once."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends_at = np.cumsum([len(t) + 1 for t in texts])
    low, space = _LOWER[joined], _SPACE[joined]
    at = np.nonzero(np.append(True, space[1:] != space[:-1]))[0]
    offsets = np.append(at, len(joined)).astype(np.int32)
    every = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(low)]).dictionary_encode()
    is_word = ~space[at]
    start, code = at[is_word], np.asarray(every.indices)[is_word]
    digests = np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in every.dictionary.to_pylist()]), SHINGLE)
    words = [np.ascontiguousarray(digests[lane])[code] for lane in ("a", "b")]
    n_shingles = max(0, len(code) - width + 1)
    lanes = []
    for word, fold in zip(words, _FOLDS):
        shingle = np.zeros(n_shingles, np.uint64)
        for k in range(width):
            shingle = _mix(shingle * fold + word[k : k + n_shingles])
        lanes.append(shingle)
    out, first = [], 0
    for last in np.searchsorted(start, ends_at).tolist():
        n = last - first
        if n >= width:
            out.append(_set_of(*(lane[first : last - width + 1] for lane in lanes)))
        elif n:
            h = [np.array([n], np.uint64), np.array([n], np.uint64)]
            for k in range(first, last):
                h = [_mix(x * fold + word[k : k + 1]) for x, word, fold in zip(h, words, _FOLDS)]
            out.append(_set_of(*h))
        else:
            out.append(np.zeros(0, SHINGLE))
        first = last
    return out


_SEEDS = np.random.default_rng(20).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * _U(2) + _U(1)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(n, COORDINATES) uint32 minwise values; rows of empty sets mean nothing."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), COORDINATES), np.uint32)
    some = np.nonzero(sizes)[0]
    if len(some):
        every = np.concatenate([sets[i]["a"] for i in some])
        first = np.cumsum(sizes[some]) - sizes[some]
        for k, seed in enumerate(_SEEDS):
            h = every * seed
            h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
            out[some, k] = np.minimum.reduceat((h >> _U(32)).astype(np.uint32), first)
    return out


def _describe(width: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        worker_cache("")
        for part in slices(batches, 1 << 20):
            sets = shingle_sets(to_bytes(part.column(1)), width)
            sig = sketches(sets)
            ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            cols = [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array([x.tobytes() if i else None for x, i in zip(sig, ids)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row_key", "n_shingles", "sid", "sig"])

    return run


def _groups(batches, key: int) -> Iterator[list[tuple]]:
    """Runs of rows alike in column `key`, of a partition sorted by it."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    for _, run in groupby(rows, key=itemgetter(key)):
        yield list(run)


def _near(sig: np.ndarray, n: np.ndarray, least: int, ratio: float) -> np.ndarray:
    """(m, m) numbers of coordinates that agree, 0 where sketch or size rule out the threshold."""
    m = len(n)
    out = np.zeros((m, m), np.uint8)
    for i in range(m - 1):
        same = (sig[i + 1 :] == sig[i]).sum(1)
        small, large = np.minimum(n[i], n[i + 1 :]), np.maximum(n[i], n[i + 1 :])
        out[i, i + 1 :] = np.where((same >= least) & (small >= ratio * large - 1e-9), same, 0)
    return out | out.T


def _members(rows: list[tuple]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Ids, sizes and sketches of a node's rows (node, sid, n, sig, …)."""
    return [r[1] for r in rows], np.array([r[2] for r in rows]), np.frombuffer(b"".join(r[3] for r in rows), np.uint32).reshape(len(rows), -1)


def _stars(least: int, ratio: float):
    """In each node stars over the pairs that pass and are of two components: members hang on the centre that agrees most
    with its neighbours; those that it does not reach go on among themselves, or hang on any
    neighbour. So whoever has a pair that passes is in some pair, and a node gives no more pairs
    than it has members."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, bytes]] = []
        for rows in _groups(batches, 0):
            ids, n, sig = _members(rows)
            near = _near(sig, n, least, ratio)
            comp = np.unique([r[4] for r in rows], return_inverse=True)[1]
            if comp.max() < len(rows) - 1:
                near *= comp[:, None] != comp
            left = near.any(1)
            while left.any():
                at = np.nonzero(left)[0]
                total = near[np.ix_(at, at)].sum(1, dtype=np.int64)
                centre = at[total.argmax()]
                got = np.nonzero((near[centre] > 0) & left)[0]
                if not len(got):  # all that is left knows only members of other stars
                    out += [(ids[int(near[i].argmax())], ids[i]) for i in at.tolist()]
                    break
                out += [(ids[centre], ids[j]) for j in got.tolist()]
                left[got] = False
                left[centre] = False
            if len(out) > 20_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return run


def _likely(least: int, ratio: float):
    """Filters (a, b, two sizes, two sketches) by what the sketches allow."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint32).reshape(b.num_rows, -1) for k in (4, 5))
            n, m = np.asarray(b.column(2)), np.asarray(b.column(3))
            ok = ((x == y).sum(1) >= least) & (np.minimum(n, m) >= ratio * np.maximum(n, m) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    return run


def _undecided(least: int, ratio: float):
    """Members of each node that have a pair that passes and that no component holds yet."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 0):
            ids, n, sig = _members(rows)
            comp = np.unique([r[4] for r in rows], return_inverse=True)[1]
            open_ = ((_near(sig, n, least, ratio) > 0) & (comp[:, None] != comp)).any(1)
            who = [ids[i] for i in np.nonzero(open_)[0].tolist()]
            if who:
                yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]] * len(who), pa.int64()), pa.array(who, pa.binary())], ["node", "sid"])

    return run


def intersections(sets: list[np.ndarray], block: int = 2048) -> np.ndarray:
    """(m, m) sizes of the intersections of sorted sets of distinct hashes."""
    m = len(sets)
    own = np.repeat(np.arange(m), [len(s) for s in sets])
    every = np.concatenate(sets)
    lanes = [np.ascontiguousarray(every[f]) for f in every.dtype.names] if every.dtype.names else [every]
    order = np.lexsort(lanes[::-1])
    new = np.append(True, np.any([x[order][1:] != x[order][:-1] for x in lanes], axis=0))
    column = np.empty(len(every), np.int64)
    column[order] = np.cumsum(new) - 1
    seen = np.bincount(column)
    shared = seen[column] > 1
    rank = np.cumsum(seen > 1) - 1
    own, column = own[shared], rank[column[shared]]
    order = np.argsort(column, kind="stable")
    own, column = own[order], column[order]
    out = np.zeros((m, m), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, block):
        lo, hi = np.searchsorted(column, [at, at + block])
        part = np.zeros((m, block), np.float32)
        part[own[lo:hi], column[lo:hi] - at] = 1
        out += part @ part.T
    return out


def _compared(numerator: int, denominator: int):
    """Rows (node, sid, comp, set) sorted by node: every pair of a node on its full sets, and one
    link for each two components that a pair joins."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 0):
            sets = [np.frombuffer(r[3], SHINGLE) for r in rows]
            comp = np.unique([r[2] for r in rows], return_inverse=True)[1]
            same, n = intersections(sets), np.array([len(x) for x in sets], np.float64)
            found: list[np.ndarray] = []
            for i in range(len(rows)):
                j = np.nonzero((comp > comp[i]) & (denominator * same[i] >= numerator * (n[i] + n - same[i]) - 1e-6))[0]
                if len(j):
                    found.append(np.stack([np.full(len(j), i), j], 1))
            if found:
                pairs = np.concatenate(found)
                key = comp[pairs[:, 0]].astype(np.int64) << 32 | comp[pairs[:, 1]]
                pairs = pairs[np.unique(key, return_index=True)[1]]
                yield _pairs([(rows[i][1], rows[j][1]) for i, j in pairs.tolist()])

    return run


def _pairs(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["a", "b"])


def _confirmed(numerator: int, denominator: int):
    """Rows (group, is_centre, a, sid, set), a group's centre first: links that the full sets bear."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        group, centre, heads, left = None, None, None, b""
        for batch in batches:
            for part in slices([batch], 4 << 20):
                out = []
                for g, first, a, b, raw in zip(*(c.to_pylist() for c in part.columns)):
                    own = np.frombuffer(raw, SHINGLE)
                    if first:
                        group, centre, left = g, own, a
                        heads = np.ascontiguousarray(own["a"])
                        continue
                    if g != group:
                        raise ValueError("a group came without its centre")
                    at = np.minimum(np.searchsorted(heads, own["a"]), len(heads) - 1)
                    same = int(((heads[at] == own["a"]) & (centre["b"][at] == own["b"])).sum())
                    if denominator * same >= numerator * (len(own) + len(centre) - same):
                        out.append((left, b))
                yield _pairs(out)

    return run


def confirm(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int, most: int = 256) -> DataFrame:
    """The pairs (a, b) whose full sets reach numerator / denominator.

    A centre's partners are dealt into groups of about `most`, and its set goes to each group, so
    that a centre with any number of partners is nobody's single task.
    """
    degree = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(degree, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / most)))
    dealt = stored(dealt.withColumn("group", F.xxhash64("a", "salt")).select("a", "b", "group"), "dealt")
    need = dealt.select("group", F.lit(False).alias("is_centre"), "a", F.col("b").alias("sid")).union(dealt.select("group", F.lit(True), "a", "a").distinct())
    rows = need.join(sets, "sid").select("group", "is_centre", "a", "sid", "set")
    ordered = rows.repartition("group", "a").sortWithinPartitions("group", "a", F.desc("is_centre"))
    return ordered.mapInArrow(_confirmed(numerator, denominator), "a binary, b binary")


def _set_rows(width: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1 << 20):
            sets = shingle_sets(to_bytes(part.column(1)), width)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["sid", "set"])

    return run


def _blocks(large: DataFrame) -> DataFrame:
    """(node, sid, comp): members (node, sid, comp) of large nodes again, in a node for each two of
    its blocks, so that every two members of different components meet in one of bounded size.

    Blocks are dealt by hash. A component that fills several has them for itself, and two of those
    never meet; so a node that is one component but for a few members costs about its size.
    """
    half = max(1, MOST_MEMBERS // 2)
    whose = F.coalesce("comp", "sid")
    filled = large.groupBy("node", whose.alias("own")).agg(F.count("*").alias("filled")).filter(F.col("filled") > half).select("node", "own")
    own = stored(filled, "filled").withColumn("apart", F.lit(True))
    put = stored(large.withColumn("own", whose).join(own.hint("merge"), ["node", "own"], "left").withColumn("own", F.when(F.col("apart"), F.col("own")).otherwise(F.lit(b""))).select("node", "sid", "comp", "own"), "put")
    sizes = stored(put.groupBy("node", "own").agg(F.count("*").alias("n")), "sizes")
    salt = F.pmod(F.xxhash64("sid", F.lit(5)), F.ceil(F.col("n") / (0.8 * half)))
    dealt = stored(put.join(sizes.hint("merge"), ["node", "own"]).select("node", "sid", "comp", "own", F.xxhash64("node", "own", salt).alias("block")), "dealt")
    blocks = stored(dealt.select("node", "own", "block").distinct(), "blocks")
    a, b = blocks.select("node", F.col("own").alias("x"), F.col("block").alias("a")), blocks.select("node", F.col("own").alias("y"), F.col("block").alias("b"))
    two = a.join(b, "node").filter((F.col("a") < F.col("b")) & ((F.col("x") != F.col("y")) | (F.col("x") == F.lit(b"")))).select("a", "b", F.xxhash64("a", "b").alias("unit"))
    two = stored(two, "block-pairs")
    sides = two.select(F.col("a").alias("block"), "unit").union(two.select("b", "unit"))
    return dealt.join(sides.hint("merge"), "block").select(F.col("unit").alias("node"), "sid", "comp")


#: How probable it may be that a pair at the threshold shares no leaf.
MOST_MISSED = 1e-6


def _coordinates(trees: int, threshold: float) -> list[list[list[int]]]:
    """For each level below the first, for each tree the coordinates that it branches by: its own
    random order of all but its first, so that no path takes one twice. They are so many that a
    pair at the threshold is missed with a probability of `MOST_MISSED` even if all its nodes are
    large, as far as the sketch has coordinates."""
    levels, differ = MOST_DEPTH - 1, 1 - threshold
    most = (COORDINATES - 1) // levels
    n = next((b for b in range(BRANCHES, most) if (differ + threshold * levels * differ**b) ** trees <= MOST_MISSED), most)
    random = np.random.default_rng(31)
    orders = [random.permutation([k for k in range(COORDINATES) if k != t]).tolist() for t in range(trees)]
    return [[order[d * n : (d + 1) * n] for order in orders] for d in range(levels)]


def _leaves(shape: DataFrame, trees: int, link=None, threshold: float = 0.8) -> DataFrame:
    """Stored (node, sid, comp) of the trees' leaves of two components or more; none has many more
    than `MOST_MEMBERS` members. comp is null where no link is known yet.

    A tree begins with a coordinate of its own. Members of a larger node are linked to pivots by
    `link`, from (node, sid) and the depth to components (v, comp). It branches by further
    coordinates of its tree, down to `MOST_DEPTH`; but where it hardly shrank, or is one component
    with few others, it is compared in blocks at once.
    """
    level = shape.select("sid", "sig", F.lit(None).cast("binary").alias("comp"), F.lit(None).cast("long").alias("was"))
    further = _coordinates(trees, threshold)
    first = F.array(*[F.struct(F.xxhash64(F.lit(0), F.lit(k), F.substring("sig", 4 * k + 1, 4)).alias("node"), F.lit(k).cast("byte").alias("tree")) for k in range(trees)])
    found, children = None, first
    for depth in range(MOST_DEPTH):
        rows = stored(level.select(F.explode(children).alias("x"), "sid", "comp", "was").select("x.node", "x.tree", "sid", "comp", "was"), "nodes")
        # stored, so that the join has a plain exchange on either side and a hot node can be split
        mark = F.xxhash64(F.coalesce("comp", "sid"))
        sizes = stored(rows.groupBy("node").agg(F.count("*").alias("size"), F.min(mark).alias("lo"), F.max(mark).alias("hi")).filter("lo != hi").select("node", "size"), "sizes")
        several = stored(rows.join(sizes.hint("merge"), "node"), "several")
        leaf = several.filter(F.col("size") <= MOST_MEMBERS).select("node", "sid", "comp")
        found = leaf if found is None else found.union(leaf)
        large = several.filter(F.col("size") > MOST_MEMBERS)
        if large.isEmpty():
            return found
        if link:
            labels = link(large.select("node", "sid"), depth)
            large = large.drop("comp").join(labels, large["sid"] == labels["v"], "left").select("node", "tree", "sid", "comp", "was")
        kinds = large.groupBy("node", F.coalesce("comp", "sid").alias("c")).agg(F.count("*").alias("n"))
        mixed = stored(kinds.groupBy("node").agg(F.sum("n").alias("size"), F.max("n").alias("most")).filter("size > most"), "mixed")
        large = stored(large.select("node", "tree", "sid", "comp", "was").join(mixed.hint("merge"), "node"), "large")
        whole = (F.col("size") - F.col("most") <= MOST_MEMBERS) | F.coalesce(2 * F.col("size") > F.col("was"), F.lit(False)) | F.lit(depth == MOST_DEPTH - 1)
        done, rest = large.filter(whole), large.filter(~whole)
        if not done.isEmpty():
            found = found.union(stored(_blocks(done.select("node", "sid", "comp")), "units"))
        if rest.isEmpty():
            return found
        level = rest.join(shape.select("sid", "sig"), "sid").select("node", "tree", "sid", "sig", "comp", F.col("size").alias("was"))
        each = []
        for own in zip(*further[depth]):  # the coordinate of each tree
            k = F.element_at(F.array(*map(F.lit, own)), F.col("tree").cast("int") + 1)
            each.append(F.struct(F.xxhash64("node", k, F.substring(F.col("sig"), 4 * k + 1, F.lit(4))).alias("node"), "tree"))
        children = F.array(*each)
    return found


def link_sets(docs: DataFrame, width: int = 5, numerator: int = 80, denominator: int = 100) -> tuple[DataFrame, DataFrame]:
    """Describes every document and finds the components of the similarity graph.

    Returns (described, labels): described has doc_id, row_key, n_shingles, sid (equal for equal
    sets, null without words); labels has v (a sid) and comp for sids with any link.
    """
    threshold = numerator / denominator
    trees = max(2, math.ceil(math.log(MOST_MISSED) / math.log(1 - threshold))) if threshold < 1 else 2
    least = max(1, int(COORDINATES * (threshold - 5 * math.sqrt(threshold * (1 - threshold) / COORDINATES))))
    base = texts_of(docs).withColumn("row_key", text_key())
    described = stored(base.mapInArrow(_describe(width), "doc_id long, row_key long, n_shingles long, sid binary, sig binary"), "described")
    classes = stored(
        described.filter("sid is not null")
        .groupBy("sid")
        .agg(F.min(F.struct("doc_id", "row_key")).alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")),
        "classes",
    )
    shape = classes.select("sid", "n", "sig")
    sets: DataFrame | None = None
    links: DataFrame | None = None

    def linked(pairs: DataFrame, ends: DataFrame) -> DataFrame:
        """The components once pairs (a, b) are confirmed on the full sets of their ends (sid)."""
        nonlocal sets, links
        new = ends if sets is None else ends.join(sets.select("sid"), "sid", "left_anti")
        wanted = stored(new.join(classes, "sid").select("sid", F.col("rep.doc_id").alias("d"), F.col("rep.row_key").alias("k")), "wanted")
        some, _ = split_by_keys(base, wanted.select(F.col("k").alias("row_key")).distinct())
        texts = some.join(wanted, (some["row_key"] == wanted["k"]) & some["doc_id"].eqNullSafe(wanted["d"])).select("sid", "text")
        more = stored(texts.mapInArrow(_set_rows(width), "sid binary, set binary"), "sets", "lz4")
        sets = more if sets is None else sets.union(more)
        sure = stored(confirm(pairs, sets, numerator, denominator), "links")
        links = sure if links is None else links.union(sure)
        return components(links)

    def ends_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()

    def pivoted(large: DataFrame, depth: int) -> DataFrame:
        """Links members of large nodes to their node's pivots, the same ones in all trees."""
        members = stored(large.join(shape, "sid").select("node", "sid", "n", "sig"), "members")
        order = F.xxhash64("sid", F.lit(depth))
        chosen = members.groupBy("node", F.pmod(order, F.lit(PIVOTS)).alias("part")).agg(F.min(F.struct(order.alias("h"), "sid", "n", "sig")).alias("p"))
        pivots = stored(chosen.select("node", F.col("p.sid").alias("a"), F.col("p.n").alias("an"), F.col("p.sig").alias("asig")), "pivots")
        both = members.join(pivots.hint("merge"), "node").filter("sid != a").select("a", F.col("sid").alias("b"), "an", "n", "asig", "sig")
        pairs = stored(both.mapInArrow(_likely(least, threshold), "a binary, b binary").distinct(), "pairs")
        return linked(pairs, ends_of(pairs))

    nodes = _leaves(shape, trees, pivoted, threshold)

    def ordered(rows: DataFrame) -> DataFrame:
        return rows.repartition("node").sortWithinPartitions("node", "sid")

    leaves = ordered(nodes.join(shape, "sid").select("node", "sid", "n", "sig", F.coalesce("comp", "sid").alias("comp")))
    pairs = stored(leaves.mapInArrow(_stars(least, threshold), "a binary, b binary").distinct(), "pairs")
    ends = ends_of(pairs)
    labels = linked(pairs, ends)
    nodes = nodes.drop("comp")
    known = nodes.join(ends, "sid").join(labels, F.col("sid") == F.col("v"), "left").select("node", "sid", F.coalesce("comp", "sid").alias("comp"))
    mixed = known.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("node")
    mixed = stored(mixed, "mixed")
    open_ = stored(known.join(mixed.hint("merge"), "node"), "open")
    who = ordered(open_.join(shape, "sid").select("node", "sid", "n", "sig", "comp")).mapInArrow(_undecided(least, threshold), "node long, sid binary")
    asked = open_.join(who, ["node", "sid"]).join(sets, "sid").select("node", "sid", "comp", "set")
    more = stored(ordered(asked).mapInArrow(_compared(numerator, denominator), "a binary, b binary"), "links")
    if not more.isEmpty():
        labels = components(links.union(more))
    return described.drop("sig"), labels


def near_duplicates(docs: DataFrame, width: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row, plus row_key.

    Documents are linked where denominator * intersection >= numerator * union of their shingle
    sets; component_id is the least doc_id reachable. A document without words has no shingles
    and is its own component; rows with equal sets are one component; a null doc_id counts as
    after all others, so that a component of null ids alone has a null component_id.
    """
    described, labels = link_sets(docs, width, numerator, denominator)
    own = described.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"))
    placed = own.join(labels, own["sid"] == labels["v"], "left").select("sid", "least", F.coalesce("comp", "sid").alias("comp"))
    heads = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_set = placed.join(heads, "comp").select("sid", "component_id")
    found = described.join(of_set, "sid", "left")
    component = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "row_key")
