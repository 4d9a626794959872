"""Exact top-k inner products by ball-tree branch and bound in every shard.

Rows are first dealt to cells of a coarse tree over a bounded sample, so that shards, and the balls
above them, are as narrow as the data let them be; bounds are those of the rows themselves, so the
sample decides nothing but speed. A block of queries gets the shards whose ball may hold a score
above the k-th best of one of its queries, and visits their nodes by upper bound.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import BLOCK_ROWS, SHARD_ROWS, Best, _matrix, distinct_vectors, for_all_ids, packed, search, usable

#: Rows of a leaf; cells of the coarse tree and rows that it is fitted on, at most.
LEAF, CELLS, SAMPLE = 64, 1024, 16_384


def ball_tree(ids: np.ndarray, x: np.ndarray) -> dict:
    """Rows in leaf order, and the nodes above them: bounds, centre, radius, left child (its
    right sibling follows; -1 for a leaf). A node splits at the median of its projection on the
    line between two far points."""
    order = np.arange(len(x))
    bounds, centres, radii, left = [(0, len(x))], [None], [0.0], [-1]
    k = 0
    while k < len(bounds):
        lo, hi = bounds[k]
        own = x[order[lo:hi]]
        centre = own.mean(0)
        away = ((own - centre) ** 2).sum(1)
        centres[k], radii[k] = centre, float(np.sqrt(away.max()))
        if hi - lo > LEAF and radii[k] > 0:
            a = own[away.argmax()]
            b = own[((own - a) ** 2).sum(1).argmax()]
            half = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(own @ (b - a), half)]
            left[k] = len(bounds)
            for part in ((lo, lo + half), (lo + half, hi)):
                bounds.append(part)
                centres.append(None)
                radii.append(0.0)
                left.append(-1)
        k += 1
    return {"ids": ids[order], "x": x[order], "bounds": bounds, "centres": np.array(centres), "radii": np.array(radii), "left": left}


def coarse_tree(x: np.ndarray, cells: int) -> list[tuple[np.ndarray, float] | None]:
    """Cuts of a tree with `cells` leaves at most (a power of two), as a heap: node i parts into
    2i + 1 and 2i + 2 by whether a row's projection passes a threshold; None is not cut."""
    cuts: list[tuple[np.ndarray, float] | None] = []
    parts: list[np.ndarray | None] = [np.arange(len(x))]
    while len(parts) < 2 * cells - 1:
        own = parts[len(cuts)]
        cut = None
        if own is not None and len(own) > 1:
            centre = x[own].mean(0)
            a = x[own][((x[own] - centre) ** 2).sum(1).argmax()]
            b = x[own][((x[own] - a) ** 2).sum(1).argmax()]
            along = x[own] @ (b - a)
            cut = (b - a, float(np.median(along)))
            right = along > cut[1]
            parts += [own[~right], own[right]]
        else:
            parts += [own, None]
        cuts.append(cut)
    return cuts


def cells_of(x: np.ndarray, cuts: list[tuple[np.ndarray, float] | None]) -> np.ndarray:
    """The leaf of each row, numbered from left to right."""
    at = np.zeros(len(x), np.int64)
    for node, cut in enumerate(cuts):
        own = np.nonzero(at == node)[0]
        if len(own):
            at[own] = 2 * node + 1 + ((x[own] @ cut[0] > cut[1]) if cut else 0)
    return at - len(cuts)


def _shard(ids: np.ndarray, x: np.ndarray) -> dict:
    return ball_tree(ids, x)


def _block(ids: np.ndarray, x: np.ndarray) -> dict:
    return {"ids": ids, "x": x}


def _reach(block: dict, floor: np.ndarray | None, balls: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """True for balls that may hold a score not below some query's floor; without floors, for the
    two of each query whose centres score highest: one may have fewer rows than a floor takes."""
    q, out = block["x"], np.zeros(len(balls), bool)
    size = np.linalg.norm(q, axis=1)[:, None]
    top, guess = np.full((len(q), 2), -np.inf), np.zeros((len(q), 2), np.int64)
    for at in range(0, len(balls), 512):
        part = balls[at : at + 512]
        middle = q @ np.array([c for c, _ in part]).T
        if floor is None:
            score = np.concatenate([top, middle], 1)
            who = np.concatenate([guess, np.broadcast_to(np.arange(at, at + len(part)), middle.shape)], 1)
            best = np.argsort(-score, axis=1, kind="stable")[:, :2]
            top, guess = np.take_along_axis(score, best, 1), np.take_along_axis(who, best, 1)
            continue
        upper = middle + size * np.array([r for _, r in part])
        upper += 1e-9 * (1 + np.abs(upper))
        out[at : at + 512] = (upper >= floor[:, None]).any(0)
    if floor is None:
        out[guess.ravel()] = True
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: by doubles where these hold them, else by whole numbers, and
    an error where a long cannot."""
    most = (np.abs(a).max(initial=0)) * (np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most >= 2**63 and (np.abs(a) @ np.abs(b).T).max() * (1 + 1e-9) >= 2**63:
        raise OverflowError("an inner product may pass 2^63")
    return a.astype(np.int64) @ b.astype(np.int64).T


def _kernel(block: dict, tree: dict, best: Best) -> None:
    """Nodes by their largest upper bound first; a query leaves a node whose bound is below its
    current k-th score, which leaves of this and of earlier shards have raised."""
    q = block["x"]
    upper = q @ tree["centres"].T + np.linalg.norm(q, axis=1)[:, None] * tree["radii"]
    upper += 1e-9 * (1 + np.abs(upper))
    queue = [(-float(upper[:, 0].max()), 0, np.arange(len(q)))]
    while queue:
        _, node, asks = heapq.heappop(queue)
        asks = asks[upper[asks, node] >= best.floor[asks]]
        if not len(asks):
            continue
        child = tree["left"][node]
        if child < 0:
            lo, hi = tree["bounds"][node]
            for at in range(lo, hi, 4 * LEAF):
                ids = tree["ids"][at : min(hi, at + 4 * LEAF)]
                score = _scores(q[asks], tree["x"][at : at + len(ids)])
                best.take(asks, score, ids)
        else:
            for c in (child, child + 1):
                heapq.heappush(queue, (-float(upper[asks, c].max()), c, asks))


def exact_top(table: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score long): vectors as floor(64 * x), x as double; for rows whose
    vec_id is divisible by `every`, the k other rows of highest inner product, ties to the smaller
    id, fewer where there are fewer.

    Rows without id and vectors that are null, empty or hold null or non-finite components take
    no part; shorter vectors count as padded with zeros; rows that repeat an id never answer it.
    Sums that may pass 2^63 raise an error.
    """
    rows = usable(table)
    floored = rows.withColumn("vec", F.transform("vec", lambda x: F.floor(64 * x).cast("double")))
    vectors = distinct_vectors(floored)
    width, n, most_ids = vectors.agg(F.max(F.size("vec")), F.count("*"), F.max("n")).first()
    width = width or 1

    def find(reps: DataFrame, queries: DataFrame, most: int, others: int | None) -> DataFrame:
        ordered = clustered(reps, width, n)
        shards = packed(ordered, width, SHARD_ROWS, _shard, "ball-trees")
        blocks = packed(queries, width, BLOCK_ROWS, _block, "top-queries")
        return search(blocks, shards, _kernel, most, as_long=True, reach=_reach, bounds=balls(shards[0]), others=others)

    return for_all_ids(floored, vectors, (most_ids or 0) > 1, every, k, find)


def balls(shards: DataFrame) -> DataFrame:
    """(no, body): centre and radius of each shard's tree."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees = [pickle.loads(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pickle.dumps((t["centres"][0], float(t["radii"][0]))) for t in trees], pa.binary())], ["no", "body"])

    return shards.select("no", "body").mapInArrow(run, "no int, body binary")


def clustered(rows: DataFrame, width: int, n: int) -> DataFrame:
    """(vec_id, vec) in partitions by ranges of coarse cells, so that what is packed together lies
    together. The tree is fitted on `SAMPLE` rows at most, the first by the hash of their id."""
    if n <= SHARD_ROWS:
        return rows
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    sample = np.zeros((len(got), width))
    for r, row in zip(sample, got):
        r[: len(row["vec"])] = row["vec"]
    cells = min(CELLS, 1 << max(1, (n // SHARD_ROWS).bit_length()))
    shared = rows.sparkSession.sparkContext.broadcast(coarse_tree(sample, cells))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = cells_of(_matrix(b.column(1), width), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], ["vec_id", "vec", "cell"])

    dealt = rows.select("vec_id", "vec").mapInArrow(run, "vec_id long, vec array<double>, cell long")
    return dealt.repartitionByRange("cell", F.xxhash64("vec_id")).sortWithinPartitions("cell", "vec_id").select("vec_id", "vec")
