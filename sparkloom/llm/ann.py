"""Approximate nearest neighbours by cross-polytope hashing.

Fast Hadamard pseudo-rotations turn unit vectors; a vector's code in a table is the signed axis
nearest to it. Every row is in every table of its shard. A query probes many axes of each table, the
nearer ones with more weight: a row's votes are the query's lengths along the axes that the row is
filed under. Rows with the most votes of a shard, and all that have nearly as many as the query
would give itself, are ranked by exact inner products.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import BLOCK_ROWS, Best, distinct_vectors, for_all_ids, packed, search, usable

#: Tables; the share of signed axes that a query probes in each (all on its own side); the share of a
#: shard's rows that are ranked exactly, how many they are at least, and the share of a query's own
#: votes from which a row always is.
TABLES, PROBED, RANKED, LEAST, NEAR = 32, 0.5, 0.08, 128, 0.7
SHARD_ROWS = 8192
#: Queries whose votes are counted at a time.
ASKED = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; its width is a power of two."""
    x = np.array(x)
    n, d = x.shape
    h = 1
    while h < d:
        pair = x.reshape(n, d // (2 * h), 2, h)
        first, second = pair[:, :, 0], pair[:, :, 1]
        total = first + second
        np.subtract(first, second, out=second)
        first[:] = total
        h *= 2
    x /= np.sqrt(d).astype(x.dtype)
    return x


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Three rounds of random signs and Hadamard, by the table's own seed."""
    signs = np.random.default_rng(1000 + table).choice([-1.0, 1.0], (3, x.shape[1])).astype(x.dtype)
    for s in signs:
        x = hadamard(x * s)
    return x


def lifted(x: np.ndarray, radius: float, even: bool, query: bool) -> np.ndarray:
    """Unit vectors whose inner products order rows as those of the originals do: where norms
    differ, a further component makes up what each lacks of the largest. Padded to a power of 2."""
    width = x.shape[1] + (not even)
    out = np.zeros((len(x), 1 << max(1, (width - 1).bit_length())), np.float32)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    out[:, : x.shape[1]] = x / (np.maximum(norm, 1e-300) if query or even else radius)
    if not even and not query:
        out[:, x.shape[1]] = np.sqrt(np.maximum(0, 1 - (norm[:, 0] / radius) ** 2))
    return out


def narrowed(x: np.ndarray) -> np.ndarray:
    """Half the bytes where single precision holds the same numbers."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float32)
    return half if (half == x).all() else x


def _shard(radius: float, even: bool, tables: int) -> Callable:
    """The index of a shard: in each table, which rows are filed under each signed axis."""

    def build(ids: np.ndarray, x: np.ndarray) -> dict:
        unit, codes = lifted(x, radius, even, False), []
        for t in range(tables):
            y = rotated(unit, t)
            axis = np.abs(y).argmax(1)
            codes.append((2 * axis + (y[np.arange(len(y)), axis] < 0)).astype(np.min_scalar_type(2 * y.shape[1] - 1)))
        return {"ids": ids, "x": narrowed(x), "codes": codes}

    return build


def _block(even: bool, tables: int, probed: float) -> Callable:
    """Queries, and what their weights follow from: these are 32 times as large, so they are not sent."""
    return lambda ids, x: {"ids": ids, "x": narrowed(x), "probes": (even, tables, probed)}


def _weights(block: dict) -> np.ndarray:
    """The weights with which each query probes the axes of each table; 0 for those it does not. They are
    made where a block is first used, once for all shards that it meets there."""
    if "weights" not in block:
        even, tables, probed = block["probes"]
        unit, weights = lifted(block["x"].astype(np.float64), 1.0, even, True), None
        for t in range(tables):
            y = rotated(unit, t)
            both = np.stack([y, -y], 2).reshape(len(y), -1)
            n = max(1, int(probed * both.shape[1]))
            least = np.partition(both, both.shape[1] - n, axis=1)[:, [both.shape[1] - n]]
            if weights is None:
                weights = np.empty((tables, *both.shape), both.dtype)
            weights[t] = np.where(both >= least, both, 0)
        block["weights"] = weights
    return block["weights"]


def candidates(block: dict, shard: dict, q: slice, ranked: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs of some of a block's queries that are worth exact products."""
    weights = _weights(block)[:, q]
    n = len(shard["ids"])
    votes, of_axis = np.zeros((n, weights.shape[1]), np.float32), np.empty((n, weights.shape[1]), np.float32)
    for w, code in zip(weights, shard["codes"]):  # whole rows are taken: all queries' weights of an axis lie side by side
        votes += np.take(np.ascontiguousarray(w.T), code, axis=0, out=of_axis, mode="clip")
    votes = np.ascontiguousarray(votes.T)
    most = max(k, LEAST, int(np.ceil(ranked * n)))
    floor = weights.max(2).sum(0) * NEAR
    if most < n:
        floor = np.minimum(floor, np.partition(votes, n - most, axis=1)[:, n - most])
    else:
        floor = np.full(len(votes), -np.inf, np.float32)
    at, row = np.nonzero(votes >= floor[:, None])
    return at + (q.start or 0), row


def _exact(block: dict, shard: dict, best: Best, q: np.ndarray, j: np.ndarray) -> None:
    """Candidate pairs by score, each summed in one fixed order, so that equal vectors tie."""
    for at in range(0, len(q), 1 << 16):
        a, b = q[at : at + (1 << 16)], j[at : at + (1 << 16)]
        score = np.einsum("ij,ij->i", block["x"][a].astype(np.float64), shard["x"][b].astype(np.float64))
        good = score >= best.floor[a]
        a, b, score = a[good], b[good], score[good]
        order = np.lexsort((shard["ids"][b], -score, a))
        a, b, score = a[order], b[order], score[order]
        rows, first, n = np.unique(a, return_index=True, return_counts=True)
        nth = np.arange(len(a)) - np.repeat(first, n)
        keep = nth < best.k
        s, i = np.full((len(rows), best.k), -np.inf), np.full((len(rows), best.k), np.iinfo(np.int64).max)
        where = np.repeat(np.arange(len(rows)), n)[keep], nth[keep]
        s[where], i[where] = score[keep], shard["ids"][b][keep]
        best.take(rows, s, i)


def _kernel(ranked: float) -> Callable[[dict, dict, Best], None]:
    def run(block: dict, shard: dict, best: Best) -> None:
        for at in range(0, len(block["ids"]), ASKED):
            q, j = candidates(block, shard, slice(at, min(at + ASKED, len(block["ids"]))), ranked, best.k)
            _exact(block, shard, best, q, j)

    return run


def nearest(table: DataFrame, every: int = 20, k: int = 20, tables: int = TABLES, probed: float = PROBED, ranked: float = RANKED) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose vec_id is divisible by `every`, the k rows
    of largest inner product that the index finds, in double precision, ties to the smaller id.

    Rows without id and vectors that are null, empty, zero or hold null or non-finite components
    take no part; shorter vectors count as padded with zeros; rows that repeat an id never answer
    it, and rows alike in both count once. The index is fitted on nothing but the norms' range, and
    indexes every row. A shard gives each query k + 1 candidates at least, or all it has, so that a
    query gets k rows, or all that there are.
    """
    rows = usable(table, allow_zero=False)
    vectors = distinct_vectors(rows)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    width, low, high, most_ids = vectors.agg(F.max(F.size("vec")), F.min(norm), F.max(norm), F.max("n")).first()
    width, high = width or 1, high or 1.0
    even = (low or 1.0) >= 0.999 * high

    def find(reps: DataFrame, queries: DataFrame, most: int, others: int | None) -> DataFrame:
        shards = packed(reps, width, SHARD_ROWS, _shard(high, even, tables), "ann-shards")
        blocks = packed(queries, width, BLOCK_ROWS // 8, _block(even, tables, probed), "ann-queries")
        return search(blocks, shards, _kernel(ranked), most, as_long=False, others=others)

    return for_all_ids(rows, vectors, (most_ids or 0) > 1, every, k, find)
