"""Top-k search of a stated query set against all rows, in blocks.

Vectors that are the same are one: each distinct vector is searched, and asked, once, and stands for
its ids in the end. Distinct vectors are packed into shards of bounded size, queries into blocks; a
task takes one block and streams one stripe of shards past it, keeping each query's k best. A part is
searched first, and the k-th scores it finds are floors for all others; where shards tell how far
they reach, the first are the best guesses, and then only those that may pass a floor. What moves are blocks
and shards, some thousand rows in one; the answer of a block and stripe is one packed row.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, stored, worker_cache

SHARD_ROWS, BLOCK_ROWS = 4096, 8192
#: Shards of a stripe at least, and stripes at most.
STRIPE, STRIPES = 2, 256
#: Bounds of shards that are sent to all tasks at a time: 64 components and a radius are some 40 MB.
SENT = 1 << 16
#: Parquet looks at a row group's size after 100 rows by default; these rows are some MB each.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", allow_zero: bool = True) -> DataFrame:
    """(vec_id, vec) of rows that can take part: an id, and a vector that is not null or empty and
    holds no null and no non-finite component; without allow_zero not all zeros either."""
    vec = F.col(vector_col).cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0))
    rows = rows.filter(~F.coalesce(F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)))
    return rows if allow_zero else rows.filter(F.exists("vec", lambda x: x != 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones padded with zeros."""
    flat, sizes = np.asarray(column.flatten(), np.float64), np.asarray(pa.compute.list_value_length(column))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def packed(rows: DataFrame, width: int, most: int, build: Callable[[np.ndarray, np.ndarray], object], name: str) -> tuple[DataFrame, int]:
    """Stored (no, body): at most `most` rows of a partition in each, as `build(ids, vectors)` has
    them, numbered from 0, and how many there are. The numbering collects one number for each."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        worker_cache("")
        part, k, ids, vecs, held = TaskContext.get().partitionId(), 0, [], [], 0

        def emit() -> pa.RecordBatch:
            body = pickle.dumps(build(np.concatenate(ids), np.concatenate(vecs)), protocol=5)
            return pa.RecordBatch.from_arrays([pa.array([part << 24 | k], pa.int64()), pa.array([body], pa.binary())], ["at", "body"])

        for b in batches:
            for at in range(0, b.num_rows, most):
                piece = b.slice(at, min(most, b.num_rows - at))
                if held and held + piece.num_rows > most:
                    yield emit()
                    k, ids, vecs, held = k + 1, [], [], 0
                ids.append(np.asarray(piece.column(0)))
                vecs.append(_matrix(piece.column(1), width))
                held += piece.num_rows
        if held:
            yield emit()

    bound_batches(rows.sparkSession)
    got = stored(rows.mapInArrow(run, "at long, body binary"), name, options=LARGE_ROWS)
    order = [(r["at"], i) for i, r in enumerate(got.select("at").orderBy("at").collect())]
    numbers = got.sparkSession.createDataFrame(order, "at long, no int")
    return got.join(F.broadcast(numbers), "at").select("no", "body"), len(order)


NOBODY = np.iinfo(np.int64).max


class Best:
    """The k best (score, id) of each query of a block: highest score first, then least id. Scores
    are doubles, or whole numbers that are never rounded."""

    def __init__(self, n: int, k: int, kind: type = np.float64):
        self.none = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
        self.k, self.score, self.id = k, np.full((n, k), self.none, kind), np.full((n, k), NOBODY)
        self.floor = np.full(n, self.none, kind)

    def take(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of the queries in `rows`: score (len(rows), m), `none` for none; ids (m,) or alike."""
        ok = (score >= self.floor[rows][:, None]) & (score > self.none)
        hit = ok.any(1)
        if not hit.any():
            return
        rows, score, ok = rows[hit], score[hit], ok[hit]
        ids = np.broadcast_to(ids, ok.shape) if ids.ndim == 1 else ids[hit]
        s = np.concatenate([self.score[rows], np.where(ok, score, self.none)], 1)
        i = np.concatenate([self.id[rows], np.where(ok, ids, NOBODY)], 1)
        order = np.lexsort((i, -s if s.dtype.kind == "f" else ~s), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        self.floor[rows] = np.maximum(self.floor[rows], self.score[rows, -1])


def _searched(k: int, kernel: Callable[[dict, object, Best], None], number: type):
    """Sorted rows (block, stripe, kind, body): a block (kind 0), its floors if any (1), shards (2)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        key, block, best = None, None, None

        def done() -> pa.RecordBatch:
            body = pickle.dumps((block["ids"], best.score, best.id), protocol=5)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([body], pa.binary())], ["block", "body"])

        for b in batches:
            for no, stripe, kind, body in zip(*(c.to_pylist() for c in b.columns)):
                got = pickle.loads(body)
                if kind == 0:
                    if best is not None:
                        yield done()
                    key, block, best = (no, stripe), got, Best(len(got["ids"]), k, number)
                elif kind == 1:
                    best.floor = np.maximum(best.floor, got)
                else:
                    kernel(block, got, best)
        if best is not None:
            yield done()

    return run


def _merged(k: int, number: type, others: int | None):
    """Answers of a block, over its stripes: ranked rows, or with `others` so many that are not the
    query itself."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        key, ids, best = None, None, None

        def done() -> pa.RecordBatch:
            held = best.id != NOBODY
            if others is not None:
                held &= best.id != ids[:, None]
                held &= np.cumsum(held, 1) <= others
            q, r = np.nonzero(held)
            rank = np.cumsum(held, 1)[q, r]
            return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(rank, pa.int32()), pa.array(best.id[q, r]), pa.array(best.score[q, r])], ["query_id", "rank", "vec_id", "score"])

        for b in batches:
            for no, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own, score, found = pickle.loads(body)
                if no != key:
                    if best is not None:
                        yield done()
                    key, ids, best = no, own, Best(len(own), k, number)
                best.take(np.arange(len(own)), score, found)
        if best is not None:
            yield done()

    return run


def search(blocks: tuple[DataFrame, int], shards: tuple[DataFrame, int], kernel: Callable[[dict, object, Best], None], k: int, as_long: bool, reach: Callable | None = None, bounds: DataFrame | None = None, others: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): every block against every shard by `kernel`, which gives
    its candidates to a `Best`. With `reach` and `bounds` (no, body), a small row for each shard, a
    block first gets the shards that are the best guess of some query, then those that may pass the
    floors which these have set; without, a stripe sets floors for all others."""
    number, kind = (np.int64, "long") if as_long else (np.float64, "double")
    (blocks, n_blocks), (shards, n_shards) = blocks, shards
    if not n_blocks or not n_shards:
        return blocks.sparkSession.createDataFrame([], f"query_id long, rank int, vec_id long, score {kind}")
    stripes = max(1, min(STRIPES, n_shards // STRIPE))

    def run(first: int, last: int, floors: DataFrame | None, routes: DataFrame | None) -> DataFrame:
        own = blocks.select(F.col("no").alias("block"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("stripe"), F.lit(0).alias("kind"), "body")
        at = shards.withColumn("stripe", F.pmod("no", F.lit(stripes))).filter(F.col("stripe").between(first, last))
        if routes is None:
            sent = at.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "stripe", F.lit(2), "body")
        else:
            sent = at.join(routes, "no").select("block", "stripe", F.lit(2), "body")
        if floors is not None:
            own = own.union(floors.select("block", F.explode(F.sequence(F.lit(first), F.lit(last))), F.lit(1), "body"))
        if routes is not None:
            own = own.join(routes.select("block", F.pmod("no", F.lit(stripes)).alias("stripe")).distinct(), ["block", "stripe"], "left_semi")
        every = own.union(sent)
        tasks = min(2000, n_blocks * (last - first + 1))
        ordered = every.repartition(tasks, "block", "stripe").sortWithinPartitions("block", "stripe", "kind")
        return stored(ordered.mapInArrow(_searched(k, kernel, number), "block int, body binary"), "found")

    if reach and stripes > 1:
        guessed = _routes(blocks, None, bounds, n_shards, reach)
        pilot = run(0, stripes - 1, None, guessed)
        floors = _floors(pilot, k, number)
        rest = _routes(blocks, floors, bounds, n_shards, reach).join(guessed, ["block", "no"], "left_anti")
        found = pilot.union(run(0, stripes - 1, floors, stored(rest, "routes")))
    else:
        found = pilot = run(0, 0, None, None)
        if stripes > 1:
            found = pilot.union(run(1, stripes - 1, _floors(pilot, k, number), None))
    return found.repartition("block").sortWithinPartitions("block").mapInArrow(_merged(k, number, others), f"query_id long, rank int, vec_id long, score {kind}")


def _floors(found: DataFrame, k: int, number: type) -> DataFrame:
    """Stored (block, body): the k-th best score of each of a block's queries so far."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        key, best = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([pickle.dumps(best.floor, protocol=5)], pa.binary())], ["block", "body"])

        for b in batches:
            for no, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own, score, ids = pickle.loads(body)
                if no != key:
                    if best is not None:
                        yield done()
                    key, best = no, Best(len(own), k, number)
                best.take(np.arange(len(own)), score, ids)
        if best is not None:
            yield done()

    return stored(found.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, body binary"), "floors")


def _routes(blocks: DataFrame, floors: DataFrame | None, bounds: DataFrame, n_shards: int, reach: Callable) -> DataFrame:
    """Stored (block, no): the shards that `reach` names for a block, given its floors if there are
    any. Bounds go to all tasks in parts of bounded size."""
    asked = blocks.select("no", "body", F.lit(None).cast("binary").alias("floor"))
    if floors is not None:
        asked = blocks.join(floors.select(F.col("block").alias("no"), F.col("body").alias("floor")), "no").select("no", "body", "floor")
    out = None
    for low in range(0, n_shards, SENT):
        part = sorted((r["no"], bytes(r["body"])) for r in bounds.filter(F.col("no").between(low, low + SENT - 1)).collect())
        shared = blocks.sparkSession.sparkContext.broadcast((np.array([no for no, _ in part]), [pickle.loads(b) for _, b in part]))

        def run(batches, shared=shared) -> Iterator[pa.RecordBatch]:
            numbers, own = shared.value
            for b in batches:
                for no, body, floor in zip(*(c.to_pylist() for c in b.columns)):
                    got = numbers[reach(pickle.loads(body), None if floor is None else pickle.loads(floor), own)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), no), pa.int32()), pa.array(got, pa.int32())], ["block", "no"])

        made = asked.mapInArrow(run, "block int, no int")
        out = made if out is None else out.union(made)
    return stored(out, "routes")


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """Stored (vec, rep, n): each distinct vector, its least vec_id and its number of rows, from
    partial sums; a vector that a third of all rows share is one row of each task."""
    return stored(rows.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors")


def for_all_ids(rows: DataFrame, vectors: DataFrame, shared: bool, every: int, k: int, find: Callable[[DataFrame, DataFrame, int, int | None], DataFrame]) -> DataFrame:
    """`find(rows, queries, k + 1, …)` on distinct vectors (vec_id, vec), for the ids they stand for;
    where none is `shared` by several ids, that is all.

    Of equal scores the least ids count, so the k + 1 best vectors, and of each its k + 1 least ids,
    hold the k best rows of any query, itself left out. Rows alike in id and vector count once.
    """
    reps = vectors.select(F.col("rep").alias("vec_id"), "vec")
    if not shared:
        return find(reps, reps.filter(F.pmod("vec_id", F.lit(every)) == 0), k + 1, k)
    alone = vectors.filter("n = 1").select("rep", F.col("rep").alias("id"))
    several = vectors.filter("n > 1").select("vec", "rep")
    ids = stored(rows.join(several.hint("merge"), "vec").select("rep", F.col("vec_id").alias("id")).distinct(), "shared-ids")
    least = ids.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (("rep", "salt"), ("rep",)):  # in 64 parts first: one vector may have very many ids
        least = least.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy("id"))).filter(F.col("r") <= k + 1)
    asks = stored(alone.union(ids).filter(F.pmod("id", F.lit(every)) == 0).select("rep", F.col("id").alias("query_id")), "asks")
    queries = reps.join(asks.select(F.col("rep").alias("vec_id")).distinct(), "vec_id", "left_semi")
    hits = find(reps, queries, k + 1, None).select(F.col("query_id").alias("rep"), F.col("vec_id").alias("hit"), "score")
    best = W.partitionBy("rep").orderBy(F.desc("score"), "id")
    each = hits.join(least.select(F.col("rep").alias("hit"), "id"), "hit", "left").select("rep", "score", F.coalesce("id", "hit").alias("id"))
    each = stored(each.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r"), "answers")
    out = asks.join(each.hint("merge"), "rep").filter("id != query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.select("query_id", rank.alias("rank"), F.col("id").alias("vec_id"), "score").filter(F.col("rank") <= k)
