"""Best-fit packing by patterns of few pieces, fitted to the histogram of lengths.

All that the driver holds is the histogram, with a bin for each length up to the capacity, and a
plan in runs: a run says that pieces of one length, from one rank to another, go to successive
sequences at one offset. Both are bounded by the capacity, whatever the corpus holds.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import gathered, stored, text_key, texts_of, to_bytes
from .tokens import MOST_WORDS, encoder

CAPACITY, END_ID = 2048, 0
#: Pieces of one length that are ranked in one task, about; buckets of a length at most, so that the
#: driver holds some million counts at any size.
RANKED, MOST_BUCKETS = 200_000, 1 << 20
PIECES = "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long"


def enumerate_patterns(lengths: np.ndarray, capacity: int, waste: int = 0, spread: int = 48) -> np.ndarray:
    """Patterns of one to four lengths in descending order, 0 for none, that fill a sequence but
    for `waste` places (others are left to the packing of what remains): for each first length, second and third lengths spread
    over those that fit, then the longest that still fits."""
    lengths = np.sort(lengths)

    def longest(room: np.ndarray, most: np.ndarray) -> np.ndarray:
        k = np.searchsorted(lengths, np.minimum(room, most), side="right") - 1
        return np.where(k >= 0, lengths[np.maximum(k, 0)], 0)

    a = lengths
    b = longest(capacity - a, a)
    rows = [np.stack([a, b, 0 * a, 0 * a], 1)]
    for share in range(1, spread + 1):
        b = longest((capacity - a) * share // spread, a)
        c = longest(capacity - a - b, b)
        d = longest(capacity - a - b - c, c)
        rows.append(np.stack([a, b, np.where(b > 0, c, 0), np.where((b > 0) & (c > 0), d, 0)], 1))
        c = longest((capacity - a - b) // 2, b)
        d = longest(capacity - a - b - c, c)
        rows.append(np.stack([a, b, np.where(b > 0, c, 0), np.where((b > 0) & (c > 0), d, 0)], 1))
    out = np.unique(np.concatenate(rows), axis=0)
    return out[out.sum(1) >= capacity - waste]


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Non-negative least squares of pattern counts to the histogram, by multiplicative updates
    (patterns and counts are non-negative, so each step lowers the error and keeps the sign)."""
    if not len(patterns):
        return np.zeros(0)
    used = patterns > 0

    def down(v: np.ndarray) -> np.ndarray:  # A^T v
        return np.where(used, v[patterns], 0).sum(1)

    x = np.full(len(patterns), histogram.sum() / max(1, used.sum()))
    target = down(histogram)
    for _ in range(rounds):
        made = np.bincount(patterns[used], weights=np.repeat(x, 4).reshape(-1, 4)[used], minlength=len(histogram))
        x *= target / np.maximum(down(made), 1e-9)
    return x


def plan_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset) runs that place every piece, in as few
    sequences as patterns without waste, with a little, or with more of it lead to."""
    plans = [_planned(histogram, capacity, w) for w in (0, capacity // 512, capacity // 50)]
    return min(plans, key=lambda runs: max((r[2] + r[3] for r in runs), default=0))


def _planned(histogram: dict[int, int], capacity: int, waste: int) -> list[tuple[int, int, int, int, int]]:
    """A plan by patterns of bounded waste.

    Pattern counts are rounded, as far as the histogram still supplies them; the rest go longest
    first into the fullest sequence with room, many alike at a time.
    """
    left = np.zeros(capacity + 1)
    for length, n in histogram.items():
        left[length] = n
    runs: list[tuple[int, int, int, int, int]] = []
    rank = [0] * (capacity + 1)
    sequences = 0
    bins: dict[int, list[tuple[int, int]]] = {}  # room left: runs of sequences
    rooms: list[int] = []

    def put(length: int, count: int, sequence: int, offset: int) -> None:
        runs.append((length, rank[length], count, sequence, offset))
        rank[length] += count
        left[length] -= count

    def opened(room: int, sequence: int, count: int) -> None:
        if room and count:
            if room not in bins:
                bins[room] = []
                insort(rooms, room)
            bins[room].append((sequence, count))

    patterns = enumerate_patterns(np.nonzero(left)[0], capacity, waste) if left.any() else np.zeros((0, 4), int)
    counts = fit_counts(patterns, left)
    order = np.argsort(-counts, kind="stable")
    for k in order[counts[order] >= 0.5]:
        parts = [int(p) for p in patterns[k] if p]
        n = int(min(np.rint(counts[k]), *(left[p] // parts.count(p) for p in set(parts))))
        if n < 1:
            continue
        offset = 0
        for p in parts:
            put(p, n, sequences, offset)
            offset += p
        opened(capacity - offset, sequences, n)
        sequences += n
    for length in range(capacity, 0, -1):
        while left[length] > 0:
            n = int(left[length])
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                sequence, count = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(k)
                t = min(n, count)
                put(length, t, sequence, capacity - room)
                opened(room - length, sequence, t)
                opened(room, sequence + t, count - t)
            else:
                each = capacity // length
                full = max(1, n // each)
                each = min(each, n // full)
                for j in range(each):
                    put(length, full, sequences, j * length)
                opened(capacity - each * length, sequences, full)
                sequences += full
    return runs


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, most_words: int = MOST_WORDS) -> DataFrame:
    """A row for each piece of each document's ids and its end id; only documents longer than
    the capacity are cut. A null or empty text is a piece of the end id alone."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, most_words)
        for part in gathered(batches):
            ids, ends = enc.encode_ended(to_bytes(part.column(1)), end_id)
            sizes = np.diff(ends, prepend=0)
            n = -(-sizes // capacity)
            own = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(sizes[own] - start, capacity)
            at, raw = (ends - sizes)[own] + start, memoryview(ids.astype("<u4").view(np.uint8))
            crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * at).tolist(), (4 * (at + length)).tolist())]
            take = pa.array(own)
            cols = [part.column(0).take(take), part.column(2).take(take), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row_key", "piece", "start", "length", "ids_crc32"])

    return texts_of(docs).withColumn("row_key", text_key()).mapInArrow(run, PIECES)


def _buckets(sizes: dict[int, int]) -> dict[int, int]:
    """In how many buckets pieces of each length are ranked: by their number, fewer if all lengths
    together would have more than `MOST_BUCKETS`."""
    each = max(RANKED, sum(sizes.values()) // MOST_BUCKETS)
    return {length: -(-n // each) for length, n in sizes.items()}


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (as of `tokenized_pieces`).

    Pieces of one length are interchangeable, so a piece's rank within its length picks its run.
    Ranks are counted in hashed buckets of each length, as many as its pieces need: one length may
    hold a third of all rows.
    """
    spark = pieces.sparkSession
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    spread = _buckets(sizes)
    usual = F.lit(1)
    if many := {k: b for k, b in spread.items() if b > 1}:
        usual = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), F.col("length")), usual)
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row_key", "piece"), usual).cast("int"))
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram: dict[int, int] = {}
    bases = []  # a row for each length and bucket
    for length, b, n in sorted(map(tuple, counts.collect())):
        bases.append((length, b, histogram.get(length, 0)))
        histogram[length] = histogram.get(length, 0) + n
    runs = sorted(plan_runs(histogram, capacity))
    key = np.array([r[0] << 44 | r[1] for r in runs], np.int64)
    first = np.array([r[1] for r in runs], np.int64)
    sequence = np.array([r[3] for r in runs], np.int64)
    offset = np.array([r[4] for r in runs], np.int64)
    shared = spark.sparkContext.broadcast((key, first, sequence, offset))

    def place(batches) -> Iterator[pa.RecordBatch]:
        key, first, sequence, offset = shared.value
        for b in batches:
            length, rank = np.asarray(b.column(3)), np.asarray(b.column(5))
            k = np.searchsorted(key, length << 44 | rank, side="right") - 1
            cols = [*b.columns[:5], pa.array(sequence[k] + rank - first[k]), pa.array(offset[k])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    base = spark.createDataFrame(bases, "length long, bucket int, base long")
    nth = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "row_key", "piece")) - 1
    ranked = rows.withColumn("nth", nth).join(F.broadcast(base), ["length", "bucket"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")).mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, most_words: int = MOST_WORDS) -> DataFrame:
    """Packs the ids of every whole text, end_id after each, into sequences of at most `capacity`.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts
    pack as the end id alone, repeated rows are packed each, null doc_ids like any other; an
    empty table packs into nothing. `most_words` bounds what a Python worker remembers.
    """
    return pack_pieces(stored(tokenized_pieces(docs, tokenizer_path, capacity, end_id, most_words), "pieces"), capacity)
