"""Vector code compression: product codes in whole numbers, assigned by annular norm pruning.

A codebook's entries are sorted by norm. A part's own norm finds the entry of nearest norm by binary
search; the distance to it bounds the norms that a nearer entry can have, so the entries of that
annulus alone, its edges included, are evaluated, outwards, and every nearer entry narrows it.
Rows are a map; a round's sums and counts, one for each entry, are all that is aggregated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, sized, slices, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest whole component: squared distances of 2**13 of them, and sums over 2**38 rows, fit 64 bits.
MOST = 1 << 24
#: What a norm may be off by rounding, at most; an annulus is so much wider on either side.
SLACK = 1e-4


class Codebook:
    """Entries of one part, (n, width) whole numbers, in order of their norm."""

    def __init__(self, entries: np.ndarray):
        squares = (entries * entries).sum(1)
        self.order = np.argsort(squares, kind="stable")
        self.entries, self.norms = entries[self.order], np.sqrt(squares[self.order].astype(np.float64))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of each point's nearest entry (the lowest of equally near ones), its squared
        distance, and how many distances were evaluated."""
        n, m = len(points), len(self.norms)
        norm = np.sqrt((points * points).sum(1).astype(np.float64))
        right = np.searchsorted(self.norms, norm)
        left = right - 1
        low, high = np.zeros(n, np.int64), np.full(n, m)  # the annulus: entries from low, below high
        best, which = np.full(n, np.iinfo(np.int64).max), np.full(n, m)
        rows, evaluated = np.arange(n), 0
        while len(rows):
            le, ri, x = left[rows], right[rows], norm[rows]
            has_left, has_right = le >= low[rows], ri < high[rows]
            rows = rows[has_left | has_right]
            le, ri, x, has_left, has_right = (a[has_left | has_right] for a in (le, ri, x, has_left, has_right))
            outer = self.norms[np.minimum(ri, m - 1)] - x <= x - self.norms[np.maximum(le, 0)]
            use_right = has_right & (outer | ~has_left)
            at = np.where(use_right, ri, le)
            left[rows[~use_right]] -= 1
            right[rows[use_right]] += 1
            gap = points[rows] - self.entries[at]
            d, entry = (gap * gap).sum(1), self.order[at]
            evaluated += len(rows)
            nearer = d < best[rows]
            better = nearer | ((d == best[rows]) & (entry < which[rows]))
            which[rows[better]] = entry[better]
            own = rows[nearer]
            best[own] = d[nearer]
            reach = np.sqrt(best[own].astype(np.float64)) + SLACK
            low[own] = np.searchsorted(self.norms, norm[own] - reach, "left")
            high[own] = np.searchsorted(self.norms, norm[own] + reach, "right")
        return which, best, evaluated


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): components as floor(scale * x), of rows whose vector is neither null nor
    empty nor holds null or non-finite components. A component beyond 2**24 is an error, as exact
    sums of its squares may not fit."""
    x = F.col(vec_col).cast("array<double>")
    usable = (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c * scale))
    v = F.when(F.exists(v, lambda c: F.abs(c) > MOST), F.raise_error(F.lit(f"a component is beyond {MOST} after scaling")).cast("array<bigint>")).otherwise(v)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.when(F.coalesce(usable, F.lit(False)), v).alias("v"))
    return rows.filter("v is not null")


def first_vectors(rows: DataFrame, n: int) -> list[list[int]]:
    """Vectors of the n smallest distinct ids, null last; of several for one id the least."""
    ids = rows.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(n)
    found = rows.join(F.broadcast(ids), rows["vec_id"].eqNullSafe(ids["vec_id"]), "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    return [r["v"] for r in found.orderBy(F.asc_nulls_last("vec_id")).collect()]


def cut(part: pa.RecordBatch, width: int, parts: int) -> np.ndarray:
    """The column v of a batch as (rows, parts, width)."""
    return part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, parts, width)


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks (parts, entries, width) after one round: each entry becomes the floor of the mean of
    the parts assigned to it, and stays where none is. Tasks sum what they hold; the driver gets one
    row for each entry and position."""
    parts, entries, width = books.shape

    def run(batches) -> Iterator[pa.RecordBatch]:
        each = [Codebook(b) for b in books]
        total, n = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in slices(batches):
            v = cut(batch, width, parts)
            for k in range(parts):
                which = each[k].nearest(v[:, k])[0]
                n[k] += np.bincount(which, minlength=entries)
                order = np.argsort(which, kind="stable")
                first = np.nonzero(np.append(True, np.diff(which[order]) > 0))[0]
                total[k, which[order][first]] += np.add.reduceat(v[order, k], first, axis=0)
        k, e, p = (a.ravel() for a in np.indices(books.shape))
        used = n[k, e] > 0
        yield pa.RecordBatch.from_arrays([pa.array(a[used]) for a in (k, e, p, n[k, e], total.ravel())], ["part", "entry", "place", "n", "total"])

    sums = rows.select("v").mapInArrow(run, "part long, entry long, place long, n long, total long")
    out = books.copy()
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return out


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error, evaluated): nearest entries of all parts, the sum of their squared
    distances, and how many distances were evaluated for a row's batch, by row."""
    parts, _, width = books.shape
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        each = [Codebook(b) for b in books]
        for batch in slices(batches):
            v = cut(batch, width, parts)
            found = [each[k].nearest(v[:, k]) for k in range(parts)]
            code = np.stack([f[0] for f in found], 1).astype(np.uint8)
            error = np.sum([f[1] for f in found], axis=0)
            share = np.full(batch.num_rows, sum(f[2] for f in found) / batch.num_rows)
            hexes = [c.tobytes().hex() for c in code]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(hexes), pa.array(error), pa.array(share)], ["vec_id", "label", "code", "error", "evaluated"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {kind}, code string, error long, evaluated double")


def books_digest(books: np.ndarray) -> str:
    """Of all components in the order of part, entry and place, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def fit_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of whole vectors of one length, after `rounds` rounds over
    all of them; fewer entries where there are fewer ids."""
    books = np.array(first_vectors(rows, entries), np.int64)
    books = books.reshape(len(books), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = moved(rows, books)
    return books


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error, label_error, evaluated), codebooks): a code of two hex digits for
    each part of every usable vector, its squared error, and that of all rows of its label.

    Null labels are one label. Vectors that are null, empty or hold null or non-finite components
    take no part, nor do those whose length is not that of the smallest id's vector, or all if the
    parts do not divide it. Rows with a null id take part; repeated rows count each and get the same
    code. No usable vector gives no row and empty codebooks. Further columns are left out.
    """
    spark = vectors.sparkSession
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for each part: 1 to 256 entries")
    bound_batches(spark)
    rows = stored(whole_vectors(vectors, id_col, vec_col, label_col, scale), "whole-vectors")
    first = first_vectors(rows, 1)
    width = len(first[0]) if first and len(first[0]) % parts == 0 else -1
    rows = rows.filter(F.size("v") == width)
    if width < 0:
        books = np.zeros((parts, 0, 0), np.int64)
        return rows.select("vec_id", "label", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit(0.0).alias("evaluated")), books
    books = fit_books(rows, parts, entries, rounds)
    coded = stored(assigned(rows, books), "codes")
    sums = sized(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    out = coded.join(sums, coded["label"].eqNullSafe(F.col("_label")))
    return out.select("vec_id", "label", "code", "error", "label_error", "evaluated"), books


def decoded(code: Column, books: np.ndarray) -> Column:
    """The whole vector that a code stands for."""
    parts = [F.element_at(F.lit(b.tolist()), F.conv(F.substring(code, 2 * k + 1, 2), 16, 10).cast("int") + 1) for k, b in enumerate(books)]
    return F.concat(*parts)
