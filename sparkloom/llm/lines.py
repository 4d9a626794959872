"""Line dedup by deletion-neighbourhood join.

Lines are compared in a normal form (trimmed, lower case). Equal ones are found by hash. For near
ones, two strings within one edit agree in their first or in their last half, so only lines that
share such a half with another are candidates; these emit what is left after each single deletion
in the other half, as hashed keys. Equal keys meet: a substitution leaves the same string at the
same place in both lines, an insertion leaves one line as the other. The edit distance is then
verified, and whichever line is not the earliest goes. A key held by any number of lines yields
one row for each line and never their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, split_by_keys, stored, text_key, worker_cache

LEAST_CHARS = 20
_U = np.uint64
#: Hashes are polynomials modulo a prime, at a base drawn at random.
_PRIME, _HALF = _U((1 << 61) - 1), _U((1 << 32) - 1)
_BASE = 0x1A7F3C9D5E2B8461
_INVERSE = pow(_BASE, -1, (1 << 61) - 1)


def normal_form(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(" \t\r\x0b\x0c")))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime 2^61 - 1, from halves of 32 bits."""
    ah, al, bh, bl = a >> _U(32), a & _HALF, b >> _U(32), b & _HALF
    middle, low = ah * bl + al * bh, al * bl
    total = (ah * bh << _U(3)) + (middle >> _U(29)) + ((middle & _U((1 << 29) - 1)) << _U(32)) + (low >> _U(61)) + (low & _PRIME)
    return _reduced(total)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> _U(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _powers(n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, _times(out, np.array([pow(_BASE, len(out), int(_PRIME))], np.uint64))])
    return out[:n]


def deletions(text: str, lo: int, hi: int) -> tuple[int, np.ndarray]:
    """The hash of a text, and of what is left of it without its character lo, …, hi - 1."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + _U(1)
    n = len(x)
    term = _times(x, _USUAL[:n] if n <= len(_USUAL) else _powers(n))
    low, high = np.cumsum(term & _U((1 << 31) - 1)), np.cumsum(term >> _U(31))
    sums = _reduced(_times(_reduced(high), np.array([1 << 31], np.uint64)) + _reduced(low))
    sums = np.concatenate([[_U(0)], sums])
    at = np.arange(lo, hi)
    left = _reduced(sums[at] + _times(_reduced(sums[n] + _PRIME - sums[at + 1]), np.array([_INVERSE], np.uint64)))

    def mixed(h: np.ndarray, size: int) -> np.ndarray:
        h = (h ^ (h >> _U(32))) * _U(0x9FB21C651E98DF25) + _U(max(size, 0))
        return h ^ (h >> _U(28))

    return int(mixed(sums[n : n + 1], n).view(np.int64)[0]), mixed(left, n - 1).view(np.int64)


_USUAL = _powers(1 << 10)


def _neighbourhood(batches) -> Iterator[pa.RecordBatch]:
    """Rows (h1, h2, by_prefix, by_suffix, norm): (key, place, h1, h2); place -1 is the line itself."""
    for b in batches:
        keys, places, a, c = [], [], [], []
        for h1, h2, prefix, suffix, norm in zip(*(x.to_pylist() for x in b.columns)):
            n = len(norm)
            lo, hi = 0 if suffix else n // 2, n if prefix else n - n // 2
            own, left = deletions(norm, lo, hi)
            keys += [np.array([own]), left]
            places += [np.array([-1], np.int32), np.arange(lo, hi, dtype=np.int32)]
            a.append(np.full(len(left) + 1, h1))
            c.append(np.full(len(left) + 1, h2))
            if len(keys) > 2000:
                yield _flat(keys, places, a, c)
                keys, places, a, c = [], [], [], []
        if keys:
            yield _flat(keys, places, a, c)


def _flat(*parts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], ["key", "place", "h1", "h2"])


def _asked_lines(batches) -> Iterator[pa.RecordBatch]:
    """Rows (text, asked): each line asked for, by number."""
    for b in batches:
        out = []
        for text, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            parts = text.split("\n")
            out += [(x["h1"], x["h2"], x["by_prefix"], x["by_suffix"], parts[x["line"]]) for x in asked]
        cols = list(zip(*out)) if out else [[]] * 5
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["h1", "h2", "by_prefix", "by_suffix", "line"])


def near_lines(base: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h1, h2) of distinct lines that are within one edit of a line that comes earlier."""
    keys = firsts.select("h1", "h2", "first", F.explode("halves").alias("half"))
    common = keys.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    asked = (
        keys.join(common, "half", "left_semi")
        .groupBy("h1", "h2")
        .agg(F.first("first").alias("first"), F.max(F.col("half.prefix")).alias("by_prefix"), F.max(~F.col("half.prefix")).alias("by_suffix"))
    )
    of_doc = stored(
        asked.groupBy(F.col("first.doc_id").alias("d"), F.col("first.row_key").alias("k")).agg(
            F.collect_list(F.struct("h1", "h2", "by_prefix", "by_suffix", "first.line", "first")).alias("asked")
        ),
        "asked-lines",
    )
    some, _ = split_by_keys(base, of_doc.select(F.col("k").alias("row_key")).distinct())
    one = some.dropDuplicates(["doc_id", "row_key"])
    texts = one.join(of_doc, (one["row_key"] == of_doc["k"]) & one["doc_id"].eqNullSafe(of_doc["d"])).select("text", "asked")
    kinds = "h1 long, h2 long, by_prefix boolean, by_suffix boolean, line string"
    lines = stored(texts.mapInArrow(_asked_lines, kinds).withColumn("norm", normal_form(F.col("line"))).drop("line"), "candidates")
    order = of_doc.select(F.explode("asked").alias("x")).select("x.h1", "x.h2", "x.first")
    every = lines.select("h1", "h2", "by_prefix", "by_suffix", "norm").mapInArrow(_neighbourhood, "key long, place int, h1 long, h2 long")
    every = stored(every, "neighbourhoods")
    met = every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    shared = stored(every.join(met, "key").join(order, ["h1", "h2"]), "shared")
    texts = lines.select("h1", "h2", "norm").dropDuplicates(["h1", "h2"])
    found = verified(earlier_pairs(shared), texts)
    near = stored(found, "verified")
    # a pair that fails met by a hash alone: its keys are dealt again by the strings themselves
    failed = near.filter("not near").select(F.explode("keys").alias("key")).distinct()
    if failed.isEmpty():
        return near.filter("near").select("h1", "h2").distinct()
    strings = shared.join(failed.hint("merge"), "key").join(texts, ["h1", "h2"])
    left = F.when(F.col("place") < 0, F.col("norm")).otherwise(F.concat(F.expr("substring(norm, 1, place)"), F.expr("substring(norm, place + 2)")))
    again = verified(earlier_pairs(strings.withColumn("key", left).drop("norm")), texts)
    return near.filter("near").select("h1", "h2").union(again.filter("near").select("h1", "h2")).distinct()


def earlier_pairs(shared: DataFrame) -> DataFrame:
    """(keys, h1, h2, w) of lines that share keys with an earlier line, w the earliest of its kind:
    with one character gone at one place each, or at any place against the whole line."""
    who = F.struct("first", "h1", "h2")
    left, own = shared.filter("place >= 0"), shared.filter("place < 0")
    heads = left.groupBy("key", "place").agg(F.min(who).alias("w"))
    same_place = left.join(heads, ["key", "place"]).select("key", "h1", "h2", "first", "w")
    selves = own.groupBy("key").agg(F.min(who).alias("w"))
    longer = left.select("key", "h1", "h2", "first").distinct()
    inserted = longer.join(selves, "key").select("key", "h1", "h2", "first", "w")
    least = longer.groupBy("key").agg(F.min(who).alias("w"))
    dropped = own.join(least, "key").select("key", "h1", "h2", "first", "w")
    pairs = same_place.union(inserted).union(dropped).filter(F.col("w.first") < F.col("first"))
    return pairs.groupBy("h1", "h2", "w").agg(F.collect_set("key").alias("keys"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(keys, h1, h2, near): whether each pair is within one edit."""
    witness = texts.select(F.col("h1").alias("w1"), F.col("h2").alias("w2"), F.col("norm").alias("earlier"))
    both = pairs.join(texts, ["h1", "h2"]).join(witness, (F.col("w.h1") == F.col("w1")) & (F.col("w.h2") == F.col("w2")))
    return both.select("keys", "h1", "h2", (F.levenshtein("norm", "earlier", 1) >= 0).alias("near"))


def removed_lines(base: DataFrame, least_chars: int = LEAST_CHARS, near: bool = True) -> DataFrame:
    """(d, k, removed array<int>) of documents that lose lines; base has doc_id, row_key, text."""
    norm, n = F.col("norm"), F.col("n")
    low, high = F.floor(n / 2).cast("int"), F.floor((n + 1) / 2).cast("int")

    def half(prefix: bool, size: Column) -> Column:
        part = F.substring(norm, F.lit(1), size) if prefix else F.substring(norm, n - size + 1, size)
        return F.struct(F.lit(prefix).alias("prefix"), F.xxhash64(F.lit(prefix), size, part).alias("hash"))

    halves = F.array_distinct(F.array(half(True, low), half(True, high), half(False, low), half(False, high)))
    exploded = base.select("doc_id", "row_key", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    lines = exploded.select("doc_id", "row_key", "line", normal_form(F.col("raw")).alias("norm")).withColumn("n", F.length("norm")).filter(n >= least_chars)
    lines = lines.select("doc_id", "row_key", "line", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(7), "norm").alias("h2"), *([halves.alias("halves")] if near else []))
    lines = stored(lines, "lines")
    best = [F.min(F.struct("doc_id", "row_key", "line")).alias("first"), F.count("*").alias("copies")]
    firsts = stored(lines.groupBy("h1", "h2").agg(*best, *([F.min("halves").alias("halves")] if near else [])), "first-lines")
    repeated = firsts.filter("copies > 1").select("h1", "h2", "first")
    if near:
        close = stored(near_lines(base, firsts), "near-lines").withColumn("near", F.lit(True))
        repeated = repeated.join(close, ["h1", "h2"], "full_outer").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    else:
        repeated = repeated.withColumn("near", F.lit(False))
    own = F.struct("doc_id", "row_key", "line")
    gone = lines.select("doc_id", "row_key", "line", "h1", "h2").join(repeated, ["h1", "h2"]).filter(F.col("near") | ~own.eqNullSafe(F.col("first")))
    return stored(gone.groupBy(F.col("doc_id").alias("d"), F.col("row_key").alias("k")).agg(F.sort_array(F.collect_set("line")).alias("removed")), "removed-lines")


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines of the given numbers. Marked as not deterministic, lest a filter
    on it be pushed below and run it twice."""

    def kept(t: str, gone) -> str:
        out = set(gone)
        return "\n".join([x for i, x in enumerate(t.split("\n")) if i not in out])

    def run(text: pd.Series, removed: pd.Series) -> pd.Series:
        worker_cache("")
        return pd.Series([None if t is None else kept(t, g) for t, g in zip(text, removed)], dtype=object)

    return F.pandas_udf(run, "string").asNondeterministic()(text, removed)


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, near: bool = True) -> DataFrame:
    """(row, doc_id, text, n_lines, n_removed) of every row: `row` holds the other columns of
    `docs`, text is what is left of it.

    A line goes if an equal line, or one within an edit of one character, comes earlier: by
    doc_id (null first), then the hash of the text, then the line's number; whether that one stays
    itself does not matter. Lines of fewer than `least_chars` characters in normal form are never
    judged. A null text stays null and has no lines; an empty one is one empty line; rows alike
    in doc_id and text count as one document and share their result; an empty table gives an
    empty result. No row goes, even if all its lines do.
    """
    bound_batches(docs.sparkSession)
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    base = docs.select(F.struct(*others).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row_key", text_key())
    removed = removed_lines(base.select("doc_id", "row_key", "text"), least_chars, near)
    touched, clean = split_by_keys(base, removed.select(F.col("k").alias("row_key")).distinct())
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    joined = touched.join(removed, (touched["row_key"] == removed["k"]) & touched["doc_id"].eqNullSafe(removed["d"]), "left")
    none = F.array().cast("array<int>")
    cut = joined.withColumn("gone", F.coalesce("removed", none)).select("row", "doc_id", without_lines(F.col("text"), F.col("gone")).alias("kept"), n_lines.alias("n_lines"), F.size("gone").cast("long").alias("n_removed"))
    whole = clean.select("row", "doc_id", "text", F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    return cut.withColumnRenamed("kept", "text").union(whole)
