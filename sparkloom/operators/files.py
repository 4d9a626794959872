"""Predicates and lookups on files: what to skip, their language, slices of their lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.text import basename, directory, suffix, text_lines


def is_skipped(path: Column, size: Column) -> Column:
    """Lock files, binary and generated suffixes, and files over the size bound; unknown sizes too."""
    name = basename(path)
    bad = name.isin(*T.SKIPPED_NAMES) | size.isNull() | (size > T.MOST_BYTES)
    full = F.lower(F.regexp_extract(name, r"(?s)^\.*[^.]+(\..*)$", 1))
    return bad | full.rlike("(?:" + "|".join(re.escape(s) for s in T.SKIPPED_SUFFIXES) + r")\z")


def in_ignored_directory(path: Column, ignored: tuple[str, ...] = T.IGNORED_DIRECTORIES) -> Column:
    """True if any part of a relative path, its name included, is one of the ignored names."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in ignored]))


def language_of(path: Column, languages: dict[str, str] = T.CHUNK_LANGUAGES, other: str | None = "text") -> Column:
    """By suffix, from a literal map: a lookup without a join."""
    lookup = F.create_map(*[F.lit(x) for kv in languages.items() for x in kv])
    return F.coalesce(F.element_at(lookup, suffix(path)), F.lit(other))


def slice_lines(text: Column, start: Column, end: Column) -> Column:
    """struct(source, start_line, end_line, total_lines): lines from start to end, both clamped to
    the text; a null end is the last line."""
    lines = text_lines(text)
    total = F.size(lines)
    most = F.greatest(total, F.lit(1))
    s = F.greatest(F.lit(1), F.least(start, most))
    e = F.greatest(F.least(F.coalesce(end, total), most), s)
    return F.struct(F.array_join(F.slice(lines, s, e - s + 1), "\n").alias("source"), s.cast("int").alias("start_line"), e.cast("int").alias("end_line"), total.alias("total_lines"))


def first_match(rows: DataFrame, keys: list[str], priority: Column, ties: list[Column]) -> DataFrame:
    """One row for each key: that of least priority, then least ties. Aggregated before the
    shuffle, so a key with very many rows is no single task."""
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(priority, *ties)).alias("_row"))
    return best.select("_row.*")


def subprojects(listing: DataFrame, mode: str = "intended") -> DataFrame:
    """(root, language, test_command) for directories of a listing (path) that hold a marker file:
    the first marker of each, the tree's own root and ignored directories left out."""
    markers = F.create_map(*[x for k, (name, lang, cmd) in enumerate(T.SUBPROJECT_MARKERS) for x in (F.lit(name), F.struct(F.lit(k).alias("k"), F.lit(lang).alias("language"), F.lit(cmd).alias("test_command")))])
    found = listing.select(directory(F.col("path")).alias("root"), F.element_at(markers, basename(F.col("path"))).alias("m")).filter("m is not null and root != ''")
    found = found.filter(~in_ignored_directory(F.col("root"), T.SUBPROJECT_IGNORED))
    return found.groupBy("root").agg(F.min("m").alias("m")).select("root", "m.language", "m.test_command", F.col("m.k").alias("marker_priority"))


def may_run(command: Column, allowed: tuple[str, ...]) -> Column:
    """Commands that begin with an allowed one and chain nothing."""
    bare = F.trim(command)
    chained = F.lit(False)
    for part in T.CHAINING:
        chained = chained | bare.contains(part)
    ok = F.lit(False)
    for a in allowed:
        ok = ok | bare.startswith(a)
    return F.coalesce((bare != "") & ~chained & ok, F.lit(False))
