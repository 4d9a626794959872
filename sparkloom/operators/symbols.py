"""Analyses of definitions and bodies: duplicates, unreferenced names, large files, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.text import call_tokens, is_comment_line
from ..session import stored


def duplicate_groups(rows: DataFrame, hash_col: str, location: Column, order: Column, least: int = 2) -> DataFrame:
    """(hash, n, first, locations): groups of equal hashes of `least` rows or more. `location` is
    kept for each row, sorted by `order`; a group may hold many rows, so callers that need no
    locations drop the column and Catalyst does not collect it."""
    return (
        rows.groupBy(F.col(hash_col).alias("hash"))
        .agg(
            F.count("*").alias("n"),
            F.min(order).alias("first"),
            F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), location.alias("l")))), lambda x: x["l"]).alias("locations"),
        )
        .filter(F.col("n") >= least)
    )


def duplicate_members(rows: DataFrame, hash_col: str, least: int = 2) -> DataFrame:
    """Rows whose hash is shared: a semi join, so no group is gathered in one place."""
    shared = rows.groupBy(hash_col).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(hash_col)
    return rows.join(shared, hash_col, "left_semi")


def call_sites(files: DataFrame, mode: str = "intended") -> DataFrame:
    """(name, file, line): names that lines of (file, text) seem to call; comment lines left out."""
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("at", "line")).filter(~is_comment_line(F.col("line")))
    return lines.select(F.explode(call_tokens(F.col("line"), mode == "intended")).alias("name"), "file", (F.col("at") + 1).alias("line"))


def is_framework_entry(decorators: Column) -> Column:
    """A decorator that is a known one, or known but for a prefix or suffix after a dot."""
    known = F.array(*[F.lit(x) for x in T.FRAMEWORK_DECORATORS])

    def like(d: Column) -> Column:
        return F.exists(known, lambda p: (d == p) | d.startswith(F.concat(p, F.lit("."))) | d.endswith(F.concat(F.lit("."), p)))

    return F.coalesce(F.exists(decorators, like), F.lit(False))


def dead_functions(functions: DataFrame, calls: DataFrame, mode: str = "intended", exported: DataFrame | None = None) -> DataFrame:
    """(symbol, file, line, reason): functions (name, file, start_line, decorators) that no call
    names, special methods, entry points and framework callbacks left out.

    Intended: a definition's own line is no call, and names in `exported` (name) are in use.
    Compat: every call token counts, and decorators are not seen.
    """
    if mode == "intended":
        own = functions.select("name", "file", F.col("start_line").alias("line"))
        calls = calls.join(own, ["name", "file", "line"], "left_anti")
    called = calls.select("name").distinct()
    if mode == "intended" and exported is not None:
        called = called.union(exported.select("name")).distinct()
    name = F.col("name")
    out = functions.filter(~name.isin(*T.SPECIAL_METHODS) & ~name.isin(*T.ENTRY_POINT_FUNCTIONS))
    if mode == "intended":
        out = out.filter(~is_framework_entry(F.col("decorators")))
    return out.join(called, "name", "left_anti").select(name.alias("symbol"), "file", F.col("start_line").alias("line"), F.lit("no_callers").alias("reason"))


def callers(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(file, start_line, callee): calls (name, file, line) with the innermost function around them, both
    null outside of functions. A definition's own line is no call of it."""
    own = functions.select("name", "file", F.col("start_line").alias("line"))
    each = calls.join(own, ["name", "file", "line"], "left_anti")
    lines = functions.select("file", "start_line", F.explode(F.sequence("start_line", "end_line")).alias("line")).groupBy("file", "line").agg(F.max("start_line").alias("start_line"))
    found = each.join(lines, ["file", "line"], "left")
    return found.select(F.when(F.col("start_line").isNotNull(), F.col("file")).alias("file"), "start_line", F.col("name").alias("callee")).distinct()


def unreachable_functions(functions: DataFrame, calls: DataFrame, exported: DataFrame | None = None) -> DataFrame:
    """(symbol, file, line, reason): functions (name, file, start_line, end_line, decorators) that nothing
    live calls, by name: `no_callers`, or `dead_callers` if dead functions do, themselves included.

    Live are special methods, entry points, framework callbacks, what is exported (name) or called
    outside of functions, and what live functions call. Each round meets only the functions that the
    one before has found.
    """
    nodes = stored(functions.select("name", "file", "start_line", is_framework_entry(F.col("decorators")).alias("callback")), "functions")
    links = stored(callers(functions, calls), "calls")
    name = F.col("name")
    names = links.filter("start_line is null").select(F.col("callee").alias("name"))
    names = (names if exported is None else names.union(exported.select("name"))).distinct()
    rooted = nodes.filter(name.isin(*T.SPECIAL_METHODS, *T.ENTRY_POINT_FUNCTIONS) | F.col("callback")).select("file", "start_line")
    front = live = stored(rooted.union(nodes.join(names, "name", "left_semi").select("file", "start_line")).distinct(), "live")
    while not front.isEmpty():
        called = links.join(front, ["file", "start_line"], "left_semi").select(F.col("callee").alias("name")).distinct()
        front = stored(nodes.join(called, "name", "left_semi").select("file", "start_line").distinct().join(live, ["file", "start_line"], "left_anti"), "live")
        live = live.union(front)
    dead = nodes.join(live, ["file", "start_line"], "left_anti")
    named = links.select(F.col("callee").alias("name")).distinct().withColumn("called", F.lit(True))
    reason = F.when(F.col("called"), "dead_callers").otherwise("no_callers")
    return dead.join(named, "name", "left").select(name.alias("symbol"), "file", F.col("start_line").alias("line"), reason.alias("reason"))


def unreferenced(rows: DataFrame, references: DataFrame, key: str, ref_key: str) -> DataFrame:
    """Rows whose key no reference holds; references are made distinct before the join."""
    return rows.join(references.select(F.col(ref_key).alias(key)).distinct(), key, "left_anti")


def referenced(rows: DataFrame, references: DataFrame, key: str, ref_key: str) -> DataFrame:
    return rows.join(references.select(F.col(ref_key).alias(key)), key, "left_semi")


def god_files(files: DataFrame, lines: Column, exports: Column, most_lines: int = 500, most_exports: int = 10) -> DataFrame:
    """Files beyond either bound (both strict)."""
    return files.filter((lines > most_lines) | (exports > most_exports))


def scan_summary(files: DataFrame, lines: Column, language: Column, counts: dict[str, Column] | None = None) -> DataFrame:
    """One row: total_files, total_lines, languages_detected, and a sum for each of `counts`."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for k, c in (counts or {}).items()]
    return files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum(lines), F.lit(0)).cast("long").alias("total_lines"), F.sort_array(F.collect_set(language)).alias("languages_detected"), *sums)
