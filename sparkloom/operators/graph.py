"""The import graph: edges by first-match resolution, degrees, members of cycles, short cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.text import directory
from ..session import cut_lineage
from .components import components


def normal_path(path: Column) -> Column:
    """A relative path without "." and with ".." taken back; null if it leaves the tree."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))

    def walk(acc: Column, x: Column) -> Column:
        return F.when(acc.isNull(), acc).when(x != "..", F.array_append(acc, x)).when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), walk), "/")


def resolved_edges(imports: DataFrame, listing: DataFrame, nodes: DataFrame, mode: str = "intended") -> DataFrame:
    """(from, to, import_id): imports (import_id, file, target) to files of a listing (path).

    Each import has candidate paths beside its file (and, intended, from the tree's root): the
    target with each suffix, then its package file. The first that the listing has is the one; it
    is an edge if it is a node (file, ordinal). Compat: only to nodes that do not come later.
    """
    base = imports.withColumn("dir", directory(F.col("file")))
    roots = [F.col("dir"), F.lit("")] if mode == "intended" else [F.col("dir")]
    paths = []
    for root in roots:
        stem = F.concat(F.when(root == "", F.lit("")).otherwise(F.concat(root, F.lit("/"))), F.col("target"))
        paths += [F.concat(stem, F.lit(s)) for s in T.IMPORT_SUFFIXES] + [F.concat(stem, F.lit("/__init__.py"))]
    each = base.select("import_id", "file", F.posexplode(F.array(*paths)).alias("priority", "raw"))
    each = each.select("import_id", "file", "priority", normal_path(F.col("raw")).alias("path")).filter("path is not null and path != ''")
    hit = each.join(listing.select("path").distinct(), "path").groupBy("import_id", "file").agg(F.min_by("path", "priority").alias("to"))
    out = hit.join(nodes.select(F.col("file").alias("to"), F.col("ordinal").alias("to_at")), "to")
    if mode != "intended":
        out = out.join(nodes.select("file", F.col("ordinal").alias("from_at")), "file").filter("to_at <= from_at")
    return out.select(F.col("file").alias("from"), "to", "import_id")


def in_degree(edges: DataFrame, mode: str = "intended") -> DataFrame:
    """(file, inbound): intended, the number of other files that import it; compat, of edges."""
    if mode == "intended":
        edges = edges.filter(F.col("from") != F.col("to")).select("from", "to").distinct()
    return edges.groupBy(F.col("to").alias("file")).agg(F.count("*").alias("inbound"))


def trimmed(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """Edges without those of nodes that nothing enters or nothing leaves, again and again: what
    stays lies on cycles or between them."""
    now = cut_lineage(edges.select("from", "to").distinct())
    n = now.count()
    for _ in range(most_rounds if n else 0):
        entered, left = now.select(F.col("to").alias("from")).distinct(), now.select(F.col("from").alias("to")).distinct()
        now = cut_lineage(now.join(entered, "from", "left_semi").join(left, "to", "left_semi").select("from", "to"))
        after = now.count()
        if after == n:
            break
        n = after
    return now


def cycle_members(edges: DataFrame) -> DataFrame:
    """(file): nodes that reach themselves."""
    return components(edges).select(F.col("node").alias("file"))


def list_cycles(edges: DataFrame, most_length: int = 8) -> DataFrame:
    """(cycle): all simple cycles of up to most_length nodes, each once, its least node first and again at
    its end, for sparse graphs: a dense one has more of them than anyone can list. Paths grow from their
    least node alone, so no rotation is built. Longer cycles are for `fundamental_cycles`."""
    steps = trimmed(edges)
    loops = steps.filter(F.col("from") == F.col("to")).select(F.array("from", "to").alias("cycle"))
    steps = steps.filter(F.col("from") != F.col("to"))
    paths = steps.filter(F.col("from") < F.col("to")).select(F.array("from", "to").alias("path"))
    found = loops
    for _ in range(2, most_length + 1):
        last = F.element_at("path", -1)
        grown = paths.join(steps, last == F.col("from"))
        found = found.union(grown.filter(F.col("to") == F.col("path")[0]).select(F.array_append("path", F.col("to")).alias("cycle")))
        paths = cut_lineage(grown.filter((F.col("to") > F.col("path")[0]) & ~F.array_contains("path", F.col("to"))).select(F.array_append("path", F.col("to")).alias("path")))
    return found


def first_search_cycles(nodes: list[str], edges: list[tuple[str, str]]) -> list[list[str]]:
    """Compat: a cycle for each edge back into the path of a depth-first walk in node order, on
    the driver (for report-sized graphs); a stack takes the place of recursion."""
    to: dict[str, list[str]] = {n: [] for n in nodes}
    for a, b in edges:
        to.setdefault(a, []).append(b)
    done: set[str] = set()
    out = []
    for root in nodes:
        if root in done:
            continue
        path, at, walks = [root], {root: 0}, [iter(to[root])]
        while walks:
            nxt = next(walks[-1], None)
            if nxt is None:
                walks.pop()
                gone = path.pop()
                del at[gone]
                done.add(gone)
            elif nxt in at:
                out.append([*path[at[nxt] :], nxt])
            elif nxt not in done and nxt in to:
                at[nxt] = len(path)
                path.append(nxt)
                walks.append(iter(to[nxt]))
    return out
