"""The scan of a source tree: one read and one parse, and analyses that share them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import n_lines_scan
from ..operators import components, files, graph, scoring, similar, symbols
from ..session import ensure_importable, stored
from ..sources import parsers, srctree
from .incremental import parse_changed


@dataclass
class Scan:
    """Lazy tables of one scan; `to_dict` collects them where a report is wanted."""

    summary: DataFrame
    dead_code: DataFrame
    duplicates: DataFrame
    god_files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    members: DataFrame
    cycles: DataFrame
    subprojects: DataFrame
    functions: DataFrame
    calls: DataFrame
    parsed: DataFrame
    parsed_now: int | None = None
    mode: str = "intended"
    error: str | None = None
    kept: list[DataFrame] = field(default_factory=list)

    def similar(self, num: int = 4, den: int = 5) -> DataFrame:
        """(first, second, score): functions with similar bodies that are not duplicates."""
        return similar.similar_functions(self.parsed, num, den)

    def unreachable(self) -> DataFrame:
        """Functions that nothing live calls: dead code, and what only dead code calls."""
        return symbols.unreachable_functions(self.functions, self.calls, self.parsed.filter("error is null").select(F.explode("exported").alias("name")))

    def circular(self) -> list[list[str]]:
        if self.mode == "intended":
            return sorted(r["cycle"] for r in self.cycles.collect())
        nodes = [r["file"] for r in self.nodes.orderBy("ordinal").collect()]
        edges = [(r["from"], r["to"]) for r in self.edges.orderBy("from", "import_id").collect()]
        return graph.first_search_cycles(nodes, edges)

    def cycle_files(self) -> DataFrame:
        if self.mode == "intended":
            return self.members.select(F.col("node").alias("file"))
        rows = [(f,) for c in self.circular() for f in set(c)]
        return self.nodes.sparkSession.createDataFrame(rows, "file string").distinct()

    def health(self) -> DataFrame:
        n = F.count("*").alias("n")
        dup = self.duplicates.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        cycles = self.nodes.sparkSession.createDataFrame([(len(self.circular()),)], "n long")
        return scoring.health(self.functions.agg(n), self.dead_code.agg(n), dup, self.god_files.agg(n), cycles)

    def architecture(self) -> DataFrame:
        return scoring.architecture(self.nodes, list(self.summary.first()["languages_detected"]))

    def risk(self, targets: DataFrame) -> DataFrame:
        return scoring.risk_of(targets, self.edges, self.nodes, self.cycle_files(), self.dead_code, self.god_files, self.summary, self.calls, self.mode)

    def to_dict(self) -> dict:
        s = self.summary.first().asDict()
        return {
            "summary": s,
            "dead_code": [r.asDict() for r in self.dead_code.orderBy("file", "line").collect()],
            "duplicates": [{"hash": r["hash"], "locations": [x.asDict() for x in r["locations"]]} for r in self.duplicates.orderBy(F.desc("n"), "first").collect()],
            "god_files": [r.asDict() for r in self.god_files.orderBy(F.desc("lines"), "file").collect()],
            "dep_graph": {"nodes": [r["file"] for r in self.nodes.orderBy("ordinal").collect()], "edges": [{"from": r["from"], "to": r["to"]} for r in self.edges.orderBy("from", "import_id").collect()], "circular": self.circular()},
            "subprojects": [r.asDict() for r in self.subprojects.orderBy("marker_priority", "root").drop("marker_priority").collect()],
            "error": self.error,
        }

    def release(self) -> None:
        for df in self.kept:
            df.unpersist()


def import_targets(imports: DataFrame, mode: str) -> DataFrame:
    """(import_id, file, target): import paths as relative paths.

    Intended: dots of a Python module are directories, leading dots go up from the file's own,
    bare imports count, and script paths lose a leading "./". Compat: only imports with a module,
    as they are written.
    """
    rows = imports.withColumn("import_id", F.col("at") * 1000)
    if mode != "intended":
        return rows.filter("from_module is not null").select("import_id", "file", F.col("from_module").alias("target"))
    module = F.coalesce("from_module", F.element_at("names", 1))
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.regexp_replace(F.regexp_replace(module, r"^\.+", ""), r"\.", "/")
    up = F.concat(F.lit("./"), F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))))
    python = F.when(dots > 0, F.concat(up, rest)).otherwise(rest)
    whole = rows.select("import_id", "file", F.when(F.col("language") == "python", python).otherwise(module).alias("target"), "names", "from_module", "language")
    # "from package import name": the name may be a module of its own
    each = whole.filter((F.col("language") == "python") & F.col("from_module").isNotNull()).select("import_id", "file", "target", F.posexplode("names").alias("k", "name"))
    each = each.select((F.col("import_id") + F.col("k") + 1).alias("import_id"), "file", F.concat(F.regexp_replace("target", "/$", ""), F.lit("/"), F.col("name")).alias("target"))
    return whole.select("import_id", "file", "target").union(each).filter("target is not null and target != ''")


def ordered(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, ordinal): places from 1 in the order of a key, and what to unpersist after use. Rows are
    sorted by ranges and counted in each; only the counts, one for each range, meet in one place."""
    ranged = rows.select(key).repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()).persist()
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_base"))
    nth = F.row_number().over(W.partitionBy("_part").orderBy(key))
    return ranged.withColumn("_nth", nth).join(F.broadcast(counts), "_part").select(key, (F.col("_base") + F.col("_nth")).alias("ordinal")), ranged


def scan(spark: SparkSession, root: str, languages: list[str] | None = None, include_tests: bool = True, max_depth: int = 0, mode: str = "intended", cache: str | None = None) -> Scan:
    """Reads and parses a tree once and plans every analysis on the result. Compat: depth and tests are
    accepted and make no difference. With a `cache` folder only files that it has not seen are parsed."""
    ensure_importable(spark)
    if mode != "intended":
        include_tests, max_depth = True, 0
    ignored = srctree.ignored_directories(root)
    options = {"ignore": ",".join(ignored), "languages": ",".join(languages or []), "maxDepth": str(max_depth), "includeTests": str(include_tests).lower()}
    tree, kept, parsed_now = srctree.read_tree(spark, root, **options), [], None
    if cache:
        tree = tree.persist()
        kept.append(tree)
        parsed, parsed_now = parse_changed(tree, cache)
    else:
        parsed = parsers.parse_files(tree)
    parsed = parsed.persist()
    listing = srctree.listing(spark, root).persist()
    lines = n_lines_scan(F.col("text"))
    good = parsed.filter("error is null")
    functions, classes = parsers.functions_of(parsed), parsers.classes_of(parsed)
    if mode != "intended":
        functions = functions.withColumn("decorators", F.array().cast("array<string>"))
    counts = {"total_functions": F.size("functions"), "total_classes": F.size("classes"), "total_imports": F.size("imports")}
    sizes = good.select("file", lines.alias("lines"), (F.size("functions") + F.size("classes")).alias("exports"))
    nodes, ranged = ordered(good, "file")
    calls = symbols.call_sites(good.select("file", "text"), mode)
    exported = good.select(F.explode("exported").alias("name"))
    targets = import_targets(parsers.imports_of(parsed), mode)
    edges = stored(graph.resolved_edges(targets, listing, nodes, mode), "edges")
    members = components.components(edges) if mode == "intended" else edges.limit(0)
    location = F.struct("file", F.col("start_line").alias("line"), "name", (F.col("end_line") - F.col("start_line") + 1).alias("line_count"))
    return Scan(
        summary=symbols.scan_summary(parsed, lines, F.col("language"), counts),
        dead_code=symbols.dead_functions(functions, calls, mode, exported),
        duplicates=symbols.duplicate_groups(functions, "body_hash", location, F.struct("file", "start_line")),
        god_files=symbols.god_files(sizes, F.col("lines"), F.col("exports")),
        nodes=nodes,
        edges=edges,
        members=members,
        cycles=components.fundamental_cycles(edges, members) if mode == "intended" else edges.limit(0),
        subprojects=files.subprojects(listing, mode),
        functions=functions,
        calls=calls,
        parsed=parsed,
        mode=mode,
        parsed_now=parsed_now,
        kept=[parsed, listing, ranged, *kept],
    )
