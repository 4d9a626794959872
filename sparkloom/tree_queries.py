"""Queries on source trees that are made from the driver's tables, with DuckDB SQL for each.

Every supplier is a source file in its nation's directory, every part a function in one; names,
sizes and calls follow from the keys, so SQL tells what a parser or a scan has to find without
parsing anything.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .control import diff
from .functions import tables as T
from .functions import text as X
from .operators import components, files, graph, history, scoring, similar, symbols
from .operators.ranking import ranked
from .plans import incremental
from .plans.scan import import_targets
from .queries import query, table
from .session import shared_dir, stored
from .sources import parsers, srctree
from .sources.sql import register_functions

HEADS = {
    "python": ['"""Parts of supplier {s}."""', "from .s{t} import part_{s}", "import os", ""],
    "javascript": ["import {{ part_{s} }} from './s{t}';", "import os from 'os';", ""],
    "typescript": ["import {{ part_{s} }} from './s{t}';", "import os from 'os';", ""],
    "go": ["package s{s}", "", "import (", '\t"fmt"', '\t"example.com/s{t}"', ")", ""],
}
FUNCTIONS = {
    "python": ["{mark}", "def part_{k}(x):", "    # part_{d}(x) is another", "    return part_{c}(x) + {z}", ""],
    "javascript": ["// part {k}", "function part_{k}(x) {{", "  // part_{d}(x) is another", "  return part_{c}(x) + {z};", "}}", ""],
    "typescript": ["// part {k}", "export function part_{k}(x: number): number {{", "  // part_{d}(x) is another", "  return part_{c}(x) + {z};", "}}", ""],
    "go": ["// part {k}", "func part_{k}(x int) int {{", "\t// part_{d}(x) is another", "\treturn part_{c}(x) + {z}", "}}", ""],
}
CLASSES = {
    "python": ["class Supplier_{s}:", "    def name(self):", "        return {s}", "", "    def __init__(self):", "        pass", "", "def main():", "    pass", ""],
    "javascript": ["class Supplier_{s} {{", "  name() {{", "    return {s};", "  }}", "}}", ""],
    "typescript": ["class Supplier_{s} {{", "  name(): number {{", "    return {s};", "  }}", "}}", ""],
    "go": ["type Supplier_{s} struct {{", "\tid int", "}}", ""],
}
SUFFIXES = {"python": ".py", "javascript": ".js", "typescript": ".ts", "go": ".go"}


def _template(lines: list[str]) -> str:
    """An expression that both engines read: lines with the values of columns put in."""
    out = []
    for piece in re.split(r"(\{\w+\})", "\n".join(lines).replace("{{", "\x01").replace("}}", "\x02")):
        if re.fullmatch(r"\{\w+\}", piece):
            out.append(f"CAST({piece[1:-1]} AS STRING)")
        elif piece:
            plain = piece.replace("\x01", "{").replace("\x02", "}").replace("'", "''")
            out.append(" || chr(10) || ".join(" || chr(9) || ".join(f"'{y}'" for y in x.split("\t")) for x in plain.split("\n")))
    return " || ".join(out)


def _by_language(lines: dict[str, list[str]]) -> str:
    return "CASE language " + " ".join(f"WHEN '{k}' THEN {_template(v)}" for k, v in lines.items()) + " END"


_LANGUAGE = "CASE WHEN n % 5 = 0 AND s % 3 = 0 THEN 'go' WHEN s % 4 = 0 THEN 'javascript' WHEN s % 4 = 1 THEN 'typescript' ELSE 'python' END"
_SUFFIX = "CASE language " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SUFFIXES.items()) + " END"

#: files f (s, n, t: the next supplier of the nation, language, file, m: functions) and parts p (s, k, z, i: place, c: callee).
_BASE = f"""f0 AS (SELECT s_suppkey AS s, s_nationkey AS n, coalesce(lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), min(s_suppkey) OVER (PARTITION BY s_nationkey)) AS t FROM supplier),
    f1 AS (SELECT *, {_LANGUAGE} AS language FROM f0), f2 AS (SELECT *, 'n' || CAST(n AS STRING) || '/s' || CAST(s AS STRING) || {_SUFFIX} AS file FROM f1),
    p0 AS (SELECT p_partkey % 1000 + 1 AS s, p_partkey AS k, p_size AS z, p_partkey - p_partkey % 3 AS c, p_partkey + 1 AS d, CASE WHEN p_partkey % 7 = 0 THEN '@app.route' ELSE '# plain' END AS mark FROM part),
    p AS (SELECT p0.*, f2.language, f2.file, f2.n, row_number() OVER (PARTITION BY p0.s ORDER BY k) - 1 AS i FROM p0 JOIN f2 ON p0.s = f2.s),
    f AS (SELECT f2.*, coalesce(q.m, 0) AS m FROM f2 LEFT JOIN (SELECT s, count(*) AS m FROM p GROUP BY s) q ON f2.s = q.s)"""


def _views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")

    def run(name: str) -> DataFrame:
        return spark.sql(f"WITH part AS (SELECT * FROM {{part}}), supplier AS (SELECT * FROM {{supplier}}), {_BASE} SELECT * FROM {name}", part=part, supplier=supplier)

    return run("f"), run("p")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, language, content, error) of the tree that the tables make."""
    f, p = _views(spark, sf_dir)
    blocks = p.select("s", "i", F.expr(_by_language(FUNCTIONS)).alias("b"))
    bodies = blocks.groupBy("s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "b"))), lambda x: x["b"]), "\n").alias("b"))
    text = F.concat_ws("\n", F.expr(_by_language(HEADS)), F.col("b"), F.expr(_by_language(CLASSES)))
    return f.join(bodies, "s", "left").select("file", "language", text.cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.parse_files(source_files(spark, sf_dir))


# -- parsers ---------------------------------------------------------------------------------

_DEF = "CASE language WHEN 'python' THEN 6 + 5 * i WHEN 'go' THEN 9 + 6 * i ELSE 5 + 6 * i END"
_LENGTH = "CASE language WHEN 'python' THEN 2 ELSE 3 END"
_TAIL = "CASE language WHEN 'python' THEN 5 + 5 * m WHEN 'go' THEN 8 + 6 * m ELSE 4 + 6 * m END"
_BODY = _by_language({"python": ["return part_{c}(x) + {z}"], "javascript": ["{{", "return part_{c}(x) + {z};", "}}"], "typescript": ["{{", "return part_{c}(x) + {z};", "}}"], "go": ["{{", "return part_{c}(x) + {z}", "}}"]})
_NAME_BODY = _by_language({"python": ["return {s}"], "javascript": ["{{", "return {s};", "}}"], "typescript": ["{{", "return {s};", "}}"]})
#: all functions: of parts, and of classes and scripts.
_FUNCTIONS = f"""fn AS (SELECT file, language, 'part_' || k AS name, {_DEF} AS a, {_DEF} + {_LENGTH} AS b, {_BODY} AS body, CASE WHEN language = 'python' AND k % 7 = 0 THEN 'app.route' ELSE '' END AS decorators FROM p
    UNION ALL SELECT file, language, 'name', {_TAIL} + 1, {_TAIL} + CASE language WHEN 'python' THEN 2 ELSE 3 END, {_NAME_BODY}, '' FROM f WHERE language <> 'go'
    UNION ALL SELECT file, language, '__init__', {_TAIL} + 4, {_TAIL} + 5, 'pass', '' FROM f WHERE language = 'python'
    UNION ALL SELECT file, language, 'main', {_TAIL} + 7, {_TAIL} + 8, 'pass', '' FROM f WHERE language = 'python')"""
_OF = {"python": "('python')", "script": "('javascript', 'typescript')", "go": "('go')"}


def _languages(name: str) -> list[str]:
    return [k for k in SUFFIXES if k == name or name == "script" and k not in ("python", "go")]


def _of_language(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return parsers.parse_files(source_files(spark, sf_dir).filter(F.col("language").isin(*_languages(name))))


def _add_parser_queries(name: str) -> None:
    def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = parsers.functions_of(_of_language(spark, sf_dir, name))
        return rows.select("file", "name", "start_line", "end_line", F.array_join("decorators", ",").alias("decorators"), "body_hash")

    def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
        return parsers.classes_of(_of_language(spark, sf_dir, name)).select("file", "name", "start_line", "end_line", F.array_join("methods", ",").alias("methods"))

    def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
        return parsers.imports_of(_of_language(spark, sf_dir, name)).select("file", F.col("at").alias("place"), F.array_join("names", ",").alias("names"), "from_module", "line")

    end = f"{_TAIL} + CASE language WHEN 'python' THEN 5 WHEN 'go' THEN 2 ELSE 4 END"
    methods = "CASE language WHEN 'python' THEN 'name,__init__' WHEN 'go' THEN '' ELSE 'name' END"
    first = {"python": "'part_' || s, '.s' || t, 2", "script": "'part_' || s, './s' || t, 1", "go": "'', 'fmt', 4"}[name]
    second = {"python": "'os', NULL, 3", "script": "'*', 'os', 2", "go": "'', 'example.com/s' || t, 5"}[name]
    each = (
        (functions, f"WITH {_BASE}, {_FUNCTIONS} SELECT file, name, a::INTEGER AS start_line, b::INTEGER AS end_line, decorators, sha256(body) AS body_hash FROM fn WHERE language IN {_OF[name]}"),
        (classes, f"WITH {_BASE} SELECT file, 'Supplier_' || s AS name, ({_TAIL})::INTEGER AS start_line, ({end})::INTEGER AS end_line, {methods} AS methods FROM f WHERE language IN {_OF[name]}"),
        (imports, f"WITH {_BASE}, r AS (SELECT file, language, 0, {first} FROM f UNION ALL SELECT file, language, 1, {second} FROM f), x(file, language, place, names, from_module, line) AS (SELECT * FROM r) SELECT file, place::INTEGER AS place, names, from_module, line::INTEGER AS line FROM x WHERE language IN {_OF[name]}"),
    )
    for f, sql in each:
        f.__name__ = f"{name}_{f.__name__}"
        query(sql)(f)


for _name in _OF:
    _add_parser_queries(_name)


@query("SELECT n_nationkey AS n, CASE n_nationkey % 5 WHEN 0 THEN 'SyntaxError' WHEN 1 THEN 'UnicodeDecodeError' WHEN 2 THEN 'KeyError' WHEN 3 THEN 'gone' ELSE '' END AS reason, (n_nationkey % 5 = 4)::INTEGER AS functions FROM nation")
def unreadable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that cannot be read, decoded or parsed are rows with a reason."""
    n = F.col("n_nationkey")
    content = F.when(n % 5 == 0, F.lit("def (:\n").cast("binary")).when(n % 5 == 1, F.unhex(F.lit("78203D2027E92720"))).otherwise(F.lit("def f(): pass\n").cast("binary"))
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), n, F.lit(".py")).alias("file"), F.when(n % 5 == 2, "unheard").otherwise("python").alias("language"), content.alias("content"), F.when(n % 5 == 3, "gone").alias("error"))
    got = parsers.parse_files(rows)
    number = F.regexp_extract("file", r"(\d+)", 1).cast("int")
    return got.select(number.alias("n"), F.coalesce(F.regexp_extract("error", r"^(\w+)", 1), F.lit("")).alias("reason"), F.size("functions").alias("functions"))


@query("SELECT r_regionkey AS r, r_name AS name, r_regionkey + 1 AS line FROM region")
def added_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parser that is registered for a language of one's own: headings are functions."""

    def headings(text: str) -> parsers.Symbols:
        found = [{"name": x[2:], "start_line": i, "end_line": i, "body": x, "decorators": []} for i, x in enumerate(text.split("\n"), 1) if x.startswith("# ")]
        return {"functions": found, "classes": [], "imports": [], "exported": []}

    parsers.register("notes", headings)
    r = F.col("r_regionkey")
    text = F.concat(F.repeat(F.lit("text\n"), r), F.lit("# "), "r_name", F.lit("\n"))
    rows = table(spark, sf_dir, "region").select(r.cast("string").alias("file"), F.lit("notes").alias("language"), text.cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))
    got = parsers.functions_of(parsers.parse_files(rows))
    return got.select(F.col("file").cast("int").alias("r"), "name", F.col("start_line").alias("line"))


#: Result types, return types and lines whose brackets are not those of a body.
_GO_RESULTS = ("int", "interface{}", "map[string]interface{}", "(chan struct{}, error)", "func(int) struct{}", "*q.Set[int]", "[]struct{ a int }")
_SCRIPT_LINES = ("return /\\/\\//.test(s)", "return `}${ {a: 1} }`", "return s / 2 / {}", "if (s) /}/.exec(s)", "return \"{\" + s")
_SCRIPT_RESULTS = ("", ": number", ": { a: number }", ": Promise<{ a: { b: 1 } }>")


def _one_of(values: tuple[str, ...]) -> str:
    """One of some texts by k, in SQL that both engines read."""
    each = [" || chr(92) || ".join(f"'{x}'" for x in v.replace("'", "''").split("\\")) for v in values]
    return f"(CASE k % {len(values)} {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(each))} END)"


_TRICKY = f"""t AS (SELECT p_partkey AS k, 'n' || CAST(p_partkey AS STRING) || '.go' AS file, 'go' AS language, {_one_of(_GO_RESULTS)} AS x, '' AS y FROM (SELECT *, p_partkey AS k FROM part)
    UNION ALL SELECT p_partkey, 'n' || CAST(p_partkey AS STRING) || '.ts', 'typescript', {_one_of(_SCRIPT_LINES)}, {_one_of(_SCRIPT_RESULTS)} FROM (SELECT *, p_partkey AS k FROM part))"""
_TRICKY_TEXT = """CASE language WHEN 'go' THEN 'package p' || chr(10) || 'func A() ' || x || ' {' || chr(10) || 'return v' || chr(10) || '}' || chr(10) || 'func B() {' || chr(10) || '}'
    ELSE 'function A(s) { ' || x || chr(10) || '}' || chr(10) || 'const B = (s)' || y || ' => {' || chr(10) || '}' END"""


@query(
    f"""WITH {_TRICKY} SELECT file, 'A' AS name, CASE language WHEN 'go' THEN 2 ELSE 1 END AS start_line, CASE language WHEN 'go' THEN 4 ELSE 2 END AS end_line, sha256(CASE language WHEN 'go' THEN '{{' || chr(10) || 'return v' || chr(10) || '}}' ELSE '{{ ' || x || chr(10) || '}}' END) AS body_hash FROM t
    UNION ALL SELECT file, 'B', CASE language WHEN 'go' THEN 5 ELSE 3 END, CASE language WHEN 'go' THEN 6 ELSE 4 END, sha256('{{' || chr(10) || '}}') FROM t""".replace("{{", "{").replace("}}", "}")
)
def composite_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions whose types, regular expressions and templates hold brackets: two in each of two files a part."""
    rows = spark.sql(f"WITH part AS (SELECT * FROM {{part}}), {_TRICKY.replace('{', '{{').replace('}', '}}')} SELECT file, language, CAST({_TRICKY_TEXT.replace('{', '{{').replace('}', '}}')} AS BINARY) AS content, CAST(NULL AS STRING) AS error FROM t", part=table(spark, sf_dir, "part"))
    return parsers.functions_of(parsers.parse_files(rows)).select("file", "name", "start_line", "end_line", "body_hash")


@query(f"WITH {_BASE}, {_FUNCTIONS} SELECT language, file, name, a::INTEGER AS start_line, b::INTEGER AS end_line, decorators, sha256(body) AS body_hash FROM fn")
def functions_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsers called from SQL alone."""
    register_functions(spark)
    files = source_files(spark, sf_dir)
    return spark.sql("SELECT language, file, f.name, f.start_line, f.end_line, array_join(f.decorators, ',') AS decorators, f.body_hash FROM {files}, LATERAL source_symbols(language, content, 'functions') f", files=files)


# -- analyses of the parsed tree ---------------------------------------------------------------

_LINES = "CASE language WHEN 'python' THEN 14 + 5 * m WHEN 'go' THEN 11 + 6 * m ELSE 9 + 6 * m END"
_EXPORTS = "m + CASE language WHEN 'python' THEN 4 WHEN 'go' THEN 1 ELSE 2 END"
#: definitions that nothing calls: callees are the multiples of 3, decorated ones and entry points are in use.
_DEAD = "dead AS (SELECT * FROM fn WHERE name = 'name' OR (name LIKE 'part_%' AND TRY_CAST(substr(name, 6) AS BIGINT) NOT IN (SELECT c FROM p) AND decorators = ''))"
_EDGES = "edges AS (SELECT a.file AS a, b.file AS b, a.n FROM f a JOIN f b ON a.t = b.s WHERE a.language <> 'go' AND b.language <> 'go')"
_RINGS = "rings AS (SELECT n FROM f GROUP BY n HAVING sum(CASE WHEN language = 'go' THEN 1 ELSE 0 END) = 0)"


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.select("file", X.n_lines_scan(F.col("text")).alias("lines"), (F.size("functions") + F.size("classes")).alias("exports"))


def _dead(rows: DataFrame) -> DataFrame:
    return symbols.dead_functions(parsers.functions_of(rows), symbols.call_sites(rows.select("file", "text")), exported=rows.select(F.explode("exported").alias("name")))


def _nodes(rows: DataFrame) -> DataFrame:
    return ranked(rows.select("file"), [], ["file"], "ordinal")


def _import_edges(rows: DataFrame) -> DataFrame:
    return graph.resolved_edges(import_targets(parsers.imports_of(rows), "intended"), rows.select(F.col("file").alias("path")), _nodes(rows))


@query(f"WITH {_BASE} SELECT count(*) AS total_files, sum({_LINES})::BIGINT AS total_lines, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, sum({_EXPORTS} - 1)::BIGINT AS total_functions, count(*) AS total_classes, (2 * count(*))::BIGINT AS total_imports FROM f")
def tree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed(spark, sf_dir)
    counts = {"total_functions": F.size("functions"), "total_classes": F.size("classes"), "total_imports": F.size("imports")}
    return symbols.scan_summary(rows, X.n_lines_scan(F.col("text")), F.col("language"), counts).withColumn("languages_detected", F.array_join("languages_detected", ",")).withColumnRenamed("languages_detected", "languages")


@query(f"WITH {_BASE}, {_FUNCTIONS}, {_DEAD} SELECT name AS symbol, file, a::INTEGER AS line, 'no_callers' AS reason FROM dead")
def dead_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dead(stored(parsed(spark, sf_dir), "parsed"))


@query(f"WITH {_BASE}, {_FUNCTIONS}, h AS (SELECT *, sha256(body) AS hash FROM fn) SELECT h.hash, g.n, file, name, a::INTEGER AS line, (b - a + 1)::INTEGER AS line_count FROM h JOIN (SELECT hash, count(*) AS n FROM h GROUP BY hash HAVING count(*) >= 2) g ON h.hash = g.hash")
def duplicate_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    location = F.struct("file", F.col("start_line").alias("line"), "name", (F.col("end_line") - F.col("start_line") + 1).alias("line_count"))
    got = symbols.duplicate_groups(parsers.functions_of(parsed(spark, sf_dir)), "body_hash", location, F.struct("file", "start_line"))
    return got.select("hash", "n", F.explode("locations").alias("x")).select("hash", "n", "x.file", "x.name", "x.line", "x.line_count")


@query(
    f"""WITH {_BASE}, {_FUNCTIONS}, w AS (SELECT file, a, name, list_sort(list_distinct(regexp_extract_all(body, '{similar.TOKEN}'))) AS s FROM fn),
    c AS (SELECT min({{'f': file, 'l': a, 'n': name}}) AS c, s FROM w GROUP BY s), e AS (SELECT c, len(s) AS n, unnest(s) AS t FROM c),
    x AS (SELECT p.c AS p, q.c AS q, p.n AS np, q.n AS nq, count(*) AS shared FROM e p JOIN e q ON p.t = q.t AND p.c < q.c GROUP BY ALL)
    SELECT p.f AS first_file, p.n AS first_name, q.f AS second_file, q.n AS second_name, shared / (np + nq - shared) AS score FROM x WHERE shared * 5 >= (np + nq - shared) * 4"""
)
def similar_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions whose bodies share 0.8 of their tokens: scripts' with the same number in them, and such that two
    languages write almost alike."""
    got = similar.similar_functions(parsed(spark, sf_dir))
    return got.select(*[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in ("first", "second") for c in ("file", "name")], "score")


@query(f"WITH {_BASE} SELECT file, ({_LINES})::INTEGER AS lines, ({_EXPORTS})::INTEGER AS exports FROM f WHERE {_LINES} > 24 OR {_EXPORTS} > 5")
def large_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.god_files(_sizes(parsed(spark, sf_dir)), F.col("lines"), F.col("exports"), 24, 5)


@query(f"WITH {_BASE}, {_EDGES} SELECT a AS from_file, b AS to_file FROM edges")
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _import_edges(stored(parsed(spark, sf_dir), "parsed")).select(F.col("from").alias("from_file"), F.col("to").alias("to_file"))


@query(f"WITH {_BASE}, {_EDGES} SELECT b AS file, count(DISTINCT a) AS inbound FROM edges WHERE a <> b GROUP BY b")
def import_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_degree(_import_edges(stored(parsed(spark, sf_dir), "parsed")))


@query(f"WITH {_BASE}, {_RINGS} SELECT file FROM f JOIN rings ON f.n = rings.n")
def import_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycle_members(_import_edges(stored(parsed(spark, sf_dir), "parsed")))


@query(f"WITH {_BASE}, {_RINGS}, x AS (SELECT f.*, min(file) OVER (PARTITION BY f.n) AS least FROM f JOIN rings ON f.n = rings.n), y AS (SELECT *, max(CASE WHEN file = least THEN s END) OVER (PARTITION BY n) AS w FROM x) SELECT least || '>' || string_agg(CASE WHEN file <> least THEN file || '>' ELSE '' END, '' ORDER BY s < w, s) || least AS cycle FROM y GROUP BY n, least")
def import_cycle_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of imports, however long they are: the files of a nation import each other in a ring."""
    edges = _import_edges(stored(parsed(spark, sf_dir), "parsed"))
    return components.fundamental_cycles(edges).select(F.array_join("cycle", ">").alias("cycle"))


_TESTS = "tests AS (SELECT n, min(k) AS q FROM p WHERE k % 3 = 0 GROUP BY n)"


@query(
    f"""WITH {_BASE}, {_FUNCTIONS}, {_DEAD}, {_EDGES}, {_RINGS}, {_TESTS}, average AS (SELECT sum({_LINES}) / count(*) AS x FROM f),
    e AS (SELECT b, count(DISTINCT a) AS inbound FROM edges WHERE a <> b GROUP BY b),
    r AS (SELECT p.k, p.file, least(30, 6 * coalesce(e.inbound, 0))::INTEGER AS inbound_refs, CASE WHEN p.k IN (SELECT q FROM tests) AND 'part_' || p.k NOT IN (SELECT name FROM dead) THEN 0 ELSE 20 END AS has_tests,
        CASE WHEN {_LINES} > 24 OR {_EXPORTS} > 5 THEN {_LINES} ELSE average.x END AS own, CASE WHEN f.n IN (SELECT n FROM rings) THEN 25 ELSE 0 END AS is_circular FROM p JOIN f ON p.file = f.file LEFT JOIN e ON e.b = p.file CROSS JOIN average WHERE p.i = 0),
    x AS (SELECT *, CASE WHEN own <= 50 THEN 5 WHEN own <= 150 THEN 10 WHEN own <= 300 THEN 17 ELSE 25 END AS lines_changed FROM r), y AS (SELECT *, inbound_refs + has_tests + lines_changed + is_circular AS score FROM x)
    SELECT 'part_' || k AS symbol, file, inbound_refs, has_tests, lines_changed, is_circular, score, CASE WHEN score <= 30 THEN 'safe to fix' WHEN score <= 60 THEN 'fix with caution' ELSE 'manual review recommended' END AS recommendation FROM y""".replace(f"{_LINES} > 24", f"{_LINES.replace('language', 'f.language')} > 24").replace(f"THEN {_LINES} ELSE", f"THEN {_LINES.replace('language', 'f.language')} ELSE").replace(f"{_EXPORTS} > 5", f"{_EXPORTS.replace('language', 'f.language')} > 5")
)
def change_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of changing the first function of each file; a test file of each nation calls one."""
    rows = stored(parsed(spark, sf_dir), "parsed")
    _, p = _views(spark, sf_dir)
    tests = p.filter("k % 3 = 0").groupBy("n").agg(F.min("k").alias("q"))
    tests = tests.select(F.expr("'tests/test_n' || n || '.py'").alias("file"), F.expr("'def test_n' || n || '():' || chr(10) || '    part_' || q || '(1)' || chr(10)").alias("text"))
    calls = symbols.call_sites(rows.select("file", "text").union(tests))
    edges, dead = _import_edges(rows), _dead(rows)
    gods = symbols.god_files(_sizes(rows), F.col("lines"), F.col("exports"), 24, 5)
    targets = p.filter("i = 0").select(F.expr("'part_' || k").alias("symbol"), "file")
    summary = symbols.scan_summary(rows, X.n_lines_scan(F.col("text")), F.col("language"))
    return scoring.risk_of(targets, edges, _nodes(rows), graph.cycle_members(edges), dead, gods, summary, calls)


_WORDS = ("router", "cmd_cli", "view_layout", "parser", "fire", "package", "render", "endpoint", "store", "typer", "test_x", "utils")
_MAKERS = {1: ["python"], 2: ["javascript", "python"], 3: ["typescript"], 4: [], 5: ["go"]}
_NAMES = f"""a AS (SELECT p_partkey AS k, CAST(substr(p_brand, length(p_brand)) AS INT) % 5 + 1 AS m, CASE WHEN p_partkey % 50 = 7 THEN 'd' || CAST(p_partkey AS STRING) || '/main.py' WHEN p_partkey % 70 = 9 THEN 'Utils.py'
    ELSE (CASE (p_partkey * p_size) % {len(_WORDS)} {" ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WORDS))} END) || CAST(p_partkey % 30 AS STRING) || '.py' END AS file FROM part)"""


def _shape_sql() -> str:
    """Shares of files with a marker, best class (the first of equals), entry points, first modules."""
    hit = lambda marks: " OR ".join(f"contains(s, '{x}')" for x in marks)
    shares = ", ".join(f"sum(({hit(marks)})::INT) / greatest(count(*), 1) AS c{k}" for k, (_, marks) in enumerate(T.ARCHITECTURES))
    bonus = {2: [m for m, x in _MAKERS.items() if x == ["python"]], 3: [m for m, x in _MAKERS.items() if x and "python" not in x and x != ["go"]]}
    more = lambda k, by: f" + CASE WHEN m IN ({', '.join(map(str, bonus[k]))}) THEN {by} ELSE 0 END"
    scores = f"c0::DOUBLE AS s0, c1::DOUBLE AS s1, c2{more(2, 0.05)} AS s2, c3{more(3, 0.2)} AS s3"
    names = " ".join(f"WHEN s{k} = best THEN '{name}'" for k, (name, _) in enumerate(T.ARCHITECTURES))
    spoken = " ".join(f"WHEN {m} THEN '{', '.join(x) or 'unknown language'}'" for m, x in _MAKERS.items())
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    return f"""WITH {_NAMES}, b AS (SELECT *, regexp_replace(lower(string_split(file, '/')[-1]), '\\.py$', '') AS s FROM a),
    p AS (SELECT m, {shares} FROM b GROUP BY m), q AS (SELECT m, {scores} FROM p), r AS (SELECT *, greatest(s0, s1, s2, s3) AS best FROM q), c AS (SELECT m, best, CASE {names} END AS pattern FROM r),
    e AS (SELECT m, list(file ORDER BY k) AS entries FROM (SELECT m, file, min(k) AS k FROM b WHERE s IN ({quoted(T.ENTRY_POINT_STEMS)}) GROUP BY m, file) GROUP BY m),
    d AS (SELECT m, s, min(k) AS k FROM b WHERE s <> '' AND s NOT IN ({quoted(T.MODULES_SKIPPED)}) AND NOT starts_with(s, 'test_') GROUP BY m, s),
    n AS (SELECT m, list(s ORDER BY k) AS modules FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY k) AS i FROM d) WHERE i <= 20 GROUP BY m),
    t AS (SELECT m, pattern, coalesce(entries, []) AS entries, coalesce(modules, []) AS modules, least(1.0, round(best * 3 + 0.2, 2))::DOUBLE AS confidence FROM c LEFT JOIN e USING (m) LEFT JOIN n USING (m))
    SELECT m AS maker, pattern, array_to_string(entries, ',') AS entry_points, array_to_string(modules, ',') AS modules, confidence, trim('This appears to be a ' || pattern || ' written in ' || CASE m {spoken} END || '. ' ||
        CASE WHEN len(entries) > 0 THEN 'Entry point' || CASE WHEN len(entries) <> 1 THEN 's' ELSE '' END || ': ' || array_to_string(entries[:3], ', ') || '.' ELSE 'No clear entry point detected.' END || ' ' ||
        CASE WHEN len(modules) > 0 THEN 'Logical modules include: ' || array_to_string(modules[:5], ', ') || '.' ELSE '' END) AS hypothesis FROM t"""


@query(_shape_sql())
def likely_architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likely architecture of five trees, whose files are the parts of brands by last digit."""
    files = spark.sql(f"WITH part AS (SELECT * FROM {{part}}), {_NAMES} SELECT * FROM a", part=table(spark, sf_dir, "part"))
    out = None
    for m, languages in _MAKERS.items():
        got = scoring.architecture(files.filter(F.col("m") == m).select("file", F.col("k").alias("ordinal")), languages)
        got = got.select(F.lit(m).alias("maker"), "pattern", F.array_join("entry_points", ",").alias("entry_points"), F.array_join("inferred_modules", ",").alias("modules"), "confidence", "hypothesis")
        out = got if out is None else out.union(got)
    return out


_MARKED = ", ".join(f"('{name}', '{lang}', '{cmd}', {k})" for k, (name, lang, cmd) in enumerate(T.SUBPROJECT_MARKERS))


@query(
    f"""WITH markers(name, language, test_command, priority) AS (VALUES {_MARKED}), d AS (SELECT s_suppkey AS s, CASE WHEN s_suppkey % 10 = 0 THEN 'node_modules/x' || s_suppkey ELSE 'n' || s_nationkey || '/d' || s_suppkey END AS root FROM supplier),
    h AS (SELECT d.*, markers.* FROM d CROSS JOIN markers WHERE s % 10 <> 0 AND (s + priority) % 3 = 0 AND s % 4 <> priority)
    SELECT root, language, test_command, priority::INTEGER AS marker_priority FROM h QUALIFY row_number() OVER (PARTITION BY root ORDER BY priority) = 1"""
)
def marked_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories with marker files; one in ten is below node_modules, and the root's own are none."""
    s = F.col("s_suppkey")
    root = F.when(s % 10 == 0, F.concat(F.lit("node_modules/x"), s)).otherwise(F.concat(F.lit("n"), "s_nationkey", F.lit("/d"), s))
    each = [F.when(((s + k) % 3 == 0) & (s % 4 != k), F.concat(root, F.lit(f"/{name}"))) for k, (name, _, _) in enumerate(T.SUBPROJECT_MARKERS)]
    paths = F.array(*each, F.concat(root, F.lit("/main.py")), F.lit("setup.py"))
    return files.subprojects(table(spark, sf_dir, "supplier").select(F.explode(paths).alias("path")).filter("path is not null"))


@query(f"SELECT page_id, len(list_filter(string_split(regexp_replace(url, '[?#].*$', ''), '/'), lambda x: x IN ({', '.join(repr(x) for x in T.IGNORED_DIRECTORIES)}, 'blog', 'docs'))) > 0 AS ignored FROM pages")
def ignored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", files.in_ignored_directory(path, (*T.IGNORED_DIRECTORIES, "blog", "docs")).alias("ignored"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS at FROM events")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", X.iso_time(F.col("ts")).alias("at"))


_CHAIN = """g0 AS (SELECT p_partkey AS k, p_partkey % 1000 + 1 AS s FROM part), g AS (SELECT *, 'n' || CAST(s AS STRING) || '.py' AS file, row_number() OVER (PARTITION BY s ORDER BY k) - 1 AS i FROM g0)"""


@query(
    f"""WITH RECURSIVE {_CHAIN}, called AS (SELECT k FROM g WHERE k % 97 = 0 UNION SELECT s FROM g WHERE s % 10 = 0 UNION SELECT CAST(floor(k / 2) AS BIGINT) FROM called WHERE k > 0),
    u AS (SELECT DISTINCT CAST(floor(k / 2) AS BIGINT) AS k FROM g UNION SELECT s FROM g WHERE s % 10 = 0)
    SELECT 'f_' || k AS symbol, file, (3 + 3 * i)::INTEGER AS line, CASE WHEN k IN (SELECT k FROM u) THEN 'dead_callers' ELSE 'no_callers' END AS reason FROM g WHERE k NOT IN (SELECT k FROM called)"""
)
def unreachable_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's function calls that of half its key; one in 97 is a callback, and one file in ten calls
    a function when it is loaded."""
    g = spark.sql(f"WITH part AS (SELECT * FROM {{part}}), {_CHAIN} SELECT * FROM g", part=table(spark, sf_dir, "part"))
    mark = F.when(F.col("k") % 97 == 0, "@app.route").otherwise("# plain")
    block = F.concat_ws("\n", mark, F.concat(F.lit("def f_"), F.col("k"), F.lit("(x):")), F.concat(F.lit("    return f_"), F.floor(F.col("k") / 2), F.lit("(x)")))
    last = F.when(F.col("s") % 10 == 0, F.concat(F.lit("f_"), F.col("s"), F.lit("(1)"))).otherwise("x = 1")
    files = g.groupBy("s", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", block.alias("b")))), lambda x: x["b"]), "\n").alias("b"))
    text = F.concat_ws("\n", F.lit("import app"), F.col("b"), last)
    rows = stored(parsers.parse_files(files.select("file", F.lit("python").alias("language"), text.cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))), "parsed")
    return symbols.unreachable_functions(parsers.functions_of(rows), symbols.call_sites(rows.select("file", "text")), rows.select(F.explode("exported").alias("name")))


@query(f"WITH {_BASE}, {_FUNCTIONS} SELECT fn.file, name, a::INTEGER AS start_line, sha256(body) AS body_hash, CASE WHEN f.s % 3 = 0 THEN 3 WHEN f.s % 3 = 1 THEN 2 ELSE 1 END AS scan FROM fn JOIN f ON fn.file = f.file")
def rescanned_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four scans of a growing and changing tree with one cache: the first sees two thirds of the files, in
    the second half of these have changed, in the third the others come; nothing is left for the fourth."""
    cache = f"{shared_dir(spark)}/sparkloom/scan-cache-{uuid.uuid4().hex}"
    every = stored(source_files(spark, sf_dir), "sources")
    s = F.regexp_extract("file", r"s(\d+)\.", 1).cast("int") % 3
    older = every.filter(s != 0).withColumn("content", F.when(s == 1, F.lit("# not yet\n").cast("binary")).otherwise(F.col("content")))
    for tree in (older, every.filter(s != 0), every):
        incremental.parse_changed(tree, cache)
    rows, n = incremental.parse_changed(every, cache)
    if n:
        raise AssertionError(f"{n} files were parsed again")
    scans = rows.select("file", "scan")
    return parsers.functions_of(rows).select("file", "name", "start_line", "body_hash").join(scans, "file")


# -- trees on disk -----------------------------------------------------------------------------


def new_tree(spark: SparkSession, name: str) -> Path:
    """A folder that the driver and, on one machine or a shared disk, all executors see; it goes when
    the driver ends, as lazy results still read it."""
    at = urlparse(shared_dir(spark))
    if at.scheme not in ("", "file"):
        raise ValueError(f"a tree has to lie on a disk that all see, and {shared_dir(spark)} is no such folder")
    base = at.path
    Path(base).mkdir(parents=True, exist_ok=True)
    root = tempfile.mkdtemp(prefix=f"sparkloom-{name}-", dir=base)
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return Path(root)


def _write(root: Path, path: str, content: bytes) -> None:
    at = root / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_bytes(content)


def write_files(files: DataFrame, root: Path) -> int:
    """Writes (path, content) rows below a root that all tasks see, and returns their number. A task that is
    repeated writes the same."""
    at = str(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                _write(Path(at), path, bytes(content))
            yield pd.DataFrame({"n": [len(b)]})

    return files.select("path", "content").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


#: Files of a nation that a scan has to leave out, and two that it reads: small ones, but that one in ten is too large.
_EXTRA = """'node_modules/n' || n || '.js', 'gen/n' || n || '.py', 'n' || n || '/build/x.py', 'n' || n || '/bundle.min.js', 'n' || n || '/package-lock.json', 'n' || n || '/notes.md'"""


def written_tree(spark: SparkSession, sf_dir: str) -> Path:
    """The tree of `source_files` on disk, written by tasks, and files among it that a scan has to leave out."""
    root = new_tree(spark, "tree")
    write_files(source_files(spark, sf_dir).withColumnRenamed("file", "path"), root)
    nation = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS n")
    small = nation.select(F.explode(F.expr(f"array({_EXTRA})")).alias("path"), F.lit("x = 1\n").alias("text"))
    root_files = nation.selectExpr("'_n' || n || '.py' AS path", "repeat('x = 1\n', CAST(n AS INT)) AS text")
    big = nation.selectExpr("'tests/big' || n || '.py' AS path", "repeat('x = 1 # filler\n', CASE WHEN n % 10 = 0 THEN 35000 ELSE 1 END) AS text")
    write_files(small.union(root_files).union(big).select("path", F.col("text").cast("binary").alias("content")), root)
    _write(root, "scan.toml", b"[scan]\nignore = ['gen']\n[fix]\nsession_budget = 7\n")
    (root / "out_of_it.py").symlink_to("/etc/hostname")
    return root


_SOURCES = f"""src AS (SELECT f.s, (SELECT string_agg(b, chr(10) ORDER BY i) FROM (SELECT s, i, {_by_language(FUNCTIONS)} AS b FROM p) q WHERE q.s = f.s) AS b FROM f),
    tree AS (SELECT file, f.language, strlen(concat_ws(chr(10), {_by_language(HEADS).replace(" s ", " f.s ").replace("(s ", "(f.s ")}, b, {_by_language(CLASSES).replace("(s ", "(f.s ")})) AS size FROM f JOIN src ON f.s = src.s)"""
_KEPT = "SELECT file, language, size FROM tree UNION ALL SELECT '_n' || n_nationkey || '.py', 'python', 6 * n_nationkey FROM nation UNION ALL SELECT 'tests/big' || n_nationkey || '.py', 'python', 15 FROM nation WHERE n_nationkey % 10 <> 0"


def _tree(spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    root = str(written_tree(spark, sf_dir))
    return srctree.read_tree(spark, root, ignore=",".join(srctree.ignored_directories(root)), **options).select("file", "language", "size")


@query(f"WITH {_BASE}, {_SOURCES} SELECT file, language, size::BIGINT AS size FROM ({_KEPT})")
def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan reads of a tree on disk: ignored directories of the config, lock files, minified
    and oversized ones, other suffixes and links that lead out are left."""
    return _tree(spark, sf_dir)


@query(f"WITH {_BASE}, {_SOURCES} SELECT file, language, size::BIGINT AS size FROM ({_KEPT}) WHERE language IN ('go', 'typescript')")
def tree_files_of_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir, languages="go,typescript")


@query("SELECT '_n' || n_nationkey || '.py' AS file, 'python' AS language, (6 * n_nationkey)::BIGINT AS size FROM nation")
def tree_files_of_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir, maxDepth="1", includeTests="false")


# -- diffs, logs, transactions ------------------------------------------------------------------


@query(
    """WITH d AS (SELECT doc_id, replace(text, chr(13), '') AS t FROM documents WHERE text IS NOT NULL AND strlen(text) < 20000), l AS (SELECT doc_id, t, string_split(t, chr(10))[1] AS head FROM d WHERE NOT regexp_matches(t, '[\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AND contains(t, chr(10)) AND string_split(t, chr(10))[1] <> '')
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'first' || chr(10) || 'second' || substr(t, length(head) + 1) WHEN 1 THEN substr(t, length(head) + 2) WHEN 2 THEN NULL ELSE head || chr(10) || 'inserted' || substr(t, length(head) + 1) END AS text FROM l"""
)
def applied_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs on documents: the first line replaced by two, removed, not as the diff has it, kept with
    one more after it."""
    docs = table(spark, sf_dir, "documents").filter("text is not null and octet_length(text) < 20000").select("doc_id", F.replace("text", F.lit("\r"), F.lit("")).alias("t"))
    docs = docs.filter(~F.col("t").rlike("[\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]") & F.contains("t", F.lit("\n"))).withColumn("head", F.split_part("t", F.lit("\n"), F.lit(1))).filter("head != ''")
    head = F.col("head")
    hunk = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("@@ -1 +1,2 @@\n-"), head, F.lit("\n+first\n+second\n")))
    hunk = hunk.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("@@ -1 +0,0 @@\n-"), head, F.lit("\n"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("@@ -1 +1 @@\n-"), head, F.lit("!\n+x\n")))
    hunk = hunk.otherwise(F.concat(F.lit("@@ -1 +1,2 @@\n "), head, F.lit("\n+inserted\n")))
    return docs.select("doc_id", diff.applied_column(F.col("t"), F.concat(F.lit("--- a/t\n+++ b/t\n"), hunk)).alias("text"))


@query(
    """WITH h AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE user_id = (SELECT min(user_id) FROM events)),
    s AS (SELECT format('**Health score:** {:.1f}', value) || CASE WHEN b IS NULL THEN '' ELSE format(' ({:+.1f} from previous scan)', value - b) END AS x FROM h WHERE r = 1),
    d AS (SELECT string_agg('- ' || n_name, chr(10) ORDER BY n_nationkey) AS x FROM nation WHERE n_regionkey = 1),
    p AS (SELECT string_agg('- ' || r_name, chr(10) ORDER BY r_regionkey) AS x FROM region)
    SELECT '# Changes' || chr(10) || chr(10) || s.x || chr(10) || chr(10) || '## Fixes Applied' || chr(10) || chr(10) || d.x || chr(10) || chr(10) || '## Pending Fixes' || chr(10) || chr(10) || p.x || chr(10) AS text FROM s, d, p"""
)
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min("user_id").alias("u"))
    scores = events.join(first, events["user_id"] == first["u"]).select(F.col("event_id").alias("at"), F.col("value").alias("score"))
    nation = table(spark, sf_dir, "nation").filter("n_regionkey = 1")
    fixes = nation.select(F.col("n_nationkey").alias("at"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("message"), F.col("n_name").alias("file"))
    pending = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("at"), F.col("r_name").alias("item"))
    return history.changelog(scores, fixes, pending)
