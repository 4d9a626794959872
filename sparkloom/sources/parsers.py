"""Symbols of source files: a registry of parsers by language, and the table function over files.

Python is parsed with the standard `ast`. JavaScript, TypeScript and Go are read by the masks of
`lexer`, in which brackets are matched and types passed over.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import body_hash
from ..session import bound_batches
from .lexer import after_space, closing, go_body, mask_go, mask_script, script_body

FUNCTION = "struct<name:string,start_line:int,end_line:int,body:string,decorators:array<string>>"
CLASS = "struct<name:string,start_line:int,end_line:int,methods:array<string>>"
IMPORT = "struct<names:array<string>,from_module:string,line:int,alias:string>"
PARSED = f"file string, language string, text string, error string, functions array<{FUNCTION}>, classes array<{CLASS}>, imports array<{IMPORT}>, exported array<string>"

_COLUMNS = ["file", "language", "text", "error", "functions", "classes", "imports", "exported"]
#: Bytes of text whose symbols leave a worker together: they take some twenty times as many.
TOGETHER = 1 << 20

Symbols = dict[str, list]
_REGISTRY: dict[str, Callable[[str], Symbols]] = {}


def register(language: str, parser: Callable[[str], Symbols]) -> None:
    """Adds or replaces the parser of a language: text to functions, classes, imports, exported."""
    _REGISTRY[language] = parser


def parsers_now() -> dict[str, Callable[[str], Symbols]]:
    return _REGISTRY


def _dotted(node: ast.expr) -> str:
    return ast.unparse(node.func if isinstance(node, ast.Call) else node)


def parse_python(text: str) -> Symbols:
    tree = ast.parse(text)
    lines = text.split("\n")
    out: Symbols = {"functions": [], "classes": [], "imports": [], "exported": []}

    def segment(first: ast.stmt, last: ast.stmt) -> str:
        start, col = (first.lineno, first.col_offset)
        for d in getattr(first, "decorator_list", []):
            start, col = min((start, col), (d.lineno, max(0, d.col_offset - 1)))
        part = lines[start - 1 : last.end_lineno]
        part[-1] = part[-1].encode()[: last.end_col_offset].decode("utf-8", "ignore")
        part[0] = part[0].encode()[col:].decode("utf-8", "ignore")
        return "\n".join(part)

    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out["functions"].append({"name": node.name, "start_line": node.lineno, "end_line": node.end_lineno, "body": segment(node.body[0], node.body[-1]), "decorators": [_dotted(d) for d in node.decorator_list]})
        elif isinstance(node, ast.ClassDef):
            methods = [x.name for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
            out["classes"].append({"name": node.name, "start_line": node.lineno, "end_line": node.end_lineno, "methods": methods})
        elif isinstance(node, ast.Import):
            out["imports"] += [{"names": [a.name], "from_module": None, "line": node.lineno, "alias": a.asname} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out["imports"].append({"names": [a.name for a in node.names], "from_module": "." * node.level + (node.module or ""), "line": node.lineno, "alias": None})
        elif isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets):
            if isinstance(node.value, (ast.List, ast.Tuple)):
                out["exported"] += [x.value for x in node.value.elts if isinstance(x, ast.Constant) and isinstance(x.value, str)]
    for k in ("functions", "classes"):
        out[k].sort(key=lambda x: x["start_line"])
    out["imports"].sort(key=lambda x: x["line"])
    return out


class _Lines:
    def __init__(self, text: str):
        self.ends = [m.start() for m in re.finditer("\n", text)]

    def of(self, at: int) -> int:
        return bisect.bisect_left(self.ends, at) + 1


_NAME = r"[A-Za-z_$][\w$]*"
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "return", "function", "with", "do", "else", "new", "await", "typeof"}


def _block(mask: str, open_: int | None) -> tuple[int, int] | None:
    return None if open_ is None else (open_, closing(mask, open_))


def parse_script(text: str) -> Symbols:
    """JavaScript and TypeScript: declarations, generators, methods, arrow constants with blocks,
    classes, import declarations."""
    mask, at = mask_script(text), _Lines(text)
    out: Symbols = {"functions": [], "classes": [], "imports": [], "exported": []}
    seen: set[int] = set()

    def add(name: str, where: int, block: tuple[int, int] | None) -> None:
        if block and where not in seen:
            seen.add(where)
            out["functions"].append({"name": name, "start_line": at.of(where), "end_line": at.of(block[1]), "body": text[block[0] : block[1] + 1], "decorators": []})

    for m in re.finditer(rf"\bfunction\b\s*\*?\s*({_NAME})\s*(?:<[^>(]*>)?\s*\(", mask):
        add(m[1], m.start(1), _block(mask, script_body(mask, m.end() - 1)))
    for m in re.finditer(rf"\b(?:const|let|var)\s+({_NAME})\s*(?::[^=]+(?:=>[^=]+)*)?=\s*(?:async\s*)?(?:<[^>(]*>\s*)?(\()", mask):
        add(m[1], m.start(1), _block(mask, script_body(mask, m.start(2), arrow=True)))
    for m in re.finditer(rf"\b(?:const|let|var)\s+({_NAME})\s*=\s*(?:async\s+)?{_NAME}\s*=>\s*(\{{)", mask):
        add(m[1], m.start(1), (m.start(2), closing(mask, m.start(2))))
    for m in re.finditer(rf"\bclass\s+({_NAME})[^{{;]*(\{{)", mask):
        end, methods = closing(mask, m.start(2)), []
        k = m.end()
        step = re.compile(rf"({_NAME})\s*(?:<[^>(]*>)?\s*\(|[({{\[]")
        while (x := step.search(mask, k, end)) is not None:
            if x[1] and x[1] not in _NOT_METHODS and (block := _block(mask, script_body(mask, x.end() - 1))):
                methods.append(x[1])
                add(x[1], x.start(1), block)
                k = block[1] + 1
            else:
                k = closing(mask, x.end() - 1) + 1
        out["classes"].append({"name": m[1], "start_line": at.of(m.start(1)), "end_line": at.of(end), "methods": methods})
    for m in re.finditer(r"""^[ \t]*import\s+(type\s+)?([^;'"]*?)\s*from\s*(['"])""", mask, re.M):
        close = mask.index(m[3], m.end())
        clause, names = m[2], []
        for part in re.findall(r"\{([^}]*)\}", clause):
            names += [w for x in part.split(",") for w in re.findall(_NAME, x) if w not in ("as", "type")]
        names += re.findall(rf"\*\s*as\s+({_NAME})", clause)
        if re.match(rf"\s*{_NAME}", clause):
            names.insert(0, "*")
        out["imports"].append({"names": names, "from_module": text[m.end() : close], "line": at.of(m.start(2)), "alias": None})
    for k in ("functions", "classes"):
        out[k].sort(key=lambda x: x["start_line"])
    return out


def parse_go(text: str) -> Symbols:
    """Go: functions and methods, types as classes, imports by path."""
    mask, at = mask_go(text), _Lines(text)
    out: Symbols = {"functions": [], "classes": [], "imports": [], "exported": []}
    for m in re.finditer(r"^func\b\s*(\()?", mask, re.M):
        k = after_space(mask, closing(mask, m.start(1)) + 1 if m[1] else m.end())  # a receiver is passed over
        name = re.compile(r"\w+").match(mask, k)
        k = after_space(mask, name.end()) if name else k
        if name and mask[k : k + 1] == "[":  # type parameters
            k = after_space(mask, closing(mask, k) + 1)
        if name and mask[k : k + 1] == "(" and (block := _block(mask, go_body(mask, k))):
            out["functions"].append({"name": name[0], "start_line": at.of(name.start()), "end_line": at.of(block[1]), "body": text[block[0] : block[1] + 1], "decorators": []})
    types = [(m.start(1), m[1]) for m in re.finditer(r"^type\s+(\w+)\b(?!\s*\()", mask, re.M)]
    for m in re.finditer(r"^type\s*(\()", mask, re.M):
        types += [(x.start(1), x[1]) for x in re.compile(r"^\t(\w+)\s", re.M).finditer(mask, m.end(), closing(mask, m.start(1)))]
    for where, name in sorted(types):
        line_end = mask.find("\n", where)
        brace = mask.find("{", where, line_end if line_end >= 0 else len(mask))
        out["classes"].append({"name": name, "start_line": at.of(where), "end_line": at.of(closing(mask, brace) if brace >= 0 else where), "methods": []})
    for m in re.finditer(r"""^import\s+(?:[\w.]+\s+)?(["`])|^import\s*(\()""", mask, re.M):
        span = (m.start(1), mask.index(m[1], m.end()) + 1) if m[1] else (m.start(2), closing(mask, m.start(2)))
        for x in re.finditer(r"""(["`])([^"`]+)\1""", text[span[0] : span[1]]):
            out["imports"].append({"names": [], "from_module": x[2], "line": at.of(span[0] + x.start()), "alias": None})
    return out


register("python", parse_python)
register("javascript", parse_script)
register("typescript", parse_script)
register("go", parse_go)


def parsed_batches(batches: Iterator[pd.DataFrame], registry: dict[str, Callable[[str], Symbols]]) -> Iterator[pd.DataFrame]:
    """PARSED rows of batches of files, handed on whenever TOGETHER bytes of text have been parsed."""
    for b in batches:
        rows, size = [], 0
        for file, language, content, error in zip(b["file"], b["language"], b["content"], b["error"]):
            text, found = "", {"functions": [], "classes": [], "imports": [], "exported": []}
            if error is None:
                try:
                    text = bytes(content).decode("utf-8-sig")
                    found = registry[language](text)
                except (SyntaxError, ValueError, RecursionError, KeyError, IndexError) as e:
                    error = f"{type(e).__name__}: {e}"
                    text = text or bytes(content).decode("utf-8", "replace")
            rows.append((file, language, text, error, found["functions"], found["classes"], found["imports"], found["exported"]))
            size += len(text)
            if size >= TOGETHER:
                yield pd.DataFrame(rows, columns=_COLUMNS)
                rows, size = [], 0
        yield pd.DataFrame(rows, columns=_COLUMNS)


def parse_files(files: DataFrame) -> DataFrame:
    """(file, language, content, error) to PARSED rows. No file makes the scan fail: what cannot
    be read, decoded or parsed has its reason in `error` and no symbols. Parsing costs far more than
    its input, so files are dealt to all cores by their paths, however few partitions they come in."""
    registry, spark = dict(_REGISTRY), files.sparkSession
    bound_batches(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return parsed_batches(batches, registry)

    dealt = files.select("file", "language", "content", "error").repartition(2 * spark.sparkContext.defaultParallelism, "file")
    return dealt.mapInPandas(run, PARSED)


def functions_of(parsed: DataFrame) -> DataFrame:
    """One row per function; bodies give way to their hashes."""
    rows = parsed.filter("error is null").select("file", "language", F.explode("functions").alias("f")).select("file", "language", "f.*")
    return rows.withColumn("body_hash", body_hash(F.col("body"))).drop("body")


def classes_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error is null").select("file", "language", F.explode("classes").alias("c")).select("file", "language", "c.*")


def imports_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error is null").select("file", "language", F.posexplode("imports").alias("at", "i")).select("file", "language", "at", "i.*")
