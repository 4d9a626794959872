"""The parsers as a table function of SQL.

    SELECT file, f.* FROM files, LATERAL source_symbols(language, content, 'functions') f

The third argument, a constant, says which rows are wanted and so decides on the columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.text import COMMENT_STARTS
from .parsers import parsers_now

_TEXT, _LINE, _TEXTS = StringType(), IntegerType(), ArrayType(StringType())
_RANGE = [("name", _TEXT), ("start_line", _LINE), ("end_line", _LINE)]
COLUMNS: dict[str, list[tuple[str, DataType]]] = {
    "functions": [*_RANGE, ("decorators", _TEXTS), ("body_hash", _TEXT)],
    "classes": [*_RANGE, ("methods", _TEXTS)],
    "imports": [("names", _TEXTS), ("from_module", _TEXT), ("line", _LINE)],
    "exported": [("name", _TEXT)],
    "errors": [("error", _TEXT)],
}


def hash_of(body: str) -> str:
    """functions.text.body_hash for one body."""
    lines = (x.strip() for x in body.split("\n"))
    return hashlib.sha256("\n".join(x for x in lines if x and not x.startswith(COMMENT_STARTS)).encode()).hexdigest()


class SourceSymbols:
    """Rows of one kind for each file; one that cannot be decoded or parsed has none but its error."""

    @staticmethod
    def analyze(language: AnalyzeArgument, content: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        if not kind.isConstantExpression or kind.value not in COLUMNS:
            raise ValueError(f"the third argument has to be one of {', '.join(map(repr, COLUMNS))}")
        return AnalyzeResult(StructType([StructField(name, form) for name, form in COLUMNS[kind.value]]))

    def eval(self, language: str, content: Any, kind: str) -> Iterator[tuple]:
        error, found = None, None
        try:
            text = bytes(content).decode("utf-8-sig") if content is not None else None
            found = parsers_now()[language](text) if text is not None else None
        except (SyntaxError, ValueError, RecursionError, KeyError, IndexError) as e:
            error = f"{type(e).__name__}: {e}"
        if kind == "errors":
            if error is not None:
                yield (error,)
        elif found is not None:
            for x in found[kind]:
                if kind == "functions":
                    yield x["name"], x["start_line"], x["end_line"], x["decorators"], hash_of(x["body"])
                elif kind == "classes":
                    yield x["name"], x["start_line"], x["end_line"], x["methods"]
                elif kind == "imports":
                    yield x["names"], x["from_module"], x["line"]
                else:
                    yield (x,)


def register_functions(spark: SparkSession) -> None:
    """Adds source_symbols to a session's SQL. Its workers know the languages of this package alone."""
    spark.udtf.register("source_symbols", udtf(SourceSymbols))
