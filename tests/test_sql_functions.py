"""The table function of SQL gives what the parsers give."""

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import parsers, sql

ROWS = [
    ("a.py", "python", b"import os\n__all__ = ['f']\n@app.route\ndef f(x):\n    # no\n    return x\nclass K:\n    def m(self): pass\n", None),
    ("b.go", "go", b'package p\nimport "fmt"\nfunc B() interface{} {\n\treturn nil\n}\ntype T struct{}\n', None),
    ("c.ts", "typescript", b"import * as q from './q'\nexport const c = (x: number): { a: 1 } => {\n  return x\n}\n", None),
    ("d.py", "python", b"def (\n", None),
    ("e.py", "python", b"\xff", None),
    ("f.rb", "ruby", b"x", None),
    ("g.py", "python", None, None),
]


@pytest.fixture
def files(spark):
    sql.register_functions(spark)
    return spark.createDataFrame(ROWS, "file string, language string, content binary, error string")


@pytest.mark.parametrize(("kind", "rows"), [("functions", parsers.functions_of), ("classes", parsers.classes_of), ("imports", parsers.imports_of)])
def test_same_as_the_parsers(spark, files, kind, rows):
    got = spark.sql(f"SELECT file, x.* FROM {{files}}, LATERAL source_symbols(language, content, '{kind}') x", files=files)
    want = rows(parsers.parse_files(files.filter("content is not null"))).select(*got.columns)
    assert got.count() and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_errors_and_exports(spark, files):
    got = spark.sql("SELECT file, x.error FROM {files}, LATERAL source_symbols(language, content, 'errors') x", files=files).collect()
    assert sorted((r["file"], r["error"].split(":")[0]) for r in got) == [("d.py", "SyntaxError"), ("e.py", "UnicodeDecodeError"), ("f.rb", "KeyError")]
    assert [r["name"] for r in spark.sql("SELECT x.name FROM {files}, LATERAL source_symbols(language, content, 'exported') x", files=files).collect()] == ["f"]


def test_kinds_are_checked(spark, files):
    for kind in ("'nothing'", "language"):
        with pytest.raises(Exception, match="third argument"):
            spark.sql(f"SELECT x.* FROM {{files}}, LATERAL source_symbols(language, content, {kind}) x", files=files).collect()
    assert spark.sql("SELECT x.* FROM {files}, LATERAL source_symbols(language, content, 'functions') x", files=files.filter(F.lit(False))).count() == 0
