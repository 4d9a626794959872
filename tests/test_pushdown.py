"""What a predicate spares the tree source: directories are not listed, files not opened."""

import os
from pathlib import Path

import pytest
from pyspark.sql.datasource import EqualTo, In, LessThan, StringContains, StringStartsWith

from sparkloom.sources import srctree

FILES = {"src/a/x.py": "x = 1\n", "src/a/y.go": "package y\n", "src/b/z.py": "z = 1\n" * 500, "src/b/deep/er/w.ts": "let w\n", "srcs/v.py": "v = 1\n", "top.py": "t = 1\n", "tests/u.js": "let u\n"}
CASES = [
    ("language = 'python'", {"src/a/x.py", "src/b/z.py", "srcs/v.py", "top.py"}),
    ("language IN ('go', 'typescript') AND size < 1000", {"src/a/y.go", "src/b/deep/er/w.ts"}),
    ("file LIKE 'src/%'", {"src/a/x.py", "src/a/y.go", "src/b/z.py", "src/b/deep/er/w.ts"}),
    ("file LIKE 'src/b/d%' AND file LIKE 'src/%'", {"src/b/deep/er/w.ts"}),
    ("file LIKE 'src%' AND language = 'python' AND language = 'go'", set()),
    ("file LIKE 'src/%' AND file LIKE 'tests/%'", set()),
    ("size >= 3000 OR language = 'javascript'", {"src/b/z.py", "tests/u.js"}),
    ("size > 6 AND size <= 3000 AND file LIKE '%.py'", {"src/b/z.py"}),
    ("language = 'cobol'", set()),
    ("language IS NOT NULL AND size <> 6 AND file <> 'src/a/y.go'", {"src/b/z.py"}),
]


@pytest.mark.parametrize(("where", "want"), CASES)
def test_same_rows_as_without(spark, tree, where, want):
    root = tree(FILES)
    got = srctree.read_tree(spark, root).filter(where)
    assert {r["file"] for r in got.select("file", "content").collect()} == want


def test_plan_leaves_no_filter(spark, tree):
    got = srctree.read_tree(spark, tree(FILES)).filter("language = 'python' AND size < 1000 AND startswith(file, 'src/')")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "language" in plan and not any(x in plan for x in ("= python", "< 1000", "StartsWith"))


def test_less_is_opened(tree, monkeypatch):
    root = tree(FILES)
    opened, listed = [], []
    read, walk, scandir = Path.read_bytes, os.walk, os.scandir
    monkeypatch.setattr(Path, "read_bytes", lambda p: (opened.append(p.name), read(p))[1])
    monkeypatch.setattr(srctree.os, "scandir", lambda p: (listed.append(os.path.relpath(p, root)), scandir(p))[1])

    def rows(*filters):
        opened.clear()
        listed.clear()
        reader = srctree.TreeReader({"path": root, "parts": "2"})
        left = list(reader.pushFilters(list(filters)))
        return [r[0] for p in reader.partitions() for r in reader.read(p)], left

    assert len(rows()[0]) == len(opened) == 7
    assert sorted(rows(EqualTo(("language",), "python"), LessThan(("size",), 1000))[0]) == ["src/a/x.py", "srcs/v.py", "top.py"] and len(opened) == 3
    assert rows(In(("language",), ("go",)))[1] == [] and opened == ["y.go"]
    assert sorted(rows(StringStartsWith(("file",), "src/b/"))[0]) == ["src/b/deep/er/w.ts", "src/b/z.py"] and sorted(opened) == ["w.ts", "z.py"]
    assert "src/a" not in listed and "tests" not in listed
    other = StringContains(("file",), "x")
    assert rows(other)[1] == [other]
