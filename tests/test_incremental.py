"""Scans with a cache: only what is new is parsed, and the report is that of a scan without one."""

from pathlib import Path

from sparkloom.plans import incremental
from sparkloom.plans.scan import scan
from sparkloom.sources import parsers


def report(spark, root, cache=None):
    s = scan(spark, root, cache=cache)
    out, n = s.to_dict(), s.parsed_now
    s.release()
    return out, n


def test_a_second_scan_parses_nothing(spark, tree, tmp_path_factory):
    root, cache = tree({"a.py": "import b\ndef f():\n    return g()\n", "b.py": "import a\ndef g():\n    return 1\n", "c.js": "function h() { return 1 }\n", "bad.py": "def (\n"}), str(tmp_path_factory.mktemp("cache") / "t")
    first, n = report(spark, root, cache)
    assert n == 4 and first == report(spark, root)[0]
    assert report(spark, root, cache) == (first, 0)
    Path(root, "a.py").write_text("def f():\n    return 2\n")
    Path(root, "c.js").unlink()
    Path(root, "d.py").write_bytes(Path(root, "b.py").read_bytes())  # the same content elsewhere is another file
    third, n = report(spark, root, cache)
    assert n == 2 and third == report(spark, root)[0] and third["summary"]["total_files"] == 4
    Path(root, "a.py").write_text("import b\ndef f():\n    return g()\n")  # what comes back is known still
    assert report(spark, root, cache)[1] == 0


def test_unreadable_files_and_rows_twice(spark, tmp_path):
    cache = str(tmp_path / "t")
    rows = spark.createDataFrame([("a.py", "python", b"x = 1\n", None), ("b.py", "python", None, "gone"), ("c.py", "python", b"\xff", None)], "file string, language string, content binary, error string")
    for want in (2, 0):
        got, n = incremental.parse_changed(rows, cache)
        assert n == want and sorted((r["file"], (r["error"] or "")[:12]) for r in got.collect()) == [("a.py", ""), ("b.py", "gone"), ("c.py", "UnicodeDecod")]
    incremental.cached(spark, cache).write.parquet(str(tmp_path / "again"))
    spark.read.parquet(str(tmp_path / "again")).write.mode("append").parquet(cache)  # another scan added the same
    assert incremental.parse_changed(rows, cache)[0].count() == 3
    assert parsers.functions_of(incremental.parse_changed(rows.limit(0), cache)[0]).count() == 0
