from pathlib import PurePosixPath

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import files

ALPHABET = st.text(alphabet="ab#/*\t \n\r\x0b\x1c\x85\xa0\u2028\u3000é.(", max_size=30)


@settings(max_examples=5, deadline=None)
@given(st.lists(ALPHABET, min_size=40, max_size=60))
def test_strip_and_lines_as_python_has_them(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", X.strip(F.col("t")).alias("s"), X.text_lines(F.col("t")).alias("l"), X.n_lines_scan(F.col("t")).alias("n")).collect()
    for r in got:
        assert r["s"] == r["t"].strip()
        assert r["l"] == r["t"].splitlines()
        assert r["n"] == r["t"].count("\n") + 1


def test_paths(spark):
    names = ["a/b/main.py", "x.min.js", ".bashrc", "..a.b", "noext", "dir/.x.tar.gz", "A.PY", "a."]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    for r in df.select("p", X.stem(F.col("p")).alias("s"), X.suffix(F.col("p")).alias("x")).collect():
        if r["p"] not in ("a.", "..a.b"):
            assert (r["s"], r["x"]) == (PurePosixPath(r["p"]).stem, PurePosixPath(r["p"]).suffix.lower())


def test_normal_body_and_hash(spark):
    rows = [("  x = 1\n\n# c\n  // d\n\t* e\n y\n",), ("x = 1\ny",)]
    got = spark.createDataFrame(rows, "t string").select(X.normal_body(F.col("t")).alias("n"), X.body_hash(F.col("t")).alias("h")).collect()
    assert got[0]["n"] == "x = 1\ny" and got[0]["h"] == got[1]["h"]


def test_call_tokens_in_both_modes(spark):
    df = spark.createDataFrame([("ab(x.foo (étoile(barre(1)",)], "t string")
    r = df.select(X.call_tokens(F.col("t"), False).alias("c"), X.call_tokens(F.col("t"), True).alias("i")).first()
    assert r["c"] == ["barre"] and r["i"] == ["ab", "foo", "barre"]


def test_skip_language_and_slices(spark):
    rows = [("logo.png", 10, True), ("package-lock.json", 10, True), ("bundle.min.js", 10, True), ("a.py", 501 * 1024, True), ("a.py", 500 * 1024, False), ("x.pyc", 1, True), ("main.py", 5, False), ("a.rs", None, True)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "p string, n long")
    assert [r[0] for r in df.select(files.is_skipped(F.col("p"), F.col("n"))).collect()] == [c for *_, c in rows]
    names = {"a.ts": "typescript", "a.go": "go", "a.js": "javascript", "a.rs": "rust", "a.sql": "sql", "a.xyz": "text"}
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r[0] for r in df.select(files.language_of(F.col("p"))).collect()] == list(names.values())
    five = "\n".join(f"line{i}" for i in range(1, 6)) + "\n"
    df = spark.createDataFrame([(five, 2, 4), ("a\nb", 50, 100), ("", 1, None), (five, -3, None)], "t string, s int, e int")
    got = [r[0] for r in df.select(files.slice_lines(F.col("t"), F.col("s"), F.col("e"))).collect()]
    assert tuple(got[0]) == ("line2\nline3\nline4", 2, 4, 5)
    assert (got[1]["start_line"], got[1]["end_line"]) == (2, 2)
    assert got[2]["source"] == "" and got[3]["end_line"] == 5


def test_commands(spark):
    rows = [("pytest tests/", True), ("pytest; rm x", False), ("a | pytest", False), ("pytest `x`", False), ("pytest $(x)", False), ("", False), (None, False), ("tox", False), (" pytest -x ", True)]
    df = spark.createDataFrame([(a,) for a, _ in rows], "c string")
    assert [r[0] for r in df.select(files.may_run(F.col("c"), ("pytest",))).collect()] == [b for _, b in rows]
