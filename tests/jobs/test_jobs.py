"""The jobs against DuckDB, over growing input, with odd rows, and after a crash."""

import json
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from jobs import common, fix_plan, scan_history
from jobs.queries import ORACLES, QUERIES
from sparkloom.operators.ranking import ranked

ROOT = Path(__file__).resolve().parent.parent.parent
SF = Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, kind string, batch long"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = QUERIES[name](spark, str(SF)), con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert rows_of(got.select(*columns)) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


ODD = [(1, "def a():\n    x", "en", "s", "k", 9), (2, "def a():\n  x", "en", "s", "k", 9), (3, None, "en", "s", "k", 9), (4, "", "en", None, "k", 9), (None, "def a():\nx", "en", "t", "k", 9), (5, "# only a comment", "en", "t", "k", 9), (5, "# only a comment", "en", "t", "k", 9), (6, "y\n" * 150, "en", "t", "k", 9)]


def write(spark, rows, path, mode="append"):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode(mode).parquet(path)


def test_plan_of_odd_rows_and_again(spark, tmp_path):
    docs, labels, out = (str(tmp_path / n) for n in ("docs", "labels", "out"))
    write(spark, ODD, docs)
    spark.createDataFrame([(2, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(labels)
    assert fix_plan.run(spark, docs, labels, out)["read"] == len(ODD)
    first = rows_of(fix_plan.read_back(spark, out))
    found = {(r["doc_id"], r["finding"]): r for r in fix_plan.read_back(spark, out).filter("record = 'finding'").collect()}
    assert set(found) == {(2, "duplicate"), (4, "dead_code"), (5, "dead_code"), (6, "god_file")}  # without an id nothing can be told to go
    assert found[4, "dead_code"]["source"] == "(none)"
    assert found[2, "duplicate"]["has_tests"] == 0 and found[6, "god_file"]["lines_changed"] == 17
    fix_plan.run(spark, docs, labels, out)
    assert rows_of(fix_plan.read_back(spark, out)) == first
    write(spark, ODD[:1], docs, "overwrite")  # a source that goes leaves nothing behind
    fix_plan.run(spark, docs, labels, out)
    assert [r["source"] for r in fix_plan.read_back(spark, out).collect()] == ["s"]
    write(spark, [], docs, "overwrite")
    assert fix_plan.run(spark, docs, labels, out) == {"read": 0, "written": 0}


def test_ranks_of_a_hot_group(spark):
    rows = [(k % 97 if k % 3 else 1000, k * 7919 % 5003, k) for k in range(4000)] + [(None, 5, 9999), (None, 4, 9998)]
    got = ranked(spark.createDataFrame(rows, "g int, o int, k int").repartition(7), ["g"], ["o", "k"], "step").collect()
    want = {}
    for g, o, k in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2])):
        want[k] = want.get(("n", g), 0) + 1
        want["n", g] = want[k]
    assert len(got) == len(rows) and all(r["step"] == want[r["k"]] for r in got)


def test_scans_of_growing_input(spark, tmp_path):
    docs, out, mark = (str(tmp_path / n) for n in ("docs", "out", "mark"))
    write(spark, ODD, docs)
    assert scan_history.run(spark, docs, out, mark) == {"batches": 1, "read": 8, "written": 9}
    assert scan_history.run(spark, docs, out, mark) == {"batches": 0, "read": 0, "written": 0}
    one = rows_of(scan_history.read_back(spark, out))
    write(spark, [(10, "def a():\n\tx", "en", "s", "k", 9), (0, "y\n" * 150, "en", "s", "k", 9), (11, "new", "en", "s", "k", 9), (12, "new", "en", "s", "k", 9)], docs)
    assert scan_history.run(spark, docs, out, mark) == {"batches": 1, "read": 4, "written": 5}
    both = scan_history.read_back(spark, out)
    assert rows_of(both.filter("batch = 0")) == one
    second = {r["doc_id"]: (r["first_id"], r["copy"]) for r in both.filter("batch = 1 and kind = 'file'").collect()}
    assert second == {10: (1, True), 0: (6, True), 11: (11, False), 12: (11, True)}  # an earlier batch is first, whatever its ids
    entries = [r.asDict() for r in both.filter("kind = 'health'").orderBy("batch").collect()]
    assert [(r["total_files"], r["total_copies"], r["total_large"]) for r in entries] == [(8, 3, 1), (12, 6, 2)]
    assert entries[0]["delta"] is None and entries[1]["delta"] == round(entries[1]["score"] - entries[0]["score"], 1)


def test_a_batch_that_is_repeated_replaces_what_it_left(spark, tmp_path, monkeypatch):
    docs, out, mark = (str(tmp_path / n) for n in ("docs", "out", "mark"))
    write(spark, ODD, docs)
    scan_history.run(spark, docs, out, mark)
    write(spark, [(20, "z", "en", "s", "k", 9)], docs)
    entry_of = scan_history.entry_of
    with monkeypatch.context() as m:
        m.setattr(scan_history, "entry_of", lambda *a: 1 / 0)  # after the batch's files are written
        with pytest.raises(Exception, match="division by zero"):
            scan_history.run(spark, docs, out, mark)
    assert scan_history.entry_of is entry_of
    assert scan_history.run(spark, docs, out, mark)["read"] == 1
    got = scan_history.read_back(spark, out).filter("batch = 1")
    assert sorted((r["kind"], r["doc_id"]) for r in got.collect()) == [("file", 20), ("health", None)]


def test_batches_are_bounded_and_nothing_is_nothing(spark, tmp_path):
    docs, out, mark = (str(tmp_path / n) for n in ("docs", "out", "mark"))
    assert scan_history.read_back(spark, out).count() == 0
    for k in range(3):
        write(spark, [(k, "same", "en", "s", "k", 9)], docs)
    assert scan_history.run(spark, docs, out, mark, {"files_per_batch": 1})["batches"] == 3
    got = scan_history.read_back(spark, out).filter("kind = 'file'")
    assert got.select("first_id").distinct().count() == 1 and got.filter("copy").count() == 2


def test_config(spark, tmp_path):
    given = tmp_path / "own.json"
    given.write_text(json.dumps({"large_lines": 7}))
    assert common.read_config(spark, "fix_plan", str(given)) == common.default_config("fix_plan") | {"large_lines": 7}
    given.write_text(json.dumps({"unheard": 7}))
    with pytest.raises(ValueError, match="unheard"):
        common.read_config(spark, "fix_plan", str(given))


def test_command_line(tmp_path):
    out = tmp_path / "out"
    at = ["--documents", f"{SF}/document[s].parquet", "--out", f"file://{out}", "--checkpoint", f"file://{tmp_path}/mark"]
    done = subprocess.run([sys.executable, "-m", "jobs.scan_history", *at], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True)
    assert "scan_history: 1 batches, 200 documents read, 201 rows written" in done.stderr
    assert (out / "kind=health" / "batch=0").is_dir()


def test_jobs_never_import_llm():
    for p in [*(ROOT / "jobs").glob("*.py")]:
        assert "llm" not in p.read_text() and "corpus_pipeline" not in p.read_text()
