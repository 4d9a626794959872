import pytest
from pyspark.sql import functions as F

from sparkloom.operators import history, scoring


STORE = "lib/store.py"


@pytest.fixture
def world(spark):
    edges = spark.createDataFrame([(f"jobs/j{i}.py", STORE, i) for i in range(3)], "from string, to string, import_id int")
    nodes = spark.createDataFrame([(STORE, 1), ("checks/test_all.py", 2)], "file string, ordinal int")
    gods = spark.createDataFrame([(STORE, 320)], "file string, lines int")
    cycles = spark.createDataFrame([(STORE,)], "file string")
    summary = spark.createDataFrame([(4, 480)], "total_files long, total_lines long")
    return edges, nodes, cycles, gods, summary


@pytest.mark.parametrize("importers, tests, cycle, large, dead, score, advice", [
    (False, True, False, False, False, 10, "safe to fix"),
    (False, False, False, False, False, 30, "safe to fix"),
    (False, True, False, False, True, 30, "safe to fix"),
    (False, False, True, False, False, 55, "fix with caution"),
    (True, False, False, True, False, 63, "manual review recommended"),
    (True, True, True, True, False, 68, "manual review recommended"),
])
def test_risk_adds_up(spark, world, importers, tests, cycle, large, dead, score, advice):
    edges, nodes, cycles, gods, summary = world
    target = spark.createDataFrame([("load", STORE)], "symbol string, file string")
    unused = spark.createDataFrame([("LOAD",)], "symbol string")
    some = [df if on else df.limit(0) for df, on in ((edges, importers), (nodes, tests), (cycles, cycle), (unused, dead), (gods, large))]
    r = scoring.risk_of(target, *some, summary, mode="compat").first()
    assert (r["score"], r["recommendation"]) == (score, advice)


@pytest.mark.parametrize("names, pattern, modules, entries", [
    (["run.py", "tool/cli_args.py", "tool/typer_app.py"], "CLI tool", ["run", "cli_args", "typer_app"], ["run.py"]),
    (["package_info.py", "core/module_a.py", "core/engine.py", "setup.py"], "library", ["package_info", "module_a", "engine"], []),
])
def test_architecture(spark, names, pattern, modules, entries):
    files = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "file string, ordinal int")
    r = scoring.architecture(files, ["python"]).first()
    assert (r["pattern"], r["confidence"], r["inferred_modules"], r["entry_points"]) == (pattern, 1.0, modules, entries)
    assert r["hypothesis"].startswith(f"This appears to be a {pattern} written in python.")


def test_gate(spark):
    df = spark.createDataFrame([(20, False), (5, False), (5, True), (0, False), (6, False)], "n int, c boolean")
    assert [r[0] for r in df.select(history.gate(F.col("n"), F.col("c"))).collect()] == ["blocked", "checkpoint", "allowed", "allowed", "allowed"]


def test_exact_gate_stops_at_checkpoint(spark):
    log = spark.createDataFrame([("s", i, i in (7, 12)) for i in range(14)], "s string, i long, ok boolean")
    got = {r["i"]: (r["n"], r["decision"]) for r in history.gate_exact(log, "s", "i", "ok").collect()}
    assert [got[i] for i in (4, 5, 6, 7, 8, 11, 12, 13)] == [(4, "allowed"), (5, "checkpoint"), (5, "checkpoint"), (5, "allowed"), (6, "allowed"), (9, "allowed"), (10, "allowed"), (11, "allowed")]
