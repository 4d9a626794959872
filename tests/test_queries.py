"""Every core query against DuckDB on the smallest tables."""

import ast
from pathlib import Path

import duckdb
import pytest

from fixed_queries import FIXED
from sparkloom import queries, tree_queries  # noqa: F401  (adds its queries)

ROOT = Path(__file__).resolve().parent.parent
SF = Path("/root/testdata/sf0.001")


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, str(SF))
    want = duck.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(FIXED))
def test_operations_without_tables(spark, duck, name):
    f, sql = FIXED[name]
    got, want = f(spark, ""), duck.sql(sql)
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_never_imports_llm():
    for p in (ROOT / "sparkloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] + [getattr(node, "module", "") or ""] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
                assert not any("llm" in n for n in names), p
