"""Every query with SQL agrees with DuckDB on the same tables."""

import decimal

import pytest

import plumbline.more_queries  # noqa: F401
import plumbline.run_queries  # noqa: F401
from plumbline.queries import ORACLE_SQL, QUERIES
from tables import ROOT, SMALL


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in sorted(df.columns)]
    got = sorted(([plain(r[c]) for c in sorted(df.columns)] for r in df.collect()), key=repr)
    assert got == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_library_does_not_import_llm():
    for f in (ROOT / "plumbline").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "plumbline").parts:
            assert "plumbline.llm" not in f.read_text(), f


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
