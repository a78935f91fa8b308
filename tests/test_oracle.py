"""Every query with SQL gives the same rows on DuckDB (smallest tables)."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
QS, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_names_and_scope():
    assert set(SQL) <= set(QS) and len(QS) > 200
    for text in SQL.values():
        assert text.strip().lower().startswith(("with", "select"))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    status, _, note = compare(spark, con, name, QS[name], SQL[name], SF)
    assert status == "ok", note[:500]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
