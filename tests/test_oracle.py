"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from polyglint.plans import bindings

SF = os.environ.get("POLYGLINT_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = bindings.queries(), bindings.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def value(x):
    return round(x, 6) if isinstance(x, float) else None if x is None else str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = sorted((tuple(map(value, r)) for r in df.select(*(f"`{c}`" for c in names)).collect()), key=str)
    result = con.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    expected = sorted((tuple(value(r[columns.index(c)]) for c in names) for r in result.fetchall()), key=str)
    assert found == expected and found


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(QUERIES) - set(SQL) == {"g01_unique_subsequence", "g09_alignment", "g10_preview"}
