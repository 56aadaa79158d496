"""The cases of tests/cases.py: what an operator gives for each made input is what was worked out by hand."""

import json

import duckdb
import pytest

from . import cases

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("documents", "conversations", "events", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(rows, columns):
    one = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(json.dumps([one(r[columns.index(c)]) for c in sorted(columns)], default=str) for r in rows)


@pytest.mark.parametrize("name", sorted(cases.queries()))
def test_case(spark, tables, name):
    got = cases.queries()[name](spark, SF)
    want = tables.sql(cases.oracle_sql()[name])
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), want.columns)
