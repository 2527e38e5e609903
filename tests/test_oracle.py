"""Registered queries against their SQL in DuckDB."""

import os
from collections import Counter

import duckdb
import pytest

from cairn import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_agrees_with_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    want = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    same = lambda v: round(v, 9) if isinstance(v, float) else v
    rows = Counter(tuple(same(r[c]) for c in columns) for r in got.collect())
    assert rows == Counter(tuple(same(v) for v in r) for r in want.fetchall())


def test_entry_point_lists_every_query():
    import __spark_entry__

    assert set(queries.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
