"""Queries that SQL can express, over the small tables."""

import math

import duckdb
import pytest

from terrane.llm import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[x]) for x in columns) for r in df.collect()), key=repr)
    result = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(x)]) for x in columns) for r in result.fetchall()), key=repr)
