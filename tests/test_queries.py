"""Every registered query against its SQL over the small tables."""

import decimal
import math
import os

import duckdb
import pytest

from terrane.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


def test_each_query_has_a_twin():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_evidence_is_cut_where_sql_cuts_it(spark, tmp_path):
    sizes = [None, 0, 1, *range(19_970, 19_980), 40_000]
    spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.length for r in registry.queries()["evidence_json"](spark, str(tmp_path)).collect()}
    sql = registry.oracle_sql()["evidence_json"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(duckdb.sql(sql).fetchall())
    assert got[sizes.index(19_973)] == 19_998 and got[sizes.index(19_974)] == 31


def test_golden_atlas(spark):
    q = registry.queries()
    assert tuple(q["atlas_summary"](spark, SF).first()) == ("d1,d2,d3,d4,d5", 1200, 264, 936, "uaf_cannot_be_zero_taint,linear_cannot_be_guarded,exception_cannot_be_guarded")
    assert q["atlas_edges"](spark, SF).count() == 16560
    assert sum(r.edges for r in q["atlas_same_family_edges"](spark, SF).collect()) == 8352
    degrees = {}
    for r in q["atlas_degree"](spark, SF).collect():
        degrees[r.degree] = degrees.get(r.degree, 0) + 1
    assert degrees == {16: 108, 17: 315, 18: 270, 19: 243}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
