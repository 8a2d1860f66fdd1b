"""Each registered query against its SQL on the smallest tables."""

import math
import os

import pytest

from convolens.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{float(v):.6f}" if isinstance(v, int | float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    order = [rel.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == want


@pytest.mark.parametrize("name", ["porter_terms", "name_wratio", "parse_queries"])
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
