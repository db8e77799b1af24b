"""Every catalogue query against its DuckDB SQL on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from quarry import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (Decimal, float)):
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cursor = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(canon(v) for v in r) for r in cursor.fetchall())
    assert sorted(tuple(canon(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_others_run(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0
