"""Words end where SQL says that they end, in texts of any language."""

import duckdb
import pytest

from quarry.catalog import ORACLES, QUERIES

TURNS = [
    ("user", "mí país así"), ("assistant", "él"), ("user", "éi le"), ("assistant", "das ofício"), ("user", "and 5"), ("assistant", "and"),
    ("user", "é-thank ythanks éthanks"), ("assistant", "i"), ("user", "i_ _i my_"), ("assistant", "é"), ("user", None), ("assistant", "é please, kindlyé éFY 24"), ("user", "pleaseé èkindly."), ("assistant", None),
]


@pytest.mark.parametrize("name", ["subject_relevance", "clean_query"])
def test_boundaries_are_those_of_sql(spark, tmp_path, name):
    rows = [(k // 2, k % 2, role, text) for k, (role, text) in enumerate(TURNS)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    got = QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(cursor.fetchall(), key=repr)
