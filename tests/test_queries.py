"""Every query with SQL gives DuckDB's rows on the supplied tables."""

import duckdb
import pytest

from loomtrace import catalog_queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    rows = sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())
    if name not in Q.ORACLE_SQL:
        assert rows
        return
    cursor = duck.execute(Q.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    places = [columns.index(c) for c in sorted(columns)]
    assert sorted(columns) == sorted(df.columns)
    assert rows == sorted(repr([r[i] for i in places]) for r in cursor.fetchall())
