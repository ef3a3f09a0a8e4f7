"""Every query of this subpackage that has SQL, against it, on the smallest tables."""

import os

import duckdb
import pytest

from gleanery.llm import queries
from tests.test_oracles import DATA, TABLES, cells


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df, want = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert cells(df.collect(), df.columns) == cells(want.fetchall(), want.columns)
