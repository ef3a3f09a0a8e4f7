"""Each hand-written case against its wanted values."""

import os

import duckdb
import pytest

from tests.cases import CASES, Site
from tests.test_oracles import DATA, TABLES, cells


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    function, sql = CASES[name]
    con = duckdb.connect()
    for t in TABLES if os.path.isdir(DATA) else ():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df, want = function(Site(spark=spark)), con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert cells(df.collect(), df.columns) == cells(want.fetchall(), want.columns)
