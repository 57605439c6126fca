"""Operators that SQL can express, against their SQL."""

import os

import duckdb
import pytest

from ledgerline.llm.oracle import ORACLE_SQL
from ledgerline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    found = QUERIES[name](spark, SF)
    wanted = con.execute(ORACLE_SQL[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    got = sorted(map(tuple, found.select(*columns).collect()), key=repr)
    assert got == sorted(wanted[columns].itertuples(index=False, name=None), key=repr)
