"""Registered queries against their SQL, over whole tables."""

import duckdb
import pytest

import check
from pairloom.llm.registry import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    line = check.compare(spark, FOLDER, name, QUERIES[name], ORACLE[name], con)
    assert line.startswith("OK"), line
