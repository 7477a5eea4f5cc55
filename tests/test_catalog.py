"""Every registered query against its SQL, over whole tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import check
from catalog import queries as catalog
from catalog.oracle import oracle_sql as catalog_sql

FOLDER = "/root/testdata/sf0.001"
QUERIES = {name: run for name, run in entry.queries().items() if name in catalog.QUERIES}
SQL = catalog_sql()
# stemmed, or with a longest subsequence over whole documents, too slow in SQL
NO_SQL = {"rouge_l", "evaluate_run", "compare_report"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in check.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    line = check.compare(spark, FOLDER, name, QUERIES[name], SQL.get(name), con)
    assert not line.startswith("FAIL"), line


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(SQL) == NO_SQL and not set(SQL) - set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "similarity_score" in df.columns
