"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import check_oracle
from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check_oracle.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["vec_id", "label", "t2", "q"] and df.count() == 500


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    outcome, _ = check_oracle.compare(spark, con, FOLDER, name, queries()[name], oracle_sql()[name])
    assert outcome.startswith("ok"), outcome
