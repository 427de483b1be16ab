import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, as_bag
from workload.registry import QUERIES

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLES)
    assert set(ORACLES) <= set(queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, sf_dir, oracle, name):
    df = queries()[name](spark, sf_dir)
    cursor = oracle.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert as_bag(df.columns, df.collect()) == as_bag(columns, cursor.fetchall())


def test_entry(spark, sf_dir):
    assert entry(spark).count() > 0
