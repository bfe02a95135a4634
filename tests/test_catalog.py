import pytest

import __spark_entry__ as driver
import check_oracle
from thematrail import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    import duckdb

    con = duckdb.connect()
    for table in check_oracle.TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, connection, name):
    line = check_oracle.compare(spark, connection, FOLDER, name, driver.queries()[name], driver.oracle_sql().get(name))
    assert line.startswith("ok"), line


def test_entry(spark):
    assert driver.entry(spark).columns == ["category", "mentions", "share"]
