"""Every governed query against the SQL that it must agree with, on the data of the smallest scales."""

import duckdb
import pytest

import __spark_entry__ as entry
from wardhall.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, sf_dir, oracle, name):
    got = QUERIES[name](spark, sf_dir)
    want = oracle.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(tuple(map(str, r)) for r in got.select(*columns).collect())
    listed = ", ".join(f'"{c}"' for c in columns)
    assert rows == sorted(tuple(map(str, r)) for r in oracle.sql(f"SELECT {listed} FROM ({ORACLE_SQL[name]})").fetchall())


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "c_acctbal" not in df.columns
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    df = QUERIES["governed_select"](spark, sf_dir).filter("c_custkey > 100").select("c_custkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(c_custkey,100)" in plan
    assert "LessThan(c_nationkey,10)" in plan
    assert "c_name" not in plan.split("ReadSchema")[1]
    assert "Exchange" not in plan
