"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{data_dir}/*.parquet"):
        con.execute(f"create view {Path(path).stem} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 4) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_sql(spark, duck, data_dir, name):
    df = driver.queries()[name](spark, data_dir)
    cursor = duck.execute(driver.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    assert {c: KINDS.get(t) for c, t in df.dtypes} == kinds
    at = [names.index(c) for c in columns]
    wanted = Counter(repr([plain(r[i]) for i in at]) for r in cursor.fetchall())
    found = Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert found == wanted


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() == 403
