"""Every query with check SQL agrees with DuckDB on the smallest scale, with hot keys split."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stopwise.catalog import catalogs
from stopwise.catalog.base import rounded, tidy
from tools.check import TABLES, rows_of

from .conftest import SF

# Long-running ones are left to tools/check.py.
SLOW = ("cmp", "ml", "str", "src", "snk", "fs04", "grf0", "grf06")
CHECKED = [k for cat in catalogs() for k in cat.queries if k in cat.sql and not k.startswith(SLOW)]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", CHECKED[::4])
def test_query(spark, oracle, split_keys, key):
    df = entry.queries()[key](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = oracle.execute(entry.oracle_sql()[key])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(cols, cur.fetchall())


def test_entry(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert entry.entry(spark).count() == events.selectExpr("user_id % 25").distinct().count()


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rounded_is_round(spark):
    """Same bits as Spark's rounding: halves, values beside halves, signs, large and missing values."""
    rng = random.Random(8)
    values = [None, 0.0, -0.0, 5e-324, 1e300, -1e300, float("nan"), float("inf"), float("-inf"), 2.0**40 / 1e6, 1099511.6277755, 2.675, 1.0000005, -1.0000005]
    for _ in range(4000):
        near = rng.randrange(-10**rng.randrange(1, 13), 10**rng.randrange(1, 13)) / 1e6 + rng.choice([0, 5e-7, -5e-7])
        values += [near, math.nextafter(near, 9e9), math.nextafter(near, -9e9), rng.uniform(-1, 1) * 10**rng.randrange(-9, 18)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (4, 6):
        assert df.filter(~rounded(F.col("v"), digits).eqNullSafe(F.round("v", digits))).count() == 0
    plain = df.filter("abs(v) < 1000000 and abs(v * 1000000 - rint(v * 1000000)) < 0.49")
    assert plain.count() > 4000 and "rint(" in tidy(plain)._jdf.queryExecution().optimizedPlan().toString().lower()
