import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from stopwise.session import build_session
from stopwise.skew import HOT_ROWS_CONF

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def split_keys(spark):
    """Forces hot-key handling: a key with more than 25 rows is split."""
    spark.conf.set(HOT_ROWS_CONF, "25")
    yield
    spark.conf.unset(HOT_ROWS_CONF)


@pytest.fixture(scope="session")
def skewed(spark):
    """300 rows, two thirds of them on one key, some null values, tied clocks."""
    return spark.range(300).selectExpr(
        "id as obs_id", "case when id % 3 < 2 then 'hot' else concat('k', id % 11) end as key",
        "timestamp_micros(1704067200000000 + cast(id div 2 as bigint) * 60000000) as feed_timestamp",
        "case when id % 17 = 0 then null else cast((id * 7919) % 101 as double) end as v", "id % 5 = 0 as flag").cache()
