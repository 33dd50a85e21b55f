"""Session defaults and the durable checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app: str = "stopwise", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; on a cluster the submit command names the master."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators rely on (UTC clock, adaptive execution)."""
    for key, value in RUNTIME_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared checkpoint folder of the cluster; a temporary one only when none is set."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="stopwise-checkpoint-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(folder)
    return folder


#: Whether Spark removes the shuffle files of a query when the query ends, instead of at some garbage collection of the driver.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Whether a join by several columns shuffles rows again that are shuffled by some of them.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def option(spark: SparkSession, name: str, value: str, default: str) -> Iterator[None]:
    """Frames that are made and run inside have the option; ``default`` is its value where none is set."""
    before = spark.conf.get(name, default)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def freeing_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Frames that are made and run inside, once each, leave no shuffle files behind."""
    return option(spark, FREE_SHUFFLES, "true", "false")


def cut_lineage(df: DataFrame, *parts: Column) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read them back.

    Plans of iterative jobs stay short, a lost executor does not repeat earlier rounds, and, unlike with an RDD
    checkpoint, the optimizer knows the true size of the result.  The shuffle files of a write go with its end; with ``parts``,
    conditions of which each row meets one, the rows of each are written in turn, so that only the files of one part are there.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/stopwise-{uuid.uuid4().hex}"
    with freeing_shuffles(spark):
        for rows in [df.filter(part) for part in parts] or [df.select("*")]:
            rows.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
