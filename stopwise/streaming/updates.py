"""Drift-triggered model updates from a stream of labelled predictions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.ml.models import fit, save

LEDGER = ("batch bigint, rows bigint, errors bigint, seen bigint, wrong bigint, warning boolean, drift boolean, fitted boolean, "
          "pending bigint, first_batch bigint, window_from bigint")


class UpdatePolicy:
    """Refit a model when the error rate drifts; a ``foreachBatch`` function.

    Errors are counted since the last refit.  From ``min_seen`` rows on, rate + deviation above ``warning`` is a warning and
    rate + 2 deviations above ``drift`` is drift.  ``mode``: ``immediate`` refits on drift, on all rows since the last refit;
    ``batch`` on drift or warning once ``min_rows`` rows wait; ``window`` on drift, on the last ``window_rows`` rows to arrive
    (within a batch the newest).
    A refit empties the buffer and restarts the counts.

    Everything is on disk under ``path``: the rows of each batch, the models as ``model/v<batch>``, and a ledger with one row
    per finished batch, which is written last.  A restarted driver reads its counts from the last ledger row.  A batch that
    comes again is left alone when the ledger has it; otherwise it overwrites what it had written, so nothing counts twice.
    A batch costs one aggregate over its own rows; earlier rows are read for a refit only, and only the folders it needs.
    """

    def __init__(self, path: str, features: Sequence[str], label: str, mode: str = "batch", min_rows: int = 100, window_rows: int = 1000,
                 min_seen: int = 30, warning: float = 0.05, drift: float = 0.1, time: str = "event_ts", row_id: str = "obs_id",
                 refit: Callable = fit):
        if mode not in ("immediate", "batch", "window"):
            raise ValueError(mode)
        self.path, self.features, self.label, self.mode = path, list(features), label, mode
        self.min_rows, self.window_rows, self.min_seen = min_rows, window_rows, min_seen
        self.warning, self.drift, self.time, self.row_id, self.refit = warning, drift, time, row_id, refit
        self.last: dict | None = None
        self.recent: dict[int, int] = {}

    def ledger(self, spark: SparkSession) -> DataFrame:
        """One row per finished batch."""
        try:
            return spark.read.schema(LEDGER).parquet(f"{self.path}/ledger")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], LEDGER)

    def _restore(self, spark: SparkSession) -> None:
        """Counts of the last finished batch, and the sizes of the batches that the window reaches."""
        done = self.ledger(spark)
        last = done.orderBy(F.desc("batch")).limit(1).collect()
        self.last = last[0].asDict() if last else {"batch": -1, "seen": 0, "wrong": 0, "pending": 0, "fitted": False, "first_batch": 0, "window_from": 0}
        self.recent = {r["batch"]: r["rows"] for r in done.filter(F.col("batch") >= self.last["window_from"]).select("batch", "rows").collect()}

    def _rows(self, spark: SparkSession, first: int, last: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows").filter(F.col("batch").between(first, last))

    def _fitted(self, spark: SparkSession, first: int, window_from: int, batch_id: int) -> bool:
        train = self._rows(spark, window_from if self.mode == "window" else first, batch_id)
        if self.mode == "window":
            train = train.orderBy(F.desc("batch"), F.desc(self.time), F.desc(self.row_id)).limit(self.window_rows)
        train = train.drop("batch")
        if train.select(self.label).distinct().limit(2).count() < 2:
            return False
        save(self.refit(train, self.features, self.label), self.features, f"{self.path}/model/v{batch_id}")
        return True

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if self.last is None:
            self._restore(spark)
        before = self.last
        if batch_id <= before["batch"]:
            return
        here = f"{self.path}/rows/batch={batch_id}"
        batch.write.mode("overwrite").parquet(here)
        wrong = ~F.col(self.label).eqNullSafe(F.col("y_pred"))
        now = spark.read.schema(batch.schema).parquet(here).agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("e")).first()
        restart = before["fitted"]
        seen, errors = (0 if restart else before["seen"]) + now["n"], (0 if restart else before["wrong"]) + now["e"]
        pending = (0 if restart else before["pending"]) + now["n"]
        first = before["batch"] + 1 if restart else before["first_batch"]
        self.recent[batch_id] = now["n"]
        window_from = before["window_from"]
        while window_from in self.recent and window_from < batch_id and sum(self.recent.values()) - self.recent[window_from] >= self.window_rows:
            del self.recent[window_from]
            window_from += 1
        rate = errors / seen if seen else 0.0
        deviation = math.sqrt(rate * (1 - rate) / seen) if seen else 0.0
        ready = seen >= self.min_seen
        warning, drift = ready and rate + deviation > self.warning, ready and rate + 2 * deviation > self.drift
        due = (drift or warning) and pending >= self.min_rows if self.mode == "batch" else drift
        fitted = due and self._fitted(spark, first, window_from, batch_id)
        self.last = {"batch": batch_id, "rows": now["n"], "errors": now["e"], "seen": seen, "wrong": errors, "warning": warning, "drift": drift,
                     "fitted": fitted, "pending": pending, "first_batch": first, "window_from": window_from}
        spark.createDataFrame([self.last], LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/done={batch_id}")
