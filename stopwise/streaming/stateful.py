"""Keyed state for events: lag features, error detectors and the alert lifecycle, in event-time order.

Rows of a key come unordered, within a batch and over batches.  They wait in state until the watermark has passed them and
are then taken in time order, so results do not depend on how the stream was cut.

* Each part of a batch is stored as a sorted run of binary blocks of ``BLOCK`` rows.  When a timer fires, the runs are merged
  block by block: the task holds one block of each run, never all rows of a key.  Results leave in pieces of that size.
* The lasting state of a key is a few numbers.  It ends with the alert, or after ``idle`` minutes of event time without rows.

Rows later than the watermark are dropped and counted by Spark (``feeds.progress_rows``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BLOCK = 4096
#: Groups of alerts that share a key of state.
GROUPS = 4096
#: Rows without a time come first.
NO_TIME = -(1 << 63)
NEW, ACKNOWLEDGED, RESOLVED, OTHER = range(4)
STATUS = ("NEW", "ACKNOWLEDGED", "RESOLVED")


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state lives in RocksDB, off the heap and checkpointed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class InOrder(StatefulProcessor):
    """Hands the rows of a key to ``advance`` in order of ``us`` and ``tie`` once the watermark has passed them.

    ``FIELDS`` are the numbers kept of a row; the first two are ``us`` and the tie breaker.
    """

    FIELDS: list[tuple[str, str]] = []

    def __init__(self, idle: float | None = None, block: int = BLOCK):
        self.idle_ms = None if idle is None else int(idle * 60_000)
        self.block = block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next_run = handle.getValueState("next_run", "run int")
        self.runs = handle.getMapState("runs", "run int", "head bigint, part int, parts int")
        self.blocks = handle.getMapState("blocks", "run int, part int", "rows binary")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """State of the subclass."""

    def advance(self, key, rows: np.ndarray) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def passed(self, key, ms: int) -> Iterator[pd.DataFrame]:
        """After all rows up to the watermark."""
        return iter(())

    def last_ms(self) -> int | None:
        """Event time of the key's last row, None without state."""
        return None

    def forget(self) -> None:
        """Drop the subclass's state of the key."""

    def timer(self, ms: int, watermark: int) -> None:
        self.handle.registerTimer(max(ms, watermark + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kinds = np.dtype(self.FIELDS)
        run = self.next_run.get()[0] if self.next_run.exists() else 0
        mark = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            found = np.zeros(len(pdf), kinds)
            for name in kinds.names:
                found[name] = pdf[name].to_numpy()
            found.sort(order=kinds.names[:2], kind="stable")
            parts = -(-len(found) // self.block)
            for part in range(parts):
                self.blocks.updateValue((run, part), (found[part * self.block:(part + 1) * self.block].tobytes(),))
            if parts:
                head = int(found["us"][0])
                self.runs.updateValue((run,), (head, 0, parts))
                self.timer(head // 1000, mark)
                run += 1
        self.next_run.update((run,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        some = False
        for rows in self._due(mark):
            some = True
            for part in self._without_gaps(rows):
                yield from self.advance(key, part)
        yield from self.passed(key, mark)
        if not self.runs.exists():
            self.next_run.clear()
        last = self.last_ms()
        if self.idle_ms is not None and last is not None:
            if last + self.idle_ms > mark:
                if some:
                    self.timer(last + self.idle_ms, mark)
            else:  # rows that still wait are later than the watermark, so more than ``idle`` behind
                self.forget()

    def _without_gaps(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """Cut before each row that comes more than ``idle`` after the one before; the state is dropped there."""
        if self.idle_ms is None:
            yield rows
            return
        for part in np.split(rows, np.flatnonzero(np.diff(rows["us"] // 1000) > self.idle_ms) + 1):
            last = self.last_ms()
            if last is not None and int(part["us"][0]) // 1000 - last > self.idle_ms:
                self.forget()
            yield part

    def _block(self, run: int, part: int) -> np.ndarray:
        return np.frombuffer(self.blocks.getValue((run, part))[0], np.dtype(self.FIELDS))

    def _due(self, mark: int) -> Iterator[np.ndarray]:
        """Rows up to the watermark in order, in pieces; the rest goes back to its blocks."""
        live = {run: (part, parts) for (run,), (head, part, parts) in self.runs.iterator() if head // 1000 <= mark}
        held = {run: self._block(run, part) for run, (part, _) in live.items()}
        tie = self.FIELDS[1][0]
        changed = set(live)
        while live:
            due = {run: int(np.searchsorted(rows["us"], (mark + 1) * 1000, "left")) for run, rows in held.items()}
            # A block that is due as a whole and has a successor says how far the merge may go.
            ends = [(int(rows["us"][-1]), int(rows[tie][-1])) for run, rows in held.items()
                    if due[run] == len(rows) and live[run][0] + 1 < live[run][1]]
            cut = min(ends) if ends else None
            pieces = []
            for run in list(live):
                rows, n = held[run], due[run]
                if cut is not None:
                    head = rows[:n]
                    n = int(np.count_nonzero((head["us"] < cut[0]) | ((head["us"] == cut[0]) & (head[tie] <= cut[1]))))
                pieces.append(rows[:n])
                held[run] = rows[n:]
                if n == len(rows):
                    part, parts = live[run]
                    self.blocks.removeKey((run, part))
                    if part + 1 < parts:
                        live[run], held[run] = (part + 1, parts), self._block(run, part + 1)
                    else:
                        del live[run], held[run]
                        self.runs.removeKey((run,))
            merged = np.concatenate(pieces)
            merged.sort(order=[self.FIELDS[0][0], tie], kind="stable")
            for at in range(0, len(merged), self.block):
                yield merged[at:at + self.block]
            if cut is None:
                break
        for run in changed & set(live):
            part, parts = live[run]
            head = int(held[run]["us"][0])
            self.blocks.updateValue((run, part), (held[run].tobytes(),))
            self.runs.updateValue((run,), (head, part, parts))
            self.timer(head // 1000, mark)

    def close(self) -> None:
        pass


class LagFeatures(InOrder):
    """Previous delay and headway of the key."""

    FIELDS = [("us", "<i8"), ("obs_id", "<i8"), ("delay_sec", "<f8")]

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us bigint, delay double")

    def last_ms(self) -> int | None:
        return self.last.get()[0] // 1000 if self.last.exists() else None

    def forget(self) -> None:
        self.last.clear()

    def advance(self, key, rows: np.ndarray) -> Iterator[pd.DataFrame]:
        us, delay = pd.Series(rows["us"]), pd.Series(rows["delay_sec"])
        prev_us, prev_delay = us.shift(1), delay.shift(1)
        if self.last.exists():
            prev_us.iloc[0], prev_delay.iloc[0] = self.last.get()
        self.last.update((int(rows["us"][-1]), float(rows["delay_sec"][-1])))
        yield pd.DataFrame({"obs_id": rows["obs_id"], "prev_delay": prev_delay.fillna(0.0), "headway_sec": (us - prev_us) / 1e6})


def lag_features(stream: DataFrame, keys: list[str], time: str = "feed_timestamp", late: str = "10 minutes", idle: float | None = None,
                 block: int = BLOCK) -> DataFrame:
    """``obs_id, prev_delay, headway_sec`` of each row once the watermark has passed it; state idle for ``idle`` minutes is dropped."""
    use_rocksdb(stream.sparkSession)
    rows = stream.withWatermark(time, late).select(*keys, "obs_id", time, F.unix_micros(time).alias("us"), "delay_sec")
    return rows.groupBy(*keys).transformWithStateInPandas(
        LagFeatures(idle, block), "obs_id bigint, prev_delay double, headway_sec double", "Append", "EventTime")


class ErrorDetectors(InOrder):
    """The error-rate and cumulative-sum detectors, one set of counts per key."""

    FIELDS = [("us", "<i8"), ("obs_id", "<i8"), ("wrong", "<i8")]

    def __init__(self, warning: float = 0.05, drift: float = 0.1, min_rows: int = 30, alpha: float = 0.005, limit: float = 0.01,
                 idle: float | None = None, block: int = BLOCK):
        super().__init__(idle, block)
        self.warning, self.drift, self.min_rows, self.alpha, self.limit = warning, drift, min_rows, alpha, limit

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "seen bigint, errors bigint, us bigint")

    def last_ms(self) -> int | None:
        return self.counts.get()[2] // 1000 if self.counts.exists() else None

    def forget(self) -> None:
        self.counts.clear()

    def advance(self, key, rows: np.ndarray) -> Iterator[pd.DataFrame]:
        seen, errors, _ = self.counts.get() if self.counts.exists() else (0, 0, 0)
        n = pd.Series(np.arange(seen + 1, seen + len(rows) + 1, dtype="int64"))
        e = pd.Series(np.cumsum(rows["wrong"]) + errors)
        p = e / n
        s = (p * (1 - p) / n).map(math.sqrt)
        ready = n >= self.min_rows
        self.counts.update((int(n.iloc[-1]), int(e.iloc[-1]), int(rows["us"][-1])))
        phi = e - n * self.alpha
        yield pd.DataFrame({"obs_id": rows["obs_id"], "seen": n, "error_rate": p.where(ready), "warning": ready & (p + s > self.warning),
                            "drift": ready & (p + 2 * s > self.drift), "phi": phi, "cusum_drift": phi > self.limit})


def error_detectors(stream: DataFrame, keys: list[str], time: str = "event_ts", late: str = "10 minutes", **limits) -> DataFrame:
    use_rocksdb(stream.sparkSession)
    wrong = (~F.col("y_true").eqNullSafe(F.col("y_pred"))).cast("long")
    rows = stream.withWatermark(time, late).select(*keys, "obs_id", time, F.unix_micros(time).alias("us"), wrong.alias("wrong"))
    return rows.groupBy(*keys).transformWithStateInPandas(
        ErrorDetectors(**limits), "obs_id bigint, seen bigint, error_rate double, warning boolean, drift boolean, phi double, cusum_drift boolean",
        "Append", "EventTime")


class AlertLifecycle(InOrder):
    """NEW, ACKNOWLEDGED, RESOLVED per alert; an alert that nobody has taken at its deadline is reported as overdue once.

    An acknowledgement at the very deadline is in time.  RESOLVED ends the alert: its state goes.  Alerts are many and short, so a key is
    a group of them: the group's rows are taken in time order together, and its open alerts are one value of state (``OPEN`` each).
    """

    FIELDS = [("us", "<i8"), ("event", "<i8"), ("deadline_min", "<f8"), ("alert_id", "<i8"), ("named", "<i8")]
    OPEN = np.dtype([("alert_id", "<i8"), ("named", "<i8"), ("status", "<i8"), ("due", "<i8"), ("us", "<i8")])

    def __init__(self, idle: float | None = None, block: int = BLOCK):
        super().__init__(None, block)  # rows of several alerts follow each other, gaps are those of one alert
        self.quiet_ms = None if idle is None else int(idle * 60_000)
        self.alerts: dict[tuple[int, int], list[int]] | None = None

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alerts", "open binary")

    def _loaded(self) -> dict[tuple[int, int], list[int]]:
        """Open alerts of the group: status, instant of the deadline (0 without) and of the last row."""
        if self.alerts is None:
            held = np.frombuffer(self.state.get()[0], self.OPEN).tolist() if self.state.exists() else []
            self.alerts = {row[:2]: list(row[2:]) for row in held}
        return self.alerts

    def _table(self, out: list[tuple[tuple[int, int], int, bool]]) -> Iterator[pd.DataFrame]:
        for at in range(0, len(out), self.block):
            some = out[at:at + self.block]
            yield pd.DataFrame({"alert_id": pd.array([i if named else None for (i, named), _, _ in some], "Int64"),
                                "status": [STATUS[s] for _, s, _ in some], "overdue": [late for _, _, late in some]})

    def advance(self, key, rows: np.ndarray) -> Iterator[pd.DataFrame]:
        alerts, out = self._loaded(), []
        for us, event, minutes, *name in rows.tolist():
            name = tuple(name)
            status, due, last = alerts.pop(name, (None, 0, 0))
            if status is not None and self.quiet_ms is not None and us // 1000 - last // 1000 > self.quiet_ms:
                status, due = None, 0
            if status == NEW and due and us // 1000 > due:
                out.append((name, status, True))
                due = 0
            if event == NEW and status is None:
                status, due = NEW, int(us // 1000 + minutes * 60_000)
            elif event == ACKNOWLEDGED and status == NEW:
                status, due = ACKNOWLEDGED, 0
            elif event == RESOLVED and status is not None:
                out.append((name, RESOLVED, False))
                continue
            if status is not None:
                out.append((name, status, False))
                alerts[name] = [status, due, us]
        yield from self._table(out)

    def passed(self, key, ms: int) -> Iterator[pd.DataFrame]:
        alerts, out, nexts = self._loaded(), [], []
        for name, entry in list(alerts.items()):
            status, due, us = entry
            if status == NEW and due:
                if due <= ms:
                    entry[1] = 0
                    out.append((name, status, True))
                else:
                    nexts.append(due)
            if self.quiet_ms is not None:
                if us // 1000 + self.quiet_ms <= ms:
                    del alerts[name]
                else:
                    nexts.append(us // 1000 + self.quiet_ms)
        if alerts:
            self.state.update((np.array([(*name, *entry) for name, entry in alerts.items()], self.OPEN).tobytes(),))
        else:
            self.state.clear()
        self.alerts = None
        if nexts:
            self.timer(min(nexts), ms)
        yield from self._table(out)


def alert_lifecycle(stream: DataFrame, time: str = "event_at", late: str = "10 minutes", idle: float | None = None, groups: int = GROUPS) -> DataFrame:
    """Status changes of each alert, plus one overdue row when its deadline passes in event time unanswered.

    Expects alert_id, event (NEW / ACKNOWLEDGED / RESOLVED), deadline_min and the event time.  State is kept for ``groups`` groups of
    alerts, each read as a whole when rows or deadlines of it come up (40 bytes for an open alert).
    """
    use_rocksdb(stream.sparkSession)
    code = F.lit(OTHER)
    for i, name in enumerate(STATUS):
        code = F.when(F.col("event") == name, i).otherwise(code)
    alert = F.col("alert_id").cast("long")
    rows = stream.withWatermark(time, late).select(
        F.pmod(F.xxhash64(alert), F.lit(groups)).alias("group"), F.coalesce(alert, F.lit(0).cast("long")).alias("alert_id"),
        alert.isNotNull().cast("long").alias("named"), code.cast("long").alias("event"),
        F.coalesce(F.col("deadline_min").cast("double"), F.lit(0.0)).alias("deadline_min"), time,
        F.coalesce(F.unix_micros(time), F.lit(NO_TIME)).alias("us"))
    return rows.groupBy("group").transformWithStateInPandas(
        AlertLifecycle(idle), "alert_id bigint, status string, overdue boolean", "Append", "EventTime")
