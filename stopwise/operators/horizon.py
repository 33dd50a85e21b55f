"""Forward targets: does a new disruption begin within the next minutes, and of which kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopwise.operators.label import disrupted
from stopwise.operators.temporal import ID, TIME
from stopwise.ordered import as_of, count_within, with_running, with_windows
from stopwise.skew import attach, hot_table, sharing_hot_keys

HORIZONS = {"target_10min": 10, "target_30min": 30, "target_60min": 60}

# Code of each label in the multi-class targets.
CODES = {
    "ON_TIME": 0, "EARLY": 1, "SLOW_TRAFFIC": 2, "MINOR_DELAY": 3, "MAJOR_DELAY": 4, "CANCELLED": 5,
    "STOPPED_ON_ROUTE": 3, "SERVICE_ALERT": 2,
}
KEYS = ["trip_id", "stop_id"]


def onsets(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """new_disruption: disrupted now and not at the previous observation of the trip and stop."""
    bad = disrupted().cast("int")
    return with_windows(df, KEYS, [TIME, ID], ["disruption_type"], [
        lambda w: {"new_disruption": ((bad == 1) & (F.coalesce(F.lag(bad).over(w), F.lit(0)) == 0)).cast("int")}],
        back=1, base=base)


@sharing_hot_keys
def forward_targets(df: DataFrame, horizons: dict[str, int] = HORIZONS, base: DataFrame | None = None) -> DataFrame:
    """Binary and multi-class targets for rows that are on time now.

    The next onset strictly after the row is a running minimum from the end of the time line, one per code, so no
    range frame has to be scanned: an onset of code c lies in (t, t+h] exactly when the next one does.  Without a hot
    trip and stop the minimum runs in the shuffle of the onsets; with one it is taken per instant and joined back.
    """
    rows = onsets(df, base)
    code = F.lit(None).cast("int")
    for name, value in CODES.items():
        code = F.when(F.col("disruption_type") == name, value).otherwise(code)
    us = F.unix_micros(TIME)
    levels = sorted(set(CODES.values()) - {0})
    nexts = [f"_next{c}" for c in levels]
    if hot_table(base if base is not None else df, KEYS, [TIME, ID]) is None:
        later = Window.partitionBy(*KEYS).orderBy(F.desc("_us")).rangeBetween(Window.unboundedPreceding, -1)
        onset = F.when((F.col("new_disruption") == 1) & F.col("trip_id").isNotNull() & F.col("stop_id").isNotNull(), code)
        rows = rows.withColumn("_us", us).withColumns({f"_next{c}": F.min(F.when(onset == c, F.col("_us"))).over(later) for c in levels})
    else:
        source = onsets((base if base is not None else df).select(*KEYS, TIME, ID, "disruption_type"))
        marks = (
            source.select(*KEYS, us.alias("_us"), F.when(F.col("new_disruption") == 1, code).alias("_code"))
            .groupBy(*KEYS, "_us").agg(F.collect_set("_code").alias("_codes"))
        )
        values = {f"_next{c}": ("min", F.when(F.array_contains("_codes", c), F.col("_us"))) for c in levels}
        upcoming = with_running(marks, KEYS, ["_us"], values, include_current=False, descending=True)
        rows = attach(rows.withColumn("_us", us), upcoming.drop("_codes"), [*KEYS, "_us"], F.col(ID), instant=True)
    calm = ~disrupted()
    out = {}
    for target, minutes in horizons.items():
        limit = F.col("_us") + F.lit(minutes * 60_000_000).cast("long")
        hits = [F.when(calm & (F.col(f"_next{c}") <= limit), F.lit(c)) for c in levels]
        worst = F.coalesce(F.greatest(*hits), F.lit(0))
        out[target] = (worst > 0).cast("int")
        out[target.replace("target_", "target_mc_")] = worst
    return rows.withColumns(out).drop("_us", *nexts)


def route_snapshots(df: DataFrame, minutes: int = 5, base: DataFrame | None = None) -> DataFrame:
    """Per route and snapshot: statistics of the previous observation's delay, speed and disruption state.

    Only lagged values enter, so a snapshot never contains the row it is joined to.
    """
    source = (base if base is not None else df).select("route_id", TIME, ID, "delay_sec", "speed", "disruption_type")
    bad = disrupted().cast("int")
    lagged = with_windows(source, ["route_id"], [TIME, ID], ["delay_sec", "speed", "disruption_type"], [lambda w: {
        "_d": F.coalesce(F.lag("delay_sec").over(w), F.lit(0.0)),
        "_s": F.coalesce(F.lag("speed").over(w), F.lit(0.0)),
        "_b": F.coalesce(F.lag(bad).over(w), F.lit(0))}], back=1)
    return lagged.groupBy("route_id", snapshot(minutes).alias("snapshot")).agg(
        F.avg("_d").alias("route_delay_mean"), F.max("_d").alias("route_delay_max"),
        F.coalesce(F.stddev_samp("_d"), F.lit(0.0)).alias("route_delay_std"),
        F.avg("_s").alias("route_speed_mean"), F.avg("_b").alias("route_disruption_rate"))


def snapshot(minutes: int, column: str = TIME):
    """Start of the ``minutes`` bin of a timestamp."""
    width = minutes * 60_000_000
    us = F.unix_micros(column)
    return F.timestamp_micros(us - F.pmod(us, F.lit(width).cast("long")))


def add_route_snapshots(df: DataFrame, minutes: int = 5, base: DataFrame | None = None) -> DataFrame:
    source = base if base is not None else df
    rows = df.withColumn("snapshot", snapshot(minutes))
    keys = source.select("route_id", snapshot(minutes).alias("snapshot"))
    return attach(rows, route_snapshots(source, minutes), ["route_id", "snapshot"], F.col(ID), base=keys).drop("snapshot")


def alert_count_last_hour(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Number of alert rows in the hour before each alert row; 0 for rows without an alert."""
    source = (base if base is not None else df).withColumn("_all", F.lit(0))
    return count_within(df.withColumn("_all", F.lit(0)), ["_all"], TIME, F.col("has_alert"), ID,
                        3_600_000_000, "alert_count_last_hour", source).drop("_all")


def network_load_as_of(df: DataFrame, lookback_minutes: int = 10, severity: str = "severity_score") -> DataFrame:
    """Latest severity at the stop that is at least ``lookback`` old, else 0 (never the row itself or the future)."""
    facts = df.select("stop_id", F.col(TIME).alias("_seen"), F.col(ID).alias("_rank"), F.col(severity).alias("_sev"))
    found = as_of(df, facts, ["stop_id"], TIME, "_seen", ["_rank", "_sev"], ID, lookback_minutes * 60_000_000)
    return found.withColumn("network_load", F.coalesce(F.col("_sev").cast("double"), F.lit(0.0))).drop("_rank", "_sev")
