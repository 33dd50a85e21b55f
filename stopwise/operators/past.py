"""The descriptive columns as they stood at each row: only rows up to it, in the order of time and id, are seen.

Column names are those of the descriptive operators, which use the whole table.  Whatever is taken from labels leaves out the row
itself as well.  All values are running values (``ordered.with_running``), so hot keys are sliced and nothing is compared pairwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.operators.label import disrupted
from stopwise.operators.spatial import neighbour_locations
from stopwise.operators.temporal import ID, TIME, clip
from stopwise.ordered import with_running, with_windows
from stopwise.skew import attach


def headway_stability(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Headway with mean, spread and variation of the route-stop's headways so far, its own included, bunching and gap ratio.

    Sums are exact (microseconds), so the spread does not suffer from cancellation.
    """
    keys, by = ["route_id", "stop_id"], [TIME, ID]

    def headways(frame: DataFrame, origin: DataFrame | None = None) -> DataFrame:
        return with_windows(frame, keys, by, [], [
            lambda w: {"_us": F.unix_micros(TIME) - F.unix_micros(F.lag(TIME).over(w))}], back=1, base=origin)

    source = base if base is not None else df
    us = F.col("_us").cast("decimal(19,0)")
    rows = with_running(headways(df, base), keys, by, {
        "_n": ("count", F.col("_us")), "_s": ("sum", us), "_ss": ("sum", us * us)}, base=headways(source.select(*keys, *by)))
    n, s = F.col("_n"), F.col("_s")
    square = s.cast("decimal(19,0)") * s.cast("decimal(19,0)")
    spread = F.when(n > 1, F.greatest(F.lit(0.0), (F.col("_ss") - (square / n.cast("decimal(12,0)")).cast("decimal(38,6)")).cast("double")))
    rows = rows.withColumns({
        "headway_sec": F.col("_us") / 1e6, "scheduled_headway": s.cast("double") / n / 1e6,
        "headway_regularity": F.sqrt(spread / (n - 1)) / 1e6})
    h, mean = F.col("headway_sec"), F.col("scheduled_headway")
    return rows.withColumns({
        "headway_cv": F.when(mean > 0, F.coalesce(F.col("headway_regularity") / mean, F.lit(0.0))).otherwise(0.0),
        "bunching_indicator": F.coalesce(h < mean * 0.5, F.lit(False)).cast("int"),
        "service_gap_ratio": clip(F.try_divide(h, mean), 0, 10)}).drop("_us", "_n", "_s", "_ss")


def disruption_density(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Disrupted rows of the stop before this one, and their share among the route's rows before it (null while there is none)."""
    flag = disrupted().cast("long")
    rows = with_running(df, ["stop_id"], [TIME, ID], {"stop_disruption_count": ("sum", flag)}, include_current=False, base=base)
    rows = with_running(rows, ["route_id"], [TIME, ID], {"_bad": ("sum", flag), "_all": ("count", F.lit(1))}, include_current=False, base=base)
    return rows.withColumns({
        "stop_disruption_count": F.coalesce("stop_disruption_count", F.lit(0)),
        "route_disruption_density": F.when(F.col("_bad") > 0, F.col("_bad") / F.col("_all"))}).drop("_bad", "_all")


def congestion(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Rows of the stop and hour of day so far, and distinct vehicles of the route and hour of day so far."""
    hour = {"hour": F.hour(TIME)}
    rows = df.withColumns(hour)
    source = (base if base is not None else df).withColumns(hour)

    def met(frame: DataFrame, origin: DataFrame | None = None) -> DataFrame:
        return with_windows(frame, ["route_id", "hour", "vehicle_id"], [TIME, ID], [], [
            lambda w: {"_new": (F.lag(ID).over(w).isNull() & F.col("vehicle_id").isNotNull()).cast("long")}], back=1, base=origin)

    rows = with_running(rows, ["stop_id", "hour"], [TIME, ID], {"stop_congestion_index": ("count", F.lit(1))}, base=source)
    return with_running(met(rows, source), ["route_id", "hour"], [TIME, ID], {"vehicle_density": ("sum", F.col("_new"))},
                        base=met(source.select("route_id", "hour", "vehicle_id", TIME, ID))).drop("_new")


def dwell_anomaly(df: DataFrame, dwell: str = "dwell_time_sec", base: DataFrame | None = None) -> DataFrame:
    """Dwell time against the mean of the stop so far, its own included; 0 when there is no dwell column."""
    if dwell not in df.columns:
        return df.withColumn("dwell_time_anomaly", F.lit(0.0))
    rows = with_running(df, ["stop_id"], [TIME, ID], {"_s": ("sum", F.col(dwell)), "_n": ("count", F.col(dwell))}, base=base)
    return rows.withColumn("dwell_time_anomaly", F.col(dwell) - F.try_divide(F.col("_s"), F.col("_n"))).drop("_s", "_n")


def interactions(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Delay-speed ratio (clipped to ±100), product, and the correlation over the route's rows so far.

    The correlation is 0 for a single row and null where speed or delay has not varied yet.
    """
    d, s = F.col("delay_sec").cast("double"), F.col("speed").cast("double")
    both = d.isNotNull() & s.isNotNull()
    sums = {"_n": F.lit(1.0), "_x": s, "_y": d, "_xx": s * s, "_yy": d * d, "_xy": s * d}
    rows = df.withColumns({"delay_speed_ratio": clip(F.try_divide(F.col("delay_sec"), F.col("speed")), -100, 100),
                           "delay_speed_product": F.col("delay_sec") * F.col("speed")})
    rows = with_running(rows, ["route_id"], [TIME, ID], {"_rows": ("count", F.lit(1))} | {
        name: ("sum", F.when(both, value)) for name, value in sums.items()}, base=base)
    n, x, y, xx, yy, xy = (F.col(c) for c in sums)

    def varied(square: Column, total: Column) -> Column:
        # What is left of the sum of squares must stand out from its rounding.
        left = n * square - total * total
        return F.when(left > 1e-12 * n * square, left)

    corr = (n * xy - x * y) / F.sqrt(varied(xx, x) * varied(yy, y))
    return rows.withColumn("speed_delay_correlation", F.when(F.col("_rows") > 1, clip(corr, -1, 1)).otherwise(0.0)).drop("_rows", *sums)


def spatial_lag(df: DataFrame, lat: str = "stop_lat", lon: str = "stop_lon", value: str = "delay_sec", radius: float = 0.01,
                base: DataFrame | None = None) -> DataFrame:
    """Mean value of the rows of earlier instants whose latitude and longitude both differ by less than the radius.

    Rows collapse to one sum per location and instant; each goes to the locations near it and is summed up along time there.
    """
    source = (base if base is not None else df).filter(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(TIME).isNotNull())
    steps = source.groupBy(lat, lon, F.unix_micros(TIME).alias("_at")).agg(F.sum(F.col(value).cast("double")).alias("_s"), F.count(value).alias("_c"))
    near = neighbour_locations(source.select(lat, lon).distinct(), lat, lon, radius).select(
        F.col(lat).alias("_tlat"), F.col(lon).alias("_tlon"), F.col("_o")[lat].alias(lat), F.col("_o")[lon].alias(lon))
    heard = steps.join(near, [lat, lon]).groupBy(F.col("_tlat").alias(lat), F.col("_tlon").alias(lon), "_at").agg(
        F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
    so_far = with_running(heard, [lat, lon], ["_at"], {"_sum": ("sum", F.col("_s")), "_cnt": ("sum", F.col("_c"))}, include_current=False)
    rows = attach(df.withColumn("_at", F.unix_micros(TIME)), so_far.select(lat, lon, "_at", "_sum", "_cnt"), [lat, lon, "_at"], F.col(ID), instant=True)
    return rows.withColumn("spatial_lag_delay", F.when(F.col("_cnt") > 0, F.col("_sum") / F.col("_cnt"))).drop("_at", "_sum", "_cnt")
