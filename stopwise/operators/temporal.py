"""Ordered delay features: propagation, headway, rolling statistics, lags, knock-on effects.

All frames go through ``stopwise.ordered``, so a hot trip, stop or route is sliced over tasks.  Operators that share
an ordering are fused into one function (one shuffle, one sort).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise.ordered import with_running, with_totals, with_windows
from stopwise.operators.label import disrupted
from stopwise.skew import sharing_hot_keys

TIME, ID = "feed_timestamp", "obs_id"


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp; null stays null (``greatest``/``least`` alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))


def _slope(value: Column, frame, position: Column) -> Column:
    """Least-squares slope over a row frame; null below two points."""
    return F.when(F.count(value).over(frame) >= 2, F.regr_slope(value, position).over(frame))


@sharing_hot_keys
def trip_progress(df: DataFrame, delay: str = "delay_sec", base: DataFrame | None = None) -> DataFrame:
    """Cumulative delay, velocity, acceleration and cascade rate along each trip."""
    by = ["stop_sequence", TIME, ID]
    d, s = F.coalesce(F.col(delay), F.lit(0.0)), F.col("stop_sequence")

    def first(w):
        return {"_dv": F.coalesce(d - F.lag(d).over(w), F.lit(0.0)),
                "_ds": s - F.lag(s).over(w), "_first": F.lag(F.lit(1)).over(w).isNull()}

    def second(w):
        change = F.col("_dv")
        return {
            "delay_velocity": change,
            "delay_acceleration": F.coalesce(change - F.lag(change).over(w), F.lit(0.0)),
            "delay_cascade_rate": F.coalesce(F.try_divide(F.when(~F.col("_first"), change), F.col("_ds")), F.lit(0.0)),
        }

    out = with_windows(df, ["trip_id"], by, [delay], [first, second], back=3, base=base)
    out = out.drop("_dv", "_ds", "_first")
    return with_running(out, ["trip_id"], by, {"cumulative_delay_along_route": ("sum", d)}, base=base)


def previous_at_stop(df: DataFrame, delay: str = "delay_sec", base: DataFrame | None = None) -> DataFrame:
    """Delay of the previous observation at the same stop (0 for the first)."""
    d = F.coalesce(F.col(delay), F.lit(0.0))
    return with_windows(
        df, ["stop_id"], [TIME, ID], [delay],
        [lambda w: {"prev_trip_delay_at_stop": F.coalesce(F.lag(d).over(w), F.lit(0.0))}], back=1, base=base)


def headway(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Seconds since the previous vehicle at the same route and stop."""
    return with_windows(
        df, ["route_id", "stop_id"], [TIME, ID], [],
        [lambda w: {"headway_sec": seconds_between(F.col(TIME), F.lag(TIME).over(w))}], back=1, base=base)


@sharing_hot_keys
def headway_stability(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Headway with its route-stop mean and spread, bunching, gap ratio and coefficient of variation."""
    rows = headway(df, base)
    narrow = headway((base if base is not None else df).select("route_id", "stop_id", TIME, ID))
    h = F.col("headway_sec")
    mean, std = F.avg(h), F.stddev_samp(h)
    out = with_totals(rows, ["route_id", "stop_id"], [
        mean.alias("scheduled_headway"), std.alias("headway_regularity"),
        F.when(mean > 0, F.coalesce(std / mean, F.lit(0.0))).otherwise(0.0).alias("headway_cv")],
        spread=F.col(ID), base=narrow)
    return out.withColumns({
        "bunching_indicator": F.coalesce(h < F.col("scheduled_headway") * 0.5, F.lit(False)).cast("int"),
        "service_gap_ratio": clip(F.try_divide(h, F.col("scheduled_headway")), 0, 10),
        "headway_cv": F.coalesce("headway_cv", F.lit(0.0)),
    })


@sharing_hot_keys
def headway_profile(df: DataFrame, scheduled: str = "scheduled_headway_sec", base: DataFrame | None = None) -> DataFrame:
    """Actual headway per route-stop: minutes, 5-row spread, mean, bunched / gap flags, ratio to the schedule."""
    def first(w):
        return {"actual_headway": seconds_between(F.col(TIME), F.lag(TIME).over(w))}

    def second(w):
        return {"headway_variability": F.stddev_samp("actual_headway").over(w.rowsBetween(-4, 0))}

    def build(frame, origin=None):
        return with_windows(frame, ["route_id", "stop_id"], [TIME, ID], [], [first, second], back=6, base=origin)

    narrow = build((base if base is not None else df).select("route_id", "stop_id", TIME, ID))
    out = with_totals(build(df, base), ["route_id", "stop_id"], [F.avg("actual_headway").alias("headway_mean")],
                      spread=F.col(ID), base=narrow)
    h = F.col("actual_headway")
    cols = {
        "headway_minutes": h / 60,
        "headway_is_bunched": F.coalesce(h < F.col("headway_mean") * 0.5, F.lit(False)).cast("int"),
        "headway_is_gap": F.coalesce(h > F.col("headway_mean") * 2, F.lit(False)).cast("int"),
    }
    if scheduled in df.columns:
        cols["headway_ratio"] = F.try_divide(h, F.col(scheduled))
        cols["headway_deviation"] = h - F.col(scheduled)
    return out.withColumns(cols)


def scheduled_headway(df: DataFrame, scheduled: str = "sched_arr_sec", base: DataFrame | None = None) -> DataFrame:
    """Actual against scheduled headway of the route-stop: both gaps, ratio, deviation and 5-row spread."""
    def first(w):
        return {"actual_headway": seconds_between(F.col(TIME), F.lag(TIME).over(w)),
                "scheduled_headway_sec": F.col(scheduled) - F.lag(scheduled).over(w)}

    def second(w):
        return {"headway_variability": F.stddev_samp("actual_headway").over(w.rowsBetween(-4, 0))}

    out = with_windows(df, ["route_id", "stop_id"], [TIME, ID], [scheduled], [first, second], back=6, base=base)
    return out.withColumns({
        "headway_ratio": F.try_divide(F.col("actual_headway"), F.col("scheduled_headway_sec").cast("double")),
        "headway_deviation": F.col("actual_headway") - F.col("scheduled_headway_sec"),
    })


def route_trend(df: DataFrame, delay: str = "delay_sec", base: DataFrame | None = None) -> DataFrame:
    """Per route in time order: mean of the last five delays and slope of the last ten."""
    d = F.col(delay)
    return with_windows(df, ["route_id"], [TIME, ID], [delay], [
        lambda w: {"rolling_mean_delay_5min": F.avg(d).over(w.rowsBetween(-4, 0)), "_pos": F.row_number().over(w)},
        lambda w: {"delay_trend": _slope(d, w.rowsBetween(-9, 0), F.col("_pos"))},
    ], back=9, base=base).drop("_pos")


def route_mean_in_time(df: DataFrame, minutes: int = 5, delay: str = "delay_sec") -> DataFrame:
    """True time window: mean delay of the route over ``(t - minutes, t]``.

    Two running totals, one at the row and one at the instant ``t - minutes``, are subtracted, so the cost does not
    grow with the number of rows in the window.
    """
    span = minutes * 60_000_000
    d = F.col(delay)
    steps = df.groupBy("route_id", F.unix_micros(TIME).alias("_us")).agg(
        F.sum(d).alias("_s"), F.count(d).alias("_c"))
    line = steps.select("route_id", "_us", F.lit(0).alias("_side"), "_s", "_c", F.col("_us").alias("_at"),
                        F.lit(1).alias("_sign")).unionByName(
        steps.select("route_id", (F.col("_us") - span).alias("_us"), F.lit(1).alias("_side"),
                     F.lit(0.0).alias("_s"), F.lit(0).cast("long").alias("_c"), F.col("_us").alias("_at"),
                     F.lit(-1).alias("_sign")))
    run = with_running(line, ["route_id"], ["_us", "_side"], {"_rs": ("sum", F.col("_s")), "_rc": ("sum", F.col("_c"))})
    sums = run.groupBy("route_id", "_at").agg(
        F.sum(F.col("_rs") * F.col("_sign")).alias("_ts"), F.sum(F.col("_rc") * F.col("_sign")).alias("_tc"))
    means = sums.select("route_id", "_at", F.try_divide("_ts", "_tc").alias("rolling_mean_delay_5min_time"))
    from stopwise.skew import attach

    rows = df.withColumn("_at", F.unix_micros(TIME))
    return attach(rows, means, ["route_id", "_at"], F.col(ID), instant=True).drop("_at")


def trend_block(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Look-back block per trip and stop: delay and speed trajectory, rolling statistics, disrupted count."""
    d, s = F.col("delay_sec"), F.col("speed")

    def first(w):
        five = w.rowsBetween(-4, 0)
        return {
            "delay_prev": F.lag(d).over(w), "delay_delta": d - F.lag(d).over(w),
            "delay_rolling_mean_5": F.avg(d).over(five),
            "delay_rolling_std_5": F.coalesce(F.stddev_samp(d).over(five), F.lit(0.0)),
            "delay_rolling_max_5": F.max(d).over(five),
            "speed_prev": F.lag(s).over(w), "speed_delta": s - F.lag(s).over(w),
            "is_disrupted_now": disrupted().cast("int"), "_pos": F.row_number().over(w),
        }

    def second(w):
        five = w.rowsBetween(-4, 0)
        enough = F.count(F.lit(1)).over(five) >= 3
        return {
            "delay_accel": F.col("delay_delta") - F.lag("delay_delta").over(w),
            "delay_trend_slope": F.when(enough, _slope(d, five, F.col("_pos"))),
            "speed_decel_rate": F.avg("speed_delta").over(w.rowsBetween(-2, 0)),
            "disruption_count_in_window": F.sum("is_disrupted_now").over(five),
        }

    return with_windows(df, ["trip_id", "stop_id"], [TIME, ID], ["delay_sec", "speed", "disruption_type"],
                        [first, second], back=6, base=base).drop("_pos")


LAGS = (5, 15, 30, 60)
ROLLING = (5, 10, 20)


def row_lags(df: DataFrame, lags: tuple[int, ...] = LAGS, base: DataFrame | None = None) -> DataFrame:
    """delay_lag_n: the delay n rows earlier of the same trip and stop."""
    return with_windows(df, ["trip_id", "stop_id"], [TIME, ID], ["delay_sec"],
                        [lambda w: {f"delay_lag_{n}": F.lag("delay_sec", n).over(w) for n in lags}],
                        back=max(lags), base=base)


def trip_rolling(df: DataFrame, sizes: tuple[int, ...] = ROLLING, base: DataFrame | None = None) -> DataFrame:
    """Rolling mean, std, max and min per trip, first and second difference, relative change clipped to ±10."""
    d = F.col("delay_sec")

    def first(w):
        out = {}
        for n in sizes:
            frame = w.rowsBetween(-(n - 1), 0)
            out[f"delay_rolling_mean_{n}"] = F.avg(d).over(frame)
            out[f"delay_rolling_std_{n}"] = F.coalesce(F.stddev_samp(d).over(frame), F.lit(0.0))
            out[f"delay_rolling_max_{n}"] = F.max(d).over(frame)
            out[f"delay_rolling_min_{n}"] = F.min(d).over(frame)
        prev = F.lag(d).over(w)
        out["delay_diff"] = d - prev
        out["delay_pct_change"] = clip(F.try_divide(d - prev, prev), -10, 10)
        return out

    def second(w):
        return {"delay_diff2": F.col("delay_diff") - F.lag("delay_diff").over(w)}

    return with_windows(df, ["trip_id"], [TIME, ID], ["delay_sec"], [first, second], back=max(sizes), base=base)


def stop_block(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Per stop in time order: gap to the previous trip, and knock-on statistics of past delays only."""
    d = F.col("delay_sec")

    def first(w):
        gap = seconds_between(F.col(TIME), F.lag(TIME).over(w))
        return {
            "time_since_last_trip": gap,
            "trips_per_hour": F.coalesce(clip(F.try_divide(F.lit(3600.0), gap), 0, 30), F.lit(0.0)),
            "has_large_gap": F.coalesce(gap > 15 * 60, F.lit(False)).cast("int"),
            "gap_severity_min": F.bround(clip(gap / 60, 0, 120), 1),
            "_past": F.lag(d).over(w),
            "_past_late": F.coalesce(F.lag(d).over(w) > 60, F.lit(False)).cast("int"),
        }

    def second(w):
        ten = w.rowsBetween(-9, 0)
        return {
            "stop_mean_delay": F.coalesce(F.avg("_past").over(ten), F.lit(0.0)),
            "stop_delay_variance": F.coalesce(F.var_samp("_past").over(ten), F.lit(0.0)),
            "stop_delayed_trips": F.sum("_past_late").over(ten),
        }

    out = with_windows(df, ["stop_id"], [TIME, ID], ["delay_sec"], [first, second], back=11, base=base)
    return out.withColumns({
        "stop_critical_delay": F.coalesce(d > 300, F.lit(False)).cast("int"),
        "estimated_recovery_min": F.bround(
            clip(F.col("stop_mean_delay") / 60 * (1 + F.col("stop_delayed_trips") / 10), 0, 240), 1),
    }).drop("_past", "_past_late")


def trip_neighbours(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Along the trip: inter-stop time against the next one, and delay propagation downstream."""
    d = F.col("delay_sec")

    def first(w):
        return {
            "inter_stop_time": seconds_between(F.col(TIME), F.lag(TIME).over(w)),
            "delay_next_stop": F.lead(d).over(w), "delay_prev_stop": F.lag(d).over(w),
        }

    def second(w):
        return {
            "expected_inter_stop": F.lead("inter_stop_time").over(w),
            "delay_downstream_mean": F.avg("delay_next_stop").over(w.rowsBetween(-2, 0)),
        }

    out = with_windows(df, ["trip_id"], ["stop_sequence", TIME, ID], ["delay_sec"], [first, second],
                       back=4, ahead=2, base=base)
    trend = d - F.col("delay_downstream_mean")
    return out.withColumns({
        "travel_time_diff": F.coalesce(F.col("inter_stop_time") - F.col("expected_inter_stop"), F.lit(0.0)),
        "delay_propagation_trend": trend,
        "is_propagating": F.coalesce(trend > 60, F.lit(False)).cast("int"),
        "delay_stop_to_stop": d - F.col("delay_prev_stop"),
    })


def sequence_position(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Share of the trip done, first / last / middle stop flags."""
    source = base if base is not None else df
    out = with_totals(df, ["trip_id"], [F.max("stop_sequence").alias("_max_seq")], spread=F.col(ID),
                      base=source.select("trip_id", "stop_sequence"))
    s, last = F.col("stop_sequence"), F.col("stop_sequence") == F.col("_max_seq")
    return out.withColumns({
        "stop_sequence_ratio": F.coalesce(F.try_divide(s, F.col("_max_seq")), F.lit(0.0)),
        "is_first_stop": F.coalesce(s == 1, F.lit(False)).cast("int"),
        "is_last_stop": F.coalesce(last, F.lit(False)).cast("int"),
        "is_middle_stop": F.coalesce((s > 1) & ~last, F.lit(False)).cast("int"),
    }).drop("_max_seq")


def route_lag_features(df: DataFrame, n: int = 5, base: DataFrame | None = None) -> DataFrame:
    """Delays of the last ``n`` observations of the route (0 when absent) and the mean of those that exist."""
    def lags(w):
        raw = [F.lag("delay_sec", i).over(w) for i in range(1, n + 1)]
        out = {f"_lag_{i}": c for i, c in enumerate(raw, 1)}
        return out

    out = with_windows(df, ["route_id"], [TIME, ID], ["delay_sec"], [lags], back=n, base=base)
    known = F.filter(F.array(*[f"_lag_{i}" for i in range(1, n + 1)]), lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x)
    out = out.withColumn("route_lag_mean", F.when(F.size(known) > 0, total / F.size(known)).otherwise(0.0))
    out = out.withColumns({f"route_lag_{i}": F.coalesce(f"_lag_{i}", F.lit(0.0)) for i in range(1, n + 1)})
    return out.drop(*[f"_lag_{i}" for i in range(1, n + 1)])


def sequence_headway(df: DataFrame, target_min: float = 10.0, bunch_min: float = 3.0,
                     base: DataFrame | None = None) -> DataFrame:
    """Minutes between consecutive vehicles of a route-stop, deviation from the target and bunching flag."""
    out = headway(df, base)
    gap = F.col("headway_sec") / 60
    return out.withColumns({
        "headway_gap_min": gap,
        "headway_deviation_min": F.abs(gap - target_min),
        "is_bunched": F.coalesce(gap < bunch_min, F.lit(False)).cast("int"),
    }).drop("headway_sec")


def lead_target(df: DataFrame, steps: int = 6, delay_limit: float = 300, var_limit: float = 120,
                base: DataFrame | None = None) -> DataFrame:
    """target_30min_shift: whether the route is disturbed ``steps`` rows later (large delay or headway variance)."""
    flag = (F.coalesce(F.col("delay_sec") > delay_limit, F.lit(False))
            | F.coalesce(F.col("headway_variance") > var_limit, F.lit(False))) if "headway_variance" in df.columns \
        else F.coalesce(F.col("delay_sec") > delay_limit, F.lit(False))
    inputs = ["delay_sec"] + (["headway_variance"] if "headway_variance" in df.columns else [])
    return with_windows(df, ["route_id"], [TIME, ID], inputs,
                        [lambda w: {"target_30min_shift": F.lead(flag.cast("int"), steps).over(w)}],
                        ahead=steps, base=base)


def past_event_flags(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Whether the delay 10 / 30 / 60 rows earlier in the trip was off by a minute (three minutes for disruption)."""
    def flags(w):
        def off(n, limit):
            return F.coalesce(F.abs(F.lag("delay_sec", n).over(w)) > limit, F.lit(False)).cast("int")
        return {"past_event_10": off(10, 60), "past_event_30": off(30, 60), "past_event_60": off(60, 60),
                "past_disruption_30": off(30, 180)}

    out = with_windows(df, ["trip_id"], [TIME, ID], ["delay_sec"], [flags], back=60, base=base)
    return out.withColumn("is_disruption", F.coalesce(F.abs("delay_sec") > 180, F.lit(False)).cast("int"))


def change_features(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Speed change to the previous row and delay change over two rows, both within the trip."""
    d, s = F.coalesce(F.col("delay_sec"), F.lit(0.0)), F.col("speed") / 3.6
    return with_windows(df, ["trip_id"], [TIME, ID], ["delay_sec", "speed"], [
        lambda w: {"speed_change": s - F.lag(s).over(w), "delay_change_2": d - F.lag(d, 2).over(w)}], back=2, base=base)


def smooth(df: DataFrame, keys: list[str], value: str, sizes: tuple[int, ...] = (10, 6),
           base: DataFrame | None = None) -> DataFrame:
    """Rolling means for charts; the first rows use what is there."""
    return with_windows(df, keys, [TIME, ID], [value], [
        lambda w: {f"{value}_smooth_{n}": F.avg(value).over(w.rowsBetween(-(n - 1), 0)) for n in sizes}],
        back=max(sizes), base=base)


def rolling_rate(df: DataFrame, keys: list[str], flag: str, size: int, min_rows: int,
                 base: DataFrame | None = None) -> DataFrame:
    """Share of flagged rows among the last ``size``; null until ``min_rows`` rows are there."""
    def rate(w):
        frame = w.rowsBetween(-(size - 1), 0)
        return {f"{flag}_rate": F.when(F.count(flag).over(frame) >= min_rows, F.avg(F.col(flag).cast("double")).over(frame))}
    return with_windows(df, keys, [TIME, ID], [flag], [rate], back=size, base=base)


def sequences(df: DataFrame, features: list[str], length: int = 10, horizons: tuple[int, ...] = (1,),
              base: DataFrame | None = None) -> DataFrame:
    """Sliding windows of ``length`` feature vectors per trip with the delay ``h`` rows later as target."""
    def first(w):
        vector = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
        out = {"sequence": F.collect_list(vector).over(w.rowsBetween(-(length - 1), 0))}
        out.update({f"target_h{h}": F.lead("delay_sec", h).over(w) for h in horizons})
        return out

    inputs = list(dict.fromkeys([*features, "delay_sec"]))
    out = with_windows(df, ["trip_id"], [TIME, ID], inputs, [first], back=length, ahead=max(horizons), base=base)
    return out.filter((F.size("sequence") == length) & F.col(f"target_h{max(horizons)}").isNotNull())


def latest_per_key(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Last value of each key in time order; a partial aggregate, no window."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(TIME, ID)).alias(f"last_{value}"))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep one row per key, the smallest by ``order``; partial aggregation instead of a sort per key."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)])
    if not rest:
        return df.distinct()
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return kept.select(*keys, "_row.*").select(*df.columns)
