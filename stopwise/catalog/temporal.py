"""Label, window and horizon queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopwise.catalog.base import Catalog
from stopwise.operators import horizon, label, past, temporal
from stopwise.testbed import views

CATALOG = Catalog()
add = CATALOG.add
obs, lab = views.obs, views.labelled

W_TRIP_SEQ = "PARTITION BY trip_id ORDER BY stop_sequence, feed_timestamp, obs_id"
W_TRIP = "PARTITION BY trip_id ORDER BY feed_timestamp, obs_id"
W_STOP = "PARTITION BY stop_id ORDER BY feed_timestamp, obs_id"
W_ROUTE = "PARTITION BY route_id ORDER BY feed_timestamp, obs_id"
W_RS = "PARTITION BY route_id, stop_id ORDER BY feed_timestamp, obs_id"
W_TS = "PARTITION BY trip_id, stop_id ORDER BY feed_timestamp, obs_id"
GAP = "(epoch_us(feed_timestamp) - lag(epoch_us(feed_timestamp)) OVER ({w})) / 1e6"


def slope(y: str, window: str, size: int, least: int) -> str:
    frame = f"({window} ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({y}) OVER {frame} >= {least} THEN regr_slope({y}, rn) OVER {frame} END"


add("prj04_delay_flags", "obs_id:i delay_min:f missing_schedule delay_flag",
    lambda s, d: label.flag_delay(obs(s, d)),
    """SELECT obs_id, delay_sec / 60.0 AS delay_min, true AS missing_schedule,
       CASE WHEN delay_sec > 120 THEN 'late' WHEN delay_sec < -60 THEN 'early' ELSE 'on_time' END AS delay_flag
       FROM obs""")

add("prj05_speed_flag", "obs_id:i speed:f speed_flag",
    lambda s, d: label.flag_speed(obs(s, d)), "SELECT obs_id, speed, speed_flag FROM lab")

add("prj07_classify", "obs_id:i disruption_type severity_score:i", lab,
    "SELECT obs_id, disruption_type, severity_score FROM lab")

add("prj08_targets", "obs_id:i disruption_target:i disruption_class:i",
    lambda s, d: label.add_targets(lab(s, d)),
    """SELECT obs_id, CAST(disruption_type <> 'ON_TIME' AS INT) AS disruption_target,
       (SELECT count(DISTINCT b.disruption_type) FROM lab b WHERE b.disruption_type < a.disruption_type)
         AS disruption_class FROM lab a""")

add("prj09_infer_type", "obs_id:i disruption_type",
    lambda s, d: label.infer_type_from_delay(label.flag_delay(obs(s, d))),
    """SELECT obs_id, CASE WHEN delay_sec / 60.0 <= 2 THEN 'ON_TIME' WHEN delay_sec / 60.0 <= 5 THEN 'MINOR_DELAY'
       ELSE 'MAJOR_DELAY' END AS disruption_type FROM obs""")

add("win01_prev_trip_delay_at_stop", "obs_id:i prev_trip_delay_at_stop:f",
    lambda s, d: temporal.previous_at_stop(obs(s, d)),
    f"SELECT obs_id, coalesce(lag(delay_sec) OVER ({W_STOP}), 0) AS prev_trip_delay_at_stop FROM obs")

add("win02_04_trip_progress",
    "obs_id:i cumulative_delay_along_route:f delay_velocity:f delay_acceleration:f delay_cascade_rate:f",
    lambda s, d: temporal.trip_progress(obs(s, d)),
    f"""SELECT obs_id, cum AS cumulative_delay_along_route, v AS delay_velocity,
        coalesce(v - lag(v) OVER ({W_TRIP_SEQ}), 0) AS delay_acceleration,
        coalesce(dd / nullif(ds, 0), 0) AS delay_cascade_rate
        FROM (SELECT *, sum(delay_sec) OVER ({W_TRIP_SEQ} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
              delay_sec - lag(delay_sec) OVER ({W_TRIP_SEQ}) AS dd,
              coalesce(delay_sec - lag(delay_sec) OVER ({W_TRIP_SEQ}), 0) AS v,
              stop_sequence - lag(stop_sequence) OVER ({W_TRIP_SEQ}) AS ds FROM obs)""", digits=4)

add("win05_agg06_headway_stability",
    "obs_id:i headway_sec:f scheduled_headway:f headway_regularity:f bunching_indicator:i service_gap_ratio:f headway_cv:f",
    lambda s, d: temporal.headway_stability(obs(s, d)),
    """SELECT obs_id, headway_sec, m AS scheduled_headway, sd AS headway_regularity,
       CASE WHEN headway_sec < m * 0.5 THEN 1 ELSE 0 END AS bunching_indicator,
       CASE WHEN headway_sec IS NOT NULL AND m <> 0 THEN least(greatest(headway_sec / m, 0), 10) END
         AS service_gap_ratio,
       CASE WHEN m > 0 THEN coalesce(sd / m, 0) ELSE 0 END AS headway_cv
       FROM hw JOIN (SELECT route_id, stop_id, avg(headway_sec) AS m,
                     CASE WHEN count(headway_sec) > 1 THEN stddev_samp(headway_sec) END AS sd
                     FROM hw GROUP BY ALL) USING (route_id, stop_id)""",
    ctes=f"hw AS (SELECT *, {GAP.format(w=W_RS)} AS headway_sec FROM obs)", digits=4)

add("win06_07_route_trend", "obs_id:i rolling_mean_delay_5min:f delay_trend:f",
    lambda s, d: temporal.route_trend(obs(s, d)),
    f"""SELECT obs_id, avg(delay_sec) OVER ({W_ROUTE} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
        AS rolling_mean_delay_5min, {slope('delay_sec', W_ROUTE, 10, 2)} AS delay_trend
        FROM (SELECT *, row_number() OVER ({W_ROUTE}) AS rn FROM obs)""", digits=4)

add("win06_route_mean_in_time", "obs_id:i rolling_mean_delay_5min_time:f",
    lambda s, d: temporal.route_mean_in_time(obs(s, d)),
    """SELECT obs_id, avg(delay_sec) OVER (PARTITION BY route_id ORDER BY feed_us
       RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) AS rolling_mean_delay_5min_time FROM obs""", digits=4)

add("win08_trend_block",
    "obs_id:i delay_prev:f delay_delta:f delay_accel:f delay_rolling_mean_5:f delay_rolling_std_5:f "
    "delay_rolling_max_5:f delay_trend_slope:f speed_prev:f speed_delta:f speed_decel_rate:f is_disrupted_now:i "
    "disruption_count_in_window:i",
    lambda s, d: temporal.trend_block(lab(s, d)),
    f"""SELECT *, delay_delta - lag(delay_delta) OVER w AS delay_accel,
        {slope('delay_sec', W_TS, 5, 3)} AS delay_trend_slope,
        avg(speed_delta) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS speed_decel_rate,
        sum(is_disrupted_now) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS disruption_count_in_window
        FROM (SELECT *, lag(delay_sec) OVER w AS delay_prev, delay_sec - lag(delay_sec) OVER w AS delay_delta,
          avg(delay_sec) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS delay_rolling_mean_5,
          coalesce(stddev_samp(delay_sec) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS delay_rolling_std_5,
          max(delay_sec) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS delay_rolling_max_5,
          lag(speed) OVER w AS speed_prev, speed - lag(speed) OVER w AS speed_delta,
          CAST(disruption_type <> 'ON_TIME' AS INT) AS is_disrupted_now, row_number() OVER w AS rn
          FROM lab WINDOW w AS ({W_TS}))
        WINDOW w AS ({W_TS})""", digits=4)

HORIZON_SQL = ["""CASE WHEN disruption_type = 'ON_TIME' THEN coalesce(max(CASE WHEN nd = 1 THEN {v} END) OVER (
    PARTITION BY trip_id, stop_id ORDER BY feed_us RANGE BETWEEN 1 FOLLOWING AND {us} FOLLOWING), 0) ELSE 0 END AS {n}"""
               .format(v=v, us=m * 60_000_000, n=n)
               for m in (10, 30, 60) for v, n in (("1", f"target_{m}min"), ("code", f"target_mc_{m}min"))]

add("win09_onsets", "obs_id:i new_disruption:i", lambda s, d: horizon.onsets(lab(s, d)),
    f"""SELECT obs_id, CASE WHEN disruption_type <> 'ON_TIME' AND coalesce(lag(disruption_type) OVER ({W_TS}),
        'ON_TIME') = 'ON_TIME' THEN 1 ELSE 0 END AS new_disruption FROM lab""")

add("win10_11_join11_forward_targets",
    "obs_id:i target_10min:i target_30min:i target_60min:i target_mc_10min:i target_mc_30min:i target_mc_60min:i",
    lambda s, d: horizon.forward_targets(lab(s, d)),
    f"""SELECT obs_id, {', '.join(HORIZON_SQL)} FROM (
        SELECT *, CASE WHEN disruption_type <> 'ON_TIME' AND coalesce(lag(disruption_type) OVER ({W_TS}),
          'ON_TIME') = 'ON_TIME' THEN 1 ELSE 0 END AS nd,
          CASE disruption_type WHEN 'EARLY' THEN 1 WHEN 'SLOW_TRAFFIC' THEN 2 WHEN 'SERVICE_ALERT' THEN 2
            WHEN 'MINOR_DELAY' THEN 3 WHEN 'STOPPED_ON_ROUTE' THEN 3 WHEN 'MAJOR_DELAY' THEN 4
            WHEN 'CANCELLED' THEN 5 ELSE 0 END AS code FROM lab)""")

add("win12_row_lags", "obs_id:i delay_lag_5:f delay_lag_15:f delay_lag_30:f delay_lag_60:f",
    lambda s, d: temporal.row_lags(obs(s, d)),
    f"""SELECT obs_id, lag(delay_sec, 5) OVER w AS delay_lag_5, lag(delay_sec, 15) OVER w AS delay_lag_15,
        lag(delay_sec, 30) OVER w AS delay_lag_30, lag(delay_sec, 60) OVER w AS delay_lag_60
        FROM obs WINDOW w AS ({W_TS})""")

_ROLL = ", ".join(
    f"{fn} AS delay_rolling_{name}_{n}" for n in (5, 10, 20) for name, fn in (
        ("mean", f"avg(delay_sec) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"),
        ("std", f"coalesce(stddev_samp(delay_sec) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0)"),
        ("max", f"max(delay_sec) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"),
        ("min", f"min(delay_sec) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")))
add("win13_14_trip_rolling",
    "obs_id:i " + " ".join(f"delay_rolling_{k}_{n}:f" for n in (5, 10, 20) for k in ("mean", "std", "max", "min"))
    + " delay_diff:f delay_diff2:f delay_pct_change:f",
    lambda s, d: temporal.trip_rolling(obs(s, d)),
    f"""SELECT *, delay_diff - lag(delay_diff) OVER ({W_TRIP}) AS delay_diff2 FROM (
        SELECT *, {_ROLL}, delay_sec - lag(delay_sec) OVER w AS delay_diff,
        CASE WHEN lag(delay_sec) OVER w <> 0 THEN least(greatest((delay_sec - lag(delay_sec) OVER w)
          / lag(delay_sec) OVER w, -10), 10) END AS delay_pct_change
        FROM obs WINDOW w AS ({W_TRIP}))""", digits=4)

add("win15_18_stop_block",
    "obs_id:i time_since_last_trip:f trips_per_hour:f has_large_gap:i gap_severity_min:f stop_mean_delay:f "
    "stop_delay_variance:f stop_delayed_trips:i stop_critical_delay:i estimated_recovery_min:f",
    lambda s, d: temporal.stop_block(obs(s, d)),
    f"""SELECT *, round_even(least(greatest(stop_mean_delay / 60 * (1 + stop_delayed_trips / 10), 0), 240), 1)
        AS estimated_recovery_min FROM (
        SELECT *, coalesce(avg(past) OVER ten, 0) AS stop_mean_delay,
          CASE WHEN count(past) OVER ten > 1 THEN var_samp(past) OVER ten ELSE 0 END AS stop_delay_variance,
          sum(late) OVER ten AS stop_delayed_trips, CAST(delay_sec > 300 AS INT) AS stop_critical_delay FROM (
          SELECT *, lag(delay_sec) OVER w AS past, coalesce(CAST(lag(delay_sec) OVER w > 60 AS INT), 0) AS late,
            gap AS time_since_last_trip, coalesce(least(greatest(3600 / nullif(gap, 0), 0), 30), 0) AS trips_per_hour,
            CASE WHEN gap > 900 THEN 1 ELSE 0 END AS has_large_gap,
            CASE WHEN gap IS NOT NULL THEN round_even(least(greatest(gap / 60, 0), 120), 1) END AS gap_severity_min
          FROM (SELECT *, {GAP.format(w=W_STOP)} AS gap FROM obs) WINDOW w AS ({W_STOP}))
        WINDOW ten AS ({W_STOP} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))""", digits=3)

add("win16_17_trip_neighbours",
    "obs_id:i inter_stop_time:f expected_inter_stop:f travel_time_diff:f delay_downstream_mean:f "
    "delay_propagation_trend:f is_propagating:i delay_next_stop:f delay_prev_stop:f delay_stop_to_stop:f",
    lambda s, d: temporal.trip_neighbours(obs(s, d)),
    f"""SELECT *, coalesce(inter_stop_time - expected_inter_stop, 0) AS travel_time_diff,
        delay_sec - delay_downstream_mean AS delay_propagation_trend,
        CASE WHEN delay_sec - delay_downstream_mean > 60 THEN 1 ELSE 0 END AS is_propagating,
        delay_sec - delay_prev_stop AS delay_stop_to_stop FROM (
        SELECT *, lead(inter_stop_time) OVER w AS expected_inter_stop,
          avg(delay_next_stop) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS delay_downstream_mean FROM (
          SELECT *, {GAP.format(w=W_TRIP_SEQ)} AS inter_stop_time, lead(delay_sec) OVER w AS delay_next_stop,
            lag(delay_sec) OVER w AS delay_prev_stop FROM obs WINDOW w AS ({W_TRIP_SEQ}))
        WINDOW w AS ({W_TRIP_SEQ}))""", digits=4)

add("win19_headway_profile",
    "obs_id:i actual_headway:f headway_minutes:f headway_variability:f headway_mean:f headway_is_bunched:i headway_is_gap:i",
    lambda s, d: temporal.headway_profile(obs(s, d)),
    f"""SELECT *, actual_headway / 60 AS headway_minutes,
        CASE WHEN actual_headway < headway_mean * 0.5 THEN 1 ELSE 0 END AS headway_is_bunched,
        CASE WHEN actual_headway > headway_mean * 2 THEN 1 ELSE 0 END AS headway_is_gap FROM (
        SELECT *, CASE WHEN count(actual_headway) OVER five > 1 THEN stddev_samp(actual_headway) OVER five END
          AS headway_variability, avg(actual_headway) OVER (PARTITION BY route_id, stop_id) AS headway_mean
        FROM (SELECT *, {GAP.format(w=W_RS)} AS actual_headway FROM obs)
        WINDOW five AS ({W_RS} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))""", digits=3)

add("win20_scheduled_headway",
    "obs_id:i actual_headway:f scheduled_headway_sec:i headway_ratio:f headway_deviation:f headway_variability:f",
    lambda s, d: temporal.scheduled_headway(obs(s, d).withColumn("sched_arr_sec", F.col("stop_sequence") * 60 - F.col("k"))),
    f"""SELECT *, actual_headway / nullif(scheduled_headway_sec, 0) AS headway_ratio,
        actual_headway - scheduled_headway_sec AS headway_deviation,
        CASE WHEN count(actual_headway) OVER five > 1 THEN stddev_samp(actual_headway) OVER five END
          AS headway_variability FROM (
        SELECT *, {GAP.format(w=W_RS)} AS actual_headway,
          stop_sequence * 60 - k - lag(stop_sequence * 60 - k) OVER ({W_RS}) AS scheduled_headway_sec FROM obs)
        WINDOW five AS ({W_RS} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", digits=3)

add("win22_sequence_position",
    "obs_id:i stop_sequence_ratio:f is_first_stop:i is_last_stop:i is_middle_stop:i",
    lambda s, d: temporal.sequence_position(obs(s, d)),
    """SELECT obs_id, stop_sequence / m AS stop_sequence_ratio, CAST(stop_sequence = 1 AS INT) AS is_first_stop,
       CAST(stop_sequence = m AS INT) AS is_last_stop, CAST(stop_sequence > 1 AND stop_sequence <> m AS INT)
       AS is_middle_stop FROM (SELECT *, max(stop_sequence) OVER (PARTITION BY trip_id) AS m FROM obs)""")

add("win23_route_lags", "obs_id:i " + " ".join(f"route_lag_{i}:f" for i in range(1, 6)) + " route_lag_mean:f",
    lambda s, d: temporal.route_lag_features(obs(s, d)),
    "SELECT obs_id, " + ", ".join(f"coalesce(lag(delay_sec, {i}) OVER w, 0) AS route_lag_{i}" for i in range(1, 6))
    + f""", coalesce(avg(delay_sec) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS route_lag_mean
        FROM obs WINDOW w AS ({W_ROUTE})""", digits=4)

add("win24_sequence_headway", "obs_id:i headway_gap_min:f headway_deviation_min:f is_bunched:i",
    lambda s, d: temporal.sequence_headway(obs(s, d)),
    f"""SELECT obs_id, g AS headway_gap_min, abs(g - 10) AS headway_deviation_min,
        CASE WHEN g < 3 THEN 1 ELSE 0 END AS is_bunched
        FROM (SELECT *, {GAP.format(w=W_RS)} / 60 AS g FROM obs)""")

add("win25_lead_target", "obs_id:i target_30min_shift:i", lambda s, d: temporal.lead_target(obs(s, d)),
    f"SELECT obs_id, lead(CAST(delay_sec > 300 AS INT), 6) OVER ({W_ROUTE}) AS target_30min_shift FROM obs")

add("win26_past_event_flags",
    "obs_id:i past_event_10:i past_event_30:i past_event_60:i past_disruption_30:i is_disruption:i",
    lambda s, d: temporal.past_event_flags(obs(s, d)),
    "SELECT obs_id, " + ", ".join(
        f"coalesce(CAST(abs(lag(delay_sec, {n}) OVER w) > {t} AS INT), 0) AS {c}" for n, t, c in (
            (10, 60, "past_event_10"), (30, 60, "past_event_30"), (60, 60, "past_event_60"),
            (30, 180, "past_disruption_30")))
    + f", CAST(abs(delay_sec) > 180 AS INT) AS is_disruption FROM obs WINDOW w AS ({W_TRIP})")

add("win27_changes", "obs_id:i speed_change:f delay_change_2:f", lambda s, d: temporal.change_features(obs(s, d)),
    f"""SELECT obs_id, speed / 3.6 - lag(speed / 3.6) OVER w AS speed_change,
        delay_sec - lag(delay_sec, 2) OVER w AS delay_change_2 FROM obs WINDOW w AS ({W_TRIP})""")

add("win28_smoothing", "obs_id:i delay_sec_smooth_10:f delay_sec_smooth_6:f",
    lambda s, d: temporal.smooth(obs(s, d), ["route_id"], "delay_sec"),
    f"""SELECT obs_id, avg(delay_sec) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS delay_sec_smooth_10,
        avg(delay_sec) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS delay_sec_smooth_6
        FROM obs WINDOW w AS ({W_ROUTE})""", digits=4)

add("win28_rolling_rate", "obs_id:i has_alert_rate:f",
    lambda s, d: temporal.rolling_rate(obs(s, d).withColumn("has_alert", F.col("has_alert").cast("int")),
                                       ["route_id"], "has_alert", 20, 5),
    f"""SELECT obs_id, CASE WHEN count(has_alert) OVER w >= 5 THEN avg(CAST(has_alert AS INT)) OVER w END
        AS has_alert_rate FROM obs WINDOW w AS ({W_ROUTE} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")

add("win29_sequences", "obs_id:i rows_in:i newest:f oldest:f target_h1:f target_h6:f",
    lambda s, d: temporal.sequences(obs(s, d), ["delay_sec", "speed"], 10, (1, 6)).select(
        "obs_id", F.size("sequence").alias("rows_in"), F.col("sequence")[9][0].alias("newest"),
        F.col("sequence")[0][1].alias("oldest"), "target_h1", "target_h6"),
    f"""SELECT obs_id, 10 AS rows_in, delay_sec AS newest, o AS oldest, t1 AS target_h1, t6 AS target_h6 FROM (
        SELECT *, row_number() OVER w AS rn, lag(speed, 9) OVER w AS o, lead(delay_sec) OVER w AS t1,
        lead(delay_sec, 6) OVER w AS t6 FROM obs WINDOW w AS ({W_TRIP})) WHERE rn >= 10 AND t6 IS NOT NULL""")

add("win30_latest_per_stop", "stop_id last_severity_score:i",
    lambda s, d: temporal.latest_per_key(lab(s, d), ["stop_id"], "severity_score"),
    """SELECT stop_id, arg_max(severity_score, feed_us) AS last_severity_score FROM lab GROUP BY stop_id""")

add("agg15_route_snapshots",
    "route_id snapshot route_delay_mean:f route_delay_max:f route_delay_std:f route_speed_mean:f route_disruption_rate:f",
    lambda s, d: horizon.route_snapshots(lab(s, d)),
    f"""SELECT route_id, make_timestamp(feed_us - feed_us % 300000000) AS snapshot, avg(ld) AS route_delay_mean,
        max(ld) AS route_delay_max, coalesce(CASE WHEN count(*) > 1 THEN stddev_samp(ld) END, 0) AS route_delay_std,
        avg(ls) AS route_speed_mean, avg(lb) AS route_disruption_rate FROM (
        SELECT *, coalesce(lag(delay_sec) OVER w, 0) AS ld, coalesce(lag(speed) OVER w, 0) AS ls,
        coalesce(lag(CAST(disruption_type <> 'ON_TIME' AS INT)) OVER w, 0) AS lb FROM lab WINDOW w AS ({W_ROUTE}))
        GROUP BY ALL""", digits=4)

add("agg15_rows_with_snapshots", "obs_id:i route_delay_mean:f route_disruption_rate:f",
    lambda s, d: horizon.add_route_snapshots(lab(s, d)),
    f"""SELECT obs_id, avg(ld) OVER s AS route_delay_mean, avg(lb) OVER s AS route_disruption_rate FROM (
        SELECT *, coalesce(lag(delay_sec) OVER w, 0) AS ld,
        coalesce(lag(CAST(disruption_type <> 'ON_TIME' AS INT)) OVER w, 0) AS lb FROM lab WINDOW w AS ({W_ROUTE}))
        WINDOW s AS (PARTITION BY route_id, feed_us // 300000000)""", digits=4)

add("join07_network_load_as_of", "obs_id:i network_load:f",
    lambda s, d: horizon.network_load_as_of(lab(s, d), 10),
    """SELECT l.obs_id, coalesce(r.severity_score, 0) AS network_load
       FROM lab l ASOF LEFT JOIN lab r ON l.stop_id = r.stop_id AND l.feed_us - 600000000 >= r.feed_us""")

add("join10_alert_count_last_hour", "obs_id:i alert_count_last_hour:i",
    lambda s, d: horizon.alert_count_last_hour(obs(s, d)),
    """SELECT obs_id, CASE WHEN has_alert THEN coalesce(sum(CAST(has_alert AS INT)) OVER (ORDER BY feed_us
       RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING), 0) ELSE 0 END AS alert_count_last_hour FROM obs""")


# The descriptive columns as they stood at each row.
add("win05_agg06_headway_stability_as_of",
    "obs_id:i headway_sec:f scheduled_headway:f headway_regularity:f bunching_indicator:i service_gap_ratio:f headway_cv:f",
    lambda s, d: past.headway_stability(obs(s, d)),
    f"""SELECT obs_id, headway_sec, m AS scheduled_headway, sd AS headway_regularity,
       CASE WHEN headway_sec < m * 0.5 THEN 1 ELSE 0 END AS bunching_indicator,
       CASE WHEN headway_sec IS NOT NULL AND m <> 0 THEN least(greatest(headway_sec / m, 0), 10) END AS service_gap_ratio,
       CASE WHEN m > 0 THEN coalesce(sd / m, 0) ELSE 0 END AS headway_cv
       FROM (SELECT *, avg(headway_sec) OVER w AS m, stddev_samp(headway_sec) OVER w AS sd FROM hw
             WINDOW w AS ({W_RS} ROWS UNBOUNDED PRECEDING))""",
    ctes=f"hw AS (SELECT *, {GAP.format(w=W_RS)} AS headway_sec FROM obs)", digits=4)

add("agg07_disruption_density_as_of", "obs_id:i stop_disruption_count:i route_disruption_density:f",
    lambda s, d: past.disruption_density(lab(s, d)),
    f"""SELECT obs_id, stop_disruption_count, CASE WHEN b > 0 THEN b / n END AS route_disruption_density FROM (
       SELECT obs_id, count(*) FILTER (disruption_type <> 'ON_TIME') OVER ({W_STOP} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop_disruption_count,
         count(*) FILTER (disruption_type <> 'ON_TIME') OVER r AS b, count(*) OVER r AS n FROM lab
       WINDOW r AS ({W_ROUTE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")

add("agg08_congestion_as_of", "obs_id:i stop_congestion_index:i vehicle_density:i",
    lambda s, d: past.congestion(obs(s, d)),
    """SELECT obs_id, count(*) OVER (PARTITION BY stop_id, h ORDER BY feed_timestamp, obs_id ROWS UNBOUNDED PRECEDING) AS stop_congestion_index,
       sum(fresh) OVER (PARTITION BY route_id, h ORDER BY feed_timestamp, obs_id ROWS UNBOUNDED PRECEDING) AS vehicle_density
       FROM (SELECT *, CASE WHEN vehicle_id IS NOT NULL AND row_number() OVER (PARTITION BY route_id, h, vehicle_id ORDER BY feed_timestamp, obs_id) = 1
                       THEN 1 ELSE 0 END AS fresh FROM (SELECT *, hour(feed_timestamp) AS h FROM obs))""")

add("agg09_dwell_anomaly_as_of", "obs_id:i dwell_time_anomaly:f",
    lambda s, d: past.dwell_anomaly(obs(s, d), "speed"),
    f"SELECT obs_id, speed - avg(speed) OVER ({W_STOP} ROWS UNBOUNDED PRECEDING) AS dwell_time_anomaly FROM obs", digits=4)

add("agg10_mth06_interactions_as_of", "obs_id:i delay_speed_ratio:f delay_speed_product:f speed_delay_correlation:f",
    lambda s, d: past.interactions(obs(s, d)),
    f"""SELECT obs_id, CASE WHEN speed <> 0 THEN least(greatest(delay_sec / speed, -100), 100) END AS delay_speed_ratio, delay_sec * speed AS delay_speed_product,
        CASE WHEN count(*) OVER w > 1 THEN
          CASE WHEN min(speed) OVER w < max(speed) OVER w AND min(delay_sec) OVER w < max(delay_sec) OVER w THEN corr(speed, delay_sec) OVER w END
        ELSE 0 END AS speed_delay_correlation
        FROM obs WINDOW w AS ({W_ROUTE} ROWS UNBOUNDED PRECEDING)""", digits=4)

add("join08_spatial_lag_as_of", "obs_id:i spatial_lag_delay:f",
    lambda s, d: past.spatial_lag(obs(s, d)),
    """SELECT o.obs_id, CASE WHEN o.stop_lat IS NOT NULL AND o.stop_lon IS NOT NULL THEN r.m END AS spatial_lag_delay FROM obs o LEFT JOIN (
         SELECT t.obs_id, avg(e.delay_sec) AS m FROM obs t JOIN obs e ON abs(t.stop_lat - e.stop_lat) < 0.01 AND abs(t.stop_lon - e.stop_lon) < 0.01
           AND e.feed_timestamp < t.feed_timestamp GROUP BY 1) r USING (obs_id)""", digits=4)
