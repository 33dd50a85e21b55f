"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopwise.catalog.base import Catalog
from stopwise.operators import label, quantiles, summary
from stopwise.testbed import views
from stopwise.testbed.views import table

CATALOG = Catalog()
add = CATALOG.add
obs, lab = views.obs, views.labelled

PCTS = " ".join(f"pct_{t.lower()}:f" for t in label.LABELS)
PCT_SQL = ", ".join(f"avg(CASE WHEN disruption_type = '{t}' THEN 100.0 ELSE 0 END) AS pct_{t.lower()}" for t in label.LABELS)
BAD = "CAST(disruption_type <> 'ON_TIME' AS INT)"

add("agg01_route_summary",
    "route_id total_stop_events:i avg_severity:f max_severity:i alert_count:i avg_delay_min:f max_delay_min:f " + PCTS,
    lambda s, d: summary.route_summary(lab(s, d)),
    f"""SELECT route_id, count(*) AS total_stop_events, avg(severity_score) AS avg_severity,
        max(severity_score) AS max_severity, sum(CAST(has_alert AS INT)) AS alert_count,
        avg(delay_min) AS avg_delay_min, max(delay_min) AS max_delay_min, {PCT_SQL} FROM lab GROUP BY route_id""")

add("agg02_srt02_hot_spots", "stop_id events:i avg_severity:f avg_delay_min:f top_disruption",
    lambda s, d: summary.hot_spots(lab(s, d), 5),
    """SELECT stop_id, count(*) AS events, avg(severity_score) AS avg_severity, avg(delay_min) AS avg_delay_min,
       (SELECT disruption_type FROM lab b WHERE b.stop_id = a.stop_id GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
       AS top_disruption FROM lab a GROUP BY stop_id ORDER BY avg_severity DESC, stop_id LIMIT 5""")

add("agg03_time_profile", "hour:i total_events:i disrupted_events:i pct_disrupted:f",
    lambda s, d: summary.time_profile(lab(s, d)),
    f"""SELECT hour(feed_timestamp) AS hour, count(*) AS total_events, sum({BAD}) AS disrupted_events,
        round_even(sum({BAD}) / count(*) * 100, 1) AS pct_disrupted FROM lab GROUP BY 1""")

add("agg04_alert_breakdown", "alert_cause alert_effect count:i",
    lambda s, d: summary.alert_breakdown(obs(s, d).withColumns({
        "alert_cause": F.concat(F.lit("CAUSE_"), (F.col("k") % 4).cast("string")),
        "alert_effect": F.concat(F.lit("EFFECT_"), (F.col("k") % 3).cast("string"))})),
    """SELECT 'CAUSE_' || (k % 4) AS alert_cause, 'EFFECT_' || (k % 3) AS alert_effect, count(*) AS count
       FROM obs WHERE has_alert GROUP BY ALL""")

add("agg05_most_delayed", "trip_id avg_delay_min:f max_delay_min:f stop_events:i disruption_type_mode",
    lambda s, d: summary.most_delayed(lab(s, d), 20),
    """SELECT trip_id, avg(delay_min) AS avg_delay_min, max(delay_min) AS max_delay_min, count(*) AS stop_events,
       (SELECT disruption_type FROM lab b WHERE b.trip_id = a.trip_id GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
       AS disruption_type_mode FROM lab a GROUP BY trip_id ORDER BY avg_delay_min DESC, trip_id LIMIT 20""")

add("agg07_disruption_density", "obs_id:i stop_disruption_count:i route_disruption_density:f",
    lambda s, d: summary.add_disruption_density(lab(s, d)),
    f"""SELECT obs_id, sum({BAD}) OVER (PARTITION BY stop_id) AS stop_disruption_count,
        nullif(avg({BAD}) OVER (PARTITION BY route_id), 0) AS route_disruption_density FROM lab""")

add("agg08_congestion", "obs_id:i stop_congestion_index:i vehicle_density:i",
    lambda s, d: summary.add_congestion(obs(s, d)),
    """SELECT obs_id, count(*) OVER (PARTITION BY stop_id, hour(feed_timestamp)) AS stop_congestion_index, n
       AS vehicle_density FROM obs JOIN (SELECT route_id, hour(feed_timestamp) AS h, count(DISTINCT vehicle_id) AS n
       FROM obs GROUP BY ALL) v USING (route_id) WHERE v.h = hour(feed_timestamp)""")

add("agg09_dwell_anomaly", "obs_id:i dwell_time_anomaly:f",
    lambda s, d: summary.add_dwell_anomaly(obs(s, d).withColumn("dwell_time_sec", F.col("k").cast("double"))),
    "SELECT obs_id, k - avg(k) OVER (PARTITION BY stop_id) AS dwell_time_anomaly FROM obs")

add("agg10_mth06_interactions", "obs_id:i delay_speed_ratio:f delay_speed_product:f speed_delay_correlation:f",
    lambda s, d: summary.add_interactions(obs(s, d)),
    """SELECT obs_id, CASE WHEN speed <> 0 THEN least(greatest(delay_sec / speed, -100), 100) END AS delay_speed_ratio,
       delay_sec * speed AS delay_speed_product, c AS speed_delay_correlation
       FROM obs JOIN (SELECT route_id, CASE WHEN count(*) > 1 THEN corr(speed, delay_sec) ELSE 0 END AS c
       FROM obs GROUP BY route_id) USING (route_id)""")

add("agg17_binned", "route_id bin delay_sec:f speed:f event_type n_rows:i",
    lambda s, d: summary.binned(obs(s, d), ["route_id"], 5, ["delay_sec", "speed"], ["event_type"]),
    """SELECT route_id, make_timestamp(feed_us - feed_us % 300000000) AS bin, avg(delay_sec) AS delay_sec,
       avg(speed) AS speed, arg_min(event_type, feed_us) AS event_type, count(*) AS n_rows FROM obs GROUP BY 1, 2""")

add("agg16_node_snapshots", "stop_id bin delay_sec:f speed:f disruption_target:i n_rows:i",
    lambda s, d: summary.binned(label.add_targets(lab(s, d)), ["stop_id"], 30, ["delay_sec", "speed"], [],
                                ["disruption_target"]),
    f"""SELECT stop_id, make_timestamp(feed_us - feed_us % 1800000000) AS bin, avg(delay_sec) AS delay_sec,
        avg(speed) AS speed, max({BAD}) AS disruption_target, count(*) AS n_rows FROM lab GROUP BY 1, 2""")

add("agg20_flt04_spatial_stats",
    "stop_id stop_lat:f stop_lon:f disruption_rate:f mean_severity:f max_severity:i own_delay:f n_events:i",
    lambda s, d: summary.spatial_stats(lab(s, d)),
    f"""SELECT stop_id, stop_lat, stop_lon, avg({BAD}) AS disruption_rate, avg(severity_score) AS mean_severity,
        max(severity_score) AS max_severity, avg(delay_sec) AS own_delay, count(*) AS n_events FROM lab
        GROUP BY 1, 2, 3 HAVING count(*) >= 3""")

add("join15_set04_hotspots_background", "stop_id score:f n_events:i part",
    lambda s, d: summary.hotspots_and_background(lab(s, d), 3),
    """SELECT stop_id, avg(severity_score) AS score, count(*) AS n_events,
       CASE WHEN row_number() OVER (ORDER BY avg(severity_score) DESC, stop_id) <= 3 THEN 'hot' ELSE 'background' END
       AS part FROM lab GROUP BY stop_id HAVING count(*) >= 5""")

add("agg21_hourly_evolution", "hour:i stop_id rate:f n:i",
    lambda s, d: summary.hourly_evolution(lab(s, d), 4),
    f"""SELECT hour(feed_timestamp) AS hour, stop_id, avg({BAD}) AS rate, count(*) AS n FROM lab
        WHERE hour(feed_timestamp) IN (SELECT arg_min(h, abs(h - t) * 100 + h) FROM (VALUES (4), (9), (13), (18)) v(t),
          (SELECT DISTINCT hour(feed_timestamp) AS h FROM lab) GROUP BY t)
        GROUP BY 1, 2 HAVING count(*) >= 2""")

add("agg22_spatiotemporal_bins", "stop_id time_bin disruption_rate:f severity:f n_events:i colour",
    lambda s, d: summary.spatiotemporal_bins(lab(s, d)),
    f"""SELECT *, CASE WHEN disruption_rate < 0.05 THEN '#1a9850' WHEN disruption_rate < 0.15 THEN '#fee08b'
        WHEN disruption_rate < 0.30 THEN '#fdae61' ELSE '#d73027' END AS colour FROM (
        SELECT stop_id, make_timestamp(feed_us - feed_us % 3600000000) AS time_bin, avg({BAD}) AS disruption_rate,
        avg(severity_score) AS severity, count(*) AS n_events FROM lab WHERE stop_id IN (
          SELECT stop_id FROM lab GROUP BY 1 HAVING count(*) >= 3 ORDER BY count(*) DESC, 1 LIMIT 5) GROUP BY 1, 2)""")

_ROLL = "count(*) AS n, sum({b}) AS active, avg(delay_min) AS avg_delay, avg({b}) AS rate".format(b=BAD)
add("agg23_dashboard_rollup", "section key n:i active:i avg_delay:f rate:f",
    lambda s, d: summary.dashboard_rollup(lab(s, d)),
    f"""SELECT 'total' AS section, '' AS key, {_ROLL} FROM lab UNION ALL
        SELECT 'label', disruption_type, {_ROLL} FROM lab GROUP BY 2 UNION ALL
        SELECT 'hour', strftime(date_trunc('hour', feed_timestamp), '%Y-%m-%d %H:%M:%S'), {_ROLL} FROM lab GROUP BY 2
        UNION ALL SELECT 'route', route_id, {_ROLL} FROM lab GROUP BY 2 UNION ALL
        SELECT 'stop', stop_id, {_ROLL} FROM lab GROUP BY 2""")

add("agg23_grid_hotspots", "grid_lat:f grid_lon:f avg_delay:f", lambda s, d: summary.grid_hotspots(lab(s, d)),
    """SELECT round_even(stop_lat * 100, 0) / 100 AS grid_lat, round_even(stop_lon * 100, 0) / 100 AS grid_lon,
       avg(delay_min) AS avg_delay FROM lab GROUP BY 1, 2""")

add("agg25_kpis", "avg_delay:f active:i on_time_pct:f confidence_pct:f normal:i",
    lambda s, d: summary.kpis(lab(s, d).withColumn("score", F.col("k") / 100)),
    f"""SELECT avg(delay_min) AS avg_delay, sum({BAD}) AS active, 100 * avg(1 - {BAD}) AS on_time_pct,
        avg(k / 100.0) * 100 AS confidence_pct, sum(1 - {BAD}) AS normal FROM lab""")

add("agg26_label_mix", "disruption_type n:i", lambda s, d: summary.label_mix(lab(s, d)),
    "SELECT disruption_type, count(*) AS n FROM lab GROUP BY 1")

add("agg26_histogram", "bucket:f n:i", lambda s, d: summary.histogram(lab(s, d), "delay_min", 5.0),
    "SELECT floor(delay_min / 5) * 5 AS bucket, count(*) AS n FROM lab GROUP BY 1")

_AUDIT = {"late_only": "CASE WHEN delay_sec > 120 THEN delay_sec END", "slow_only": "CASE WHEN speed < 50 THEN speed END",
          "cancelled_only": "CASE WHEN vehicle_status = 'CANCELED' THEN 1 END"}
add("agg26_null_audit", "feature null_pct:f",
    lambda s, d: summary.null_audit(obs(s, d).selectExpr(*[f"{v} AS {k}" for k, v in _AUDIT.items()])),
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{k}' AS feature, 100.0 * avg(CASE WHEN {v.replace('END', 'END')} IS NULL THEN 1 ELSE 0 END) AS null_pct FROM obs"
        for k, v in _AUDIT.items()) + ") WHERE null_pct > 50")

add("agg26_crosstab", "disruption_type event_type n:i",
    lambda s, d: summary.crosstab(lab(s, d), "disruption_type", "event_type"),
    "SELECT disruption_type, event_type, count(*) AS n FROM lab GROUP BY 1, 2")

add("agg27_heat_map", "hour:i R0:f R1:f R2:f R3:f",
    lambda s, d: summary.heat_map(lab(s, d), ["R0", "R1", "R2", "R3"]),
    "SELECT hour(feed_timestamp) AS hour, " + ", ".join(
        f"avg(CASE WHEN route_id = 'R{i}' THEN delay_min END) AS R{i}" for i in range(4)) + " FROM lab GROUP BY 1")

add("agg28_duration_buckets", "duration_bucket n:i is_active_sum:i is_active_mean:f is_soon_sum:i is_soon_mean:f",
    lambda s, d: summary.duration_buckets(obs(s, d).select(
        (F.col("value") / 6).alias("hours"), (F.col("k") % 2).alias("is_active"),
        (F.col("k") % 5 == 0).cast("int").alias("is_soon")), "hours", ["is_active", "is_soon"]),
    """SELECT CASE WHEN h <= 1 THEN '<1h' WHEN h <= 6 THEN '1-6h' WHEN h <= 24 THEN '6-24h' WHEN h <= 48 THEN '24-48h'
       ELSE '>48h' END AS duration_bucket, count(*) AS n, sum(a) AS is_active_sum, avg(a) AS is_active_mean,
       sum(b) AS is_soon_sum, avg(b) AS is_soon_mean FROM (SELECT value / 6 AS h, k % 2 AS a,
       CAST(k % 5 = 0 AS INT) AS b FROM obs) WHERE h > 0 GROUP BY 1""")

add("agg29_modal_values", "route_id mode_event_type mode_stop_id mean_delay_sec:f",
    lambda s, d: summary.modal_values(obs(s, d), "route_id", ["event_type", "stop_id"], "delay_sec"),
    """SELECT route_id, (SELECT event_type FROM obs b WHERE b.route_id = a.route_id GROUP BY 1
       ORDER BY count(*) DESC, 1 LIMIT 1) AS mode_event_type, (SELECT stop_id FROM obs b WHERE b.route_id = a.route_id
       GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode_stop_id, avg(delay_sec) AS mean_delay_sec
       FROM obs a GROUP BY route_id""")

_PROFILE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
add("agg30_column_profile", "feature mean:f std:f min:f max:f zeros:i nulls:i",
    lambda s, d: summary.column_profile(table(s, d, "lineitem"), list(_PROFILE)),
    " UNION ALL ".join(f"""SELECT '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
        max({c}) AS max, count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} IS NULL) AS nulls FROM lineitem"""
                       for c in _PROFILE), views="", digits=4)

add("agg30_clock_profile", "n_rows:i n_times:i duplicated:i first last",
    lambda s, d: summary.time_profile_check(table(s, d, "lineitem"), "l_shipdate"),
    """SELECT count(*) AS n_rows, count(l_shipdate) AS n_times, count(*) - count(DISTINCT l_shipdate) AS duplicated,
       min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem""", views="")

add("agg31_prediction_stats", "n:i mean_probability:f disruption_rate:f max_latency:f",
    lambda s, d: summary.prediction_stats(obs(s, d).withColumn("p", F.col("k") / 100), "p", "value"),
    """SELECT count(*) AS n, avg(k / 100.0) AS mean_probability, avg(CAST(k > 50 AS INT)) AS disruption_rate,
       max(value) AS max_latency FROM obs""")

add("agg32_latency_report", "mean_ms:f median_ms:f p95_ms:f p99_ms:f min_ms:f max_ms:f throughput_per_s:f",
    lambda s, d: summary.latency_report(table(s, d, "events"), "value"),
    """SELECT avg(value) AS mean_ms, quantile_cont(value, 0.5) AS median_ms, quantile_cont(value, 0.95) AS p95_ms,
       quantile_cont(value, 0.99) AS p99_ms, min(value) AS min_ms, max(value) AS max_ms,
       count(value) * 1000.0 / sum(value) AS throughput_per_s FROM events""", views="")

add("agg32_group_quantiles", "l_returnflag p10:f p50:f p99:f",
    lambda s, d: quantiles.quantiles(table(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice",
                                     {"p10": 0.1, "p50": 0.5, "p99": 0.99}),
    """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.1) AS p10, quantile_cont(l_extendedprice, 0.5) AS p50,
       quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY 1""", views="", digits=4)

add("agg33_interval_shift", "median_sec:f p10_sec:f p90_sec:f uniform horizon_min:f best_min:f worst_min:f",
    lambda s, d: summary.interval_shift(obs(s, d)),
    """SELECT m AS median_sec, p1 AS p10_sec, p9 AS p90_sec, abs(m - 60) < 10 AS uniform, m * 30 / 60 AS horizon_min,
       p1 * 30 / 60 AS best_min, p9 * 30 / 60 AS worst_min FROM (
       SELECT quantile_cont(g, 0.5) AS m, quantile_cont(g, 0.1) AS p1, quantile_cont(g, 0.9) AS p9 FROM (
       SELECT (feed_us - lag(feed_us) OVER (PARTITION BY vehicle_id ORDER BY feed_us, obs_id)) / 1e6 AS g FROM obs)
       WHERE g > 0)""")

add("srt01_multi_key_sort", "route_id stop_id n:i avg_delay:f",
    lambda s, d: obs(s, d).groupBy("route_id", "stop_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("delay_sec").alias("avg_delay")).orderBy(F.desc("n"), "route_id", "stop_id"),
    "SELECT route_id, stop_id, count(*) AS n, avg(delay_sec) AS avg_delay FROM obs GROUP BY ALL ORDER BY n DESC, 1, 2")
