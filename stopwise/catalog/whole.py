"""Composite entry points and file sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stopwise.catalog.base import Catalog
from stopwise.catalog.feeds import MERGED, NEAR, PLACES, al, tu, vp
from stopwise.catalog.model import RANK, scored, split
from stopwise.catalog.temporal import GAP, W_ROUTE, W_RS, W_STOP, W_TRIP_SEQ, W_TS
from stopwise.operators import label, merge, summary
from stopwise.plans import features, modelling
from stopwise.session import checkpoint_root
from stopwise.sources import readers
from stopwise.testbed import views
from stopwise.testbed.views import table

CATALOG = Catalog()
add = CATALOG.add
obs, lab = views.obs, views.labelled


def fresh(s, name):
    return f"{checkpoint_root(s).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tree(s, d):
    """The three feeds as a tree of parquet tables, in name order."""
    root = fresh(s, "tree")
    for i, (name, make) in enumerate((("vehicle_positions", vp), ("trip_updates", tu), ("alerts", al))):
        make(s, d).write.parquet(f"{root}/day1/{i}_{name}.parquet")
    return root


def feed_counts(frames):
    out = None
    for name, df in frames.items():
        one = df.agg(F.lit(name).alias("feed"), F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("entities"))
        out = one if out is None else out.unionByName(one)
    return out


COUNTS = """SELECT 'vehicle_positions' AS feed, count(*) AS n, count(DISTINCT entity_id) AS entities FROM vp UNION ALL
  SELECT 'trip_updates', count(*), count(DISTINCT entity_id) FROM tu UNION ALL SELECT 'alerts', count(*), count(DISTINCT entity_id) FROM al"""
add("src01_feed_tree", "feed n:i entities:i", lambda s, d: feed_counts(readers.read_feed_tree(s, tree(s, d))), COUNTS, "obs feeds")
add("src03_three_feeds", "feed n:i entities:i",
    lambda s, d: feed_counts(readers.read_three_feeds(s, tree(s, d) + "/day1")), COUNTS, "obs feeds")


def spaced(s, d):
    root = fresh(s, "spaced")
    table(s, d, "events").repartitionByRange(6, "ts").write.parquet(root)
    return readers.read_parquet_files(s, root, None).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


add("src02_05_parquet_files", "n:i first last", spaced, "SELECT count(*) AS n, min(ts) AS first, max(ts) AS last FROM events", views="")


def timetable_files(s, d):
    root = fresh(s, "timetable")
    dims = views.dims(s, d)
    for name in sorted(dims):
        dims[name].write.option("header", True).csv(f"{root}/{name}.txt")
    found = readers.read_timetable(s, root)
    out = None
    for name, df in found.items():
        one = df.agg(F.lit(name).alias("file"), F.count(F.lit(1)).alias("n"), F.count(df.columns[-1]).alias("last_filled"))
        out = one if out is None else out.unionByName(one)
    return out


add("src04_timetable_files", "file n:i last_filled:i", timetable_files,
    """SELECT 'routes' AS file, count(*) AS n, count(route_type) AS last_filled FROM routes UNION ALL SELECT 'stops', count(*), count(wheelchair_boarding) FROM stops
       UNION ALL SELECT 'trips', count(*), count(bikes_allowed) FROM trips UNION ALL SELECT 'agency', count(*), count(agency_name) FROM agency
       UNION ALL SELECT 'stop_times', count(*), count(drop_off_type) FROM stop_times
       UNION ALL SELECT 'calendar_dates', count(*), count(date) FROM calendar_dates
       UNION ALL SELECT 'shapes', count(*), count(shape_dist_traveled) FROM shapes
       UNION ALL SELECT 'transfers', count(*), count(to_stop_id) FROM transfers
       UNION ALL SELECT 'calendar', 0, 0""", "routes stops trips agency stop_times calendar shapes transfers")


def sinks(s, d):
    root = fresh(s, "sinks")
    result = summary.route_summary(lab(s, d)).select("route_id", "total_stop_events")
    out = None
    for kind in ("json", "csv", "parquet"):
        readers.write_result(result, f"{root}/{kind}", kind)
        back = s.read.format(kind).option("header", True).load(f"{root}/{kind}")
        one = back.agg(F.lit(kind).alias("sink"), F.count(F.lit(1)).alias("n"), F.sum(F.col("total_stop_events").cast("long")).alias("events"))
        out = one if out is None else out.unionByName(one)
    return out


add("snk01_02_results", "sink n:i events:i", sinks, "SELECT sink, count(DISTINCT route_id) AS n, count(*) AS events FROM obs, (VALUES ('json'), ('csv'), ('parquet')) v(sink) GROUP BY 1")


def by_day(s, d):
    root = fresh(s, "days")
    readers.write_by_day(obs(s, d), root, "event_ts")
    return s.read.parquet(root).filter("service_date between '2024-01-05' and '2024-01-07'").groupBy("service_date").agg(F.count(F.lit(1)).alias("n"))


add("snk_partitioned_days", "service_date n:i", by_day,
    "SELECT CAST(event_ts AS DATE) AS service_date, count(*) AS n FROM obs WHERE CAST(event_ts AS DATE) BETWEEN '2024-01-05' AND '2024-01-07' GROUP BY 1")

BAD = "CAST(disruption_type <> 'ON_TIME' AS INT)"
add("cmp01_ingest", "entity_id trip_id delay_sec:f alert_cause",
    lambda s, d: features.ingest({"vehicle_positions": vp(s, d).filter("current_status <= 1"), "trip_updates": tu(s, d), "alerts": al(s, d)},
                                 {"vehicle_positions": vp(s, d).filter("current_status >= 1")}),
    """SELECT entity_id, trip_id, arrival_delay AS delay_sec, cause AS alert_cause FROM m""", "obs feeds",
    ctes=MERGED)

add("cmp02_build_features",
    "obs_id:i disruption_type cumulative_delay_along_route:f prev_trip_delay_at_stop:f headway_sec:f bunching_indicator:i stop_disruption_count:i spatial_lag_delay:f "
    "alert_count_last_hour:i stop_congestion_index:i rolling_mean_delay_5min:f delay_speed_product:f hour:i is_peak:i is_national_holiday:i alert_duration_min:f pagerank:f",
    lambda s, d: features.build_features(obs(s, d)),
    f"""SELECT obs_id, disruption_type, sum(delay_sec) OVER ({W_TRIP_SEQ} ROWS UNBOUNDED PRECEDING) AS cumulative_delay_along_route, coalesce(lag(delay_sec) OVER ({W_STOP}), 0) AS prev_trip_delay_at_stop,
        headway_sec, CASE WHEN headway_sec < 0.5 * avg(headway_sec) OVER (PARTITION BY route_id, stop_id) THEN 1 ELSE 0 END AS bunching_indicator,
        sum({BAD}) OVER (PARTITION BY stop_id) AS stop_disruption_count, (s - delay_sec) / nullif(c - 1, 0) AS spatial_lag_delay,
        CASE WHEN has_alert THEN coalesce(sum(CAST(has_alert AS INT)) OVER (ORDER BY feed_us RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING), 0) ELSE 0 END AS alert_count_last_hour,
        count(*) OVER (PARTITION BY stop_id, hour(feed_timestamp)) AS stop_congestion_index, avg(delay_sec) OVER ({W_ROUTE} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rolling_mean_delay_5min,
        delay_sec * speed AS delay_speed_product, hour(feed_timestamp) AS hour, CAST(hour(feed_timestamp) BETWEEN 7 AND 9 OR hour(feed_timestamp) BETWEEN 16 AND 19 AS INT) AS is_peak,
        0 AS is_national_holiday, 0.0 AS alert_duration_min, 0.0 AS pagerank FROM (SELECT *, {GAP.format(w=W_RS)} AS headway_sec FROM lab) JOIN around USING (stop_lat, stop_lon)""",
    ctes=NEAR.format(cond="abs(a.stop_lat - b.stop_lat) < 0.01 AND abs(a.stop_lon - b.stop_lon) < 0.01"), digits=4)

add("cmp04_early_warning", "obs_id:i delay_prev:f delay_rolling_mean_5:f target_30min:i target_mc_60min:i route_delay_mean:f",
    lambda s, d: features.early_warning(lab(s, d)),
    f"""SELECT obs_id, delay_prev, delay_rolling_mean_5, target_30min, target_mc_60min, avg(ld) OVER (PARTITION BY route_id, feed_us // 300000000) AS route_delay_mean FROM (
        SELECT *, CASE WHEN disruption_type = 'ON_TIME' THEN coalesce(max(nd) OVER (PARTITION BY trip_id, stop_id ORDER BY feed_us RANGE BETWEEN 1 FOLLOWING AND 1800000000 FOLLOWING), 0) ELSE 0 END AS target_30min,
        CASE WHEN disruption_type = 'ON_TIME' THEN coalesce(max(nd * code) OVER (PARTITION BY trip_id, stop_id ORDER BY feed_us RANGE BETWEEN 1 FOLLOWING AND 3600000000 FOLLOWING), 0) ELSE 0 END AS target_mc_60min FROM (
        SELECT *, lag(delay_sec) OVER ({W_TS}) AS delay_prev, avg(delay_sec) OVER ({W_TS} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS delay_rolling_mean_5, coalesce(lag(delay_sec) OVER ({W_ROUTE}), 0) AS ld,
        CAST(disruption_type <> 'ON_TIME' AND coalesce(lag(disruption_type) OVER ({W_TS}), 'ON_TIME') = 'ON_TIME' AS INT) AS nd, CASE disruption_type WHEN 'EARLY' THEN 1 WHEN 'SLOW_TRAFFIC' THEN 2
        WHEN 'SERVICE_ALERT' THEN 2 WHEN 'MINOR_DELAY' THEN 3 WHEN 'STOPPED_ON_ROUTE' THEN 3 WHEN 'MAJOR_DELAY' THEN 4 WHEN 'CANCELLED' THEN 5 ELSE 0 END AS code FROM lab))""", digits=4)

add("cmp05_family_features", "obs_id:i delay_lag_5:f delay_rolling_mean_10:f geo_cell is_last_stop:i stop_mean_delay:f delay_next_stop:f is_bus:i is_peak:i",
    lambda s, d: features.family_features(lab(s, d)),
    f"""SELECT obs_id, lag(delay_sec, 5) OVER ({W_TS}) AS delay_lag_5, avg(delay_sec) OVER (PARTITION BY trip_id ORDER BY feed_timestamp, obs_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS delay_rolling_mean_10,
        CAST(round_even(stop_lat * 10, 0) AS BIGINT) || '_' || CAST(round_even(stop_lon * 10, 0) AS BIGINT) AS geo_cell, CAST(stop_sequence = max(stop_sequence) OVER (PARTITION BY trip_id) AS INT) AS is_last_stop,
        coalesce(avg(delay_sec) OVER ({W_STOP} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS stop_mean_delay, lead(delay_sec) OVER ({W_TRIP_SEQ}) AS delay_next_stop, 1 AS is_bus,
        CAST(hour(feed_timestamp) BETWEEN 7 AND 9 OR hour(feed_timestamp) BETWEEN 16 AND 19 AS INT) AS is_peak FROM lab""", digits=4)

add("cmp03_enrich", "obs_id sched_arr_sec:f route_trip_count:i stop_degree:i delay_category actual_headway:f headway_deviation:f speed_mps:f is_ontime_60s:i",
    lambda s, d: (lambda dims: features.enrich(merge.star_join(views.trip_obs(s, d), dims), dims))(views.dims(s, d)))

add("cmp06_network_features", "obs_id:i actual_headway:f headway_mean:f network_disruption_load:f pagerank:f betweenness_centrality:f",
    lambda s, d: features.network_features(lab(s, d), obs(s, d).select("trip_id", "stop_id", "stop_sequence").groupBy("trip_id", "stop_sequence").agg(F.min("stop_id").alias("stop_id"))))

add("cmp07_weather_features", "obs_id:i temperature:f weather_wind_strong:i weather_total_impact:f weather_impact_score:f weather_code_category",
    lambda s, d: features.weather_features(obs(s, d), views.weather(s, d)),
    """SELECT obs_id, temperature, CAST(wind_speed >= 14 AS INT) AS weather_wind_strong, (CASE WHEN visibility < 200 THEN 1.0 WHEN visibility < 1000 THEN 0.5 ELSE 0 END + CASE WHEN wind_speed >= 20 THEN 1.0
       WHEN wind_speed >= 14 THEN 0.7 WHEN wind_speed >= 8 THEN 0.3 ELSE 0 END + CASE WHEN temperature <= 0 AND precipitation > 0 THEN 0.8 WHEN precipitation > 0 THEN 0.4 WHEN temperature <= 0 THEN 0.3 ELSE 0 END
       + CASE WHEN precipitation > 0 THEN 0.3 ELSE 0 END) / 4 AS weather_total_impact, least(1, 0.3 * CASE WHEN visibility < 200 THEN 1.0 WHEN visibility < 1000 THEN 0.5 ELSE 0 END + 0.4 * CASE WHEN wind_speed >= 20 THEN 1.0
       WHEN wind_speed >= 14 THEN 0.7 WHEN wind_speed >= 8 THEN 0.3 ELSE 0 END + 0.2 * CASE WHEN temperature <= 0 AND precipitation > 0 THEN 1.0 WHEN temperature <= 0 THEN 0.3 WHEN precipitation > 10 THEN 0.5
       WHEN precipitation > 0 THEN 0.2 ELSE 0 END) AS weather_impact_score, CASE WHEN weather_code = 0 THEN 'clear' WHEN weather_code <= 3 THEN 'cloudy' WHEN weather_code <= 48 THEN 'fog' WHEN weather_code <= 55 THEN 'drizzle'
       WHEN weather_code <= 66 THEN 'rain' WHEN weather_code <= 77 THEN 'snow' WHEN weather_code <= 82 THEN 'showers' ELSE 'storm' END AS weather_code_category
       FROM obs LEFT JOIN weather ON date_trunc('hour', feed_timestamp) = weather.timestamp""", "obs weather")

add("cmp07_text_features", "doc_id:i word_count:i keyword_severity:i text_sentiment:f alert_primary_category alert_language",
    lambda s, d: features.text_features(table(s, d, "documents"), "text", "lang"))

add("cmp07_place_features", "doc_id:i first_lat:f bad_coordinates has_geocoded_location:i", lambda s, d: features.place_features(table(s, d, "documents"), PLACES, "text"))

add("cmp09_adaptive_split", "split n:i disruption_rate:f", lambda s, d: modelling.adaptive_split(lab(s, d), modelling.SplitConfig(small_rows=100), "event_ts")[1],
    "SELECT split, count(*) AS n, avg(CAST(disruption_type <> 'ON_TIME' AS INT)) AS disruption_rate FROM sp GROUP BY 1", ctes=RANK)
add("cmp09_adaptive_walk_forward", "fold:i part n:i", lambda s, d: modelling.adaptive_split(lab(s, d), modelling.SplitConfig(small_days=99, min_train_days=20), "event_ts")[1],
    """SELECT fold, part, count(*) AS n FROM (SELECT *, CASE WHEN day_rank <= 20 + fold - 1 THEN 'train' WHEN day_rank = 20 + fold THEN 'test' END AS part FROM dr, nd, range(1, 100) t(fold) WHERE fold <= days - 20)
       WHERE part IS NOT NULL GROUP BY 1, 2""", ctes="dr AS (SELECT *, dense_rank() OVER (ORDER BY CAST(event_ts AS DATE)) AS day_rank FROM lab), nd AS (SELECT max(day_rank) AS days FROM dr)")

add("prj10_cmp10_select_features", "feature selected protected",
    lambda s, d: (lambda df: modelling.select_features(df, label.pick_features(df, exclude=("obs_id", "y_true", "y_pred", "y_pred2", "y2", "ord_true", "ord_pred")), "y_true", protected=("speed",)))(scored(s, d)))

add("cmp12_monitor", "kind name value:f drift",
    lambda s, d: modelling.monitor(obs(s, d).filter("event_ts < '2024-01-16'"), obs(s, d).filter("event_ts >= '2024-01-16'"), ["value", "speed"], method="psi"))

add("cmp14_diagnostics", "feature shift:f", lambda s, d: modelling.diagnostics(
    label.add_targets(split(s, d)).withColumn("p", (F.col("k") > 50).cast("int")), ["speed", "value"], "disruption_target", "p")["shift"])

add("cmp15_dashboard", "section key n:i active:i", lambda s, d: modelling.dashboard(obs(s, d)),
    f"""SELECT 'total' AS section, '' AS key, count(*) AS n, sum({BAD}) AS active FROM lab UNION ALL SELECT 'label', disruption_type, count(*), sum({BAD}) FROM lab GROUP BY 2 UNION ALL
        SELECT 'hour', strftime(date_trunc('hour', feed_timestamp), '%Y-%m-%d %H:%M:%S'), count(*), sum({BAD}) FROM lab GROUP BY 2 UNION ALL SELECT 'route', route_id, count(*), sum({BAD}) FROM lab GROUP BY 2
        UNION ALL SELECT 'stop', stop_id, count(*), sum({BAD}) FROM lab GROUP BY 2""")

add("cmp16_full_run", "tp:i fp:i fn:i tn:i accuracy:f f1:f", lambda s, d: modelling.full_run(obs(s, d), as_of=False, numTrees=5, maxDepth=4)["metrics"])
