"""Source, merge, timetable and spatial queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopwise.catalog.base import Catalog
from stopwise.functions import clock, geo
from stopwise.operators import merge, spatial, temporal, timetable
from stopwise.sources import feeds
from stopwise.testbed import views
from stopwise.testbed.views import table

CATALOG = Catalog()
add = CATALOG.add
obs, lab = views.obs, views.labelled
FEEDS = "obs feeds"


def vp(s, d):
    return feeds.vehicle_positions(views.messages(s, d))


def tu(s, d):
    return feeds.trip_updates(views.messages(s, d))


def al(s, d):
    return feeds.alerts(views.messages(s, d))


add("src06_vehicle_positions",
    "entity_id trip_id route_id direction_id:f schedule_relationship:i vehicle_id latitude:f bearing:f speed:f "
    "current_stop_sequence:f stop_id current_status:i timestamp:i congestion_level retrieved_at", vp, "SELECT * FROM vp", FEEDS)

add("src07_trip_updates",
    "entity_id trip_id route_id delay:i stop_sequence:f stop_id arrival_delay:i arrival_time:f departure_delay:i "
    "arrival_uncertainty:f retrieved_at", tu, "SELECT * FROM tu", FEEDS)

add("src08_alerts", "entity_id cause effect severity_level header_text description_text retrieved_at", al,
    "SELECT * FROM al", FEEDS)

add("src09_informed_routes", "entity_id route_id cause effect header_text",
    lambda s, d: feeds.informed_routes(al(s, d)), "SELECT * FROM ie", FEEDS)

add("arr01_active_span", "entity_id active_period_start active_period_end",
    lambda s, d: feeds.active_span(al(s, d)),
    """SELECT entity_id, make_timestamp((secs - 600) * 1000000) AS active_period_start,
       make_timestamp((secs + k * 60) * 1000000) AS active_period_end FROM al""", FEEDS)

MERGED = """
m AS (
  SELECT vp.*, tu1.delay, tu1.arrival_delay, tu1.arrival_time, al1.cause, al1.effect, al1.description_text
  FROM vp LEFT JOIN (SELECT * FROM tu WHERE trip_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trip_id
    ORDER BY retrieved_at DESC, entity_id, CAST(stop_sequence AS DOUBLE) NULLS LAST) = 1) tu1 USING (trip_id)
  LEFT JOIN (SELECT * FROM ie QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY retrieved_at DESC, entity_id) = 1) al1
    ON vp.route_id = al1.route_id)"""
add("join01_03_prj02_03_06_merge",
    "entity_id trip_id route_id stop_id feed_timestamp delay_sec:f actual_time_sec:f has_overlapping_alert alert_cause "
    "alert_effect alert_text",
    lambda s, d: merge.merge_feeds(vp(s, d), tu(s, d), al(s, d)),
    """SELECT entity_id, trip_id, route_id, stop_id, retrieved_at AS feed_timestamp, arrival_delay AS delay_sec,
       arrival_time AS actual_time_sec, cause IS NOT NULL AS has_overlapping_alert, cause AS alert_cause,
       effect AS alert_effect, description_text AS alert_text FROM m""", FEEDS, ctes=MERGED)

add("join02_merge_direct_route", "entity_id route_id alert_cause has_overlapping_alert",
    lambda s, d: merge.merge_feeds(vp(s, d), tu(s, d), feeds.informed_routes(al(s, d))),
    """SELECT entity_id, route_id, cause AS alert_cause, cause IS NOT NULL AS has_overlapping_alert FROM m""", FEEDS, ctes=MERGED)

add("set01_02_union_feeds", "entity_id trip_id stop_id speed:f origin",
    lambda s, d: merge.union_feeds(
        vp(s, d).filter(F.col("current_status") <= 1).withColumn("origin", F.lit("local")),
        vp(s, d).filter(F.col("current_status") >= 1).withColumn("origin", F.lit("live")).drop("speed")),
    """SELECT entity_id, trip_id, stop_id, CASE WHEN current_status <= 1 THEN speed END AS speed,
       CASE WHEN current_status <= 1 THEN 'local' ELSE 'live' END AS origin FROM vp""", FEEDS)

add("prj01_keys_as_text", "trip_id n:i",
    lambda s, d: merge.as_strings(table(s, d, "lineitem").withColumnRenamed("l_orderkey", "trip_id"), ["trip_id"]).groupBy(
        "trip_id").agg(F.count(F.lit(1)).alias("n")),
    "SELECT CAST(l_orderkey AS VARCHAR) AS trip_id, count(*) AS n FROM lineitem GROUP BY 1", views="")

add("join18_alert_summaries", "entity_id key4 cause effect severity_level:f disruption_target:i alert_sentiment",
    lambda s, d: merge.merge_alert_summaries(
        vp(s, d), al(s, d).withColumn("header_text", F.concat(F.lit("R"), F.substring("header_text", 7, 2)))),
    """SELECT entity_id, route_id AS key4, coalesce(mc, 'UNKNOWN') AS cause, coalesce(me, 'UNKNOWN') AS effect,
       coalesce(sev, 1) AS severity_level, CAST(coalesce(sev, 1) > 3 AS INT) AS disruption_target,
       CASE WHEN coalesce(sev, 1) > 4 THEN 'negative' WHEN coalesce(sev, 1) > 2 THEN 'neutral' ELSE 'positive' END
         AS alert_sentiment FROM vp LEFT JOIN (
       SELECT 'R' || k AS key, avg(CAST(severity_level AS DOUBLE)) AS sev,
         (SELECT cause FROM al b WHERE b.k = a.k GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mc,
         (SELECT effect FROM al b WHERE b.k = a.k GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS me
       FROM al a GROUP BY k) ON key = route_id""", FEEDS)

STAR = "trip_obs trips routes stops agency"
add("join04_star_join",
    "obs_id route_id direction_id agency_id route_short_name route_type stop_name stop_lat:f stop_lon:f agency_name",
    lambda s, d: merge.star_join(views.trip_obs(s, d), views.dims(s, d)),
    """SELECT obs_id, route_id, direction_id, agency_id, route_short_name, route_type, stop_name, stop_lat, stop_lon,
       agency_name FROM trip_obs LEFT JOIN trips USING (trip_id) LEFT JOIN routes USING (route_id)
       LEFT JOIN stops USING (stop_id) LEFT JOIN agency USING (agency_id)""", STAR)

SCHED = """sched AS (
  SELECT trip_id, stop_id, stop_sequence, arr AS sched_arr_sec, dep AS sched_dep_sec, dep - arr AS sched_dwell_sec,
    lead(dep) OVER (PARTITION BY trip_id ORDER BY stop_sequence, stop_id, dep) - dep AS sched_travel_to_next,
    stop_sequence / max(stop_sequence) OVER (PARTITION BY trip_id) AS stop_seq_ratio,
    CAST(pickup_type = '1' AS INT) AS sched_no_pickup, CAST(drop_off_type = '1' AS INT) AS sched_no_dropoff FROM stop_times),
sched1 AS (SELECT * FROM sched QUALIFY row_number() OVER (PARTITION BY trip_id, stop_id ORDER BY stop_sequence, sched_dep_sec, sched_travel_to_next NULLS FIRST) = 1)"""
add("win21_dt01_schedule",
    "trip_id stop_id stop_seq_num:i sched_arr_sec:f sched_dep_sec:f sched_dwell_sec:f sched_travel_to_next:f "
    "stop_seq_ratio:f sched_no_pickup:i sched_no_dropoff:i",
    lambda s, d: timetable.schedule(views.stop_times(s, d)),
    "SELECT *, stop_sequence AS stop_seq_num FROM sched", "stop_times", ctes=SCHED)

add("join05_dt12_mth05_schedule_join",
    "obs_id sched_arr_sec:f sched_travel_to_next:f sched_hour:f sched_is_peak:i sched_is_offpeak:i sched_is_evening:i "
    "sched_is_early_morning:i sched_deviation_sec:f relative_delay:f is_ontime_60s:i sched_adherence adherence_late:i",
    lambda s, d: timetable.schedule_deviation(timetable.join_schedule(
        views.trip_obs(s, d), timetable.schedule(views.stop_times(s, d)))),
    """SELECT *, CAST(h BETWEEN 7 AND 9 OR h BETWEEN 16 AND 19 AS INT) AS sched_is_peak, CAST(h >= 9 AND h < 16 AS INT)
       AS sched_is_offpeak, CAST(h >= 19 AS INT) AS sched_is_evening, CAST(h < 7 AS INT) AS sched_is_early_morning,
       h AS sched_hour, dev AS sched_deviation_sec, CAST(abs(dev) <= 60 AS INT) AS is_ontime_60s,
       CASE WHEN sched_travel_to_next <> 0 THEN least(greatest(delay_sec / sched_travel_to_next, -5), 5) END AS relative_delay,
       CASE WHEN dev <= -120 THEN 'very_early' WHEN dev <= -60 THEN 'early' WHEN dev <= 60 THEN 'on_time'
         WHEN dev <= 300 THEN 'late' ELSE 'very_late' END AS sched_adherence,
       CAST(dev > 60 AND dev <= 300 AS INT) AS adherence_late FROM (
       SELECT o.*, sched_arr_sec, sched_travel_to_next, least(greatest(round_even(sched_arr_sec / 3600, 0), 0), 27) AS h,
         actual_time_sec - sched_arr_sec AS dev FROM trip_obs o JOIN sched1 USING (trip_id, stop_id))""",
    "stop_times trip_obs", ctes=SCHED)

BRIDGE = """bridge AS (SELECT DISTINCT stop_id, route_id FROM stop_times JOIN trips USING (trip_id)),
sdeg AS (SELECT stop_id, count(*) AS stop_degree FROM bridge GROUP BY 1)"""
add("join06_stop_route_bridge", "stop_id route_id",
    lambda s, d: timetable.stop_route_bridge(views.stop_times(s, d), views.trips(s, d)),
    "SELECT * FROM bridge", "stop_times trips", ctes=BRIDGE)

add("agg12_degrees", "route_id route_stop_count:i route_avg_stop_degree:f route_max_stop_degree:i",
    lambda s, d: timetable.degrees(timetable.stop_route_bridge(views.stop_times(s, d), views.trips(s, d)))[1],
    """SELECT route_id, count(*) AS route_stop_count, avg(stop_degree) AS route_avg_stop_degree,
       max(stop_degree) AS route_max_stop_degree FROM bridge JOIN sdeg USING (stop_id) GROUP BY 1""", "stop_times trips", ctes=BRIDGE)

add("agg11_mth09_route_dimension",
    "route_id route_type_int:i is_bus:i is_rail:i is_tram:i is_ferry:i is_metro:i route_name_length:i "
    "route_long_name_length:i route_trip_count:i route_stop_count:i route_service_days:i",
    lambda s, d: timetable.route_dimension(views.routes(s, d), views.trips(s, d), timetable.stop_route_bridge(
        views.stop_times(s, d), views.trips(s, d)), views.calendar_dates(s, d)),
    """SELECT route_id, CAST(route_type AS INT) AS route_type_int, CAST(route_type = '3' AS INT) AS is_bus,
       CAST(route_type = '2' AS INT) AS is_rail, CAST(route_type = '0' AS INT) AS is_tram,
       CAST(route_type = '4' AS INT) AS is_ferry, CAST(route_type = '1' AS INT) AS is_metro,
       length(route_short_name) AS route_name_length, length(route_long_name) AS route_long_name_length,
       coalesce(t, 0) AS route_trip_count, coalesce(n, 0) AS route_stop_count, days AS route_service_days
       FROM routes LEFT JOIN (SELECT route_id, count(DISTINCT trip_id) AS t FROM trips GROUP BY 1) USING (route_id)
       LEFT JOIN (SELECT route_id, count(*) AS n FROM bridge GROUP BY 1) USING (route_id)
       LEFT JOIN (SELECT route_id, sum(sd) AS days FROM (SELECT DISTINCT route_id, service_id FROM trips) JOIN
         (SELECT service_id, count(DISTINCT date) AS sd FROM calendar_dates GROUP BY 1) USING (service_id) GROUP BY 1)
         USING (route_id)""", "stop_times trips routes calendar", ctes=BRIDGE)

add("agg14_set03_transfers", "stop_id transfer_connection_count:i",
    lambda s, d: timetable.transfer_counts(views.transfers(s, d)),
    """SELECT stop_id, count(*) AS transfer_connection_count FROM (SELECT from_stop_id AS stop_id FROM transfers UNION ALL
       SELECT to_stop_id FROM transfers) WHERE stop_id IS NOT NULL GROUP BY 1""", "transfers")

add("set03_transfer_stops", "stop_id", lambda s, d: timetable.transfer_stops(views.transfers(s, d)),
    """SELECT stop_id FROM (SELECT from_stop_id AS stop_id FROM transfers UNION SELECT to_stop_id FROM transfers)
       WHERE stop_id IS NOT NULL""", "transfers")

HAV = ("2 * 6371 * asin(sqrt(power(sin((radians({b}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({b})) * "
       "power(sin((radians({d}) - radians({c})) / 2), 2)))")
HUB_KM = {n: HAV.format(a="stop_lat", b=a, c="stop_lon", d=b) for n, (a, b) in geo.HUBS.items()}
ALL_HUB_KM = [HAV.format(a="stop_lat", b=a, c="stop_lon", d=b) for a, b in geo.ALL_HUBS.values()]
add("mth09_stop_dimension",
    "stop_id is_station:i has_parent_station:i has_platform:i wheelchair_accessible_stop:i lat_bin:i lon_bin:i "
    "stop_degree:i is_hub_stop:i is_transfer_stop:i transfer_connection_count:i dist_to_nearest_hub_km:f",
    lambda s, d: timetable.stop_dimension(views.stops(s, d), timetable.degrees(timetable.stop_route_bridge(
        views.stop_times(s, d), views.trips(s, d)))[0], views.transfers(s, d)),
    f"""SELECT stop_id, CAST(coalesce(location_type, '0') AS INT) AS is_station, CAST(parent_station IS NOT NULL AS INT) AS
        has_parent_station, CAST(platform_code IS NOT NULL AS INT) AS has_platform, CAST(wheelchair_boarding AS INT)
        AS wheelchair_accessible_stop, round_even(stop_lat * 10, 0) AS lat_bin, round_even(stop_lon * 10, 0) AS lon_bin,
        coalesce(g.stop_degree, 0) AS stop_degree, CAST(coalesce(g.stop_degree, 0) > 5 AS INT) AS is_hub_stop,
        CAST(n IS NOT NULL AS INT) AS is_transfer_stop, coalesce(n, 0) AS transfer_connection_count,
        round_even(least({', '.join(ALL_HUB_KM)}), 1) AS dist_to_nearest_hub_km
        FROM stops LEFT JOIN sdeg g USING (stop_id) LEFT JOIN (SELECT stop_id, count(*) AS n FROM (SELECT from_stop_id AS
        stop_id FROM transfers UNION ALL SELECT to_stop_id FROM transfers) GROUP BY 1) USING (stop_id)""",
    "stop_times trips stops transfers", ctes=BRIDGE)

add("agg13_trip_dimension",
    "trip_id trip_direction:i has_shape:i trip_wheelchair:i trip_bikes_allowed:i trip_stop_count:i trip_max_sequence:f "
    "shape_total_dist_m:f",
    lambda s, d: timetable.trip_dimension(views.trips(s, d), views.stop_times(s, d), views.shapes(s, d)),
    """SELECT trip_id, CAST(direction_id AS INT) AS trip_direction, CAST(shape_id IS NOT NULL AS INT) AS has_shape,
       CAST(wheelchair_accessible AS INT) AS trip_wheelchair, CAST(bikes_allowed AS INT) AS trip_bikes_allowed,
       n AS trip_stop_count, m AS trip_max_sequence, dist AS shape_total_dist_m FROM trips LEFT JOIN
       (SELECT trip_id, count(DISTINCT stop_id) AS n, max(stop_sequence) AS m FROM stop_times GROUP BY 1) USING (trip_id)
       LEFT JOIN (SELECT shape_id, max(shape_dist_traveled) AS dist FROM shapes GROUP BY 1) USING (shape_id)""",
    "stop_times trips shapes", digits=3)

add("join13_train_counts", "obs_id stop_load:f",
    lambda s, d: merge.train_counts(
        obs(s, d).filter(F.col("event_ts") < "2024-01-15").filter(F.col("stop_id") != "S3").withColumn("hour", F.hour("feed_timestamp")),
        obs(s, d).withColumn("hour", F.hour("feed_timestamp")), ["stop_id", "hour"]),
    """SELECT obs_id, coalesce(c, (SELECT median(c) FROM tc)) AS stop_load FROM obs LEFT JOIN tc
       ON obs.stop_id = tc.stop_id AND hour(feed_timestamp) = h""", "obs", ctes="""tc AS (
       SELECT stop_id, hour(feed_timestamp) AS h, count(*) AS c FROM obs WHERE event_ts < '2024-01-15' AND stop_id <> 'S3'
       GROUP BY ALL)""")

add("join14_in_set", "obs_id near_transfer:i",
    lambda s, d: merge.in_set(views.trip_obs(s, d), timetable.transfer_stops(views.transfers(s, d)), "stop_id", "near_transfer"),
    """SELECT obs_id, CAST(stop_id IN (SELECT from_stop_id FROM transfers UNION SELECT to_stop_id FROM transfers WHERE
       to_stop_id IS NOT NULL) AS INT) AS near_transfer FROM trip_obs""", "trip_obs transfers")

add("join16_weather_hour", "obs_id temperature:f wind_speed:f precipitation:f visibility:f weather_code:i",
    lambda s, d: merge.join_weather(obs(s, d), views.weather(s, d)),
    """SELECT obs_id, temperature, wind_speed, precipitation, visibility, weather_code FROM obs LEFT JOIN weather
       ON date_trunc('hour', feed_timestamp) = weather.timestamp""", "obs weather")

add("join17_weather_grid", "obs_id cell_lat:i cell_lon:i cell_wind:f",
    lambda s, d: merge.join_weather_grid(obs(s, d), obs(s, d).filter("stop_id <> 'S0'").groupBy(
        F.bround(F.col("stop_lat") * 10).cast("long").alias("cell_lat"), F.bround(F.col("stop_lon") * 10).cast("long").alias("cell_lon")).agg(
        F.avg("k").alias("cell_wind"))),
    """SELECT obs_id, a AS cell_lat, b AS cell_lon, w AS cell_wind FROM (SELECT *, round_even(stop_lat * 10, 0) AS a,
       round_even(stop_lon * 10, 0) AS b FROM obs) LEFT JOIN (SELECT round_even(stop_lat * 10, 0) AS a,
       round_even(stop_lon * 10, 0) AS b, avg(k) AS w FROM obs WHERE stop_id <> 'S0' GROUP BY 1, 2) USING (a, b)""")

PLACES = (("station", 52.1, 5.1), ("market", 52.4, 4.9), ("river", 51.9, 4.5), ("the", 50.9, 5.7))
_PLACE = " ".join(f"WHEN contains(lower(text), '{n}') THEN {{{i}}}" for i, (n, _, _) in enumerate(PLACES))
add("join19_locate", "doc_id:i first_loc_text first_lat:f first_lon:f",
    lambda s, d: merge.locate(table(s, d, "documents"), PLACES, "text"),
    "SELECT doc_id, CASE " + _PLACE.format(*[f"'{n}'" for n, _, _ in PLACES]) + " END AS first_loc_text, CASE "
    + _PLACE.format(*[a for _, a, _ in PLACES]) + " END AS first_lat, CASE " + _PLACE.format(*[b for _, _, b in PLACES])
    + " END AS first_lon FROM documents", views="")

NEAR = """pts AS (SELECT stop_lat, stop_lon, sum(delay_sec) AS s, count(*) AS c FROM obs GROUP BY 1, 2),
around AS (SELECT a.stop_lat, a.stop_lon, sum(b.s) AS s, sum(b.c) AS c FROM pts a JOIN pts b ON {cond} GROUP BY 1, 2)"""
add("join08_spatial_lag", "obs_id spatial_lag_delay:f", lambda s, d: spatial.spatial_lag(obs(s, d)),
    "SELECT obs_id, (s - delay_sec) / nullif(c - 1, 0) AS spatial_lag_delay FROM obs JOIN around USING (stop_lat, stop_lon)",
    ctes=NEAR.format(cond="abs(a.stop_lat - b.stop_lat) < 0.01 AND abs(a.stop_lon - b.stop_lon) < 0.01"), digits=4)

add("join09_agg20_spatial_lag_radius", "stop_id spatial_lag:f own_delay:f n_events:i",
    lambda s, d: spatial.spatial_lag_radius(obs(s, d)),
    """SELECT stop_id, avg((s - delay_sec) / nullif(c - 1, 0)) AS spatial_lag, avg(delay_sec) AS own_delay,
       count(*) AS n_events FROM obs JOIN around USING (stop_lat, stop_lon) GROUP BY 1""",
    ctes=NEAR.format(cond="sqrt(power(a.stop_lat - b.stop_lat, 2) + power(a.stop_lon - b.stop_lon, 2)) < 0.01"), digits=4)

add("join12_proximity_edges", "src dst km:f weight:f", lambda s, d: spatial.proximity_edges(views.stops(s, d), 6.0),
    f"""SELECT * , greatest(0.1, 1 - km / 6.0) AS weight FROM (SELECT a.stop_id AS src, b.stop_id AS dst,
        {HAV.format(a='a.stop_lat', b='b.stop_lat', c='a.stop_lon', d='b.stop_lon')} AS km FROM stops a JOIN stops b
        ON a.stop_id <> b.stop_id AND abs(a.stop_lat - b.stop_lat) < 0.1) WHERE km <= 6.0""", "stops")

add("mth01_02_hub_distances",
    "stop_id " + " ".join(f"dist_to_{n}_km:f" for n in geo.HUBS) + " min_dist_to_hub_km:f nearest_hub metres:f",
    lambda s, d: geo.hub_distances(views.stops(s, d)).withColumn("metres", geo.haversine_m(
        F.col("stop_lat").cast("double"), F.col("stop_lon").cast("double"), F.lit(52.0), F.lit(5.0))),
    "SELECT *, least(" + ", ".join(f"dist_to_{n}_km" for n in geo.HUBS) + ") AS min_dist_to_hub_km, CASE "
    + " ".join(f"WHEN dist_to_{n}_km = least(" + ", ".join(f"dist_to_{m}_km" for m in geo.HUBS) + f") THEN '{n}'" for n in geo.HUBS)
    + " END AS nearest_hub FROM (SELECT stop_id, " + ", ".join(f"round_even({x}, 1) AS dist_to_{n}_km" for n, x in HUB_KM.items())
    + ", 1000 * " + HAV.format(a="stop_lat", b="52.0", c="stop_lon", d="5.0") + " AS metres FROM stops)", "stops", digits=4)

add("mth03_geo_cells", "stop_id lat_bin:i lon_bin:i geo_cell is_north:i is_west:i is_randstad:i near_coast:i geo_bin_5km geo_bin_10km geo_bin_20km",
    lambda s, d: geo.scale_bins(geo.location_features(views.stops(s, d))),
    """SELECT stop_id, round_even(x * 10, 0) AS lat_bin, round_even(y * 10, 0) AS lon_bin,
       CAST(round_even(x * 10, 0) AS BIGINT) || '_' || CAST(round_even(y * 10, 0) AS BIGINT) AS geo_cell,
       CAST(x > 52.3 AS INT) AS is_north, CAST(y < 5.0 AS INT) AS is_west,
       CAST(x > 51.85 AND x < 52.55 AND y > 4.3 AND y < 5.0 AS INT) AS is_randstad, CAST(y < 4.6 OR y > 6.8 AS INT) AS near_coast, """
    + ", ".join(f"CAST(round_even(x * {100 / k}, 0) * {100 / k} AS BIGINT) || '_' || CAST(round_even(y * {100 / k}, 0) * {100 / k} AS BIGINT) AS geo_bin_{k}km"
                for k in (5, 10, 20)) + " FROM (SELECT stop_id, stop_lat AS x, stop_lon AS y FROM stops)", "stops")

_MOVED = """moved AS (SELECT obs_id, CASE WHEN k % 9 = 0 THEN 0.5 WHEN k % 13 = 0 THEN NULL ELSE stop_lat + k % 5 END AS lat,
            CASE WHEN k % 9 = 0 THEN 0.5 ELSE stop_lon END AS lon FROM obs)"""


def moved(s, d):
    k = F.col("k")
    return obs(s, d).select(
        "obs_id", F.when(k % 9 == 0, 0.5).when(k % 13 == 0, F.lit(None)).otherwise(F.col("stop_lat") + k % 5).alias("lat"),
        F.when(k % 9 == 0, 0.5).otherwise(F.col("stop_lon")).alias("lon"))


add("flt02_clean_coordinates", "obs_id:i lat:f lon:f bad_coordinates", lambda s, d: geo.clean_coordinates(moved(s, d), "lat", "lon"),
    """SELECT obs_id, bad AS bad_coordinates, CASE WHEN NOT bad THEN lat END AS lat, CASE WHEN NOT bad THEN lon END AS lon FROM (
       SELECT *, NOT coalesce(lat BETWEEN 50.75 AND 53.55 AND lon BETWEEN 3.30 AND 7.20, false) AS bad FROM moved)""", ctes=_MOVED)

add("flt02_drop_bad_coordinates", "obs_id:i lat:f lon:f", lambda s, d: geo.clean_coordinates(moved(s, d), "lat", "lon", drop=True),
    "SELECT * FROM moved WHERE lat BETWEEN 50.75 AND 53.55 AND lon BETWEEN 3.30 AND 7.20", ctes=_MOVED)

add("mth07_08_delay_speed_features",
    "obs_id:i abs_arrival_delay:f is_delayed:i delay_category speed_mps:f is_stationary:i is_stopped:i low_speed_flag:i",
    lambda s, d: timetable.speed_features(timetable.delay_features(obs(s, d))),
    """SELECT obs_id, abs(delay_sec) AS abs_arrival_delay, CAST(delay_sec > 0 AS INT) AS is_delayed,
       CASE WHEN abs(delay_sec) <= 0 THEN 'early' WHEN abs(delay_sec) <= 60 THEN 'minor' WHEN abs(delay_sec) <= 180 THEN
       'moderate' WHEN abs(delay_sec) <= 300 THEN 'major' ELSE 'severe' END AS delay_category, speed / 3.6 AS speed_mps,
       CAST(speed < 0.5 AS INT) AS is_stationary, CAST(speed < 0.1 AS INT) AS is_stopped, CAST(speed < 5 AS INT) AS
       low_speed_flag FROM obs""")

add("mth09_network_defaults", "obs_id:i stop_route_degree:i is_hub_stop:i route_type:i is_bus:i is_train:i",
    lambda s, d: timetable.network_defaults(obs(s, d)),
    """SELECT obs_id, 1 AS stop_route_degree, 0 AS is_hub_stop, 3 AS route_type, 1 AS is_bus, 0 AS is_train FROM obs""")

add("srt03_first_per_key", "user_id:i event_id:i event_type value:f",
    lambda s, d: temporal.first_per_key(table(s, d, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"],
                                        [F.col("value"), F.col("event_id")]),
    """SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id
       ORDER BY value, event_id) = 1""", views="")

add("cmp03_enrich_dimensions", "obs_id route_trip_count:i route_avg_stop_degree:f stop_degree:i is_hub_stop:i trip_stop_count:i near_transfer:i",
    lambda s, d: timetable.add_dimensions(merge.star_join(views.trip_obs(s, d), views.dims(s, d)), views.dims(s, d)),
    """SELECT obs_id, t AS route_trip_count, ra AS route_avg_stop_degree, CASE WHEN s.stop_id IS NOT NULL THEN
       coalesce(sdeg.stop_degree, 0) END AS stop_degree, CASE WHEN s.stop_id IS NOT NULL THEN CAST(coalesce(sdeg.stop_degree, 0) > 5 AS INT) END AS is_hub_stop,
       n AS trip_stop_count, CAST(x.stop_id IN (SELECT from_stop_id FROM transfers UNION SELECT to_stop_id FROM transfers
       WHERE to_stop_id IS NOT NULL) AND s.stop_id IS NOT NULL AS INT) AS near_transfer
       FROM trip_obs x LEFT JOIN trips USING (trip_id) LEFT JOIN stops s ON x.stop_id = s.stop_id LEFT JOIN sdeg ON x.stop_id = sdeg.stop_id
       LEFT JOIN (SELECT route_id, count(DISTINCT trip_id) AS t FROM trips GROUP BY 1) USING (route_id)
       LEFT JOIN (SELECT route_id, avg(stop_degree) AS ra FROM bridge JOIN sdeg USING (stop_id) GROUP BY 1) USING (route_id)
       LEFT JOIN (SELECT trip_id, count(DISTINCT stop_id) AS n FROM stop_times GROUP BY 1) USING (trip_id)""",
    "trip_obs trips stops stop_times transfers", ctes=BRIDGE)
