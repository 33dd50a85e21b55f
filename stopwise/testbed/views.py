"""

``obs`` is the fused stop-event table.  The feed clock compresses the 30 raw days to 12 hours; the raw clock stays
in ``event_ts`` for day-based splits.  Every column is a projection of ``events``, so building it costs one scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_MICROS = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed stop events, one row per event."""
    return shape_obs(table(spark, sf_dir, "events"))


def shape_obs(events: DataFrame) -> DataFrame:
    """Event rows (a table or a stream) as stop events."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    feed_us = F.lit(EPOCH_MICROS) + F.floor((us - F.lit(EPOCH_MICROS)) / F.lit(60)).cast("long")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    shaped = events.select(
        "event_id", "user_id", "event_type", "value",
        F.col("ts").cast("timestamp").alias("event_ts"), feed_us.alias("feed_us"), k.alias("k"))
    return shaped.select(
        F.col("event_id").alias("obs_id"),
        "event_ts",
        F.timestamp_micros("feed_us").alias("feed_timestamp"),
        F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("trip_id"),
        F.concat(F.lit("R"), (F.col("user_id") % 25).cast("string")).alias("route_id"),
        F.concat(F.lit("V"), (F.col("user_id") % 50).cast("string")).alias("vehicle_id"),
        F.concat(F.lit("S"), (F.col("k") % 8).cast("string")).alias("stop_id"),
        (F.floor((F.col("feed_us") - F.lit(EPOCH_MICROS)) / F.lit(60_000_000)) + 1).cast("long").alias("stop_sequence"),
        (F.col("value") * 5 - 100).alias("delay_sec"),
        (F.col("k") * F.lit(0.6)).alias("speed"),
        (F.col("event_type") == "signup").alias("has_alert"),
        F.when((F.col("event_type") == "error") & (F.col("k") % 10 == 0), "CANCELED")
        .otherwise("IN_TRANSIT_TO").alias("vehicle_status"),
        (F.lit(51.0) + (F.col("k") % 8) * F.lit(0.004)).alias("stop_lat"),
        (F.lit(4.5) + (F.col("k") % 8) * F.lit(0.004)).alias("stop_lon"),
        "event_type", "k", "value",
    )


OBS_SQL = """
shaped AS (
  SELECT event_id, user_id, event_type, value, ts AS event_ts,
         1704067200000000 + (epoch_us(ts) - 1704067200000000) // 60 AS feed_us,
         CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k
  FROM events),
obs AS (
  SELECT event_id AS obs_id, event_ts, make_timestamp(feed_us) AS feed_timestamp, feed_us,
         'T' || user_id AS trip_id, 'R' || (user_id % 25) AS route_id, 'V' || (user_id % 50) AS vehicle_id,
         'S' || (k % 8) AS stop_id, (feed_us - 1704067200000000) // 60000000 + 1 AS stop_sequence,
         value * 5 - 100 AS delay_sec, k * CAST(0.6 AS DOUBLE) AS speed, event_type = 'signup' AS has_alert,
         CASE WHEN event_type = 'error' AND k % 10 = 0 THEN 'CANCELED' ELSE 'IN_TRANSIT_TO' END AS vehicle_status,
         CAST(51.0 AS DOUBLE) + (k % 8) * CAST(0.004 AS DOUBLE) AS stop_lat,
         CAST(4.5 AS DOUBLE) + (k % 8) * CAST(0.004 AS DOUBLE) AS stop_lon, event_type, k, value
  FROM shaped),
lab AS (
  SELECT *, CASE WHEN disruption_type = 'CANCELLED' THEN 10 WHEN disruption_type = 'MAJOR_DELAY' THEN 7
                 WHEN disruption_type IN ('MINOR_DELAY', 'STOPPED_ON_ROUTE') THEN 5
                 WHEN disruption_type = 'ON_TIME' THEN 0 ELSE 3 END AS severity_score
  FROM (SELECT *, delay_sec / 60.0 AS delay_min,
               CASE WHEN speed <= 2 THEN 'stopped' WHEN speed <= 10 THEN 'slow' ELSE 'normal' END AS speed_flag,
               CASE WHEN vehicle_status = 'CANCELED' THEN 'CANCELLED' WHEN delay_sec > 600 THEN 'MAJOR_DELAY'
                    WHEN speed <= 2 AND delay_sec > 120 THEN 'STOPPED_ON_ROUTE'
                    WHEN delay_sec > 120 THEN 'MINOR_DELAY' WHEN speed > 2 AND speed <= 10 THEN 'SLOW_TRAFFIC'
                    WHEN delay_sec < -60 THEN 'EARLY' WHEN has_alert THEN 'SERVICE_ALERT'
                    ELSE 'ON_TIME' END AS disruption_type
        FROM obs))
"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stopwise.operators.label import classify, flag_delay, flag_speed

    return classify(flag_speed(flag_delay(obs(spark, sf_dir))))


def stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timetable rows from ``lineitem``: trip = order, stop = part bucket, clock times derived from the line.

    The sequence number grows along the trip and is unique in it; like in real timetables it has gaps.
    """
    lines = table(spark, sf_dir, "lineitem")
    line, part, supp = F.col("l_linenumber").cast("long"), F.col("l_partkey"), F.col("l_suppkey")
    arrive = 5 * 3600 + (supp % 20) * 3600 + (line * 7 + supp % 90) * 60
    leave = arrive + F.col("l_quantity").cast("long")
    return lines.select(
        F.col("l_orderkey").cast("string").alias("trip_id"), (part % 500).cast("string").alias("stop_id"),
        ((line * 10_000_000 + part) * 100_000 + supp).alias("stop_sequence"), _clock(arrive).alias("arrival_time"),
        _clock(leave).alias("departure_time"), (part % 4).cast("string").alias("pickup_type"),
        (supp % 3).cast("string").alias("drop_off_type"))


def _clock(seconds):
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600).cast("long"),
                           F.floor(seconds / 60).cast("long") % 60, seconds.cast("long") % 60)


STOP_TIMES_SQL = """
st_secs AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS trip_id, CAST(l_partkey % 500 AS VARCHAR) AS stop_id, l_partkey AS part,
         l_suppkey AS supp, (CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey) * 100000 + l_suppkey AS stop_sequence,
         5 * 3600 + (l_suppkey % 20) * 3600 + (l_linenumber * 7 + l_suppkey % 90) * 60 AS arr,
         5 * 3600 + (l_suppkey % 20) * 3600 + (l_linenumber * 7 + l_suppkey % 90) * 60 + CAST(l_quantity AS BIGINT) AS dep
  FROM lineitem),
stop_times AS (
  SELECT trip_id, stop_id, stop_sequence,
         printf('%02d:%02d:%02d', arr // 3600, (arr // 60) % 60, arr % 60) AS arrival_time,
         printf('%02d:%02d:%02d', dep // 3600, (dep // 60) % 60, dep % 60) AS departure_time,
         CAST(part % 4 AS VARCHAR) AS pickup_type, CAST(supp % 3 AS VARCHAR) AS drop_off_type, arr, dep
  FROM st_secs)
"""


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("trip_id"), (F.col("o_custkey") % 25).cast("string").alias("route_id"),
        F.col("o_orderpriority").alias("service_id"), (F.col("o_custkey") % 2).cast("string").alias("direction_id"),
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderstatus")).alias("shape_id"),
        F.col("o_orderstatus").alias("trip_headsign"), (F.col("o_custkey") % 3).cast("string").alias("wheelchair_accessible"),
        (F.col("o_orderkey") % 3).cast("string").alias("bikes_allowed"))


TRIPS_SQL = """
trips AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS trip_id, CAST(o_custkey % 25 AS VARCHAR) AS route_id,
         o_orderpriority AS service_id, CAST(o_custkey % 2 AS VARCHAR) AS direction_id,
         CASE WHEN o_custkey % 5 <> 0 THEN o_orderstatus END AS shape_id, o_orderstatus AS trip_headsign,
         CAST(o_custkey % 3 AS VARCHAR) AS wheelchair_accessible, CAST(o_orderkey % 3 AS VARCHAR) AS bikes_allowed
  FROM orders)
"""


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").cast("string").alias("route_id"), F.col("n_regionkey").cast("string").alias("agency_id"),
        F.substring("n_name", 1, 3).alias("route_short_name"), F.col("n_name").alias("route_long_name"),
        (F.col("n_nationkey") % 6).cast("string").alias("route_type"))


ROUTES_SQL = """
routes AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS route_id, CAST(n_regionkey AS VARCHAR) AS agency_id,
         substring(n_name, 1, 3) AS route_short_name, n_name AS route_long_name,
         CAST(n_nationkey % 6 AS VARCHAR) AS route_type FROM nation)
"""


def agency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("string").alias("agency_id"), F.col("r_name").alias("agency_name"))


AGENCY_SQL = "agency AS (SELECT CAST(r_regionkey AS VARCHAR) AS agency_id, r_name AS agency_name FROM region)"


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stop per part; coordinates spread over the country box, stations are every tenth stop."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        key.cast("string").alias("stop_id"), F.col("p_name").alias("stop_name"),
        (F.lit(50.8) + (key * 37 % 271) * F.lit(0.01)).cast("string").alias("stop_lat"),
        (F.lit(3.4) + (key * 53 % 379) * F.lit(0.01)).cast("string").alias("stop_lon"),
        F.when(key % 10 == 0, "1").when(key % 7 == 0, F.lit(None)).otherwise("0").alias("location_type"),
        F.when(key % 10 != 0, (key - key % 10).cast("string")).alias("parent_station"),
        F.when(key % 4 == 0, F.lit("A")).alias("platform_code"), (key % 3).cast("string").alias("wheelchair_boarding"))


STOPS_SQL = """
stops AS (
  SELECT CAST(p_partkey AS VARCHAR) AS stop_id, p_name AS stop_name,
         CAST(50.8 AS DOUBLE) + (p_partkey * 37 % 271) * CAST(0.01 AS DOUBLE) AS stop_lat,
         CAST(3.4 AS DOUBLE) + (p_partkey * 53 % 379) * CAST(0.01 AS DOUBLE) AS stop_lon,
         CASE WHEN p_partkey % 10 = 0 THEN '1' WHEN p_partkey % 7 = 0 THEN NULL ELSE '0' END AS location_type,
         CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_partkey - p_partkey % 10 AS VARCHAR) END AS parent_station,
         CASE WHEN p_partkey % 4 = 0 THEN 'A' END AS platform_code,
         CAST(p_partkey % 3 AS VARCHAR) AS wheelchair_boarding FROM part)
"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded feed messages, one entity per event: purchases are trip updates, signups alerts, the rest vehicles."""
    o = obs(spark, sf_dir).withColumn("secs", F.unix_seconds("feed_timestamp"))
    k = F.col("k")
    text = F.lit("")
    trip = F.struct(
        F.when(k % 11 == 0, text).otherwise(F.col("trip_id")).alias("trip_id"), F.col("route_id").alias("route_id"),
        (k % 2).alias("direction_id"), F.lit("").alias("start_time"), F.lit("20240101").alias("start_date"),
        (k % 4).alias("schedule_relationship"))
    vehicle = F.struct(F.col("vehicle_id").alias("id"), F.lit("").alias("label"), F.lit("").alias("license_plate"))
    event = lambda delay, i: F.struct(  # noqa: E731 - short local shape
        delay.cast("long").alias("delay"), (F.col("secs") + i * 60).alias("time"), (k % 3).alias("uncertainty"))
    updates = F.transform(F.expr("filter(sequence(1, 3), i -> i <= k % 4)"), lambda i: F.struct(
        i.alias("stop_sequence"), F.concat(F.lit("S"), ((k + i) % 8).cast("string")).alias("stop_id"),
        F.lit(0).alias("schedule_relationship"), event(k * i - 60, i).alias("arrival"),
        event(k * i - 50, i + 1).alias("departure")))
    said = lambda c: F.array(F.struct(c.alias("text"), F.lit("nl").alias("language")),
                             F.struct(F.lit("second").alias("text"), F.lit("en").alias("language")))
    none = F.array().cast("array<struct<text:string,language:string>>")
    informed = F.array(
        F.struct(F.lit("").alias("agency_id"), F.concat(F.lit("R"), (k % 25).cast("string")).alias("route_id"),
                 F.lit(0).alias("route_type"), F.lit("").alias("trip_id"), F.lit("").alias("stop_id")),
        F.struct(F.lit("A1").alias("agency_id"), F.when(k % 2 == 0, text).otherwise(F.concat(F.lit("R"), ((k + 1) % 25).cast("string"))).alias("route_id"),
                 F.lit(3).alias("route_type"), F.lit("").alias("trip_id"), F.lit("S1").alias("stop_id")))
    is_update, is_alert = F.col("event_type") == "purchase", F.col("event_type") == "signup"
    entity = F.struct(
        F.concat(F.lit("E"), F.col("obs_id").cast("string")).alias("id"),
        F.when(~is_update & ~is_alert, F.struct(
            trip.alias("trip"), vehicle.alias("vehicle"),
            F.struct(F.col("stop_lat").alias("latitude"), F.col("stop_lon").alias("longitude"),
                     k.cast("double").alias("bearing"), F.lit(0.0).alias("odometer"), F.col("speed").alias("speed")).alias("position"),
            (k % 10).alias("current_stop_sequence"), F.col("stop_id").alias("stop_id"), (k % 3).alias("current_status"),
            F.when(k % 4 == 0, F.lit(0).cast("long")).otherwise(F.col("secs") - 5).alias("timestamp"),
            (k % 5).alias("congestion_level"), (k % 4).alias("occupancy_status"), k.alias("occupancy_percentage"),
        )).alias("vehicle"),
        F.when(is_update, F.struct(
            trip.alias("trip"), vehicle.alias("vehicle"), (F.col("secs") - 3).alias("timestamp"),
            F.when(k % 3 > 0, F.floor("value").cast("long")).alias("delay"), updates.alias("stop_time_update"),
        )).alias("trip_update"),
        F.when(is_alert, F.struct(
            (k % 14).alias("cause"), (k % 13).alias("effect"), (k % 4).alias("severity_level"),
            said(F.concat(F.lit("Alert "), k.cast("string"))).alias("header_text"),
            F.when(k % 5 == 0, none).otherwise(said(F.concat(F.lit("Text "), F.col("route_id")))).alias("description_text"),
            none.alias("url"), none.alias("tts_header_text"), none.alias("tts_description_text"),
            F.array(F.struct((F.col("secs") - 600).alias("start"), (F.col("secs") + k * 60).alias("end"))).alias("active_period"),
            informed.alias("informed_entity"),
        )).alias("alert"))
    return o.select(F.struct(F.col("secs").alias("timestamp")).alias("header"), F.col("feed_timestamp").alias("retrieved_at"),
                    F.array(entity).alias("entity"))


FEEDS_SQL = """
src AS (SELECT *, epoch_us(feed_timestamp) // 1000000 AS secs, feed_timestamp AS retrieved_at,
        CASE WHEN k % 11 = 0 THEN NULL ELSE trip_id END AS f_trip FROM obs),
vp AS (
  SELECT 'E' || obs_id AS entity_id, f_trip AS trip_id, route_id, CASE WHEN k % 2 = 1 THEN 1.0 END AS direction_id,
         k % 4 AS schedule_relationship, vehicle_id, stop_lat AS latitude, CASE WHEN k <> 0 THEN k END AS bearing,
         CASE WHEN speed <> 0 THEN speed END AS speed, CASE WHEN k % 10 <> 0 THEN k % 10 END AS current_stop_sequence,
         stop_id, k % 3 AS current_status, CASE WHEN k % 4 = 0 THEN secs ELSE secs - 5 END AS timestamp,
         CASE WHEN k % 5 <> 0 THEN CAST(k % 5 AS VARCHAR) END AS congestion_level, retrieved_at
  FROM src WHERE event_type NOT IN ('purchase', 'signup')),
tu AS (
  SELECT 'E' || obs_id AS entity_id, f_trip AS trip_id, route_id, coalesce(CASE WHEN k % 3 > 0 THEN floor(value) END, 0) AS delay,
         i AS stop_sequence, CASE WHEN i IS NOT NULL THEN 'S' || ((k + i) % 8) END AS stop_id,
         coalesce(k * i - 60, 0) AS arrival_delay, secs + i * 60 AS arrival_time, coalesce(k * i - 50, 0) AS departure_delay,
         CASE WHEN i IS NOT NULL AND k % 3 <> 0 THEN k % 3 END AS arrival_uncertainty, retrieved_at
  FROM src LEFT JOIN (VALUES (1), (2), (3)) v(i) ON i <= k % 4 WHERE event_type = 'purchase'),
al AS (
  SELECT 'E' || obs_id AS entity_id,
         coalesce(['UNKNOWN_CAUSE','OTHER_CAUSE','TECHNICAL_PROBLEM','STRIKE','DEMONSTRATION','ACCIDENT','HOLIDAY','WEATHER',
           'MAINTENANCE','CONSTRUCTION','POLICE_ACTIVITY','MEDICAL_EMERGENCY'][nullif(k % 14, 0)], 'UNKNOWN_CAUSE') AS cause,
         coalesce(['NO_SERVICE','REDUCED_SERVICE','SIGNIFICANT_DELAYS','DETOUR','ADDITIONAL_SERVICE','MODIFIED_SERVICE',
           'OTHER_EFFECT','UNKNOWN_EFFECT','STOP_MOVED','NO_EFFECT','ACCESSIBILITY_ISSUE'][nullif(k % 13, 0)], 'UNKNOWN_EFFECT') AS effect,
         CASE WHEN k % 4 <> 0 THEN CAST(k % 4 AS VARCHAR) END AS severity_level, 'Alert ' || k AS header_text,
         CASE WHEN k % 5 <> 0 THEN 'Text ' || route_id END AS description_text, secs, k, retrieved_at
  FROM src WHERE event_type = 'signup'),
ie AS (
  SELECT *, 'R' || (k % 25) AS route_id FROM al UNION ALL
  SELECT *, 'R' || ((k + 1) % 25) AS route_id FROM al WHERE k % 2 = 1)
"""


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 500).cast("string").alias("from_stop_id"),
                    F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 500).cast("string")).alias("to_stop_id"))


TRANSFERS_SQL = """
transfers AS (SELECT CAST(o_custkey % 500 AS VARCHAR) AS from_stop_id,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 500 AS VARCHAR) END AS to_stop_id FROM orders)
"""


def calendar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("service_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("date"))


CALENDAR_SQL = """
calendar_dates AS (SELECT o_orderpriority AS service_id, strftime(o_orderdate, '%Y%m%d') AS date FROM orders)
"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("shape_id"), F.col("o_totalprice").cast("string").alias("shape_dist_traveled"))


SHAPES_SQL = "shapes AS (SELECT o_orderstatus AS shape_id, o_totalprice AS shape_dist_traveled FROM orders)"


def trip_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations whose trips and stops exist in the timetable: one per order line."""
    lines = table(spark, sf_dir, "lineitem")
    oid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lines.select(
        oid.alias("obs_id"), F.col("l_orderkey").cast("string").alias("trip_id"),
        (F.col("l_partkey") % 500).cast("string").alias("stop_id"), F.col("l_shipdate").cast("timestamp").alias("feed_timestamp"),
        (F.col("l_quantity") * 20 - 100).alias("delay_sec"), (F.col("l_suppkey") % 60).cast("double").alias("speed"),
        (F.lit(18000.0) + F.col("l_suppkey") % 20 * 3600 + F.col("l_quantity") * 100).alias("actual_time_sec"))


TRIP_OBS_SQL = """
trip_obs AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS obs_id, CAST(l_orderkey AS VARCHAR) AS trip_id,
         CAST(l_partkey % 500 AS VARCHAR) AS stop_id, l_shipdate AS feed_timestamp, l_quantity * 20 - 100 AS delay_sec,
         CAST(l_suppkey % 60 AS DOUBLE) AS speed, 18000.0 + l_suppkey % 20 * 3600 + l_quantity * 100 AS actual_time_sec FROM lineitem)
"""


def dims(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"trips": trips(spark, sf_dir), "routes": routes(spark, sf_dir), "stops": stops(spark, sf_dir),
            "agency": agency(spark, sf_dir), "stop_times": stop_times(spark, sf_dir), "transfers": transfers(spark, sf_dir),
            "calendar_dates": calendar_dates(spark, sf_dir), "shapes": shapes(spark, sf_dir)}


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather made from the events of each feed hour."""
    o = obs(spark, sf_dir)
    return o.groupBy(F.date_trunc("hour", "feed_timestamp").alias("timestamp")).agg(
        (F.min("k") - 3 + F.max("k") % 7).cast("double").alias("temperature"),
        (F.count(F.lit(1)) % 25).cast("double").alias("wind_speed"), (F.count(F.lit(1)) % 13).cast("double").alias("precipitation"),
        (F.count(F.lit(1)) * 7 % 1500).cast("double").alias("visibility"), (F.count(F.lit(1)) % 100).cast("int").alias("weather_code"))


WEATHER_SQL = """
weather AS (
  SELECT date_trunc('hour', feed_timestamp) AS timestamp, min(k) - 3 + max(k) % 7 AS temperature, count(*) % 25 AS wind_speed,
         count(*) % 13 AS precipitation, count(*) * 7 % 1500 AS visibility, count(*) % 100 AS weather_code FROM obs GROUP BY 1)
"""
