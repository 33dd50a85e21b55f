"""Calendar, text, weather and alert function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopwise.catalog.base import Catalog
from stopwise.functions import alerts, bins, clock, text, weather
from stopwise.operators import label
from stopwise.sources.feeds import code_name, CAUSES, EFFECTS
from stopwise.testbed import views
from stopwise.testbed.views import table

CATALOG = Catalog()
add = CATALOG.add
obs, lab = views.obs, views.labelled


def docs(s, d):
    return table(s, d, "documents")


def orders(s, d):
    """Order clocks moved into the holiday years, with a time of day."""
    return table(s, d, "orders").select("o_orderkey", F.timestamp_micros(
        F.lit(1_735_689_600_000_000) + (F.col("o_orderkey") * 7919 % 730).cast("long") * 86_400_000_000
        + (F.col("o_orderkey") * 104_729 % 86_400).cast("long") * 1_000_000).alias("t"))


ORDERS = """o AS (SELECT o_orderkey, make_timestamp(1735689600000000 + (o_orderkey * 7919 % 730) * 86400000000
  + (o_orderkey * 104729 % 86400) * 1000000) AS t FROM orders)"""

add("dt01_clock_seconds", "o_orderkey:i seconds:f",
    lambda s, d: table(s, d, "orders").select("o_orderkey", clock.clock_seconds(
        F.when(F.col("o_orderkey") % 7 == 0, "bad:clock").when(F.col("o_orderkey") % 7 == 1, F.col("o_custkey").cast("string"))
        .otherwise(F.format_string("%02d:%02d:%02d", F.col("o_custkey") % 30, F.col("o_orderkey") % 60, F.col("o_custkey") % 60))).alias("seconds")),
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN o_custkey
       ELSE (o_custkey % 30) * 3600 + (o_orderkey % 60) * 60 + o_custkey % 60 END AS seconds FROM orders""", views="")

add("dt02_04_calendar",
    "o_orderkey:i hour:i day_of_week:i day_name date month:i week_of_year:i day_of_month:i hour_sin:f hour_cos:f dow_sin:f "
    "month_cos:f week_sin:f is_peak:i is_offpeak:i is_night:i is_early_morning:i is_late_evening:i is_weekend:i is_rush_hour:i",
    lambda s, d: clock.time_buckets(clock.cyclic_features(clock.calendar_parts(orders(s, d), "t"))),
    """SELECT *, sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos, sin(2 * pi() * day_of_week / 7) AS dow_sin,
       cos(2 * pi() * (month - 1) / 12) AS month_cos, sin(2 * pi() * week_of_year / 52) AS week_sin,
       CAST(pk AS INT) AS is_peak, CAST(hour BETWEEN 10 AND 15 AS INT) AS is_offpeak, CAST(hour >= 22 OR hour <= 5 AS INT) AS is_night,
       CAST(hour IN (5, 6) AS INT) AS is_early_morning, CAST(hour IN (20, 21) AS INT) AS is_late_evening,
       CAST(day_of_week >= 5 AS INT) AS is_weekend, CAST(pk AND day_of_week < 5 AS INT) AS is_rush_hour FROM (
       SELECT o_orderkey, hour(t) AS hour, isodow(t) - 1 AS day_of_week, dayname(t) AS day_name, CAST(t AS DATE) AS date,
       month(t) AS month, weekofyear(t) AS week_of_year, day(t) AS day_of_month,
       hour(t) BETWEEN 7 AND 9 OR hour(t) BETWEEN 16 AND 19 AS pk FROM o)""", views="", ctes=ORDERS)

add("dt05_enricher_time", "o_orderkey:i is_peak_hour_wide:i is_peak_narrow:i timestamp_min timestamp_hour id_time id_date",
    lambda s, d: clock.enricher_time(orders(s, d), "t"),
    """SELECT o_orderkey, CAST(hour(t) IN (7, 8, 9, 17, 18, 19) AS INT) AS is_peak_hour_wide, CAST(hour(t) IN (8, 17, 18) AS INT)
       AS is_peak_narrow, date_trunc('minute', t) AS timestamp_min, date_trunc('hour', t) AS timestamp_hour,
       strftime(t, '%H:%M:%S') AS id_time, CAST(t AS DATE) AS id_date FROM o""", views="", ctes=ORDERS)

_HOL = ", ".join(f"DATE '{d}'" for d in clock.HOLIDAYS)
_SCH = " OR ".join(f"d BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in clock.SCHOOL_HOLIDAYS)
add("dt06_holidays", "o_orderkey:i is_national_holiday:i is_school_holiday:i is_school_day:i is_holiday_period:i",
    lambda s, d: clock.holiday_features(orders(s, d), "t"),
    f"""SELECT o_orderkey, CAST(h AS INT) AS is_national_holiday, CAST(sc AS INT) AS is_school_holiday,
        CAST(isodow(d) <= 5 AND NOT sc AS INT) AS is_school_day, CAST(h OR sc AS INT) AS is_holiday_period FROM (
        SELECT *, d IN ({_HOL}) AS h, {_SCH} AS sc FROM (SELECT o_orderkey, CAST(t AS DATE) AS d FROM o))""", views="", ctes=ORDERS)

TF = f"""tf AS (SELECT *, CASE WHEN off THEN NULL WHEN s BETWEEN 21600 AND 32400 OR s BETWEEN 57600 AND 68400 THEN 0
  WHEN s < 21600 THEN (21600 - s) / 60 WHEN s < 57600 THEN (57600 - s) / 60 ELSE (108000 - s) / 60 END AS m FROM (
  SELECT o_orderkey, t, (epoch_us(t) % 86400000000) / 1e6 AS s, isodow(t) >= 6 OR CAST(t AS DATE) IN ({_HOL}) AS off,
  isodow(t) >= 6 AS we, CAST(t AS DATE) IN ({_HOL}) AS hol FROM o))"""
add("dt07_08_time_features",
    "o_orderkey:i days_since_start:i is_weekend:i is_holiday:i time_to_rush_hour_peak:f time_to_peak_bucket is_peak_hour:i",
    lambda s, d: clock.time_features(orders(s, d), "t"),
    """SELECT o_orderkey, (epoch_us(t) - (SELECT min(epoch_us(t)) FROM o)) // 86400000000 AS days_since_start,
       CAST(we AS INT) AS is_weekend, CAST(hol AS INT) AS is_holiday, m AS time_to_rush_hour_peak,
       CASE WHEN off THEN 'off_day' WHEN m <= 0 THEN 'in_peak' WHEN m <= 30 THEN 'under_30min' WHEN m <= 60 THEN '30_to_60min'
       WHEN m <= 180 THEN '1_to_3hrs' ELSE 'off_peak' END AS time_to_peak_bucket, CAST(coalesce(m = 0, false) AS INT) AS is_peak_hour
       FROM tf""", views="", ctes=ORDERS + ",\n" + TF)

add("agg24_time_shares", "peak_percentage:f weekend_percentage:f holiday_percentage:f",
    lambda s, d: clock.time_shares(clock.time_features(orders(s, d), "t")),
    """SELECT round_even(avg(CAST(coalesce(m = 0, false) AS INT)) * 100, 1) AS peak_percentage, round_even(avg(CAST(we AS INT)) * 100, 1)
       AS weekend_percentage, round_even(avg(CAST(hol AS INT)) * 100, 1) AS holiday_percentage FROM tf""", views="", ctes=ORDERS + ",\n" + TF)

add("dt09_to_utc", "o_orderkey:i utc",
    lambda s, d: orders(s, d).select("o_orderkey", F.to_utc_timestamp("t", "Europe/Amsterdam").alias("utc")), None)


def alert_rows(s, d):
    k = F.col("k")
    return obs(s, d).withColumns({
        "active_period_start": F.timestamp_micros(F.unix_micros("feed_timestamp") - (k * 97 % 130).cast("long") * 60_000_000),
        "active_period_end": F.when(k % 10 != 0, F.timestamp_micros(F.unix_micros("feed_timestamp") + (k * 31 % 150 - 40).cast("long") * 60_000_000))})


ALERTS = """ar AS (SELECT *, feed_us - (k * 97 % 130) * 60000000::BIGINT AS s, CASE WHEN k % 10 <> 0 THEN feed_us + (k * 31 % 150 - 40) * 60000000::BIGINT END AS e FROM obs)"""
add("dt10_11_alert_timing",
    "obs_id:i alert_duration_seconds:f alert_duration_hours:f alert_duration_days:f alert_remaining_hours:f alert_is_expired:i "
    "alert_is_imminent:i alert_expiring_soon:i alert_age_minutes:f alert_is_new:i alert_is_aging:i alert_is_active:i "
    "alert_duration_min:f duration_category",
    lambda s, d: clock.alert_timing(alert_rows(s, d)),
    """SELECT obs_id, (e - s) / 1e6 AS alert_duration_seconds, (e - s) / 3.6e9 AS alert_duration_hours, (e - s) / 8.64e10 AS alert_duration_days,
       r / 3600 AS alert_remaining_hours, CAST(coalesce(r <= 0, false) AS INT) AS alert_is_expired,
       CAST(coalesce(r > 0 AND r <= 3600, false) AS INT) AS alert_is_imminent, CAST(coalesce(r > 0 AND r <= 1800, false) AS INT)
       AS alert_expiring_soon, a / 60 AS alert_age_minutes, CAST(a / 60 <= 15 AS INT) AS alert_is_new, CAST(a / 3600 > 1 AS INT) AS alert_is_aging,
       CAST(coalesce(a >= 0 AND r > 0, false) AS INT) AS alert_is_active, coalesce((e - s) / 6e7, 0) AS alert_duration_min,
       CASE WHEN coalesce((e - s) / 6e7, 0) <= -1 THEN NULL WHEN coalesce((e - s) / 6e7, 0) <= 30 THEN 'short'
         WHEN (e - s) / 6e7 <= 120 THEN 'medium' WHEN (e - s) / 6e7 <= 480 THEN 'long' ELSE 'extended' END AS duration_category
       FROM (SELECT *, (e - feed_us) / 1e6 AS r, (feed_us - s) / 1e6 AS a FROM ar)""", ctes=ALERTS)

_AT = "2024-01-01 06:00:00"
add("flt03_known_at", "obs_id:i known_at_prediction known_end",
    lambda s, d: alerts.known_at(alert_rows(s, d), F.lit(_AT).cast("timestamp")),
    f"""SELECT obs_id, make_timestamp(s) <= TIMESTAMP '{_AT}' AS known_at_prediction, CASE WHEN make_timestamp(s) <= TIMESTAMP '{_AT}'
        THEN least(make_timestamp(e), TIMESTAMP '{_AT}') END AS known_end FROM ar""", ctes=ALERTS)

add("dt13_mth11_weather_placeholder",
    "obs_id:i weather_is_winter:i weather_is_summer:i weather_rush_hour:i weather_weekend:i weather_temp:f weather_visibility:i weather_total_impact:f",
    lambda s, d: weather.placeholder(obs(s, d), "event_ts"),
    """SELECT obs_id, CAST(month(event_ts) IN (12, 1, 2, 3) AS INT) AS weather_is_winter, CAST(month(event_ts) IN (6, 7, 8) AS INT)
       AS weather_is_summer, CAST(hour(event_ts) BETWEEN 7 AND 9 OR hour(event_ts) BETWEEN 16 AND 19 AS INT) AS weather_rush_hour,
       CAST(isodow(event_ts) >= 6 AS INT) AS weather_weekend, 10.0 AS weather_temp, 10000 AS weather_visibility, 0.0 AS weather_total_impact FROM obs""")


def sky(s, d):
    """Weather readings spread over all thresholds."""
    k = F.col("k")
    return obs(s, d).withColumns({
        "temperature": (k - 20).cast("double"), "wind_speed": (k % 25).cast("double"), "precipitation": (k % 13 - 1).cast("double"),
        "visibility": F.when(k % 17 != 0, (k * 23 % 1500).cast("double")), "weather_code": k,
        "mode": F.element_at(F.array(*[F.lit(m) for m in ("bus", "tram", "metro", "train", "boat")]), k % 5 + 1)})


SKY = """sky AS (SELECT obs_id, k, k - 20 AS t, k % 25 AS w, k % 13 - 1 AS p, coalesce(CASE WHEN k % 17 <> 0 THEN k * 23 % 1500 END, 10000) AS v,
  ['bus', 'tram', 'metro', 'train', 'bus'][k % 5 + 1] AS mode FROM obs)"""
_I = lambda c: f"CAST({c} AS INT)"
add("mth11_weather_thresholds",
    "obs_id:i weather_temp_cold:i weather_temp_hot:i weather_wind_gale:i weather_wind_strong:i weather_rain_heavy:i weather_rain_moderate:i "
    "weather_visibility_low:i weather_visibility_poor:i weather_total_impact:f weather_is_disrupting:i",
    lambda s, d: weather.impacts(weather.threshold_flags(sky(s, d))),
    f"""SELECT *, {_I('weather_total_impact > 0.5')} AS weather_is_disrupting FROM (
        SELECT obs_id, {_I('t < 0')} AS weather_temp_cold, {_I('t > 30')} AS weather_temp_hot, {_I('w >= 20')} AS weather_wind_gale,
        {_I('w >= 14')} AS weather_wind_strong, {_I('p >= 10')} AS weather_rain_heavy, {_I('p >= 4')} AS weather_rain_moderate,
        {_I('v < 200')} AS weather_visibility_low, {_I('v < 1000')} AS weather_visibility_poor,
        (CASE WHEN v < 200 THEN 1.0 WHEN v < 1000 THEN 0.5 ELSE 0 END + CASE WHEN w >= 20 THEN 1.0 WHEN w >= 14 THEN 0.7 WHEN w >= 8 THEN 0.3 ELSE 0 END
        + CASE WHEN t <= 0 AND p > 0 THEN 0.8 WHEN p > 0 THEN 0.4 WHEN t <= 0 THEN 0.3 ELSE 0 END + CASE WHEN p > 0 THEN 0.3 ELSE 0 END) / 4
        AS weather_total_impact FROM sky)""", ctes=SKY)

_WT = lambda part: "CASE mode " + " ".join(f"WHEN '{m}' THEN {w[part]}" for m, w in weather.MODE_WEIGHTS.items()) + " END"
add("mth12_mode_score", "obs_id:i weather_impact_score:f",
    lambda s, d: weather.mode_score(sky(s, d), F.col("mode")),
    f"""SELECT obs_id, least(1.0, {_WT('visibility')} * CASE WHEN v < 200 THEN 1.0 WHEN v < 1000 THEN 0.5 ELSE 0 END
        + {_WT('speed')} * CASE WHEN w >= 20 THEN 1.0 WHEN w >= 14 THEN 0.7 WHEN w >= 8 THEN 0.3 ELSE 0 END
        + {_WT('reliability')} * CASE WHEN t <= 0 AND p > 0 THEN 1.0 WHEN t <= 0 THEN 0.3 WHEN p > 10 THEN 0.5 WHEN p > 0 THEN 0.2 ELSE 0 END)
        AS weather_impact_score FROM sky""", ctes=SKY)

add("mth13_weather_codes", "obs_id:i weather_disruption_risk:f weather_is_disrupting_code:i weather_code_category",
    lambda s, d: weather.code_features(sky(s, d)),
    "SELECT obs_id, risk AS weather_disruption_risk, CAST(risk > 0.4 AS INT) AS weather_is_disrupting_code, CASE WHEN k = 0 THEN 'clear' "
    "WHEN k <= 3 THEN 'cloudy' WHEN k <= 48 THEN 'fog' WHEN k <= 55 THEN 'drizzle' WHEN k <= 66 THEN 'rain' WHEN k <= 77 THEN 'snow' "
    "WHEN k <= 82 THEN 'showers' ELSE 'storm' END AS weather_code_category FROM (SELECT obs_id, k, CASE k "
    + " ".join(f"WHEN {c} THEN {r}" for c, r in weather.CODE_RISK.items()) + " ELSE 0 END AS risk FROM sky)", ctes=SKY)

add("mth14_additive_score", "obs_id:i impact_score:f",
    lambda s, d: weather.additive_score(sky(s, d).withColumns({
        "rain_1h": F.col("k") % 7, "snow_1h": F.col("k") % 3 * 0.3, "visibility_m": F.col("k") * 71 % 9000, "weather_id": 200 + F.col("k") * 7})),
    """SELECT obs_id, least(1.0, CASE WHEN k % 7 + k % 3 * 0.3 > 5 THEN 0.4 WHEN k % 7 + k % 3 * 0.3 > 0.5 THEN 0.2 ELSE 0 END
       + CASE WHEN k * 71 % 9000 < 1000 THEN 0.3 WHEN k * 71 % 9000 < 5000 THEN 0.15 ELSE 0 END + CASE WHEN 200 + k * 7 BETWEEN 200 AND 299 THEN 0.3
       WHEN 200 + k * 7 BETWEEN 500 AND 599 THEN 0.2 WHEN 200 + k * 7 BETWEEN 600 AND 699 THEN 0.3 WHEN 200 + k * 7 BETWEEN 700 AND 799 THEN 0.2 ELSE 0 END
       + CASE WHEN w > 15 THEN 0.1 ELSE 0 END) AS impact_score FROM sky""", ctes=SKY)

add("mth10_cause_effect_codes", "obs_id:i cause_id:i effect_id:i alert_severity_composite:i",
    lambda s, d: alerts.cause_effect_codes(obs(s, d).withColumns({
        "cause": code_name(F.col("k") % 14, CAUSES, "OTHER"), "effect": code_name(F.col("k") % 13, EFFECTS, "OTHER")})),
    """SELECT obs_id, c AS cause_id, e AS effect_id, abs(c) + abs(e) AS alert_severity_composite FROM (SELECT obs_id,
       CASE WHEN k % 14 BETWEEN 1 AND 12 THEN k % 14 - 1 ELSE -1 END AS c, CASE WHEN k % 13 BETWEEN 1 AND 9 THEN k % 13 - 1 ELSE -1 END AS e FROM obs)""")

add("mth15_risk_label", "obs_id:i risk_level disruption_class",
    lambda s, d: label.with_risk(lab(s, d).withColumn("disruption_target", (F.col("disruption_type") != "ON_TIME").cast("int"))),
    "SELECT obs_id, CASE WHEN disruption_type <> 'ON_TIME' THEN 'high' ELSE 'low' END AS risk_level, 'unknown' AS disruption_class FROM lab")

add("mth16_flt06_prediction_alerts", "obs_id:i severity_class:i severity_label message",
    lambda s, d: alerts.prediction_alerts(obs(s, d).withColumns({"bunching_index": F.col("k") / 100, "confidence": F.col("value") / 500})),
    """SELECT obs_id, c AS severity_class, ['Normal', 'Minor', 'Moderate', 'Severe'][c + 1] AS severity_label, 'Disruption detected on ' || route_id
       || ' — ' || ['Normal', 'Minor', 'Moderate', 'Severe'][c + 1] || ' severity' AS message FROM (SELECT *, CASE WHEN k / 100 < 0.3 THEN 0
       WHEN k / 100 < 0.6 THEN 1 WHEN k / 100 < 0.8 THEN 2 ELSE 3 END AS c FROM obs) WHERE c > 0""")

add("mth17_prediction_severity", "obs_id:i severity is_disrupted",
    lambda s, d: alerts.prediction_severity(obs(s, d).withColumn("disruption_probability", F.col("k") / 100)),
    """SELECT obs_id, CASE WHEN k / 100 > 0.7 THEN 'high' WHEN k / 100 > 0.3 THEN 'medium' ELSE 'low' END AS severity, k / 100 > 0.5 AS is_disrupted FROM obs""")


def escalated(s, d):
    k = F.col("k")
    return alerts.escalate(obs(s, d).withColumns({
        "severity_class": k % 4, "confidence": (k * 37 % 100).cast("double"), "delay_minutes": F.col("delay_sec") / 60,
        "bunching_index": (k * 13 % 100) / 100, "evaluated_at": F.col("feed_timestamp"), "alert_id": F.col("obs_id")}))


ESC = """esc AS (SELECT *, CASE WHEN conf < 60 AND base = 'MODERATE' THEN 'MAJOR' ELSE base END AS tier, conf < 60 OR base IN ('CRITICAL', 'MAJOR')
  AS requires_human_review, CASE base WHEN 'CRITICAL' THEN 5 WHEN 'MAJOR' THEN 15 WHEN 'MODERATE' THEN 30 ELSE 120 END AS deadline FROM (
  SELECT *, k % 4 AS sev, k * 37 % 100 AS conf, CASE WHEN k % 4 >= 3 THEN 'CRITICAL' WHEN delay_sec / 60 >= 15 THEN 'MAJOR'
  WHEN delay_sec / 60 >= 5 OR (k * 13 % 100) / 100 >= 0.8 THEN 'MODERATE' ELSE 'MINOR' END AS base FROM obs))"""
add("mth18_escalation", "obs_id:i tier requires_human_review auto_publish response_deadline_minutes:i requires_acknowledgement escalation_if_unacked_min:i",
    escalated,
    """SELECT obs_id, tier, requires_human_review, NOT requires_human_review AND conf >= 85 AS auto_publish, deadline AS response_deadline_minutes,
       base IN ('CRITICAL', 'MAJOR') AS requires_acknowledgement, CASE base WHEN 'CRITICAL' THEN 10 WHEN 'MAJOR' THEN 30 END AS escalation_if_unacked_min
       FROM esc""", ctes=ESC)

add("flt05_active_alerts", "obs_id:i tier status",
    lambda s, d: alerts.active_alerts(escalated(s, d).withColumn("status", F.when(F.col("k") % 3 == 0, "RESOLVED").otherwise("NEW")), ("CRITICAL", "MAJOR")),
    "SELECT obs_id, tier, 'NEW' AS status FROM esc WHERE k % 3 <> 0 AND tier IN ('CRITICAL', 'MAJOR')", ctes=ESC)


def history(s, d):
    """Acknowledge and resolve events of some alerts."""
    o = obs(s, d)
    later = lambda m: F.timestamp_micros(F.unix_micros("feed_timestamp") + m * 60_000_000)
    ack = o.filter("k % 3 = 0").select(F.col("obs_id").alias("alert_id"), later(3).alias("event_at"), F.lit("ACKNOWLEDGED").alias("event"))
    done = o.filter("k % 6 = 0").select(F.col("obs_id").alias("alert_id"), later(9).alias("event_at"), F.lit("RESOLVED").alias("event"))
    return ack.unionByName(done)


def cycle(s, d):
    return alerts.lifecycle(escalated(s, d).drop("status"), history(s, d), F.lit("2024-01-01 06:00:00").cast("timestamp"))


CYCLE = ESC + """, cyc AS (SELECT *, CASE WHEN k % 6 = 0 THEN 'RESOLVED' WHEN k % 3 = 0 THEN 'ACKNOWLEDGED' ELSE 'NEW' END AS status,
  k % 3 <> 0 AND epoch_us(TIMESTAMP '2024-01-01 06:00:00') > feed_us + deadline * 60000000::BIGINT AS overdue FROM esc)"""
add("str10_alert_lifecycle", "alert_id:i status overdue", cycle, "SELECT obs_id AS alert_id, status, overdue FROM cyc", ctes=CYCLE)

add("cmp13_escalation_summary", "active:i critical:i pending_ack:i overdue:i", lambda s, d: alerts.escalation_summary(cycle(s, d)),
    """SELECT sum(CAST(status <> 'RESOLVED' AS INT)) AS active, sum(CAST(status <> 'RESOLVED' AND tier = 'CRITICAL' AS INT)) AS critical,
       sum(CAST(status = 'NEW' AND base IN ('CRITICAL', 'MAJOR') AS INT)) AS pending_ack, sum(CAST(overdue AS INT)) AS overdue FROM cyc""", ctes=CYCLE)

add("mth19_txt11_delay_alerts", "obs_id:i severity message delay_category",
    lambda s, d: alerts.delay_alerts(alerts.ui_categories(lab(s, d))),
    """SELECT obs_id, CASE WHEN delay_min > 30 THEN 'CRITICAL' ELSE 'MAJOR' END AS severity, CASE WHEN delay_min > 30 THEN 'Severe' ELSE 'Major' END
       || ' delay on route ' || route_id || ': ' || printf('%.1f', delay_min) || 'min' AS message, CASE WHEN delay_min > 30 THEN 'severe' ELSE 'major' END
       AS delay_category FROM lab WHERE delay_min > 15 AND delay_min <= 1000""")

add("mth04_ui_categories", "obs_id:i speed_category delay_category",
    lambda s, d: alerts.ui_categories(lab(s, d)),
    """SELECT obs_id, CASE WHEN speed > 0 AND speed <= 10 THEN 'stopped' WHEN speed > 10 AND speed <= 25 THEN 'slow' WHEN speed > 25 AND speed <= 50 THEN
       'normal' WHEN speed > 50 AND speed <= 100 THEN 'fast' END AS speed_category, CASE WHEN delay_min > 0 AND delay_min <= 5 THEN 'on_time'
       WHEN delay_min > 5 AND delay_min <= 15 THEN 'minor' WHEN delay_min > 15 AND delay_min <= 30 THEN 'major' WHEN delay_min > 30 AND delay_min <= 1000
       THEN 'severe' END AS delay_category FROM lab""")

add("mth20_risk_level", "obs_id:i risk_score:f risk_level",
    lambda s, d: alerts.risk_level(obs(s, d).withColumn("risk_score", F.col("value") / 500)),
    """SELECT obs_id, r AS risk_score, CASE WHEN r <= 0.25 THEN 'low' WHEN r <= 0.5 THEN 'moderate' WHEN r <= 0.75 THEN 'high' WHEN r <= 1.01 THEN 'critical'
       END AS risk_level FROM (SELECT obs_id, round_even(value / 500, 4) AS r FROM obs)""")

add("flt01_ui_filter", "obs_id:i route_id delay_min:f",
    lambda s, d: alerts.ui_filter(lab(s, d), ("R1", "R2", "R3"), (0.0, 5.0)),
    "SELECT obs_id, route_id, delay_min FROM lab WHERE route_id IN ('R1', 'R2', 'R3') AND delay_min BETWEEN 0 AND 5")

W = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"
RX = lambda p: f"len(regexp_extract_all(text, '{p}'))"
add("txt01_complexity",
    "doc_id:i text_length:i word_count:i avg_word_length:f sentence_count:i avg_sentence_length:f upper_ratio:f has_emphasis:i number_count:i "
    "has_time_ref:i has_location_ref:i",
    lambda s, d: text.complexity(docs(s, d), "text"),
    f"""SELECT doc_id, n AS text_length, w AS word_count, round_even(n / (w + 1), 2) AS avg_word_length, sc AS sentence_count,
        round_even(w / (sc + 1), 2) AS avg_sentence_length, round_even({RX('[A-Z]')} / (n + 1), 3) AS upper_ratio,
        CAST(regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])[A-Z]{{2,}}($|[^\\p{{L}}\\p{{N}}_])') AS INT) AS has_emphasis, {RX('[0-9]')} AS number_count,
        CAST(regexp_matches(text, '(?i)[0-9]{{1,2}}:[0-9]{{2}}|am|pm|uur') AS INT) AS has_time_ref,
        CAST(regexp_matches(text, '(?i)station|stop|halte|plein|straat') AS INT) AS has_location_ref
        FROM (SELECT *, length(text) AS n, {W} AS w, {RX('[.!?]')} + 1 AS sc FROM documents)""", views="", digits=4)

_CNT = lambda words: " + ".join(f"(length(lo) - length(replace(lo, '{w}', ''))) // {len(w)}" for w in words)
add("txt02_keyword_severity",
    "doc_id:i severe_keyword_count:i moderate_keyword_count:i urgency_keyword_count:i has_severe_keyword:i keyword_severity:i keyword_level",
    lambda s, d: text.keyword_severity(docs(s, d), "text"),
    f"""SELECT *, CAST(severe_keyword_count > 0 AS INT) AS has_severe_keyword, CASE WHEN keyword_severity <= 0 THEN 'none' WHEN keyword_severity <= 2 THEN 'low'
        WHEN keyword_severity <= 5 THEN 'medium' ELSE 'high' END AS keyword_level FROM (SELECT *, least(30, 3 * severe_keyword_count
        + 2 * moderate_keyword_count + 2 * urgency_keyword_count) AS keyword_severity FROM (SELECT doc_id, {_CNT(text.SEVERE_WORDS)} AS severe_keyword_count,
        {_CNT(text.MODERATE_WORDS)} AS moderate_keyword_count, {_CNT(text.URGENCY_WORDS)} AS urgency_keyword_count
        FROM (SELECT doc_id, lower(text) AS lo FROM documents)))""", views="")

_ANY = lambda words: "CAST(" + " OR ".join(f"contains(lo, '{w}')" for w in words) + " AS INT)"
add("txt03_mode_mentions", "doc_id:i " + " ".join(f"mentions_{m}:i" for m in text.MODE_WORDS) + " transport_mode_count:i",
    lambda s, d: text.mode_mentions(docs(s, d), "text"),
    "SELECT *, " + " + ".join(f"mentions_{m}" for m in text.MODE_WORDS) + " AS transport_mode_count FROM (SELECT doc_id, "
    + ", ".join(f"{_ANY(w)} AS mentions_{m}" for m, w in text.MODE_WORDS.items()) + " FROM (SELECT doc_id, lower(text) AS lo FROM documents))", views="")

add("txt04_contact_flags", "doc_id:i has_text:i alert_text_length:i alert_word_count:i alert_has_url:i alert_has_phone:i alert_has_email:i",
    lambda s, d: text.contact_flags(docs(s, d), "text"),
    f"""SELECT doc_id, 1 AS has_text, length(text) AS alert_text_length, {W} AS alert_word_count, CAST(regexp_matches(text, 'http[s]?://') AS INT) AS alert_has_url,
        CAST(regexp_matches(text, '[0-9]{{2,4}}[-\\s]?[0-9]{{2,4}}[-\\s]?[0-9]{{2,4}}') AS INT) AS alert_has_phone,
        CAST(regexp_matches(text, '[\\w.-]+@[\\w.-]+') AS INT) AS alert_has_email FROM documents""", views="")

_RAW = ", ".join("(" + " + ".join(f"CAST(contains(lo, '{w}') AS INT)" for w in ws) + f") / {len(ws)} AS r_{c}" for c, ws in text.TAXONOMY.items())
_SUM = " + ".join(f"r_{c}" for c in text.TAXONOMY)
add("txt05_taxonomy", "doc_id:i alert_primary_category alert_category_confidence:f " + " ".join(f"alert_category_{c}:f" for c in text.TAXONOMY),
    lambda s, d: text.taxonomy_scores(docs(s, d), "text"),
    "SELECT *, CASE WHEN tot = 0 THEN 'UNKNOWN' " + " ".join(
        f"WHEN alert_category_{c} = greatest(" + ", ".join(f"alert_category_{x}" for x in text.TAXONOMY) + f") THEN '{c}'" for c in text.TAXONOMY)
    + " END AS alert_primary_category, CASE WHEN tot = 0 THEN 1 ELSE greatest(" + ", ".join(f"alert_category_{x}" for x in text.TAXONOMY)
    + f") END AS alert_category_confidence FROM (SELECT *, {_SUM} AS tot, " + ", ".join(f"coalesce(r_{c} / nullif({_SUM}, 0), 0) AS alert_category_{c}" for c in text.TAXONOMY)
    + f" FROM (SELECT doc_id, {_RAW} FROM (SELECT doc_id, lower(text) AS lo FROM documents)))", views="")

add("txt06_mentions", "doc_id:i n_routes:i n_stops:i first_stop",
    lambda s, d: text.extract_mentions(docs(s, d), "text").select("doc_id", F.size("mentioned_routes").alias("n_routes"),
                                                                  F.size("mentioned_stops").alias("n_stops"), F.get("mentioned_stops", F.lit(0)).alias("first_stop")),
    r"""SELECT doc_id, len(regexp_extract_all(text, '(?i)(?:line|bus|tram)\s*([0-9]+)', 1)) AS n_routes, len(s) AS n_stops, s[1] AS first_stop FROM (
        SELECT *, regexp_extract_all(text, '(?i)(?:stop|station)\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)', 1) AS s FROM documents)""", views="")

_N, _P = (" + ".join(f"CAST(contains(lo, '{w}') AS INT)" for w in ws) for ws in (text.NEGATIVE_WORDS, text.POSITIVE_WORDS))
add("txt07_sentiment", "doc_id:i text_sentiment:f", lambda s, d: text.sentiment(docs(s, d), "text"),
    f"SELECT doc_id, coalesce(((p) - (n)) / nullif(p + n, 0), 0) AS text_sentiment FROM (SELECT doc_id, {_N} AS n, {_P} AS p FROM (SELECT doc_id, lower(text) AS lo FROM documents))", views="")

add("txt08_sentiment_flags", "obs_id:i alert_negative:i alert_positive:i alert_neutral:i sentiment_urgent:i confidence_level urgency_score:f alert_urgency_score:f",
    lambda s, d: text.urgency(text.sentiment_flags(obs(s, d).withColumns({
        "sentiment": F.element_at(F.array(F.lit("Negative"), F.lit("Neutral"), F.lit("Positive")), F.col("k") % 3 + 1),
        "score": F.col("k") / 100, "effect_code": F.col("k") % 9})), "sentiment", "score", "effect_code"),
    """SELECT obs_id, CAST(m = 0 AS INT) AS alert_negative, CAST(m = 2 AS INT) AS alert_positive, CAST(m = 1 AS INT) AS alert_neutral,
       CAST(m = 0 AND p > 0.7 AS INT) AS sentiment_urgent, CASE WHEN p <= 0 THEN NULL WHEN p <= 0.5 THEN 'low' WHEN p <= 0.7 THEN 'medium'
       WHEN p <= 0.85 THEN 'high' ELSE 'very_high' END AS confidence_level, CASE WHEN m = 0 THEN p ELSE 0 END AS urgency_score,
       CASE WHEN m = 0 THEN p ELSE 0 END + k % 9 * 0.5 AS alert_urgency_score FROM (SELECT *, k % 3 AS m, k / 100 AS p FROM obs)""")


def entities(s, d):
    k = F.col("k")
    kind = lambda i: F.element_at(F.array(*[F.lit(x) for x in ("LOC", "ORG", "PER")]), (k + i) % 3 + 1)
    arr = F.transform(F.expr("filter(sequence(1, 4), i -> i <= k % 5)"), lambda i: F.struct(kind(i).alias("entity_type"), F.lit("x").alias("text")))
    return obs(s, d).withColumns({"ents": F.when(k % 7 != 0, F.to_json(arr)), "body": F.repeat(F.lit("ab"), k)})


add("txt09_entities", "obs_id:i entity_count:i location_entity_count:i org_entity_count:i person_entity_count:i has_location_entity:i entity_density:f",
    lambda s, d: text.entity_features(entities(s, d), "ents", "body"),
    """SELECT obs_id, n AS entity_count, l AS location_entity_count, o AS org_entity_count, p AS person_entity_count, CAST(l > 0 AS INT) AS has_location_entity,
       round_even(n / (2 * k / 100 + 1), 3) AS entity_density FROM (SELECT obs_id, k, count(i) AS n, count(i) FILTER ((k + i) % 3 = 0) AS l,
       count(i) FILTER ((k + i) % 3 = 1) AS o, count(i) FILTER ((k + i) % 3 = 2) AS p FROM obs LEFT JOIN (VALUES (1), (2), (3), (4)) v(i)
       ON i <= k % 5 AND k % 7 <> 0 GROUP BY 1, 2)""", digits=4)

add("txt10_language", "doc_id:i alert_language alert_is_dutch:i alert_is_english:i alert_is_german:i alert_is_french:i",
    lambda s, d: text.language_flags(docs(s, d), "lang"),
    """SELECT doc_id, coalesce(lang, 'unknown') AS alert_language, CAST(coalesce(lang = 'nl', false) AS INT) AS alert_is_dutch, CAST(coalesce(lang = 'en', false) AS INT) AS
       alert_is_english, CAST(coalesce(lang = 'de', false) AS INT) AS alert_is_german, CAST(coalesce(lang = 'fr', false) AS INT) AS alert_is_french FROM documents""", views="")

add("arr01_array_access", "o_orderkey:i n_lines:i biggest:f big_lines:i mean_qty:f",
    lambda s, d: table(s, d, "orders").join(table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sort_array(F.collect_list("l_quantity"), False).alias("q")), "o_orderkey").select(
        "o_orderkey", F.size("q").alias("n_lines"), F.element_at("q", 1).alias("biggest"), F.size(F.filter("q", lambda x: x > 25)).alias("big_lines"),
        (F.aggregate("q", F.lit(0.0), lambda a, x: a + x) / F.size("q")).alias("mean_qty")),
    """SELECT l_orderkey AS o_orderkey, count(*) AS n_lines, max(l_quantity) AS biggest, count(*) FILTER (l_quantity > 25) AS big_lines,
       avg(l_quantity) AS mean_qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""", views="")

add("mth04_bins", "obs_id:i bin", lambda s, d: obs(s, d).withColumn("bin", bins.cut(F.col("delay_sec"), [-120, -60, 60, 300], ["early", "on_time", "late"])),
    """SELECT obs_id, CASE WHEN delay_sec > -120 AND delay_sec <= -60 THEN 'early' WHEN delay_sec > -60 AND delay_sec <= 60 THEN 'on_time'
       WHEN delay_sec > 60 AND delay_sec <= 300 THEN 'late' END AS bin FROM obs""")
