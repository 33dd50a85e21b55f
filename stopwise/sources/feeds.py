"""Real-time feed messages (nested DataFrames) to flat feed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the alert cause and effect codes.
CAUSES = {
    1: "UNKNOWN_CAUSE", 2: "OTHER_CAUSE", 3: "TECHNICAL_PROBLEM", 4: "STRIKE", 5: "DEMONSTRATION", 6: "ACCIDENT",
    7: "HOLIDAY", 8: "WEATHER", 9: "MAINTENANCE", 10: "CONSTRUCTION", 11: "POLICE_ACTIVITY", 12: "MEDICAL_EMERGENCY",
}
EFFECTS = {
    1: "NO_SERVICE", 2: "REDUCED_SERVICE", 3: "SIGNIFICANT_DELAYS", 4: "DETOUR", 5: "ADDITIONAL_SERVICE",
    6: "MODIFIED_SERVICE", 7: "OTHER_EFFECT", 8: "UNKNOWN_EFFECT", 9: "STOP_MOVED", 10: "NO_EFFECT",
    11: "ACCESSIBILITY_ISSUE",
}

_TRIP = "struct<trip_id:string,route_id:string,direction_id:int,start_time:string,start_date:string,schedule_relationship:int>"
_VEHICLE = "struct<id:string,label:string,license_plate:string>"
_TEXT = "array<struct<text:string,language:string>>"
_EVENT = "struct<delay:bigint,time:bigint,uncertainty:int>"

# Schema of a decoded feed message, for readers of JSON or parquet message files.
MESSAGE_DDL = (
    "header struct<timestamp:bigint>, retrieved_at timestamp, entity array<struct<id:string,"
    f"vehicle:struct<trip:{_TRIP},vehicle:{_VEHICLE},"
    "position:struct<latitude:double,longitude:double,bearing:double,odometer:double,speed:double>,"
    "current_stop_sequence:int,stop_id:string,current_status:int,timestamp:bigint,congestion_level:int,"
    "occupancy_status:int,occupancy_percentage:int>,"
    f"trip_update:struct<trip:{_TRIP},vehicle:{_VEHICLE},timestamp:bigint,delay:bigint,"
    f"stop_time_update:array<struct<stop_sequence:int,stop_id:string,schedule_relationship:int,arrival:{_EVENT},"
    f"departure:{_EVENT}>>>,"
    f"alert:struct<cause:int,effect:int,severity_level:int,header_text:{_TEXT},description_text:{_TEXT},url:{_TEXT},"
    f"tts_header_text:{_TEXT},tts_description_text:{_TEXT},active_period:array<struct<start:bigint,end:bigint>>,"
    "informed_entity:array<struct<agency_id:string,route_id:string,route_type:int,trip_id:string,stop_id:string>>>>>"
)

ENTITIES_JSON = "array<struct<agency_id:string,route_id:string,route_type:int,trip_id:string,stop_id:string>>"
PERIODS_JSON = "array<struct<start:bigint,end:bigint>>"


def _text(value: Column) -> Column:
    """Empty text is absent."""
    return F.nullif(value, F.lit(""))


def _number(value: Column) -> Column:
    """Zero means not set in the feed format."""
    return F.when(value != 0, value.cast("double"))


def entities(messages: DataFrame) -> DataFrame:
    """One row per entity of each message, with the header clock and the retrieval time."""
    return messages.select(
        F.col("header.timestamp").alias("header_ts"), "retrieved_at", F.explode("entity").alias("e"))


def _trip(prefix: str) -> list[Column]:
    t = F.col(f"{prefix}.trip")
    return [_text(t["trip_id"]).alias("trip_id"), _text(t["route_id"]).alias("route_id"),
            _number(t["direction_id"]).alias("direction_id"), _text(t["start_time"]).alias("start_time"),
            _text(t["start_date"]).alias("start_date"), t["schedule_relationship"].alias("schedule_relationship")]


def vehicle_positions(messages: DataFrame) -> DataFrame:
    """Flat vehicle rows; entities of other kinds are left out, a missing clock falls back to the header."""
    v = F.col("e.vehicle")
    p = v["position"]
    none = F.lit(None).cast("string")
    return entities(messages).filter(v.isNotNull()).select(
        F.col("e.id").alias("entity_id"), *_trip("e.vehicle"),
        _text(v["vehicle"]["id"]).alias("vehicle_id"), _text(v["vehicle"]["label"]).alias("vehicle_label"),
        _text(v["vehicle"]["license_plate"]).alias("license_plate"), none.alias("wheelchair_accessible"),
        *[_number(p[c]).alias(c) for c in ("latitude", "longitude", "bearing", "odometer", "speed")],
        _number(v["current_stop_sequence"]).alias("current_stop_sequence"), _text(v["stop_id"]).alias("stop_id"),
        v["current_status"].alias("current_status"),
        F.coalesce(F.nullif(v["timestamp"], F.lit(0)), F.col("header_ts")).cast("long").alias("timestamp"),
        *[F.when(v[c] != 0, v[c].cast("string")).alias(c)
          for c in ("congestion_level", "occupancy_status", "occupancy_percentage")],
        none.alias("multi_carriage_details"), "retrieved_at")


def trip_updates(messages: DataFrame) -> DataFrame:
    """One row per stop update; an update without any keeps one row with empty stop fields, delays default to 0."""
    u = F.col("e.trip_update")
    rows = entities(messages).filter(u.isNotNull()).withColumn("u", F.explode_outer(u["stop_time_update"]))
    s = F.col("u")
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("string")
    return rows.select(
        F.col("e.id").alias("entity_id"), *_trip("e.trip_update"),
        _text(u["vehicle"]["id"]).alias("vehicle_id"), _text(u["vehicle"]["label"]).alias("vehicle_label"),
        none.alias("license_plate"),
        F.timestamp_seconds(F.coalesce(F.nullif(u["timestamp"], F.lit(0)), F.col("header_ts"))).alias("trip_update_timestamp"),
        F.coalesce(u["delay"], zero).alias("delay"),
        *[_text(u["trip"][c]).alias(f"trip_properties_{c}") for c in ("trip_id", "start_date", "start_time")],
        none.alias("trip_properties_shape_id"), _number(s["stop_sequence"]).alias("stop_sequence"),
        _text(s["stop_id"]).alias("stop_id"), s["schedule_relationship"].alias("stop_time_schedule_relationship"),
        F.coalesce(s["arrival"]["delay"], zero).alias("arrival_delay"), _number(s["arrival"]["time"]).alias("arrival_time"),
        _number(s["arrival"]["uncertainty"]).alias("arrival_uncertainty"),
        F.coalesce(s["departure"]["delay"], zero).alias("departure_delay"),
        _number(s["departure"]["time"]).alias("departure_time"),
        _number(s["departure"]["uncertainty"]).alias("departure_uncertainty"),
        _text(s["stop_id"]).alias("assigned_stop_id"), none.alias("departure_occupancy_status"), "retrieved_at")


def code_name(code: Column, names: dict[int, str], default: str) -> Column:
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(default))


def alerts(messages: DataFrame) -> DataFrame:
    """Flat alert rows: first translation of each text, names of the codes, periods and entities as JSON text."""
    a = F.col("e.alert")
    def first(c: str) -> Column:
        return F.get(a[c], F.lit(0))["text"].alias(c)
    routes = F.transform(a["informed_entity"], lambda x: F.struct(
        _text(x["agency_id"]).alias("agency_id"), _text(x["route_id"]).alias("route_id"),
        F.nullif(x["route_type"], F.lit(0)).alias("route_type"), _text(x["trip_id"]).alias("trip_id"),
        _text(x["stop_id"]).alias("stop_id")))
    none = F.lit(None).cast("string")
    return entities(messages).filter(a.isNotNull()).select(
        F.col("e.id").alias("entity_id"), code_name(a["cause"], CAUSES, "UNKNOWN_CAUSE").alias("cause"),
        code_name(a["effect"], EFFECTS, "UNKNOWN_EFFECT").alias("effect"),
        F.when(a["severity_level"] != 0, a["severity_level"].cast("string")).alias("severity_level"),
        F.when(F.size(a["active_period"]) > 0, F.to_json(a["active_period"])).alias("active_periods"),
        F.when(F.size(a["informed_entity"]) > 0, F.to_json(routes)).alias("informed_entities"),
        *[first(c) for c in ("header_text", "description_text", "url", "tts_header_text", "tts_description_text")],
        none.alias("image"), none.alias("image_alternative_text"), none.alias("cause_detail"),
        none.alias("effect_detail"), "retrieved_at")


def informed_routes(alert_table: DataFrame) -> DataFrame:
    """One row per alert and informed entity that names a route; unreadable JSON gives no row."""
    keep = [c for c in ("entity_id", "cause", "effect", "severity_level", "header_text", "description_text", "retrieved_at")
            if c in alert_table.columns]
    listed = F.explode(F.from_json("informed_entities", ENTITIES_JSON))
    return alert_table.select(*keep, listed.alias("ie")).filter(
        F.col("ie.route_id").isNotNull() & (F.col("ie.route_id") != "")).select(*keep, F.col("ie.route_id").alias("route_id"))


def active_span(alert_table: DataFrame) -> DataFrame:
    """First start and last end of the active periods as timestamps."""
    periods = F.from_json("active_periods", PERIODS_JSON)
    return alert_table.withColumns({
        "active_period_start": F.timestamp_seconds(F.array_min(F.transform(periods, lambda p: F.nullif(p["start"], F.lit(0))))),
        "active_period_end": F.timestamp_seconds(F.array_max(F.transform(periods, lambda p: F.nullif(p["end"], F.lit(0))))),
    })
