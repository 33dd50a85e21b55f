"""Features of the static timetable: routes, stops, trips, schedule and their deviation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise.functions.bins import cut, flag
from stopwise.functions.clock import clock_seconds
from stopwise.functions.geo import ALL_HUBS, haversine_km
from stopwise.operators.temporal import clip, first_per_key
from stopwise.ordered import with_totals, with_windows
from stopwise.session import cut_lineage
from stopwise.skew import attach, hot_table, lookup, sharing_hot_keys


def number(name: str, default: int) -> Column:
    return F.coalesce(F.col(name).try_cast("double"), F.lit(float(default))).cast("int")


def stop_route_bridge(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """Distinct (stop, route) pairs.  Stop times are reduced to distinct (trip, stop) before the join if a trip is hot."""
    pairs = stop_times.select("trip_id", "stop_id")
    if hot_table(pairs, ["trip_id"]) is not None:
        pairs = pairs.distinct()
    owner = first_per_key(trips.select("trip_id", "route_id").filter("trip_id is not null"), ["trip_id"], [F.col("route_id")])
    return attach(pairs, owner, ["trip_id"], F.xxhash64("stop_id")).select("stop_id", "route_id").filter(
        "stop_id is not null and route_id is not null").distinct()


def degrees(bridge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes per stop, and stops per route with mean and maximum degree of its stops."""
    stop_degree = bridge.groupBy("stop_id").agg(F.count("route_id").alias("stop_degree"))
    wide = attach(bridge, stop_degree, ["stop_id"], F.xxhash64("route_id"))
    route_degree = wide.groupBy("route_id").agg(
        F.count("stop_id").alias("route_stop_count"), F.avg("stop_degree").alias("route_avg_stop_degree"),
        F.max("stop_degree").alias("route_max_stop_degree"))
    return stop_degree, route_degree


def mode_flags(route_type: Column) -> dict[str, Column]:
    # Route type codes.
    kinds = {"is_tram": 0, "is_metro": 1, "is_rail": 2, "is_bus": 3, "is_ferry": 4}
    return {name: flag(route_type == code) for name, code in kinds.items()}


def route_dimension(routes: DataFrame, trips: DataFrame, bridge: DataFrame, calendar_dates: DataFrame) -> DataFrame:
    """Modes, name lengths, trip and stop counts and service days of each route."""
    kind = number("route_type", -1)
    base = first_per_key(routes, ["route_id"], [F.coalesce("route_short_name", F.lit(""))])
    out = base.withColumns({
        "route_type_int": kind, **mode_flags(kind), "route_name_length": F.length("route_short_name"),
        "route_long_name_length": F.length("route_long_name")})
    freq = trips.groupBy("route_id").agg(F.count_distinct("trip_id").alias("route_trip_count"))
    stops = bridge.groupBy("route_id").agg(F.count("stop_id").alias("route_stop_count"))
    days = calendar_dates.groupBy("service_id").agg(F.count_distinct("date").alias("service_days"))
    served = trips.select("route_id", "service_id").distinct().join(days, "service_id", "left")
    service = served.groupBy("route_id").agg(F.sum(F.coalesce("service_days", F.lit(0))).alias("route_service_days"))
    out = out.join(freq, "route_id", "left").join(stops, "route_id", "left").join(service, "route_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("route_trip_count", "route_stop_count")})


def transfer_counts(transfers: DataFrame) -> DataFrame:
    """Connections per stop, counted on both sides."""
    ends = transfers.select(F.col("from_stop_id").alias("stop_id")).unionByName(
        transfers.select(F.col("to_stop_id").alias("stop_id"))).filter("stop_id is not null")
    return ends.groupBy("stop_id").agg(F.count(F.lit(1)).alias("transfer_connection_count"))


def transfer_stops(transfers: DataFrame) -> DataFrame:
    """Set union of the stops on either side of a transfer."""
    return transfers.select(F.col("from_stop_id").alias("stop_id")).union(transfers.select("to_stop_id")).filter(
        "stop_id is not null").distinct()


def stop_dimension(stops: DataFrame, stop_degree: DataFrame, transfers: DataFrame) -> DataFrame:
    """Station, parent, platform and wheelchair flags, bins, degree, hub and transfer flags, distance to the nearest of eight hubs."""
    base = first_per_key(stops, ["stop_id"], [F.coalesce("stop_name", F.lit(""))])
    lat, lon = F.col("stop_lat").try_cast("double"), F.col("stop_lon").try_cast("double")
    nearest = F.least(*[haversine_km(lat, lon, F.lit(a), F.lit(b)) for a, b in ALL_HUBS.values()])
    out = base.join(stop_degree, "stop_id", "left").join(transfer_counts(transfers), "stop_id", "left")
    degree = F.coalesce("stop_degree", F.lit(0))
    return out.withColumns({
        "is_station": number("location_type", 0), "has_parent_station": flag(F.col("parent_station").isNotNull()),
        "has_platform": flag(F.col("platform_code").isNotNull()), "wheelchair_accessible_stop": number("wheelchair_boarding", 0),
        "lat_bin": F.bround(lat * 10).cast("long"), "lon_bin": F.bround(lon * 10).cast("long"),
        "stop_degree": degree, "is_hub_stop": flag(degree > 5), "is_major_hub": flag(degree >= 10),
        "is_transfer_stop": flag(F.col("transfer_connection_count").isNotNull()),
        "transfer_connection_count": F.coalesce("transfer_connection_count", F.lit(0)),
        "dist_to_nearest_hub_km": F.bround(nearest, 1),
    })


def trip_dimension(trips: DataFrame, stop_times: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """Direction, shape, wheelchair and bike flags, stop count, largest sequence and length of each trip."""
    base = first_per_key(trips, ["trip_id"], [F.coalesce("route_id", F.lit(""))])
    counted = stop_times.groupBy("trip_id").agg(
        F.count_distinct("stop_id").alias("trip_stop_count"),
        F.max(F.col("stop_sequence").try_cast("double")).alias("trip_max_sequence"))
    # Both have one row per trip.
    out = base.join(counted, "trip_id", "left").withColumns({
        "trip_direction": number("direction_id", -1), "has_shape": flag(F.col("shape_id").isNotNull()),
        "trip_wheelchair": number("wheelchair_accessible", 0), "trip_bikes_allowed": number("bikes_allowed", 0)})
    if shapes is not None:
        length = shapes.groupBy("shape_id").agg(
            F.max(F.col("shape_dist_traveled").try_cast("double")).alias("shape_total_dist_m"))
        out = lookup(out, length, ["shape_id"], F.xxhash64("trip_id"), base=trips)
    return out


@sharing_hot_keys
def schedule(stop_times: DataFrame) -> DataFrame:
    """Clock times in seconds, dwell, travel time to the next stop, position in the trip, pickup flags.

    Without a hot trip its last position is taken in the shuffle of the next stops, else from totals joined back.
    """
    base = stop_times.withColumns({
        "sched_arr_sec": clock_seconds(F.col("arrival_time")), "sched_dep_sec": clock_seconds(F.col("departure_time")),
        "stop_seq_num": F.col("stop_sequence").try_cast("long")})
    by, longest = ["stop_seq_num", "stop_id", "sched_dep_sec"], F.max("stop_seq_num")
    nexts = with_windows(base, ["trip_id"], by, [], [
        lambda w: {"sched_travel_to_next": F.lead("sched_dep_sec").over(w) - F.col("sched_dep_sec")}], ahead=1)
    if hot_table(base, ["trip_id"], by) is None:
        out = nexts.withColumn("_max", F.when(F.col("trip_id").isNotNull(), longest.over(Window.partitionBy("trip_id"))))
    else:
        out = with_totals(nexts, ["trip_id"], [longest.alias("_max")], spread=F.xxhash64("stop_id", "stop_seq_num"), base=base)
    return out.withColumns({
        "sched_dwell_sec": F.col("sched_dep_sec") - F.col("sched_arr_sec"),
        "stop_seq_ratio": F.try_divide(F.col("stop_seq_num"), F.col("_max")),
        "sched_no_pickup": flag(F.col("pickup_type").try_cast("int") == 1),
        "sched_no_dropoff": flag(F.col("drop_off_type").try_cast("int") == 1),
    }).drop("_max")


SCHEDULE_COLUMNS = ("sched_arr_sec", "sched_dep_sec", "sched_dwell_sec", "sched_travel_to_next", "stop_seq_ratio",
                    "sched_no_pickup", "sched_no_dropoff")


def join_schedule(df: DataFrame, schedule_table: DataFrame, spread: str = "obs_id", base: DataFrame | None = None) -> DataFrame:
    """Schedule of the (trip, stop) pair; a stop visited twice by a trip keeps its first visit."""
    keys = ["trip_id", "stop_id"]
    first = first_per_key(schedule_table.select(*keys, "stop_seq_num", *SCHEDULE_COLUMNS), keys,
                          [F.col("stop_seq_num"), F.col("sched_dep_sec"), F.col("sched_travel_to_next")])
    return schedule_buckets(attach(df, first.drop("stop_seq_num"), keys, F.col(spread), base))


def schedule_buckets(df: DataFrame) -> DataFrame:
    """Scheduled hour (half-even, 0 to 27) and its day-part flags."""
    h = F.col("sched_hour")
    out = df.withColumn("sched_hour", clip(F.bround(F.col("sched_arr_sec") / 3600), 0, 27))
    return out.withColumns({
        "sched_is_peak": flag(h.between(7, 9) | h.between(16, 19)), "sched_is_offpeak": flag((h >= 9) & (h < 16)),
        "sched_is_evening": flag(h >= 19), "sched_is_early_morning": flag(h < 7)})


ADHERENCE = ("very_early", "early", "on_time", "late", "very_late")


def schedule_deviation(df: DataFrame) -> DataFrame:
    """Deviation from the schedule, relative delay (±5), on-time flag, adherence class and its indicators."""
    dev = F.col("actual_time_sec") - F.col("sched_arr_sec")
    out = df.withColumns({
        "sched_deviation_sec": dev,
        "relative_delay": clip(F.try_divide(F.col("delay_sec"), F.col("sched_travel_to_next")), -5, 5),
        "is_ontime_60s": flag(F.abs(dev) <= 60),
        "sched_adherence": cut(dev, [float("-inf"), -120, -60, 60, 300, float("inf")], list(ADHERENCE))})
    return out.withColumns({f"adherence_{c}": flag(F.col("sched_adherence") == c) for c in ADHERENCE})


def delay_features(df: DataFrame, delay: str = "delay_sec") -> DataFrame:
    """Absolute delay, delayed flag and category (unknown counts as 0)."""
    d = F.coalesce(F.col(delay), F.lit(0.0))
    return df.withColumns({
        "abs_arrival_delay": F.abs(d), "is_delayed": flag(d > 0),
        "delay_category": cut(F.abs(d), [float("-inf"), 0, 60, 180, 300, float("inf")],
                              ["early", "minor", "moderate", "major", "severe"])})


def speed_features(df: DataFrame, speed: str = "speed") -> DataFrame:
    v = F.col(speed)
    return df.withColumns({"speed_mps": v / 3.6, "is_stationary": flag(v < 0.5), "is_stopped": flag(v < 0.1),
                           "low_speed_flag": flag(v < 5)})


def network_defaults(df: DataFrame) -> DataFrame:
    """Defaults for rows without timetable data: a bus at an ordinary stop."""
    wanted = {"stop_route_degree": 1, "is_hub_stop": 0, "is_transfer_stop": 0, "route_stop_count": 1, "route_type": 3,
              "is_bus": 1, "is_train": 0, "is_tram": 0, "is_metro": 0, "is_ferry": 0}
    return df.withColumns({c: F.lit(v) for c, v in wanted.items() if c not in df.columns})


@sharing_hot_keys
def add_dimensions(df: DataFrame, dims: dict[str, DataFrame], spread: str = "obs_id", base: DataFrame | None = None) -> DataFrame:
    """Route, stop and trip features on the observation rows; ``base`` has the same rows and a shorter plan.

    The bridge and the finished route and stop dimensions are written once, and their true size decides between a broadcast and a
    salted join.  The trip dimension is about as large as its tables and read once, so it stays in the plan.
    """
    bridge = cut_lineage(stop_route_bridge(dims["stop_times"], dims["trips"]))
    stop_degree, route_degree = degrees(bridge)
    r = route_dimension(dims["routes"], dims["trips"], bridge, dims["calendar_dates"])
    s = stop_dimension(dims["stops"], stop_degree, dims["transfers"])
    t = trip_dimension(dims["trips"], dims["stop_times"], dims.get("shapes"))
    out = df
    for dim, key in ((r.join(route_degree.drop("route_stop_count"), "route_id", "left"), "route_id"), (s, "stop_id"), (t, "trip_id")):
        part = dim.select(*[c for c in dim.columns if c == key or c not in out.columns])
        out = lookup(out, part if dim is t else cut_lineage(part), [key], F.col(spread), base=df if base is None else base)
    return out.withColumn("near_transfer", F.coalesce("is_transfer_stop", F.lit(0)))
