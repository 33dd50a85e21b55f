"""Joining feeds with each other and with the static timetable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions.clock import clock_seconds
from stopwise.operators.label import as_strings, resolve_col
from stopwise.operators.temporal import first_per_key
from stopwise.skew import attach, lookup, sharing_hot_keys
from stopwise.sources.feeds import informed_routes

LATEST = "latest"


def _latest_first(df: DataFrame) -> list[Column]:
    """Order that puts the newest row first: retrieval or update time, then the identity columns; stops in number
    order, rows without a number last."""
    order = [F.coalesce(-F.unix_micros(c), F.lit(0)) for c in ("retrieved_at", "trip_update_timestamp")
             if c in df.columns and dict(df.dtypes)[c] == "timestamp"]
    last = F.lit(float("inf"))
    ties = {"entity_id": F.coalesce(F.col("entity_id").cast("string"), F.lit("")),
            "stop_sequence": F.coalesce(F.col("stop_sequence").cast("double"), last),
            "stop_id": F.coalesce(F.col("stop_id").cast("string"), F.lit(""))}
    return order + [value for name, value in ties.items() if name in df.columns]


def new_columns(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The right side reduced to its keys and the columns the left side does not have."""
    return right.select(*keys, *[c for c in right.columns if c not in left.columns and c not in keys])


def merge_feeds(vehicles: DataFrame, updates: DataFrame, alert_table: DataFrame) -> DataFrame:
    """Vehicle rows with the newest update of their trip and the newest alert of their route, plus derived columns.

    Null keys never match.  Alerts join on their own route_id when they have one, else through informed entities.
    """
    spread = F.col("entity_id")
    vp = as_strings(vehicles, ["trip_id", "route_id", "stop_id"])
    tu = as_strings(updates, ["trip_id", "route_id", "stop_id"]).filter(F.col("trip_id").isNotNull())
    tu = first_per_key(tu, ["trip_id"], _latest_first(tu))
    merged = attach(vp, new_columns(vp, tu, ["trip_id"]), ["trip_id"], spread)
    al = alert_table
    if "route_id" not in al.columns:
        al = informed_routes(al)
    al = al.filter(F.col("route_id").isNotNull())
    al = first_per_key(al, ["route_id"], _latest_first(al))
    merged = attach(merged, new_columns(merged, al, ["route_id"]), ["route_id"], spread, base=vp)
    return with_indicators(with_clock(merged))


def with_clock(df: DataFrame) -> DataFrame:
    """feed_timestamp, delay_sec and actual_time_sec from the first source present."""
    out = df
    if "feed_timestamp" not in df.columns:
        options = []
        if "retrieved_at" in df.columns:
            options.append(F.col("retrieved_at"))
        if "timestamp" in df.columns:
            options.append(F.timestamp_seconds("timestamp"))
        out = out.withColumn("feed_timestamp", F.coalesce(*options) if options else F.lit(None).cast("timestamp"))
    if "delay_sec" not in df.columns:
        source = resolve_col(df, ("arrival_delay", "delay"))
        out = out.withColumn("delay_sec", (F.col(source) if source else F.lit(None)).cast("double"))
    actual = resolve_col(df, ("arrival_time", "departure_time"))
    if actual and "actual_time_sec" not in df.columns:
        out = out.withColumn("actual_time_sec", clock_seconds(F.col(actual)))
    return out


def with_indicators(df: DataFrame) -> DataFrame:
    """has_overlapping_alert and the alert_* copies of the alert columns."""
    cause = resolve_col(df, ("cause", "cause_alert"))
    effect = resolve_col(df, ("effect", "effect_alert"))
    out = df.withColumn("has_overlapping_alert", F.col(cause).isNotNull() if cause else F.lit(False))
    for source, name in ((cause, "alert_cause"), (effect, "alert_effect"),
                         (resolve_col(df, ("description_text",)), "alert_text")):
        if source and name not in out.columns:
            out = out.withColumn(name, F.col(source))
    return out


STAR = (
    ("trips", "trip_id", ("route_id", "direction_id", "trip_headsign", "shape_id")),
    ("routes", "route_id", ("agency_id", "route_short_name", "route_long_name", "route_type")),
    ("stops", "stop_id", ("stop_name", "stop_lat", "stop_lon")),
    ("agency", "agency_id", ("agency_name",)),
)


@sharing_hot_keys
def star_join(df: DataFrame, dims: dict[str, DataFrame], spread: str = "obs_id") -> DataFrame:
    """Trips, routes, stops and agency in turn; each reduced to one row per key and to columns not yet there."""
    out = df
    for name, key, wanted in STAR:
        dim = dims.get(name)
        if dim is None or key not in out.columns or key not in dim.columns:
            continue
        cols = [c for c in wanted if c in dim.columns and c not in out.columns]
        if not cols:
            continue
        dim = as_strings(dim, [key]).select(key, *cols).filter(F.col(key).isNotNull())
        dim = first_per_key(dim, [key], [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
        for c in ("stop_lat", "stop_lon"):
            if c in cols:
                dim = dim.withColumn(c, F.col(c).try_cast("double"))
        # The joins before it leave the rows as many as they are, so keys of the rows are counted without them.
        out = lookup(as_strings(out, [key]), dim, [key], F.col(spread), base=as_strings(df.select(key), [key]) if key in df.columns else None)
    return out


def union_feeds(local: DataFrame, live: DataFrame) -> DataFrame:
    """All columns of both by name; on (entity_id, retrieved_at) the local row wins."""
    both = local.withColumn("_rank", F.lit(0)).unionByName(live.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    order = [F.col("_rank")] + [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("trip_id", "stop_id") if c in both.columns]
    return first_per_key(both, ["entity_id", "retrieved_at"], order).drop("_rank")


def train_counts(train: DataFrame, full: DataFrame, keys: Sequence[str], out: str = "stop_load",
                 spread: str = "obs_id") -> DataFrame:
    """Counts of the key in the training rows looked up for all rows; unseen keys get the median count."""
    from stopwise.operators.quantiles import median_of

    counts = train.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(out))
    found = attach(full, counts, list(keys), F.col(spread))
    return found.withColumn(out, F.coalesce(F.col(out), median_of(counts, out), F.lit(0.0)))


def in_set(df: DataFrame, members: DataFrame, key: str, flag: str, spread: str = "obs_id") -> DataFrame:
    """0/1 flag for membership of the key in a set of ids."""
    ids = members.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_in", F.lit(1))
    return lookup(df, ids, [key], F.col(spread)).withColumn(flag, F.coalesce("_in", F.lit(0))).drop("_in")


def join_weather(df: DataFrame, weather: DataFrame, time: str = "feed_timestamp", exact: bool = False,
                 spread: str = "obs_id") -> DataFrame:
    """Weather of the hour of the observation (or of exactly its instant)."""
    key = F.col(time) if exact else F.date_trunc("hour", time)
    w = weather.withColumn("_at", F.col("timestamp") if exact else F.date_trunc("hour", "timestamp")).drop("timestamp")
    w = first_per_key(w.filter(F.col("_at").isNotNull()), ["_at"], [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in w.columns if c != "_at"])
    return lookup(df.withColumn("_at", key), w, ["_at"], F.col(spread)).drop("_at")


def join_weather_grid(df: DataFrame, weather: DataFrame, lat: str = "stop_lat", lon: str = "stop_lon",
                      spread: str = "obs_id") -> DataFrame:
    """Weather of the 0.1 degree cell; the table has one row per (cell_lat, cell_lon) in tenths."""
    rows = df.withColumns({"cell_lat": F.bround(F.col(lat) * 10).cast("long"), "cell_lon": F.bround(F.col(lon) * 10).cast("long")})
    return lookup(rows, weather, ["cell_lat", "cell_lon"], F.col(spread))


def merge_alert_summaries(vehicles: DataFrame, alert_table: DataFrame, spread: str = "entity_id") -> DataFrame:
    """Vehicles joined to the alert summary of their four-character key: modal cause and effect, mean severity."""
    from stopwise.operators.summary import modal_values

    key = F.coalesce(F.substring("header_text", 1, 4), F.lit("GEN"))
    al = alert_table.withColumn("key4", key).withColumn("severity_level", F.col("severity_level").try_cast("double"))
    sums = modal_values(al, "key4", ["cause", "effect"], "severity_level")
    sums = sums.select("key4", F.col("mode_cause").alias("cause"), F.col("mode_effect").alias("effect"),
                       F.col("mean_severity_level").alias("severity_level"))
    rows = vehicles.drop("cause", "effect", "severity_level").withColumn("key4", F.substring("route_id", 1, 4))
    out = attach(rows, sums, ["key4"], F.col(spread))
    severity = F.coalesce("severity_level", F.lit(1.0))
    return out.withColumns({
        "cause": F.coalesce("cause", F.lit("UNKNOWN")), "effect": F.coalesce("effect", F.lit("UNKNOWN")),
        "severity_level": severity, "disruption_target": (severity > 3).cast("int"),
        "alert_sentiment": F.when(severity > 4, "negative").when(severity > 2, "neutral").otherwise("positive"),
    })


def locate(df: DataFrame, gazetteer: Sequence[tuple[str, float, float]], text: str, entity: str | None = None,
           lat: str | None = None, lon: str | None = None) -> DataFrame:
    """Coordinates of a row: its own, else the gazetteer place of its location entity, else the first listed place
    contained in the text.  The gazetteer is a short literal list, so the match is an expression, not a join."""
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    named = F.lower(F.col(entity)) if entity else F.lit(None).cast("string")

    def place(name, a, b):
        return F.struct(F.lit(name).alias("place"), F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon"))

    empty = F.lit(None).cast("struct<place:string,lat:double,lon:double>")
    by_entity, by_text = empty, empty
    for name, a, b in reversed(list(gazetteer)):
        by_entity = F.when(named == name.lower(), place(name, a, b)).otherwise(by_entity)
        by_text = F.when(body.contains(name.lower()), place(name, a, b)).otherwise(by_text)
    found = F.coalesce(by_entity, by_text)
    own_lat = F.col(lat) if lat else F.lit(None).cast("double")
    own_lon = F.col(lon) if lon else F.lit(None).cast("double")
    has_own = own_lat.isNotNull() & own_lon.isNotNull()
    return df.withColumn("_found", found).withColumns({
        "first_loc_text": F.col("_found.place"),
        "first_lat": F.when(has_own, own_lat).otherwise(F.col("_found.lat")),
        "first_lon": F.when(has_own, own_lon).otherwise(F.col("_found.lon")),
    }).drop("_found")
