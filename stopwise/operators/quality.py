"""Feed validation: one aggregate pass per check family, issues as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions.bins import flag
from stopwise.functions.geo import LAT_RANGE, LON_RANGE
from stopwise.ordered import with_windows

# Required fields of each feed, accepted names, and the fields whose absence is an error.
REQUIRED = {
    "vehicle_positions": ("vehicle_id", "trip_id", "latitude", "longitude"),
    "trip_updates": ("trip_id", "stop_id"),
    "service_alerts": ("alert_id", "cause", "effect"),
}
ALTERNATES = {
    "latitude": ("lat", "latitude"), "longitude": ("lon", "longitude"), "vehicle_id": ("vehicle_id", "vehicle/id"),
    "trip_id": ("trip_id", "trip/id"), "stop_id": ("stop_id", "stop/id"), "alert_id": ("alert_id", "id"),
}
FATAL = ("vehicle_id", "trip_id", "alert_id")

ISSUE_DDL = "feed_type string, severity string, code string, n bigint"


def schema_issues(df: DataFrame, feed_type: str) -> DataFrame:
    """Missing required fields (schema only, no job)."""
    rows = [(feed_type, "error" if f in FATAL else "warn", f"MISSING_{f.upper()}", 1) for f in REQUIRED.get(feed_type, ())
            if not any(a in df.columns for a in ALTERNATES.get(f, (f,)))]
    return df.sparkSession.createDataFrame(rows, ISSUE_DDL)


def required_fields(df: DataFrame, feed: str = "feed_type") -> DataFrame:
    """Per feed and required field: rows, rows without a value, their share, severity and code; one grouped pass over the rows.

    A field is found under any of its names; without a column it is missing in every row.  Complete fields have no code.
    """
    names = {f: next((a for a in ALTERNATES.get(f, (f,)) if a in df.columns), None) for fields in REQUIRED.values() for f in fields}
    found = df.groupBy(feed).agg(F.count(F.lit(1)).alias("rows"), *[
        (F.count_if(F.col(f"`{name}`").isNull()) if name else F.count(F.lit(1))).alias(f"_{f}") for f, name in names.items()])
    rows = None
    for kind, fields in REQUIRED.items():
        here = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("missing"), F.lit(names[f] is not None).alias("present"),
                                  F.lit("error" if f in FATAL else "warn").alias("severity")) for f in fields])
        rows = F.when(F.col(feed) == kind, here) if rows is None else rows.when(F.col(feed) == kind, here)
    out = found.select(F.col(feed).alias("feed_type"), "rows", F.explode(rows).alias("r")).select("feed_type", "rows", "r.*")
    code = F.when(~F.col("present"), F.concat(F.lit("MISSING_"), F.upper("field"))).when(F.col("missing") > 0, F.concat(F.lit("NULL_"), F.upper("field")))
    return out.select("feed_type", "field", "rows", "missing", (F.col("missing") / F.col("rows")).alias("share"),
                      F.when(code.isNotNull(), F.col("severity")).alias("severity"), code.alias("code"))


def max_age(feed_type: Column) -> Column:
    return F.when(feed_type == "service_alerts", 900).otherwise(90)


def feed_metrics(df: DataFrame, as_of_epoch: Column, expected_trips: int = 5000, expected_routes: int = 300) -> DataFrame:
    """Per feed: rows, age, bounds, speed, ids, delays and coverage, from one grouped pass (plus distinct counts)."""
    lat, lon = F.col("latitude"), F.col("longitude")
    outside = (lat < LAT_RANGE[0]) | (lat > LAT_RANGE[1]) | (lon < LON_RANGE[0]) | (lon > LON_RANGE[1])
    base = df.groupBy("feed_type").agg(
        F.count(F.lit(1)).alias("n_rows"), (as_of_epoch - F.max("timestamp")).cast("double").alias("feed_age_seconds"),
        F.sum(flag(outside)).alias("out_of_bounds"), F.sum(flag(F.col("speed") > 80)).alias("implausible_speed"),
        F.sum(flag(F.col("vehicle_id").isNull())).alias("null_vehicle_id"), F.sum(flag(F.col("delay") < -300)).alias("large_negative_delay"))
    for c, out in (("vehicle_id", "distinct_vehicles"), ("trip_id", "distinct_trips"), ("route_id", "distinct_routes")):
        # Two plain aggregations instead of several distinct counts at once, which would expand every row.
        pairs = df.filter(F.col(c).isNotNull()).groupBy("feed_type", c).agg(F.lit(1).alias("_one"))
        base = base.join(pairs.groupBy("feed_type").agg(F.count("_one").alias(out)), "feed_type", "left")
    base = base.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("distinct_vehicles", "distinct_trips", "distinct_routes")})
    nulls = (F.col("null_vehicle_id") > 0).cast("long")
    return base.withColumns({
        "duplicate_ids": F.col("n_rows") - F.col("distinct_vehicles") - nulls,
        "coverage_trips_pct": F.when(F.col("feed_type") == "trip_updates", F.least(F.lit(100.0), F.col("distinct_trips") / expected_trips * 100)),
        "coverage_routes_pct": F.when(F.col("feed_type") == "vehicle_positions", F.least(F.lit(100.0), F.col("distinct_routes") / expected_routes * 100)),
    })


def clock_reversals(df: DataFrame, arrival: str, row_id: str) -> DataFrame:
    """Per feed, rows whose clock runs behind the row that arrived before."""
    flagged = with_windows(df.select("feed_type", arrival, row_id, "timestamp"), ["feed_type"], [arrival, row_id], ["timestamp"], [
        lambda w: {"back": flag(F.lag("timestamp").over(w) > F.col("timestamp"))}], back=1)
    return flagged.groupBy("feed_type").agg(F.sum("back").alias("clock_reversals"))


def issues(metrics: DataFrame, reversals: DataFrame | None = None) -> DataFrame:
    """Issue rows (feed_type, severity, code, n) from the metrics."""
    m = metrics if reversals is None else metrics.join(reversals, "feed_type", "left")
    age, limit = F.col("feed_age_seconds"), max_age(F.col("feed_type"))
    vp = F.col("feed_type") == "vehicle_positions"
    one = F.lit(1).cast("long")

    def row(cond: Column, severity: str, code: str, n: Column = one) -> Column:
        return F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), n.cast("long").alias("n")))

    found = [
        row(age > limit, "error", "STALE_FEED"), row((age > limit * 0.7) & (age <= limit), "warn", "AGING_FEED"),
        row(vp & (F.col("out_of_bounds") > 0), "warn", "OUT_OF_BOUNDS", F.col("out_of_bounds")),
        row(vp & (F.col("implausible_speed") > 0), "warn", "IMPLAUSIBLE_SPEED", F.col("implausible_speed")),
        row(F.col("null_vehicle_id") > 0, "warn", "NULL_VEHICLE_ID", F.col("null_vehicle_id")),
        row(vp & (F.col("duplicate_ids") > F.col("n_rows") * 0.1), "warn", "EXCESSIVE_DUPLICATES", F.col("duplicate_ids")),
        row(F.col("large_negative_delay") > 0, "warn", "LARGE_NEGATIVE_DELAY", F.col("large_negative_delay")),
    ]
    if reversals is not None:
        found.append(row(F.col("clock_reversals") > 0, "warn", "NON_MONOTONIC_TS"))
    return m.select("feed_type", F.explode(F.array_compact(F.array(*found))).alias("i")).select("feed_type", "i.*")


def score(metrics: DataFrame, issue_rows: DataFrame) -> DataFrame:
    """Validation score 0 to 100: errors weigh three, warnings one, plus a penalty for age."""
    counts = issue_rows.groupBy("feed_type").agg(
        F.sum(F.when(F.col("severity") == "error", F.col("n")).otherwise(0)).alias("errors"),
        F.sum(F.when(F.col("severity") == "warn", F.col("n")).otherwise(0)).alias("warnings"))
    out = metrics.join(counts, "feed_type", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("errors", "warnings")})
    late = F.greatest(F.lit(0.0), F.least(F.lit(20.0), (F.coalesce("feed_age_seconds", F.lit(0.0)) - 90) / 10))
    raw = 100 - F.least(F.lit(50), F.col("errors") * 3) - F.least(F.lit(30), F.col("warnings")) - late
    return out.withColumn("validation_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))


def validate(df: DataFrame, as_of_epoch: Column, arrival: str, row_id: str) -> tuple[DataFrame, DataFrame]:
    """Issue rows and scored metrics of every feed in the table."""
    metrics = feed_metrics(df, as_of_epoch)
    rows = issues(metrics, clock_reversals(df, arrival, row_id))
    return rows, score(metrics, rows)


def without_updates(vehicles: DataFrame, updates: DataFrame) -> DataFrame:
    """Vehicles whose trip has no trip update (anti join on the distinct trips)."""
    trips = updates.select("trip_id").filter("trip_id is not null").distinct()
    return vehicles.join(trips, "trip_id", "left_anti")
