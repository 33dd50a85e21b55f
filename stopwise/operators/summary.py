"""Report aggregates.  Each is one grouped pass with map-side partial aggregation; modes use a two-level count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions.bins import cut
from stopwise.operators.horizon import snapshot
from stopwise.operators.label import LABELS, disrupted
from stopwise.operators.quantiles import quantiles
from stopwise.operators.temporal import TIME


def share(cond: Column) -> Column:
    """Fraction of rows for which the condition holds."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def route_summary(df: DataFrame) -> DataFrame:
    """Per route: events, severity, alerts, delay and the percentage of each label, worst routes first."""
    aggs = [
        F.count(F.lit(1)).alias("total_stop_events"), F.avg("severity_score").alias("avg_severity"),
        F.max("severity_score").alias("max_severity"), F.sum(F.col("has_alert").cast("int")).alias("alert_count"),
    ]
    if "delay_min" in df.columns:
        aggs += [F.avg("delay_min").alias("avg_delay_min"), F.max("delay_min").alias("max_delay_min")]
    aggs += [(share(F.col("disruption_type") == t) * 100).alias(f"pct_{t.lower()}") for t in LABELS]
    if "route_short_name" in df.columns:
        aggs.append(F.min("route_short_name").alias("route_short_name"))
    return df.groupBy("route_id").agg(*aggs).orderBy(F.desc("avg_severity"), "route_id")


def _with_mode(df: DataFrame, key: str, label: str, sums: dict[str, Column], maxes: dict[str, Column] | None = None,
               mode: str = "mode") -> DataFrame:
    """Totals per key plus the most frequent label (ties: the smaller one), from one pass over (key, label)."""
    maxes = maxes or {}
    cells = df.groupBy(key, label).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()],
        *[F.count(c).alias(f"_c_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_m_{n}") for n, c in maxes.items()])
    return cells.groupBy(key).agg(
        F.sum("_n").alias("events"),
        *[F.try_divide(F.sum(f"_s_{n}"), F.sum(f"_c_{n}")).alias(n) for n in sums],
        *[F.max(f"_m_{n}").alias(n) for n in maxes],
        F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias(mode))


def hot_spots(df: DataFrame, top_n: int = 10) -> DataFrame:
    """Stops with the highest mean severity."""
    out = _with_mode(df, "stop_id", "disruption_type",
                     {"avg_severity": F.col("severity_score"), "avg_delay_min": F.col("delay_min")},
                     mode="top_disruption")
    return out.orderBy(F.desc("avg_severity"), "stop_id").limit(top_n)


def most_delayed(df: DataFrame, top_n: int = 20) -> DataFrame:
    """Trips with the highest mean delay."""
    out = _with_mode(df, "trip_id", "disruption_type", {"avg_delay_min": F.col("delay_min")},
                     {"max_delay_min": F.col("delay_min")}, mode="disruption_type_mode")
    return out.withColumnRenamed("events", "stop_events").orderBy(F.desc("avg_delay_min"), "trip_id").limit(top_n)


def time_profile(df: DataFrame, time: str = TIME) -> DataFrame:
    """Per hour of day: events, disrupted events, percentage."""
    return df.groupBy(F.hour(time).alias("hour")).agg(
        F.count(F.lit(1)).alias("total_events"), F.sum(disrupted().cast("int")).alias("disrupted_events"),
    ).withColumn("pct_disrupted", F.bround(F.col("disrupted_events") / F.col("total_events") * 100, 1))


def alert_breakdown(df: DataFrame) -> DataFrame:
    """Cause by effect counts of the rows with an alert."""
    return df.filter("has_alert").groupBy("alert_cause", "alert_effect").agg(
        F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "alert_cause", "alert_effect")


def disruption_density(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Disrupted events per stop, and their share per route."""
    stops = df.groupBy("stop_id").agg(F.sum(disrupted().cast("int")).alias("stop_disruption_count"))
    routes = df.groupBy("route_id").agg(share(disrupted()).alias("route_disruption_density"))
    return stops, routes


def add_disruption_density(df: DataFrame, spread: str = "obs_id", base: DataFrame | None = None) -> DataFrame:
    from stopwise.skew import attach

    source = base if base is not None else df
    stops, routes = disruption_density(source)
    # A route without any disruption has no density in the source semantics.
    routes = routes.withColumn("route_disruption_density",
                               F.when(F.col("route_disruption_density") > 0, F.col("route_disruption_density")))
    return attach(attach(df, stops, ["stop_id"], F.col(spread), source), routes, ["route_id"], F.col(spread), source)


def congestion(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events per stop and hour; distinct vehicles per route and hour."""
    hour = F.hour(TIME).alias("hour")
    per_stop = df.groupBy("stop_id", hour).agg(F.count(F.lit(1)).alias("stop_congestion_index"))
    pairs = df.filter(F.col("vehicle_id").isNotNull()).groupBy("route_id", hour, "vehicle_id").agg(F.lit(1).alias("_one"))
    per_route = pairs.groupBy("route_id", "hour").agg(F.count("_one").alias("vehicle_density"))
    return per_stop, per_route


def add_congestion(df: DataFrame, spread: str = "obs_id", base: DataFrame | None = None) -> DataFrame:
    from stopwise.skew import attach

    source = base if base is not None else df
    per_stop, per_route = congestion(source)
    rows, narrow = df.withColumn("hour", F.hour(TIME)), source.withColumn("hour", F.hour(TIME))
    rows = attach(rows, per_stop, ["stop_id", "hour"], F.col(spread), narrow)
    return attach(rows, per_route, ["route_id", "hour"], F.col(spread), narrow)


def add_dwell_anomaly(df: DataFrame, dwell: str = "dwell_time_sec", spread: str = "obs_id", base: DataFrame | None = None) -> DataFrame:
    """Dwell time against the mean of the stop; 0 when there is no dwell column."""
    from stopwise.ordered import with_totals

    if dwell not in df.columns:
        return df.withColumn("dwell_time_anomaly", F.lit(0.0))
    out = with_totals(df, ["stop_id"], [F.avg(dwell).alias("_mean")], spread=F.col(spread), base=base)
    return out.withColumn("dwell_time_anomaly", F.col(dwell) - F.col("_mean")).drop("_mean")


def speed_delay_correlation(df: DataFrame) -> DataFrame:
    """Pearson correlation of speed and delay per route; 0 for a single row."""
    return df.groupBy("route_id").agg(
        F.when(F.count(F.lit(1)) > 1, F.corr("speed", "delay_sec")).otherwise(0.0).alias("speed_delay_correlation"))


def add_interactions(df: DataFrame, spread: str = "obs_id", base: DataFrame | None = None) -> DataFrame:
    """Delay-speed ratio (clipped to ±100), product, and the route correlation."""
    from stopwise.operators.temporal import clip
    from stopwise.skew import attach

    d, s = F.col("delay_sec"), F.col("speed")
    out = df.withColumns({"delay_speed_ratio": clip(F.try_divide(d, s), -100, 100), "delay_speed_product": d * s})
    source = base if base is not None else df
    return attach(out, speed_delay_correlation(source), ["route_id"], F.col(spread), base=source)


def binned(df: DataFrame, keys: Sequence[str], minutes: int, means: Sequence[str], firsts: Sequence[str],
           maxes: Sequence[str] = (), time: str = TIME, tie: str = "obs_id") -> DataFrame:
    """Align streams on time bins: means of numbers, earliest value of text, maxima of targets."""
    return df.groupBy(*keys, snapshot(minutes, time).alias("bin")).agg(
        *[F.avg(c).alias(c) for c in means],
        *[F.min_by(c, F.struct(time, tie)).alias(c) for c in firsts],
        *[F.max(c).alias(c) for c in maxes], F.count(F.lit(1)).alias("n_rows"))


def spatial_stats(df: DataFrame, min_events: int = 3) -> DataFrame:
    """Rate, severity, delay and support per stop location."""
    return df.groupBy("stop_id", "stop_lat", "stop_lon").agg(
        share(disrupted()).alias("disruption_rate"), F.avg("severity_score").alias("mean_severity"),
        F.max("severity_score").alias("max_severity"), F.avg("delay_sec").alias("own_delay"),
        F.count(F.lit(1)).alias("n_events")).filter(F.col("n_events") >= min_events)


def hotspots_and_background(df: DataFrame, top_n: int = 3, min_events: int = 5) -> DataFrame:
    """Stops with their score, marked hot for the ``top_n`` and background for all others (anti join)."""
    stats = df.groupBy("stop_id", "stop_lat", "stop_lon").agg(
        F.avg("severity_score").alias("score"), F.count(F.lit(1)).alias("n_events")).filter(F.col("n_events") >= min_events)
    hot = stats.orderBy(F.desc("score"), "stop_id").limit(top_n)
    rest = stats.join(F.broadcast(hot.select("stop_id")), "stop_id", "left_anti")
    return hot.withColumn("part", F.lit("hot")).unionByName(rest.withColumn("part", F.lit("background")))


def hourly_evolution(df: DataFrame, n_hours: int = 4, min_events: int = 2) -> DataFrame:
    """Rate per stop for hours spread evenly over the day; each target hour takes the nearest hour in the data."""
    wanted = [int(23 * (i + 1) / (n_hours + 1)) for i in range(n_hours)]
    cells = df.groupBy(F.hour(TIME).alias("hour"), "stop_id", "stop_lat", "stop_lon").agg(
        share(disrupted()).alias("rate"), F.count(F.lit(1)).alias("n"))
    # At most 24 hours are present, so the choice of hours is a tiny table.
    targets = cells.select("hour").distinct().select("hour", F.explode(F.array(*map(F.lit, wanted))).alias("_target"))
    chosen = targets.groupBy("_target").agg(
        F.min_by("hour", F.struct(F.abs(F.col("hour") - F.col("_target")), "hour")).alias("hour"))
    return cells.join(F.broadcast(chosen.select("hour")), "hour", "left_semi").filter(F.col("n") >= min_events)


def spatiotemporal_bins(df: DataFrame, minutes: int = 60, min_events: int = 3, max_stops: int = 5) -> DataFrame:
    """Rate, severity and support per stop and time bin for the busiest stops, with the display colour."""
    cells = df.groupBy("stop_id", "stop_lat", "stop_lon", snapshot(minutes).alias("time_bin")).agg(
        share(disrupted()).alias("disruption_rate"), F.avg("severity_score").alias("severity"),
        F.count(F.lit(1)).alias("n_events"))
    totals = cells.groupBy("stop_id").agg(F.sum("n_events").alias("_total")).filter(F.col("_total") >= min_events)
    top = totals.orderBy(F.desc("_total"), "stop_id").limit(max_stops).select("stop_id")
    rate = F.col("disruption_rate")
    colour = (F.when(rate.isNull(), "#808080").when(rate < 0.05, "#1a9850").when(rate < 0.15, "#fee08b")
              .when(rate < 0.30, "#fdae61").otherwise("#d73027"))
    return cells.join(F.broadcast(top), "stop_id", "left_semi").withColumn("colour", colour)


def dashboard_rollup(df: DataFrame) -> DataFrame:
    """Long table of the dashboard figures, all from one pass with grouping sets."""
    view = df.select(
        F.col("disruption_type").alias("label"), F.date_trunc("hour", TIME).alias("hour"), "route_id", "stop_id",
        "delay_min", disrupted().cast("int").alias("bad"))
    sets = view.groupingSets(
        [[], [F.col("label")], [F.col("hour")], [F.col("route_id")], [F.col("stop_id")]],
        F.col("label"), F.col("hour"), F.col("route_id"), F.col("stop_id"),
    ).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.sum("bad").alias("active"),
          F.avg("delay_min").alias("avg_delay"), F.avg(F.col("bad").cast("double")).alias("rate"))
    kind = (F.when(F.col("_g") == 15, "total").when(F.col("_g") == 7, "label").when(F.col("_g") == 11, "hour")
            .when(F.col("_g") == 13, "route").otherwise("stop"))
    key = F.coalesce("label", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"), "route_id", "stop_id", F.lit(""))
    return sets.select(kind.alias("section"), key.alias("key"), "n", "active", "avg_delay", "rate")


def grid_hotspots(df: DataFrame, lat: str = "stop_lat", lon: str = "stop_lon") -> DataFrame:
    """Mean delay per 0.01 degree cell."""
    return df.groupBy((F.bround(F.col(lat) * 100) / 100).alias("grid_lat"),
                      (F.bround(F.col(lon) * 100) / 100).alias("grid_lon")).agg(F.avg("delay_min").alias("avg_delay"))


def kpis(df: DataFrame, score: str = "score") -> DataFrame:
    """Mean delay, active disruptions, on-time percentage, mean confidence and normal count."""
    return df.agg(
        F.avg("delay_min").alias("avg_delay"), F.sum(disrupted().cast("int")).alias("active"),
        (share(~disrupted()) * 100).alias("on_time_pct"), (F.avg(score) * 100).alias("confidence_pct"),
        F.sum((~disrupted()).cast("int")).alias("normal"))


def label_mix(df: DataFrame, column: str = "disruption_type") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    return df.groupBy((F.floor(F.col(column) / width) * width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def null_audit(df: DataFrame, above: float = 50.0) -> DataFrame:
    """Percentage of nulls of each column in one pass; only columns above the limit."""
    wide = df.agg(*[(share(F.col(c).isNull()) * 100).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "feature", "null_pct").filter(F.col("null_pct") > above)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def heat_map(df: DataFrame, routes: Sequence[str]) -> DataFrame:
    """Hour by route mean delay, one column per named route."""
    return df.groupBy(F.hour(TIME).alias("hour")).pivot("route_id", list(routes)).agg(F.avg("delay_min"))


def duration_buckets(df: DataFrame, hours: str, flags: Sequence[str]) -> DataFrame:
    """Sum and mean of the flags per alert duration bucket (right-closed)."""
    bucket = cut(F.col(hours), [0, 1, 6, 24, 48, float("inf")], ["<1h", "1-6h", "6-24h", "24-48h", ">48h"])
    return df.withColumn("duration_bucket", bucket).filter("duration_bucket is not null").groupBy("duration_bucket").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f"{f}_sum") for f in flags],
        *[F.avg(F.col(f).cast("double")).alias(f"{f}_mean") for f in flags])


def modal_values(df: DataFrame, key: str, columns: Sequence[str], mean: str) -> DataFrame:
    """Most frequent value of each column per key (ties: smallest) and the mean of a number."""
    out = df.groupBy(key).agg(F.avg(mean).alias(f"mean_{mean}"))
    for c in columns:
        cells = df.filter(F.col(c).isNotNull()).groupBy(key, c).agg(F.count(F.lit(1)).alias("_n"))
        modes = cells.groupBy(key).agg(F.min_by(c, F.struct(-F.col("_n"), F.col(c))).alias(f"mode_{c}"))
        out = out.join(modes, key, "left")
    return out


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, std, min, max, zeros and nulls of each number column, long form, one pass."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs.append(F.struct(
            F.lit(c).alias("feature"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
            F.max(x).alias("max"), F.sum((x == 0).cast("int")).alias("zeros"),
            F.sum(x.isNull().cast("int")).alias("nulls")).alias(c))
    return df.agg(*aggs).select(F.explode(F.array(*columns)).alias("p")).select("p.*")


def time_profile_check(df: DataFrame, time: str = TIME) -> DataFrame:
    """Rows, distinct instants, duplicates and range of a clock column."""
    per = df.groupBy(time).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(F.sum("_n").alias("n_rows"), F.sum(F.when(F.col(time).isNotNull(), F.col("_n"))).alias("n_times"),
                   F.sum(F.col("_n") - 1).alias("duplicated"), F.min(time).alias("first"), F.max(time).alias("last"))


def prediction_stats(df: DataFrame, probability: str, latency: str) -> DataFrame:
    """Count, mean probability, rate above one half and largest latency of a batch of predictions."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("mean_probability"),
                  share(F.col(probability) > 0.5).alias("disruption_rate"), F.max(latency).alias("max_latency"))


def latency_report(df: DataFrame, latency: str) -> DataFrame:
    """Mean, median, p95, p99, min, max of a latency in ms and the resulting calls per second."""
    q = quantiles(df, [], latency, {"median_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    x = F.col(latency)
    base = df.agg(F.avg(x).alias("mean_ms"), F.min(x).alias("min_ms"), F.max(x).alias("max_ms"),
                  F.try_divide(F.count(x) * F.lit(1000.0), F.sum(x)).alias("throughput_per_s"))
    return base.withColumns({c: q.select(c).scalar() for c in ("median_ms", "p95_ms", "p99_ms")})


def interval_shift(df: DataFrame, horizon_rows: int = 30, assumed_sec: float = 60.0, tolerance_sec: float = 10.0,
                   key: str = "vehicle_id") -> DataFrame:
    """Positive gaps between a vehicle's observations: median, p10, p90, whether they are as even as assumed, and
    the minutes that ``horizon_rows`` rows span at each of the three."""
    from stopwise.operators.temporal import ID, seconds_between
    from stopwise.ordered import with_windows

    gaps = with_windows(df.select(key, TIME, ID), [key], [TIME, ID], [], [
        lambda w: {"gap_sec": seconds_between(F.col(TIME), F.lag(TIME).over(w))}], back=1)
    q = quantiles(gaps.filter(F.col("gap_sec") > 0), [], "gap_sec",
                  {"median_sec": 0.5, "p10_sec": 0.1, "p90_sec": 0.9})
    return q.withColumns({
        "uniform": F.abs(F.col("median_sec") - assumed_sec) < tolerance_sec,
        "horizon_min": F.col("median_sec") * horizon_rows / 60,
        "best_min": F.col("p10_sec") * horizon_rows / 60,
        "worst_min": F.col("p90_sec") * horizon_rows / 60,
    })
