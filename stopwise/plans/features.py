"""Feature builds: the operators chained over the fused stop events.

Every ordered or grouped step gets ``base``, the labelled input projected to the columns such steps read.  Hot-key
passes, carried rows and totals are derived from that short plan, so the chain is evaluated once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions import alerts as alert_fn
from stopwise.functions import clock, geo, text, weather
from stopwise.operators import graph, horizon, label, merge, past, spatial, summary, temporal, timetable
from stopwise.session import ALL_KEYS, cut_lineage, option
from stopwise.skew import buckets, hot_table, sharing_hot_keys

BASE = ("obs_id", "feed_timestamp", "trip_id", "route_id", "stop_id", "vehicle_id", "stop_sequence", "delay_sec", "speed",
        "disruption_type", "severity_score", "has_alert", "stop_lat", "stop_lon", "dwell_time_sec", "sched_arr_sec")

#: Rows up to which ``enrich`` joins the schedule in one go; more are joined in so many shares.
WHOLE_ROWS = 10_000_000
SHARES = 4


def base_of(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in BASE if c in df.columns])


def ingest(local: dict[str, DataFrame], live: dict[str, DataFrame] | None = None) -> DataFrame:
    """Feeds (and, when given, live feeds behind the local ones) fused into one table of stop events."""
    feeds = dict(local)
    for name, extra in (live or {}).items():
        feeds[name] = merge.union_feeds(feeds[name], extra) if name in feeds else extra
    return merge.merge_feeds(feeds["vehicle_positions"], feeds["trip_updates"], feeds["alerts"])


def prepared(df: DataFrame, dims: dict[str, DataFrame] | None = None) -> DataFrame:
    """Flags, static columns, alert indicator and label: everything that needs one row only."""
    out = label.as_strings(df, ["trip_id", "stop_id", "vehicle_id", "route_id", "agency_id"])
    out = label.flag_speed(label.flag_delay(out))
    if dims:
        out = merge.star_join(out, dims)
    if "has_alert" not in out.columns:
        seen = F.col("alert_text").isNotNull() if "alert_text" in out.columns else label.column_or(out, "has_overlapping_alert", F.lit(False))
        out = out.withColumn("has_alert", seen)
    return label.classify(out)


@sharing_hot_keys
def build_features(df: DataFrame, dims: dict[str, DataFrame] | None = None, prediction_time: Column | None = None,
                   as_of: bool = False) -> DataFrame:
    """The full feature table of the observations, label first so that no later step reads it too early.

    Headway, disruption, spatial, dwell, congestion and correlation columns describe the whole table, later rows included.  With
    ``as_of`` the same columns take only the rows up to each row, as a table to train on must.
    """
    out = prepared(df, dims)
    base = base_of(out)
    cols = set(out.columns)
    if {"stop_sequence", "trip_id"} <= cols:
        out = temporal.trip_progress(out, base=base)
    if "stop_id" in cols:
        out = temporal.previous_at_stop(out, base=base)
    if {"route_id", "stop_id"} <= cols:
        out = (past.headway_stability if as_of else temporal.headway_stability)(out, base=base)
        out = (past.disruption_density if as_of else summary.add_disruption_density)(out, base=base)
    if {"stop_lat", "stop_lon"} <= cols:
        out = (past.spatial_lag if as_of else spatial.spatial_lag)(out, base=base)
    out = horizon.alert_count_last_hour(out, base=base)
    out = (past.dwell_anomaly if as_of else summary.add_dwell_anomaly)(out, base=base)
    if "vehicle_id" in cols:
        out = (past.congestion if as_of else summary.add_congestion)(out, base=base)
    out = temporal.route_trend(out, base=base)
    out = (past.interactions if as_of else summary.add_interactions)(out, base=base)
    out = clock.holiday_features(clock.time_buckets(clock.cyclic_features(clock.calendar_parts(out, "feed_timestamp"))), "feed_timestamp")
    out = alert_features(out, prediction_time)
    for c in ("betweenness_centrality", "pagerank", "network_disruption_load", "network_load_normalized"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(0.0))
    return out


def alert_features(df: DataFrame, prediction_time: Column | None = None) -> DataFrame:
    """Timing, codes and text features of the alert columns that are present."""
    out = df
    start = label.resolve_col(out, ("active_period_start", "alert_start"))
    end = label.resolve_col(out, ("active_period_end", "alert_end"))
    if start and end:
        out = clock.alert_timing(out, start, end, as_of=prediction_time)
    elif "alert_duration_min" not in out.columns:
        out = out.withColumn("alert_duration_min", F.lit(0.0))
    cause, effect = label.resolve_col(out, ("cause", "alert_cause")), label.resolve_col(out, ("effect", "alert_effect"))
    if cause and effect:
        out = alert_fn.cause_effect_codes(out, cause, effect)
    body = label.resolve_col(out, ("description_text", "alert_text", "header_text", "text"))
    return text_features(out, body) if body else out


def text_features(df: DataFrame, body: str, lang: str | None = None) -> DataFrame:
    """All text families on one text column."""
    out = text.contact_flags(text.mode_mentions(text.keyword_severity(text.complexity(df, body), body), body), body)
    return text.language_flags(text.sentiment(text.taxonomy_scores(out, body), body), lang)


@sharing_hot_keys
def enrich(df: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Timetable enrichment: dimensions, schedule, deviation, second peak set, delay, headway and speed features.

    The joined schedule is written if a trip or stop is hot, for slicing reads it several times.  Without hot ones it is read once.  Many
    rows are written too, a share of the trips at a time: that needs the disk of one share's shuffles besides what is written.
    """
    # Without hot keys the base serves to count only, and the rows of df are counted without the joins.
    base = base_of(df)
    hot = any(hot_table(base, [key]) is not None for key in ("trip_id", "stop_id"))
    out = timetable.join_schedule(df, timetable.schedule(dims["stop_times"]), base=base)
    if hot:
        out = cut_lineage(out)
        base = base_of(out)
    elif buckets(base, ["trip_id"])[2] > WHOLE_ROWS:
        # No trip is hot, so the rows of a trip may stay together for the join by trip and stop.
        with option(df.sparkSession, ALL_KEYS, "false", "true"):
            out = cut_lineage(out, *[F.pmod(F.xxhash64("trip_id"), F.lit(SHARES)) == i for i in range(SHARES)])
    out = timetable.add_dimensions(out, dims, base=base)
    out = timetable.schedule_deviation(out) if "actual_time_sec" in out.columns else out
    out = timetable.delay_features(clock.enricher_time(out, "feed_timestamp"))
    out = temporal.scheduled_headway(out, base=base)
    return temporal.change_features(timetable.speed_features(out), base=base)


@sharing_hot_keys
def early_warning(df: DataFrame, horizons: dict[str, int] | None = None) -> DataFrame:
    """Look-back block, forward targets and route snapshots of labelled observations."""
    base = base_of(df)
    out = temporal.trend_block(df, base=base)
    out = horizon.forward_targets(out, horizons or horizon.HORIZONS, base=base)
    return horizon.add_route_snapshots(out, base=base)


@dataclass(frozen=True)
class Families:
    """Switches of the feature families."""

    temporal: bool = True
    geospatial: bool = True
    headway: bool = True
    network: bool = True
    text: bool = True


@sharing_hot_keys
def family_features(df: DataFrame, dims: dict[str, DataFrame] | None = None, on: Families = Families()) -> DataFrame:
    """The five feature families, each behind its switch."""
    base, out = base_of(df), df
    if on.temporal:
        out = clock.time_buckets(clock.cyclic_features(clock.calendar_parts(out, "feed_timestamp")))
        out = temporal.trip_rolling(temporal.row_lags(out, base=base), base=base)
    if on.geospatial and "stop_lat" in df.columns:
        out = geo.scale_bins(geo.hub_distances(geo.location_features(out)))
        out = temporal.sequence_position(out, base=base)
    if on.headway:
        out = temporal.trip_neighbours(temporal.stop_block(out, base=base), base=base)
    if on.network:
        out = timetable.network_defaults(timetable.add_dimensions(out, dims) if dims else out)
    body = label.resolve_col(df, ("description_text", "alert_text", "header_text", "text"))
    if on.text and body:
        out = text_features(out, body)
    return out


def network_features(df: DataFrame, stop_times: DataFrame, sources: int | None = None) -> DataFrame:
    """Headway profile, calendar, centrality and disruption load."""
    base = base_of(df)
    out = clock.holiday_features(temporal.headway_profile(df, base=base), "feed_timestamp")
    return graph.centrality_features(out, stop_times, sources)


def weather_features(df: DataFrame, table: DataFrame | None = None, time: str = "feed_timestamp", mode: str = "bus") -> DataFrame:
    """Weather joined by hour with thresholds, impacts, mode score and codes; placeholders without a table."""
    if table is None:
        return weather.placeholder(df, time)
    out = weather.impacts(weather.threshold_flags(merge.join_weather(df, table, time)))
    out = weather.mode_score(weather.season_flags(out, time), mode)
    return weather.code_features(out) if "weather_code" in out.columns else out


def place_features(df: DataFrame, gazetteer, body: str) -> DataFrame:
    """Place of the alert text, cleaned coordinates, risk label and country flags."""
    out = geo.clean_coordinates(merge.locate(df, gazetteer, body), "first_lat", "first_lon")
    out = geo.geocoded_flags(out)
    if "disruption_target" in out.columns and "risk_level" not in out.columns:
        out = out.withColumn("risk_level", label.risk_label(F.col("disruption_target")))
    return out
