"""Neighbourhood operators on coordinates.

Rows are first collapsed to one (sum, count) per distinct coordinate, i.e. per stop location.  Locations are put on a
grid with cells as wide as the radius; a location is compared with those of its own and the eight adjacent cells, and
the partial sums of its matches are aggregated at once.  Row volume therefore never enters the comparison, only the
number of distinct locations does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions.geo import EARTH_KM, haversine_km
from stopwise.skew import attach

#: Stops of one location that are kept in a list.
BLOCK = 64


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("long")


def _neighbour_pairs(points: DataFrame, lat: str, lon: str, lat_size: float, lon_size: float) -> DataFrame:
    """Each point (columns as they are) next to every point ``_o`` of its 3x3 cells."""
    steps = F.sequence(F.lit(-1), F.lit(1))
    left = (
        points.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
        .withColumn("_cx", _cell(F.col(lat), lat_size) + F.col("_dx"))
        .withColumn("_cy", _cell(F.col(lon), lon_size) + F.col("_dy")).drop("_dx", "_dy")
    )
    right = points.select(_cell(F.col(lat), lat_size).alias("_cx"), _cell(F.col(lon), lon_size).alias("_cy"),
                          F.struct(*points.columns).alias("_o"))
    return left.join(right, ["_cx", "_cy"]).drop("_cx", "_cy")


def neighbour_locations(points: DataFrame, lat: str, lon: str, radius: float) -> DataFrame:
    """Each location next to every location ``_o`` (itself included) whose latitude and longitude both differ by less than the radius."""
    return _neighbour_pairs(points, lat, lon, radius, radius).filter(
        (F.abs(F.col("_o")[lat] - F.col(lat)) < radius) & (F.abs(F.col("_o")[lon] - F.col(lon)) < radius))


def _lag(df: DataFrame, lat: str, lon: str, value: str, radius: float, near, row_id: str, out: str,
         base: DataFrame | None = None) -> DataFrame:
    source = base if base is not None else df
    points = source.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(lat, lon).agg(
        F.sum(value).alias("_s"), F.count(value).alias("_c"))
    pairs = _neighbour_pairs(points, lat, lon, radius, radius).filter(
        near(F.col("_o")[lat] - F.col(lat), F.col("_o")[lon] - F.col(lon)))
    around = pairs.groupBy(lat, lon).agg(F.sum("_o._s").alias("_sum"), F.sum("_o._c").alias("_cnt"))
    rows = attach(df, around, [lat, lon], F.col(row_id), base=source)
    own = F.col(value)
    others = F.col("_cnt") - F.when(own.isNotNull(), 1).otherwise(0)
    return rows.withColumn(out, F.when(others > 0, (F.col("_sum") - F.coalesce(own, F.lit(0.0))) / others)).drop("_sum", "_cnt")


def spatial_lag(df: DataFrame, lat: str = "stop_lat", lon: str = "stop_lon", value: str = "delay_sec",
                radius: float = 0.01, row_id: str = "obs_id", base: DataFrame | None = None) -> DataFrame:
    """spatial_lag_delay: mean of the other rows whose latitude and longitude both differ by less than the radius."""
    return _lag(df, lat, lon, value, radius, lambda dx, dy: (F.abs(dx) < radius) & (F.abs(dy) < radius), row_id,
                "spatial_lag_delay", base)


def spatial_lag_radius(df: DataFrame, lat: str = "stop_lat", lon: str = "stop_lon", value: str = "delay_sec",
                       radius: float = 0.01, row_id: str = "obs_id") -> DataFrame:
    """The same within a circle (degrees), per stop with the stop's own mean and support."""
    rows = _lag(df, lat, lon, value, radius, lambda dx, dy: F.sqrt(dx * dx + dy * dy) < radius, row_id, "_lag")
    return rows.groupBy("stop_id", lat, lon).agg(
        F.avg("_lag").alias("spatial_lag"), F.avg(value).alias("own_delay"), F.count("_lag").alias("n_events"),
    ).filter(F.col("spatial_lag").isNotNull())


def _blocks(points: DataFrame) -> DataFrame:
    """``lat, lon, _ids``: the stops of each location in lists of about ``BLOCK``, repeated ids included."""
    same = points.groupBy("lat", "lon", "stop_id").agg(F.count(F.lit(1)).alias("_m"))
    sizes = same.groupBy("lat", "lon").agg(F.sum("_m").alias("_stops"))
    sized = attach(same, sizes, ["lat", "lon"], F.col("stop_id"), base=points)
    cut = sized.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1, F.lit(BLOCK).cast("long"))))
    copies = F.array_repeat("stop_id", F.least(F.col("_m") - F.col("_at"), F.lit(BLOCK)).cast("int"))
    block = F.pmod(F.xxhash64("stop_id", "_at"), F.ceil(F.col("_stops") / BLOCK))
    return cut.groupBy("lat", "lon", block.alias("_block")).agg(F.flatten(F.collect_list(copies)).alias("_ids")).drop("_block")


def _band_width(band: Column, lat_size: float, max_km: float) -> Column:
    """Degrees of longitude that hold ``max_km`` anywhere in a band of latitudes and in the two beside it."""
    edge = F.radians(F.greatest(F.abs(band - 1), F.abs(band + 2)) * F.lit(lat_size))
    half = F.lit(math.sin(min(max_km / (2 * EARTH_KM), math.pi / 2))) / F.cos(edge)
    return F.when((edge < math.pi / 2) & (half < 1), F.degrees(2 * F.asin(half)) * (1 + 1e-6)).otherwise(360.0)


def proximity_edges(stops: DataFrame, max_km: float = 1.0) -> DataFrame:
    """Directed edges between stops within ``max_km``; weight falls with the distance, at least 0.1.

    Locations are compared, each once, and the edges of their stops follow from lists of at most some ``BLOCK`` ids, so neither stops
    nor edges are moved for the comparison.  Cells are as wide as the radius at the latitude of their band, so no pair in range is missed
    (pairs across the date line aside).
    """
    finite = lambda c: F.abs(c) < float("inf")  # noqa: E731 - no value and no number are not in range of anything
    points = stops.select("stop_id", F.col("stop_lat").try_cast("double").alias("lat"), F.col("stop_lon").try_cast("double").alias("lon"))
    blocks = _blocks(points.filter(F.col("stop_id").isNotNull() & finite(F.col("lat")) & finite(F.col("lon"))))
    lat_size = max_km / 111.0

    def cell(band: Column) -> Column:
        return F.floor(F.col("lon") / _band_width(band, lat_size, max_km)).cast("long")

    steps = F.sequence(F.lit(-1), F.lit(1))
    left = blocks.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps)).withColumn(
        "_cx", _cell(F.col("lat"), lat_size) + F.col("_dx")).withColumn("_cy", cell(F.col("_cx")) + F.col("_dy")).drop("_dx", "_dy")
    right = blocks.withColumn("_cx", _cell(F.col("lat"), lat_size)).select("_cx", cell(F.col("_cx")).alias("_cy"), F.struct("lat", "lon", "_ids").alias("_o"))
    # The tables are small and their join is not: it is neither broadcast nor merged into few tasks.
    n = int(stops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = left.repartition(n, "_cx", "_cy").join(right.repartition(n, "_cx", "_cy").hint("merge"), ["_cx", "_cy"])
    near = pairs.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("_o.lat"), F.col("_o.lon"))).filter(F.col("km") <= max_km)
    edges = near.select("_ids", F.col("_o._ids").alias("_others"), "km", F.greatest(F.lit(0.1), 1.0 - F.col("km") / max_km).alias("weight"))
    return edges.select(F.explode("_ids").alias("src"), "_others", "km", "weight").select(
        "src", F.explode("_others").alias("dst"), "km", "weight").filter(F.col("src") != F.col("dst"))
