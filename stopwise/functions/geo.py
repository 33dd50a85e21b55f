"""Coordinates: distances, hubs, cells and the country box."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions.bins import flag

EARTH_KM = 6371.0

# Country box (latitude and longitude range).
LAT_RANGE = (50.75, 53.55)
LON_RANGE = (3.30, 7.20)

# The four main hubs.
HUBS = {
    "AMS": (52.3791, 4.9003),
    "UT": (52.0890, 5.1093),
    "RT": (51.9249, 4.4689),
    "DH": (52.0807, 4.3247),
}

# The eight hubs that a stop's nearest hub is looked for among.
ALL_HUBS = {
    **HUBS,
    "LEI": (52.1663, 4.4814),
    "SPL": (52.3094, 4.7625),
    "EHV": (51.4431, 5.4813),
    "AH": (51.9846, 5.9010),
}


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a1, a2 = F.radians(lat1), F.radians(lat2)
    half_lat = (a2 - a1) / 2
    half_lon = (F.radians(lon2) - F.radians(lon1)) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(half_lon), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(chord))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) * 1000


def hub_distances(df: DataFrame, lat: str = "stop_lat", lon: str = "stop_lon",
                  hubs: Mapping[str, tuple[float, float]] = HUBS) -> DataFrame:
    """Kilometres to each hub (one decimal), the smallest of them and its hub."""
    x, y = F.col(lat).try_cast("double"), F.col(lon).try_cast("double")
    dist = {name: F.bround(haversine_km(x, y, F.lit(a), F.lit(b)), 1) for name, (a, b) in hubs.items()}
    out = df.withColumns({f"dist_to_{n}_km": d for n, d in dist.items()})
    near = F.array_min(F.array(*[
        F.struct(F.col(f"dist_to_{n}_km").alias("km"), F.lit(i).alias("i"), F.lit(n).alias("hub"))
        for i, n in enumerate(hubs)]))
    known = F.col(f"dist_to_{next(iter(hubs))}_km").isNotNull()
    return out.withColumns({"min_dist_to_hub_km": F.when(known, near["km"]), "nearest_hub": F.when(known, near["hub"])})


def location_features(df: DataFrame, lat: str = "stop_lat", lon: str = "stop_lon") -> DataFrame:
    """Tenth-degree bins and cell, and the region flags."""
    x, y = F.col(lat).try_cast("double"), F.col(lon).try_cast("double")
    lat_bin, lon_bin = F.bround(x * 10).cast("long"), F.bround(y * 10).cast("long")
    return df.withColumns({
        "lat_bin": lat_bin, "lon_bin": lon_bin,
        "geo_cell": F.concat_ws("_", lat_bin.cast("string"), lon_bin.cast("string")),
        "is_north": flag(x > 52.3), "is_west": flag(y < 5.0),
        "is_randstad": flag((x > 51.85) & (x < 52.55) & (y > 4.3) & (y < 5.0)),
        "near_coast": flag((y < 4.6) | (y > 6.8)),
    })


def scale_bins(df: DataFrame, lat: str = "stop_lat", lon: str = "stop_lon", scales: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Cells at several scales, each coordinate scaled, rounded and scaled again as in the source convention."""
    def one(c: str, km: int) -> Column:
        f = 100 / km
        return (F.bround(F.col(c).try_cast("double") * f) * f).cast("long").cast("string")
    return df.withColumns({f"geo_bin_{km}km": F.concat_ws("_", one(lat, km), one(lon, km)) for km in scales})


def out_of_bounds(lat: Column, lon: Column) -> Column:
    """Missing, outside the country box, or at the origin."""
    return F.coalesce(
        (lat < LAT_RANGE[0]) | (lat > LAT_RANGE[1]) | (lon < LON_RANGE[0]) | (lon > LON_RANGE[1])
        | ((F.abs(lat) < 1) & (F.abs(lon) < 1)), F.lit(True)) | lat.isNull() | lon.isNull()


def clean_coordinates(df: DataFrame, lat: str, lon: str, drop: bool = False) -> DataFrame:
    """Null out (or drop) bad coordinates; the mask stays as ``bad_coordinates``."""
    bad = out_of_bounds(F.col(lat), F.col(lon))
    marked = df.withColumn("bad_coordinates", bad)
    if drop:
        return marked.filter(~F.col("bad_coordinates"))
    return marked.withColumns({c: F.when(~F.col("bad_coordinates"), F.col(c)) for c in (lat, lon)})


def geocoded_flags(df: DataFrame, lat: str = "first_lat", lon: str = "first_lon") -> DataFrame:
    x, y = F.col(lat), F.col(lon)
    return df.withColumns({
        "has_geocoded_location": flag(x.isNotNull() & y.isNotNull()),
        "in_netherlands": flag(x.between(*LAT_RANGE) & y.between(*LON_RANGE)),
    })
