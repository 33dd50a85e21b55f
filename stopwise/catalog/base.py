"""Small helpers for the query catalogue: result shaping on the Spark side and in the check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopwise.testbed import views as tv

Query = Callable[[SparkSession, str], DataFrame]
VIEWS = {"obs": tv.OBS_SQL, "stop_times": tv.STOP_TIMES_SQL, "trips": tv.TRIPS_SQL, "routes": tv.ROUTES_SQL,
         "agency": tv.AGENCY_SQL, "stops": tv.STOPS_SQL, "feeds": tv.FEEDS_SQL, "transfers": tv.TRANSFERS_SQL,
         "calendar": tv.CALENDAR_SQL, "shapes": tv.SHAPES_SQL, "trip_obs": tv.TRIP_OBS_SQL, "weather": tv.WEATHER_SQL}


def nudge(digits: int) -> float:
    """Small shift off the exact halves, which the two engines round differently."""
    return float(f"3.7e-{digits + 3}")


def rounded(value: Column, digits: int) -> Column:
    """``F.round`` of doubles without decimal arithmetic, to the same bits.

    Below 2**40 the scaled value is off by less than 2**-12, so only values that close to a half are left to ``F.round``.  A whole
    number divided by a power of ten is the double next to the quotient, as it is when a decimal becomes a double.
    """
    scaled = value * F.lit(10.0**digits)
    whole = F.rint(scaled)
    plain = (F.abs(scaled) < F.lit(2.0**40)) & (F.abs(scaled - whole) < F.lit(0.499))
    return F.when(plain, whole / F.lit(10.0**digits)).otherwise(F.round(value, digits))


def tidy(df: DataFrame, names: str = "", digits: int = 6) -> DataFrame:
    """Chosen columns with whole numbers as long and doubles rounded, so both engines compare exactly."""
    cols = names.split() or df.columns
    out = []
    for name in cols:
        kind = df.schema[name].dataType
        if isinstance(kind, T.IntegralType):
            out.append(F.col(name).cast("long").alias(name))
        elif isinstance(kind, T.BooleanType):
            out.append(F.col(name))
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            out.append((rounded(F.col(name).cast("double") + nudge(digits), digits) + F.lit(0.0)).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def sql(spec: str, body: str, views: str = "obs", digits: int = 6, ctes: str = "") -> str:
    """Check query: ``spec`` lists output columns as ``name:i`` (whole), ``name:f`` (rounded) or ``name``."""
    cols = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        if kind == "i":
            cols.append(f"CAST({name} AS BIGINT) AS {name}")
        elif kind == "f":
            cols.append(f"round(CAST({name} AS DOUBLE) + {nudge(digits)}, {digits}) + 0.0 AS {name}")
        else:
            cols.append(name)
    parts = [VIEWS[v].strip() for v in views.split()] + ([ctes.strip()] if ctes else [])
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    return f"{head}SELECT {', '.join(cols)} FROM (\n{body}\n)"


def names(spec: str) -> str:
    return " ".join(item.partition(":")[0] for item in spec.split())


class Catalog:
    """Queries of one area with their check SQL."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, key: str, spec: str, build: Query, body: str | None = None, views: str = "obs", digits: int = 6,
            ctes: str = "") -> None:
        if key in self.queries:
            raise KeyError(key)
        columns = names(spec)
        self.queries[key] = lambda spark, sf_dir: tidy(build(spark, sf_dir), columns, digits)
        if body is not None:
            self.sql[key] = sql(spec, body, views, digits, ctes)
