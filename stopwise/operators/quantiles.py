"""Exact quantiles and ranks without collecting a group into one task.

Rows are first counted per distinct value (map-side combined); the counts are accumulated along the value with the
slot-wise running sum, and each quantile is read off the accumulated counts.  The result equals linear interpolation
between the two neighbouring order statistics.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.ordered import with_running


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their count, the count up to and including them, and the number of values of the key."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))
    return with_running(counts, list(keys), ["_v"], {"_cum": ("sum", F.col("_c"))})


def quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float]) -> DataFrame:
    """One row per key with the named quantiles of ``value`` (nulls skipped)."""
    keys = list(keys)
    if not keys:
        return quantiles(df.select(F.lit(0).alias("_all"), value), ["_all"], value, wanted).drop("_all")
    line = value_counts(df, keys, value)
    sizes = line.groupBy(*keys).agg(F.max("_cum").alias("_n"))
    # At most one row per key and quantile bound is kept; the key count is carried by a join of aggregates.
    joined = line.join(sizes, keys)
    picks = []
    for i, share in enumerate(wanted.values()):
        at = (F.col("_n") - 1) * F.lit(float(share))
        picks += [F.min(F.when(F.col("_cum") > F.floor(at), F.col("_v"))).alias(f"_lo{i}"),
                  F.min(F.when(F.col("_cum") > F.ceil(at), F.col("_v"))).alias(f"_hi{i}")]
    read = joined.groupBy(*keys, "_n").agg(*picks)
    out = []
    for i, (name, share) in enumerate(wanted.items()):
        at = (F.col("_n") - 1) * F.lit(float(share))
        weight = at - F.floor(at)
        out.append((F.col(f"_lo{i}") * (F.lit(1.0) - weight) + F.col(f"_hi{i}") * weight).alias(name))
    return read.select(*keys, *out)


def median_of(df: DataFrame, value: str):
    """Median of a column as a scalar expression (evaluated once, inside the plan)."""
    return quantiles(df, [], value, {"_median": 0.5}).scalar()
