"""Feature preparation fitted on the training rows: encoding, imputation, scaling, selection, lag features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.operators.quantiles import quantiles
from stopwise.ordered import with_running
from stopwise.skew import attach, lookup

CLIP = 1e15


def long_form(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, v) rows of the non-null values."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]))
    return df.select(pairs.alias("p")).select("p.*").filter("v is not null and not isnan(v)")


def category_codes(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, code) with codes in value order, for however many values a feature has."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns]))
    values = train.select(pairs.alias("p")).select("p.*").filter("value is not null").distinct()
    found = with_running(values, ["feature"], ["value"], {"code": ("count", F.lit(1))})
    return found.withColumn("code", (F.col("code") - 1).cast("int"))


def ordinal_encode(df: DataFrame, codes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace the columns by their code, unknown or missing values by -1."""
    out = df
    for c in columns:
        table = codes.filter(F.col("feature") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        out = lookup(out.withColumn("_value", F.col(c).cast("string")), table, ["_value"]).withColumn(
            c, F.coalesce("_code", F.lit(-1))).drop("_value", "_code")
    return out


def medians(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exact median of each feature (one row per feature)."""
    return quantiles(long_form(train, features), ["feature"], "v", {"median": 0.5})


def impute(df: DataFrame, train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Fill with the training median (0 without one), replace infinities by 0, clip and narrow to float."""
    table = medians(train, features)
    # One row per feature: turned into a single map value inside the plan.
    lookup_map = table.agg(F.map_from_entries(F.collect_list(F.struct("feature", "median")))).scalar()
    rows = df.withColumn("_medians", lookup_map)
    def fixed(c: str) -> Column:
        x = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.try_element_at("_medians", F.lit(c)), F.lit(0.0))
        finite = F.when(F.abs(x) == F.lit(float("inf")), 0.0).otherwise(x)
        return F.least(F.greatest(finite, F.lit(-CLIP)), F.lit(CLIP)).cast("float")
    return rows.withColumns({c: fixed(c) for c in features}).drop("_medians")


def standard_scale(df: DataFrame, train: DataFrame, features: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation of the training rows; constant features are only centred."""
    stats = train.agg(F.struct(*[F.struct(F.avg(F.col(c).cast("double")).alias("m"), F.stddev_pop(F.col(c).cast("double")).alias("s")).alias(c) for c in features]).alias("_s"))
    rows = df.withColumn("_s", stats.scalar())
    return rows.withColumns({c: (F.col(c) - F.col(f"_s.{c}.m")) / F.when(F.col(f"_s.{c}.s") > 0, F.col(f"_s.{c}.s")).otherwise(1.0) for c in features}).drop("_s")


def correlation_filter(df: DataFrame, features: Sequence[str], limit: float = 0.95) -> DataFrame:
    """(feature, max_corr, keep): a feature goes when it correlates above the limit with an earlier one.  One pass."""
    f = list(features)
    pairs = [(i, j) for j in range(len(f)) for i in range(j)]
    wide = df.agg(*[F.abs(F.corr(F.col(f[i]).cast("double"), F.col(f[j]).cast("double"))).alias(f"c_{i}_{j}") for i, j in pairs])
    rows = F.array(*[F.struct(F.lit(f[j]).alias("feature"),
                              F.greatest(*[F.col(f"c_{i}_{j}") for i in range(j)], F.lit(0.0), F.lit(0.0)).alias("max_corr")) for j in range(len(f))])
    return wide.select(F.explode(rows).alias("r")).select("r.*").withColumn("keep", F.col("max_corr") <= limit)


def variance_filter(df: DataFrame, features: Sequence[str], threshold: float = 0.01) -> DataFrame:
    """(feature, variance, keep): population variance after filling with the median."""
    filled = impute(df, df, features)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.var_pop(F.col(c).cast("double")).alias("variance")) for c in features])
    return filled.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*").withColumn("keep", F.col("variance") > threshold)


def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 10, k: int | None = None) -> DataFrame:
    """Mutual information of each quantile-binned feature with the label, largest first."""
    inner = {f"e{i}": i / bins for i in range(1, bins)}
    edges = quantiles(long_form(df, features), ["feature"], "v", inner).select("feature", F.array(*inner).alias("edges"))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]))
    long = df.select(F.col(label).alias("y"), pairs.alias("p")).select("y", "p.*").filter("v is not null")
    cells = long.join(F.broadcast(edges), "feature").groupBy(
        "feature", F.size(F.filter("edges", lambda e: e <= F.col("v"))).alias("bin"), "y").agg(F.count(F.lit(1)).alias("n"))
    total = cells.groupBy("feature").agg(F.sum("n").alias("t"))
    by_bin = cells.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    by_y = cells.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    joined = cells.join(total, "feature").join(by_bin, ["feature", "bin"]).join(by_y, ["feature", "y"])
    out = joined.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n").cast("double") * F.col("t") / (F.col("nb") * F.col("ny")))).alias("mi"))
    out = out.orderBy(F.desc("mi"), "feature")
    return out.limit(k) if k else out


def stop_mean_features(df: DataFrame, train: DataFrame, value: str = "delay_sec", key: str = "stop_id", spread: str = "obs_id") -> DataFrame:
    """spatial_lag: training mean of the stop (mean of the stop means for unseen stops), and the row's difference."""
    means = train.groupBy(key).agg(F.avg(value).alias("spatial_lag"))
    overall = means.agg(F.avg("spatial_lag")).scalar()
    out = attach(df, means, [key], F.col(spread)).withColumn("spatial_lag", F.coalesce("spatial_lag", overall, F.lit(0.0)))
    return out.withColumn("spatial_lag_diff", F.col(value) - F.col("spatial_lag"))


def temporal_lag_features(df: DataFrame, value: str = "delay_sec", key: str = "route_id", time: str = "feed_timestamp", row_id: str = "obs_id") -> DataFrame:
    """Fallback without stops: the previous value of the route and the difference to it (0 for the first)."""
    from stopwise.ordered import with_windows

    out = with_windows(df, [key], [time, row_id], [value], [lambda w: {"temporal_lag": F.coalesce(F.lag(value).over(w), F.col(value))}], back=1)
    return out.withColumn("temporal_lag_diff", F.col("temporal_lag") - F.col(value))
