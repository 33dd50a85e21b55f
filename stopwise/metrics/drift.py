"""Drift and performance monitoring: distribution shifts, degradation and sequential error detectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.metrics.classification import from_counts, ratio
from stopwise.operators.quantiles import quantiles
from stopwise.ordered import with_running, with_windows
from stopwise.skew import lookup


def _long(df: DataFrame, features: Sequence[str], side: int | None = None) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]))
    out = df.select(pairs.alias("p")).select("p.*").filter("v is not null")
    return out if side is None else out.withColumn("side", F.lit(side))


def psi(reference: DataFrame, current: DataFrame, features: Sequence[str], n_bins: int = 10, limit: float = 0.2) -> DataFrame:
    """Population stability index per feature with quantile bins of the reference (open ends, shares at least 1e-10)."""
    inner = {f"e{i}": i / n_bins for i in range(1, n_bins)}
    edges = quantiles(_long(reference, features), ["feature"], "v", inner).select("feature", F.array(*inner).alias("edges"))
    both = _long(reference, features, 0).unionByName(_long(current, features, 1))
    # Bins are closed on the left: the bin is the number of inner edges at or below the value.
    placed = both.join(F.broadcast(edges), "feature").withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("v"))))
    cells = placed.groupBy("feature", "bin").agg(
        F.sum((F.col("side") == 0).cast("long")).alias("r"), F.sum((F.col("side") == 1).cast("long")).alias("c"))
    grid = edges.select("feature", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    full = grid.join(cells, ["feature", "bin"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("r", "c")})
    totals = cells.groupBy("feature").agg(F.sum("r").alias("rn"), F.sum("c").alias("cn"))
    p = F.greatest(F.col("r") / F.col("rn"), F.lit(1e-10))
    q = F.greatest(F.col("c") / F.col("cn"), F.lit(1e-10))
    out = full.join(totals, "feature").groupBy("feature").agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))
    return out.withColumn("drift", F.col("psi") > limit)


def ks(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic per feature, from counts per distinct value."""
    both = _long(reference, features, 0).unionByName(_long(current, features, 1))
    per = both.groupBy("feature", "v").agg(
        F.sum((F.col("side") == 0).cast("long")).alias("r"), F.sum((F.col("side") == 1).cast("long")).alias("c"))
    run = with_running(per, ["feature"], ["v"], {"rr": ("sum", F.col("r")), "cc": ("sum", F.col("c"))})
    totals = per.groupBy("feature").agg(F.sum("r").alias("rn"), F.sum("c").alias("cn"))
    gap = F.abs(F.col("rr") / F.col("rn") - F.col("cc") / F.col("cn"))
    return run.join(totals, "feature").groupBy("feature", "rn", "cn").agg(F.max(gap).alias("ks_statistic"))


def ks_p_value(statistic: Column, n: Column, m: Column) -> Column:
    """Asymptotic p-value with the usual small-sample correction of the argument."""
    en = F.sqrt(n.cast("double") * m / (n + m))
    lam = (en + 0.12 + F.lit(0.11) / en) * statistic
    total = sum((2 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 21)), F.lit(0.0))
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def ks_report(reference: DataFrame, current: DataFrame, features: Sequence[str], threshold: float = 0.05) -> DataFrame:
    per = ks(reference, current, features).withColumn("p_value", ks_p_value(F.col("ks_statistic"), F.col("rn"), F.col("cn")))
    overall = per.agg(F.avg("p_value")).scalar()
    return per.withColumns({"overall_drift": per.agg(F.avg("ks_statistic")).scalar(), "overall_p_value": overall, "drift_detected": overall < threshold})


def reference_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, std, min, max and median per feature."""
    long = _long(df, features)
    stats = long.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    return stats.join(quantiles(long, ["feature"], "v", {"median": 0.5}), "feature")


def degradation(current: DataFrame, baseline: DataFrame, limit: float = 0.1, high: float = 0.2, rising: Sequence[str] = ("mae", "rmse")) -> DataFrame:
    """Metrics (long form: metric, value) that fell by more than the limit against the baseline; errors that rose."""
    b = baseline.select("metric", F.col("value").alias("baseline"))
    j = current.join(b, "metric").filter("baseline > 0")
    change = F.when(F.col("metric").isin(*rising), F.col("value") - F.col("baseline")).otherwise(F.col("baseline") - F.col("value")) / F.col("baseline")
    return j.withColumn("relative_change", change).filter(F.col("relative_change") > limit).withColumn(
        "severity", F.when(F.col("relative_change") > high, "high").otherwise("medium"))


def performance_summary(history: DataFrame, time: str = "at") -> DataFrame:
    return history.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.max_by("value", time).alias("latest"), F.count(F.lit(1)).alias("n_samples"))


def _with_error(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.withColumn("_err", (F.col(y) != F.col(yhat)).cast("int"))


def error_rate_detector(df: DataFrame, keys: Sequence[str], by: Sequence[str], y: str, yhat: str, warning: float = 0.05,
                        drift: float = 0.1, min_rows: int = 30) -> DataFrame:
    """Running error rate p with spread s: warn when p + s, drift when p + 2s passes its limit; silent before ``min_rows``."""
    run = with_running(_with_error(df, y, yhat), keys, by, {"seen": ("count", F.lit(1)), "_e": ("sum", F.col("_err"))})
    p = F.col("_e") / F.col("seen")
    s = F.sqrt(p * (1 - p) / F.col("seen"))
    ready = F.col("seen") >= min_rows
    return run.withColumns({"error_rate": F.when(ready, p), "warning": ready & (p + s > warning), "drift": ready & (p + 2 * s > drift)}).drop("_e", "_err")


def mean_shift_detector(df: DataFrame, keys: Sequence[str], by: Sequence[str], y: str, yhat: str, warning: float = 0.05,
                        drift: float = 0.1, min_rows: int = 20) -> DataFrame:
    """After each row n, the mean error of the newest n // 2 rows against the oldest n // 2.

    With prefix sums S both means are S(h) / h and (S(n) - S(n-h)) / h, so each row looks up two earlier prefixes.
    """
    keys = list(keys)
    run = with_running(_with_error(df, y, yhat), keys, by, {"seen": ("count", F.lit(1)), "_s": ("sum", F.col("_err"))}).drop("_err")
    prefix = run.select(*keys, F.col("seen").alias("_at"), F.col("_s").alias("_sum"))
    half = F.floor(F.col("seen") / 2).cast("long")
    # The position is part of both join keys, so a hot key is spread over its positions.
    low = prefix.select(*keys, F.col("_at").alias("_h"), F.col("_sum").alias("_old"))
    mid = prefix.select(*keys, F.col("_at").alias("_m"), F.col("_sum").alias("_before"))
    out = run.withColumns({"_h": half, "_m": F.col("seen") - half}).join(low, [*keys, "_h"], "left").join(mid, [*keys, "_m"], "left")
    older = F.try_divide(F.col("_old"), F.col("_h"))
    recent = F.try_divide(F.col("_s") - F.col("_before"), F.col("_h"))
    ready = F.col("seen") >= min_rows
    gap = F.when(ready, F.abs(recent - older))
    return out.withColumns({"error_rate": F.col("_s") / F.col("seen"), "mean_shift": gap,
                            "warning": F.coalesce(gap > warning, F.lit(False)), "drift": F.coalesce(gap > drift, F.lit(False))}).drop(
        "_s", "_h", "_m", "_old", "_before")


def cusum_detector(df: DataFrame, keys: Sequence[str], by: Sequence[str], y: str, yhat: str, alpha: float = 0.005, limit: float = 0.01) -> DataFrame:
    """Cumulative sum of error - alpha; drift above the limit."""
    run = with_running(_with_error(df, y, yhat), keys, by, {"seen": ("count", F.lit(1)), "_e": ("sum", F.col("_err"))})
    phi = F.col("_e") - F.col("seen") * alpha
    return run.withColumn("phi", phi).withColumn("drift", F.col("phi") > limit).drop("_e", "_err")


def feature_cusum(df: DataFrame, features: Sequence[str], alpha: float = 0.005, limit: float = 0.01, start: int = 10) -> DataFrame:
    """Per feature, the same sum over values that are not above one half, counted after the first ``start`` rows.

    The order of the rows only decides which are the first ones; ``pos`` holds the 1-based position.
    """
    late = F.col("pos") > start
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.sum(F.when(late, (F.col(f) <= 0.5).cast("double") - alpha)).alias("phi")) for f in features])
    return df.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*").withColumn("drift", F.coalesce(F.col("phi") > limit, F.lit(False)))


def rolling_performance(df: DataFrame, keys: Sequence[str], by: Sequence[str], y: str, yhat: str, window: int = 1000, min_rows: int = 10) -> DataFrame:
    """Accuracy, precision, recall and F1 over the last ``window`` predictions; null before ``min_rows``.

    Written as a difference of two running counts ``window`` rows apart, so the window size does not matter.
    """
    a, p = F.col(y).cast("int") == 1, F.col(yhat).cast("int") == 1
    marks = {"tp": a & p, "fp": ~a & p, "fn": a & ~p, "tn": ~a & ~p}
    sums = {f"_{k}": ("sum", v.cast("long")) for k, v in marks.items()}
    run = with_running(df, keys, by, {"seen": ("count", F.lit(1)), **sums})
    lagged = with_windows(run, keys, by, list(sums), [
        lambda w: {f"_l{k}": F.coalesce(F.lag(k, window).over(w), F.lit(0)) for k in sums}], back=window)
    counts = lagged.withColumns({k: F.col(f"_{k}") - F.col(f"_l_{k}") for k in marks})
    out = from_counts(counts)
    ready = F.col("seen") >= min_rows
    keep = ("accuracy", "precision", "recall", "f1")
    return out.select(*df.columns, "seen", *[F.when(ready, F.col(c)).alias(c) for c in keep])


def autocorrelation(df: DataFrame, keys: Sequence[str], by: Sequence[str], value: str, max_lag: int = 19) -> DataFrame:
    """Correlation of the series with itself at each lag, and whether it is the best one."""
    lags = with_windows(df, keys, by, [value], [lambda w: {f"_l{k}": F.lag(value, k).over(w) for k in range(1, max_lag + 1)}], back=max_lag)
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.corr(F.when(F.col(f"_l{k}").isNotNull(), F.col(value).cast("double")), F.col(f"_l{k}").cast("double")).alias("corr"))
                     for k in range(1, max_lag + 1)])
    out = lags.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*")
    best = out.agg(F.max_by("lag", F.struct("corr", -F.col("lag")))).scalar()
    return out.withColumn("is_best", F.col("lag") == best)


def mean_shift_report(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Train against val: feature means, their difference in train deviations, and the positive rates."""
    def of(part: str, c: Column) -> Column:
        return F.when(F.col("split") == part, c.cast("double"))
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.avg(of("train", F.col(f))).alias("train_mean"), F.avg(of("val", F.col(f))).alias("val_mean"),
                              F.stddev_samp(of("train", F.col(f))).alias("train_std")) for f in features])
    out = df.agg(rows.alias("r"), F.avg(of("train", F.col(target))).alias("train_positive_rate"), F.avg(of("val", F.col(target))).alias("val_positive_rate"))
    long = out.select(F.explode("r").alias("r"), "train_positive_rate", "val_positive_rate").select("r.*", "train_positive_rate", "val_positive_rate")
    return long.withColumn("shift", F.try_divide(F.abs(F.col("train_mean") - F.col("val_mean")), F.col("train_std")))
