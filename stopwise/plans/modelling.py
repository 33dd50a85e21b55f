"""Splitting, selection, monitoring, diagnostics and the run from feeds to scored models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.metrics import drift
from stopwise.metrics.classification import binary_metrics
from stopwise.ml import models, prepare
from stopwise.operators import label, splits, summary
from stopwise.plans.features import build_features, early_warning
from stopwise.session import cut_lineage


@dataclass(frozen=True)
class SplitConfig:
    strategy: str = "auto"
    train: float = 0.70
    val: float = 0.15
    test: float = 0.15
    gap_minutes: float = 0
    small_rows: int = 10_000
    small_days: float = 7
    min_train_days: int = 1
    train_end: str | None = None
    val_end: str | None = None


def adaptive_split(df: DataFrame, config: SplitConfig = SplitConfig(), time: str = "feed_timestamp", row_id: str = "obs_id") -> tuple[DataFrame, DataFrame]:
    """Labelled rows and the balance table: rows with ``split``, or rows with ``day_rank`` and a balance whose folds are intervals of
    days (``splits.span_rows`` takes the rows of one).

    Small data (few rows or few days) is walked forward by day, everything else is cut once; the choice reads one
    aggregated row.
    """
    strategy = config.strategy
    if strategy == "auto":
        strategy = splits.volume(df, time, config.small_rows, config.small_days).first()["strategy"]
    if strategy == "walk_forward":
        days = splits.day_table(df, time)
        return splits.with_day_rank(df, time), splits.span_balance(days, splits.fold_spans(days, config.min_train_days))
    if config.train_end and config.val_end:
        out = splits.boundary_split(df, time, F.lit(config.train_end).cast("timestamp"), F.lit(config.val_end).cast("timestamp"), config.gap_minutes)
    else:
        out = splits.chronological_split(df, time, row_id, config.train, config.val, config.test)
        if config.gap_minutes > 0:
            out = splits.gap_buffer(out, time, config.gap_minutes)
    return out, splits.balance(out)


def align_streams(df: DataFrame, keys: Sequence[str] = ("route_id",), minutes: int = 5) -> DataFrame:
    """Number columns averaged and text columns taken from the earliest row of each time bin."""
    numbers = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") and c not in (*keys, "obs_id")]
    texts = [c for c, t in df.dtypes if t == "string" and c not in keys]
    return summary.binned(df, keys, minutes, numbers, texts)


def select_features(df: DataFrame, features: Sequence[str], target: str, protected: Sequence[str] = (), corr: float = 0.95,
                    variance: float = 0.01, top: int | None = None) -> DataFrame:
    """(feature, selected): passes the correlation and variance filters and, with ``top``, is among that many most
    informative ones; or is protected."""
    c = prepare.correlation_filter(df, features, corr).select("feature", F.col("keep").alias("corr_ok"))
    v = prepare.variance_filter(df, features, variance).select("feature", F.col("keep").alias("var_ok"))
    m = prepare.mutual_information(df, features, target, k=top).select("feature", F.lit(True).alias("mi_ok"))
    out = c.join(v, "feature").join(m, "feature", "left").withColumn("mi_ok", F.coalesce("mi_ok", F.lit(False)))
    return out.withColumn("protected", F.col("feature").isin(*protected) if protected else F.lit(False)).withColumn(
        "selected", (F.col("corr_ok") & F.col("var_ok") & F.col("mi_ok")) | F.col("protected"))


def monitor(reference: DataFrame, current: DataFrame, features: Sequence[str], metrics: DataFrame | None = None,
            baseline: DataFrame | None = None, method: str = "ks_test") -> DataFrame:
    """Drift per feature and, when metrics are given, degradation alerts, as one long table."""
    if method == "psi":
        found = drift.psi(reference, current, features).select(F.lit("drift").alias("kind"), F.col("feature").alias("name"), F.col("psi").alias("value"), "drift")
    else:
        found = drift.ks_report(reference, current, features).select(
            F.lit("drift").alias("kind"), F.col("feature").alias("name"), F.col("ks_statistic").alias("value"), (F.col("p_value") < 0.05).alias("drift"))
    if metrics is None or baseline is None:
        return found
    worse = drift.degradation(metrics, baseline).select(F.lit("degradation").alias("kind"), F.col("metric").alias("name"), F.col("relative_change").alias("value"), F.lit(True).alias("drift"))
    return found.unionByName(worse)


def diagnostics(df: DataFrame, features: Sequence[str], target: str, y_pred: str) -> dict[str, DataFrame]:
    """Column profile, leakage check, class metrics and train / val shift of a split table."""
    return {"profile": summary.column_profile(df, features), "leakage": splits.correlation_shift(df, list(features), target, 0.3),
            "metrics": binary_metrics(df, target, y_pred), "shift": drift.mean_shift_report(df, features, target)}


def dashboard(df: DataFrame, dims: dict[str, DataFrame] | None = None) -> DataFrame:
    """Observations to the dashboard rollup; a label is inferred from the delay when no label can be given."""
    from stopwise.plans.features import prepared

    out = prepared(df, dims)
    if "disruption_type" not in out.columns:
        out = label.infer_type_from_delay(out)
    return summary.dashboard_rollup(out)


def full_run(df: DataFrame, dims: dict[str, DataFrame] | None = None, target: str = "target_30min", kind: str = "forest",
             config: SplitConfig = SplitConfig(strategy="fixed_ratio"), as_of: bool = True, **params) -> dict[str, DataFrame]:
    """Stop events to features, targets, split, tuned model and metrics.

    The feature table is written after each of the two builds, because the later steps read it several times.  Its columns take
    only rows up to each row unless ``as_of`` is off.
    """
    table = cut_lineage(early_warning(cut_lineage(build_features(df, dims, as_of=as_of))))
    labelled, balance = adaptive_split(table, config)
    labelled = cut_lineage(labelled)
    names = label.pick_features(labelled, exclude=("obs_id", "k", "value"))
    train = labelled.filter("split = 'train'")
    ready = cut_lineage(prepare.impute(labelled, train, names))
    part = {p: ready.filter(F.col("split") == p) for p in ("train", "val", "test")}
    scored = cut_lineage(models.fit_predict(part["train"], part["val"], part["test"], names, target, kind, **params))
    return {"route_summary": summary.route_summary(labelled), "hot_spots": summary.hot_spots(labelled), "balance": balance,
            "predictions": scored.select("obs_id", target, "score", "y_pred"), "metrics": binary_metrics(scored, target, "y_pred")}
