"""Row-level labels: delay and speed flags, disruption type, severity, targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severity of each label.
SEVERITY = {
    "CANCELLED": 10, "MAJOR_DELAY": 7, "STOPPED_ON_ROUTE": 5, "MINOR_DELAY": 5,
    "SLOW_TRAFFIC": 3, "EARLY": 3, "SERVICE_ALERT": 3, "ON_TIME": 0,
}
LABELS = tuple(SEVERITY)


@dataclass(frozen=True)
class Thresholds:
    major_sec: float = 600
    minor_sec: float = 120
    early_sec: float = -60
    stopped: float = 2.0
    slow: float = 10.0


def has(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def resolve_col(df: DataFrame, candidates: list[str] | tuple[str, ...]) -> str | None:
    """First of the candidate names present in the schema (no job)."""
    return next((c for c in candidates if c in df.columns), None)


def column_or(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def as_strings(df: DataFrame, names: list[str]) -> DataFrame:
    """Cast the key columns that exist to string; null stays null."""
    return df.withColumns({c: F.col(c).cast("string") for c in names if c in df.columns})


def flag_delay(df: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """delay_sec (from the two clocks when absent), delay_min, missing_schedule and delay_flag."""
    if "delay_sec" not in df.columns:
        both = has(df, "actual_time_sec", "scheduled_time_sec")
        made = F.col("actual_time_sec") - F.col("scheduled_time_sec") if both else F.lit(None).cast("double")
        df = df.withColumn("delay_sec", made)
    delay = F.col("delay_sec")
    missing = F.col("scheduled_time_sec").isNull() if "scheduled_time_sec" in df.columns else F.lit(True)
    return df.withColumns({
        "delay_min": delay / 60.0,
        "missing_schedule": missing,
        "delay_flag": F.when(delay > limits.minor_sec, "late").when(delay < limits.early_sec, "early")
        .otherwise("on_time"),
    })


def flag_speed(df: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """speed_flag stopped / slow / normal; an unknown speed counts as normal."""
    if "speed" not in df.columns:
        df = df.withColumn("speed", F.lit(None).cast("double"))
    speed = F.col("speed")
    return df.withColumn(
        "speed_flag", F.when(speed <= limits.stopped, "stopped").when(speed <= limits.slow, "slow").otherwise("normal"))


def cancelled(df: DataFrame) -> Column:
    """Cancelled by vehicle status, or by an alert effect that contains NO_SERVICE."""
    status = F.upper(column_or(df, "vehicle_status", F.lit(None).cast("string")))
    effect = F.upper(column_or(df, "alert_effect", F.lit(None).cast("string")))
    return F.coalesce(status == "CANCELED", F.lit(False)) | F.coalesce(effect.contains("NO_SERVICE"), F.lit(False))


def severity_of(label: Column) -> Column:
    value = F.lit(None).cast("int")
    for name, score in SEVERITY.items():
        value = F.when(label == name, score).otherwise(value)
    return value


def classify(df: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """disruption_type by priority, and its severity_score."""
    delay = column_or(df, "delay_sec", F.lit(None).cast("double"))
    flag = column_or(df, "speed_flag", F.lit("unknown"))
    alert = column_or(df, "has_alert", F.lit(False))
    kind = (
        F.when(cancelled(df), "CANCELLED")
        .when(delay > limits.major_sec, "MAJOR_DELAY")
        .when((flag == "stopped") & (delay > limits.minor_sec), "STOPPED_ON_ROUTE")
        .when(delay > limits.minor_sec, "MINOR_DELAY")
        .when(flag == "slow", "SLOW_TRAFFIC")
        .when(delay < limits.early_sec, "EARLY")
        .when(alert, "SERVICE_ALERT")
        .otherwise("ON_TIME")
    )
    return df.withColumn("disruption_type", kind).withColumn("severity_score", severity_of(F.col("disruption_type")))


def disrupted(label: str = "disruption_type") -> Column:
    return F.col(label) != "ON_TIME"


def add_targets(df: DataFrame) -> DataFrame:
    """Binary disruption_target and disruption_class, the position of the label among the sorted labels present.

    The distinct labels are at most the eight known ones, so the lookup is a small array, not a join.
    """
    present = df.agg(F.array_sort(F.collect_set("disruption_type")).alias("_labels"))
    position = F.array_position(present.scalar(), F.col("disruption_type"))
    return df.withColumns({
        "disruption_target": disrupted().cast("int"),
        "disruption_class": (position - 1).cast("int"),
    })


def infer_type_from_delay(df: DataFrame) -> DataFrame:
    """Fallback label from delay minutes alone, for data without a label."""
    delay = F.col("delay_min")
    return df.withColumn(
        "disruption_type",
        F.when(delay <= 2, "ON_TIME").when(delay <= 5, "MINOR_DELAY").when(delay > 5, "MAJOR_DELAY"))


def risk_label(target: Column) -> Column:
    return F.when(target == 1, "high").otherwise("low")


def with_risk(df: DataFrame, target: str = "disruption_target") -> DataFrame:
    """``risk_level`` from the target (low without one) and ``disruption_class`` = unknown, where the table has none of its own."""
    out = df
    if "risk_level" not in df.columns:
        out = out.withColumn("risk_level", risk_label(F.col(target)) if target in df.columns else F.lit("low"))
    return out if "disruption_class" in df.columns else out.withColumn("disruption_class", F.lit("unknown"))


def pick_features(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """All numeric feature columns in schema order: no ids, targets, labels, text or clocks."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint", "boolean"}
    banned = ("target", "disruption_type", "disruption_class", "severity_score", "timestamp")
    return [name for name, kind in df.dtypes
            if kind in numeric and name not in exclude and not name.endswith("_id")
            and not any(word in name for word in banned)]
