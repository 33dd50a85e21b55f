"""Alert codes, tiers, predictions and generated alerts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions.bins import cut, flag

# Ordinal codes of cause and effect.
CAUSE_IDS = {
    "UNKNOWN_CAUSE": 0, "OTHER_CAUSE": 1, "TECHNICAL_PROBLEM": 2, "STRIKE": 3, "DEMONSTRATION": 4, "ACCIDENT": 5,
    "HOLIDAY": 6, "WEATHER": 7, "MAINTENANCE": 8, "CONSTRUCTION": 9, "POLICE_ACTIVITY": 10, "MEDICAL_EMERGENCY": 11,
}
EFFECT_IDS = {
    "NO_SERVICE": 0, "REDUCED_SERVICE": 1, "SIGNIFICANT_DELAYS": 2, "DETOUR": 3, "ADDITIONAL_SERVICE": 4,
    "MODIFIED_SERVICE": 5, "OTHER_EFFECT": 6, "UNKNOWN_EFFECT": 7, "STOP_MOVED": 8,
}


def code_of(name: Column, ids: dict[str, int]) -> Column:
    pairs = [F.lit(x) for kv in ids.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit(-1))


def cause_effect_codes(df: DataFrame, cause: str = "cause", effect: str = "effect") -> DataFrame:
    """Ordinal codes (unknown -1) and the sum of their absolute values."""
    out = df.withColumns({"cause_id": code_of(F.col(cause), CAUSE_IDS), "effect_id": code_of(F.col(effect), EFFECT_IDS)})
    return out.withColumn("alert_severity_composite", F.abs("cause_id") + F.abs("effect_id"))


@dataclass(frozen=True)
class TierPolicy:
    channels: tuple[str, ...]
    notify_within_minutes: int
    requires_human: bool
    requires_ack: bool
    escalate_if_unacked: int | None


@dataclass(frozen=True)
class EscalationPolicy:
    """Thresholds and tier policies; the defaults are this library's own, callers set theirs."""

    severity_critical: float = 3
    delay_major: float = 15
    delay_minor: float = 5
    bunching_severe: float = 0.8
    confidence_escalate_max: float = 60
    confidence_auto_min: float = 85
    tiers: dict = field(default_factory=lambda: {
        "CRITICAL": TierPolicy(("sms", "phone", "dashboard"), 5, True, True, 10),
        "MAJOR": TierPolicy(("sms", "dashboard"), 15, True, True, 30),
        "MODERATE": TierPolicy(("dashboard",), 30, False, False, None),
        "MINOR": TierPolicy(("log",), 120, False, False, None),
    })


TIER_ORDER = ("CRITICAL", "MAJOR", "MODERATE", "MINOR")


def escalate(df: DataFrame, policy: EscalationPolicy = EscalationPolicy(), evaluated_at: str = "evaluated_at") -> DataFrame:
    """Tier, review and publish flags, channels and deadlines of each prediction.

    The policy is that of the tier before a low confidence raises MODERATE to MAJOR.
    """
    severity = F.coalesce(F.col("severity_class"), F.lit(0))
    confidence = F.coalesce(F.col("confidence"), F.lit(100.0))
    delay, bunching = F.coalesce(F.col("delay_minutes"), F.lit(0.0)), F.coalesce(F.col("bunching_index"), F.lit(0.0))
    tier = (F.when(severity >= policy.severity_critical, "CRITICAL").when(delay >= policy.delay_major, "MAJOR")
            .when((delay >= policy.delay_minor) | (bunching >= policy.bunching_severe), "MODERATE").otherwise("MINOR"))

    def by_tier(pick) -> Column:
        out = F.lit(None)
        for name, p in policy.tiers.items():
            out = F.when(F.col("_tier") == name, pick(p)).otherwise(out)
        return out

    unsure = confidence < policy.confidence_escalate_max
    out = df.withColumn("_tier", tier).withColumn(
        "requires_human_review", unsure | by_tier(lambda p: F.lit(p.requires_human)))
    return out.withColumns({
        "tier": F.when(unsure & (F.col("_tier") == "MODERATE"), "MAJOR").otherwise(F.col("_tier")),
        "auto_publish": ~F.col("requires_human_review") & (confidence >= policy.confidence_auto_min),
        "notification_channels": by_tier(lambda p: F.array(*map(F.lit, p.channels))),
        "response_deadline_minutes": by_tier(lambda p: F.lit(p.notify_within_minutes)),
        "requires_acknowledgement": by_tier(lambda p: F.lit(p.requires_ack)),
        "escalation_if_unacked_min": by_tier(lambda p: F.lit(p.escalate_if_unacked).cast("int")),
        "status": F.lit("NEW"),
    }).drop("_tier")


def tier_rank(tier: Column) -> Column:
    out = F.lit(len(TIER_ORDER))
    for i, name in enumerate(TIER_ORDER):
        out = F.when(tier == name, i).otherwise(out)
    return out


def active_alerts(df: DataFrame, tiers: tuple[str, ...] = ()) -> DataFrame:
    """Alerts that are not resolved, most urgent first."""
    keep = F.coalesce(F.col("status") != "RESOLVED", F.lit(True))
    if tiers:
        keep = keep & F.col("tier").isin(*tiers)
    return df.filter(keep).orderBy(tier_rank(F.col("tier")), F.desc("severity_class"))


def lifecycle(alerts: DataFrame, events: DataFrame, as_of: Column, alert_id: str = "alert_id") -> DataFrame:
    """Current status of each alert from its latest event, and whether it is past its response deadline."""
    last = events.groupBy(alert_id).agg(F.max_by("event", F.struct("event_at", "event")).alias("_event"))
    out = alerts.join(last, alert_id, "left").withColumn("status", F.coalesce("_event", F.lit("NEW"))).drop("_event")
    due = F.unix_micros("evaluated_at") + F.col("response_deadline_minutes").cast("long") * 60_000_000
    open_ = ~F.col("status").isin("ACKNOWLEDGED", "RESOLVED")
    return out.withColumn("overdue", open_ & (F.unix_micros(as_of) > due))


def escalation_summary(df: DataFrame) -> DataFrame:
    """Active, critical, waiting for acknowledgement and overdue alerts."""
    active = F.col("status") != "RESOLVED"
    return df.agg(
        F.sum(flag(active)).alias("active"), F.sum(flag(active & (F.col("tier") == "CRITICAL"))).alias("critical"),
        F.sum(flag((F.col("status") == "NEW") & F.col("requires_acknowledgement"))).alias("pending_ack"),
        F.sum(flag(F.col("overdue"))).alias("overdue"))


def bunching_class(index: Column) -> Column:
    return F.when(index < 0.3, 0).when(index < 0.6, 1).when(index < 0.8, 2).otherwise(3)


CLASS_LABELS = ("Normal", "Minor", "Moderate", "Severe")


def prediction_alerts(df: DataFrame) -> DataFrame:
    """One alert per prediction above normal, worst and most certain first."""
    out = df.withColumn("severity_class", bunching_class(F.col("bunching_index"))).filter("severity_class > 0")
    label = F.element_at(F.array(*map(F.lit, CLASS_LABELS)), F.col("severity_class") + 1)
    out = out.withColumn("severity_label", label)
    return out.withColumn(
        "message", F.format_string("Disruption detected on %s — %s severity", "route_id", "severity_label"),
    ).orderBy(F.desc("severity_class"), F.desc("confidence"))


def prediction_severity(df: DataFrame, p: str = "disruption_probability") -> DataFrame:
    x = F.col(p)
    return df.withColumns({
        "severity": F.when(x > 0.7, "high").when(x > 0.3, "medium").otherwise("low"), "is_disrupted": x > 0.5})


def ui_categories(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "speed_category": cut(F.col("speed"), [0, 10, 25, 50, 100], ["stopped", "slow", "normal", "fast"]),
        "delay_category": cut(F.col("delay_min"), [0, 5, 15, 30, 1000], ["on_time", "minor", "major", "severe"])})


def delay_alerts(df: DataFrame) -> DataFrame:
    """Alerts for major and severe delays with a readable message."""
    c = F.col("delay_category")
    word = F.when(c == "severe", "Severe").otherwise("Major")
    return df.filter(c.isin("severe", "major")).withColumns({
        "severity": F.when(c == "severe", "CRITICAL").otherwise("MAJOR"),
        "message": F.format_string("%s delay on route %s: %.1fmin", word, F.col("route_id"), F.col("delay_min")),
        "acknowledged": F.lit(False)})


def risk_level(df: DataFrame, score: str = "risk_score") -> DataFrame:
    """Score to four decimals and its level; the lowest bin includes 0."""
    out = df.withColumn(score, F.bround(F.col(score), 4))
    return out.withColumn("risk_level", cut(F.col(score), [0.0, 0.25, 0.50, 0.75, 1.01],
                                            ["low", "moderate", "high", "critical"], include_lowest=True))


def ui_filter(df: DataFrame, routes: tuple[str, ...] = (), delay: tuple[float, float] | None = None) -> DataFrame:
    """Rows of the chosen routes within the delay range (minutes)."""
    out = df.filter(F.col("route_id").isin(*routes)) if routes else df
    return out.filter(F.col("delay_min").between(*delay)) if delay else out


def known_at(df: DataFrame, at: Column, start: str = "active_period_start", end: str = "active_period_end") -> DataFrame:
    """All rows kept; whether the alert had started by ``at``, and its end clamped to ``at``."""
    started = F.coalesce(F.col(start) <= at, F.lit(False))
    return df.withColumns({"known_at_prediction": started, "known_end": F.when(started, F.least(F.col(end), at))})
