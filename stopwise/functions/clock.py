"""Clock and calendar expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions.bins import cut, flag

# Public holidays of 2025 and 2026.
HOLIDAYS = (
    "2025-01-01", "2025-04-18", "2025-04-20", "2025-04-21", "2025-04-27", "2025-05-01", "2025-05-29", "2025-06-08",
    "2025-06-09", "2025-12-25", "2025-12-26",
    "2026-01-01", "2026-04-03", "2026-04-05", "2026-04-06", "2026-04-26", "2026-05-01", "2026-05-14", "2026-05-24",
    "2026-05-25", "2026-12-25", "2026-12-26",
)
# First and last day of each school holiday.
SCHOOL_HOLIDAYS = (
    ("2025-02-15", "2025-02-23"), ("2025-04-25", "2025-05-03"), ("2025-07-01", "2025-08-31"), ("2025-10-11", "2025-10-19"),
    ("2026-02-14", "2026-02-22"), ("2026-04-17", "2026-04-25"), ("2026-07-01", "2026-08-31"), ("2026-10-10", "2026-10-18"),
)


def clock_seconds(value: Column) -> Column:
    """``HH:MM:SS`` (hours may pass 24) as seconds; plain numbers pass through; anything else is null."""
    parts = F.split(value.cast("string"), ":")
    def part(i: int) -> Column:
        return F.get(parts, F.lit(i)).try_cast("long")
    clock = (part(0) * 3600 + part(1) * 60 + part(2)).cast("double")
    return F.coalesce(clock, value.cast("string").try_cast("double"))


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def calendar_parts(df: DataFrame, time: str) -> DataFrame:
    """hour, day_of_week (Monday 0), day_name, date, month, week_of_year, day_of_month."""
    t = F.col(time)
    return df.withColumns({
        "hour": F.hour(t), "day_of_week": F.weekday(t), "day_name": F.date_format(t, "EEEE"), "date": F.to_date(t),
        "month": F.month(t), "week_of_year": F.weekofyear(t), "day_of_month": F.dayofmonth(t),
    })


def cyclic_features(df: DataFrame) -> DataFrame:
    """Sine and cosine of hour, day of week, month and week (needs ``calendar_parts``)."""
    out = {}
    for name, value, period in (("hour", F.col("hour"), 24), ("dow", F.col("day_of_week"), 7),
                                ("month", F.col("month") - 1, 12), ("week", F.col("week_of_year"), 52)):
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclic(value, period)
    return df.withColumns(out)


def time_buckets(df: DataFrame) -> DataFrame:
    """Peak, off-peak, night, early, late, weekend, weekday and rush-hour flags (needs ``calendar_parts``)."""
    h, weekend = F.col("hour"), F.col("day_of_week") >= 5
    morning, evening = h.between(7, 9), h.between(16, 19)
    return df.withColumns({
        "is_peak": flag(morning | evening), "is_morning_peak": flag(morning), "is_evening_peak": flag(evening),
        "is_offpeak": flag(h.between(10, 15)), "is_night": flag((h >= 22) | (h <= 5)),
        "is_early_morning": flag(h.between(5, 6)), "is_late_evening": flag(h.between(20, 21)),
        "is_weekend": flag(weekend), "is_weekday": flag(~weekend), "is_rush_hour": flag(~weekend & (morning | evening)),
    })


def enricher_time(df: DataFrame, time: str) -> DataFrame:
    """The second pair of peak definitions and the floored clocks."""
    h = F.hour(time)
    return df.withColumns({
        "is_peak_hour_wide": flag(h.isin(7, 8, 9, 17, 18, 19)), "is_peak_narrow": flag(h.isin(8, 17, 18)),
        "timestamp_min": F.date_trunc("minute", time), "timestamp_hour": F.date_trunc("hour", time),
        "id_time": F.date_format(time, "HH:mm:ss"), "id_date": F.to_date(time),
    })


def holiday_features(df: DataFrame, time: str) -> DataFrame:
    """National holiday, school holiday, school day and holiday period."""
    day = F.to_date(F.col(time))
    public = day.isin(*[F.lit(d).cast("date") for d in HOLIDAYS])
    school = F.lit(False)
    for start, end in SCHOOL_HOLIDAYS:
        school = school | day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return df.withColumns({
        "is_national_holiday": flag(public), "is_school_holiday": flag(school),
        "is_school_day": flag((F.weekday(day) < 5) & ~school), "is_holiday_period": flag(public | school),
    })


PEAKS = ((6 * 3600, 9 * 3600), (16 * 3600, 19 * 3600))
PEAK_EDGES = (-1, 0, 30, 60, 180, float("inf"))
PEAK_LABELS = ("in_peak", "under_30min", "30_to_60min", "1_to_3hrs", "off_peak")


def minutes_to_peak(time: Column) -> Column:
    """Minutes until the next peak starts, 0 inside one; after the evening peak, until the next morning."""
    day = 86_400_000_000
    s = F.pmod(F.unix_micros(time), F.lit(day)) / 1e6
    (m0, m1), (e0, e1) = PEAKS
    return (F.when(s.between(m0, m1) | s.between(e0, e1), 0.0).when(s < m0, (m0 - s) / 60)
            .when(s < e0, (e0 - s) / 60).when(s.isNotNull(), (86400 + m0 - s) / 60))


def time_features(df: DataFrame, time: str) -> DataFrame:
    """Day-type features: days since the first day, weekend, holiday, minutes to the peak and its bucket."""
    first = df.agg(F.min(F.unix_micros(time))).scalar()
    off = (F.weekday(time) >= 5) | F.to_date(time).isin(*[F.lit(d).cast("date") for d in HOLIDAYS])
    out = df.withColumns({
        "hour_of_day": F.hour(time), "day_name": F.date_format(time, "EEEE"), "date": F.to_date(time),
        "month": F.month(time), "day_of_week_numeric": F.weekday(time),
        "days_since_start": F.floor((F.unix_micros(time) - first) / F.lit(86_400_000_000)),
        "is_weekend": flag(F.weekday(time) >= 5),
        "is_holiday": flag(F.to_date(time).isin(*[F.lit(d).cast("date") for d in HOLIDAYS])),
        "time_to_rush_hour_peak": F.when(~off, minutes_to_peak(F.col(time))),
    })
    bucket = cut(F.col("time_to_rush_hour_peak"), PEAK_EDGES, PEAK_LABELS)
    return out.withColumns({
        "time_to_peak_bucket": F.when(off, "off_day").otherwise(bucket),
        "is_peak_hour": flag(F.col("time_to_rush_hour_peak") == 0),
    })


def time_shares(df: DataFrame) -> DataFrame:
    """Percentages of peak, weekend and holiday rows (one decimal), from ``time_features``."""
    def pct(name: str) -> Column:
        return F.bround(F.avg((F.col(name) == 1).cast("double")) * 100, 1)
    return df.agg(pct("is_peak_hour").alias("peak_percentage"), pct("is_weekend").alias("weekend_percentage"),
                  pct("is_holiday").alias("holiday_percentage"))


def alert_timing(df: DataFrame, start: str = "active_period_start", end: str = "active_period_end",
                 now: str = "feed_timestamp", as_of: Column | None = None, soon_minutes: int = 30) -> DataFrame:
    """Duration, age and remaining time of an alert with their flags.

    With ``as_of`` (a prediction time) alerts that start later have no timing yet and the end is not known beyond it.
    """
    t = F.col(now)
    s, e = F.col(start), F.col(end)
    if as_of is not None:
        e = F.when(s <= as_of, F.least(e, as_of))
        s = F.when(s <= as_of, s)

    def gap(later: Column, earlier: Column) -> Column:
        return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6

    duration, remaining, age = gap(e, s), gap(e, t), gap(t, s)
    return df.withColumns({
        "alert_duration_seconds": duration, "alert_duration_minutes": duration / 60,
        "alert_duration_hours": duration / 3600, "alert_duration_days": duration / 86400,
        "alert_remaining_seconds": remaining, "alert_remaining_hours": remaining / 3600,
        "alert_is_expired": flag(remaining <= 0), "alert_is_imminent": flag((remaining > 0) & (remaining <= 3600)),
        "alert_expiring_soon": flag((remaining > 0) & (remaining <= soon_minutes * 60)),
        "alert_age_seconds": age, "alert_age_minutes": age / 60, "alert_age_hours": age / 3600,
        "alert_is_new": flag(age / 60 <= 15), "alert_is_aging": flag(age / 3600 > 1),
        "alert_is_active": flag((age >= 0) & (remaining > 0)),
        "alert_duration_min": F.coalesce(duration / 60, F.lit(0.0)),
        "duration_category": cut(F.coalesce(duration / 60, F.lit(0.0)), [-1, 30, 120, 480, float("inf")],
                                 ["short", "medium", "long", "extended"]),
    })
