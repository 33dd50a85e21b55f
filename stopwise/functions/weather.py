"""Weather thresholds, impact scores and risk codes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions.bins import flag

# Thresholds (Celsius, m/s, mm/h, m).
FREEZING, HOT = 0.0, 30.0
WIND_GALE, WIND_STRONG, WIND_MODERATE = 20.0, 14.0, 8.0
RAIN_HEAVY, RAIN_MODERATE = 10.0, 4.0
VISIBILITY_LOW, VISIBILITY_POOR = 200, 1000

# Impact weights of each mode.
MODE_WEIGHTS = {
    "bus": {"visibility": 0.3, "speed": 0.4, "reliability": 0.2},
    "tram": {"visibility": 0.2, "speed": 0.3, "reliability": 0.3},
    "metro": {"visibility": 0.3, "speed": 0.2, "reliability": 0.3},
    "train": {"visibility": 0.2, "speed": 0.2, "reliability": 0.4},
}

# Disruption risk of each weather code.
CODE_RISK = {
    0: 0.0, 1: 0.0, 2: 0.0, 3: 0.1, 45: 0.3, 48: 0.4, 51: 0.2, 53: 0.2, 55: 0.3, 56: 0.7, 61: 0.3, 63: 0.4, 65: 0.6,
    66: 0.8, 71: 0.6, 73: 0.7, 75: 0.8, 77: 0.5, 80: 0.3, 81: 0.4, 82: 0.5, 85: 0.7, 86: 0.8, 95: 0.6, 96: 0.8, 99: 0.9,
}

# Defaults without weather data.
DEFAULTS = {"weather_temp": 10.0, "weather_wind": 5.0, "weather_precip": 0.0, "weather_humidity": 75,
            "weather_visibility": 10000}
IMPACTS = ("visibility", "speed", "reliability", "capacity")


def value(name: str, default: float) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(float(default)))


def season_flags(df: DataFrame, time: str) -> DataFrame:
    h = F.hour(time)
    return df.withColumns({
        "weather_is_winter": flag(F.month(time).isin(12, 1, 2, 3)), "weather_is_summer": flag(F.month(time).isin(6, 7, 8)),
        "weather_rush_hour": flag(h.between(7, 9) | h.between(16, 19)), "weather_weekend": flag(F.weekday(time) >= 5)})


def placeholder(df: DataFrame, time: str) -> DataFrame:
    """Columns for rows without a weather table: season flags, moderate defaults, no impact."""
    out = season_flags(df, time).withColumns({k: F.lit(v) for k, v in DEFAULTS.items()})
    out = out.withColumns({f"weather_{i}_impact": F.lit(0.0) for i in IMPACTS})
    return out.withColumns({"weather_total_impact": F.lit(0.0), "weather_has_data": F.lit(0)})


def threshold_flags(df: DataFrame) -> DataFrame:
    t, w, p, v = value("temperature", 10), value("wind_speed", 0), value("precipitation", 0), value("visibility", 10000)
    return df.withColumns({
        "weather_temp_cold": flag(t < FREEZING), "weather_temp_hot": flag(t > HOT), "weather_temp_freezing": flag(t <= 0),
        "weather_wind_gale": flag(w >= WIND_GALE), "weather_wind_strong": flag(w >= WIND_STRONG),
        "weather_wind_moderate": flag(w >= WIND_MODERATE), "weather_rain_heavy": flag(p >= RAIN_HEAVY),
        "weather_rain_moderate": flag(p >= RAIN_MODERATE), "weather_visibility_low": flag(v < VISIBILITY_LOW),
        "weather_visibility_poor": flag(v < VISIBILITY_POOR)})


def impacts(df: DataFrame, snow: str | None = None) -> DataFrame:
    """Visibility, speed, reliability and capacity impact, their mean and the disrupting flag."""
    t, w, p, v = value("temperature", 10), value("wind_speed", 0), value("precipitation", 0), value("visibility", 10000)
    snowy = F.coalesce(F.col(snow), F.lit(False)) if snow else F.lit(False)
    rainy, freezing = p > 0, t <= FREEZING
    out = df.withColumns({
        "weather_visibility_impact": F.when(v < VISIBILITY_LOW, 1.0).when(v < VISIBILITY_POOR, 0.5).otherwise(0.0),
        "weather_speed_impact": F.when(w >= WIND_GALE, 1.0).when(w >= WIND_STRONG, 0.7).when(w >= WIND_MODERATE, 0.3)
        .otherwise(0.0),
        "weather_reliability_impact": F.when(snowy, 1.0).when(freezing & rainy, 0.8).when(rainy, 0.4)
        .when(freezing, 0.3).otherwise(0.0),
        "weather_capacity_impact": F.when(rainy | snowy, 0.3).otherwise(0.0)})
    total = sum((F.col(f"weather_{i}_impact") for i in IMPACTS), F.lit(0.0)) / len(IMPACTS)
    return out.withColumn("weather_total_impact", total).withColumn(
        "weather_is_disrupting", flag(F.col("weather_total_impact") > 0.5))


def mode_score(df: DataFrame, mode: Column | str = "bus", weights: Mapping = MODE_WEIGHTS) -> DataFrame:
    """Impact weighted by the transport mode (unknown modes count as bus), at most 1."""
    kind = F.lit(mode) if isinstance(mode, str) else mode
    def weight(part: str) -> Column:
        out = F.lit(weights["bus"][part])
        for name, w in weights.items():
            out = F.when(kind == name, w[part]).otherwise(out)
        return out
    t, w, p, v = value("temperature", 10), value("wind_speed", 0), value("precipitation", 0), value("visibility", 10000)
    sight = F.when(v < VISIBILITY_LOW, 1.0).when(v < VISIBILITY_POOR, 0.5).otherwise(0.0)
    speed = F.when(w >= WIND_GALE, 1.0).when(w >= WIND_STRONG, 0.7).when(w >= WIND_MODERATE, 0.3).otherwise(0.0)
    rely = (F.when((t <= 0) & (p > 0), 1.0).when(t <= 0, 0.3).when(p > RAIN_HEAVY, 0.5).when(p > 0, 0.2).otherwise(0.0))
    score = weight("visibility") * sight + weight("speed") * speed + weight("reliability") * rely
    return df.withColumn("weather_impact_score", F.least(score, F.lit(1.0)))


def code_features(df: DataFrame, code: str = "weather_code") -> DataFrame:
    """Risk of the weather code, disrupting flag above 0.4, and its category."""
    c = F.coalesce(F.col(code).cast("int"), F.lit(0))
    risk = F.create_map(*[F.lit(x) for kv in CODE_RISK.items() for x in kv])
    category = F.lit("storm")
    for top, name in ((82, "showers"), (77, "snow"), (66, "rain"), (55, "drizzle"), (48, "fog"), (3, "cloudy")):
        category = F.when(c <= top, name).otherwise(category)
    out = df.withColumn("weather_disruption_risk", F.coalesce(F.try_element_at(risk, c), F.lit(0.0)))
    return out.withColumns({
        "weather_is_disrupting_code": flag(F.col("weather_disruption_risk") > 0.4),
        "weather_code_category": F.when(c == 0, "clear").otherwise(category)})


def additive_score(df: DataFrame, rain: str = "rain_1h", snow: str = "snow_1h", visibility: str = "visibility_m",
                   code: str = "weather_id", wind: str = "wind_speed") -> DataFrame:
    """Sum of precipitation, visibility, code and wind contributions, at most 1."""
    p = value(rain, 0) + value(snow, 0)
    km = value(visibility, 10000) / 1000
    c = F.coalesce(F.col(code).cast("int"), F.lit(800))
    score = (F.when(p > 5, 0.4).when(p > 0.5, 0.2).otherwise(0.0) + F.when(km < 1, 0.3).when(km < 5, 0.15).otherwise(0.0)
             + F.when(c.between(200, 299), 0.3).when(c.between(500, 599), 0.2).when(c.between(600, 699), 0.3)
             .when(c.between(700, 799), 0.2).otherwise(0.0) + F.when(value(wind, 0) > 15, 0.1).otherwise(0.0))
    return df.withColumn("impact_score", F.least(score, F.lit(1.0)))
