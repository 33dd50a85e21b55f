"""Alert text features as column expressions (whole texts, no Python in the path)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions.bins import cut, flag

# Keyword lists of the severity score.
SEVERE_WORDS = (
    "emergency", "critical", "serious", "fatal", "accident", "blocked", "closed", "canceled", "cancelled", "not running",
    "out of service", "no service", "severe", "danger",
)
MODERATE_WORDS = (
    "delayed", "longer", "reduced", "fewer", "slower", "disruption", "problem", "issue", "warning", "alter",
)
URGENCY_WORDS = ("immediately", "urgent", "asap", "now", "instant")

# Words that name a mode of transport.
MODE_WORDS = {
    "tram": ("tram", "tramlijn", "sneltram"),
    "bus": ("bus", "buslijn", "lijnbus"),
    "train": ("trein", "treinlijn", "ns", "rail"),
    "metro": ("metro", "metrolijn"),
    "ferry": ("veer", "veerboot", " ferry"),
}

# Words of the text sentiment.
NEGATIVE_WORDS = ("delay", "cancel", "breakdown", "problem", "issue", "fail")
POSITIVE_WORDS = ("resolved", "fixed", "clear", "normal", "restored")

# Patterns.
CAPITALS_PATTERN = r"(?<![\p{L}\p{N}_])[A-Z]{2,}(?![\p{L}\p{N}_])"
URL_PATTERN = r"http[s]?://"
PHONE_PATTERN = r"\d{2,4}[-\s]?\d{2,4}[-\s]?\d{2,4}"
EMAIL_PATTERN = r"[\w.-]+@[\w.-]+"
TIME_PATTERN = r"(?i)\d{1,2}:\d{2}|am|pm|uur"
PLACE_PATTERN = r"(?i)station|stop|halte|plein|straat"
ROUTE_PATTERN = r"(?i)(?:line|bus|tram)\s*(\d+)"
STOP_PATTERN = r"(?i)(?:stop|station)\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"

ENTITY_JSON = "array<struct<entity_type:string,text:string>>"


def body(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal word."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))
    return F.floor(gone / len(word)).cast("int")


def total_of(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + occurrences(text, w)
    return out


def complexity(df: DataFrame, text: str) -> DataFrame:
    """Length, words, sentences, capitals, digits, time and place references."""
    t = body(text)
    out = df.withColumns({
        "text_length": F.length(t), "word_count": word_count(t),
        "sentence_count": F.regexp_count(t, F.lit("[.!?]")) + 1, "number_count": F.regexp_count(t, F.lit(r"\d")),
        "has_emphasis": flag(t.rlike(CAPITALS_PATTERN)), "has_time_ref": flag(t.rlike(TIME_PATTERN)),
        "has_location_ref": flag(t.rlike(PLACE_PATTERN)),
        "upper_ratio": F.bround(F.regexp_count(t, F.lit("[A-Z]")) / (F.length(t) + 1), 3),
    })
    return out.withColumns({
        "avg_word_length": F.bround(F.col("text_length") / (F.col("word_count") + 1), 2),
        "avg_sentence_length": F.bround(F.col("word_count") / (F.col("sentence_count") + 1), 2)})


def keyword_severity(df: DataFrame, text: str) -> DataFrame:
    """Counts of the three lists, weighted score (at most 30) and its level."""
    out = df.withColumn("_lower", F.lower(body(text))).withColumns({
        "severe_keyword_count": total_of(F.col("_lower"), SEVERE_WORDS),
        "moderate_keyword_count": total_of(F.col("_lower"), MODERATE_WORDS),
        "urgency_keyword_count": total_of(F.col("_lower"), URGENCY_WORDS)}).drop("_lower")
    score = F.col("severe_keyword_count") * 3 + F.col("moderate_keyword_count") * 2 + F.col("urgency_keyword_count") * 2
    out = out.withColumns({
        "has_severe_keyword": flag(F.col("severe_keyword_count") > 0),
        "has_urgency_keyword": flag(F.col("urgency_keyword_count") > 0), "keyword_severity": F.least(score, F.lit(30))})
    return out.withColumn("keyword_level", cut(F.col("keyword_severity"), [-1, 0, 2, 5, 30], ["none", "low", "medium", "high"]))


def mode_mentions(df: DataFrame, text: str) -> DataFrame:
    low = F.lower(body(text))
    def any_of(words: Sequence[str]) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        return flag(hit)
    out = df.withColumns({f"mentions_{m}": any_of(words) for m, words in MODE_WORDS.items()})
    total = F.lit(0)
    for m in MODE_WORDS:
        total = total + F.col(f"mentions_{m}")
    return out.withColumn("transport_mode_count", total)


def contact_flags(df: DataFrame, text: str) -> DataFrame:
    t = body(text)
    return df.withColumns({
        "has_text": flag(F.col(text).isNotNull()), "alert_text_length": F.length(t), "alert_word_count": word_count(t),
        "alert_has_url": flag(t.rlike(URL_PATTERN)), "alert_has_phone": flag(t.rlike(PHONE_PATTERN)),
        "alert_has_email": flag(t.rlike(EMAIL_PATTERN))})


# Default taxonomy of this library; callers pass their own.
TAXONOMY = {
    "ACCIDENT": ("accident", "collision", "crash"),
    "MAINTENANCE": ("maintenance", "works", "construction", "repair"),
    "WEATHER": ("snow", "storm", "ice", "flood", "wind"),
    "DELAY": ("delay", "late", "slow"),
    "CANCELLATION": ("cancel", "no service", "suspended"),
}


def taxonomy_scores(df: DataFrame, text: str, taxonomy: Mapping[str, Sequence[str]] = TAXONOMY) -> DataFrame:
    """Share of each category's words found in the text, normalised over categories; UNKNOWN when none is found.

    The primary category is the largest score, the first listed one on ties.
    """
    low = F.lower(body(text))
    raw = {c: sum((flag(low.contains(w)) for w in words), F.lit(0)) / len(words) for c, words in taxonomy.items()}
    out = df.withColumns({f"_raw_{c}": v for c, v in raw.items()})
    total = sum((F.col(f"_raw_{c}") for c in taxonomy), F.lit(0.0))
    out = out.withColumn("_total", total)
    out = out.withColumns({f"alert_category_{c}": F.coalesce(F.try_divide(F.col(f"_raw_{c}"), F.col("_total")), F.lit(0.0))
                           for c in taxonomy})
    best = F.array_max(F.array(*[
        F.struct(F.col(f"alert_category_{c}").alias("s"), F.lit(-i).alias("i"), F.lit(c).alias("c"))
        for i, c in enumerate(taxonomy)]))
    found = F.col("_total") > 0
    return out.withColumns({
        "alert_primary_category": F.when(found, best["c"]).otherwise("UNKNOWN"),
        "alert_category_confidence": F.when(found, best["s"]).otherwise(1.0),
    }).drop("_total", *[f"_raw_{c}" for c in taxonomy])


def extract_mentions(df: DataFrame, text: str) -> DataFrame:
    """Route numbers and stop names mentioned in the text, as arrays."""
    t = body(text)
    return df.withColumns({
        "mentioned_routes": F.regexp_extract_all(t, F.lit(ROUTE_PATTERN), F.lit(1)),
        "mentioned_stops": F.regexp_extract_all(t, F.lit(STOP_PATTERN), F.lit(1))})


def sentiment(df: DataFrame, text: str) -> DataFrame:
    """(positive - negative) / (positive + negative) over the words present, 0 without any."""
    low = F.lower(body(text))
    neg = sum((flag(low.contains(w)) for w in NEGATIVE_WORDS), F.lit(0))
    pos = sum((flag(low.contains(w)) for w in POSITIVE_WORDS), F.lit(0))
    return df.withColumn("text_sentiment", F.coalesce(F.try_divide((pos - neg).cast("double"), pos + neg), F.lit(0.0)))


def sentiment_flags(df: DataFrame, label: str = "sentiment", score: str = "score") -> DataFrame:
    """Flags, confidence level and urgency from a supplied sentiment label and score."""
    s, p = F.col(label), F.coalesce(F.col(score), F.lit(0.0))
    negative = flag(s == "Negative")
    return df.withColumns({
        "alert_negative": negative, "alert_positive": flag(s == "Positive"), "alert_neutral": flag(s == "Neutral"),
        "sentiment_urgent": flag((s == "Negative") & (F.col(score) > 0.7)),
        "confidence_level": cut(p, [0, 0.5, 0.7, 0.85, 1.0], ["low", "medium", "high", "very_high"]),
        "urgency_score": p * negative})


def urgency(df: DataFrame, sentiment_label: str, confidence: str, effect_id: str | None = None) -> DataFrame:
    """Negative sentiment weighted by its confidence plus half of the effect code."""
    effect = F.abs(F.col(effect_id)) if effect_id else F.lit(0)
    return df.withColumn("alert_urgency_score",
                         flag(F.lower(sentiment_label) == "negative") * F.col(confidence) + effect * 0.5)


def entity_features(df: DataFrame, entities: str, text: str) -> DataFrame:
    """Entity counts by type, location flag and density per 100 characters; ``entities`` is JSON text or an array."""
    arr = F.col(entities)
    if dict(df.dtypes)[entities] == "string":
        arr = F.from_json(entities, ENTITY_JSON)
    def of_type(kind: str) -> Column:
        return F.coalesce(F.size(F.filter(arr, lambda e: e["entity_type"] == kind)), F.lit(0))
    out = df.withColumns({
        "entity_count": F.when(arr.isNotNull(), F.size(arr)).otherwise(0), "location_entity_count": of_type("LOC"),
        "org_entity_count": of_type("ORG"), "person_entity_count": of_type("PER")})
    return out.withColumns({
        "has_location_entity": flag(F.col("location_entity_count") > 0),
        "entity_density": F.bround(F.col("entity_count") / (F.length(body(text)) / 100 + 1), 3)})


LANGUAGES = {"nl": "dutch", "en": "english", "de": "german", "fr": "french"}


def language_flags(df: DataFrame, lang: str | None = None) -> DataFrame:
    """Language label (``unknown`` when absent) and one flag per supported language."""
    value = F.coalesce(F.col(lang), F.lit("unknown")) if lang else F.lit("unknown")
    out = df.withColumn("alert_language", value)
    return out.withColumns({f"alert_is_{name}": flag(F.col("alert_language") == code) for code, name in LANGUAGES.items()})
