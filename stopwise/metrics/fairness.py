"""Group fairness: rates, odds, impact and calibration per protected attribute value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise.metrics.classification import confusion_counts, ratio


def _spread(df: DataFrame, value: Column) -> tuple[Column, Column]:
    return F.max(value), F.min(value)


def demographic_parity(df: DataFrame, yhat: str, group: str) -> DataFrame:
    """Largest gap between group prediction rates, their ratio, and whether the gap is below 0.1."""
    rates = df.groupBy(group).agg(F.avg(F.col(yhat).cast("double")).alias("rate"))
    hi, lo = _spread(rates, F.col("rate"))
    return rates.agg((hi - lo).alias("disparity"), F.when(hi > 0, lo / hi).otherwise(1.0).alias("ratio")).withColumn(
        "demographic_parity", F.col("disparity") < 0.1)


def equalized_odds(df: DataFrame, y: str, yhat: str, group: str) -> DataFrame:
    """Gaps of the true and false positive rates over groups."""
    c = confusion_counts(df, y, yhat, [group]).withColumns({
        "tpr": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "fpr": ratio(F.col("fp"), F.col("fp") + F.col("tn"))})
    return c.agg((F.max("tpr") - F.min("tpr")).alias("tpr_disparity"), (F.max("fpr") - F.min("fpr")).alias("fpr_disparity")).withColumn(
        "equalized_odds", (F.col("tpr_disparity") < 0.1) & (F.col("fpr_disparity") < 0.1))


def disparate_impact(df: DataFrame, yhat: str, group: str, privileged: str | None = None) -> DataFrame:
    """Rate of each other group relative to the privileged one (default: first in order), and the 80 % rule on the smallest."""
    rates = df.groupBy(F.col(group).cast("string").alias("grp")).agg(F.avg(F.col(yhat).cast("double")).alias("rate"))
    best = F.lit(privileged) if privileged is not None else rates.agg(F.min("grp")).scalar()
    base = rates.agg(F.max(F.when(F.col("grp") == best, F.col("rate")))).scalar()
    out = rates.filter(F.col("grp") != best).withColumn("impact_ratio", F.when(base > 0, F.col("rate") / base).otherwise(1.0))
    # One row per group value: a small table.
    low = F.min("impact_ratio").over(Window.partitionBy(F.lit(0)))
    return out.withColumns({"privileged_group": best, "privileged_rate": base, "min_ratio": low, "disparate_impact": low >= 0.8})


def calibration(df: DataFrame, y: str, score: str, group: str, n_bins: int = 10) -> DataFrame:
    """Per group and bin: mean prediction, mean outcome and size.  Edges are i * (1 / bins) as floating numbers."""
    s = F.col(score)
    step = 1.0 / n_bins
    bin_ = F.lit(-1)
    for i in range(n_bins + 1):
        bin_ = bin_ + (s >= F.lit(i * step)).cast("int")
    bin_ = F.least(F.greatest(bin_, F.lit(0)), F.lit(n_bins - 1))
    return df.groupBy(F.col(group).alias("grp"), bin_.alias("bin")).agg(
        F.avg(s).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("mean_actual"), F.count(F.lit(1)).alias("n"))


def expected_calibration_error(df: DataFrame, y: str, score: str, group: str, n_bins: int = 10) -> DataFrame:
    bins = calibration(df, y, score, group, n_bins)
    return bins.groupBy("grp").agg(
        (F.sum(F.col("n") * F.abs(F.col("mean_predicted") - F.col("mean_actual"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n_samples"))


def by_attribute(df: DataFrame, y: str, yhat: str, attributes: Sequence[str]) -> DataFrame:
    """Parity, odds and impact of several attributes from one pass over (attribute, value) pairs."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes]))
    long = df.select(y, yhat, pairs.alias("p")).select(y, yhat, "p.*").filter("value is not null")
    c = confusion_counts(long, y, yhat, ["attribute", "value"]).withColumns({
        "rate": ratio(F.col("tp") + F.col("fp"), F.col("n")), "tpr": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        "fpr": ratio(F.col("fp"), F.col("fp") + F.col("tn"))})
    per = c.groupBy("attribute").agg(
        (F.max("rate") - F.min("rate")).alias("disparity"), F.when(F.max("rate") > 0, F.min("rate") / F.max("rate")).otherwise(1.0).alias("ratio"),
        (F.max("tpr") - F.min("tpr")).alias("tpr_disparity"), (F.max("fpr") - F.min("fpr")).alias("fpr_disparity"),
        F.min_by("rate", "value").alias("privileged_rate"), F.min("value").alias("privileged_group"))
    others = c.join(per.select("attribute", "privileged_group"), "attribute").filter("value <> privileged_group") \
        .groupBy("attribute").agg(F.min("rate").alias("_low"))
    low = F.when(F.col("privileged_rate") > 0, F.col("_low") / F.col("privileged_rate")).otherwise(1.0)
    return per.join(others, "attribute", "left").withColumn("min_impact_ratio", F.coalesce(low, F.lit(1.0))).drop("_low").withColumns({
        "demographic_parity": F.col("disparity") < 0.1,
        "equalized_odds": (F.col("tpr_disparity") < 0.1) & (F.col("fpr_disparity") < 0.1),
        "disparate_impact": F.col("min_impact_ratio") >= 0.8})
