"""Classification, ranking, ordinal, lead-time and operational metrics as aggregates.

Counts come from one conditional-sum pass.  Ranking metrics first collapse to one row per distinct score and then
accumulate along the score with the slot-wise running sum, so a billion rows never meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.operators.quantiles import quantiles
from stopwise.ordered import with_running


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 when b is 0."""
    return F.when(b != 0, a.cast("double") / b).otherwise(0.0)


def confusion_counts(df: DataFrame, y: str, yhat: str, keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn and n per key."""
    a, p = F.col(y).cast("int") == 1, F.col(yhat).cast("int") == 1
    def n(cond: Column) -> Column:
        return F.sum(F.coalesce(cond, F.lit(False)).cast("long"))
    return df.groupBy(*keys).agg(n(a & p).alias("tp"), n(~a & p).alias("fp"), n(a & ~p).alias("fn"), n(~a & ~p).alias("tn"),
                                 F.count(F.lit(1)).alias("n"))


def from_counts(counts: DataFrame) -> DataFrame:
    """Every binary metric as arithmetic over the four counts; a zero denominator gives 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    precision, recall, spec = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    acc = ratio(tp + tn, n)
    chance = ratio((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    neg_precision, neg_f1 = ratio(tn, tn + fn), ratio(2 * tn, 2 * tn + fp + fn)
    f1 = ratio(2 * tp, 2 * tp + fp + fn)
    return counts.withColumns({
        "accuracy": acc, "precision": precision, "recall": recall, "f1": f1, "specificity": spec,
        "precision_macro": (precision + neg_precision) / 2, "recall_macro": (recall + spec) / 2, "f1_macro": (f1 + neg_f1) / 2,
        "f1_weighted": ratio(f1 * (tp + fn) + neg_f1 * (tn + fp), n),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "balanced_accuracy": (recall + spec) / 2, "g_mean": F.sqrt(recall * spec),
        "kappa": ratio(acc - chance, 1 - chance), "error_rate": 1 - acc,
    })


def binary_metrics(df: DataFrame, y: str, yhat: str, keys: Sequence[str] = ()) -> DataFrame:
    return from_counts(confusion_counts(df, y, yhat, keys))


def score_curve(df: DataFrame, y: str, score: str, keys: Sequence[str]) -> DataFrame:
    """Per key and distinct score: positives and negatives there, and at or above it."""
    pos = F.col(y).cast("int")
    per = df.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("_s")).agg(
        F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))
    return with_running(per, list(keys), ["_s"], {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))}, descending=True)


def ranking_metrics(df: DataFrame, y: str, score: str, keys: Sequence[str] = (), min_positives: int = 0) -> DataFrame:
    """ROC-AUC with averaged ties (null below ``min_positives``) and step-wise average precision per key."""
    keys = list(keys)
    if not keys:
        one = df.select(F.lit(0).alias("_all"), y, score)
        return ranking_metrics(one, y, score, ["_all"], min_positives).drop("_all")
    curve = score_curve(df, y, score, keys)
    totals = curve.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    below = F.col("_n") - F.col("fp")
    wins = F.col("pos") * (below + F.col("neg") / 2)
    step = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    out = curve.join(totals, keys).groupBy(*keys, "_p", "_n").agg(F.sum(wins).alias("_w"), F.sum(step).alias("_ap"))
    return out.select(
        *keys, F.col("_p").alias("positives"), F.col("_n").alias("negatives"),
        F.when(F.col("_p") >= min_positives, F.try_divide(F.col("_w"), F.col("_p").cast("double") * F.col("_n"))).alias("roc_auc"),
        F.try_divide(F.col("_ap"), F.col("_p").cast("double")).alias("pr_auc"))


THRESHOLDS = tuple(0.15 + 0.05 * i for i in range(14))
TARGET_THRESHOLDS = tuple(0.10 + 0.05 * i for i in range(17))


def threshold_table(df: DataFrame, y: str, score: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """F1 and counts at each threshold, from one row per distinct score bucket (never rows times thresholds)."""
    s = F.col(score)
    step = F.lit(0)
    for t in thresholds:
        step = step + (s >= F.lit(float(t))).cast("int")
    cells = df.groupBy(step.alias("_passed")).agg(F.sum(F.col(y).cast("int")).alias("pos"), F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("pos")).scalar()
    levels = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(thresholds)]))
    each = cells.select("*", levels.alias("_l")).groupBy("_l.i", "_l.threshold").agg(
        F.sum(F.when(F.col("_passed") >= F.col("_l.i"), F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("_passed") >= F.col("_l.i"), F.col("n")).otherwise(0)).alias("predicted"))
    return each.withColumn("f1", ratio(2 * F.col("tp"), F.col("predicted") + total)).drop("i")


def tune_threshold(df: DataFrame, y: str, score: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Threshold with the best F1 (the first on ties); empty predictions are skipped, 0.5 when none scores."""
    table = threshold_table(df, y, score, thresholds).filter("predicted > 0 and f1 > 0")
    best = table.agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("b"))
    return best.select(F.coalesce(F.col("b.threshold"), F.lit(0.5)).alias("threshold"), F.coalesce(F.col("b.f1"), F.lit(0.0)).alias("f1"))


def multilabel_metrics(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Macro, micro, weighted and samples F1, Hamming loss, Jaccard, subset accuracy over (truth, prediction) columns."""
    def total(cond) -> Column:
        return F.sum(cond.cast("long"))
    aggs, per_row = [], {"tp": F.lit(0), "fp": F.lit(0), "fn": F.lit(0)}
    for i, (y, p) in enumerate(pairs):
        a, b = F.col(y).cast("int") == 1, F.col(p).cast("int") == 1
        for name, cond in (("tp", a & b), ("fp", ~a & b), ("fn", a & ~b)):
            aggs.append(total(cond).alias(f"{name}{i}"))
            per_row[name] = per_row[name] + cond.cast("int")
    union = per_row["tp"] + per_row["fp"] + per_row["fn"]
    wrong = per_row["fp"] + per_row["fn"]
    aggs += [F.avg(ratio(2 * per_row["tp"], per_row["tp"] + union)).alias("f1_samples"),
             F.avg(ratio(per_row["tp"], union)).alias("jaccard_index"), F.avg((wrong == 0).cast("double")).alias("subset_accuracy"),
             (F.sum(wrong) / (F.count(F.lit(1)) * len(pairs))).alias("hamming_loss")]
    wide = df.agg(*aggs)
    k = range(len(pairs))
    def all_of(name: str) -> Column:
        return sum((F.col(f"{name}{i}") for i in k), F.lit(0))
    f1 = [ratio(2 * F.col(f"tp{i}"), 2 * F.col(f"tp{i}") + F.col(f"fp{i}") + F.col(f"fn{i}")) for i in k]
    support = [F.col(f"tp{i}") + F.col(f"fn{i}") for i in k]
    out = wide.withColumns({
        "f1_macro": sum(f1, F.lit(0.0)) / len(pairs),
        "f1_weighted": ratio(sum((f * s for f, s in zip(f1, support)), F.lit(0.0)), sum(support, F.lit(0))),
        "f1_micro": ratio(2 * all_of("tp"), 2 * all_of("tp") + all_of("fp") + all_of("fn")),
        "precision_micro": ratio(all_of("tp"), all_of("tp") + all_of("fp")), "recall_micro": ratio(all_of("tp"), all_of("tp") + all_of("fn"))})
    return out.drop(*[f"{n}{i}" for n in ("tp", "fp", "fn") for i in k])


def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    e = F.col(y) - F.col(yhat)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def ordinal_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Accuracy within 0, 1 and 2 classes, mean distance, class means; weighted F1 comes from ``per_class``."""
    d = F.abs(F.col(y) - F.col(yhat))
    out = df.agg(F.avg((d == 0).cast("double")).alias("accuracy"), F.avg((d <= 1).cast("double")).alias("pareto_accuracy_1"),
                 F.avg((d <= 2).cast("double")).alias("pareto_accuracy_2"), F.avg(d).alias("mean_abs_distance"),
                 F.avg(y).alias("true_class_mean"), F.avg(yhat).alias("pred_class_mean"))
    weighted = per_class(df, y, yhat).agg(ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")))
    return out.withColumn("f1_ordinal", weighted.scalar())


def confusion_matrix(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("actual"), F.col(yhat).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Precision, sensitivity, specificity, F1 and support of each class, from the confusion matrix."""
    cells = confusion_matrix(df, y, yhat)
    actual = cells.groupBy(F.col("actual").alias("cls")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    predicted = cells.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("predicted_n"))
    total = cells.agg(F.sum("n")).scalar()
    m = actual.join(predicted, "cls", "left").withColumn("predicted_n", F.coalesce("predicted_n", F.lit(0)))
    fp, fn = F.col("predicted_n") - F.col("tp"), F.col("support") - F.col("tp")
    tn = total - F.col("tp") - fp - fn
    return m.withColumns({
        "precision": ratio(F.col("tp"), F.col("predicted_n")), "sensitivity": ratio(F.col("tp"), F.col("support")),
        "specificity": ratio(tn, tn + fp), "f1": ratio(2 * F.col("tp"), F.col("support") + F.col("predicted_n"))})


LEADS = (5, 10, 15, 30, 60)


def lead_time_metrics(df: DataFrame, y: str, yhat: str, lead: str) -> DataFrame:
    """Lead times of the true positives: mean, median, range, share at or above each limit, detection delay."""
    hits = df.filter((F.col(y) == 1) & (F.col(yhat) == 1))
    out = hits.agg(
        F.coalesce(F.avg(lead), F.lit(0.0)).alias("mean_lead_time"), F.min(lead).alias("min_lead_time"), F.max(lead).alias("max_lead_time"),
        *[(F.avg((F.col(lead) >= t).cast("double")) * 100).alias(f"lead_time_pct_{t}min") for t in LEADS])
    median = quantiles(hits, [], lead, {"m": 0.5}).scalar()
    return out.withColumns({"median_lead_time": F.coalesce(median, F.lit(0.0)), "lead_time_gain": F.col("mean_lead_time"),
                            "detection_delay": -F.col("mean_lead_time")})


def rolling_windows_metrics(df: DataFrame, time: str, y: str, yhat: str, score: str, days: int = 7) -> DataFrame:
    """Binary and ranking metrics per tumbling window of days counted from the first instant.

    A last row that sits exactly on a window start, with no later row, opens no window.
    """
    width = days * 86_400_000_000
    edge = df.agg(F.min(F.unix_micros(time)).alias("lo"), F.max(F.unix_micros(time)).alias("hi"))
    lo, hi = edge.select("lo").scalar(), edge.select("hi").scalar()
    us = F.unix_micros(time)
    w = df.withColumn("window_no", F.floor((us - lo) / F.lit(width)).cast("long"))
    w = w.filter((us < hi) | ((us - lo) % F.lit(width).cast("long") != 0))
    start = lo + F.col("window_no") * F.lit(width).cast("long")
    return binary_metrics(w, y, yhat, ["window_no"]).join(ranking_metrics(w, y, score, ["window_no"]), "window_no").withColumns({
        "window_start": F.timestamp_micros(start), "window_end": F.timestamp_micros(start + F.lit(width).cast("long"))})


def best_model(summary: DataFrame, model: str = "model", auc: str = "auc", f1: str = "f1_macro") -> DataFrame:
    """Model with the best AUC, or by F1 when no AUC is valid; the first name on ties."""
    usable = F.col(auc).isNotNull() & ~F.isnan(auc)
    pick = summary.agg(
        F.max_by(F.col(model), F.when(usable, F.struct(F.col(auc), -F.col("order")))).alias("by_auc"),
        F.max_by(F.col(model), F.when(F.col(f1).isNotNull(), F.struct(F.col(f1), -F.col("order")))).alias("by_f1"),
        F.min_by(F.col(model), F.col("order")).alias("first"))
    return pick.select(F.coalesce("by_auc", "by_f1", "first").alias("model"),
                       F.when(F.col("by_auc").isNotNull(), "auc").when(F.col("by_f1").isNotNull(), "f1_macro").otherwise("first").alias("basis"))


def eval_targets(df: DataFrame, targets: Sequence[str], min_positives: int = 3) -> DataFrame:
    """Targets with enough positives to be evaluated."""
    rows = F.array(*[F.struct(F.lit(t).alias("target"), F.sum(F.col(t).cast("int")).alias("positives")) for t in targets])
    return df.agg(rows.alias("_r")).select(F.explode("_r").alias("r")).select("r.*").filter(F.col("positives") >= min_positives)
