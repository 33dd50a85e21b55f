"""Paired comparisons of models.  Sums run on Spark; p-values are finished on single result rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise.operators.quantiles import quantiles
from stopwise.ordered import with_running


def paired_t(df: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean and spread of the differences, t statistic, effect size and standard error."""
    d = F.col(a) - F.col(b)
    out = df.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("std_difference"))
    se = F.col("std_difference") / F.sqrt(F.col("n").cast("double"))
    return out.withColumns({"standard_error": se, "t_statistic": F.try_divide(F.col("mean_difference"), se),
                            "cohens_d": F.when(F.col("std_difference") > 0, F.col("mean_difference") / F.col("std_difference")).otherwise(0.0)})


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def t_two_sided(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    x = dof / (dof + t * t)
    a, b = dof / 2, 0.5
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(max(1 - x, 1e-300)))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_cf(a, b, x) / a
    return 1 - front * _beta_cf(b, a, 1 - x) / b


def t_quantile(p: float, dof: float) -> float:
    """Quantile of Student's t for p above one half, by bisection on the p-value."""
    lo, hi = 0.0, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        if 1 - t_two_sided(mid, dof) / 2 < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def paired_t_report(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> dict:
    """The t test with p-value and confidence interval (one row is read)."""
    r = paired_t(df, a, b).first().asDict()
    dof = r["n"] - 1
    r["p_value"] = t_two_sided(r["t_statistic"], dof) if r["t_statistic"] is not None else 1.0
    half = t_quantile(1 - alpha / 2, dof) * (r["standard_error"] or 0.0)
    return {**r, "significant": r["p_value"] < alpha, "ci_lower": r["mean_difference"] - half, "ci_upper": r["mean_difference"] + half}


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """Signed rank statistic: non-zero differences ranked by size, equal sizes share the average rank."""
    d = df.select((F.col(a) - F.col(b)).alias("_d")).filter("_d <> 0")
    sizes = d.groupBy(F.lit(0).alias("_all"), F.abs("_d").alias("_m")).agg(
        F.sum((F.col("_d") > 0).cast("long")).alias("plus"), F.count(F.lit(1)).alias("c"))
    ranked = with_running(sizes, ["_all"], ["_m"], {"cum": ("sum", F.col("c"))})
    rank = F.col("cum") - (F.col("c") - 1) / 2
    sums = ranked.agg(F.sum(rank * F.col("plus")).alias("w_plus"), F.sum(rank * (F.col("c") - F.col("plus"))).alias("w_minus"),
                      F.sum("c").alias("n"))
    n, w = F.col("n").cast("double"), F.least("w_plus", "w_minus")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return sums.select("n", w.alias("statistic"), F.try_divide(w - n * (n + 1) / 4, spread).alias("z_score"),
                       (1 - 2 * w / (n * (n + 1))).alias("effect_size"))


def wilcoxon_report(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> dict:
    r = wilcoxon(df, a, b).first().asDict()
    r["p_value"] = math.erfc(abs(r["z_score"] or 0.0) / math.sqrt(2))
    return {**r, "significant": r["p_value"] < alpha}


def mcnemar(df: DataFrame, y: str, p1: str, p2: str) -> DataFrame:
    """Discordant counts and the continuity-corrected statistic."""
    one, two = F.col(p1) == F.col(y), F.col(p2) == F.col(y)
    out = df.agg(F.sum((one & ~two).cast("long")).alias("b"), F.sum((~one & two).cast("long")).alias("c"), F.count(F.lit(1)).alias("n_samples"))
    return out.withColumn("chi2_statistic", F.coalesce(F.try_divide(F.pow(F.abs(F.col("b") - F.col("c")) - 1, 2), F.col("b") + F.col("c")), F.lit(0.0)))


def mcnemar_report(df: DataFrame, y: str, p1: str, p2: str, alpha: float = 0.05) -> dict:
    r = mcnemar(df, y, p1, p2).first().asDict()
    r["p_value"] = 1.0 if r["b"] + r["c"] == 0 else math.erfc(math.sqrt(r["chi2_statistic"] / 2))
    return {**r, "significant": r["p_value"] < alpha}


def bootstrap_mean(df: DataFrame, value: str, row_id: str, replicates: int = 200, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Bootstrap interval of a mean.  Each row gets a Poisson(1) count per replicate from a hash of its id, so the
    result does not depend on partitioning; rows are never exploded, each replicate is one pair of sums."""
    steps, p, total = [], math.exp(-1), 0.0
    for k in range(8):
        total += p
        steps.append(total)
        p /= k + 1
    def weight(b: int) -> Column:
        u = F.pmod(F.xxhash64(row_id, F.lit(seed), F.lit(b)), F.lit(1_000_000_007)) / 1_000_000_007.0
        return sum(((u > s).cast("int") for s in steps), F.lit(0))
    sums = []
    for b in range(replicates):
        sums.append(F.struct(F.lit(b).alias("b"), F.sum(F.col(value) * weight(b)).alias("s"), F.sum(weight(b)).alias("w")))
    parts = [df.agg(F.array(*sums[i:i + 50]).alias("r")) for i in range(0, replicates, 50)]
    means = parts[0]
    for extra in parts[1:]:
        means = means.unionByName(extra)
    means = means.select(F.explode("r").alias("r")).select(F.try_divide("r.s", "r.w").alias("m"))
    tail = (1 - level) / 2
    q = quantiles(means, [], "m", {"ci_lower": tail, "ci_upper": 1 - tail})
    stats = df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return stats.withColumns({"ci_lower": q.select("ci_lower").scalar(), "ci_upper": q.select("ci_upper").scalar()})


def correct_p_values(df: DataFrame, p: str = "p_value", alpha: float = 0.05, method: str = "holm") -> DataFrame:
    """Bonferroni or Holm decision per comparison (a table with one row per model)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    if method == "bonferroni":
        return df.withColumn("corrected_alpha", alpha / n).withColumn("significant_corrected", F.col(p) < F.col("corrected_alpha"))
    order = Window.partitionBy(F.lit(0)).orderBy(p, "model")
    ok = (F.col(p) <= alpha / (n - F.row_number().over(order) + 1)).cast("int")
    return df.withColumn("_ok", ok).withColumn(
        "significant_corrected", F.min("_ok").over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_ok")


def compare_models(df: DataFrame, baseline: str, models: list[str], alpha: float = 0.05, method: str = "holm") -> DataFrame:
    """Each model against the baseline by the paired t test, with corrected decisions (one short driver row each)."""
    rows = []
    for m in models:
        r = paired_t_report(df, baseline, m, alpha)
        rows.append((m, baseline, float(r["mean_difference"]), float(r["t_statistic"] or 0.0), float(r["p_value"]), float(r["cohens_d"]), bool(r["significant"])))
    out = df.sparkSession.createDataFrame(
        rows, "model string, baseline string, mean_diff double, t_statistic double, p_value double, cohens_d double, significant boolean")
    return correct_p_values(out, alpha=alpha, method=method)
