"""Time-ordered splits, folds, leakage checks and class weights.

A split is a label column, never a list of row numbers.  Exact positions in the time order come from running counts
over time slices, so no step sorts all rows in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopwise.operators.label import disrupted
from stopwise.ordered import with_running
from stopwise.skew import lookup, position

#: Accuracy of the sketch that brackets a cut, and rows that one task may sort for the exact place.
SKETCH = 10_000
FEW = 200_000


def with_rank(df: DataFrame, time: str, row_id: str, out: str = "rank") -> DataFrame:
    """0-based position of each row in (time, id) order."""
    ranked = with_running(df.withColumn("_all", F.lit(0)), ["_all"], [time, row_id], {out: ("count", F.lit(1))})
    return ranked.withColumn(out, F.col(out) - 1).drop("_all")


def _row_at(near: DataFrame, lo: int, hi: int, place: int, size: int) -> Row:
    """The row at a position among ``size`` rows of (``_p``, ``_i``) whose ``_p`` lies from ``lo`` to ``hi``."""
    while size > FEW and lo < hi:
        shares = [min(1.0, max(0.0, place / size + side / SKETCH)) for side in (-2, 2)]
        a, b = near.agg(F.percentile_approx("_p", shares, SKETCH)).first()[0]
        if (a, b) == (lo, hi):
            break
        below, size = near.agg(F.count_if(F.col("_p") < a), F.count_if(F.col("_p").between(a, b))).first()
        near, lo, hi, place = near.filter(F.col("_p").between(a, b)), a, b, place - below
    if size > FEW:  # one instant holds this many rows
        return with_rank(near, "_p", "_i", "_r").filter(F.col("_r") == place).first()
    return near.orderBy("_p", "_i").offset(place).limit(1).first()


def _before_cut(df: DataFrame, time: str, row_id: str, shares: list[float]) -> list[Column]:
    """Whether a row is among the first int(n * share) rows in (time, id) order, for each share.

    A sketch of the instants gives an interval that must hold the row at the cut, about 4 / SKETCH of the table; rows before it
    are only counted, and the interval is narrowed in the same way until few rows are left.  The result is a comparison with
    the row at the cut, so no row is shuffled for the split itself.
    """
    at = F.coalesce(position(df, time), F.lit(-(1 << 53)))  # no time comes first
    rows = df.select(at.alias("_p"), F.col(row_id).alias("_i"))
    around = [min(1.0, max(0.0, share + side / SKETCH)) for share in shares for side in (-2, 2)]
    n, grid = rows.agg(F.count(F.lit(1)), F.percentile_approx("_p", around, SKETCH)).first()
    if not n:
        return [F.lit(True) for _ in shares]
    bounds = [(grid[2 * k], grid[2 * k + 1]) for k in range(len(shares))]
    known = rows.agg(*[x for a, b in bounds for x in (F.count_if(F.col("_p") < a), F.count_if(F.col("_p").between(a, b)))]).first()
    out = []
    for k, (share, (a, b)) in enumerate(zip(shares, bounds)):
        place = math.floor(n * share)
        if place >= n:
            out.append(F.lit(True))
            continue
        row = _row_at(rows.filter(F.col("_p").between(a, b)), a, b, place - known[2 * k], known[2 * k + 1])
        out.append((at < row["_p"]) | ((at == row["_p"]) & (F.col(row_id) < F.lit(row["_i"]))))
    return out


def chronological_split(df: DataFrame, time: str, row_id: str, train: float = 0.7, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """``split`` = train / val / test by position in (time, id) order; the cuts are int(n * ratio), ids are unique."""
    if abs(train + val + test - 1.0) > 1e-8:
        raise ValueError("the ratios must add up to 1")
    if isinstance(df.schema[time].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        first, second = _before_cut(df, time, row_id, [train, train + val])
        return df.withColumn("split", F.when(first, "train").when(second, "val").otherwise("test"))
    n = df.agg(F.count(F.lit(1))).scalar()
    rank = F.col("_rank")
    return with_rank(df, time, row_id, "_rank").withColumn(
        "split", F.when(rank < F.floor(n * F.lit(train)), "train").when(rank < F.floor(n * F.lit(train + val)), "val").otherwise("test")).drop("_rank")


def gap_buffer(df: DataFrame, time: str, gap_minutes: float) -> DataFrame:
    """Drop train rows within the gap of the first val row, and val rows within the gap of the first test row."""
    starts = df.groupBy("split").agg(F.min(F.unix_micros(time)).alias("us"))
    gap = int(gap_minutes * 60_000_000)

    def near(part: str) -> Column:
        start = starts.filter(F.col("split") == part).select("us").scalar()
        us = F.unix_micros(time)
        return F.coalesce((us >= start - gap) & (us <= start + gap), F.lit(False))

    return df.filter(~((F.col("split") == "train") & near("val")) & ~((F.col("split") == "val") & near("test")))


def boundary_split(df: DataFrame, time: str, train_end: Column, val_end: Column, gap_minutes: float = 0) -> DataFrame:
    """Split at given instants with a gap on both sides of each; rows inside a gap are dropped."""
    us, gap = F.unix_micros(time), int(gap_minutes * 60_000_000)
    a, b = F.unix_micros(train_end), F.unix_micros(val_end)
    label = (F.when(us < a - gap, "train").when((us > a + gap) & (us < b - gap), "val").when(us > b + gap, "test"))
    return df.withColumn("split", label).filter("split is not null")


def index_folds(df: DataFrame, time: str, row_id: str, n_splits: int = 5, test_size: int | None = None, gap: int = 0) -> DataFrame:
    """Walk-forward folds by row position: ``test_fold`` and the array ``train_folds`` of each row."""
    n = df.agg(F.count(F.lit(1))).scalar()
    size = F.lit(test_size) if test_size else F.floor(n / F.lit(n_splits + 1))
    r = F.col("rank")

    def start(i: int) -> Column:
        return size * (i + 1)

    def usable(i: int) -> Column:
        return (start(i) - gap > 0) & (F.least(start(i) + size, n) <= n) & (start(i) < n)

    test = F.lit(None).cast("int")
    for i in range(n_splits):
        test = F.when(usable(i) & (r >= start(i)) & (r < start(i) + size), i).otherwise(test)
    train = F.array_compact(F.array(*[F.when(usable(i) & (r < start(i) - gap), F.lit(i)) for i in range(n_splits)]))
    return with_rank(df, time, row_id).withColumns({"test_fold": test, "train_folds": train})


def fold_rows(df: DataFrame) -> DataFrame:
    """Long form of ``index_folds``: one row per fold a row takes part in."""
    parts = F.concat(
        F.transform("train_folds", lambda f: F.struct(f.alias("fold"), F.lit("train").alias("part"))),
        F.when(F.col("test_fold").isNotNull(), F.array(F.struct(F.col("test_fold").alias("fold"), F.lit("test").alias("part"))))
        .otherwise(F.array().cast("array<struct<fold:int,part:string>>")))
    return df.withColumn("_p", F.explode(parts)).select("*", "_p.*").drop("_p", "train_folds", "test_fold")


def with_day_rank(df: DataFrame, time: str) -> DataFrame:
    """1-based number of the row's day among the days present (the day table is tiny)."""
    days = df.select(F.to_date(time).alias("_day")).distinct()
    ranked = days.withColumn("day_rank", F.row_number().over(Window.orderBy("_day")))
    return lookup(df.withColumn("_day", F.to_date(time)), ranked, ["_day"]).withColumnRenamed("_day", "day")


def day_folds(df: DataFrame, time: str, min_train_days: int) -> DataFrame:
    """Expanding walk-forward by day in long form: fold i trains on days 1..min+i-1 and tests on the next one."""
    days = df.select(F.to_date(time).alias("d")).distinct().agg(F.count(F.lit(1))).scalar()
    ranked = with_day_rank(df, time).withColumn("_last", days - min_train_days)
    last_fold = F.col("_last")
    r = F.col("day_rank")
    test_fold = r - min_train_days
    train_from = F.greatest(F.lit(1), r - min_train_days + 1)
    trains = F.when(train_from <= last_fold, F.sequence(train_from.cast("int"), last_fold.cast("int"))).otherwise(
        F.array().cast("array<int>"))
    parts = F.concat(
        F.transform(trains, lambda f: F.struct(f.alias("fold"), F.lit("train").alias("part"))),
        F.when(test_fold >= 1, F.array(F.struct(test_fold.cast("int").alias("fold"), F.lit("test").alias("part"))))
        .otherwise(F.array().cast("array<struct<fold:int,part:string>>")))
    return ranked.withColumn("_p", F.explode(parts)).select("*", "_p.*").drop("_p", "_last")


@dataclass(frozen=True)
class Rolling:
    train_days: int
    val_days: int
    test_days: int
    step: int = 1

    @property
    def span(self) -> int:
        return self.train_days + self.val_days + self.test_days


# The window presets (train, val, test days).
PRESETS = {"ultra_lean": Rolling(14, 3, 3), "balanced": Rolling(21, 7, 7), "streaming": Rolling(21, 3, 1)}


def preset_ratios(plan: Rolling) -> tuple[float, float, float]:
    """The same preset as shares of a fixed chronological split."""
    return plan.train_days / plan.span, plan.val_days / plan.span, plan.test_days / plan.span


def rolling_windows(df: DataFrame, time: str, plan: Rolling) -> DataFrame:
    """Rolling day windows in long form: ``window_id`` and ``part`` for every complete window a row falls into."""
    days = df.select(F.to_date(time).alias("d")).distinct().agg(F.count(F.lit(1))).scalar()
    ranked = with_day_rank(df, time)
    r = F.col("day_rank") - 1
    last = F.floor((days - plan.span) / plan.step)
    lo = F.greatest(F.lit(0), F.ceil((r - plan.span + 1) / plan.step))
    hi = F.least(last, F.floor(r / plan.step))
    ids = F.when((lo <= hi) & (days >= plan.span), F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(F.array().cast("array<int>"))
    out = ranked.withColumn("window_id", F.explode(ids))
    at = r - F.col("window_id") * plan.step
    return out.withColumn("part", F.when(at < plan.train_days, "train").when(at < plan.train_days + plan.val_days, "val").otherwise("test"))


def day_table(df: DataFrame, time: str) -> DataFrame:
    """One row per day present: ``day``, ``day_rank`` (from 1), rows and disrupted rows, with both sums up to that day."""
    days = df.groupBy(F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(disrupted()).alias("hits"))
    order = Window.orderBy("day")  # one row per day
    return days.withColumns({"day_rank": F.row_number().over(order), "n_to": F.sum("n").over(order), "hits_to": F.sum("hits").over(order)})


def _spans(kind: str, ids: Column, spans: list[tuple[str, Column, Column]]) -> DataFrame:
    """``kind``, ``part``, ``first_rank``, ``last_rank``: one row per part of each id; days are numbered from 1."""
    rows = SparkSession.active().range(1).select(F.explode(ids).alias(kind))
    parts = F.array(*[F.struct(F.lit(p).alias("part"), a.cast("int").alias("first_rank"), b.cast("int").alias("last_rank")) for p, a, b in spans])
    return rows.withColumn("_p", F.explode(parts)).select(kind, "_p.*")


def _up_to(lo: int, hi: Column) -> Column:
    return F.when(hi >= lo, F.sequence(F.lit(lo), hi.cast("int"))).otherwise(F.array().cast("array<int>"))


def fold_spans(days: DataFrame, min_train_days: int) -> DataFrame:
    """The folds of ``day_folds`` as intervals of days: fold i trains on days 1..min+i-1 and tests on the next one."""
    n = days.agg(F.count(F.lit(1))).scalar()
    i = F.col("fold")
    return _spans("fold", _up_to(1, n - min_train_days), [
        ("train", F.lit(1), i + (min_train_days - 1)), ("test", i + min_train_days, i + min_train_days)])


def window_spans(days: DataFrame, plan: "Rolling") -> DataFrame:
    """The windows of ``rolling_windows`` as intervals of days."""
    n = days.agg(F.count(F.lit(1))).scalar()
    start = F.col("window_id") * plan.step
    val, test = plan.train_days, plan.train_days + plan.val_days
    parts = [("train", 0, val), ("val", val, test), ("test", test, plan.span)]
    return _spans("window_id", _up_to(0, F.floor((n - plan.span) / plan.step)), [(p, start + a + 1, start + b) for p, a, b in parts if b > a])


def span_balance(days: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans with rows, disruption rate, first and last day, from the sums up to their ends: a join of two small tables."""
    ends = days.select(F.col("day_rank").alias("last_rank"), F.col("day").alias("last_day"), F.col("n_to").alias("_n1"), F.col("hits_to").alias("_h1"))
    starts = days.select(F.col("day_rank").alias("first_rank"), F.col("day").alias("first_day"), (F.col("n_to") - F.col("n")).alias("_n0"), (F.col("hits_to") - F.col("hits")).alias("_h0"))
    n = F.col("_n1") - F.col("_n0")
    return spans.join(ends, "last_rank").join(starts, "first_rank").withColumns(
        {"n": n, "disruption_rate": (F.col("_h1") - F.col("_h0")) / n}).drop("_n0", "_n1", "_h0", "_h1")


def span_rows(ranked: DataFrame, span: Row) -> DataFrame:
    """Rows of ``with_day_rank`` that lie in a span; no row is copied per fold."""
    return ranked.filter(F.col("day_rank").between(span["first_rank"], span["last_rank"]))


def overlap_check(df: DataFrame, time: str) -> DataFrame:
    """Whether train ends before val begins and val before test; one row with the four instants."""
    ends = df.agg(*[f(F.when(F.col("split") == p, F.col(time))).alias(n) for f, p, n in (
        (F.max, "train", "train_end"), (F.min, "val", "val_start"), (F.max, "val", "val_end"), (F.min, "test", "test_start"))])
    return ends.withColumn("valid", F.coalesce((F.col("train_end") < F.col("val_start")) & (F.col("val_end") < F.col("test_start")), F.lit(True)))


def shared_ids(df: DataFrame, row_id: str) -> DataFrame:
    """Ids that occur in both train and test."""
    return df.filter("split = 'train'").select(row_id).intersect(df.filter("split = 'test'").select(row_id))


def volume(df: DataFrame, time: str, small_rows: int = 10_000, small_days: float = 7) -> DataFrame:
    """Row count, time span in days, size class and the split strategy it leads to."""
    out = df.agg(F.count(F.lit(1)).alias("total_points"),
                 ((F.max(F.unix_micros(time)) - F.min(F.unix_micros(time))) / 86_400_000_000).alias("total_days"))
    small = (F.col("total_points") < small_rows) | (F.col("total_days") < small_days)
    return out.withColumns({"size_category": F.when(small, "small").otherwise("medium_large"),
                            "strategy": F.when(small, "walk_forward").otherwise("fixed_ratio")})


def order_guard(df: DataFrame, time: str) -> DataFrame:
    """Rows in time order, and how many share an instant with an earlier row."""
    per = df.groupBy(time).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicate_timestamps"))


def balance(df: DataFrame, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(disrupted().cast("double")).alias("disruption_rate"))


def train_only_classes(df: DataFrame, watched: tuple[str, ...] = ("MAJOR_DELAY", "CANCELLED")) -> DataFrame:
    """Watched labels that occur in train but in neither val nor test."""
    def n(*parts: str) -> Column:
        return F.sum(F.col("split").isin(*parts).cast("int"))
    counts = df.filter(F.col("disruption_type").isin(*watched)).groupBy("disruption_type").agg(
        n("train").alias("train_n"), n("val", "test").alias("other_n"))
    return counts.filter("train_n > 0 and other_n = 0")


def correlation_shift(df: DataFrame, features: list[str], target: str, threshold: float = 0.8) -> DataFrame:
    """Per feature the correlation with the target in train and val, their difference and the flag; one pass."""
    wide = df.agg(*[F.corr(F.when(F.col("split") == p, F.col(f).cast("double")), F.when(F.col("split") == p, F.col(target).cast("double"))).alias(f"{p}|{f}")
                    for f in features for p in ("train", "val")])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"train|{f}").alias("train_corr"), F.col(f"val|{f}").alias("val_corr")) for f in features])
    out = wide.select(F.explode(rows).alias("r")).select("r.*")
    diff = F.abs(F.col("val_corr") - F.col("train_corr"))
    return out.withColumns({"corr_diff": diff, "suspicious": F.coalesce(diff > threshold, F.lit(False))})


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * count) per class; at most one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    n, k = counts.agg(F.sum("n")).scalar(), counts.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", n / (k * F.col("n")))


def add_class_weight(df: DataFrame, label: str) -> DataFrame:
    """The weights are a few rows whatever the size estimate says; a join by class would put the rows into as few tasks."""
    return df.join(F.broadcast(class_weights(df, label).select(label, F.col("weight").alias("class_weight"))), [label], "left")


def positive_ratio(df: DataFrame, label: str) -> DataFrame:
    """Negatives per positive."""
    return df.agg(F.try_divide(F.sum((F.col(label) == 0).cast("double")), F.sum((F.col(label) == 1).cast("double"))).alias("scale_pos_weight"))


def oversample(df: DataFrame, label: str, row_id: str, seed: int = 42) -> DataFrame:
    """Repeat the rows of smaller classes up to exactly the size of the largest; the remainder goes to the first rows by a seeded hash."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.agg(F.max("_n")).scalar()
    ranked = with_running(df.withColumn("_h", F.xxhash64(row_id, F.lit(seed))), [label], ["_h", row_id], {"_r": ("count", F.lit(1))})
    sized = lookup(ranked, counts, [label])
    copies = F.floor(top / F.col("_n")) + (F.col("_r") <= top % F.col("_n")).cast("long")
    return sized.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("_n", "_r", "_h")
