"""Ordered (window) computation that survives hot keys.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task.  Here the window is partitioned by
``key + slot`` (see ``skew.with_slots``) and what a slot needs from its neighbours is carried over:

* ``with_windows``: frames that reach a fixed number of rows back or ahead.  The last (first) rows of the
  neighbouring slots are copied into the slot and removed again after the computation.
* ``with_running``: values over all rows before (after) a row.  Each slot is aggregated once, the slot totals are
  prefixed along the key, and the prefix is combined with the value inside the slot.
* ``as_of`` and ``count_within``: as-of lookup and counts in a time range, both as running values over a union.

For cold keys all of this reduces to the plain window, because they have exactly one slot.  When no key is hot at all, the plan is
the plain window: one shuffle, which further operators on the same keys share.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stopwise.skew import attach, hot_table, with_slots

Layer = Callable[[WindowSpec], Mapping[str, Column]]


def _carried_rows(slots: DataFrame, keys: list[str], by: list[str], reach: int, backwards: bool) -> DataFrame:
    """The ``reach`` rows before (after) each slot of a hot key, labelled with that slot."""
    near = [F.col(c).desc() if backwards else F.col(c).asc() for c in by]
    edge = Window.partitionBy(*keys, "_slot").orderBy(*near)
    edges = slots.withColumn("_edge", F.row_number().over(edge)).filter(F.col("_edge") <= reach).drop("_edge")
    # Ordered so that "earlier in this order" means "already passed" for the neighbouring slot.
    along = [F.col(c).asc() if backwards else F.col(c).desc() for c in by]
    path = Window.partitionBy(*keys).orderBy(*along)
    row = F.struct(*[c for c in slots.columns if c != "_slot"])
    return (
        edges.withColumn("_next", F.lead("_slot").over(path))
        .withColumn("_rows", F.collect_list(row).over(path.rowsBetween(-(reach - 1), 0)))
        .filter(F.col("_next") != F.col("_slot"))
        .select(F.col("_next").alias("_slot"), F.explode("_rows").alias("_row"))
        .select("_row.*", "_slot")
    )


def _layered(rows: DataFrame, window: WindowSpec, layers: Sequence[Layer]) -> DataFrame:
    for layer in layers:
        for name, value in layer(window).items():
            rows = rows.withColumn(name, value)
    return rows


def with_windows(
    df: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    inputs: Sequence[str],
    layers: Sequence[Layer],
    back: int = 0,
    ahead: int = 0,
    base: DataFrame | None = None,
) -> DataFrame:
    """Add window columns whose frames reach at most ``back`` rows behind and ``ahead`` rows ahead.

    ``layers`` are applied in turn over the same window, so a later one may use columns of an earlier one; ``back``
    and ``ahead`` are the reach of the whole chain.  ``inputs`` names the columns the frames read.  ``base`` is a
    frame with the same rows and those columns but a shorter plan, used for the hot-key pass and the carried rows.
    """
    keys, by = list(keys), list(by)
    source = base if base is not None else df
    hot = hot_table(source, keys, by)
    if hot is None:
        return _layered(df, Window.partitionBy(*keys).orderBy(*by), layers)
    narrow = source.select(*dict.fromkeys([*keys, *by, *inputs]))
    rows = with_slots(df, hot, keys, by).withColumn("_carried", F.lit(False))
    hot_rows = with_slots(narrow, hot, keys, by, how="inner")
    for reach, backwards in ((back, True), (ahead, False)):
        if reach:
            extra = _carried_rows(hot_rows, keys, by, reach, backwards).withColumn("_carried", F.lit(True))
            rows = rows.unionByName(extra, allowMissingColumns=True)
    rows = _layered(rows, Window.partitionBy(*keys, "_slot").orderBy(*by), layers)
    return rows.filter(~F.col("_carried")).drop("_carried", "_slot")


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    values: Mapping[str, tuple[str, Column]],
    include_current: bool = True,
    descending: bool = False,
    base: DataFrame | None = None,
) -> DataFrame:
    """Running values over all rows up to the current one (from the end when ``descending``).

    ``values`` maps an output name to ``(kind, column)`` with kind ``sum``, ``count``, ``min``, ``max`` or ``last``
    (latest non-null).  ``include_current=False`` stops one row earlier.
    """
    keys, by = list(keys), list(by)
    source = base if base is not None else df
    hot = hot_table(source, keys, by)
    args = {f"_v{i}": column for i, (_, column) in enumerate(values.values())}
    rows = (df if hot is None else with_slots(df, hot, keys, by)).select("*", *[column.alias(name) for name, column in args.items()])
    carries, part = [], keys
    if hot is not None:
        rows, carries, part = _with_carried(rows, source, hot, keys, by, values, descending), [f"_c{i}" for i in range(len(values))], [*keys, "_slot"]
    spec = Window.partitionBy(*part).orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c in by])
    frame = spec.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    for i, (name, (kind, _)) in enumerate(values.items()):
        arg, carry = F.col(f"_v{i}"), F.col(f"_c{i}") if carries else None
        value = F.last(arg, True).over(frame) if kind == "last" else getattr(F, kind)(arg).over(frame)
        if kind == "count":
            value = F.coalesce(value, F.lit(0)) + (F.coalesce(carry, F.lit(0)) if carries else F.lit(0))
        elif carries and kind == "last":
            value = F.coalesce(value, carry)
        elif carries and kind == "sum":
            value = F.when(value.isNull(), carry).when(carry.isNull(), value).otherwise(value + carry)
        elif carries:
            value = (F.least if kind == "min" else F.greatest)(value, carry)
        rows = rows.withColumn(name, value)
    return rows.drop("_slot", *args, *carries)


def _with_carried(rows: DataFrame, source: DataFrame, hot: DataFrame, keys: list[str], by: list[str],
                  values: Mapping[str, tuple[str, Column]], descending: bool) -> DataFrame:
    """Slotted rows with what the slots before theirs add up to (``_c0``, ``_c1``, ...)."""
    hot_rows = with_slots(source.select(*dict.fromkeys([*keys, *by]), *[c.alias(f"_v{i}") for i, (_, c) in enumerate(values.values())]),
                          hot, keys, by, how="inner")
    order = F.struct(*by)
    aggs = []
    for i, (kind, _) in enumerate(values.values()):
        arg = F.col(f"_v{i}")
        if kind == "last":
            pick = F.min_by if descending else F.max_by
            aggs.append(pick(arg, F.when(arg.isNotNull(), order)).alias(f"_p{i}"))
        else:
            aggs.append(getattr(F, kind)(arg).alias(f"_p{i}"))
    prefix = hot_rows.groupBy(*keys, "_slot").agg(*aggs)
    direction = F.col("_slot").desc() if descending else F.col("_slot").asc()
    before = Window.partitionBy(*keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    for i, (kind, _) in enumerate(values.values()):
        total = F.col(f"_p{i}")
        fold = F.last(total, True) if kind == "last" else getattr(F, "sum" if kind == "count" else kind)(total)
        prefix = prefix.withColumn(f"_c{i}", fold.over(before))
    prefix = prefix.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.col("_slot").alias("_h_slot"), *[f"_c{i}" for i in range(len(values))])
    on = F.col("_slot") == F.col("_h_slot")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
    # One row per slot of a hot key, that is at most two for every ``hot limit`` rows.
    return rows.join(F.broadcast(prefix), on, "left").drop("_h_slot", *[f"_h_{k}" for k in keys])


def with_totals(
    df: DataFrame,
    keys: Sequence[str],
    aggs: Sequence[Column],
    spread: Column | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """Whole-group aggregates next to each row: partial aggregation, then a salted join back."""
    source = base if base is not None else df
    totals = source.groupBy(*keys).agg(*aggs)
    return attach(df, totals, keys, spread, base=source)


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    left_id: str,
    lag_micros: int = 0,
) -> DataFrame:
    """Latest right values per key with ``right_time <= left_time - lag``; ties go to the larger ``values``.

    Both sides are united on one time line and the last right row is carried forward; no pair of rows is formed.
    Rows of the left side with a null key or time keep null values.
    """
    keys, values = list(keys), list(values)
    probe_us = F.unix_micros(left_time) - F.lit(lag_micros)
    probes = left.select(
        *keys, probe_us.alias("_us"), F.lit(1).alias("_side"), F.col(left_id).alias("_tie"),
        F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_payload"),
        F.struct(*[c for c in left.columns if c not in keys]).alias("_left"))
    facts = right.filter(F.col(right_time).isNotNull()).select(
        *keys, F.unix_micros(right_time).alias("_us"), F.lit(0).alias("_side"),
        F.lit(0).cast(left.schema[left_id].dataType).alias("_tie"), F.struct(*values).alias("_payload"))
    # Several facts at the same instant collapse to one before the union.
    facts = facts.groupBy(*keys, "_us", "_side", "_tie").agg(F.max("_payload").alias("_payload"))
    both = probes.unionByName(facts, allowMissingColumns=True)
    found = with_running(both, keys, ["_us", "_side", "_tie"], {"_hit": ("last", F.col("_payload"))})
    usable = F.col("_us").isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    return found.filter(F.col("_side") == 1).select(
        *keys, "_left.*", *[F.when(usable, F.col("_hit")[v]).alias(v) for v in values])


def count_within(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    flag: Column,
    row_id: str,
    micros: int,
    out: str,
    base: DataFrame | None = None,
) -> DataFrame:
    """Per flagged row, the number of flagged rows of its key in ``[t - micros, t)``; 0 for the other rows.

    Written as a difference of two running counts, so the cost does not depend on how many rows the range holds.
    """
    keys = list(keys)
    source = base if base is not None else df
    marks = source.filter(flag & F.col(time).isNotNull()).select(*keys, F.col(row_id), F.unix_micros(time).alias("_us"))
    # Per instant: a probe sees only increments of strictly earlier instants.
    steps = marks.groupBy(*keys, "_us").agg(F.count(F.lit(1)).alias("_inc"))
    line = (
        steps.select(*keys, "_us", F.lit(1).alias("_side"), "_inc", F.col("_us").alias("_at"), F.lit(1).alias("_sign"))
        .unionByName(steps.select(*keys, (F.col("_us") - F.lit(micros)).alias("_us"), F.lit(0).alias("_side"),
                                  F.lit(0).cast("long").alias("_inc"), F.col("_us").alias("_at"),
                                  F.lit(-1).alias("_sign")))
    )
    run = with_running(line, keys, ["_us", "_side"], {"_before": ("sum", F.col("_inc"))}, include_current=False)
    counts = run.groupBy(*keys, "_at").agg(
        F.sum(F.coalesce("_before", F.lit(0)) * F.col("_sign")).cast("long").alias("_cnt"))
    at = [*keys, "_at"]
    joined = attach(df.withColumn("_at", F.when(flag, F.unix_micros(time))), counts, at, F.col(row_id), instant=True)
    return joined.withColumn(out, F.coalesce("_cnt", F.lit(0))).drop("_cnt", "_at")
