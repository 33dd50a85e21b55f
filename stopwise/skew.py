"""Hot-key handling shared by every keyed operator.

A key that holds a large share of the rows must never land in one task.  Four tools cover the library:

* ``hot_keys``  finds the keys with more rows than one task should take, with the values at which each is cut.  There are
  at most rows / limit such keys and twice as many cuts (one million for 10**12 rows), which bounds the broadcast.
* ``hot_table``  looks for hot keys once, ahead of the plan, and writes what it finds; without hot keys the plan gets no slicing branch.
* ``with_slots`` splits each hot key into consecutive slices of about equally many rows; cold keys keep slot 0.
* ``attach`` joins per-key totals back to the rows, spreading the rows of hot keys over several salts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopwise.session import cut_lineage

HOT_ROWS_CONF = "spark.stopwise.hotRows"
DEFAULT_HOT_ROWS = 2_000_000
#: Quantiles a hot key is cut at; a key that needs more slices has each piece cut further into equal widths.
GRID = 256
#: Hash buckets that rows are counted in before keys are; a task sends at most so many counts.
BUCKETS = 1 << 14


def hot_limit(spark: SparkSession) -> int:
    """Rows of one key above which it is split."""
    return int(spark.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))


def position(df: DataFrame, name: str) -> Column | None:
    """Order column as a number that keeps its order, or None when it has no such form."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("long")
    if isinstance(kind, T.IntegralType):
        return F.col(name).cast("long")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.col(name).cast("double")
    if isinstance(kind, T.StringType):
        # Strings are ordered by their bytes; six of them fit a double exactly.
        return F.conv(F.rpad(F.substring(F.hex(F.col(name)), 1, 12), 12, "0"), 16, 10).cast("long")
    return None


def _same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & a.eqNullSafe(b)
    return cond


def hot_keys(base: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Keys with too many rows for one task: rows, slices needed and, with ``by``, the cuts along its first column.

    The names begin with ``_h``, so that columns of the rows or totals it is joined to keep theirs.
    Counting is partially aggregated before the shuffle.  Only rows of hot keys are read for the quantiles, so that pass is empty
    when no key is hot.
    """
    limit = hot_limit(base.sparkSession)
    renamed = [F.col(k).alias(f"_h_{k}") for k in keys]
    heavy = base.groupBy(*renamed).agg(F.count(F.lit(1)).alias("_hot_n")).filter(F.col("_hot_n") > limit)
    heavy = heavy.withColumn("_hot_parts", F.ceil(F.col("_hot_n") / F.lit(float(limit))).cast("long"))
    first = position(base, by[0]) if by else None
    if first is None:
        return heavy
    pos = F.nanvl(first.cast("double"), F.lit(None).cast("double"))
    second = position(base, by[1]) if len(by) > 1 else None
    aggs = [F.percentile_approx(pos, F.lit(np.arange(1, GRID) / GRID)).alias("_hot_grid"), F.min(pos).alias("_hot_lo0"), F.max(pos).alias("_hot_hi0")]
    if second is not None:
        aggs += [F.min(second).cast("double").alias("_hot_lo1"), F.max(second).cast("double").alias("_hot_hi1")]
    on = _same([F.col(k) for k in keys], [F.col(f"_h_{k}") for k in keys])
    ids = [f"_h_{k}" for k in keys]
    cut = base.join(F.broadcast(heavy), on).groupBy(*ids, "_hot_n", "_hot_parts").agg(*aggs)
    pieces = F.least(F.col("_hot_parts"), F.lit(GRID))
    every = F.when(pieces > 1, F.sequence(F.lit(1).cast("long"), pieces - 1))
    at = F.transform(every, lambda i: F.get("_hot_grid", F.round(i * GRID / pieces).cast("int") - 1))
    return cut.withColumn("_hot_cuts", F.when(F.col("_hot_grid").isNotNull(), at)).drop("_hot_grid")


_FOUND: ContextVar[dict | None] = ContextVar("found_hot_keys", default=None)


@contextmanager
def shared_hot_keys() -> Iterator[None]:
    """Operators called inside look for the hot keys of the same base and keys only once."""
    if _FOUND.get() is not None:
        yield
        return
    token = _FOUND.set({})
    try:
        yield
    finally:
        _FOUND.reset(token)


def sharing_hot_keys(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Run a function that builds a plan from several operators under ``shared_hot_keys``."""
    @wraps(build)
    def run(*args, **kwargs):
        with shared_hot_keys():
            return build(*args, **kwargs)

    return run


def _once(kind: str, rows: DataFrame, keys: Sequence[str], by: Sequence[str], find: Callable[[], object]) -> object:
    found = _FOUND.get()
    if found is None:
        return find()
    name = (kind, rows.semanticHash(), tuple(keys), tuple(by), hot_limit(rows.sparkSession))
    for known, value in found.setdefault(name, []):
        if known.sameSemantics(rows):
            return value
    value = find()
    found[name].append((rows, value))
    return value


def buckets(base: DataFrame, keys: Sequence[str]) -> tuple[int, int, int]:
    """Rows in the fullest of ``BUCKETS`` hash buckets of the keys, the buckets with rows, and all rows.

    No key has more rows than its bucket.  However many keys there are, only counts of buckets are shuffled.
    """
    narrow = base.select(*keys)

    def count() -> tuple[int, int, int]:
        filled = narrow.groupBy(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
        most, n, rows = filled.agg(F.max("_n"), F.count(F.lit(1)), F.sum("_n")).first()
        return most or 0, n, rows or 0

    return _once("buckets", narrow, keys, (), count)


def _counted(base: DataFrame, keys: Sequence[str]) -> bool:
    """Whether the rows of these keys were found to be few in each bucket already."""
    narrow = base.select(*keys)
    name = ("buckets", narrow.semanticHash(), tuple(keys), (), hot_limit(base.sparkSession))
    return any(known.sameSemantics(narrow) and most <= hot_limit(base.sparkSession) for known, (most, _, _) in (_FOUND.get() or {}).get(name, []))


def hot_table(base: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame | None:
    """``hot_keys`` as a written table, None when no key is hot.

    A job counts the rows when the plan is built: those of hash buckets, which tells that no key is hot unless a bucket is too full,
    and those of each key only then.  It reads the key columns only, and its result decides whether the plan needs slices, carried
    rows and a quantile pass at all; the results are the same either way.  No key is hot if one of its columns has no hot value.
    """
    narrow = base.select(*keys)
    if len(keys) > 1 and any(_counted(base, [k]) for k in keys):
        return None
    if buckets(base, keys)[0] <= hot_limit(base.sparkSession) or _once("none", narrow, keys, (), lambda: hot_keys(narrow, keys).isEmpty()):
        return None
    needed = base.select(*dict.fromkeys([*keys, *by]))
    return _once("table", needed, keys, by, lambda: cut_lineage(hot_keys(needed, keys, by)))


def _slice(pos: Column, lo: Column, hi: Column, parts: Column) -> Column:
    """Number of the equal-width slice from 0 to ``parts`` - 1, 0 without a position."""
    share = F.try_divide((pos - lo) * parts, hi - lo)
    raw = F.floor(F.coalesce(share, F.lit(0.0))).cast("long")
    return F.coalesce(F.greatest(F.lit(0), F.least(raw, parts - 1)), F.lit(0)).cast("long")


def with_slots(df: DataFrame, hot: DataFrame, keys: Sequence[str], by: Sequence[str], how: str = "left") -> DataFrame:
    """Add ``_slot``: slices of a hot key in order, 0 for the others (``how='inner'`` keeps hot rows only).

    Slot numbers never decrease along ``by``.  Slices end at quantiles of the first order column, so they hold about
    equally many rows however its values lie.  A value that fills several slices is sliced further along the second
    order column.  Rows without a value are in slot 0; keys whose order column has no numeric form stay whole.
    """
    on = _same([F.col(k) for k in keys], [F.col(f"_h_{k}") for k in keys])
    joined = df.join(F.broadcast(hot), on, how)
    if "_hot_cuts" in hot.columns:
        pos = position(df, by[0]).cast("double")
        sub = F.ceil(F.col("_hot_parts") / GRID)
        # Columns of their own, because they are used several times.
        joined = joined.withColumns({"_below": F.size(F.filter("_hot_cuts", lambda c: c < pos)).cast("long"),
                                     "_equal": F.size(F.filter("_hot_cuts", lambda c: c == pos)).cast("long")})
        below, equal = F.col("_below"), F.col("_equal")
        lo = F.when(below == 0, F.col("_hot_lo0")).otherwise(F.get("_hot_cuts", below.cast("int") - 1))
        hi = F.coalesce(F.get("_hot_cuts", below.cast("int")), F.col("_hot_hi0"))
        inside = _slice(pos, lo, hi, sub)
        # A value at a cut starts in the last slice below the cut and ends in the first one above it.
        tied = sub - 1
        if "_hot_lo1" in hot.columns:
            tied = tied + _slice(position(df, by[1]).cast("double"), F.col("_hot_lo1"), F.col("_hot_hi1"), (equal - 1) * sub + 2)
        slot = below * sub + F.when(equal > 0, tied).otherwise(inside)
        slot = F.when(F.col("_hot_cuts").isNull() | pos.isNull(), F.lit(0)).otherwise(slot).cast("long")
    else:
        slot = F.lit(0).cast("long")
    return joined.withColumn("_slot", slot).drop(*hot.columns, "_below", "_equal")


def attach(
    df: DataFrame,
    totals: DataFrame,
    keys: Sequence[str],
    spread: Column | None = None,
    base: DataFrame | None = None,
    instant: bool = False,
) -> DataFrame:
    """Left-join one row per key back to the rows without putting a hot key into one task.

    Rows of a hot key take one of rows / limit salts and the matching total is repeated once per salt; every other key
    has salt 0.  ``spread`` is any well-spread expression of a row (its id); ``base`` a cheaper frame with the same
    key counts.  Null keys never match, and are salted as well so that they do not pile up.  When no key is hot, neither are the null
    keys, which are counted too: the join is a plain one then and can use a shuffle by the keys that is there.

    ``instant`` says that the keys contain the exact instant of the row, so that a key is nearly unique.  Counting is left out
    and adaptive execution splits whatever is still skewed.
    """
    keys = list(keys)
    spread = spread if spread is not None else F.xxhash64(*[c for c in df.columns if c not in keys] or keys)
    mixed = F.xxhash64(spread)
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    hot = None if instant else hot_table(base if base is not None else df, keys)
    if hot is None and not instant:
        return df.join(totals, keys, "left")
    if hot is None:
        left = df.withColumn("_salt", F.when(any_null, mixed).otherwise(F.lit(0)))
        return left.join(totals.withColumn("_salt", F.lit(0).cast("long")), [*keys, "_salt"], "left").drop("_salt")
    on = _same([F.col(k) for k in keys], [F.col(f"_h_{k}") for k in keys])
    left = df.join(F.broadcast(hot), on, "left")
    left = left.withColumn("_salt", F.when(any_null, mixed).otherwise(F.coalesce(F.pmod(mixed, F.col("_hot_parts")), F.lit(0))))
    left = left.drop(*hot.columns)
    right = totals.join(F.broadcast(hot), on, "left")
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce("_hot_parts", F.lit(1)) - 1)
    right = right.withColumn("_salt", F.explode(copies)).drop(*hot.columns)
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")


def small_enough(df: DataFrame) -> bool:
    """Whether the optimizer's size estimate is within the session's broadcast threshold."""
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").lower()
    units = {"kb": 2**10, "k": 2**10, "mb": 2**20, "m": 2**20, "gb": 2**30, "g": 2**30, "b": 1}
    unit = next((u for u in ("kb", "mb", "gb", "k", "m", "g", "b") if text.endswith(u)), "")
    limit = int(text.removesuffix(unit)) * units.get(unit, 1)
    try:
        estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except ValueError:  # an estimate with thousands of digits
        return False
    return 0 <= estimate <= limit


def lookup(df: DataFrame, dim: DataFrame, keys: Sequence[str], spread: Column | None = None,
           base: DataFrame | None = None) -> DataFrame:
    """Left-join a dimension with one row per key: broadcast behind a size check, salted shuffle join beyond it.

    Of a larger dimension only the keys of the rows are broadcast if these are some thousands, so that the rows are not shuffled.
    """
    if small_enough(dim):
        return df.join(F.broadcast(dim), list(keys), "left")
    source = base if base is not None else df
    if buckets(source, keys)[1] <= BUCKETS // 4:
        wanted = source.select(*keys).distinct()
        return df.join(F.broadcast(dim.join(F.broadcast(wanted), list(keys), "left_semi")), list(keys), "left")
    return attach(df, dim, keys, spread, base)
