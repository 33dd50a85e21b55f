"""Sliced computation of hot keys equals the plain window."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stopwise import skew
from stopwise.operators.horizon import forward_targets
from stopwise.operators.quantiles import quantiles
from stopwise.ordered import as_of, count_within, with_running, with_totals, with_windows
from stopwise.skew import HOT_ROWS_CONF, attach, hot_keys, hot_table, lookup, shared_hot_keys, with_slots

BY = ["feed_timestamp", "obs_id"]


def plain():
    return Window.partitionBy("key").orderBy(*BY)


def rows(df, *cols):
    return sorted((tuple(None if v is None else round(v, 6) if isinstance(v, float) else v for v in r)
                   for r in df.select("obs_id", *cols).collect()))


def test_slots_follow_the_order_and_split_only_hot_keys(spark, skewed, split_keys):
    slotted = with_slots(skewed, hot_keys(skewed, ["key"], BY), ["key"], BY)
    assert slotted.filter("key <> 'hot' and _slot <> 0").count() == 0
    assert slotted.filter("key = 'hot'").select("_slot").distinct().count() >= 8
    back = F.lag("_slot").over(plain()) > F.col("_slot")
    assert slotted.withColumn("b", back).filter("b").count() == 0


def test_equal_clocks_are_split_along_the_second_column(spark, split_keys):
    df = spark.range(200).selectExpr("'a' as key", "1L as first", "id as second")
    slots = with_slots(df, hot_keys(df, ["key"], ["first", "second"]), ["key"], ["first", "second"])
    assert slots.select("_slot").distinct().count() >= 8


@pytest.mark.parametrize("value", [
    "case when id = 7 then 1e12 else exp(4 * randn(5)) end",  # log-normal and one outlier
    "cast(case when id % 20 = 0 then id * 1000000 else 7000000 + id % 3600 end as bigint)",  # one busy hour
    "lpad(cast(id as string), 6, '0')"])
@pytest.mark.parametrize("limit", [100, 1000])
def test_slots_hold_about_equally_many_rows(spark, split_keys, value, limit):
    """Also with more slices than quantiles (limit 100: 300 of them, over 256 cuts), if loosely."""
    spark.conf.set("spark.stopwise.hotRows", str(limit))
    df = spark.range(30_000).selectExpr("'a' as key", f"{value} as first", "id as second").cache()
    slots = with_slots(df, hot_keys(df, ["key"], ["first", "second"]), ["key"], ["first", "second"])
    back = F.lag("_slot").over(Window.partitionBy("key").orderBy("first", "second")) > F.col("_slot")
    assert slots.withColumn("b", back).filter("b").count() == 0
    assert slots.groupBy("_slot").count().agg(F.max("count")).first()[0] <= 2 * limit


@pytest.mark.parametrize("back,ahead", [(7, 0), (0, 4), (7, 4)])
def test_row_frames(skewed, split_keys, back, ahead):
    def cols(w):
        return {"m": F.avg("v").over(w.rowsBetween(-back, ahead)), "p": F.lag("v", max(back, 1)).over(w) if back else F.lead("v", ahead).over(w)}
    got = with_windows(skewed, ["key"], BY, ["v"], [cols], back=back, ahead=ahead)
    want = skewed
    for name, c in cols(plain()).items():
        want = want.withColumn(name, c)
    assert rows(got, "m", "p") == rows(want, "m", "p")


@pytest.mark.parametrize("down", [False, True])
@pytest.mark.parametrize("current", [False, True])
def test_running_values(skewed, split_keys, down, current):
    kinds = ("sum", "count", "min", "max", "last")
    got = with_running(skewed, ["key"], BY, {k: (k, F.col("v")) for k in kinds}, include_current=current, descending=down)
    order = [F.col(c).desc() if down else F.col(c).asc() for c in BY]
    frame = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    want = skewed.withColumns({k: (F.last("v", True) if k == "last" else getattr(F, k)("v")).over(frame) for k in kinds})
    assert rows(got, *kinds) == rows(want, *kinds)


def test_totals_and_attach_keep_every_row(skewed, split_keys):
    got = with_totals(skewed, ["key"], [F.avg("v").alias("m")], spread=F.col("obs_id"))
    want = skewed.withColumn("m", F.avg("v").over(Window.partitionBy("key")))
    assert rows(got, "m") == rows(want, "m")


def test_attach_with_null_keys(spark, skewed, split_keys):
    df = skewed.withColumn("key", F.when(F.col("obs_id") % 2 == 0, F.col("key")))
    totals = df.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    got = attach(df, totals, ["key"], F.col("obs_id"))
    assert got.count() == 300
    assert got.filter("key is null and n is not null").count() == 0


def test_lookup_takes_both_ways(spark, skewed, split_keys):
    dim = skewed.groupBy("key").agg(F.max("obs_id").alias("top"))
    small = rows(lookup(skewed, dim, ["key"], F.col("obs_id")), "top")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(lookup(skewed, dim, ["key"], F.col("obs_id")), "top") == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_count_within_and_as_of_against_brute_force(skewed, split_keys):
    span = 10 * 60_000_000
    got = {r["obs_id"]: r["n"] for r in count_within(skewed, ["key"], "feed_timestamp", F.col("flag"), "obs_id", span, "n").collect()}
    data = skewed.select("obs_id", "key", F.unix_micros("feed_timestamp").alias("us"), "v", "flag").collect()
    for a in data:
        want = sum(b["flag"] and b["key"] == a["key"] and a["us"] - span <= b["us"] < a["us"] for b in data) if a["flag"] else 0
        assert got[a["obs_id"]] == want
    facts = skewed.filter("v is not null").select("key", F.col("feed_timestamp").alias("seen"), F.col("obs_id").alias("rank"), F.col("v").alias("hit"))
    found = {r["obs_id"]: r["hit"] for r in as_of(skewed, facts, ["key"], "feed_timestamp", "seen", ["rank", "hit"], "obs_id", span).collect()}
    assert len(found) == 300
    for a in data:
        past = [(b["us"], b["obs_id"], b["v"]) for b in data if b["key"] == a["key"] and b["v"] is not None and b["us"] <= a["us"] - span]
        assert found[a["obs_id"]] == (max(past)[2] if past else None)


def test_quantiles_match_linear_interpolation(skewed, split_keys):
    got = {r["key"]: r for r in quantiles(skewed, ["key"], "v", {"a": 0.1, "b": 0.5, "c": 0.99}).collect()}
    data = skewed.filter("v is not null").select("key", "v").toPandas()
    for key, group in data.groupby("key"):
        assert np.allclose([got[key]["a"], got[key]["b"], got[key]["c"]], np.quantile(group["v"], [0.1, 0.5, 0.99]))


def test_result_does_not_depend_on_partitioning(skewed, split_keys):
    def run(df):
        return rows(with_running(df, ["key"], BY, {"s": ("sum", F.col("v"))}), "s")
    assert run(skewed.repartition(1)) == run(skewed.repartition(8)) == run(skewed.orderBy(F.rand(3)))


def test_plans_without_hot_keys_have_no_slicing_branch(skewed):
    assert hot_table(skewed, ["key"], BY) is None
    got = with_running(with_windows(skewed, ["key"], BY, ["v"], [lambda w: {"p": F.lag("v").over(w)}], back=1), ["key"], BY, {"s": ("sum", F.col("v"))})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_hot_keys_are_looked_for_once_in_a_shared_scope(skewed, split_keys, monkeypatch):
    calls = []
    whole = skew.hot_keys
    monkeypatch.setattr(skew, "hot_keys", lambda *args: calls.append(args) or whole(*args))
    with shared_hot_keys():
        first, second = (hot_table(skewed, ["key"], BY) for _ in range(2))
        assert len(calls) == 2 and first is second and first.count() == 1
    assert hot_table(skewed, ["key"], BY) is not first


def test_forward_targets_are_the_same_with_and_without_hot_keys(spark):
    kinds = ["ON_TIME", "MAJOR_DELAY", "ON_TIME", "CANCELLED", None, "ON_TIME", "MINOR_DELAY", "ON_TIME"]
    df = spark.range(240).select(
        F.col("id").alias("obs_id"), F.when(F.col("id") % 13 > 0, F.concat(F.lit("t"), F.col("id") % 2)).alias("trip_id"),
        F.when(F.col("id") % 19 > 0, F.lit("s")).alias("stop_id"),
        F.when(F.col("id") % 23 > 0, F.timestamp_micros(F.floor(F.col("id") / 3) * 240_000_000)).alias("feed_timestamp"),
        F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("id") * 7 % 11 % 8).cast("int")).alias("disruption_type"))
    columns = ["new_disruption", *[f"target_{p}{m}min" for p in ("", "mc_") for m in (10, 30, 60)]]
    cold = rows(forward_targets(df), *columns)
    spark.conf.set(HOT_ROWS_CONF, "10")
    try:
        assert rows(forward_targets(df), *columns) == cold
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
    assert any(r[-1] for r in cold)


def test_keys_are_counted_only_behind_a_full_bucket(spark, monkeypatch):
    """Many keys, missing ones too, cost no shuffle of keys; columns without hot values tell for the pair."""
    monkeypatch.setattr(skew, "hot_keys", lambda *_: pytest.fail("keys were counted"))
    df = spark.range(20_000).selectExpr("case when id % 3 > 0 then id end as key", "cast(id % 5 as string) as few", "id as obs_id")
    assert hot_table(df, ["key"]) is None and hot_table(df, ["few", "key"], ["obs_id"]) is None
    assert skew.buckets(df, ["few"]) == (4000, 5, 20_000) and skew.buckets(df.filter("false"), ["few"]) == (0, 0, 0)
    with shared_hot_keys():
        hot_table(df, ["few"])
        monkeypatch.setattr(skew, "buckets", lambda *_: pytest.fail("rows were counted again"))
        assert hot_table(df, ["few", "key"]) is None


def test_totals_of_one_key_share_a_shuffle(spark):
    """Without a hot key rows are shuffled once for several joins and windows by it; rows with null keys stay."""
    df = spark.range(500).selectExpr("case when id % 9 > 0 then id % 100 end as key", "id as obs_id", "id % 7 as v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = attach(attach(df, df.groupBy("key").agg(F.sum("v").alias("s")), ["key"]), df.groupBy("key").agg(F.max("v").alias("m")), ["key"])
        out = out.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("obs_id")))
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
        got = out.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    of = {}
    for i in range(500):
        of.setdefault(i % 100 if i % 9 else None, []).append(i)
    want = {(k, i, None if k is None else sum(x % 7 for x in v), None if k is None else max(x % 7 for x in v), n + 1) for k, v in of.items() for n, i in enumerate(v)}
    assert {(r["key"], r["obs_id"], r["s"], r["m"], r["r"]) for r in got} == want and len(got) == 500


def test_lookup_of_few_keys_in_a_large_table_moves_no_rows(spark):
    df = spark.range(300).selectExpr("case when id % 4 > 0 then id % 12 end as key", "id as obs_id")
    dim = spark.range(6000).selectExpr("id * 2 as key", "id as x")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = lookup(df, dim, ["key"], F.col("obs_id"))
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        got = {(r["key"], r["obs_id"], r["x"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = [(i % 12 if i % 4 else None, i) for i in range(300)]
    assert got == {(k, i, k // 2 if k is not None and k % 2 == 0 else None) for k, i in keys}
