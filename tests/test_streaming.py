"""Stream and batch agree, and the keyed state survives several micro-batches."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stopwise.streaming import feeds, stateful
from stopwise.streaming.updates import UpdatePolicy
from stopwise.testbed import views

from .conftest import SF


def several_batches(spark, df, tmp_path, order, n=4):
    """The rows in time order, one file per micro-batch, written one after the other."""
    ranked = df.withColumn("_part", F.ntile(n).over(Window.orderBy(order))).cache()
    for i in range(1, n + 1):
        ranked.filter(F.col("_part") == i).drop("_part").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return feeds.file_feed(spark, str(tmp_path / "in/*"), df.schema, max_files=1)


def files(spark, tmp_path, *batches):
    """One file per micro-batch, in this order."""
    for i, df in enumerate(batches):
        df.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return feeds.file_feed(spark, str(tmp_path / "in/*"), batches[0].schema, max_files=1)


@pytest.mark.parametrize("block", [16, 4096])
def test_lag_state_across_batches(spark, tmp_path, block):
    """A hot key, rows out of order within and over batches, ties in time: the same as lag over what the watermark has passed."""
    rows = spark.range(3000).selectExpr(
        "id as obs_id", "case when id % 3 < 2 then 'hot' else concat('s', id % 40) end as stop_id",
        "timestamp_seconds(1704067200 + 7 * (id div 2)) as feed_timestamp", "cast(id % 101 as double) as delay_sec").orderBy(F.xxhash64("obs_id"))
    batch = F.floor(F.col("obs_id") / 750 + F.pmod(F.xxhash64("obs_id"), F.lit(100)) / 1000)  # up to 75 rows, four minutes, behind
    parts = [rows.withColumn("b", batch).filter(F.col("b") == i).drop("b") for i in range(5)]
    got = feeds.replay(stateful.lag_features(files(spark, tmp_path, *parts), ["stop_id"], block=block))
    mark = rows.agg(F.max("feed_timestamp") - F.expr("interval 10 minutes")).first()[0]
    w = Window.partitionBy("stop_id").orderBy("feed_timestamp", "obs_id")
    want = rows.withColumns({"prev_delay": F.coalesce(F.lag("delay_sec").over(w), F.lit(0.0)),
                             "headway_sec": (F.unix_micros("feed_timestamp") - F.unix_micros(F.lag("feed_timestamp").over(w))) / 1e6})
    want = want.filter(F.col("feed_timestamp") <= mark).select(*got.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_idle_state_is_dropped(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 0, 5.0), (2, "b", 10, 1.0), (3, "b", 100, 1.0), (4, "a", 300, 2.0), (5, "b", 310, 2.0), (6, "c", 900, 0.0)],
                                 "obs_id long, stop_id string, m long, delay_sec double").withColumn("feed_timestamp", F.timestamp_seconds((F.col("m") + 1000) * 60)).drop("m")
    feed = several_batches(spark, rows, tmp_path, "feed_timestamp", 6)
    got = {r["obs_id"]: r["headway_sec"] for r in feeds.replay(stateful.lag_features(feed, ["stop_id"], idle=240)).collect()}
    assert got == {1: None, 2: None, 3: 5400.0, 4: None, 5: 12600.0}


def test_state_ends_with_the_alert(spark, tmp_path):
    at = lambda minute: f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"
    rows = [(i, "NEW", 600, at(i % 7)) for i in range(50)] + [(i, "RESOLVED", None, at(30 + i % 7)) for i in range(48)] + [(99, "NEW", 600, at(59)), (98, "NEW", 600, at(120))]
    rows += [(1, "RESOLVED", None, at(8)), (1, "ACKNOWLEDGED", None, at(9)), (1, "NEW", 600, at(10))]
    df = spark.createDataFrame(rows, "alert_id long, event string, deadline_min int, at string").withColumn("event_at", F.to_timestamp("at")).drop("at")
    stream = stateful.alert_lifecycle(several_batches(spark, df, tmp_path, "event_at", 4))
    query = feeds.run_to_files(stream, str(tmp_path / "out"))
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert totals[-1] < max(totals) / 4
    out = spark.read.parquet(str(tmp_path / "out/data"))
    assert [tuple(r) for r in out.filter("alert_id = 1").groupBy("status").count().orderBy("status").collect()] == [("NEW", 2), ("RESOLVED", 2)]
    assert out.filter("status = 'RESOLVED'").select("alert_id").distinct().count() == 48 and not out.filter("overdue").count()


def test_overdue_alerts(spark, tmp_path):
    rows = [(1, "NEW", 10, "2024-01-01 00:00:00"), (1, "ACKNOWLEDGED", 10, "2024-01-01 00:05:00"), (2, "NEW", 10, "2024-01-01 00:00:00"),
            (3, "NEW", 10, "2024-01-01 05:00:00"), (4, "NEW", 10, "2024-01-01 06:00:00")]
    df = spark.createDataFrame(rows, "alert_id long, event string, deadline_min int, at string").withColumn("event_at", F.to_timestamp("at")).drop("at")
    out = feeds.replay(stateful.alert_lifecycle(several_batches(spark, df, tmp_path, "event_at")))
    assert {r["alert_id"] for r in out.filter("overdue").collect()} == {2, 3}
    assert out.filter("alert_id = 1 and status = 'ACKNOWLEDGED'").count() == 1


def test_alerts_of_a_group_keep_apart(spark, tmp_path):
    """Alerts that share a key of state, one without an id and an id of 0 among them, end as each would alone."""
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(12)]), rng.choice(["NEW", "NEW", "ACKNOWLEDGED", "RESOLVED", "SEEN", None]), rng.choice([None, 3, 20, 90]), m)
            for m in rng.sample(range(2000), 400)] + [(99, "SEEN", None, 2100)]
    df = spark.createDataFrame(rows, "alert_id long, event string, deadline_min int, m long").withColumn(
        "event_at", F.timestamp_seconds((F.col("m") + 1000) * 60)).drop("m")
    want = Counter()
    for alert in {r[0] for r in rows}:
        status, due = None, None
        for _, event, minutes, m in sorted((r for r in rows if r[0] == alert and r[3] <= 2090), key=lambda r: r[3]):
            if status == "NEW" and due is not None and m > due:
                want[alert, status, True] += 1
                due = None
            if event == "NEW" and not status:
                status, due = "NEW", m + (minutes or 0)
            elif event == "ACKNOWLEDGED" and status == "NEW":
                status = event
            elif event == "RESOLVED" and status:
                want[alert, event, False] += 1
                status = None
                continue
            if status:
                want[alert, status, False] += 1
        if status == "NEW" and due is not None and due <= 2090:
            want[alert, status, True] += 1
    for groups in (1, 3, stateful.GROUPS):
        feed = several_batches(spark, df, tmp_path / str(groups), "event_at", 5)
        assert Counter(map(tuple, feeds.replay(stateful.alert_lifecycle(feed, groups=groups)).collect())) == want
    idle = [Counter(map(tuple, feeds.replay(stateful.alert_lifecycle(
        several_batches(spark, df, tmp_path / f"idle{groups}", "event_at", 5), idle=15, groups=groups)).collect())) for groups in (1, stateful.GROUPS)]
    assert idle[0] == idle[1] != want


class Stub:
    def write(self):
        return self

    def overwrite(self):
        return self

    def save(self, path):
        pass


@pytest.mark.parametrize("mode,want", [("batch", [1, 3]), ("immediate", [0, 1, 2, 3]), ("window", [0, 1, 2, 3])])
def test_update_policy(spark, tmp_path, mode, want):
    """A policy made anew before each batch, and every batch twice, goes on like one that lives through all of them."""
    df = views.obs(spark, SF).selectExpr("obs_id", "event_ts", "speed", "cast(value > 50 as int) as y", "cast(k > 50 as int) as y_pred").cache()
    trained = {"one": [], "many": []}

    def policy(name):
        return UpdatePolicy(str(tmp_path / name), ["speed"], "y", mode, 400, 300, warning=0.3, drift=0.3,
                            refit=lambda train, *a: trained[name].append(sorted(r[0] for r in train.select("obs_id").collect())) or Stub())

    one = policy("one")
    for i in range(4):
        part = df.filter(f"obs_id % 4 = {i}")
        one(part, i)
        policy("many")(part, i)
        policy("many")(part, i)
    ledgers = [sorted(map(tuple, policy(name).ledger(spark).collect())) for name in trained]
    assert ledgers[0] == ledgers[1] and trained["one"] == trained["many"]
    assert [r["batch"] for r in policy("one").ledger(spark).filter("fitted").orderBy("batch").collect()] == want
    if mode == "batch":
        assert trained["one"][0] == sorted(r[0] for r in df.filter("obs_id % 4 < 2").select("obs_id").collect())
    if mode == "window":
        seen = df.filter("obs_id % 4 in (1, 2)").orderBy(F.desc(F.col("obs_id") % 4), F.desc("event_ts"), F.desc("obs_id")).limit(300)
        assert trained["one"][2] == sorted(r[0] for r in seen.select("obs_id").collect())


def test_unfinished_batch_is_done_again(spark, tmp_path):
    df = spark.range(100).selectExpr("id as obs_id", "timestamp_seconds(id) as event_ts", "id % 2 as y", "0L as y_pred")

    def broken(*a):
        raise OSError("lost")

    with pytest.raises(OSError):
        UpdatePolicy(str(tmp_path), ["obs_id"], "y", "immediate", refit=broken)(df, 0)
    policy = UpdatePolicy(str(tmp_path), ["obs_id"], "y", "immediate", refit=lambda *a: Stub())
    assert policy.ledger(spark).isEmpty()
    policy(df, 0)
    assert [tuple(r) for r in policy.ledger(spark).select("rows", "errors", "fitted").collect()] == [(100, 50, True)]


def test_registry(spark, tmp_path):
    from stopwise.ml import models
    from stopwise.ml.registry import Registry

    df = spark.range(60).selectExpr("id", "cast(id % 10 as double) as x", "cast(id % 10 > 4 as int) as y")
    found = Registry(spark, str(tmp_path))
    assert found.latest("m") == 0
    for depth, f1 in ((1, 0.9), (2, 0.5)):
        found.register("m", models.fit(df, ["x"], "y", numTrees=2, maxDepth=depth), ["x"], "y", 0.4, f1=f1)
    assert found.latest("m") == 2 and found.best("m", "f1") == 1 and found.load("m", 1)[1:] == (["x"], 0.4)
    assert {r["model_version"] for r in found.score(df, "m").collect()} == {2}
    with pytest.raises(KeyError):
        found.load("other", 1)
    with pytest.raises(ValueError):
        found.score(df.drop("x"), "m")
