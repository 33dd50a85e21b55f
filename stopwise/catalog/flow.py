"""Streaming and model queries, and the encoders and selectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stopwise.catalog.base import Catalog
from stopwise.catalog.model import SC, RANK, scored, split
from stopwise.ml import models, neighbours, prepare
from stopwise.ml.registry import Registry
from stopwise.operators import label, splits
from stopwise.session import checkpoint_root, cut_lineage
from stopwise.streaming import feeds as stream
from stopwise.streaming import stateful
from stopwise.streaming.updates import UpdatePolicy
from stopwise.testbed import views

CATALOG = Catalog()
add = CATALOG.add
obs, lab = views.obs, views.labelled


def live(s, d):
    """The observations as a file stream."""
    raw = s.read.parquet(f"{d}/events.parquet")
    events = stream.file_feed(s, f"{d}/events*.parquet", raw.schema)
    return views.shape_obs(events)


# A window is final once the watermark (newest time - 10 minutes) has passed its end.
CLOSED = "(SELECT max(feed_us) - 600000000 FROM obs)"
add("str02_dedup", "entity_id:i n:i",
    lambda s, d: stream.replay(stream.dedup(live(s, d).select((F.col("obs_id") % 3000).alias("entity_id"), F.date_trunc("hour", "feed_timestamp").alias("retrieved_at")))).groupBy(
        "entity_id").agg(F.count(F.lit(1)).alias("n")),
    "SELECT obs_id % 3000 AS entity_id, count(DISTINCT date_trunc('hour', feed_timestamp)) AS n FROM obs GROUP BY 1")
add("str03_snapshots", "window_start route_id n:i route_delay_mean:f route_delay_max:f", lambda s, d: stream.replay(stream.snapshots(live(s, d))),
    f"""SELECT make_timestamp(b * 300000000) AS window_start, route_id, count(*) AS n, avg(delay_sec) AS route_delay_mean, max(delay_sec) AS route_delay_max FROM (SELECT *, feed_us // 300000000 AS b FROM obs)
        WHERE (b + 1) * 300000000 <= {CLOSED} GROUP BY b, route_id""", digits=4)
add("str04_lookback", "window_start stop_id n:i mean_delay:f max_delay:f", lambda s, d: stream.replay(stream.lookback(live(s, d))),
    f"""SELECT make_timestamp(b * 300000000) AS window_start, stop_id, count(*) AS n, avg(delay_sec) AS mean_delay, max(delay_sec) AS max_delay FROM (SELECT *, feed_us // 300000000 - i AS b FROM obs, range(12) t(i))
        WHERE b * 300000000 + 3600000000 <= {CLOSED} GROUP BY b, stop_id""", digits=4)
add("str05_sessions", "session_start session_end vehicle_id n:i mean_speed:f", lambda s, d: stream.replay(stream.sessions(live(s, d))),
    f"""SELECT make_timestamp(min(feed_us)) AS session_start, make_timestamp(max(feed_us) + 900000000) AS session_end, vehicle_id, count(*) AS n, avg(speed) AS mean_speed FROM (
        SELECT *, sum(CAST(g AS INT)) OVER (PARTITION BY vehicle_id ORDER BY feed_us) AS sid FROM (SELECT *, coalesce(feed_us - lag(feed_us) OVER (PARTITION BY vehicle_id ORDER BY feed_us) >= 900000000, true) AS g FROM obs))
        GROUP BY vehicle_id, sid HAVING max(feed_us) + 900000000 <= {CLOSED}""", digits=4)
add("str08_stateful_lags", "obs_id:i prev_delay:f headway_sec:f", lambda s, d: stream.replay(stateful.lag_features(live(s, d), ["route_id", "stop_id"], late="0 seconds")),
    """SELECT obs_id, coalesce(lag(delay_sec) OVER w, 0) AS prev_delay, (feed_us - lag(feed_us) OVER w) / 1e6 AS headway_sec FROM obs
       WINDOW w AS (PARTITION BY route_id, stop_id ORDER BY feed_us, obs_id)""")
add("str09_stateful_detectors", "obs_id:i seen:i error_rate:f warning drift phi:f cusum_drift",
    lambda s, d: stream.replay(stateful.error_detectors(live(s, d).withColumns({"y_true": (F.col("value") > 50).cast("int"), "y_pred": (F.col("k") >= 50).cast("int")}), ["route_id"], late="0 seconds", warning=0.55, drift=0.6)),
    """SELECT obs_id, seen, CASE WHEN seen >= 30 THEN p END AS error_rate, seen >= 30 AND p + sd > 0.55 AS warning, seen >= 30 AND p + 2 * sd > 0.6 AS drift, s - seen * 0.005 AS phi, s - seen * 0.005 > 0.01 AS cusum_drift
       FROM (SELECT *, sqrt(p * (1 - p) / seen) AS sd FROM (SELECT *, s / seen AS p FROM (SELECT *, row_number() OVER w AS seen, sum(CAST(y_true <> y_pred AS INT)) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM sc
       WINDOW w AS (PARTITION BY route_id ORDER BY event_ts, obs_id))))""", ctes=SC)


def life(s, d):
    o = live(s, d)
    kinds = F.array(F.struct(F.lit("NEW").alias("event"), F.lit(0).alias("after")), F.struct(F.lit("ACKNOWLEDGED").alias("event"), (F.col("k") % 40 + 1).alias("after")))
    rows = o.select("obs_id", "k", "feed_timestamp", F.explode(kinds).alias("e")).filter("e.event = 'NEW' or k % 2 = 0")
    return rows.select(F.col("obs_id").alias("alert_id"), "e.event", F.lit(15).alias("deadline_min"),
                       F.timestamp_micros(F.unix_micros("feed_timestamp") + F.col("e.after").cast("long") * 60_000_000).alias("event_at"))


add("str10_stateful_lifecycle", "alert_id:i status overdue", lambda s, d: stream.replay(stateful.alert_lifecycle(life(s, d))).filter("overdue"),
    """SELECT obs_id AS alert_id, 'NEW' AS status, true AS overdue FROM obs WHERE NOT (k % 2 = 0 AND k % 40 + 1 <= 15) AND feed_us // 1000 + 900000 <= (
       SELECT max(feed_us + CASE WHEN k % 2 = 0 THEN (k % 40 + 1) * CAST(60000000 AS BIGINT) ELSE 0 END) // 1000 - 600000 FROM obs)""")

SLICES = 8


def sliced(df):
    """Rows with the number of their slice of the time range, which are equally long."""
    us = F.unix_micros("feed_timestamp")
    lo, hi = df.agg(F.min(us)).scalar(), df.agg(F.max(us)).scalar()
    return df.withColumn("slice", F.least(F.floor((us - lo) * SLICES / (hi - lo + 1)), F.lit(SLICES - 1)).cast("int"))


SLICED = f"""sl AS (SELECT *, CAST(floor((feed_us - min(feed_us) OVER ()) * {SLICES} / (max(feed_us) OVER () - min(feed_us) OVER () + 1)) AS INT) AS slice FROM obs)"""


def in_turns(s, rows, part, n, run):
    """Rows arrive in ``n`` parts; after each the stream is started anew on the same folders and handed to ``run``."""
    root = f"{checkpoint_root(s).rstrip('/')}/turns-{uuid.uuid4().hex}"
    rows = cut_lineage(rows)
    for i in range(n):
        rows.filter(F.col(part) == i).drop(part).write.parquet(f"{root}/in/part={i}")
        run(stream.file_feed(s, f"{root}/in", rows.drop(part).schema), root, i)
    return root


def updates(s, d):
    """Ledger of a policy that is made anew for each batch, so every batch starts from what is on disk."""
    rows = sliced(obs(s, d)).select("slice", "obs_id", "event_ts", "speed", "k", (F.col("value") > 50).cast("int").alias("y"), (F.col("k") >= 50).cast("int").alias("y_pred"))

    def policy(root):
        return UpdatePolicy(f"{root}/policy", ["speed", "k"], "y", "batch", warning=0.5, drift=0.52, refit=lambda *a: models.fit(*a, numTrees=3, maxDepth=3))

    root = in_turns(s, rows, "slice", SLICES, lambda live_rows, root, i: stream.run_to_sink(live_rows, policy(root), f"{root}/checkpoint"))
    return policy(root).ledger(s)


add("mon11_update_policy", "batch:i rows:i errors:i seen:i wrong:i warning drift fitted pending:i first_batch:i", updates,
    """SELECT batch, rows, errors, seen, wrong, warning, drift, due AS fitted, seen AS pending, first_batch FROM (
       WITH RECURSIVE p AS (SELECT slice AS batch, count(*) AS rows, count(*) FILTER ((value > 50) IS DISTINCT FROM (k >= 50)) AS errors FROM sl GROUP BY 1),
       w(batch, rows, errors, seen, wrong, first_batch) AS (SELECT batch, rows, errors, rows, errors, 0 FROM p WHERE batch = 0 UNION ALL
         SELECT p.batch, p.rows, p.errors, CASE WHEN f THEN 0 ELSE seen END + p.rows, CASE WHEN f THEN 0 ELSE wrong END + p.errors, CASE WHEN f THEN p.batch ELSE first_batch END
         FROM (SELECT *, seen >= 100 AND (wrong / seen + sqrt(wrong / seen * (1 - wrong / seen) / seen) > 0.5 OR wrong / seen + 2 * sqrt(wrong / seen * (1 - wrong / seen) / seen) > 0.52) AS f FROM w) w
         JOIN p ON p.batch = w.batch + 1)
       SELECT *, seen >= 30 AND wrong / seen + sqrt(wrong / seen * (1 - wrong / seen) / seen) > 0.5 AS warning, seen >= 30 AND wrong / seen + 2 * sqrt(wrong / seen * (1 - wrong / seen) / seen) > 0.52 AS drift,
         (warning OR drift) AND seen >= 100 AS due FROM w)""", ctes=SLICED)


def late_rows(s, d):
    """Three quarters of the time range arrive first, then the rest with every 50th row of the first part: most of these are late."""
    o = sliced(obs(s, d)).withColumn("part", F.when((F.col("slice") < 6) & (F.col("obs_id") % 50 != 7), 0).otherwise(1))

    def run(live_rows, root, i):
        query = stream.run_to_files(stream.dedup(live_rows, ("obs_id", "feed_timestamp"), "feed_timestamp"), f"{root}/out")
        stream.save_progress(query, f"{root}/progress")

    root = in_turns(s, o.select("part", "obs_id", "feed_timestamp"), "part", 2, run)
    kept = s.read.schema("obs_id bigint").parquet(f"{root}/out/data").agg(F.count(F.lit(1))).scalar()
    return s.read.schema(stream.PROGRESS).parquet(f"{root}/progress").agg(F.sum("rows_in").alias("rows_in"), F.sum("rows_late").alias("rows_late")).withColumn("rows_kept", kept)


add("str11_late_rows", "rows_in:i rows_late:i rows_kept:i", late_rows,
    """SELECT count(*) AS rows_in, count(*) FILTER (late) AS rows_late, count(*) FILTER (NOT late) AS rows_kept FROM (SELECT slice < 6 AND obs_id % 50 = 7 AND feed_us <= (
       SELECT max(feed_us) // 1000 - 600000 FROM sl WHERE slice < 6 AND obs_id % 50 <> 7) * 1000 AS late FROM sl)""", ctes=SLICED)


def sink(s, d):
    """Every batch is written twice, as after a failure between the write and the commit."""
    def twice(root):
        write = stream.table_sink(f"{root}/table", "delays")
        return lambda batch, n: [write(batch, n) for _ in range(2)] and None

    rows = sliced(obs(s, d)).select("slice", "route_id", "delay_sec")
    root = in_turns(s, rows, "slice", SLICES, lambda live_rows, root, i: stream.run_to_sink(live_rows, twice(root), f"{root}/checkpoint"))
    return stream.read_sink(s, f"{root}/table", "delays").groupBy("route_id").agg(F.count(F.lit(1)).alias("n"), F.sum("delay_sec").alias("delay"))


add("snk04_table_sink", "route_id n:i delay:f", sink, "SELECT route_id, count(*) AS n, sum(delay_sec) AS delay FROM obs GROUP BY 1", digits=3)

FEATURES = ["delay", "velocity", "hour", "weekday", "is_rush"]


def next_state(s, d):
    """Split rows with model inputs and the disruption state of the trip's next observation as label."""
    from stopwise.ordered import with_windows

    rows = with_windows(split(s, d), ["trip_id"], ["feed_timestamp", "obs_id"], ["disruption_type"], [
        lambda w: {"y": F.coalesce((F.lead("disruption_type").over(w) != "ON_TIME").cast("int"), F.lit(0))}], ahead=1)
    return cut_lineage(stream.event_features(rows).withColumn("y2", (F.col("delay_sec") > 200).cast("int")))


def parts(s, d):
    df = next_state(s, d)
    return tuple(df.filter(F.col("split") == p) for p in ("train", "val", "test"))


add("ml01_fit_predict", "obs_id:i y_pred:i", lambda s, d: models.fit_predict(*parts(s, d), FEATURES, "y", numTrees=8))


def registered(s, d):
    """Two versions are registered with their validation F1; loaded ones score like the fitted ones."""
    train, val, test = parts(s, d)
    models_of = Registry(s, f"{checkpoint_root(s).rstrip('/')}/registry-{uuid.uuid4().hex}")
    out = None
    for depth in (2, 5):
        model = models.fit(train, FEATURES, "y", numTrees=5, maxDepth=depth)
        tuned = models.tune_threshold(models.score(model, val), "y", "score").first()
        version = models_of.register("state", model, FEATURES, "y", tuned["threshold"], f1=tuned["f1"])
        fitted = models.score(model, test, tuned["threshold"]).select("obs_id", F.col("score").alias("_s"), F.col("y_pred").alias("_p"))
        both = models_of.score(test, "state", version).join(fitted, "obs_id")
        row = both.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("score") != F.col("_s")) | (F.col("y_pred") != F.col("_p"))).alias("different")).withColumn("version", F.lit(version))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("latest", F.lit(models_of.latest("state")))


add("snk03_ml10_registry", "version:i n:i different:i latest:i", registered,
    "SELECT v AS version, count(*) AS n, 0 AS different, 2 AS latest FROM sp, range(1, 3) AS u(v) WHERE split = 'test' GROUP BY v", ctes=RANK)
add("ml04_cmp11_chain", "approach f1_macro:f hamming_loss:f subset_accuracy:f",
    lambda s, d: (lambda p: models.compare_chain(p[0], p[2], FEATURES, ["y", "y2"], numTrees=5, maxDepth=4))(parts(s, d)))
add("ml08_search", "params value:f", lambda s, d: (lambda p: models.search(p[0], p[1], FEATURES, "y", "forest", {"numTrees": [4, 8], "maxDepth": [3, 5]}))(parts(s, d)))
add("ml08_halving", "rung:i share:f params value:f kept",
    lambda s, d: (lambda p: models.halving(p[0], p[1], FEATURES, "y", "forest", models.sample_space({"numTrees": (2, 8, 2), "maxDepth": (2, 5, 1)}, 6), "obs_id"))(parts(s, d)))
add("ml01_compare_models", "model threshold:f val_f1:f f1:f best",
    lambda s, d: (lambda p: models.compare(*p, FEATURES, "y", {"forest": {"numTrees": 5}, "boosted": {"maxIter": 3}, "perceptron": {"maxIter": 20}}))(parts(s, d)))
add("ml09_permutation_importance", "feature importance:f",
    lambda s, d: (lambda p: models.permutation_importance(models.fit(p[0], FEATURES, "y", numTrees=5), p[2], FEATURES, "y", "obs_id"))(parts(s, d)))
add("str06_07_score_stream", "window_start n:i mean_probability:f disruption_rate:f",
    lambda s, d: stream.replay(stream.prediction_stats(stream.score_stream(live(s, d), models.fit(parts(s, d)[0], FEATURES, "y", numTrees=5)))))


def simulation(s, d):
    rows = cut_lineage(splits.with_day_rank(stream.event_features(label.add_targets(lab(s, d))), "event_ts"))
    spans = splits.window_spans(splits.day_table(rows, "event_ts"), splits.Rolling(20, 4, 4))
    forest = models.simulate(rows, FEATURES[1:], "disruption_target", None, ("forest",), spans, numTrees=5)
    return forest.unionByName(models.simulate(rows, FEATURES[1:], "disruption_target", None, ("boosted",), spans))


add("ml03_simulation", "window_id:i model threshold:f val_f1:f f1:f", simulation)
add("ml07_neighbour_features", "obs_id:i speed_knn_mean:f speed_knn_std:f k_knn_mean:f",
    lambda s, d: neighbours.neighbour_features(obs(s, d).select("obs_id", "speed", "k"), split(s, d).filter("split = 'train'").select("obs_id", "speed", "k"), ["speed", "k"], "obs_id", 8),
    """SELECT obs_id, list_avg([e.speed FOR e IN n]) AS speed_knn_mean, list_stddev_pop([e.speed FOR e IN n]) AS speed_knn_std, list_avg([e.k FOR e IN n]) AS k_knn_mean
       FROM (SELECT a.obs_id, min({'d': (a.speed - b.speed) * (a.speed - b.speed) + (a.k - b.k) * (a.k - b.k), 'id': b.obs_id, 'speed': b.speed, 'k': b.k}, 8) AS n
       FROM obs a JOIN sp b ON b.split = 'train' AND b.obs_id <> a.obs_id GROUP BY a.obs_id)""", ctes=RANK)
add("spl11_smote", "synthetic y:i n:i", lambda s, d: neighbours.smote(obs(s, d).withColumn("y", (F.col("value") > 220).cast("int")), ["speed", "value"], "y", "obs_id").groupBy("synthetic", "y").agg(
    F.count(F.lit(1)).alias("n")),
    """SELECT false AS synthetic, CAST(value > 220 AS INT) AS y, count(*) AS n FROM obs GROUP BY 2 UNION ALL
       SELECT true, 1, w FROM (SELECT CAST(floor(count(*) FILTER (value <= 220) * 0.1) AS BIGINT) - count(*) FILTER (value > 220) AS w FROM obs) WHERE w > 0""")

# ---------------------------------------------------------------- preparation
ENC = RANK + ", cd AS (SELECT stop_id, dense_rank() OVER (ORDER BY stop_id) - 1 AS c FROM (SELECT DISTINCT stop_id FROM sp WHERE split = 'train' AND stop_id <> 'S2'))"
add("enc01_ordinal_encode", "obs_id:i stop_id:i",
    lambda s, d: (lambda p: prepare.ordinal_encode(p, prepare.category_codes(p.filter("split = 'train' and stop_id <> 'S2'"), ["stop_id", "trip_id"]), ["stop_id"]))(split(s, d)),
    "SELECT obs_id, coalesce(c, -1) AS stop_id FROM sp LEFT JOIN cd USING (stop_id)", ctes=ENC)
add("enc02_impute", "obs_id:i late:f speed:f",
    lambda s, d: (lambda p: prepare.impute(p, p.filter("split = 'train'"), ["late", "speed"]))(split(s, d).withColumn("late", F.when(F.col("delay_sec") > 0, F.col("delay_sec")))),
    """SELECT obs_id, CAST(coalesce(CASE WHEN delay_sec > 0 THEN delay_sec END, (SELECT median(delay_sec) FROM sp WHERE split = 'train' AND delay_sec > 0)) AS FLOAT) AS late, CAST(speed AS FLOAT) AS speed FROM sp""", ctes=RANK, digits=3)
add("enc03_standard_scale", "obs_id:i delay_sec:f speed:f",
    lambda s, d: (lambda p: prepare.standard_scale(p, p.filter("split = 'train'"), ["delay_sec", "speed"]))(split(s, d)),
    """SELECT obs_id, (delay_sec - (SELECT avg(delay_sec) FROM sp WHERE split = 'train')) / (SELECT stddev_pop(delay_sec) FROM sp WHERE split = 'train') AS delay_sec,
       (speed - (SELECT avg(speed) FROM sp WHERE split = 'train')) / (SELECT stddev_pop(speed) FROM sp WHERE split = 'train') AS speed FROM sp""", ctes=RANK)


def wide(s, d):
    return obs(s, d).withColumns({"twice": F.col("delay_sec") * 2 + F.col("k") * 0.01, "flat": F.lit(0.001) * (F.col("k") % 2)})


add("fs01_correlation_filter", "feature max_corr:f keep", lambda s, d: prepare.correlation_filter(wide(s, d), ["delay_sec", "speed", "twice"]),
    """SELECT 'delay_sec' AS feature, 0.0 AS max_corr, true AS keep UNION ALL SELECT 'speed', abs(corr(delay_sec, speed)), abs(corr(delay_sec, speed)) <= 0.95 FROM obs UNION ALL
       SELECT 'twice', greatest(abs(corr(delay_sec, delay_sec * 2 + k * 0.01)), abs(corr(speed, delay_sec * 2 + k * 0.01))), greatest(abs(corr(delay_sec, delay_sec * 2 + k * 0.01)), abs(corr(speed, delay_sec * 2 + k * 0.01))) <= 0.95 FROM obs""")
add("fs02_variance_filter", "feature variance:f keep", lambda s, d: prepare.variance_filter(wide(s, d), ["k", "flat"]),
    "SELECT 'k' AS feature, var_pop(k) AS variance, var_pop(k) > 0.01 AS keep FROM obs UNION ALL SELECT 'flat', var_pop(0.001 * (k % 2)), var_pop(0.001 * (k % 2)) > 0.01 FROM obs", digits=4)
add("fs03_mutual_information", "feature mi:f", lambda s, d: prepare.mutual_information(scored(s, d), ["value", "k"], "y_true"),
    """SELECT feature, sum(n / t * ln(n * t / (nb * ny))) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, b) AS nb, sum(n) OVER (PARTITION BY feature, y_true) AS ny FROM (
       SELECT feature, len(list_filter(e, lambda x: x <= v)) AS b, y_true, count(*)::DOUBLE AS n FROM (SELECT 'value' AS feature, value AS v, y_true FROM sc UNION ALL SELECT 'k', k, y_true FROM sc) JOIN (
       SELECT feature, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM (SELECT 'value' AS feature, value AS v FROM sc UNION ALL SELECT 'k', k FROM sc) GROUP BY 1) USING (feature) GROUP BY 1, 2, 3)) GROUP BY 1""", ctes=SC)
add("fs04_elimination", "n_features:i features auc:f", lambda s, d: (lambda p: models.eliminate(p[0], p[1], FEATURES, "y", 3, 0.3, numTrees=4))(parts(s, d)))
add("ml06_stop_mean_features", "obs_id:i spatial_lag:f spatial_lag_diff:f",
    lambda s, d: (lambda p: prepare.stop_mean_features(p, p.filter("split = 'train' and stop_id <> 'S2'")))(split(s, d)),
    """SELECT obs_id, coalesce(m, (SELECT avg(m) FROM sm)) AS spatial_lag, delay_sec - coalesce(m, (SELECT avg(m) FROM sm)) AS spatial_lag_diff FROM sp LEFT JOIN sm USING (stop_id)""",
    ctes=RANK + ", sm AS (SELECT stop_id, avg(delay_sec) AS m FROM sp WHERE split = 'train' AND stop_id <> 'S2' GROUP BY 1)", digits=4)
add("ml06_temporal_lag", "obs_id:i temporal_lag:f temporal_lag_diff:f", lambda s, d: prepare.temporal_lag_features(obs(s, d)),
    """SELECT obs_id, coalesce(lag(delay_sec) OVER w, delay_sec) AS temporal_lag, coalesce(lag(delay_sec) OVER w, delay_sec) - delay_sec AS temporal_lag_diff FROM obs
       WINDOW w AS (PARTITION BY route_id ORDER BY feed_timestamp, obs_id)""")
