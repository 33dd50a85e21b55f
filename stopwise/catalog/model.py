"""Graph, quality, split, metric and monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopwise.catalog.base import Catalog
from stopwise.metrics import classification as cl
from stopwise.metrics import drift, fairness, significance
from stopwise.operators import graph, label, quality, splits
from stopwise.sources import feeds
from stopwise.testbed import views
from stopwise.testbed.views import table

CATALOG = Catalog()
add = CATALOG.add
obs, lab = views.obs, views.labelled

# ---------------------------------------------------------------- graph
NEXT = """nx AS (SELECT * FROM (SELECT trip_id, stop_sequence, stop_id AS src, lead(stop_id) OVER (PARTITION BY trip_id ORDER BY stop_sequence, stop_id) AS dst
  FROM stop_times) WHERE dst IS NOT NULL), edges AS (SELECT DISTINCT src, dst FROM nx)"""


def edges(s, d):
    return graph.sequence_edges(views.stop_times(s, d))


add("grf01_sequence_edges", "src dst", edges, "SELECT * FROM edges", "stop_times", ctes=NEXT)

add("grf02_weighted_edges", "trip_id src dst position:i weight:f", lambda s, d: graph.weighted_edges(views.stop_times(s, d)),
    """SELECT *, (1.0 / position) / (1 + 1e-9) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY stop_sequence, src, dst) AS position FROM nx)""",
    "stop_times", ctes=NEXT)

add("grf03_route_stop_edges", "src dst n:i",
    lambda s, d: graph.route_stop_edges(views.stop_times(s, d), views.trips(s, d)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")),
    "SELECT route_id AS src, stop_id AS dst, count(*) AS n FROM stop_times JOIN trips USING (trip_id) GROUP BY 1, 2", "stop_times trips")

add("grf04_node_index", "stop_id node_idx:i", lambda s, d: graph.node_index(views.stop_times(s, d), "stop_id"),
    "SELECT stop_id, row_number() OVER (ORDER BY stop_id) - 1 AS node_idx FROM (SELECT DISTINCT stop_id FROM stop_times)", "stop_times")

_PR = """deg AS (SELECT src, count(*) AS o FROM edges GROUP BY 1), nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
r0 AS (SELECT node, 1.0 / (SELECT count(*) FROM nodes) AS rank FROM nodes)"""
for _i in range(1, 6):
    _PR += f""", r{_i} AS (SELECT n.node, 0.85 * (coalesce(g.v, 0) + (SELECT coalesce(sum(rank), 0) FROM r{_i - 1} WHERE node NOT IN (SELECT src FROM deg))
  / (SELECT count(*) FROM nodes)) + 0.15 / (SELECT count(*) FROM nodes) AS rank FROM nodes n LEFT JOIN (SELECT dst AS node, sum(rank / o) AS v
  FROM edges JOIN deg USING (src) JOIN r{_i - 1} ON node = src GROUP BY 1) g USING (node))"""
TEDGES = "edges AS (SELECT DISTINCT from_stop_id AS src, to_stop_id AS dst FROM transfers WHERE from_stop_id IS NOT NULL AND to_stop_id IS NOT NULL)"


def transfer_edges(s, d):
    return views.transfers(s, d).select(F.col("from_stop_id").alias("src"), F.col("to_stop_id").alias("dst")).filter(
        "src is not null and dst is not null").distinct()


add("grf05_pagerank", "node pagerank:f", lambda s, d: graph.pagerank(transfer_edges(s, d), iterations=5),
    "SELECT node, rank AS pagerank FROM r5", "transfers", digits=9, ctes=TEDGES + ",\n" + _PR)

add("grf06_betweenness", "node betweenness_centrality:f", lambda s, d: graph.betweenness(transfer_edges(s, d), sources=2000))
add("grf06_10_high_centrality", "node betweenness_centrality:f", lambda s, d: graph.high_centrality(
    graph.betweenness(transfer_edges(s, d), directed=True, lcc=False), 0.0005))

# Breadth-limited closure: labels settle once every node has seen its component, which the recursion does with UNION.
_COMP = TEDGES + """, both_ AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach AS (SELECT a AS node, a AS seen FROM both_ UNION SELECT reach.node, both_.b FROM reach JOIN both_ ON reach.seen = both_.a)"""
add("grf07_components", "node component", lambda s, d: graph.components(transfer_edges(s, d)),
    "SELECT node, min(seen) AS component FROM reach GROUP BY 1", "transfers", ctes=_COMP)
CATALOG.sql["grf07_components"] = CATALOG.sql["grf07_components"].replace("WITH ", "WITH RECURSIVE ", 1)

add("grf07_graph_report", "num_components:i largest_component:i num_nodes:i num_edges:i num_isolated_nodes:i edge_density:f",
    lambda s, d: graph.graph_report(transfer_edges(s, d), views.stops(s, d)),
    """SELECT (SELECT count(DISTINCT c) FROM lb) AS num_components, (SELECT max(n) FROM (SELECT count(*) AS n FROM lb GROUP BY c)) AS largest_component,
       (SELECT count(*) FROM stops) AS num_nodes, (SELECT count(*) FROM edges) AS num_edges,
       (SELECT count(*) FROM stops WHERE stop_id NOT IN (SELECT node FROM lb)) AS num_isolated_nodes,
       (SELECT count(*) FROM edges) / ((SELECT count(*) FROM stops) * ((SELECT count(*) FROM stops) - 1)) AS edge_density""", "transfers stops",
    ctes=_COMP + ", lb AS (SELECT node, min(seen) AS c FROM reach GROUP BY 1)", digits=9)
CATALOG.sql["grf07_graph_report"] = CATALOG.sql["grf07_graph_report"].replace("WITH ", "WITH RECURSIVE ", 1)

TWO = """hop2 AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src <> b.dst)"""
add("grf08_set05_two_hop", "src dst", lambda s, d: graph.two_hop(transfer_edges(s, d)), "SELECT * FROM hop2", "transfers", ctes=TEDGES + ",\n" + TWO)


def all_obs_edges(s, d):
    """Stop graph of the observations: consecutive stops of a trip."""
    return graph.sequence_edges(obs(s, d).select("trip_id", "stop_id", "stop_sequence").groupBy("trip_id", "stop_sequence").agg(F.min("stop_id").alias("stop_id")))


def obs_edges(s, d):
    """The half of the stop graph that the check SQL takes."""
    return all_obs_edges(s, d).filter("substring(src, 2) < substring(dst, 2)")


OEDGES = """edges AS (SELECT DISTINCT src, dst FROM (SELECT stop_id AS src, lead(stop_id) OVER (PARTITION BY trip_id ORDER BY stop_sequence, stop_id) AS dst FROM (
  SELECT trip_id, stop_sequence, min(stop_id) AS stop_id FROM obs GROUP BY 1, 2)) WHERE substring(src, 2) < substring(dst, 2))"""
LOAD = """SELECT obs_id, coalesce(v, 0) AS network_disruption_load, coalesce(v, 0) / nullif(severity_score, 0) AS network_load_normalized FROM lab LEFT JOIN (
       SELECT src AS stop_id, sum(coalesce(sev, 0)) AS v FROM hop2 LEFT JOIN (SELECT stop_id AS dst, arg_max(severity_score, feed_us) AS sev FROM lab GROUP BY 1)
       USING (dst) GROUP BY 1) USING (stop_id)"""
add("grf09_network_load", "obs_id:i network_disruption_load:f network_load_normalized:f", lambda s, d: graph.network_load(lab(s, d), obs_edges(s, d)),
    LOAD, ctes=OEDGES + ",\n" + TWO)

# The query above takes half of the edges; this one takes all.
add("grf09_network_load_all_edges", "obs_id:i network_disruption_load:f network_load_normalized:f", lambda s, d: graph.network_load(lab(s, d), all_obs_edges(s, d)),
    LOAD, ctes=OEDGES.replace(" WHERE substring(src, 2) < substring(dst, 2)", " WHERE dst IS NOT NULL") + ",\n" + TWO)

add("srt05_sample_trips", "trip_id stop_id", lambda s, d: graph.sample_trips(views.stop_times(s, d), 100))
add("srt06_sample_rows", "event_id:i", lambda s, d: graph.sample_rows(table(s, d, "events"), "event_id", 200))

# ---------------------------------------------------------------- quality
AS_OF = 1_704_067_200 + 12 * 3600 + 80


def feed_rows(s, d):
    k = F.col("k")
    kind = F.when(F.col("event_type") == "purchase", "trip_updates").when(F.col("event_type") == "signup", "service_alerts").otherwise("vehicle_positions")
    return obs(s, d).select(
        "obs_id", "event_ts", "trip_id", "route_id", kind.alias("feed_type"), F.when(k % 20 != 0, F.col("vehicle_id")).alias("vehicle_id"),
        (F.col("stop_lat") + F.when(k % 50 == 0, 10).otherwise(0)).alias("latitude"), F.col("stop_lon").alias("longitude"),
        (F.col("speed") + k % 45).alias("speed"), (F.col("delay_sec") - k * 3).alias("delay"),
        (F.unix_seconds("feed_timestamp") - F.when(k % 30 == 0, 60).otherwise(0)).alias("timestamp"))


FEED = """fr AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'trip_updates' WHEN event_type = 'signup' THEN 'service_alerts' ELSE 'vehicle_positions' END AS feed_type,
  CASE WHEN k % 20 <> 0 THEN vehicle_id END AS vid, stop_lat + CASE WHEN k % 50 = 0 THEN 10 ELSE 0 END AS lat, speed + k % 45 AS sp, delay_sec - k * 3 AS dl,
  feed_us // 1000000 - CASE WHEN k % 30 = 0 THEN 60 ELSE 0 END AS tsec FROM obs),
fm AS (SELECT feed_type, count(*) AS n_rows, 1704110480 - max(tsec) AS feed_age_seconds, sum(CAST(lat NOT BETWEEN 50.75 AND 53.55 AS INT)) AS out_of_bounds,
  sum(CAST(sp > 80 AS INT)) AS implausible_speed, sum(CAST(vid IS NULL AS INT)) AS null_vehicle_id, sum(CAST(dl < -300 AS INT)) AS large_negative_delay,
  count(DISTINCT vid) AS dv, count(DISTINCT trip_id) AS dt, count(DISTINCT route_id) AS dr FROM fr GROUP BY 1),
fm2 AS (SELECT *, n_rows - dv - CAST(null_vehicle_id > 0 AS INT) AS duplicate_ids FROM fm),
rev AS (SELECT feed_type, sum(CAST(b AS INT)) AS clock_reversals FROM (SELECT feed_type, coalesce(lag(tsec) OVER (PARTITION BY feed_type ORDER BY event_ts, obs_id) > tsec, false) AS b
  FROM fr) GROUP BY 1),
iss AS (SELECT feed_type, i.sev AS severity, i.code AS code, i.n AS n FROM (SELECT feed_type, unnest([
  CASE WHEN feed_age_seconds > lim THEN {'sev': 'error', 'code': 'STALE_FEED', 'n': 1} END, CASE WHEN feed_age_seconds > lim * 0.7 AND feed_age_seconds <= lim THEN {'sev': 'warn', 'code': 'AGING_FEED', 'n': 1} END,
  CASE WHEN vp AND out_of_bounds > 0 THEN {'sev': 'warn', 'code': 'OUT_OF_BOUNDS', 'n': out_of_bounds} END, CASE WHEN vp AND implausible_speed > 0 THEN {'sev': 'warn', 'code': 'IMPLAUSIBLE_SPEED', 'n': implausible_speed} END,
  CASE WHEN null_vehicle_id > 0 THEN {'sev': 'warn', 'code': 'NULL_VEHICLE_ID', 'n': null_vehicle_id} END, CASE WHEN vp AND duplicate_ids > n_rows * 0.1 THEN {'sev': 'warn', 'code': 'EXCESSIVE_DUPLICATES', 'n': duplicate_ids} END,
  CASE WHEN large_negative_delay > 0 THEN {'sev': 'warn', 'code': 'LARGE_NEGATIVE_DELAY', 'n': large_negative_delay} END, CASE WHEN clock_reversals > 0 THEN {'sev': 'warn', 'code': 'NON_MONOTONIC_TS', 'n': 1} END]) AS i
  FROM (SELECT *, feed_type = 'vehicle_positions' AS vp, CASE WHEN feed_type = 'service_alerts' THEN 900 ELSE 90 END AS lim FROM fm2 JOIN rev USING (feed_type))) WHERE i IS NOT NULL)"""


def checked(s, d):
    return quality.validate(feed_rows(s, d), F.lit(AS_OF), "event_ts", "obs_id")


add("dq01_schema_issues", "feed_type severity code n:i",
    lambda s, d: quality.schema_issues(feed_rows(s, d).drop("vehicle_id"), "vehicle_positions").unionByName(
        quality.schema_issues(feed_rows(s, d), "service_alerts")))

add("dq01_required_fields", "feed_type field rows:i missing:i share:f severity code", lambda s, d: quality.required_fields(feed_rows(s, d)),
    """SELECT feed_type, r.f AS field, rows, r.m AS missing, r.m / rows AS share, CASE WHEN r.m > 0 THEN r.s END AS severity,
       CASE WHEN r.m > 0 THEN r.c || upper(r.f) END AS code FROM (SELECT feed_type, count(*) AS rows, unnest(CASE feed_type
       WHEN 'vehicle_positions' THEN [{'f': 'vehicle_id', 'm': count(*) - count(vid), 's': 'error', 'c': 'NULL_'}, {'f': 'trip_id', 'm': count(*) - count(trip_id), 's': 'error', 'c': 'NULL_'},
         {'f': 'latitude', 'm': count(*) - count(lat), 's': 'warn', 'c': 'NULL_'}, {'f': 'longitude', 'm': count(*) - count(stop_lon), 's': 'warn', 'c': 'NULL_'}]
       WHEN 'trip_updates' THEN [{'f': 'trip_id', 'm': count(*) - count(trip_id), 's': 'error', 'c': 'NULL_'}, {'f': 'stop_id', 'm': count(*), 's': 'warn', 'c': 'MISSING_'}]
       ELSE [{'f': 'alert_id', 'm': count(*), 's': 'error', 'c': 'MISSING_'}, {'f': 'cause', 'm': count(*), 's': 'warn', 'c': 'MISSING_'}, {'f': 'effect', 'm': count(*), 's': 'warn', 'c': 'MISSING_'}]
       END) AS r FROM fr GROUP BY feed_type)""", ctes=FEED)

add("dq02_06_feed_metrics",
    "feed_type n_rows:i feed_age_seconds:f out_of_bounds:i implausible_speed:i null_vehicle_id:i large_negative_delay:i duplicate_ids:i coverage_trips_pct:f coverage_routes_pct:f",
    lambda s, d: quality.feed_metrics(feed_rows(s, d), F.lit(AS_OF)),
    """SELECT *, CASE WHEN feed_type = 'trip_updates' THEN least(100, dt / 5000 * 100) END AS coverage_trips_pct,
       CASE WHEN feed_type = 'vehicle_positions' THEN least(100, dr / 300 * 100) END AS coverage_routes_pct FROM fm2""", ctes=FEED)
add("dq03_clock_reversals", "feed_type clock_reversals:i", lambda s, d: quality.clock_reversals(feed_rows(s, d), "event_ts", "obs_id"), "SELECT * FROM rev", ctes=FEED)
add("dq08_cmp08_issues", "feed_type severity code n:i", lambda s, d: checked(s, d)[0], "SELECT * FROM iss", ctes=FEED)
add("dq07_score", "feed_type errors:i warnings:i validation_score:f", lambda s, d: checked(s, d)[1],
    """SELECT feed_type, e AS errors, w AS warnings, greatest(0, least(100, 100 - least(50, e * 3) - least(30, w) - greatest(0, least(20, (feed_age_seconds - 90) / 10))))
       AS validation_score FROM (SELECT feed_type, any_value(feed_age_seconds) AS feed_age_seconds, coalesce(sum(CASE WHEN severity = 'error' THEN n END), 0) AS e,
       coalesce(sum(CASE WHEN severity = 'warn' THEN n END), 0) AS w FROM fm2 LEFT JOIN iss USING (feed_type) GROUP BY 1)""", ctes=FEED)
add("dq09_vehicles_without_updates", "entity_id trip_id",
    lambda s, d: quality.without_updates(feeds.vehicle_positions(views.messages(s, d)), feeds.trip_updates(views.messages(s, d)).filter("stop_sequence = 3")),
    "SELECT entity_id, trip_id FROM vp WHERE NOT EXISTS (SELECT 1 FROM tu WHERE tu.trip_id = vp.trip_id AND stop_sequence = 3)", "obs feeds")

# The query above tests against the updates of one stop; this one tests against all.
add("dq09_vehicles_without_any_update", "entity_id trip_id",
    lambda s, d: quality.without_updates(feeds.vehicle_positions(views.messages(s, d)), feeds.trip_updates(views.messages(s, d))),
    "SELECT entity_id, trip_id FROM vp WHERE NOT EXISTS (SELECT 1 FROM tu WHERE tu.trip_id = vp.trip_id)", "obs feeds")

# ---------------------------------------------------------------- splits
RANK = """rk AS (SELECT *, row_number() OVER (ORDER BY event_ts, obs_id) - 1 AS rank, count(*) OVER () AS n FROM lab),
sp AS (SELECT *, CASE WHEN rank < floor(n * 0.7) THEN 'train' WHEN rank < floor(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM rk)"""


def split(s, d):
    return splits.chronological_split(lab(s, d), "event_ts", "obs_id")


add("spl01_chronological_split", "obs_id:i split", split, "SELECT obs_id, split FROM sp", ctes=RANK)
add("spl02_index_folds", "fold:i part n:i first_rank:i last_rank:i",
    lambda s, d: splits.fold_rows(splits.index_folds(lab(s, d), "event_ts", "obs_id", 4, gap=50)).groupBy("fold", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank")),
    """SELECT fold, part, count(*) AS n, min(rank) AS first_rank, max(rank) AS last_rank FROM (SELECT rank, f AS fold, CASE WHEN rank < (f + 1) * (n // 5) - 50 THEN 'train'
       WHEN rank >= (f + 1) * (n // 5) AND rank < least((f + 2) * (n // 5), n) THEN 'test' END AS part FROM rk, range(4) t(f)) WHERE part IS NOT NULL GROUP BY 1, 2""", ctes=RANK)

DAYS = "dr AS (SELECT *, dense_rank() OVER (ORDER BY CAST(event_ts AS DATE)) AS day_rank FROM lab), nd AS (SELECT max(day_rank) AS days FROM dr)"
add("spl03_day_folds", "fold:i part n:i rate:f",
    lambda s, d: (lambda days: splits.span_balance(days, splits.fold_spans(days, 20)))(splits.day_table(lab(s, d), "event_ts")).withColumnRenamed("disruption_rate", "rate"),
    """SELECT fold, part, count(*) AS n, avg(CAST(disruption_type <> 'ON_TIME' AS INT)) AS rate FROM (SELECT *, CASE WHEN day_rank <= 20 + fold - 1 THEN 'train' WHEN day_rank = 20 + fold
       THEN 'test' END AS part FROM dr, nd, range(1, 100) t(fold) WHERE fold <= days - 20) WHERE part IS NOT NULL GROUP BY 1, 2""", ctes=DAYS)
add("spl04_rolling_windows", "window_id:i part n:i first_day last_day",
    lambda s, d: (lambda days: splits.span_balance(days, splits.window_spans(days, splits.PRESETS["ultra_lean"])))(splits.day_table(lab(s, d), "event_ts")),
    """SELECT window_id, CASE WHEN pos < 14 THEN 'train' WHEN pos < 17 THEN 'val' ELSE 'test' END AS part, count(*) AS n, min(CAST(event_ts AS DATE)) AS first_day,
       max(CAST(event_ts AS DATE)) AS last_day FROM (SELECT *, day_rank - 1 - window_id AS pos FROM dr, nd, range(0, 100) t(window_id) WHERE window_id <= days - 20)
       WHERE pos BETWEEN 0 AND 19 GROUP BY 1, 2""", ctes=DAYS)
add("spl05_gap_buffer", "split n:i last_ts", lambda s, d: splits.gap_buffer(split(s, d), "event_ts", 90).groupBy("split").agg(
    F.count(F.lit(1)).alias("n"), F.max("event_ts").alias("last_ts")),
    """SELECT split, count(*) AS n, max(event_ts) AS last_ts FROM sp WHERE NOT (split = 'train' AND abs(epoch_us(event_ts) - (SELECT min(epoch_us(event_ts)) FROM sp WHERE split = 'val')) <= 5400000000)
       AND NOT (split = 'val' AND abs(epoch_us(event_ts) - (SELECT min(epoch_us(event_ts)) FROM sp WHERE split = 'test')) <= 5400000000) GROUP BY 1""", ctes=RANK)
add("spl06_boundary_split", "obs_id:i split",
    lambda s, d: splits.boundary_split(lab(s, d), "event_ts", F.lit("2024-01-20 00:00:00").cast("timestamp"), F.lit("2024-01-25 00:00:00").cast("timestamp"), 60),
    """SELECT obs_id, CASE WHEN event_ts < TIMESTAMP '2024-01-19 23:00:00' THEN 'train' WHEN event_ts > TIMESTAMP '2024-01-20 01:00:00' AND event_ts < TIMESTAMP '2024-01-24 23:00:00' THEN 'val'
       WHEN event_ts > TIMESTAMP '2024-01-25 01:00:00' THEN 'test' END AS split FROM lab WHERE event_ts < TIMESTAMP '2024-01-19 23:00:00' OR (event_ts > TIMESTAMP '2024-01-20 01:00:00'
       AND event_ts < TIMESTAMP '2024-01-24 23:00:00') OR event_ts > TIMESTAMP '2024-01-25 01:00:00'""")
add("spl07_overlap_check", "train_end val_start val_end test_start valid", lambda s, d: splits.overlap_check(split(s, d), "event_ts"),
    """SELECT *, train_end < val_start AND val_end < test_start AS valid FROM (SELECT max(event_ts) FILTER (split = 'train') AS train_end, min(event_ts) FILTER (split = 'val') AS val_start,
       max(event_ts) FILTER (split = 'val') AS val_end, min(event_ts) FILTER (split = 'test') AS test_start FROM sp)""", ctes=RANK)
add("spl07_shared_trips", "trip_id", lambda s, d: splits.shared_ids(split(s, d), "trip_id"),
    "SELECT trip_id FROM sp WHERE split = 'train' INTERSECT SELECT trip_id FROM sp WHERE split = 'test'", ctes=RANK)
add("spl08_volume", "total_points:i total_days:f size_category strategy", lambda s, d: splits.volume(lab(s, d), "event_ts"),
    """SELECT *, CASE WHEN size_category = 'small' THEN 'walk_forward' ELSE 'fixed_ratio' END AS strategy FROM (SELECT *, CASE WHEN total_points < 10000 OR total_days < 7 THEN 'small' ELSE
       'medium_large' END AS size_category FROM (SELECT count(*) AS total_points, (max(epoch_us(event_ts)) - min(epoch_us(event_ts))) / 8.64e10 AS total_days FROM lab))""")
add("srt04_order_guard", "rows:i duplicate_timestamps:i", lambda s, d: splits.order_guard(table(s, d, "lineitem"), "l_shipdate"),
    "SELECT count(*) AS rows, count(*) - count(DISTINCT l_shipdate) AS duplicate_timestamps FROM lineitem", views="")
add("agg18_balance", "split n:i disruption_rate:f", lambda s, d: splits.balance(split(s, d)),
    "SELECT split, count(*) AS n, avg(CAST(disruption_type <> 'ON_TIME' AS INT)) AS disruption_rate FROM sp GROUP BY 1", ctes=RANK)
add("agg19_train_only_classes", "disruption_type train_n:i other_n:i",
    lambda s, d: splits.train_only_classes(split(s, d).filter("split = 'train' or disruption_type <> 'CANCELLED'")),
    "SELECT disruption_type, count(*) AS train_n, 0 AS other_n FROM sp WHERE split = 'train' AND disruption_type = 'CANCELLED' GROUP BY 1", ctes=RANK)


def featured(s, d):
    leak = F.when(F.col("split") == "train", F.col("k")).otherwise(F.col("value"))
    return label.add_targets(split(s, d)).withColumn("leak", leak.cast("double"))


add("spl09_correlation_shift", "feature train_corr:f val_corr:f corr_diff:f suspicious",
    lambda s, d: splits.correlation_shift(featured(s, d), ["speed", "value", "leak"], "disruption_target", 0.3),
    "SELECT *, abs(val_corr - train_corr) AS corr_diff, abs(val_corr - train_corr) > 0.3 AS suspicious FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, corr({c}, y) FILTER (split = 'train') AS train_corr, corr({c}, y) FILTER (split = 'val') AS val_corr FROM ft"
        for n, c in (("speed", "speed"), ("value", "value"), ("leak", "CASE WHEN split = 'train' THEN k ELSE value END"))) + ")",
    ctes=RANK + ", ft AS (SELECT *, CAST(disruption_type <> 'ON_TIME' AS INT) AS y FROM sp)")
add("spl10_class_weights", "disruption_type n:i weight:f", lambda s, d: splits.class_weights(lab(s, d), "disruption_type"),
    """SELECT disruption_type, count(*) AS n, (SELECT count(*) FROM lab) / ((SELECT count(DISTINCT disruption_type) FROM lab) * count(*)) AS weight FROM lab GROUP BY 1""")
add("spl10_positive_ratio", "scale_pos_weight:f", lambda s, d: splits.positive_ratio(label.add_targets(lab(s, d)), "disruption_target"),
    "SELECT sum(CAST(disruption_type = 'ON_TIME' AS INT)) / sum(CAST(disruption_type <> 'ON_TIME' AS INT)) AS scale_pos_weight FROM lab")
add("spl11_oversample", "disruption_type n:i", lambda s, d: splits.oversample(lab(s, d), "disruption_type", "obs_id").groupBy("disruption_type").agg(F.count(F.lit(1)).alias("n")),
    "SELECT disruption_type, (SELECT max(n) FROM (SELECT count(*) AS n FROM lab GROUP BY disruption_type)) AS n FROM lab GROUP BY 1")


# ---------------------------------------------------------------- metrics
def scored(s, d):
    k = F.col("k")
    return obs(s, d).withColumns({
        "y_true": (F.col("value") > 50).cast("int"), "score": k / F.lit(100.0), "y_pred": (k >= 50).cast("int"), "y_pred2": (k % 3 == 0).cast("int"),
        "y2": (F.col("event_type") == "error").cast("int"), "ord_true": (k % 5).cast("int"), "ord_pred": (k * 3 % 7 % 5).cast("int"),
        "lead": (k * 7 % 70).cast("double"), "s1": F.col("value") / 100, "s2": F.col("k") / 50})


SC = """sc AS (SELECT *, CAST(value > 50 AS INT) AS y_true, k / 100.0::DOUBLE AS score, CAST(k >= 50 AS INT) AS y_pred, CAST(k % 3 = 0 AS INT) AS y_pred2, CAST(event_type = 'error' AS INT) AS y2,
  k % 5 AS ord_true, k * 3 % 7 % 5 AS ord_pred, k * 7 % 70 AS lead_min, value / 100 AS s1, k / 50.0::DOUBLE AS s2 FROM obs),
cf AS (SELECT sum(y_true * y_pred) AS tp, sum((1 - y_true) * y_pred) AS fp, sum(y_true * (1 - y_pred)) AS fn, sum((1 - y_true) * (1 - y_pred)) AS tn, count(*)::DOUBLE AS n FROM sc)"""
add("ev01_binary_metrics",
    "tp:i fp:i fn:i tn:i accuracy:f precision:f recall:f f1:f specificity:f precision_macro:f recall_macro:f f1_macro:f f1_weighted:f mcc:f balanced_accuracy:f g_mean:f kappa:f error_rate:f",
    lambda s, d: cl.binary_metrics(scored(s, d), "y_true", "y_pred"),
    """SELECT *, (accuracy - pe) / (1 - pe) AS kappa, 1 - accuracy AS error_rate, (f1 * (tp + fn) + f0 * (tn + fp)) / n AS f1_weighted, (f1 + f0) / 2 AS f1_macro FROM (
       SELECT *, (tp + tn) / n AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, 2 * tn / (2 * tn + fp + fn) AS f0, tn / (tn + fp) AS specificity,
       (tp / (tp + fp) + tn / (tn + fn)) / 2 AS precision_macro, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS recall_macro, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy,
       sqrt(tp / (tp + fn) * tn / (tn + fp)) AS g_mean, (tp * tn - fp * fn) / sqrt(1.0::DOUBLE * (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc,
       (1.0::DOUBLE * (tp + fp) * (tp + fn) + 1.0::DOUBLE * (tn + fn) * (tn + fp)) / (n * n) AS pe FROM cf)""", ctes=SC)
CURVE = """cv AS (SELECT score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM sc GROUP BY 1), cw AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM cv)"""
add("ev02_03_ranking_metrics", "positives:i negatives:i roc_auc:f pr_auc:f", lambda s, d: cl.ranking_metrics(scored(s, d), "y_true", "score", min_positives=15),
    "SELECT any_value(p) AS positives, any_value(n) AS negatives, sum(pos * (n - fp + neg / 2)) / (any_value(p) * any_value(n)) AS roc_auc, sum(pos * tp / (tp + fp)) / any_value(p) AS pr_auc FROM cw",
    ctes=SC + ",\n" + CURVE, digits=9)
add("ml02_threshold_table", "threshold:f predicted:i tp:i f1:f", lambda s, d: cl.threshold_table(scored(s, d), "y_true", "score"),
    "SELECT threshold, sum(CAST(score >= threshold AS INT)) AS predicted, sum(y_true * CAST(score >= threshold AS INT)) AS tp, 2 * sum(y_true * CAST(score >= threshold AS INT)) / (sum(CAST(score >= threshold AS INT)) + sum(y_true)) AS f1 FROM sc, (VALUES "
    + ", ".join(f"({t!r}::DOUBLE)" for t in cl.THRESHOLDS) + ") v(threshold) GROUP BY 1", ctes=SC)
add("ml02_tune_threshold", "threshold:f f1:f", lambda s, d: cl.tune_threshold(scored(s, d), "y_true", "score", cl.TARGET_THRESHOLDS),
    "SELECT threshold, 2 * sum(y_true * CAST(score >= threshold AS INT)) / (sum(CAST(score >= threshold AS INT)) + sum(y_true)) AS f1 FROM sc, (VALUES "
    + ", ".join(f"({t!r}::DOUBLE)" for t in cl.TARGET_THRESHOLDS) + ") v(threshold) GROUP BY 1 HAVING sum(CAST(score >= threshold AS INT)) > 0 ORDER BY f1 DESC, threshold LIMIT 1", ctes=SC)
_F1 = lambda y, p: f"2 * sum({y} * {p}) / nullif(sum({y}) + sum({p}), 0)"
add("ev04_multilabel",
    "f1_macro:f f1_micro:f f1_weighted:f f1_samples:f hamming_loss:f jaccard_index:f subset_accuracy:f",
    lambda s, d: cl.multilabel_metrics(scored(s, d), [("y_true", "y_pred"), ("y2", "y_pred2")]),
    f"""SELECT ({_F1('y_true', 'y_pred')} + {_F1('y2', 'y_pred2')}) / 2 AS f1_macro, 2 * sum(y_true * y_pred + y2 * y_pred2) / sum(y_true + y_pred + y2 + y_pred2) AS f1_micro,
        ({_F1('y_true', 'y_pred')} * sum(y_true) + {_F1('y2', 'y_pred2')} * sum(y2)) / (sum(y_true) + sum(y2)) AS f1_weighted,
        avg(coalesce(2 * (y_true * y_pred + y2 * y_pred2) / nullif(y_true + y_pred + y2 + y_pred2, 0), 0)) AS f1_samples,
        sum(abs(y_true - y_pred) + abs(y2 - y_pred2)) / (2 * count(*)) AS hamming_loss,
        avg(coalesce((y_true * y_pred + y2 * y_pred2) / nullif(greatest(y_true, y_pred) + greatest(y2, y_pred2), 0), 0)) AS jaccard_index,
        avg(CAST(y_true = y_pred AND y2 = y_pred2 AS INT)) AS subset_accuracy FROM sc""", ctes=SC)
add("ev05_regression", "mae:f rmse:f", lambda s, d: cl.regression_metrics(scored(s, d), "value", "delay_sec"),
    "SELECT avg(abs(value - delay_sec)) AS mae, sqrt(avg(power(value - delay_sec, 2))) AS rmse FROM sc", ctes=SC)
PC = """pc AS (SELECT c AS cls, sum(CAST(ord_true = c AS INT)) AS support, sum(CAST(ord_pred = c AS INT)) AS predicted_n, sum(CAST(ord_true = c AND ord_pred = c AS INT)) AS tp, count(*) AS n
  FROM sc, range(5) t(c) GROUP BY 1)"""
add("ev06_ordinal", "accuracy:f pareto_accuracy_1:f pareto_accuracy_2:f mean_abs_distance:f true_class_mean:f pred_class_mean:f f1_ordinal:f",
    lambda s, d: cl.ordinal_metrics(scored(s, d), "ord_true", "ord_pred"),
    """SELECT avg(CAST(ord_true = ord_pred AS INT)) AS accuracy, avg(CAST(abs(ord_true - ord_pred) <= 1 AS INT)) AS pareto_accuracy_1, avg(CAST(abs(ord_true - ord_pred) <= 2 AS INT)) AS pareto_accuracy_2,
       avg(abs(ord_true - ord_pred)) AS mean_abs_distance, avg(ord_true) AS true_class_mean, avg(ord_pred) AS pred_class_mean,
       (SELECT sum(coalesce(2 * tp / nullif(support + predicted_n, 0), 0) * support) / sum(support) FROM pc) AS f1_ordinal FROM sc""", ctes=SC + ",\n" + PC)
add("ev07_per_class", "cls:i support:i tp:i precision:f sensitivity:f specificity:f f1:f", lambda s, d: cl.per_class(scored(s, d), "ord_true", "ord_pred"),
    """SELECT *, coalesce(tp / nullif(predicted_n, 0), 0) AS precision, tp / support AS sensitivity, (n - support - predicted_n + tp) / (n - support) AS specificity,
       coalesce(2 * tp / nullif(support + predicted_n, 0), 0) AS f1 FROM pc WHERE support > 0""", ctes=SC + ",\n" + PC)
add("ev07_confusion_matrix", "actual:i predicted:i n:i", lambda s, d: cl.confusion_matrix(scored(s, d), "ord_true", "ord_pred"),
    "SELECT ord_true AS actual, ord_pred AS predicted, count(*) AS n FROM sc GROUP BY 1, 2", ctes=SC)
add("ev08_lead_time",
    "mean_lead_time:f median_lead_time:f min_lead_time:f max_lead_time:f " + " ".join(f"lead_time_pct_{t}min:f" for t in cl.LEADS) + " detection_delay:f",
    lambda s, d: cl.lead_time_metrics(scored(s, d), "y_true", "y_pred", "lead"),
    "SELECT avg(lead_min) AS mean_lead_time, median(lead_min) AS median_lead_time, min(lead_min) AS min_lead_time, max(lead_min) AS max_lead_time, "
    + ", ".join(f"100 * avg(CAST(lead_min >= {t} AS INT)) AS lead_time_pct_{t}min" for t in cl.LEADS) + ", -avg(lead_min) AS detection_delay FROM sc WHERE y_true = 1 AND y_pred = 1", ctes=SC)
add("ev09_rolling_metrics", "window_no:i window_start n:i f1:f precision:f recall:f roc_auc:f pr_auc:f",
    lambda s, d: cl.rolling_windows_metrics(scored(s, d), "event_ts", "y_true", "y_pred", "score", 7),
    """SELECT c.window_no, make_timestamp((SELECT min(epoch_us(event_ts)) FROM obs) + c.window_no * 604800000000) AS window_start, n_rows AS n, f1, precision, recall, roc_auc, pr_auc FROM (
       SELECT window_no, count(*) AS n_rows, 2 * sum(y_true * y_pred) / (sum(y_true) + sum(y_pred)) AS f1, sum(y_true * y_pred) / sum(y_pred) AS precision, sum(y_true * y_pred) / sum(y_true) AS recall FROM wn GROUP BY 1) c
       JOIN (SELECT window_no, sum(pos * (n - fp + neg / 2)) / (any_value(p) * any_value(n)) AS roc_auc, sum(pos * tp / (tp + fp)) / any_value(p) AS pr_auc FROM (
         SELECT *, sum(pos) OVER (PARTITION BY window_no ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY window_no ORDER BY score DESC) AS fp, sum(pos) OVER (PARTITION BY window_no) AS p,
         sum(neg) OVER (PARTITION BY window_no) AS n FROM (SELECT window_no, score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM wn GROUP BY 1, 2)) GROUP BY 1) USING (window_no)""",
    ctes=SC + ", wn AS (SELECT *, (epoch_us(event_ts) - (SELECT min(epoch_us(event_ts)) FROM obs)) // 604800000000 AS window_no FROM sc)")
add("ml05_eval_targets", "target positives:i", lambda s, d: cl.eval_targets(scored(s, d), ["y_true", "y2"], 3),
    "SELECT 'y_true' AS target, sum(y_true) AS positives FROM sc UNION ALL SELECT 'y2', sum(y2) FROM sc", ctes=SC)
_BM = [("a", "score"), ("b", "s1"), ("c", "s2")]
add("ml05_best_model", "model basis",
    lambda s, d: cl.best_model(_model_rows(s, d)),
    "SELECT CASE WHEN b > a AND b >= c THEN 'b' WHEN c > a AND c > b THEN 'c' ELSE 'a' END AS model, 'auc' AS basis FROM (SELECT " + ", ".join(
        f"(SELECT sum(pos * (nn - fp + neg / 2)) / any_value(pp * nn) FROM (SELECT *, sum(neg) OVER (ORDER BY sv DESC) AS fp, sum(pos) OVER () AS pp, sum(neg) OVER () AS nn FROM (SELECT {c} AS sv, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM sc GROUP BY 1))) AS {m}"
        for m, c in _BM) + ")", ctes=SC)


def _model_rows(s, d):
    sc = scored(s, d)
    out = None
    for i, (m, c) in enumerate(_BM):
        one = cl.ranking_metrics(sc, "y_true", c).select(F.lit(m).alias("model"), F.lit(i).alias("order"), F.col("roc_auc").alias("auc"), F.lit(0.5).alias("f1_macro"))
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- fairness
GR = "gr AS (SELECT event_type, avg(y_pred) AS rate, sum(y_true * y_pred) / sum(y_true) AS tpr, sum((1 - y_true) * y_pred) / sum(1 - y_true) AS fpr FROM sc GROUP BY 1)"
add("ev11_demographic_parity", "disparity:f ratio:f demographic_parity", lambda s, d: fairness.demographic_parity(scored(s, d), "y_pred", "event_type"),
    "SELECT max(rate) - min(rate) AS disparity, min(rate) / max(rate) AS ratio, max(rate) - min(rate) < 0.1 AS demographic_parity FROM gr", ctes=SC + ",\n" + GR)
add("ev12_equalized_odds", "tpr_disparity:f fpr_disparity:f equalized_odds", lambda s, d: fairness.equalized_odds(scored(s, d), "y_true", "y_pred", "event_type"),
    "SELECT max(tpr) - min(tpr) AS tpr_disparity, max(fpr) - min(fpr) AS fpr_disparity, max(tpr) - min(tpr) < 0.1 AND max(fpr) - min(fpr) < 0.1 AS equalized_odds FROM gr", ctes=SC + ",\n" + GR)
add("ev13_disparate_impact", "grp rate:f impact_ratio:f privileged_group privileged_rate:f min_ratio:f disparate_impact",
    lambda s, d: fairness.disparate_impact(scored(s, d), "y_pred", "event_type"),
    """SELECT event_type AS grp, rate, rate / b AS impact_ratio, g AS privileged_group, b AS privileged_rate, min(rate / b) OVER () AS min_ratio, min(rate / b) OVER () >= 0.8 AS disparate_impact
       FROM gr, (SELECT event_type AS g, rate AS b FROM gr ORDER BY event_type LIMIT 1) WHERE event_type <> g""", ctes=SC + ",\n" + GR)
_EDGE = " + ".join(f"CAST(score >= {i * 0.1!r}::DOUBLE AS INT)" for i in range(11))
CB = f"cb AS (SELECT event_type AS grp, least(greatest({_EDGE} - 1, 0), 9) AS bin, avg(score) AS mean_predicted, avg(y_true) AS mean_actual, count(*) AS n FROM sc GROUP BY 1, 2)"
add("ev10_calibration", "grp bin:i mean_predicted:f mean_actual:f n:i", lambda s, d: fairness.calibration(scored(s, d), "y_true", "score", "event_type"), "SELECT * FROM cb", ctes=SC + ",\n" + CB)
add("ev10_ece", "grp ece:f n_samples:i", lambda s, d: fairness.expected_calibration_error(scored(s, d), "y_true", "score", "event_type"),
    "SELECT grp, sum(n * abs(mean_predicted - mean_actual)) / sum(n) AS ece, sum(n) AS n_samples FROM cb GROUP BY 1", ctes=SC + ",\n" + CB)
add("ev14_cmp11_by_attribute", "attribute disparity:f ratio:f tpr_disparity:f fpr_disparity:f privileged_group min_impact_ratio:f demographic_parity equalized_odds disparate_impact",
    lambda s, d: fairness.by_attribute(scored(s, d), "y_true", "y_pred", ["event_type", "route_id"]),
    """SELECT attribute, max(rate) - min(rate) AS disparity, min(rate) / max(rate) AS ratio, max(tpr) - min(tpr) AS tpr_disparity, max(fpr) - min(fpr) AS fpr_disparity, min(value) AS privileged_group,
       min(rate) FILTER (value <> first) / arg_min(rate, value) AS min_impact_ratio, max(rate) - min(rate) < 0.1 AS demographic_parity, max(tpr) - min(tpr) < 0.1 AND max(fpr) - min(fpr) < 0.1 AS equalized_odds,
       min(rate) FILTER (value <> first) / arg_min(rate, value) >= 0.8 AS disparate_impact FROM (SELECT *, min(value) OVER (PARTITION BY attribute) AS first FROM (
       SELECT attribute, value, avg(y_pred) AS rate, sum(y_true * y_pred) / sum(y_true) AS tpr, sum((1 - y_true) * y_pred) / sum(1 - y_true) AS fpr FROM (
       SELECT 'event_type' AS attribute, event_type AS value, y_true, y_pred FROM sc UNION ALL SELECT 'route_id', route_id, y_true, y_pred FROM sc) GROUP BY 1, 2)) GROUP BY 1""", ctes=SC)

# ---------------------------------------------------------------- significance
add("ev15_paired_t", "n:i mean_difference:f std_difference:f standard_error:f t_statistic:f cohens_d:f", lambda s, d: significance.paired_t(scored(s, d), "s1", "s2"),
    """SELECT n, m AS mean_difference, sd AS std_difference, sd / sqrt(n) AS standard_error, m / (sd / sqrt(n)) AS t_statistic, m / sd AS cohens_d FROM (SELECT count(*) AS n, avg(s1 - s2) AS m,
       stddev_samp(s1 - s2) AS sd FROM sc)""", ctes=SC)
add("ev16_wilcoxon", "n:i statistic:f z_score:f effect_size:f", lambda s, d: significance.wilcoxon(scored(s, d).withColumns({"a": F.col("k") % 23, "b": F.col("stop_sequence") % 19}), "a", "b"),
    """SELECT n, w AS statistic, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24) AS z_score, 1 - 2 * w / (n * (n + 1)) AS effect_size FROM (
       SELECT count(*)::DOUBLE AS n, least(sum(r) FILTER (d > 0), sum(r) FILTER (d < 0)) AS w FROM (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM (
       SELECT k % 23 - stop_sequence % 19 AS d FROM obs) WHERE d <> 0))""", digits=4)
add("ev17_mcnemar", "b:i c:i n_samples:i chi2_statistic:f", lambda s, d: significance.mcnemar(scored(s, d), "y_true", "y_pred", "y_pred2"),
    """SELECT *, power(abs(b - c) - 1, 2) / (b + c) AS chi2_statistic FROM (SELECT sum(CAST(y_pred = y_true AND y_pred2 <> y_true AS INT)) AS b,
       sum(CAST(y_pred <> y_true AND y_pred2 = y_true AS INT)) AS c, count(*) AS n_samples FROM sc)""", ctes=SC)
add("ev18_bootstrap", "mean:f std:f ci_lower:f ci_upper:f", lambda s, d: significance.bootstrap_mean(scored(s, d), "value", "obs_id", 50))


def p_rows(s, d):
    per = significance.paired_t(scored(s, d), "s1", "s2", ("event_type",))
    return per.select(F.col("event_type").alias("model"), (F.lit(1.0) / (1 + F.abs("t_statistic") * F.length("event_type"))).alias("p_value"))


PV = """pv AS (SELECT event_type AS model, 1 / (1 + abs(avg(s1 - s2) / (stddev_samp(s1 - s2) / sqrt(count(*)))) * length(event_type)) AS p_value FROM sc GROUP BY event_type)"""
add("ev19_holm", "model p_value:f significant_corrected", lambda s, d: significance.correct_p_values(p_rows(s, d), alpha=0.02),
    """SELECT model, p_value, min(ok) OVER (ORDER BY p_value, model ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS significant_corrected FROM (SELECT *, CAST(p_value <= 0.02 / (count(*) OVER ()
       - row_number() OVER (ORDER BY p_value, model) + 1) AS INT) AS ok FROM pv)""", ctes=SC + ",\n" + PV)
add("ev19_bonferroni", "model p_value:f significant_corrected corrected_alpha:f", lambda s, d: significance.correct_p_values(p_rows(s, d), alpha=0.02, method="bonferroni"),
    "SELECT *, 0.02 / count(*) OVER () AS corrected_alpha, p_value < 0.02 / count(*) OVER () AS significant_corrected FROM pv", ctes=SC + ",\n" + PV)
add("cmp11_compare_models", "model mean_diff:f t_statistic:f p_value:f significant_corrected", lambda s, d: significance.compare_models(scored(s, d), "s1", ["s2", "score"]))

# ---------------------------------------------------------------- monitoring
HALVES = "ha AS (SELECT *, event_ts < '2024-01-16' AS ref FROM obs)"


def halves(s, d):
    o = obs(s, d)
    return o.filter("event_ts < '2024-01-16'"), o.filter("event_ts >= '2024-01-16'").withColumn("value", F.col("value") * 1.2)


LONG = HALVES + """, lg AS (SELECT 'value' AS feature, CASE WHEN ref THEN value ELSE value * 1.2::DOUBLE END AS v, ref FROM ha UNION ALL SELECT 'speed', speed, ref FROM ha)"""
add("mon01_psi", "feature psi:f drift", lambda s, d: drift.psi(*halves(s, d), ["value", "speed"]))
CATALOG.sql["mon01_psi"] = ("WITH " + views.OBS_SQL.strip() + ",\n" + LONG + """, ed AS (SELECT feature, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM lg WHERE ref GROUP BY 1),
bn AS (SELECT lg.feature, ref, len(list_filter(e, lambda x: x <= v)) AS b FROM lg JOIN ed USING (feature)),
ct AS (SELECT feature, b, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM bn GROUP BY 1, 2),
tt AS (SELECT feature, sum(r) AS rn, sum(c) AS cn FROM ct GROUP BY 1),
fu AS (SELECT g.feature, greatest(coalesce(r, 0) / rn, 1e-10) AS p, greatest(coalesce(c, 0) / cn, 1e-10) AS q FROM (SELECT DISTINCT feature, t.b FROM lg, range(10) t(b)) g
  LEFT JOIN ct ON ct.feature = g.feature AND ct.b = g.b JOIN tt ON tt.feature = g.feature)
SELECT feature, round(sum((q - p) * ln(q / p)) + 3.7e-09, 6) + 0.0 AS psi, sum((q - p) * ln(q / p)) > 0.2 AS drift FROM fu GROUP BY 1""")
add("mon02_ks", "feature rn:i cn:i ks_statistic:f", lambda s, d: drift.ks(*halves(s, d), ["value", "speed"]),
    """SELECT feature, any_value(rn) AS rn, any_value(cn) AS cn, max(abs(rr / rn - cc / cn)) AS ks_statistic FROM (SELECT *, sum(r) OVER (PARTITION BY feature ORDER BY v) AS rr,
       sum(c) OVER (PARTITION BY feature ORDER BY v) AS cc, sum(r) OVER (PARTITION BY feature) AS rn, sum(c) OVER (PARTITION BY feature) AS cn FROM (SELECT feature, v, count(*) FILTER (ref) AS r,
       count(*) FILTER (NOT ref) AS c FROM lg GROUP BY 1, 2)) GROUP BY 1""", ctes=LONG)
add("mon02_cmp12_ks_report", "feature ks_statistic:f p_value:f overall_drift:f drift_detected", lambda s, d: drift.ks_report(*halves(s, d), ["value", "speed"]))
add("mon03_reference_stats", "feature mean:f std:f min:f max:f median:f", lambda s, d: drift.reference_stats(halves(s, d)[0], ["value", "speed"]),
    "SELECT feature, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, median(v) AS median FROM lg WHERE ref GROUP BY 1", ctes=LONG)


def weekly(s, d, part):
    m = cl.binary_metrics(scored(s, d).filter(part), "y_true", "y_pred")
    return m.unpivot([], ["accuracy", "precision", "recall", "f1"], "metric", "value")


add("mon04_degradation", "metric baseline:f value:f relative_change:f severity",
    lambda s, d: drift.degradation(weekly(s, d, "k >= 30"), weekly(s, d, "k % 4 > 0 or y_true = y_pred"), 0.02),
    """SELECT *, (baseline - value) / baseline AS relative_change, CASE WHEN (baseline - value) / baseline > 0.2 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT metric, x.value AS value, y.value AS baseline FROM (
       UNPIVOT (SELECT avg(CAST(y_true = y_pred AS INT)) AS accuracy, sum(y_true * y_pred) / sum(y_pred) AS precision, sum(y_true * y_pred) / sum(y_true) AS recall, 2 * sum(y_true * y_pred) / (sum(y_true) + sum(y_pred)) AS f1
       FROM sc WHERE k >= 30) ON accuracy, precision, recall, f1 INTO NAME metric VALUE value) x JOIN (UNPIVOT (SELECT avg(CAST(y_true = y_pred AS INT)) AS accuracy, sum(y_true * y_pred) / sum(y_pred) AS precision,
       sum(y_true * y_pred) / sum(y_true) AS recall, 2 * sum(y_true * y_pred) / (sum(y_true) + sum(y_pred)) AS f1 FROM sc WHERE k % 4 > 0 OR y_true = y_pred) ON accuracy, precision, recall, f1 INTO NAME metric VALUE value) y
       USING (metric)) WHERE baseline > 0 AND (baseline - value) / baseline > 0.02""", ctes=SC)
add("mon04_performance_summary", "metric mean:f std:f min:f max:f latest:f n_samples:i",
    lambda s, d: drift.performance_summary(cl.binary_metrics(scored(s, d).withColumn("at", F.to_date("event_ts")), "y_true", "y_pred", ["at"]).unpivot(["at"], ["accuracy", "f1"], "metric", "value")),
    """SELECT metric, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, arg_max(value, dd) AS latest, count(*) AS n_samples FROM (
       UNPIVOT (SELECT CAST(event_ts AS DATE) AS dd, avg(CAST(y_true = y_pred AS INT)) AS accuracy, coalesce(2 * sum(y_true * y_pred) / nullif(sum(y_true) + sum(y_pred), 0), 0) AS f1 FROM sc GROUP BY 1)
       ON accuracy, f1 INTO NAME metric VALUE value) GROUP BY 1""", ctes=SC)

ERR = SC + """, er AS (SELECT *, CAST(y_true <> y_pred AS INT) AS e, row_number() OVER (PARTITION BY route_id ORDER BY event_ts, obs_id) AS seen,
  sum(CAST(y_true <> y_pred AS INT)) OVER (PARTITION BY route_id ORDER BY event_ts, obs_id ROWS UNBOUNDED PRECEDING) AS s FROM sc)"""
_D = (["route_id"], ["event_ts", "obs_id"], "y_true", "y_pred")
add("mon05_error_rate_detector", "obs_id:i seen:i error_rate:f warning drift", lambda s, d: drift.error_rate_detector(scored(s, d), *_D, warning=0.55, drift=0.6),
    """SELECT obs_id, seen, CASE WHEN seen >= 30 THEN p END AS error_rate, seen >= 30 AND p + sd > 0.55 AS warning, seen >= 30 AND p + 2 * sd > 0.6 AS drift FROM (SELECT *, sqrt(p * (1 - p) / seen) AS sd FROM (
       SELECT *, s / seen AS p FROM er))""", ctes=ERR)
add("mon06_mean_shift_detector", "obs_id:i seen:i error_rate:f mean_shift:f warning drift", lambda s, d: drift.mean_shift_detector(scored(s, d), *_D),
    """SELECT obs_id, seen, s / seen AS error_rate, g AS mean_shift, coalesce(g > 0.05, false) AS warning, coalesce(g > 0.1, false) AS drift FROM (SELECT a.*, CASE WHEN a.seen >= 20 THEN
       abs((a.s - m.s) / (a.seen // 2) - l.s / (a.seen // 2)) END AS g FROM er a LEFT JOIN er l ON a.route_id = l.route_id AND l.seen = a.seen // 2 LEFT JOIN er m ON a.route_id = m.route_id
       AND m.seen = a.seen - a.seen // 2)""", ctes=ERR)
add("mon07_cusum_detector", "obs_id:i seen:i phi:f drift", lambda s, d: drift.cusum_detector(scored(s, d), *_D),
    "SELECT obs_id, seen, s - seen * 0.005 AS phi, s - seen * 0.005 > 0.01 AS drift FROM er", ctes=ERR)
add("mon07_feature_cusum", "feature phi:f drift", lambda s, d: drift.feature_cusum(splits.with_rank(scored(s, d), "event_ts", "obs_id").withColumn("pos", F.col("rank") + 1), ["score", "s1"]),
    "SELECT *, phi > 0.01 AS drift FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, sum(CAST({c} <= 0.5 AS INT) - 0.005) FILTER (r > 10) AS phi FROM (SELECT *, row_number() OVER (ORDER BY event_ts, obs_id) AS r FROM sc)" for c in ("score", "s1")) + ")", ctes=SC)
_R = "(PARTITION BY route_id ORDER BY event_ts, obs_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"
add("mon08_rolling_performance", "obs_id:i accuracy:f precision:f recall:f f1:f", lambda s, d: drift.rolling_performance(scored(s, d), *_D, window=100),
    f"""SELECT obs_id, CASE WHEN seen >= 10 THEN a END AS accuracy, CASE WHEN seen >= 10 THEN coalesce(tp / nullif(pp, 0), 0) END AS precision, CASE WHEN seen >= 10 THEN coalesce(tp / nullif(yy, 0), 0) END AS recall,
        CASE WHEN seen >= 10 THEN coalesce(2 * tp / nullif(pp + yy, 0), 0) END AS f1 FROM (SELECT *, avg(1 - e) OVER w AS a, sum(y_true * y_pred) OVER w AS tp, sum(y_pred) OVER w AS pp, sum(y_true) OVER w AS yy
        FROM er WINDOW w AS {_R})""", ctes=ERR)
add("mon09_autocorrelation", "lag:i corr:f is_best", lambda s, d: drift.autocorrelation(obs(s, d), ["route_id"], ["event_ts", "obs_id"], "value", 5),
    "SELECT *, corr = max(corr) OVER () AS is_best FROM (" + " UNION ALL ".join(
        f"SELECT {k} AS lag, corr(value, l) AS corr FROM (SELECT value, lag(value, {k}) OVER (PARTITION BY route_id ORDER BY event_ts, obs_id) AS l FROM obs) WHERE l IS NOT NULL" for k in range(1, 6)) + ")")
add("mon10_mean_shift_report", "feature train_mean:f val_mean:f train_std:f shift:f train_positive_rate:f val_positive_rate:f",
    lambda s, d: drift.mean_shift_report(featured(s, d), ["speed", "value"], "disruption_target"),
    " UNION ALL ".join(f"""SELECT '{c}' AS feature, avg({c}) FILTER (split = 'train') AS train_mean, avg({c}) FILTER (split = 'val') AS val_mean, stddev_samp({c}) FILTER (split = 'train') AS train_std,
       abs(avg({c}) FILTER (split = 'train') - avg({c}) FILTER (split = 'val')) / stddev_samp({c}) FILTER (split = 'train') AS shift,
       avg(CAST(disruption_type <> 'ON_TIME' AS INT)) FILTER (split = 'train') AS train_positive_rate, avg(CAST(disruption_type <> 'ON_TIME' AS INT)) FILTER (split = 'val') AS val_positive_rate FROM sp"""
                       for c in ("speed", "value")), ctes=RANK)
