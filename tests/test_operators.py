"""Literal tables and brute-force comparisons."""

import math
import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from stopwise.functions.geo import EARTH_KM
from stopwise.metrics import classification as cl
from stopwise.metrics import significance
from stopwise.ml import models, neighbours
from stopwise.operators import graph, label, merge, quality, spatial, splits, summary, temporal
from stopwise.plans import features
from stopwise.sources import readers
from stopwise.testbed import views

from .conftest import SF


def test_label_truth_table(spark):
    rows = [(0, 30, "normal", False, "IN_TRANSIT", ""), (200, 30, "normal", False, "IN_TRANSIT", ""), (700, 30, "normal", False, "IN_TRANSIT", ""),
            (-100, 30, "normal", False, "IN_TRANSIT", ""), (0, 30, "normal", True, "IN_TRANSIT", ""), (0, 30, "normal", False, "CANCELED", ""),
            (0, 30, "normal", False, "x", "no_service"), (200, 1, "stopped", False, "x", ""), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "delay_sec int, speed int, speed_flag string, has_alert boolean, vehicle_status string, alert_effect string")
    got = [r["disruption_type"] for r in label.classify(df.coalesce(1)).collect()]
    assert got == ["ON_TIME", "MINOR_DELAY", "MAJOR_DELAY", "EARLY", "SERVICE_ALERT", "CANCELLED", "CANCELLED", "STOPPED_ON_ROUTE", "ON_TIME"]


def test_hot_spots(spark):
    df = spark.createDataFrame([("s1", 7, "MAJOR_DELAY"), ("s1", 5, "MINOR_DELAY"), ("s2", 0, "ON_TIME"), ("s2", 3, "EARLY")],
                               "stop_id string, severity_score int, disruption_type string").withColumn("delay_min", F.lit(1.0))
    first = summary.hot_spots(df, 1).first()
    assert (first["stop_id"], first["avg_severity"]) == ("s1", 6.0)


def hourly(spark, n=100):
    return spark.range(n).selectExpr("id", "timestamp_micros(1704067200000000 + id * 3600000000) as ts", "'ON_TIME' as disruption_type")


def test_chronological_split(spark):
    out = splits.chronological_split(hourly(spark), "ts", "id")
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 70, "val": 15, "test": 15}
    assert splits.overlap_check(out, "ts").first()["valid"]
    assert not splits.overlap_check(out.withColumn("split", F.when(F.col("id") == 69, "val").otherwise(F.when(F.col("id") == 71, "train").otherwise(F.col("split")))), "ts").first()["valid"]
    with pytest.raises(ValueError):
        splits.chronological_split(hourly(spark), "ts", "id", 0.5, 0.2, 0.2)


def test_walk_forward_first_fold(spark):
    folds = splits.fold_rows(splits.index_folds(hourly(spark), "ts", "id", 3, 20))
    sizes = {(r["fold"], r["part"]): r["count"] for r in folds.groupBy("fold", "part").count().collect()}
    assert sizes[(0, "train")] == 20 and sizes[(0, "test")] == 20 and sizes[(2, "train")] == 60


def test_class_weights_and_positive_ratio(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,), (1,)], "y int")
    weights = {r["y"]: r["weight"] for r in splits.class_weights(df, "y").collect()}
    assert math.isclose(weights[0], 5 / 6) and math.isclose(weights[1], 5 / 4)
    assert splits.positive_ratio(df, "y").first()[0] == 1.5


def test_correlation_shift_flags_the_changed_feature(spark):
    rows = [("train", i, i, i) for i in range(5)] + [("val", i, 5 - i, i) for i in range(5)]
    df = spark.createDataFrame(rows, "split string, f1 int, f2 int, y int")
    found = {r["feature"]: r["suspicious"] for r in splits.correlation_shift(df, ["f1", "f2"], "y", 0.5).collect()}
    assert found == {"f1": False, "f2": True}


EDGES = [("a", "b"), ("b", "c"), ("c", "d"), ("b", "d"), ("d", "e"), ("e", "f"), ("c", "f"), ("x", "y")]


def brute_betweenness(edges):
    nodes = sorted({n for e in edges for n in e})
    adj = {n: set() for n in nodes}
    for a, b in edges:
        adj[a].add(b)
        adj[b].add(a)
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, sigma, order, queue = {s: 0}, {s: 1.0}, [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w], sigma[w] = dist[v] + 1, 0.0
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in adj[w]:
                if dist[v] == dist[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}


def test_betweenness_is_exact_with_all_sources(spark):
    got = {r["node"]: r["betweenness_centrality"] for r in graph.betweenness(spark.createDataFrame(EDGES, "src string, dst string")).collect()}
    want = brute_betweenness([e for e in EDGES if e[0] != "x"])
    assert got.keys() == want.keys()
    assert all(math.isclose(got[n], want[n], abs_tol=1e-9) for n in want)


def test_pagerank_sums_to_one_and_is_a_fixed_point(spark):
    ranks = {r["node"]: r["pagerank"] for r in graph.pagerank(spark.createDataFrame(EDGES, "src string, dst string")).collect()}
    assert math.isclose(sum(ranks.values()), 1.0, abs_tol=1e-6)
    out = {n: [b for a, b in EDGES if a == n] for n in ranks}
    loose = sum(ranks[n] for n in ranks if not out[n])
    for n in ranks:
        want = 0.15 / len(ranks) + 0.85 * (loose / len(ranks) + sum(ranks[a] / len(out[a]) for a in ranks if n in out[a]))
        assert math.isclose(ranks[n], want, abs_tol=1e-5)


def test_components(spark):
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(EDGES, "src string, dst string")).collect()}
    assert got == {**dict.fromkeys("abcdef", "a"), "x": "x", "y": "x"}


def test_spatial_lag_against_all_pairs(spark, split_keys):
    df = spark.range(120).selectExpr("id as obs_id", "51 + (id % 13) * 0.0037 as stop_lat", "4 + (id % 7) * 0.0041 as stop_lon", "cast(id * 31 % 97 as double) as delay_sec")
    got = {r["obs_id"]: r["spatial_lag_delay"] for r in spatial.spatial_lag(df).collect()}
    data = df.collect()
    for a in data:
        near = [b["delay_sec"] for b in data if b["obs_id"] != a["obs_id"] and abs(a["stop_lat"] - b["stop_lat"]) < 0.01 and abs(a["stop_lon"] - b["stop_lon"]) < 0.01]
        assert math.isclose(got[a["obs_id"]], sum(near) / len(near), rel_tol=1e-9)


@pytest.mark.parametrize("pivots,limit", [(1, 10), (7, 200_000), (60, 3)])
def test_nearest_neighbours_are_exact_over_cells(spark, pivots, limit):
    df = spark.range(150).selectExpr("id", "case when id % 3 = 0 then 5D when id = 100 then null when id = 101 then double('nan') else cast(id * 37 % 11 as double) end as x",
                                     "case when id % 3 = 0 then -0D else cast(id * 53 % 89 as double) end as y").repartition(3)
    data = [r for r in df.collect() if r["x"] is not None and not math.isnan(r["x"])]
    for reference, skip in ((df, True), (df.filter("id % 2 = 0"), True), (df, False)):
        ids = {r["id"] for r in reference.collect()}
        got = {r["id"]: [tuple(v) for v in r["neighbours"]] for r in neighbours.nearest(df, reference, ["x", "y"], "id", 3, skip, pivots, limit).collect()}
        assert set(got) == {r["id"] for r in data}
        for a in data:
            near = sorted(((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2, b["id"], (b["x"], b["y"])) for b in data
                          if b["id"] in ids and not (skip and b["id"] == a["id"]))[:3]
            assert got[a["id"]] == [n[2] for n in near]
    assert not neighbours.nearest(df, df.limit(0), ["x", "y"], "id").collect()


def test_rows_visit_few_cells(spark):
    """Clustered rows see their own cells only: far fewer copies than rows x cells."""
    df = spark.range(3000).selectExpr("id", "id % 30 * 100D + id * 7919 % 13 as x", "id % 6 * 90D + id * 104729 % 17 as y")
    entries = neighbours._entries(df, ["x", "y"], "id", 6)
    _, cells = neighbours._cells(entries, 60, 6)
    queries = neighbours._vectors(df, ["x", "y"], "id", "x").selectExpr("id as q", "x")
    assert neighbours.visits(queries, cells).count() < 6 * 3000


def test_smote_makes_exactly_the_wanted_rows_between_neighbours(spark):
    df = spark.range(403).selectExpr("id", "cast(id % 97 as double) as x", "cast(id % 20 = 0 as int) as y")
    out = neighbours.smote(df, ["x"], "y", "id", 0.2)
    assert out.filter("synthetic").count() == int(df.filter("y = 0").count() * 0.2) - df.filter("y = 1").count()
    lo, hi = df.filter("y = 1").agg(F.min("x"), F.max("x")).first()
    assert out.filter(f"synthetic and (x < {lo} or x > {hi})").count() == 0


def test_oversampled_classes_are_equally_large(spark):
    df = spark.range(500).selectExpr("id", "case when id % 7 = 0 then 'b' when id % 11 = 1 then 'c' else 'a' end as y")
    out = splits.oversample(df, "y", "id")
    top = df.groupBy("y").count().agg(F.max("count")).first()[0]
    assert {r["count"] for r in out.groupBy("y").count().collect()} == {top}
    assert out.groupBy("y", "id").count().groupBy("y").agg((F.max("count") - F.min("count")).alias("d")).filter("d > 1").isEmpty()


def test_oversampled_hot_class_without_broadcast(spark, split_keys):
    """Class sizes too large to broadcast by the estimate are joined by salts of the hot class."""
    df = spark.range(200).selectExpr("id", "case when id % 7 = 0 then 'b' when id % 11 = 1 then 'c' else 'a' end as y")
    want = sorted(map(tuple, splits.oversample(df, "y", "id").collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(map(tuple, splits.oversample(df, "y", "id").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want


def test_proximity_edges_against_all_pairs(spark):
    """Crowded places, repeated and missing ids, high latitudes and values that are no place; the cells get lists, not stops."""
    rng = random.Random(3)
    rows = [(f"s{i}", str(51 + rng.random() * 0.1), str(4 + rng.random() * 0.2)) for i in range(120)]
    rows += [(f"h{i}", "51.05", "4.1") for i in range(150)] + [("h1", "51.05", "4.1")] * 70 + [("s1", "51.05", "4.1"), (None, "51.05", "4.1")]
    rows += [(f"n{i}", str(rng.choice([83.9, 86.0, 89.9, -89.95]) + rng.random() * 0.02), str(rng.random() * 90)) for i in range(60)]
    rows += [("x", "NaN", "4.1"), ("y", None, "4.1"), ("z", "here", "4.1"), ("w", "51.05", "Infinity")]
    df = spark.createDataFrame(rows, "stop_id string, stop_lat string, stop_lon string")
    places = [(i, float(a), float(b)) for i, a, b in rows if i not in (None, "w", "x", "y", "z")]

    def km(a, b):
        (x1, y1), (x2, y2) = (tuple(map(math.radians, p[1:])) for p in (a, b))
        chord = math.sin((x2 - x1) / 2) ** 2 + math.cos(x1) * math.cos(x2) * math.sin((y2 - y1) / 2) ** 2
        return 2 * EARTH_KM * math.asin(math.sqrt(chord))

    want = Counter((a[0], b[0], round(km(a, b), 6)) for a in places for b in places if a[0] != b[0] and km(a, b) <= 2.0)
    out = spatial.proximity_edges(df, 2.0)
    got = out.collect()
    assert Counter((r["src"], r["dst"], round(r["km"], 6)) for r in got) == want
    assert all(abs(r["weight"] - max(0.1, 1 - r["km"] / 2)) < 1e-9 for r in got)
    assert "SortMergeJoin [_cx" in out._jdf.queryExecution().executedPlan().toString()
    assert spatial._blocks(df.selectExpr("stop_id", "51.05D as lat", "4.1D as lon").filter("stop_id like 'h%'")).agg(F.max(F.size("_ids"))).first()[0] < 150


def test_training_rows_are_spread_over_tasks(spark):
    """Neither the class weights nor the fit put the rows of two classes into two tasks."""
    rows = spark.range(0, 1000, 1, 3).selectExpr("cast(id % 7 as double) as x", "cast(id % 10 = 0 as double) as y")
    assert models.spread(rows, 100).rdd.getNumPartitions() == 10 and models.spread(rows, 1000) is rows
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        weighted = splits.add_class_weight(rows, "y")
        assert weighted.rdd.getNumPartitions() == 3
        assert {(r["y"], round(r["class_weight"], 9)) for r in weighted.distinct().collect()} == {(0.0, round(1000 / 1800, 9)), (1.0, 5.0)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert models.score(models.fit(rows, ["x"], "y", numTrees=2), rows).count() == 1000


def test_student_t_against_known_values():
    assert math.isclose(significance.t_two_sided(2.0, 10), 0.07338803, abs_tol=1e-6)
    assert math.isclose(significance.t_two_sided(0.5, 3), 0.6514, abs_tol=1e-4)
    assert math.isclose(significance.t_quantile(0.975, 10), 2.228139, abs_tol=1e-5)


def test_ranking_metrics_with_ties(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.8), (1, 0.4), (0, 0.2)], "y int, s double")
    r = cl.ranking_metrics(df, "y", "s").first()
    assert math.isclose(r["roc_auc"], 0.625) and math.isclose(r["pr_auc"], 0.5 * 0.5 + 0.5 * 2 / 3)
    assert cl.ranking_metrics(df, "y", "s", min_positives=15).first()["roc_auc"] is None


def test_features_do_not_see_the_future(spark):
    """Deleting all later rows leaves every feature of the earlier rows as it was."""
    full = views.labelled(spark, SF)
    cut = "2024-01-01 06:00:00"
    cols = ["delay_prev", "delay_rolling_mean_5", "speed_decel_rate", "stop_mean_delay", "time_since_last_trip", "rolling_mean_delay_5min"]
    def build(df):
        out = temporal.route_trend(temporal.stop_block(temporal.trend_block(df)))
        return sorted(tuple(r) for r in out.filter(F.col("feed_timestamp") <= cut).select("obs_id", *cols).collect())
    assert build(full) == build(full.filter(F.col("feed_timestamp") <= cut))


def test_feature_table_to_train_on_does_not_see_the_future(spark):
    """The same over every numeric column of the feature table that a full run may fit on."""
    obs = views.obs(spark, SF)
    cut = "2024-01-01 06:00:00"

    def build(df):
        out = features.build_features(df, as_of=True)
        names = label.pick_features(out, exclude=("obs_id", "k", "value"))
        rows = out.filter(F.col("feed_timestamp") <= cut).select("obs_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in names])
        return {r.obs_id: r.asDict() for r in rows.collect()}

    early = obs.filter(F.col("feed_timestamp") <= cut)
    assert build(obs) == build(early)


def test_evenly_spaced_files():
    names = [f"f{i:02d}" for i in range(10)]
    assert readers.evenly_spaced(names, 4) == ["f00", "f03", "f06", "f09"]
    assert readers.evenly_spaced(names, None) == names


def test_feed_tree_and_timetable(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "feeds/a.parquet"))
    tree = readers.read_feed_tree(spark, str(tmp_path / "feeds"))
    assert list(tree) == ["vehicle_positions"] and tree["vehicle_positions"].count() == 3
    (tmp_path / "tt").mkdir()
    (tmp_path / "tt/routes.txt").write_text("route_id,route_type,extra\nR1,3,x\nR2,,y\n")
    tables = readers.read_timetable(spark, str(tmp_path / "tt"))
    assert tables["routes"].filter("route_type is null").count() == 1 and tables["stop_times"].count() == 0
    with pytest.raises(FileNotFoundError):
        readers.read_three_feeds(spark, str(tmp_path / "feeds"))


def test_feed_tree_is_routed_in_the_plan(spark, tmp_path):
    root = str(tmp_path / "feeds")
    spark.sql("select 'v1' as entity_id, 4.5D as speed").write.parquet(f"{root}/a/Vehicle_Positions.parquet")
    spark.sql("select 'v2' as entity_id, 'x' as unknown_column").write.parquet(f"{root}/b/other.parquet/service_date=2024-01-01")
    spark.sql("select 't1' as entity_id, 60L as delay").write.parquet(f"{root}/b/trip_update_1.parquet")
    (tmp_path / "feeds/alerts_note.txt").write_text("no parquet")
    tree = readers.read_feed_tree(spark, root)
    assert sorted(tree) == ["trip_updates", "vehicle_positions"]
    vehicles = tree["vehicle_positions"]
    assert sorted((r.entity_id, r.speed) for r in vehicles.collect()) == [("v1", 4.5), ("v2", None)]
    assert "unknown_column" not in vehicles.columns and [r.delay for r in tree["trip_updates"].collect()] == [60]
    assert readers.read_feed_tree(spark, str(tmp_path / "nothing")) == {}


def test_parquet_files_by_schema_and_choice(spark, tmp_path):
    root = str(tmp_path / "many")
    for i in range(5):
        spark.sql(f"select {i} as i").coalesce(1).write.parquet(f"{root}/d{i}.parquet")
    spark.sql("select 9 as i, 'late' as note").coalesce(1).write.parquet(f"{root}/d9.parquet")
    assert sorted(r.i for r in readers.read_parquet_files(spark, root, 3).collect()) == [0, 2, 9]
    whole = readers.read_parquet_files(spark, root)
    assert whole.count() == 6 and sorted(whole.columns) == ["i", "note"]
    declared = readers.read_parquet_files(spark, root, schema="i int, absent string")
    assert declared.columns == ["i", "absent"] and declared.filter("absent is null").count() == 6
    (tmp_path / "empty").mkdir()
    assert readers.read_parquet_files(spark, str(tmp_path / "empty")) is None
    assert readers.read_parquet_files(spark, str(tmp_path / "none"), schema="i int").count() == 0


def brandes(edges, directed):
    """Betweenness over ordered pairs, by the single-source accumulation."""
    links = {(a, b) for a, b in edges if a != b} | (set() if directed else {(b, a) for a, b in edges if a != b})
    nodes, out = {x for e in links for x in e}, {}
    for a, b in links:
        out.setdefault(a, []).append(b)
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        depth, paths, order, before = {s: 0}, {s: 1}, [], {}
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out.get(v, []):
                if w not in depth:
                    depth[w] = depth[v] + 1
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] = paths.get(w, 0) + paths[v]
                    before.setdefault(w, []).append(v)
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before.get(w, []):
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in total.items()}


def test_registered_high_centrality_is_exact(spark, monkeypatch):
    from stopwise.catalog import model

    edges = [(f"n{i}", f"n{j}") for i in range(60) for j in ((i + 1) % 60, (i * 7 + 3) % 60) if i % 9]
    monkeypatch.setattr(model, "transfer_edges", lambda s, d: s.createDataFrame(edges, "src string, dst string"))
    got = {r["node"]: r["betweenness_centrality"] for r in model.CATALOG.queries["grf06_10_high_centrality"](spark, SF).collect()}
    want = {v: x for v, x in brandes(edges, True).items() if x > 0.0005}
    assert got.keys() == want.keys() and all(abs(got[v] - x) < 1e-5 for v, x in want.items())


def test_registered_queries_take_everything(spark, monkeypatch):
    from stopwise.catalog import flow, model

    seen = {}
    monkeypatch.setattr(flow.models, "permutation_importance", lambda m, df, features, *a: seen.update(features=features) or spark.range(1).selectExpr("'a' feature", "0D importance"))
    monkeypatch.setattr(flow.models, "fit", lambda *a, **b: None)
    monkeypatch.setattr(flow, "parts", lambda s, d: (None, None, None))
    flow.CATALOG.queries["ml09_permutation_importance"](spark, SF)
    assert seen["features"] == flow.FEATURES
    messages = views.messages(spark, SF)
    vehicles, updates = model.feeds.vehicle_positions(messages).collect(), {r.trip_id for r in model.feeds.trip_updates(messages).collect()}
    got = model.CATALOG.queries["dq09_vehicles_without_any_update"](spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((r.entity_id, r.trip_id) for r in vehicles if r.trip_id is None or r.trip_id not in updates), key=str)
    edges = {(r.src, r.dst) for r in model.all_obs_edges(spark, SF).collect()}
    last = {}
    for r in sorted(views.labelled(spark, SF).select("stop_id", "feed_timestamp", "severity_score").collect(), key=lambda r: r.feed_timestamp):
        last[r.stop_id] = r.severity_score
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    hops = {a: (b | {c for x in b for c in near.get(x, ())}) - {a} for a, b in near.items()}
    rows = {r.obs_id: r.network_disruption_load for r in model.CATALOG.queries["grf09_network_load_all_edges"](spark, SF).collect()}
    for r in views.labelled(spark, SF).select("obs_id", "stop_id").collect():
        assert rows[r.obs_id] == sum(last.get(x) or 0 for x in hops.get(r.stop_id, ()))


def test_simulate_takes_all_windows(spark):
    from stopwise.ml import models

    rows = [(w, p, float(i), i % 2) for w in (1, 4) for p in ("train", "val", "test") for i in range(20)]
    df = spark.createDataFrame(rows, "window_id int, part string, x double, y int")
    got = {(r.window_id, r.model) for r in models.simulate(df, ["x"], "y", None, ("forest",), numTrees=2, maxDepth=2).select("window_id", "model").collect()}
    assert got == {(w, k) for w in (1, 4) for k in ("forest",)}


@pytest.mark.parametrize("limit", [1_000_000, 30, 1])
def test_two_hop_through_hubs(spark, limit):
    """Two stars that share leaves, a chain, self links and repeats: pairs and sums as by hand, however hubs are cut."""
    pairs = [(f"l{i}", "hub") for i in range(12)] + [("hub", f"r{i}") for i in range(9)] + [(f"l{i}", "mid") for i in range(4, 15)] + [("mid", f"r{i}") for i in range(5, 14)]
    pairs += [("l0", "l1"), ("l1", "r2"), ("l1", "z"), ("z", "y"), ("y", "z"), ("r1", "r1"), ("hub", "l3"), ("hub", "l3"), ("r0", "hub"), ("y", "l5")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    want = {(a, c) for a in out for b in out[a] for c in {b} | out.get(b, set()) if c != a}
    assert {tuple(r) for r in graph.two_hop(edges, limit).collect()} == want
    weight = {n: i % 5 - 1 for i, n in enumerate(sorted({x for p in pairs for x in p})) if i % 7}
    weights = spark.createDataFrame([(n, w) for n, w in weight.items()] + [("l2x", None)], "dst string, weight int")
    got = {r["src"]: r["load"] for r in graph.two_hop_load(edges, weights, limit).collect()}
    sums = {a: sum(weight.get(c, 0) for b, c in want if b == a) for a in out}
    assert {a: got.get(a, 0) for a in out} == sums


@pytest.mark.parametrize("directed", [True, False])
def test_betweenness_in_rounds(spark, directed):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    one = dict(graph.betweenness(edges, directed=directed).collect())
    many = dict(graph.betweenness(edges, directed=directed, reached=10).collect())
    assert one.keys() == many.keys() and all(math.isclose(one[n], many[n], abs_tol=1e-12) for n in one)


@pytest.mark.parametrize("few,sketch", [(200_000, 10_000), (20, 10), (20, 100)])
def test_split_cuts_are_exact_with_ties_and_missing_times(monkeypatch, spark, split_keys, few, sketch):
    monkeypatch.setattr(splits, "FEW", few)
    monkeypatch.setattr(splits, "SKETCH", sketch)
    df = spark.range(700).selectExpr("(id * 389) % 700 as id", "case when id % 90 = 1 then null when id % 3 = 0 then timestamp_seconds(1000) else timestamp_seconds(900 + id % 160) end as ts")
    order = sorted(df.collect(), key=lambda r: (r["ts"] is not None, r["ts"] and r["ts"].timestamp(), r["id"]))
    for shares in ((0.7, 0.15, 0.15), (0.01, 0.5, 0.49), (0.5, 0.5, 0.0), (1.0, 0.0, 0.0)):
        got = {r["id"]: r["split"] for r in splits.chronological_split(df, "ts", "id", *shares).collect()}
        a, b = math.floor(700 * shares[0]), math.floor(700 * (shares[0] + shares[1]))
        assert [got[r["id"]] for r in order] == ["train"] * a + ["val"] * (b - a) + ["test"] * (700 - b)


def test_halving_finds_the_point_of_the_full_search(spark):
    df = spark.range(900).selectExpr("id", "cast(id * 37 % 101 as double) as x", "cast(id * 53 % 97 as double) as z", "cast((id * 37 % 101) * (id * 53 % 97) > 2500 as int) as y")
    train, val = df.filter("id % 4 > 0"), df.filter("id % 4 = 0")
    points = [{"numTrees": n, "maxDepth": m} for n in (1, 5) for m in (1, 4)]
    full = models.search(train, val, ["x", "z"], "y", "forest", {"numTrees": [1, 5], "maxDepth": [1, 4]}).first()
    found = models.halving(train, val, ["x", "z"], "y", "forest", points, "id", eta=2, first_share=0.5).collect()
    won = [r for r in found if r["share"] == 1.0 and r["kept"]]
    assert [(r["params"], r["value"]) for r in won] == [(full["params"], full["value"])]
    assert sum(r["share"] == 1.0 for r in found) < len(points) and sum(r["share"] == 0.5 for r in found) == len(points)


def test_sampled_points_lie_in_the_space():
    for kind, space in models.SPACES.items():
        points = models.sample_space(space, 30)
        assert points == models.sample_space(space, 30) and len({str(p) for p in points}) == len(points) >= 4, kind
        for p in points:
            for name, v in p.items():
                assert v in space[name] if isinstance(space[name], list) else space[name][0] <= v <= space[name][1]


def test_required_fields(spark):
    df = spark.createDataFrame([("trip_updates", "t", None), ("trip_updates", None, "s"), ("vehicle_positions", "t", None)], "feed_type string, trip_id string, stop_id string")
    got = {(r["feed_type"], r["field"]): (r["missing"], r["severity"], r["code"]) for r in quality.required_fields(df).collect()}
    assert got[("trip_updates", "trip_id")] == (1, "error", "NULL_TRIP_ID") and got[("trip_updates", "stop_id")] == (1, "warn", "NULL_STOP_ID")
    assert got[("vehicle_positions", "trip_id")] == (0, None, None) and got[("vehicle_positions", "latitude")] == (1, "warn", "MISSING_LATITUDE")


@pytest.mark.parametrize("plan", [splits.Rolling(4, 2, 1), splits.Rolling(3, 1, 2, 2), splits.Rolling(40, 1, 1)])
def test_spans_are_the_long_forms(spark, plan):
    """Folds and windows as intervals of days hold the same rows as the long forms, with days that have no row."""
    df = spark.range(400).selectExpr("id", "timestamp_seconds(1704067200 + 7000 * id + 200000 * (id div 90)) as ts",
                                     "case when id % 3 = 0 then 'MAJOR_DELAY' else 'ON_TIME' end as disruption_type")
    days = splits.day_table(df, "ts")

    def long(rows, kind):
        return sorted((r[kind], r["part"], r["n"], round(r["rate"], 9)) for r in rows.groupBy(kind, "part").agg(
            F.count(F.lit(1)).alias("n"), F.avg((F.col("disruption_type") != "ON_TIME").cast("double")).alias("rate")).collect())

    def short(spans, kind):
        return sorted((r[kind], r["part"], r["n"], round(r["disruption_rate"], 9)) for r in splits.span_balance(days, spans).collect())

    assert short(splits.window_spans(days, plan), "window_id") == long(splits.rolling_windows(df, "ts", plan), "window_id")
    assert short(splits.fold_spans(days, plan.train_days), "fold") == long(splits.day_folds(df, "ts", plan.train_days), "fold")
    ranked = splits.with_day_rank(df, "ts")
    for span in splits.span_balance(days, splits.fold_spans(days, 30)).collect():
        assert splits.span_rows(ranked, span).count() == span["n"]


def test_pagerank_that_does_not_settle_is_an_error(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    with pytest.raises(ArithmeticError):
        graph.pagerank(edges, max_iterations=1)
    assert math.isclose(sum(r["pagerank"] for r in graph.pagerank(edges).collect()), 1.0, abs_tol=1e-6)
    assert not graph.pagerank(edges.limit(0)).collect()


def test_enrichment_in_shares_is_the_same(spark, monkeypatch):
    """Whole, in shares of the trips and with hot trips, also with trips that repeat, are unknown or missing."""
    stops = spark.range(40).selectExpr("cast(id as string) stop_id", "concat('n', id) stop_name", "cast(51 + id / 100 as string) stop_lat", "'4.5' stop_lon",
                                       "'0' location_type", "cast(null as string) parent_station", "'A' platform_code", "'1' wheelchair_boarding")
    trips = spark.range(60).selectExpr("cast(id % 55 as string) trip_id", "cast(id % 4 as string) route_id", "concat('d', id % 3) service_id", "'1' direction_id",
                                       "concat('x', id % 5) shape_id", "'h' trip_headsign", "'0' wheelchair_accessible", "'1' bikes_allowed")
    times = spark.range(900).selectExpr("case when id % 50 > 0 then cast(id % 60 as string) end trip_id", "cast(id * 7 % 45 as string) stop_id", "id stop_sequence",
                                        "format_string('%02d:%02d:00', id % 20, id % 60) arrival_time", "format_string('%02d:%02d:30', id % 20, id % 60) departure_time", "'0' pickup_type", "'1' drop_off_type")
    dims = {"trips": trips, "stops": stops, "stop_times": times,
            "routes": spark.range(4).selectExpr("cast(id as string) route_id", "'a' agency_id", "concat('s', id) route_short_name", "'long' route_long_name", "'3' route_type"),
            "transfers": spark.range(9).selectExpr("cast(id as string) from_stop_id", "cast(id + 20 as string) to_stop_id"),
            "calendar_dates": spark.range(9).selectExpr("concat('d', id % 3) service_id", "cast(20240101 + id as string) date"),
            "shapes": spark.range(9).selectExpr("concat('x', id % 5) shape_id", "cast(id * 100 as string) shape_dist_traveled")}
    rows = spark.range(700).selectExpr("concat('o', id) obs_id", "case when id % 40 > 0 then cast(id % 65 as string) end trip_id", "cast(id * 7 % 45 as string) stop_id",
                                       "timestamp_seconds(1704067200 + id * 31) feed_timestamp", "cast(id % 90 - 20 as double) delay_sec", "cast(id % 30 as double) speed", "cast(18000 + id * 11 as double) actual_time_sec")

    def enriched():
        out = features.enrich(merge.star_join(rows, dims), dims)
        return out.columns, Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in out.collect())

    whole = enriched()
    assert sum(whole[1].values()) == 700
    written = []
    write = features.cut_lineage
    monkeypatch.setattr(features, "cut_lineage", lambda df, *parts: written.append(len(parts)) or write(df, *parts))
    monkeypatch.setattr(features, "WHOLE_ROWS", 100)
    assert enriched() == whole and written == [features.SHARES]
    spark.conf.set("spark.stopwise.hotRows", "5")
    try:
        assert enriched() == whole and written == [features.SHARES, 0]
    finally:
        spark.conf.unset("spark.stopwise.hotRows")
