"""Stop graph: edges, neighbourhoods, disruption load, and the iterative measures.

Iterations are plain joins and aggregates; every round is written to the reliable checkpoint folder, so plans stay
short and a lost executor costs one round.  Per-node tables are joined to the edges through ``skew.lookup``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise.operators.temporal import latest_per_key
from stopwise.ordered import with_windows
from stopwise.session import cut_lineage
from stopwise.skew import attach, lookup

SEQ = ["stop_sequence", "stop_id"]
#: Pairs of edges through one node above which its edges are cut into blocks, or its neighbourhood is summed as a whole.
HUB_PAIRS = 1_000_000
#: Rows of (source, reached node) that one round of betweenness sources may have.
REACHED = 100_000_000


def _next_stop(stop_times: DataFrame) -> DataFrame:
    st = stop_times.select(
        F.col("trip_id").cast("string"), F.col("stop_id").cast("string"),
        F.col("stop_sequence").try_cast("long").alias("stop_sequence")).filter("stop_sequence is not null")
    return with_windows(st, ["trip_id"], SEQ, [], [lambda w: {"dst": F.lead("stop_id").over(w)}], ahead=1).filter(
        "dst is not null").select("trip_id", "stop_sequence", F.col("stop_id").alias("src"), "dst")


def sequence_edges(stop_times: DataFrame) -> DataFrame:
    """Distinct directed edges between consecutive stops of a trip."""
    return _next_stop(stop_times).select("src", "dst").distinct()


def weighted_edges(stop_times: DataFrame) -> DataFrame:
    """One edge per consecutive pair of each trip, weight 1 / position in the trip, scaled by the largest weight."""
    from stopwise.ordered import with_running

    ranked = with_running(_next_stop(stop_times), ["trip_id"], ["stop_sequence", "src", "dst"], {"position": ("count", F.lit(1))})
    raw = ranked.withColumn("weight", 1.0 / F.col("position"))
    top = raw.agg(F.max("weight")).scalar()
    return raw.withColumn("weight", F.col("weight") / (top + F.lit(1e-9))).select("trip_id", "src", "dst", "position", "weight")


def route_stop_edges(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """Route to stop edges, one per stop time (repeats kept)."""
    owner = trips.select("trip_id", "route_id").distinct()
    return attach(stop_times.select("trip_id", "stop_id"), owner, ["trip_id"], F.xxhash64("stop_id")).filter(
        "route_id is not null").select(F.col("route_id").alias("src"), F.col("stop_id").alias("dst"))


def node_index(nodes: DataFrame, node: str) -> DataFrame:
    """Dense 0-based index in id order.

    The distinct ids are sorted in ranges and written once with their place in the range; the index is that place plus the number
    of ids in earlier ranges, so no task sees more than one range, whatever the ids begin with.
    """
    ids = nodes.select(node).filter(F.col(node).isNotNull()).distinct().orderBy(node)
    placed = cut_lineage(ids.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per range.
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return placed.withColumn("_p", part).join(F.broadcast(shift), "_p").select(node, (place + F.col("_shift")).alias("node_idx"))


def _hubs(into: DataFrame, out: DataFrame, limit: int) -> DataFrame:
    """``mid`` with the numbers of blocks of its in- and out-edges, for nodes with more than ``limit`` pairs through them."""
    a = into.groupBy("mid").agg(F.count(F.lit(1)).alias("_a"))
    b = out.groupBy("mid").agg(F.count(F.lit(1)).alias("_b"))
    side = limit ** 0.5
    heavy = a.join(b, "mid").filter(F.col("_a").cast("double") * F.col("_b") > limit)
    return heavy.select("mid", F.ceil(F.col("_a") / side).cast("int").alias("_a"), F.ceil(F.col("_b") / side).cast("int").alias("_b"))


def _through(into: DataFrame, out: DataFrame, limit: int) -> DataFrame:
    """Pairs (src, mid) with (mid, dst).  The edges of a hub are cut into blocks of sqrt(limit) on both sides and every pair of
    blocks is a join key of its own, so a star is spread over tasks and an edge is copied once per block it meets."""
    hubs = cut_lineage(_hubs(into, out, limit))
    left, right = lookup(into, hubs, ["mid"], F.xxhash64("src")), lookup(out, hubs, ["mid"], F.xxhash64("dst"))

    def block(name: str, of: str) -> Column:
        return F.coalesce(F.pmod(F.xxhash64(name), F.col(of)).cast("int"), F.lit(0))

    def every(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(of), F.lit(1)) - 1))

    left = left.withColumns({"_i": block("src", "_a"), "_j": every("_b")}).drop("_a", "_b")
    right = right.withColumns({"_i": every("_a"), "_j": block("dst", "_b")}).drop("_a", "_b")
    return left.join(right, ["mid", "_i", "_j"]).drop("_i", "_j")


def two_hop(edges: DataFrame, limit: int = HUB_PAIRS) -> DataFrame:
    """Nodes reachable in one or two steps, without the node itself."""
    first = cut_lineage(edges.select("src", "dst").distinct())
    second = _through(first.select("src", F.col("dst").alias("mid")), first.select(F.col("src").alias("mid"), "dst"), limit)
    return first.union(second.select("src", "dst")).filter("src <> dst").distinct()


def two_hop_load(edges: DataFrame, weights: DataFrame, limit: int = HUB_PAIRS) -> DataFrame:
    """``src`` and ``load``: the sum of ``weight`` (per ``dst``) over the nodes reachable in one or two steps, without the node itself.

    Pairs are made through light nodes only.  What lies behind hubs is summed once per set of hubs that some node leads to, and
    is shared by all nodes with that set; what such a node also reaches by light ways counts only when it is not behind its hubs.
    """
    first = cut_lineage(edges.select("src", "dst").distinct())
    weighed = weights.filter(F.col("weight") != 0)
    ends = cut_lineage(lookup(first, weighed, ["dst"], F.xxhash64("src")).filter("weight is not null"))
    into, out = first.select("src", F.col("dst").alias("mid")), ends.select(F.col("src").alias("mid"), "dst", "weight")
    hubs = cut_lineage(_hubs(into, out, limit).select("mid"))
    if hubs.isEmpty():
        light = ends.unionByName(into.join(out, "mid").select("src", "dst", "weight")).filter("src <> dst").distinct()
        return light.groupBy("src").agg(F.sum("weight").alias("load"))
    flags = hubs.withColumn("_hub", F.lit(True))
    marked = cut_lineage(lookup(into, flags, ["mid"], F.xxhash64("src")))
    light = ends.unionByName(marked.filter("_hub is null").join(out, "mid").select("src", "dst", "weight")).filter("src <> dst").distinct()
    sets = cut_lineage(marked.filter("_hub").groupBy("src").agg(F.array_sort(F.collect_set("mid")).alias("hubs")))
    behind = cut_lineage(_through(
        sets.select("hubs").distinct().select(F.col("hubs").alias("src"), F.explode("hubs").alias("mid")), out, limit).select(
        F.col("src").alias("hubs"), "dst", "weight").distinct())
    shared = behind.groupBy("hubs").agg(F.sum("weight").alias("_all"))
    own = behind.select("hubs", F.col("dst").alias("src"), F.col("weight").alias("_own"))
    more = light.join(sets, "src", "left").join(behind.select("hubs", "dst", F.lit(True).alias("_in")), ["hubs", "dst"], "left") \
        .filter("_in is null").groupBy("src").agg(F.sum("weight").alias("_more"))
    mine = sets.join(shared, "hubs", "left").join(own, ["hubs", "src"], "left").select(
        "src", (F.coalesce("_all", F.lit(0)) - F.coalesce("_own", F.lit(0))).alias("_far"))
    return mine.join(more, "src", "full").select("src", (F.coalesce("_far", F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("load"))


def network_load(df: DataFrame, edges: DataFrame, severity: str = "severity_score", spread: str = "obs_id", limit: int = HUB_PAIRS) -> DataFrame:
    """Sum of the latest severities over the two-hop neighbourhood of the stop, also relative to the own severity."""
    latest = latest_per_key(df, ["stop_id"], severity).select(F.col("stop_id").alias("dst"), F.col(f"last_{severity}").alias("weight"))
    load = two_hop_load(edges, latest, limit).select(F.col("src").alias("stop_id"), F.col("load").alias("network_disruption_load"))
    rows = attach(df, load, ["stop_id"], F.col(spread))
    out = rows.withColumn("network_disruption_load", F.coalesce("network_disruption_load", F.lit(0)).cast("double"))
    return out.withColumn("network_load_normalized", F.try_divide(F.col("network_disruption_load"), F.col(severity)))


def pagerank(edges: DataFrame, alpha: float = 0.85, iterations: int | None = None, tolerance: float = 1e-6,
             max_iterations: int = 100) -> DataFrame:
    """PageRank with uniform restart; the mass of nodes without out-edges is spread evenly.

    Stops after ``iterations`` rounds, or when the total change falls below ``nodes * tolerance``; not getting there within
    ``max_iterations`` rounds is an error.
    """
    links = edges.select("src", "dst").distinct()
    degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))
    links = cut_lineage(lookup(links, degree, ["src"], F.xxhash64("dst")))
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    nodes = cut_lineage(lookup(nodes, degree.withColumnRenamed("src", "node"), ["node"]))
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    if not n:
        return ranks.select("node", F.col("rank").alias("pagerank"))
    rounds = iterations if iterations is not None else max_iterations
    for _ in range(rounds):
        loose = ranks.filter("out_degree is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).scalar()
        given = lookup(links, ranks.select(F.col("node").alias("src"), "rank"), ["src"], F.xxhash64("dst"))
        got = given.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out_degree")).alias("_in"))
        step = lookup(ranks.withColumnRenamed("rank", "_old"), got, ["node"])
        value = alpha * (F.coalesce("_in", F.lit(0.0)) + loose / n) + (1 - alpha) / n
        fresh = cut_lineage(step.select("node", "out_degree", "_old", value.alias("rank")))
        ranks = fresh.drop("_old")
        if iterations is None and (fresh.agg(F.sum(F.abs(F.col("rank") - F.col("_old")))).first()[0] or 0.0) < n * tolerance:
            break
    else:
        if iterations is None:
            raise ArithmeticError(f"ranks still change by {n * tolerance} or more after {max_iterations} rounds")
    return ranks.select("node", F.col("rank").alias("pagerank"))


def components(edges: DataFrame) -> DataFrame:
    """Weakly connected components: node and the smallest id of its component.

    Each round takes the smallest label among the neighbours and then follows the label one step, so long chains
    shrink quickly; rounds go on until no label changes.
    """
    both = edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct()
    both = cut_lineage(both)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    labels = cut_lineage(nodes.withColumn("label", F.col("node")))
    while True:
        seen = lookup(both, labels.select(F.col("node").alias("dst"), "label"), ["dst"], F.xxhash64("src"))
        low = seen.groupBy(F.col("src").alias("node")).agg(F.min("label").alias("_low"))
        step = lookup(labels, low, ["node"]).select("node", "label", F.least("label", F.coalesce("_low", "label")).alias("_new"))
        jump = step.select(F.col("node").alias("_new"), F.col("_new").alias("_far"))
        fresh = cut_lineage(lookup(step, jump, ["_new"], F.xxhash64("node")).select(
            "node", F.col("label").alias("_old"), F.least("_new", F.coalesce("_far", "_new")).alias("label")))
        labels = fresh.drop("_old")
        if fresh.filter("label <> _old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))


def graph_report(edges: DataFrame, nodes: DataFrame, node: str = "stop_id") -> DataFrame:
    """Nodes, edges, density, isolated nodes, components and the size of the largest."""
    comp = components(edges)
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    isolated = nodes.select(F.col(node).alias("node")).distinct().join(comp.select("node"), "node", "left_anti")
    n = nodes.select(node).distinct().agg(F.count(F.lit(1))).scalar()
    m = edges.agg(F.count(F.lit(1))).scalar()
    return sizes.agg(F.count(F.lit(1)).alias("num_components"), F.max("size").alias("largest_component")).withColumns({
        "num_nodes": n, "num_edges": m, "num_isolated_nodes": isolated.agg(F.count(F.lit(1))).scalar(),
        "edge_density": F.coalesce(F.try_divide(m.cast("double"), n.cast("double") * (n - 1)), F.lit(0.0))})


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges within the largest weakly connected component (ties: smallest label)."""
    comp = components(edges)
    top = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    members = comp.join(F.broadcast(top.select("component")), "component", "left_semi")
    inside = lookup(edges, members.select(F.col("node").alias("src"), "component"), ["src"], F.xxhash64("dst"))
    return inside.filter("component is not null").drop("component")


def _dependencies(links: DataFrame, sources: DataFrame, directed: bool) -> DataFrame:
    """``v, dep``: Brandes dependencies out of the given sources.

    Every level of the search is a table that is written once.  In an undirected graph a neighbour of the front is in one of
    the last two levels or new; with directed links an edge may lead back to any level, so all of them are read.
    """
    levels = [cut_lineage(sources.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("sigma")))]
    while True:
        grown = levels[-1].join(links.withColumnRenamed("src", "v"), "v").groupBy("s", F.col("dst").alias("v")).agg(F.sum("sigma").alias("sigma"))
        seen = reduce(DataFrame.unionByName, [x.select("s", "v") for x in (levels if directed else levels[-2:])])
        fresh = cut_lineage(grown.join(seen, ["s", "v"], "left_anti").select("s", "v", "sigma"))
        if fresh.isEmpty():
            break
        levels.append(fresh)
    total = None
    below = None
    for level in reversed(levels):
        if below is None:
            here = level.withColumn("delta", F.lit(0.0))
        else:
            part = below.select("s", F.col("v").alias("w"), ((1 + F.col("delta")) / F.col("sigma")).alias("_share"))
            pulled = level.select("s", "v", "sigma").join(links.withColumnRenamed("src", "v"), "v").select(
                "s", "v", "sigma", F.col("dst").alias("w")).join(part, ["s", "w"])
            gain = pulled.groupBy("s", "v").agg(F.sum(F.col("sigma") * F.col("_share")).alias("delta"))
            here = level.join(gain, ["s", "v"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
        here = cut_lineage(here)
        mine = here.filter("s <> v").groupBy("v").agg(F.sum("delta").alias("dep"))
        total = mine if total is None else total.unionByName(mine)
        below = here
    return total.groupBy("v").agg(F.sum("dep").alias("dep"))


def betweenness(edges: DataFrame, sources: int | None = None, seed: int = 42, directed: bool = False, lcc: bool = True,
                reached: int = REACHED) -> DataFrame:
    """Betweenness centrality from shortest paths out of all nodes, or of ``sources`` sampled ones and scaled to all.

    State is one row per (source, reached node), written twice: when the search reaches it and on the way back.  Sources are
    taken in rounds of at most about ``reached`` such rows.  With as many sources as nodes the result is exact.
    """
    graph = largest_component(edges) if lcc else edges
    links = graph.select("src", "dst").filter("src <> dst")
    if not directed:
        links = links.union(links.select("dst", "src"))
    links = cut_lineage(links.distinct())
    nodes = cut_lineage(links.select(F.col("src").alias("node")).union(links.select("dst")).distinct())
    n = nodes.count()
    k = n if sources is None else min(sources, n)
    picked = nodes if k == n else cut_lineage(nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(k))
    rounds = max(1, -(-k * n // reached))
    parts = [cut_lineage(_dependencies(links, picked.filter(F.pmod(F.xxhash64("node", F.lit(seed + 1)), F.lit(rounds)) == i), directed)) for i in range(rounds)]
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) * n / max(k, 1)
    sums = reduce(DataFrame.unionByName, parts).groupBy(F.col("v").alias("node")).agg(F.sum("dep").alias("dep"))
    return nodes.join(sums, "node", "left").select("node", (F.coalesce("dep", F.lit(0.0)) * scale).alias("betweenness_centrality"))


def centrality_features(df: DataFrame, stop_times: DataFrame, sources: int | None = None, spread: str = "obs_id") -> DataFrame:
    """Betweenness with its log form, PageRank and network load on the observation rows."""
    edges = cut_lineage(sequence_edges(stop_times))
    bc = betweenness(edges, sources).withColumnRenamed("node", "stop_id")
    pr = pagerank(edges).withColumnRenamed("node", "stop_id")
    out = lookup(lookup(df, bc, ["stop_id"], F.col(spread)), pr, ["stop_id"], F.col(spread))
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("betweenness_centrality", "pagerank")})
    out = out.withColumn("betweenness_centrality_log", F.log1p(F.col("betweenness_centrality") * 1000))
    return network_load(out, edges, spread=spread)


def high_centrality(bc: DataFrame, threshold: float) -> DataFrame:
    return bc.filter(F.col("betweenness_centrality") > threshold).orderBy(F.desc("betweenness_centrality"), "node")


def sample_trips(stop_times: DataFrame, max_trips: int, seed: int = 42) -> DataFrame:
    """Stop times of at most ``max_trips`` trips, chosen by a seeded hash of the trip id."""
    kept = stop_times.select("trip_id").distinct().orderBy(F.xxhash64("trip_id", F.lit(seed)), "trip_id").limit(max_trips)
    return stop_times.join(kept, "trip_id", "left_semi")


def sample_rows(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of ``n`` rows by a seeded hash of the row id."""
    return df.orderBy(F.xxhash64(row_id, F.lit(seed)), row_id).limit(n)
