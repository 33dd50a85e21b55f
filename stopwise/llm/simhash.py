"""Near-duplicate detection with 64-bit fingerprints and vantage-point trees.

A fingerprint has a bit set where more than half of the XXH64 hashes (seed 42) of a text's three-word runs have it.  Texts
whose fingerprints differ in ``APART`` bits or fewer are linked, and components run along links.

* Equal fingerprints are one point from the start, so groups of copies never meet in a join.
* The upper tree is made from a sample of the points, at most ``SAMPLE`` of them and no more than a sixteenth.  A node holds
  a vantage point and a radius; points within the radius belong to its inner branch, others to the outer one.  Of some
  vantage points and radii the one with the fewest sample points at the border is taken.  The leaves are the shards.
  Every point is dealt to one shard, its home; the sample decides where, never whether a link is found.
* Distances to a vantage point differ by ``APART`` at most for linked points.  So an inner point nearer to the border than
  that also visits the outer branch, and a visitor goes down each branch that its bounds allow.  Two linked points part at
  one node, and the inner one visits the home of the outer one: each link is found in one shard.
* A task reads a shard's own points first and makes them into a tree of its own, searched by the same bounds down to small
  leaves that are compared directly.  Visitors pass in batches.  Links are reduced to a spanning forest before they leave
  the task: a shard returns fewer rows than it has points and visitors, however many pairs are linked.

A shard holds about ``SHARD`` points at most, fewer while there are more tasks than shards.  Fingerprints of unrelated texts
are about 32 bits from any vantage point, so a visitor passes to both branches of a node in a good third of cases.

Null and empty texts and texts without words have fingerprint zero and are linked like others.  Repeated rows have the same
component each; null ids never name a component that has another.  Empty tables give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopwise.llm.near_dedup import components
from stopwise.llm.store import keep, map_rows, raw_text

WORDS = 3
SEED = 42
APART = 2
SAMPLE, SAMPLE_SHARE = 1 << 20, 1 / 16
SHARD, LEAST_SHARD = 1 << 20, 4096
VANTAGE_TRIES = 24
LEAF = 96
PIECE = 1 << 15


def fingerprint(raw: bytes) -> int:
    """Fingerprint of a text as an unsigned number; hashes are counted in pieces, so memory does not grow with the runs."""
    found = raw.lower().split()  # bytes: only A-Z are folded and only the six ASCII spaces split
    if not found:
        return 0
    width = min(WORDS, len(found))
    text, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, counts = len(found) - width + 1, np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        spans = zip(starts[at:min(at + PIECE, n)].tolist(), ends[at + width - 1:min(at + PIECE, n) + width - 1].tolist())
        h = np.array([xxhash.xxh64_intdigest(text[s:e], SEED) for s, e in spans], ">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``point``, the fingerprint as a signed long, of each row."""
    def make():
        def step(r):
            value = fingerprint(r["raw"])
            return [(r["doc_id"], value - (1 << 64) if value >> 63 else value)]

        return step

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("point", T.LongType())])
    return map_rows(docs.select("doc_id", raw_text().alias("raw")), make, schema)


def apart(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def upper_tree(sample: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii in heap order; a node whose sample ran out keeps everything in its inner branch."""
    vantage, radius = np.zeros((1 << levels) - 1, np.uint64), np.full((1 << levels) - 1, 64, np.int16)
    parts = [sample]
    for level in range(levels):
        below = []
        for i, part in enumerate(parts):
            node = (1 << level) - 1 + i
            best = None
            for v in part[np.linspace(0, len(part) - 1, min(len(part), VANTAGE_TRIES)).astype(int)] if len(part) > 1 else ():
                d = apart(part, v)
                at = np.bincount(d, minlength=66)
                inner = np.cumsum(at)
                border = np.convolve(at, np.ones(2 * APART + 1, int), "same")
                for r in np.flatnonzero((inner >= 0.35 * len(part)) & (inner <= 0.65 * len(part))):
                    if best is None or border[r] < best[0]:
                        best = (border[r], v, r)
                if best is None:
                    r = int(np.median(d))
                    if inner[r] < len(part):
                        best = (border[r] + len(part), v, r)
            if best is not None:
                vantage[node], radius[node] = best[1], best[2]
            d = apart(part, vantage[node])
            below += [part[d <= radius[node]], part[d > radius[node]]]
        parts = below
    return vantage, radius


def route(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, point and whether it is a visitor there, for all shards that each point has to see."""
    vantage, radius = tree
    leaf = np.zeros(len(points), np.int64)
    guest = np.zeros(len(points), bool)
    for level in range((len(vantage) + 1).bit_length() - 1):
        node = (1 << level) - 1 + leaf
        d, r = np.bitwise_count(points ^ vantage[node]).astype(np.int16), radius[node]
        home = np.where(d <= r, 0, 1)
        # Inner points and visitors go to the outer branch, and visitors to the inner one, where the bounds allow.
        outer = (d <= r) & (d + APART > r)
        inner = guest & (d > r) & (d - APART <= r)
        also = outer | inner
        points = np.concatenate([points, points[also]])
        leaf = np.concatenate([2 * leaf + home, 2 * leaf[also] + 1 - home[also]])
        guest = np.concatenate([guest, np.ones(int(also.sum()), bool)])
    return leaf, points, guest


def near(points: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of points and queries that differ in ``APART`` bits or fewer, by a tree over the points."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(np.arange(len(points)), np.arange(len(queries)))]
    while stack:
        mine, asked = stack.pop()
        if not len(mine) or not len(asked):
            continue
        if len(mine) > LEAF:
            v = points[mine[len(mine) // 2]]
            d, dq = apart(points[mine], v), apart(queries[asked], v)
            r = np.int16(np.median(d))
            inner = d <= r
            if not inner.all():
                stack.append((mine[inner], asked[dq - APART <= r]))
                stack.append((mine[~inner], asked[dq + APART > r]))
                continue
        step = max(1, (1 << 20) // len(mine))
        for at in range(0, len(asked), step):
            some = asked[at:at + step]
            i, j = np.nonzero(np.bitwise_count(queries[some][:, None] ^ points[mine][None, :]) <= APART)
            if len(i):
                found.append((mine[j], some[i]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


class Forest:
    """Union-find over points; ``join`` returns the links that were needed."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(up, up)
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        out = []
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                out.append((x, y))
        return out


def _dealt(points: DataFrame, tree: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_points), PIECE):
                shard, point, guest = route(all_points[at:at + PIECE], shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(point.view(np.int64)), pa.array(guest)], ["shard", "point", "guest"])

    return points.mapInArrow(run, "shard long, point long, guest boolean")


def _linked(dealt: DataFrame, shards: int) -> DataFrame:
    """``a, b``: a spanning forest of the links of each shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, points, forest = None, [], None, Forest()

        def own() -> tuple[np.ndarray, list]:
            points = np.concatenate(held) if held else np.zeros(0, np.uint64)
            links = []
            for at in range(0, len(points), PIECE):
                i, j = near(points, points[at:at + PIECE])
                some = i < j + at
                links += forest.join(points[i[some]], points[at:at + PIECE][j[some]])
            return points, links

        def out(links: list) -> pa.RecordBatch:
            pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            shard, point, guest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (guest[1:] != guest[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)]):
                if s == e:
                    continue
                if shard[s] != now:
                    if points is None and held:
                        yield out(own()[1])
                    now, held, points, forest = shard[s], [], None, Forest()
                some = point[s:e].view(np.uint64)
                if not guest[s]:
                    held.append(some)
                    continue
                if points is None:
                    points, links = own()
                    yield out(links)
                i, j = near(points, some)
                yield out(forest.join(points[i], some[j]))
        if points is None and held:
            yield out(own()[1])

    return dealt.repartition(shards, "shard").sortWithinPartitions("shard", "guest").mapInArrow(run, "a long, b long")


def point_links(points: DataFrame) -> DataFrame:
    """``a, b``: links between different points that hold each component of the whole together; ``points`` is distinct."""
    spark = points.sparkSession
    n = points.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = min(SHARD, max(LEAST_SHARD, n // (2 * tasks)))
    levels = max(0, math.ceil(math.log2(n / size))) if n else 0
    share = min(SAMPLE_SHARE, SAMPLE / max(n, 1))
    by_hash = F.pmod(F.xxhash64(F.lit(7), "point"), F.lit(1 << 20))
    sample = points.filter(by_hash < int(share * (1 << 20))).orderBy("point").toArrow()["point"].to_numpy().view(np.uint64) if levels else np.zeros(0, np.uint64)
    return keep(_linked(_dealt(points, upper_tree(sample, levels)), min(1 << levels, 4 * tasks)))


def simhash(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row."""
    rows = keep(fingerprints(docs))
    points = keep(rows.groupBy("point").agg(F.min("doc_id").alias("doc_id")))
    links = point_links(points.select("point"))
    named = points.select("point", "doc_id", F.col("point").alias("comp"))
    if not links.isEmpty():
        labels = components(links).withColumnRenamed("id", "point")
        named = points.join(labels, "point", "left").select("point", "doc_id", F.coalesce("comp", "point").alias("comp"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "comp").select("point", "component_id")
    return rows.join(named, "point").select(
        "doc_id", F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), "component_id")
