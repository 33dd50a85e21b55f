"""Exact nearest neighbours in feature space, and the features built on them.

The reference is cut into cells around pivots, and the triangle inequality decides which cells a row has to see.

* Equal reference vectors are one entry with its smallest ids, and equal rows are one query, so a value that fills a third
  of the table is searched once.
* Pivots are reference vectors picked by a hash, at most ``PIVOTS``; every entry belongs to the cell of its nearest pivot.  A
  cell is described by its radius and its few smallest distances to the pivot: a table of pivots x k numbers.
* Distance to a pivot plus one of those distances bounds what the cell can offer from above, so the k-th smallest of these sums
  bounds the k-th neighbour.  A query visits a cell only if it is nearer than that to its ball and to its side of the
  plane between the two pivots.
* A cell and its visitors meet in one task: the entries first, sorted by distance to the pivot, then the visitors in batches,
  which are compared with the entries inside their ring only.  A cell with more than ``VISITS`` visitors is repeated over
  several tasks, so its entries are copied once per so many visitors.

Rows with a missing or NaN feature have no neighbours and are nobody's neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopwise.session import cut_lineage

PIVOTS = 4096
CELL = 10_000
VISITS = 200_000
#: Numbers held at once by a distance table.
TABLE = 1 << 21
#: Rounding of a bound, relative to its size.
SLACK = 1e-9


def _vectors(df: DataFrame, features: Sequence[str], row_id: str, name: str) -> DataFrame:
    """``id`` and the vector of each row that has all features; zero has one sign."""
    values = [F.col(c).cast("double") + F.lit(0.0) for c in features]
    rows = df.select(F.col(row_id).alias("id"), F.array(*values).alias(name))
    return rows.filter(F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x)))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, summed feature by feature so that only one table is held."""
    out = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        out += (x[:, i, None] - y[None, :, i]) ** 2
    return out


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def _entries(reference: DataFrame, features: Sequence[str], row_id: str, want: int) -> DataFrame:
    """``y, ids``: different reference vectors with their ``want`` smallest ids (cut to that many before the shuffle)."""
    rows = _vectors(reference, features, row_id, "y")
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("y").orderBy("id"))).filter(F.col("_n") <= want)
    return first.groupBy("y").agg(F.sort_array(F.collect_list("id")).alias("ids"))


class Cells:
    """Pivots with the radius of each cell and its ``want`` smallest distances; broadcast, at most PIVOTS rows."""

    def __init__(self, pivots: np.ndarray, radius: np.ndarray, closest: np.ndarray):
        self.pivots, self.radius, self.closest = pivots, radius, closest

    def visits(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Row, cell, distance to its pivot and bound of the k-th neighbour, for each cell a row has to see."""
        step = max(1, TABLE // self.closest.size)
        for at in range(0, len(x), step):
            some = x[at:at + step]
            d = np.sqrt(_distances(some, self.pivots))
            want = self.closest.shape[1]
            sums = (d[:, :, None] + self.closest[None]).reshape(len(some), -1)
            bound = np.partition(sums, want - 1, axis=1)[:, want - 1] * (1 + SLACK)
            home = d.argmin(axis=1)
            between = np.sqrt(_distances(self.pivots[home], self.pivots))
            own = d[np.arange(len(some)), home][:, None]
            plane = np.divide(d ** 2 - own ** 2, 2 * between, out=np.zeros_like(d), where=between > 0)
            slack = SLACK * (1 + d)
            row, cell = np.nonzero((d - self.radius <= bound[:, None] + slack) & (plane <= bound[:, None] + slack) & (self.radius >= 0))
            yield row + at, cell, d[row, cell], bound[row]


def _cells(entries: DataFrame, pivots: int, want: int) -> tuple[DataFrame, Cells]:
    """Entries with their cell and distance, and the description of the cells."""
    spark = entries.sparkSession
    table = _stack(entries.orderBy(F.xxhash64("y"), "y").limit(pivots).select("y").toPandas()["y"])
    shared = spark.sparkContext.broadcast(table)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            step = max(1, TABLE // len(shared.value))
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at:at + step]
                d = _distances(_stack(part["y"]), shared.value)
                cell = d.argmin(axis=1)
                yield part.assign(cell=cell.astype("int32"), dist=np.sqrt(d[np.arange(len(part)), cell]))

    kind = dict(entries.dtypes)["ids"]
    index = cut_lineage(entries.mapInPandas(assign, f"y array<double>, ids {kind}, cell int, dist double"))
    first = index.select("cell", "dist").withColumn("_n", F.row_number().over(Window.partitionBy("cell").orderBy("dist"))).filter(F.col("_n") <= want)
    closest, radius = np.full((len(table), want), np.inf), np.full(len(table), -1.0)
    for r in first.collect():
        closest[r["cell"], r["_n"] - 1] = r["dist"]
    for r in index.groupBy("cell").agg(F.max("dist").alias("radius")).collect():
        radius[r["cell"]] = r["radius"]
    return index, Cells(table, radius, closest)


def visits(queries: DataFrame, cells: Cells) -> DataFrame:
    """``cell, q, x, dist, bound``: the cells that each query has to see."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                for row, cell, dist, bound in shared.value.visits(_stack(pdf["x"])):
                    yield pd.DataFrame({"cell": cell.astype("int32"), "q": pdf["q"].to_numpy()[row], "x": pdf["x"].to_numpy()[row],
                                        "dist": dist, "bound": bound})

    return queries.select("q", "x").mapInPandas(run, "cell int, q long, x array<double>, dist double, bound double")


def _searched(index: DataFrame, found: DataFrame, want: int, limit: int) -> DataFrame:
    """``q, d, id, y``: the ``want`` best entries of each visit."""
    counts = found.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("salts"))  # one row per cell
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    ids = dict(index.dtypes)["ids"]
    left = index.join(F.broadcast(counts), "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "dist", none("double", "bound"),
        none("long", "q"), F.col("y").alias("v"), "ids")
    right = found.join(F.broadcast(counts), "cell").select(
        "cell", F.pmod(F.xxhash64("q"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "dist", "bound", "q", F.col("x").alias("v"),
        none(ids, "ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, cell = None, [], None
        for pdf in batches:
            for key, part in pdf.groupby(["cell", "salt", "kind"], sort=True):
                if key[:2] != now:
                    now, held, cell = key[:2], [], None
                if key[2] == 0:
                    held.append(part)
                elif held:
                    cell = cell or _Cell(pd.concat(held))
                    yield from cell.best(part, want)

    rows = left.unionByName(right).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind")
    return rows.mapInPandas(run, f"q long, d double, id {ids[6:-1]}, y array<double>")


class _Cell:
    """Entries of one cell by distance to its pivot."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values("dist", kind="stable")
        self.y, self.ids, self.dist = _stack(pdf["v"]), pdf["ids"].to_numpy(), pdf["dist"].to_numpy()

    def best(self, part: pd.DataFrame, want: int) -> Iterator[pd.DataFrame]:
        part = part.sort_values("dist", kind="stable")
        x, dist, bound, q = _stack(part["v"]), part["dist"].to_numpy(), part["bound"].to_numpy(), part["q"].to_numpy()
        step = max(1, min(256, TABLE // len(self.y)))
        for at in range(0, len(x), step):
            some = slice(at, at + step)
            slack = SLACK * (1 + dist[some])
            lo = np.searchsorted(self.dist, (dist[some] - bound[some] - slack).min(), "left")
            hi = np.searchsorted(self.dist, (dist[some] + bound[some] + slack).max(), "right")
            if lo == hi:
                continue
            d = _distances(x[some], self.y[lo:hi])
            limit = np.partition(d, want - 1, axis=1)[:, want - 1] if hi - lo > want else np.full(len(d), np.inf)
            out = []
            for i, row in enumerate(d):
                near = np.flatnonzero(row <= limit[i])
                offers = sorted((row[j], name, j) for j in near for name in self.ids[lo + j])[:want]
                out += [(q[at + i], float(far), name, self.y[lo + j]) for far, name, j in offers]
            yield pd.DataFrame(out, columns=["q", "d", "id", "y"])


def nearest(df: DataFrame, reference: DataFrame, features: Sequence[str], row_id: str, k: int = 8, skip_self: bool = True,
            pivots: int | None = None, limit: int = VISITS) -> DataFrame:
    """(row_id, neighbours): the k closest reference vectors of each row, nearest first (ties: smaller id)."""
    want = k + 1 if skip_self else k
    rows = _vectors(df, features, row_id, "x")
    entries = cut_lineage(_entries(reference, features, row_id, want))
    n = entries.count()
    if not n:
        return rows.limit(0).select(F.col("id").alias(row_id), F.array(F.col("x")).alias("neighbours"))
    index, cells = _cells(entries, pivots or min(PIVOTS, -(-n // CELL)), want)
    queries = cut_lineage(rows.select("x").distinct().withColumn("q", F.monotonically_increasing_id()))
    found = _searched(index, cut_lineage(visits(queries, cells)), want, limit)
    merged = found.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "id", "y"))), 1, want).alias("n"))
    told = rows.join(queries.join(merged, "q").select("x", "n"), "x")
    others = F.filter("n", lambda e: e["id"] != F.col("id")) if skip_self else F.col("n")
    return told.select(F.col("id").alias(row_id), F.transform(F.slice(others, 1, k), lambda e: e["y"]).alias("neighbours"))


def neighbour_features(df: DataFrame, train: DataFrame, features: Sequence[str], row_id: str, k: int = 8) -> DataFrame:
    """Mean and population deviation of each feature over the k nearest training rows."""
    near = nearest(df, train, features, row_id, k)
    out = df.join(near, row_id, "left")
    cols = {}
    def component(i: int):
        return F.transform("neighbours", lambda v: v[i])

    for i, c in enumerate(features):
        values = component(i)
        n = F.size(values)
        mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
        spread = F.aggregate(F.transform(values, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / n
        cols[f"{c}_knn_mean"] = mean
        cols[f"{c}_knn_std"] = F.sqrt(spread)
    return out.withColumns(cols).drop("neighbours")


def smote(df: DataFrame, features: Sequence[str], label: str, row_id: str, target_ratio: float = 0.10, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic minority rows (label 1) up to exactly ``target_ratio`` of the majority, between a row and one of its neighbours.

    Every minority row is used equally often, the rest goes to the first rows by a seeded hash.  Neighbour and position come
    from a hash of the row id and copy number, so reruns agree.
    """
    from stopwise.operators.splits import with_rank

    small = df.filter(F.col(label) == 1)
    n_small, n_large = small.count(), df.filter(F.col(label) == 0).count()
    wanted = int(n_large * target_ratio) - n_small
    base = df.select(row_id, label, *features).withColumn("synthetic", F.lit(False))
    if wanted <= 0 or n_small < 2:
        return base
    near = small.join(nearest(small, small, features, row_id, min(k, n_small - 1)), row_id)
    usable = cut_lineage(near.filter(F.size("neighbours") > 0).select(row_id, label, *features, "neighbours"))
    n_usable = usable.count()
    if not n_usable:
        return base
    ranked = with_rank(usable.withColumn("_h", F.xxhash64(row_id, F.lit(seed))), "_h", row_id, "_r")
    copies = F.lit(wanted // n_usable) + (F.col("_r") < wanted % n_usable).cast("int")
    grown = ranked.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int"))).otherwise(F.array().cast("array<int>"))))
    pick = F.pmod(F.xxhash64(row_id, "copy", F.lit(seed)), F.size("neighbours")).cast("int")
    at = F.pmod(F.xxhash64(row_id, "copy", F.lit(seed + 1)), F.lit(1_000_003)) / 1_000_003.0
    made = grown.withColumns({"_v": F.get("neighbours", pick), "_u": at}).select(
        row_id, label, *[(F.col(c) + F.col("_u") * (F.col("_v")[i] - F.col(c))).alias(c) for i, c in enumerate(features)], F.lit(True).alias("synthetic"))
    return base.unionByName(made)
