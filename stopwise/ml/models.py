"""Models on MLlib: fitting, chains, search, rolling simulation, importance, selection and batch scoring.

The driver only loops over small plans (folds, grid points, targets); every fit and every score is a Spark job.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopwise.metrics.classification import binary_metrics, multilabel_metrics, ranking_metrics, tune_threshold
from stopwise.operators.splits import add_class_weight, span_rows


#: Training rows that one task holds.
FIT_ROWS = 250_000


def estimator(kind: str, features: Sequence[str], label: str, weight: str | None = None, seed: int = 42, **params):
    """Assembler, scaler where the model needs one, and classifier."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep")]
    vec = "_raw"
    common = {"labelCol": label, "featuresCol": vec, "seed": seed}
    if weight and kind in ("forest", "boosted"):
        common["weightCol"] = weight
    if kind == "forest":
        model = RandomForestClassifier(**{"numTrees": 20, "maxDepth": 6, **common, **params})
    elif kind == "boosted":
        model = GBTClassifier(**{"maxIter": 10, "maxDepth": 4, **common, **params})
    elif kind == "perceptron":
        stages.append(StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True))
        common["featuresCol"] = "_scaled"
        model = MultilayerPerceptronClassifier(**{"layers": [len(features), 16, 2], "maxIter": 50, **common, **params})
    else:
        raise ValueError(f"unknown model {kind}")
    return Pipeline(stages=[*stages, model])


def spread(rows: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """The rows in parts of at most about ``limit``, as they are when one part would hold them all."""
    n = rows.count()
    return rows if n <= limit else rows.repartition(max(-(-n // limit), rows.sparkSession.sparkContext.defaultParallelism))


def fit(train: DataFrame, features: Sequence[str], label: str, kind: str = "forest", balanced: bool = True, **params) -> PipelineModel:
    """A fit keeps its rows in memory, wider than they are stored, and reads them in every round; so they are spread over tasks first."""
    rows = spread(train.select(*dict.fromkeys([*features, label])).withColumn(label, F.col(label).cast("double")))
    weight = None
    if balanced and kind in ("forest", "boosted"):
        rows, weight = add_class_weight(rows, label), "class_weight"
    return estimator(kind, features, label, weight, **params).fit(rows)


def score(model: PipelineModel, df: DataFrame, threshold: float = 0.5, out: str = "score") -> DataFrame:
    """Probability of class 1 and the thresholded prediction, next to the input columns."""
    scored = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return scored.withColumn("y_pred", (F.col(out) >= threshold).cast("int")).select(*df.columns, out, "y_pred")


def fit_predict(train: DataFrame, val: DataFrame, test: DataFrame, features: Sequence[str], label: str, kind: str = "forest", **params) -> DataFrame:
    """Fit on train, tune the threshold on val, score test."""
    model = fit(train, features, label, kind, **params)
    threshold = tune_threshold(score(model, val), label, "score").first()["threshold"]
    return score(model, test, threshold)


def simulate(df: DataFrame, features: Sequence[str], label: str, windows: Sequence[int] | None = None, kinds: Sequence[str] = ("forest", "boosted"),
             spans: DataFrame | None = None, **params) -> DataFrame:
    """Train, tune and test every model on each rolling window, or on those named.

    ``spans`` are the windows as intervals of days (``splits.window_spans``) over rows with ``day_rank``; without them the rows are the
    long form of ``splits.rolling_windows``.
    """
    table = None
    if spans is not None:
        table = {(r["window_id"], r["part"]): r for r in spans.collect()}  # a few rows per day
        windows = windows if windows is not None else sorted({w for w, _ in table})
    elif windows is None:
        windows = [r[0] for r in df.select("window_id").distinct().orderBy("window_id").collect()]
    out = None
    for w in windows:
        if table is not None:
            train, val, test = (span_rows(df, table[(w, p)]) for p in ("train", "val", "test"))
        else:
            part = df.filter(F.col("window_id") == w)
            train, val, test = (part.filter(F.col("part") == p) for p in ("train", "val", "test"))
        for kind in kinds:
            model = fit(train, features, label, kind, **params)
            best = tune_threshold(score(model, val), label, "score").first()
            row = binary_metrics(score(model, test, best["threshold"]), label, "y_pred").select(
                F.lit(w).alias("window_id"), F.lit(kind).alias("model"), F.lit(best["threshold"]).alias("threshold"),
                F.lit(best["f1"]).alias("val_f1"), "accuracy", "precision", "recall", "f1")
            out = row if out is None else out.unionByName(row)
    return out


def best_by_val(results: DataFrame) -> DataFrame:
    """Model with the highest mean validation F1."""
    return results.groupBy("model").agg(F.avg("val_f1").alias("mean_val_f1"), F.avg("f1").alias("mean_test_f1")).orderBy(F.desc("mean_val_f1"), "model").limit(1)


def multi_output(train: DataFrame, test: DataFrame, features: Sequence[str], labels: Sequence[str], chain: bool = False, kind: str = "forest", **params) -> DataFrame:
    """One model per label; in a chain each later model also sees the earlier labels.

    A chain trains on the true earlier labels and scores on the predicted ones.
    """
    out, seen = test, []
    for label in labels:
        inputs = [*features, *seen] if chain else list(features)
        model = fit(train, inputs, label, kind, **params)
        frame = out
        for s in seen if chain else []:
            frame = frame.withColumn(f"_true_{s}", F.col(s)).withColumn(s, F.col(f"pred_{s}"))
        scored = score(model, frame).withColumnRenamed("y_pred", f"pred_{label}").drop("score")
        for s in seen if chain else []:
            scored = scored.withColumn(s, F.col(f"_true_{s}")).drop(f"_true_{s}")
        out = scored
        seen.append(label)
    return out


def compare_chain(train: DataFrame, test: DataFrame, features: Sequence[str], labels: Sequence[str], **params) -> DataFrame:
    """Multi-label metrics of independent models and of the chain."""
    out = None
    for name, chain in (("independent", False), ("chain", True)):
        scored = multi_output(train, test, features, labels, chain, **params)
        row = multilabel_metrics(scored, [(y, f"pred_{y}") for y in labels]).withColumn("approach", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def search(train: DataFrame, val: DataFrame, features: Sequence[str], label: str, kind: str, grid: dict[str, Sequence],
           metric: Callable[[DataFrame], float] | None = None) -> DataFrame:
    """Every grid point fitted on train and measured on val (ROC-AUC unless another callable is given)."""
    def auc(scored: DataFrame) -> float:
        return ranking_metrics(scored, label, "score").first()["roc_auc"] or 0.0
    measure = metric or auc
    rows = []
    for values in product(*grid.values()):
        params = dict(zip(grid, values))
        rows.append((str(params), float(measure(score(fit(train, features, label, kind, **params), val)))))
    return train.sparkSession.createDataFrame(rows, "params string, value double").orderBy(F.desc("value"), "params")


# The published search spaces, under the names of the parameters here: (low, high, step), (low, high, "log") or choices.
SPACES = {
    "forest": {"numTrees": (50, 300, 50), "maxDepth": (3, 15, 1), "minInstancesPerNode": (1, 10, 1), "featureSubsetStrategy": ["sqrt", "log2", "all"]},
    "boosted": {"maxIter": (50, 300, 50), "maxDepth": (3, 10, 1), "stepSize": (0.01, 0.3, "log"), "minInstancesPerNode": (1, 10, 1)},
    "perceptron": {"stepSize": (1e-4, 1e-2, "log"), "blockSize": [32, 64, 128, 256]},
}


def sample_space(space: dict, trials: int, seed: int = 42) -> list[dict]:
    """Different random points of a space, the same for the same seed; fewer when the space is smaller."""
    rng, out = random.Random(seed), []
    for _ in range(20 * trials):
        point = {}
        for name, values in space.items():
            if isinstance(values, list):
                point[name] = rng.choice(values)
            elif values[2] == "log":
                point[name] = math.exp(rng.uniform(math.log(values[0]), math.log(values[1])))
            else:
                point[name] = rng.randrange(values[0], values[1] + 1, values[2])
        if point not in out:
            out.append(point)
        if len(out) == trials:
            break
    return out


def halving(train: DataFrame, val: DataFrame, features: Sequence[str], label: str, kind: str, points: Sequence[dict], row_id: str,
            eta: int = 3, first_share: float = 1 / 9, workers: int = 4, seed: int = 42) -> DataFrame:
    """Successive halving: all points are fitted on a small share of the rows, the best of ``eta`` go on to ``eta`` times the rows, until one
    rung has them all.  A row is in a rung by its hash, so rungs grow by adding rows; the fits of a rung run side by side.

    One row per fit: rung, share, parameters, ROC-AUC on ``val`` and whether the point went on (in the last rung: won).
    """
    shares = [1.0]
    while shares[0] > first_share * (1 + 1e-9):
        shares.insert(0, max(first_share, shares[0] / eta))
    alive, rows = list(points), []
    place = F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(1_000_000))
    for rung, share in enumerate(shares):
        part = train if share == 1.0 else train.filter(place < int(share * 1_000_000))

        def value(point: dict) -> float:
            return ranking_metrics(score(fit(part, features, label, kind, **point), val), label, "score").first()["roc_auc"] or 0.0

        with ThreadPoolExecutor(workers) as pool:
            found = sorted(zip(pool.map(value, alive), map(str, alive), alive), key=lambda r: (-r[0], r[1]))
        keep = 1 if share == 1.0 else max(1, -(-len(found) // eta))
        rows += [(rung, share, name, float(v), i < keep) for i, (v, name, _) in enumerate(found)]
        alive = [point for _, _, point in found[:keep]]
    return train.sparkSession.createDataFrame(rows, "rung int, share double, params string, value double, kept boolean")


def compare(train: DataFrame, val: DataFrame, test: DataFrame, features: Sequence[str], label: str,
            kinds: dict[str, dict] = {"forest": {}, "boosted": {}, "perceptron": {}}) -> DataFrame:
    """Every kind of model fitted on train, its threshold tuned on val: F1 on val and test, and which is best by val."""
    out = None
    for kind, params in kinds.items():
        model = fit(train, features, label, kind, **params)
        tuned = tune_threshold(score(model, val), label, "score").first()
        row = binary_metrics(score(model, test, tuned["threshold"]), label, "y_pred").select(
            F.lit(kind).alias("model"), F.lit(tuned["threshold"]).alias("threshold"), F.lit(tuned["f1"]).alias("val_f1"), "f1")
        out = row if out is None else out.unionByName(row)
    top = F.max(F.struct("val_f1", "model")).over(Window.partitionBy())  # one row per kind
    return out.withColumn("best", top["model"] == F.col("model"))


def tree_importance(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, (float(x) for x in model.stages[-1].featureImportances.toArray())), key=lambda p: (-p[1], p[0]))


def eliminate(train: DataFrame, val: DataFrame, features: Sequence[str], label: str, keep: int = 3, drop_share: float = 0.3, **params) -> DataFrame:
    """Recursive elimination: drop the least important share, keep the validation AUC of each round."""
    current, rows = list(features), []
    while True:
        model = fit(train, current, label, "forest", **params)
        auc = ranking_metrics(score(model, val), label, "score").first()["roc_auc"] or 0.0
        rows.append((len(current), ",".join(current), float(auc)))
        if len(current) <= keep:
            break
        ranked = [f for f, _ in tree_importance(model, current)]
        size = max(keep, min(len(current) - 1, int(len(current) * (1 - drop_share))))
        current = [f for f in current if f in ranked[:size]]
    return train.sparkSession.createDataFrame(rows, "n_features int, features string, auc double")


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], label: str, row_id: str, seed: int = 42) -> DataFrame:
    """Loss of AUC when one feature is shuffled.  The shuffle pairs the rows of two hash orders by exact position, so
    every value is used once."""
    from stopwise.operators.splits import with_rank

    base = ranking_metrics(score(model, df), label, "score").first()["roc_auc"] or 0.0
    rows = []
    for f in features:
        a = with_rank(df.withColumn("_h", F.xxhash64(row_id, F.lit(seed))), "_h", row_id, "_r")
        b = with_rank(df.select(row_id, F.col(f).alias("_shuffled")).withColumn("_h", F.xxhash64(row_id, F.lit(seed + 1))), "_h", row_id, "_r")
        mixed = a.join(b.select("_r", "_shuffled"), "_r").withColumn(f, F.col("_shuffled")).drop("_shuffled", "_r", "_h")
        rows.append((f, float(base - (ranking_metrics(score(model, mixed), label, "score").first()["roc_auc"] or 0.0))))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def save(model: PipelineModel, features: Sequence[str], path: str) -> None:
    """Model and its feature names."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(i, f) for i, f in enumerate(features)], "position int, feature string").write.mode("overwrite").parquet(f"{path}/features")


def load(path: str, spark) -> tuple[PipelineModel, list[str]]:
    names = [r["feature"] for r in spark.read.parquet(f"{path}/features").orderBy("position").collect()]
    return PipelineModel.load(f"{path}/model"), names
