"""Versioned models on the shared file system, and batch scoring with them.

A version is a folder with the fitted pipeline and its feature names; its row in the ``versions`` table is written last, so a
version is either complete or not there.  Numbers are given by one writer per name.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.ml.models import load, save, score

VERSIONS = "name string, version bigint, label string, threshold double, metrics string"


class Registry:
    """Models under ``root``, by name and version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self, name: str | None = None) -> DataFrame:
        try:
            found = self.spark.read.schema(VERSIONS).parquet(f"{self.root}/versions")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = self.spark.createDataFrame([], VERSIONS)
        return found if name is None else found.filter(F.col("name") == name)

    def latest(self, name: str) -> int:
        """Newest version, 0 without any."""
        return self.versions(name).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def register(self, name: str, model: PipelineModel, features: list[str], label: str, threshold: float = 0.5, **metrics: float) -> int:
        version = self.latest(name) + 1
        save(model, features, f"{self.root}/models/{name}/v{version}")
        row = [(name, version, label, float(threshold), json.dumps(metrics, sort_keys=True))]
        self.spark.createDataFrame(row, VERSIONS).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/versions/of={name}-{version}")
        return version

    def load(self, name: str, version: int | None = None) -> tuple[PipelineModel, list[str], float]:
        """Model, feature names and threshold of a version, the newest one by default."""
        version = version or self.latest(name)
        entry = self.versions(name).filter(F.col("version") == version).first()
        if entry is None:
            raise KeyError(f"{name} v{version}")
        return *load(f"{self.root}/models/{name}/v{version}", self.spark), entry["threshold"]

    def best(self, name: str, metric: str) -> int:
        """Version with the highest value of a metric (ties: newest)."""
        value = F.get_json_object("metrics", f"$.{metric}").cast("double")
        return self.versions(name).filter(value.isNotNull()).orderBy(F.desc(value), F.desc("version")).select("version").first()[0]

    def score(self, df: DataFrame, name: str, version: int | None = None) -> DataFrame:
        """Rows with ``score``, ``y_pred`` and the version that made them."""
        version = version or self.latest(name)
        model, features, threshold = self.load(name, version)
        missing = [f for f in features if f not in df.columns]
        if missing:
            raise ValueError(f"missing features: {', '.join(missing)}")
        return score(model, df, threshold).withColumn("model_version", F.lit(version))
