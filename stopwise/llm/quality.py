"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader.

Words and runs of punctuation are the tokens; single tokens, pairs and repeats of a close token are hashed to
``2^BITS`` places.  A text is the vector
of its damped counts, scaled to length one.  A bounded sample of the labelled rows (``linear.SAMPLE_ROWS``) is dealt to
``SHARDS`` groups; each group runs the per-coordinate updates over its rows and the weights are averaged.  Scores are sparse
dot products with the one vector of weights, ``2^BITS`` floats whatever the input.

An empty or null text has the constant only.  Without labels every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopwise.llm import bytehash as bh
from stopwise.llm.linear import SAMPLE_ROWS, fold_of, labelled, logistic, tokens
from stopwise.llm.store import map_rows, raw_text

BITS = 18
SHARDS = 4
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: Hashes that stand for "the token from one, two, three, four places before", whatever the token.
AGAIN = bh.mix(np.arange(1, 5, dtype=np.uint64))


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values; place 0 is the constant."""
    t = tokens(raw, fold=True)
    again = [np.full(np.count_nonzero(t[d:] == t[:-d]), AGAIN[d - 1]) for d in range(1, len(AGAIN) + 1)]
    places = np.concatenate([t, bh.grams(t, 2), *again]) >> np.uint64(64 - BITS)
    at, n = np.unique(places.astype(np.int64), return_counts=True)
    value = np.log1p(n)
    value /= max(float(np.sqrt((value ** 2).sum())), 1e-12)
    other = at > 0
    return np.concatenate([[0], at[other]]), np.concatenate([[1.0], value[other]])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights after ``EPOCHS`` passes of FTRL-proximal updates."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            g = (logistic(w @ x) - y[i]) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(slice(None))


def fit(docs: DataFrame, labels: DataFrame, target: str, use, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """The averaged weights."""
    sample = labelled(docs, labels, target, use, rows)

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "raw"])
        w = ftrl([features(x) for x in group["raw"]], group["y"].to_numpy(float))
        at = np.flatnonzero(w)
        return pd.DataFrame({"n": [len(group)], "at": [at.astype("<i4").tobytes()], "w": [w[at].astype("<f4").tobytes()]})

    shards = sample.withColumn("shard", F.pmod(F.hash("doc_id"), F.lit(SHARDS))).groupBy("shard") \
        .applyInPandas(train, "n long, at binary, w binary").collect()
    total, count = np.zeros(1 << BITS), sum(r["n"] for r in shards)
    for r in sorted(shards, key=lambda r: bytes(r["at"])):
        total[np.frombuffer(r["at"], "<i4")] += np.frombuffer(r["w"], "<f4") * (r["n"] / count)
    return total.astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        w = shared.value.astype(float)

        def step(r):
            at, x = features(r["raw"])
            return [(r["doc_id"], float(logistic(w[at] @ x)))]

        return step

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    return map_rows(docs.select("doc_id", raw_text().alias("raw")), make, schema)


def quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted``; labels of held-out ids (crc32 modulo 3 is 1) are never read."""
    weights = fit(docs, labels, "quality", fold_of("doc_id", 3) != 1, rows)
    return score(docs, weights).select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score",
                                       F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
