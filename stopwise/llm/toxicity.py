"""Toxicity by maximum-scoring segments.

* Every token gets the log-odds of appearing in toxic rather than clean text, shrunk by a Dirichlet prior of ``PRIOR`` counts
  that is shared out between the classes by their size, less ``DRIFT``, so that ordinary text has a falling sum.
* One scan over the tokens of a text finds all maximal segments, those whose sum cannot be raised by making them longer or
  shorter (each is a passage of its own).
* Sums of best segments of clean text follow an extreme-value law: with ``lambda`` from E[exp(lambda x)] = 1 over clean
  tokens and ``K`` from the best segments of clean texts, a segment's normalised sum is ``lambda S - ln(K n)`` for a text of n
  tokens.  Segments above ``SIGNIFICANT`` count; the best one and the sum of all are turned into a probability by a logistic
  fit on rows whose tokens were not counted.

Token scores are hashed to ``2^BITS`` places, so the model has the same size whatever the input.  It is fitted on a bounded
sample of labelled rows (``linear.SAMPLE_ROWS``).  Empty and null texts have no segment and get the score of clean text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopwise.llm import bytehash as bh
from stopwise.llm.linear import SAMPLE_ROWS, fit_logistic, fold_of, labelled, logistic
from stopwise.llm.store import keep, map_rows, raw_text

BITS = 18
PRIOR = 10.0
DRIFT = 0.5
SIGNIFICANT = 1.0
NOTHING = -5.0


@dataclass
class Model:
    scores: np.ndarray
    lam: float
    log_k: float
    weights: np.ndarray

    def segments(self, raw: bytes) -> tuple[int, list[tuple[int, int, float]], np.ndarray, np.ndarray]:
        """Number of tokens, maximal segments as (first token, last token + 1, normalised sum), and token offsets."""
        h, start, end = bh.words(raw, bh.NON_WORD)
        x = self.scores[(h >> np.uint64(64 - BITS)).astype(np.int64)]
        shift = self.log_k + math.log(max(len(x), 1))
        return len(x), [(a, b, self.lam * s - shift) for a, b, s in maximal_segments(x)], start, end

    def evidence(self, segments: list[tuple[int, int, float]]) -> tuple[float, float]:
        """Best normalised sum, and the damped total of the significant ones."""
        best = max((s for _, _, s in segments), default=NOTHING)
        return max(best, NOTHING), math.log1p(sum(s for _, _, s in segments if s > SIGNIFICANT))

    def probability(self, segments: list[tuple[int, int, float]]) -> float:
        return float(logistic(np.dot([*self.evidence(segments), 1.0], self.weights)))


def maximal_segments(x: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments in linear time.

    Candidates are kept in a list.  A new positive token looks back for the last candidate that began at a smaller running
    sum; if that one ended lower than the new end, both and everything between become one candidate, which looks back anew.
    Runs of tokens between positive ones only move the running sum and are skipped.
    """
    total = np.concatenate([[0.0], np.cumsum(x)])
    kept: list[list[float]] = []  # first, last + 1, sum before, sum behind, link to the candidate that began lower
    for i in np.flatnonzero(x > 0).tolist():
        item = [i, i + 1, float(total[i]), float(total[i + 1])]
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= item[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= item[3]:
                kept.append([*item, j])
                break
            item = [kept[j][0], item[1], kept[j][2], item[3]]
            del kept[j:]
            j -= 1
    return [(int(k[0]), int(k[1]), k[3] - k[2]) for k in kept]


def root_lambda(x: np.ndarray, share: np.ndarray) -> float:
    """Positive root of E[exp(lambda x)] = 1 for scores with the given shares."""
    mean = lambda lam: float((share * np.exp(np.minimum(lam * x, 50))).sum()) - 1
    if x.max(initial=-1.0) <= 0 or (share * x).sum() >= 0:
        return 1.0
    lo, hi = 1e-6, 1.0
    while mean(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def _counts(sample: DataFrame) -> np.ndarray:
    """Clean and toxic sample rows with a token, by its place: at most 2^BITS rows come to the driver.

    A row counts once, so a rare word repeated in one text carries no more weight than elsewhere.
    """
    def make():
        def step(r):
            at = np.unique(bh.words(r["raw"], bh.NON_WORD)[0] >> np.uint64(64 - BITS))
            return [(a, 1 - r["y"], r["y"]) for a in at.astype(np.int64).tolist()]

        return step

    rows = map_rows(sample.select("raw", "y"), make, "at int, clean long, toxic long", 20_000) \
        .groupBy("at").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    out = np.zeros((2, 1 << BITS))
    at = rows["at"].to_numpy()
    out[0][at], out[1][at] = rows["clean"].to_numpy(), rows["toxic"].to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, use: Column, rows: int = SAMPLE_ROWS) -> Model:
    """Token scores from three quarters of the sample, calibration from the rest."""
    sample = keep(labelled(docs, labels, "toxic", use, rows).select("raw", "y", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)).alias("part")))
    counts = _counts(sample.filter("part > 0"))
    size = counts.sum(1)
    if not size.all():  # only one class, or no labels: no evidence either way
        return Model(np.full(1 << BITS, -DRIFT), 1.0, 0.0, np.zeros(3))
    part = size / size.sum()
    odds = np.log((counts[1] + PRIOR * part[1]) / (counts[0] + PRIOR * part[0])) - math.log(part[1] / part[0])
    scores = odds - DRIFT
    model = Model(scores, root_lambda(scores, counts[0] / size[0]), 0.0, np.zeros(3))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        raw_model = shared.value

        def step(r):
            n, segments, _, _ = raw_model.segments(r["raw"])
            return [(r["y"], n, [s for _, _, s in segments])]

        return step

    seen = map_rows(sample.filter("part = 0").select("raw", "y"), make, "y int, n long, sums array<double>").collect()
    best = [max(r["sums"]) for r in seen if r["y"] == 0 and r["sums"]]
    # The mean of the extreme-value law is Euler's constant above its mode.
    model.log_k = float(np.mean(best)) - 0.5772156649015329 if best else 0.0
    x = np.array([model.evidence([(0, 0, s - model.log_k) for s in r["sums"]]) for r in seen]).reshape(-1, 2)
    model.weights = fit_logistic(x, np.array([float(r["y"]) for r in seen])) if seen else np.zeros(3)
    return model


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` and the significant passages (byte offsets, normalised sum) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def step(r):
            _, segments, start, end = model.segments(r["raw"])
            found = [{"start": int(start[a]), "end": int(end[b - 1]), "strength": s} for a, b, s in segments if s > SIGNIFICANT]
            return [(r["doc_id"], model.probability(segments), found)]

        return step

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)] + T.StructType.fromDDL(
        "score double, passages array<struct<start:long,end:long,strength:double>>").fields)
    return map_rows(docs.select("doc_id", raw_text().alias("raw")), make, schema)


def without_toxic(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows whose score stays below ``least``, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            clean = [shared.value.probability(shared.value.segments((x.as_py() or "").encode())[1]) < least for x in column]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_passages``; labels of held-out ids (crc32 modulo 5 is 0) are never read."""
    model = fit(docs, labels, fold_of("doc_id", 5) != 0, rows)
    return passages(docs, model).select(
        "doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"))
