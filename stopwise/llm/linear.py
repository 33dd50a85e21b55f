"""Labelled samples and hashed token counts for the two text classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.llm import bytehash as bh
from stopwise.llm.store import keep, raw_text

#: Bound of the labelled sample that a classifier is fitted on.
SAMPLE_ROWS = 20_000
_KIND = np.where(bh.NON_WORD, 2, 1).astype(np.int8)
_KIND[65:91] = 1
_KIND[bh.SPACES] = 0
_KIND[0] = 0


def fold_of(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as an empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds


def labelled(docs: DataFrame, labels: DataFrame, target: str, use: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids (smallest hash first), with ``raw`` and ``y``; the ids are few enough to broadcast."""
    known = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & use) \
        .groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("y"))
    chosen = keep(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return docs.select("doc_id", raw_text().alias("raw")).join(F.broadcast(chosen), "doc_id")


def tokens(raw: bytes, fold: bool) -> np.ndarray:
    """Hashes of the words and of the runs of punctuation of a text, in order."""
    out, at = [], 0
    while at < len(raw):
        b = np.frombuffer(raw, np.uint8, min(bh.PIECE, len(raw) - at), at)
        if at + len(b) < len(raw):  # cut behind a space if there is any
            cut = np.flatnonzero(_KIND[b] == 0)
            b = b[:int(cut[-1]) + 1] if len(cut) else b
        at += len(b)
        kind = np.zeros(len(b) + 2, np.int8)
        kind[1:-1] = _KIND[b]
        edge = np.flatnonzero(np.diff(kind))
        start, end = edge[:-1], edge[1:]
        real = kind[start + 1] > 0
        out.append(bh.spans_hash(bh.prefix(bh.FOLD[b] if fold else b), start[real], end[real]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (the last one is the constant) by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = logistic(x @ w)
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w
