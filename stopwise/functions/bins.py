"""Right-closed binning of a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut(value: Column, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False) -> Column:
    """Label of the interval ``(edges[i], edges[i+1]]`` that holds the value; null outside all of them."""
    if len(edges) != len(labels) + 1:
        raise ValueError("one more edge than labels is needed")
    low = F.lit(float(edges[0]))
    inside = value >= low if include_lowest else value > low
    if edges[0] == float("-inf"):
        inside = value.isNotNull()
    out = F.lit(None).cast("string")
    for edge, label in zip(reversed(edges[1:]), reversed(list(labels))):
        hit = value.isNotNull() if edge == float("inf") else value <= F.lit(float(edge))
        out = F.when(hit, F.lit(label)).otherwise(out)
    return F.when(inside, out)


def flag(cond: Column) -> Column:
    """0/1 with unknown as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")
