"""The nearest of one block, and of what several blocks gave; ``space`` says which blocks meet."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def least(distance: np.ndarray, values: np.ndarray, k: int) -> list[np.ndarray]:
    """For each line of ``distance`` the places of its ``k`` smallest finite ones, of equal ones those of the smaller values."""
    out = []
    edges = np.partition(distance, k - 1, axis=1)[:, k - 1] if distance.shape[1] > k else np.full(len(distance), np.inf)
    for line, edge in zip(distance, edges, strict=True):
        at = np.flatnonzero((line <= edge) & np.isfinite(line))
        out.append(at[np.lexsort((values[at], line[at]))[:k]])
    return out


def nearest_of(near: str, k: int) -> Column:
    """The first ``k`` of an array of (d, value, n) structs, n copies each, by distance and then value, as (value, n)."""
    start = F.struct(F.lit(k).cast("long").alias("left"), F.array().cast("array<struct<value:double,n:bigint>>").alias("taken"))
    step = lambda s, x: F.struct(
        (s["left"] - F.least(s["left"], x["n"])).alias("left"),
        F.when(s["left"] > 0, F.concat(s["taken"], F.array(F.struct(x["value"].alias("value"), F.least(s["left"], x["n"]).alias("n"))))).otherwise(s["taken"]).alias("taken"),
    )
    return F.aggregate(F.array_sort(F.col(near)), start, step)["taken"]
