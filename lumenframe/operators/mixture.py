"""Gaussian mixtures with full, tied, diagonal or spherical covariance: EM whose sums Spark takes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clustering as K

FORMS = ("full", "tied", "diag", "spherical")


def log_densities(x: np.ndarray, means: np.ndarray, covariance: np.ndarray, form: str) -> np.ndarray:
    """rows x components: logarithms of the densities."""
    d, out = x.shape[1], np.empty((len(x), len(means)))
    for k, mean in enumerate(means):
        gap = x - mean
        if form in ("full", "tied"):
            lower = np.linalg.cholesky(covariance[k] if form == "full" else covariance)
            squared, log_root = (np.linalg.solve(lower, gap.T) ** 2).sum(0), np.log(np.diag(lower)).sum()
        else:
            var = covariance[k] if form == "diag" else np.full(d, covariance[k])
            squared, log_root = (gap * gap / var).sum(1), 0.5 * np.log(var).sum()
        out[:, k] = -0.5 * (d * math.log(2 * math.pi) + squared) - log_root
    return out


def shares(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covariance: np.ndarray, form: str) -> tuple[np.ndarray, np.ndarray]:
    """rows x components: to what part a row belongs to each; and each row's log-likelihood."""
    joint = log_densities(x, means, covariance, form) + np.log(weights)
    top = joint.max(axis=1, keepdims=True)
    likely = top[:, 0] + np.log(np.exp(joint - top).sum(axis=1))
    return np.exp(joint - likely[:, None]), likely


def _sums(x: np.ndarray, r: np.ndarray, likely: np.ndarray, form: str) -> np.ndarray:
    """What the next parameters need of these rows: part sums, of rows, of their squares or products; rows and log-likelihood."""
    if form == "full":
        second = np.einsum("nk,ni,nj->kij", r, x, x, optimize=True)
    elif form == "tied":
        second = x.T @ x
    else:
        second = r.T @ (x * x)
    return np.concatenate([r.sum(0), (r.T @ x).ravel(), second.ravel(), [len(x), likely.sum()]])


def next_parameters(sums: np.ndarray, k: int, d: int, form: str, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    held = sums[:k] + 10 * np.finfo(float).eps
    means = sums[k : k + k * d].reshape(k, d) / held[:, None]
    second, n = sums[k + k * d : -2], sums[-2]
    if form == "full":
        covariance = second.reshape(k, d, d) / held[:, None, None] - means[:, :, None] * means[:, None, :] + floor * np.eye(d)
    elif form == "tied":
        covariance = (second.reshape(d, d) - (held[:, None] * means).T @ means) / held.sum() + floor * np.eye(d)
    else:
        covariance = second.reshape(k, d) / held[:, None] - means**2 + floor
        covariance = covariance if form == "diag" else covariance.mean(axis=1)
    return held / n, means, covariance


@dataclass
class MixtureModel:
    weights: np.ndarray
    means: np.ndarray
    covariance: np.ndarray
    form: str
    log_likelihood: float  # a row, on average
    rounds: int

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability`` and ``prediction`` (the likeliest component)."""
        given = (self.weights, self.means, self.covariance, self.form)

        def run(x: pd.Series) -> pd.Series:
            return pd.Series(list(shares(np.stack(x.to_numpy()), *given)[0]) if len(x) else [], dtype=object)

        told = df.withColumn("__p", F.pandas_udf(run, "array<double>")(vector_to_array("features")))
        best = (F.array_position("__p", F.array_max("__p")) - 1).cast("int")
        return told.withColumn("probability", array_to_vector("__p")).withColumn("prediction", best).drop("__p")


@dataclass
class Mixture:
    """EM from the parts of one k-means run until the mean log-likelihood of a row gains less than ``tol``.

    A round is one pass: each task sums over its rows, batch by batch, and the sums are added in Spark; the driver holds one set
    of sums, k x d x d numbers at most. ``floor`` is added to variances, so copies and constants don't break a component.
    """

    k: int = 3
    form: str = "full"
    rounds: int = 100
    tol: float = 1e-3
    floor: float = 1e-6
    seed: int = 42

    def fit(self, m: DataFrame) -> MixtureModel:
        if self.form not in FORMS:
            raise ValueError(f"covariance_type: {', '.join(FORMS)}")
        form, floor = self.form, self.floor
        started = K.kmeans(m, self.k, seeds=1, seed=self.seed)
        k, d = len(started.clusterCenters()), len(started.clusterCenters()[0])
        rows = started.transform(m).select(vector_to_array("features").alias("x"), "prediction").persist()
        try:
            sums = _summed(rows, lambda x, own: (np.eye(k)[own], np.zeros(len(x))), form)
            known, least = next_parameters(sums, k, d, form, floor), -math.inf
            for round_ in range(1, self.rounds + 1):  # noqa: B007
                sums = _summed(rows, lambda x, _, known=known: shares(x, *known, form), form)
                mean = sums[-1] / sums[-2]
                known, gain, least = next_parameters(sums, k, d, form, floor), mean - least, mean
                if gain < self.tol:
                    break
            return MixtureModel(*known, form, least, round_)
        finally:
            rows.unpersist()


def _summed(rows: DataFrame, belong, form: str) -> np.ndarray:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            if len(f):
                x = np.stack(f["x"].to_numpy())
                own = _sums(x, *belong(x, f["prediction"].to_numpy()), form)
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"s": [total.tolist()]})

    told = rows.mapInPandas(run, "s array<double>").select(array_to_vector("s").alias("s"))
    return told.agg(Summarizer.sum(F.col("s"))).first()[0].toArray()
