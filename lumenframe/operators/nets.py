"""Nets and kernel machines fitted by rounds of local descent: tasks learn on their own rows, and the average of their parameters starts the next round."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH, PASSES = 64, 4  # rows of a step; passes over each Arrow batch in a round

Gradient = Callable[[list[np.ndarray], np.ndarray, np.ndarray], tuple[float, list[np.ndarray]]]


def _split(flat: np.ndarray, shapes: list[tuple]) -> list[np.ndarray]:
    cuts = np.cumsum([math.prod(s) for s in shapes])[:-1]
    return [part.reshape(s) for part, s in zip(np.split(flat, cuts), shapes, strict=True)]


def averaged(rows: DataFrame, start: list[np.ndarray], gradient: Gradient, rounds: int, rate: float, seed: int) -> list[np.ndarray]:
    """Parameters after at most ``rounds`` rounds over ``rows`` (x, y); it ends early when three rounds bring the loss no further.

    A task streams its rows and holds one Arrow batch, so neither its partition nor the table has to fit in memory.
    Averages weigh tasks by their rows and are summed in Spark; the driver holds one set of parameters.
    """
    shapes = [p.shape for p in start]
    flat = np.concatenate([p.ravel() for p in start])
    best, least, waited = flat, math.inf, 0
    for r in range(rounds):

        def run(frames: Iterator[pd.DataFrame], flat: np.ndarray = flat, r: int = r) -> Iterator[pd.DataFrame]:
            w, m, v = flat.copy(), np.zeros_like(flat), np.zeros_like(flat)
            rng, step, n, lost = np.random.default_rng(seed + r), 0, 0, 0.0
            for f in frames:
                if not len(f):
                    continue
                x, y = np.stack(f["x"].to_numpy()), f["y"].to_numpy()
                for _ in range(PASSES):
                    order = rng.permutation(len(x))
                    for at in range(0, len(x), BATCH):
                        some = order[at : at + BATCH]
                        loss, parts = gradient(_split(w, shapes), x[some], y[some])
                        g, step = np.concatenate([p.ravel() for p in parts]), step + 1
                        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                        lost += loss * len(some)
                n += len(x)
            if n:
                yield pd.DataFrame({"w": [w.tolist()], "n": [float(n)], "lost": [lost / PASSES]})

        told = rows.mapInPandas(run, "w array<double>, n double, lost double").select(array_to_vector("w").alias("w"), "n", "lost")
        one = told.agg(Summarizer.mean(F.col("w"), F.col("n")).alias("w"), (F.sum("lost") / F.sum("n")).alias("loss")).first()
        if one["loss"] is None or not math.isfinite(one["loss"]):
            break
        flat = one["w"].toArray()
        waited = 0 if one["loss"] < least * (1 - 1e-3) else waited + 1
        if one["loss"] < least:
            best, least = flat, one["loss"]
        if waited >= 3:
            break
    return _split(best, shapes)


@dataclass
class FittedNet:
    """Adds ``prediction``: ``told`` of the features by Arrow batch, on the label's scale."""

    parts: list[np.ndarray]
    told: Callable[[list[np.ndarray], np.ndarray], np.ndarray]
    mean: float
    sd: float

    def transform(self, df: DataFrame) -> DataFrame:
        parts, told, mean, sd = self.parts, self.told, self.mean, self.sd

        def run(x: pd.Series) -> pd.Series:
            return pd.Series(told(parts, np.stack(x.to_numpy())) * sd + mean if len(x) else [], dtype="float64")

        return df.withColumn("prediction", F.pandas_udf(run, "double")(vector_to_array("features")))


def _scaled(df: DataFrame) -> tuple[DataFrame, float, float, int, int]:
    """(x, y) with a standardised label, its mean and deviation, the rows and the width."""
    facts = df.agg(F.avg("label").alias("mean"), F.stddev_pop("label").alias("sd"), F.count("*").alias("n"), F.max(F.size(vector_to_array("features"))).alias("width")).first()
    mean, sd = facts["mean"] or 0.0, facts["sd"] or 1.0
    return df.select(vector_to_array("features").alias("x"), ((F.col("label") - mean) / sd).alias("y")), mean, sd, facts["n"], facts["width"] or 1


def net_values(parts: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    for k in range(0, len(parts) - 2, 2):
        x = np.maximum(x @ parts[k] + parts[k + 1], 0)
    return (x @ parts[-2] + parts[-1])[:, 0]


def net_gradient(parts: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Half the mean squared error and its slopes, layer by layer backwards."""
    seen = [x]
    for k in range(0, len(parts) - 2, 2):
        seen.append(np.maximum(seen[-1] @ parts[k] + parts[k + 1], 0))
    gap = (seen[-1] @ parts[-2] + parts[-1])[:, 0] - y
    back, out = gap[:, None] / len(y), []
    for k in range(len(parts) - 2, -1, -2):
        inner = seen[k // 2]
        out = [inner.T @ back, back.sum(axis=0), *out]
        back = (back @ parts[k].T) * (inner > 0)
    return float(gap @ gap / (2 * len(y))), out


@dataclass
class NetRegressor:
    """A net of rectified layers for numbers, squared error, on a standardised label."""

    hidden: tuple[int, ...] = (128, 64)
    rounds: int = 30
    rate: float = 3e-3
    seed: int = 42

    def fit(self, df: DataFrame) -> FittedNet:
        rows, mean, sd, _, width = _scaled(df)
        rng, sizes, start = np.random.default_rng(self.seed), [width, *self.hidden, 1], []
        for a, b in zip(sizes, sizes[1:], strict=False):
            edge = math.sqrt(6 / (a + b))
            start += [rng.uniform(-edge, edge, (a, b)), np.zeros(b)]
        return FittedNet(_learned(rows, start, net_gradient, self), net_values, mean, sd)


@dataclass
class KernelRegressor:
    """A kernel machine for numbers: radial kernel by ``waves`` random Fourier features, loss beyond ``tube`` only, penalty 1 / (2 C n).

    The kernel's width is 1 / (features x their variance). The label is standardised, so ``tube`` is in standard deviations.
    """

    waves: int = 512
    tube: float = 0.1
    c: float = 1.0
    rounds: int = 30
    rate: float = 1e-2
    seed: int = 42

    def fit(self, df: DataFrame) -> FittedNet:
        rows, mean, sd, n, width = _scaled(df)
        raised = _waves(rows, width, self.waves, self.seed)
        told = lambda parts, x: raised(x) @ parts[0] + parts[1][0]
        shrink, tube = 1 / (self.c * max(n, 1)), self.tube

        def gradient(parts: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
            z = raised(x)
            gap = z @ parts[0] + parts[1][0] - y
            slope = np.where(np.abs(gap) > tube, np.sign(gap), 0) / len(y)
            loss = np.maximum(np.abs(gap) - tube, 0).mean() + shrink / 2 * parts[0] @ parts[0]
            return float(loss), [z.T @ slope + shrink * parts[0], np.array([slope.sum()])]

        return FittedNet(_learned(rows, [np.zeros(self.waves), np.zeros(1)], gradient, self), told, mean, sd)


@dataclass
class FittedKernel:
    """Adds ``probability`` (calibrated shares, summing to 1) and ``prediction``, by Arrow batch."""

    parts: list[np.ndarray]
    raised: Callable[[np.ndarray], np.ndarray]
    slope: np.ndarray
    shift: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.raised(x) @ self.parts[0] + self.parts[1]

    def shares(self, x: np.ndarray) -> np.ndarray:
        one = 1 / (1 + np.exp(-np.clip(self.slope * self.margins(x) + self.shift, -40, 40)))
        if one.shape[1] == 1:  # two classes, one margin
            return np.hstack([1 - one, one])
        return one / one.sum(axis=1, keepdims=True)

    def transform(self, df: DataFrame) -> DataFrame:
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(list(self.shares(np.stack(x.to_numpy()))) if len(x) else [], dtype=object)

        told = df.withColumn("__p", F.pandas_udf(run, "array<double>")(vector_to_array("features")))
        best = F.array_position("__p", F.array_max("__p")) - 1
        return told.withColumn("probability", array_to_vector("__p")).withColumn("prediction", best.cast("double")).drop("__p")


def _waves(rows: DataFrame, width: int, waves: int, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    """Random Fourier features of the radial kernel whose width is 1 / (features x their variance)."""
    spread = rows.select(F.explode("x").alias("v")).agg(F.var_pop("v")).first()[0] or 1.0
    rng = np.random.default_rng(seed)
    tilt, phase = rng.normal(0, math.sqrt(2 / (width * spread)), (width, waves)), rng.uniform(0, 2 * math.pi, waves)
    return lambda x: math.sqrt(2 / waves) * np.cos(x @ tilt + phase)


@dataclass
class KernelClassifier:
    """A kernel machine for classes: radial kernel by ``waves`` random Fourier features, hinge loss, penalty 1 / (2 C n), one class against the rest.

    A tenth of the rows, by a hash of their features, is held out of the fit; a sigmoid of their margins gives the probabilities, fitted with Platt's targets by
    Newton steps whose sums Spark takes. With two classes there is one margin. ``weight`` names a column of row weights.
    """

    classes: int = 2
    waves: int = 512
    c: float = 1.0
    rounds: int = 30
    rate: float = 1e-2
    weight: str | None = None
    seed: int = 42

    def fit(self, df: DataFrame) -> FittedKernel:
        heavy = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        x = vector_to_array("features")
        rows = df.select(x.alias("x"), F.array(F.col("label").cast("double"), heavy).alias("y"), (F.pmod(F.xxhash64(x), F.lit(10)) == 0).alias("held"))
        facts = rows.agg(F.count_if(~F.col("held")).alias("n"), F.max(F.size("x")).alias("width")).first()
        raised = _waves(rows, facts["width"] or 1, self.waves, self.seed)
        outputs, shrink = (1 if self.classes == 2 else self.classes), 1 / (self.c * max(facts["n"], 1))
        signs = lambda label: np.where(np.arange(outputs)[None, :] + (outputs == 1) == label[:, None], 1.0, -1.0)

        def gradient(parts: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
            pairs = np.stack(y)  # label and weight
            t, w = signs(pairs[:, 0]), pairs[:, 1:]
            z = raised(x)
            short = 1 - t * (z @ parts[0] + parts[1])
            slope = np.where(short > 0, -t, 0.0) * w / len(x)
            loss = (np.maximum(short, 0) * w).mean() + shrink / 2 * (parts[0] ** 2).sum()
            return float(loss), [z.T @ slope + shrink * parts[0], slope.sum(axis=0)]

        start = [np.zeros((self.waves, outputs)), np.zeros(outputs)]
        parts = _learned(rows.filter("not held").select("x", "y"), start, gradient, self)
        model = FittedKernel(parts, raised, np.ones(outputs), np.zeros(outputs))
        model.slope, model.shift = _sigmoids(rows.filter("held"), model, signs)
        return model


def _sigmoids(held: DataFrame, model: FittedKernel, signs: Callable, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Slope and shift of each margin's sigmoid: Newton steps with halving on the cross-entropy against (hits + 1) / (hits + 2) and 1 / (misses + 2)."""
    outputs = len(model.parts[1])

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                m, t = model.margins(np.stack(f["x"].to_numpy())), signs(np.stack(f["y"].to_numpy())[:, 0]) > 0
                yield pd.DataFrame({"k": np.tile(np.arange(outputs, dtype=np.int32), len(f)), "m": m.ravel(), "t": t.ravel()})

    margins = held.mapInPandas(placed, "k int, m double, t boolean").persist()
    try:
        counts = {r["k"]: (r["p"], r["n"]) for r in margins.groupBy("k").agg(F.count_if("t").alias("p"), F.count_if(~F.col("t")).alias("n")).collect()}  # a row a class
        p, n = (np.array([counts.get(k, (0, 0))[i] for k in range(outputs)], dtype=float) for i in (0, 1))
        high, low = (p + 1) / (p + 2), 1 / (n + 2)
        slope, shift = np.ones(outputs), np.log((p + 1) / (n + 1))
        of = lambda v: F.element_at(F.array(*[F.lit(float(x)) for x in v]), F.col("k") + 1)
        least, move = np.full(outputs, np.inf), (np.zeros(outputs), np.zeros(outputs))
        for _ in range(steps):
            u = of(slope) * F.col("m") + of(shift)
            q, goal = 1 / (1 + F.exp(-u)), F.when(F.col("t"), of(high)).otherwise(of(low))
            d, h = q - goal, F.greatest(q * (1 - q), F.lit(1e-12))
            loss = F.greatest(u, F.lit(0.0)) - goal * u + F.log1p(F.exp(-F.abs(u)))
            sums = {r["k"]: r for r in margins.groupBy("k").agg(F.sum(loss).alias("loss"), F.sum(d * F.col("m")).alias("ga"), F.sum(d).alias("gb"), F.sum(h * F.col("m") * F.col("m")).alias("haa"), F.sum(h * F.col("m")).alias("hab"), F.sum(h).alias("hbb")).collect()}
            still = False
            for k, r in sums.items():
                if r["loss"] > least[k] + 1e-9:  # too far: half of the way back
                    slope[k], shift[k] = slope[k] - move[0][k] / 2, shift[k] - move[1][k] / 2
                    move[0][k], move[1][k] = move[0][k] / 2, move[1][k] / 2
                    still |= abs(move[0][k]) + abs(move[1][k]) > 1e-6
                    continue
                least[k] = r["loss"]
                a, b, c = r["haa"] + 1e-9, r["hab"], r["hbb"] + 1e-9
                det = a * c - b * b
                move[0][k], move[1][k] = -(c * r["ga"] - b * r["gb"]) / det, -(a * r["gb"] - b * r["ga"]) / det
                slope[k], shift[k] = slope[k] + move[0][k], shift[k] + move[1][k]
                still |= abs(move[0][k]) + abs(move[1][k]) > 1e-6
            if not still:
                break
        return slope, shift
    finally:
        margins.unpersist()


def _learned(rows: DataFrame, start: list[np.ndarray], gradient: Gradient, plan: NetRegressor | KernelRegressor | KernelClassifier) -> list[np.ndarray]:
    rows.persist()
    try:
        return averaged(rows, start, gradient, plan.rounds, plan.rate, plan.seed)
    finally:
        rows.unpersist()
