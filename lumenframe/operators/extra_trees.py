"""Extremely randomised trees: every row in every tree, one random threshold for each drawn feature, grown level by level from sums by node."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREES_AT_ONCE = 25  # grown together, at least: a level of them takes two passes
SUMS_HELD = 1 << 22  # numbers that a task holds of a level; while they are fewer, more trees grow together


@dataclass
class Tree:
    """Nodes as lists: feature (-1 at a leaf), threshold, children, label sums (rows by class; or rows, sum and sum of squares), and rows of weight 1."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    sums: list[np.ndarray] = field(default_factory=list)

    def grown(self, sums: np.ndarray) -> int:
        for values, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.sums, sums)):
            values.append(v)
        return len(self.feature) - 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature), np.array(self.threshold), np.array(self.left), np.array(self.right)


def routed(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """The node that each row ends in."""
    feature, threshold, left, right = tree
    at = np.zeros(len(x), dtype=np.int64)
    inner = np.flatnonzero(feature[at] >= 0)
    while len(inner):
        here = at[inner]
        at[inner] = np.where(x[inner, feature[here]] <= threshold[here], left[here], right[here])
        inner = inner[feature[at[inner]] >= 0]
    return at


def impurity(sums: np.ndarray, classes: int) -> np.ndarray:
    """Rows times Gini index, or the sum of squared deviations, of label sums in the last axis."""
    if classes:
        n = sums.sum(-1)
        return n - (sums**2).sum(-1) / np.maximum(n, 1e-300)
    return sums[..., 2] - sums[..., 1] ** 2 / np.maximum(sums[..., 0], 1e-300)


def _rows(sums: np.ndarray, classes: int) -> np.ndarray:
    return sums.sum(-1) if classes else sums[..., 0]


def _labels(y: np.ndarray, w: np.ndarray, classes: int) -> np.ndarray:
    return np.eye(classes)[y.astype(int)] * w[:, None] if classes else np.stack([w, w * y, w * y * y], axis=1)


def _passed(rows: DataFrame, frontier: int, width: int, take: Callable, reduce: str) -> dict[int, np.ndarray]:
    """Sums, least or greatest values by node of the frontier: tasks reduce their own rows, Spark the tasks' results; a row a node reaches the driver."""
    start = {"sum": 0.0, "min": math.inf, "max": -math.inf}[reduce]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.full((frontier, width), start), np.zeros(frontier, dtype=bool)
        for f in frames:
            if len(f):
                for at, own in take(np.stack(f["x"].to_numpy()), f["y"].to_numpy(), f["w"].to_numpy()):
                    seen[at] = True
                    total[at] = total[at] + own if reduce == "sum" else (np.minimum if reduce == "min" else np.maximum)(total[at], own)
        some = np.flatnonzero(seen)
        yield pd.DataFrame({"node": some, "s": pd.Series(list(total[some]), dtype=object)})

    told = rows.mapInPandas(run, "node long, s array<double>").select("node", array_to_vector("s").alias("s"))
    return {r["node"]: r["s"].toArray() for r in told.groupBy("node").agg(getattr(Summarizer, reduce)(F.col("s")).alias("s")).collect()}


@dataclass
class ExtraTreesModel:
    trees: list[Tree]
    classes: int
    numFeatures: int  # noqa: N815  as Spark's models name it

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """Falls of impurity by feature, normalised by tree and then over the forest."""
        out = np.zeros(self.numFeatures)
        for t in self.trees:
            own = np.zeros(self.numFeatures)
            for i, j in enumerate(t.feature):
                if j >= 0:
                    own[j] += impurity(t.sums[i], self.classes) - impurity(t.sums[t.left[i]], self.classes) - impurity(t.sums[t.right[i]], self.classes)
            out += own / (own.sum() or 1.0)
        return DenseVector(out / (out.sum() or 1.0))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``, and ``probability`` for classes: means over the trees."""
        classes, given = self.classes, []
        for t in self.trees:
            sums = np.array(t.sums)
            given.append((t.arrays(), sums / np.maximum(_rows(sums, classes), 1e-300)[:, None] if classes else sums[:, 1:2] / np.maximum(sums[:, :1], 1e-300)))

        def run(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            a = np.stack(x.to_numpy())
            return pd.Series(list(sum(value[routed(a, t)] for t, value in given) / len(given)))

        told = df.withColumn("__p", F.pandas_udf(run, "array<double>")(vector_to_array("features")))
        if not classes:
            return told.withColumn("prediction", F.col("__p")[0]).drop("__p")
        best = (F.array_position("__p", F.array_max("__p")) - 1).cast("double")
        return told.withColumn("probability", array_to_vector("__p")).withColumn("prediction", best).drop("__p")


@dataclass
class ExtraTrees:
    """A forest without bootstrap. In a node ``most`` features that vary there (all by default; the square root of their number for classes) get one threshold each,
    uniform between their least and greatest value in the node, and the split of least impurity is taken.

    Trees grow together, ``TREES_AT_ONCE`` at a time: a level takes one pass for the ranges and one for the sums of the drawn splits. Tasks hold sums
    by node, not rows; the driver holds the trees. ``depth`` bounds both. Draws depend on seed, tree and node only.
    """

    classes: int = 0
    trees: int = 100
    depth: int = 12
    most: int | None = None
    weight: str | None = None
    seed: int = 43

    def fit(self, df: DataFrame) -> ExtraTreesModel:
        heavy = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), heavy.alias("w")).persist()
        try:
            d, classes = len(rows.first()["x"]), self.classes
            whole = _passed(rows, 1, classes or 3, lambda x, y, w: [(0, _labels(y, w, classes).sum(0))], "sum")[0]
            made: list[Tree] = []
            widest = 2 ** min(self.depth - 1, max(0, int(math.log2(max(_rows(whole, classes), 1))))) * max(2 * d, d * (classes or 3))
            together = max(TREES_AT_ONCE, SUMS_HELD // max(1, widest))
            for lo in range(0, self.trees, together):
                part = [Tree() for _ in range(min(together, self.trees - lo))]
                for t in part:
                    t.grown(whole)
                self._grow(rows, part, lo, d)
                made += part
            return ExtraTreesModel(made, classes, d)
        finally:
            rows.unpersist()

    def _grow(self, rows: DataFrame, trees: list[Tree], first: int, d: int) -> None:
        classes, size = self.classes, self.classes or 3
        most = self.most or (max(1, int(math.sqrt(d))) if classes else d)
        front = [(t, 0) for t in range(len(trees))]
        for _ in range(self.depth):
            front = [(t, i) for t, i in front if _rows(trees[t].sums[i], classes) > 1 and impurity(trees[t].sums[i], classes) > 1e-9]
            if not front:
                return
            shape = [t.arrays() for t in trees]
            place = [np.full(len(t.feature), -1) for t in trees]
            for k, (t, i) in enumerate(front):
                place[t][i] = k

            def reached(x: np.ndarray, shape=shape, place=place) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                """For each tree the rows in the frontier, ordered by node, and their nodes."""
                for tree, own in zip(shape, place, strict=True):
                    node = own[routed(x, tree)]
                    order = np.argsort(node, kind="stable")
                    order = order[np.searchsorted(node[order], 0) :]
                    if len(order):
                        yield order, node[order]

            def ranges(x: np.ndarray, y: np.ndarray, w: np.ndarray, sign: float, reached=reached) -> Iterator[tuple]:
                for order, node in reached(x):
                    at, start = np.unique(node, return_index=True)
                    yield at, np.minimum.reduceat(sign * x[order], start)

            # least values, and of the negative ones: one pass for both
            both = _passed(rows, len(front), 2 * d, lambda x, y, w, ranges=ranges: ((a[0], np.hstack([a[1], b[1]])) for a, b in zip(ranges(x, y, w, 1.0), ranges(x, y, w, -1.0), strict=True)), "min")
            feature, threshold = np.zeros((len(front), most), dtype=int), np.full((len(front), most), np.nan)
            for k, (t, i) in enumerate(front):
                rng, low, high = np.random.default_rng((self.seed, first + t, i)), both[k][:d], -both[k][d:]
                drawn = [j for j in rng.permutation(d) if high[j] > low[j]][:most]
                feature[k, : len(drawn)] = drawn
                threshold[k, : len(drawn)] = [min(rng.uniform(low[j], high[j]), np.nextafter(high[j], -math.inf)) for j in drawn]

            def splits(x: np.ndarray, y: np.ndarray, w: np.ndarray, reached=reached, feature=feature, threshold=threshold) -> Iterator[tuple]:
                label = _labels(y, w, classes)
                for order, node in reached(x):
                    at, start = np.unique(node, return_index=True)
                    goes = x[order[:, None], feature[node]] <= threshold[node]
                    yield at, np.hstack([np.add.reduceat(label[order] * goes[:, c, None], start) for c in range(most)])

            left = _passed(rows, len(front), most * size, splits, "sum")
            after = []
            for k, (t, i) in enumerate(front):
                tree, whole = trees[t], trees[t].sums[i]
                parts = left[k].reshape(most, size)
                rest = whole - parts
                fall = impurity(whole, classes) - impurity(parts, classes) - impurity(rest, classes)
                fall[np.isnan(threshold[k]) | (_rows(parts, classes) <= 0) | (_rows(rest, classes) <= 1e-9)] = -math.inf
                c = int(np.argmax(np.round(fall / impurity(whole, classes), 9)))  # equal splits stay equal, in whatever order sums are added
                if not np.isfinite(fall[c]):
                    continue
                tree.feature[i], tree.threshold[i] = int(feature[k, c]), float(threshold[k, c])
                tree.left[i] = tree.grown(parts[c])
                tree.right[i] = tree.grown(rest[c])
                after += [(t, tree.left[i]), (t, tree.right[i])]
            front = after
