"""Segmentation by few points that stand for many: Birch, spectral and mean shift, with all rows in Spark and only landmarks on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..sources import workspace
from . import clustering as K

CENTERS_MOST, FEATURES_MOST = 2_000, 20_000  # clustering features that Ward's rule merges; those that reach the driver
LANDMARKS, NEAR = 200, 10  # micro-clusters; those that a row is tied to in the spectral graph
SEEDS, BANDWIDTH_MOST, STEPS = 300, 2_000, 50  # rows that mean shift climbs from; rows that tell its bandwidth; climbs at most


def _micro(m: DataFrame, most: int, seed: int) -> tuple[object, np.ndarray, np.ndarray]:
    """A fitted k-means of at most ``most`` groups, its centers and their sizes."""
    model = KMeans(k=most, seed=seed, maxIter=20).fit(m)
    return model, np.array(model.clusterCenters()), np.array(model.summary.clusterSizes, dtype=float)


class FeatureTree:
    """A height-balanced tree of clustering features (rows, their sum, their sum of squared lengths), each no wider than ``radius``.

    A feature goes down to the nearest entry, node by node. It joins the leaf's entry if both together keep within the radius, and
    is an entry of its own otherwise; a node of more than ``branching`` entries is split at its two farthest ones.
    """

    class Node:
        def __init__(self, room: int, width: int, leaf: bool) -> None:
            self.count, self.leaf = 0, leaf
            self.n, self.sums, self.squares, self.below = np.zeros(room), np.zeros((room, width)), np.zeros(room), [None] * room

        def put(self, i: int, n: float, sums: np.ndarray, squares: float, below: FeatureTree.Node | None) -> None:
            self.n[i], self.sums[i], self.squares[i], self.below[i] = n, sums, squares, below
            self.count = max(self.count, i + 1)

        def whole(self) -> tuple[float, np.ndarray, float]:
            k = self.count
            return self.n[:k].sum(), self.sums[:k].sum(axis=0), self.squares[:k].sum()

    def __init__(self, radius: float, width: int, branching: int = 50) -> None:
        self.radius, self.width, self.branching = radius, width, branching
        self.root = self.Node(branching + 1, width, True)

    def add(self, n: float, sums: np.ndarray, squares: float) -> None:
        halves = self._add(self.root, n, sums, squares)
        if halves:
            self.root = self.Node(self.branching + 1, self.width, False)
            for i, half in enumerate(halves):
                self.root.put(i, *half.whole(), half)

    def _add(self, node: Node, n: float, sums: np.ndarray, squares: float) -> tuple[Node, Node] | None:
        k = node.count
        if k:
            gap = node.sums[:k] / node.n[:k, None] - sums / n
            i = int(np.argmin((gap * gap).sum(axis=1)))
            all_n, all_sums, all_squares = node.n[i] + n, node.sums[i] + sums, node.squares[i] + squares
            if not node.leaf:
                halves = self._add(node.below[i], n, sums, squares)
                if not halves:
                    node.put(i, all_n, all_sums, all_squares, node.below[i])
                    return None
                node.put(i, *halves[0].whole(), halves[0])
                node.put(k, *halves[1].whole(), halves[1])
                return self._split(node) if node.count > self.branching else None
            middle = all_sums / all_n
            if all_squares / all_n - middle @ middle <= self.radius**2:
                node.put(i, all_n, all_sums, all_squares, None)
                return None
        node.put(k, n, sums, squares, None)
        return self._split(node) if node.count > self.branching else None

    def _split(self, node: Node) -> tuple[Node, Node]:
        k = node.count
        d = K._distances(node.sums[:k] / node.n[:k, None], node.sums[:k] / node.n[:k, None])
        a, b = np.unravel_index(np.argmax(d), d.shape)
        first = d[a] <= d[b]
        first[[a, b]] = True, False
        halves = []
        for part in (np.flatnonzero(first), np.flatnonzero(~first)):
            half = self.Node(self.branching + 1, self.width, node.leaf)
            for i, j in enumerate(part):
                half.put(i, node.n[j], node.sums[j], node.squares[j], node.below[j])
            halves.append(half)
        return halves[0], halves[1]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, sums and squares of all leaf entries."""
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if node.leaf:
                out.append((node.n[: node.count], node.sums[: node.count], node.squares[: node.count]))
            else:
                todo += node.below[: node.count][::-1]
        return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def _condensed(df: DataFrame, radius: float, width: int) -> DataFrame:
    """Clustering features (n, sums, squares), those of each task put through a tree of its own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = FeatureTree(radius, width)
        for f in frames:
            for n, sums, squares in zip(f["n"], f["sums"], f["squares"], strict=True):
                tree.add(n, sums, squares)
        n, sums, squares = tree.entries()
        yield pd.DataFrame({"n": n, "sums": pd.Series(list(sums), dtype=object), "squares": squares})

    return df.mapInPandas(run, "n double, sums array<double>, squares double")


def birch(m: DataFrame, key: str, k: int, threshold: float = 0.5, most: int = CENTERS_MOST) -> DataFrame:
    """(key, prediction): rows are condensed to clustering features no wider than ``threshold``, whose centers Ward's rule merges, by their sizes, to ``k`` clusters.

    Each task puts its rows through a feature tree; the tasks' features, which add up, are put through one again. If more than ``most``
    are left, the threshold rises by half and features are condensed further, in Spark while they are more than ``FEATURES_MOST``. Every row goes to the nearest center.
    How rows are dealt to tasks has a say in where features begin, as the order of rows has in any such tree.
    """
    f = vector_to_array("features")
    first = m.select(f.alias("f")).first()
    if first is None:
        return m.select(N.q(key), F.lit(0).alias("prediction"))
    width = len(first["f"])
    rows = m.select(F.lit(1.0).alias("n"), f.alias("sums"), F.aggregate(f, F.lit(0.0), lambda s, v: s + v * v).alias("squares"))
    features, radius = workspace.keep(_condensed(rows, threshold, width), "features"), threshold
    while features.count() > FEATURES_MOST:
        radius *= 1.5
        features = workspace.keep(_condensed(features.repartition(max(1, features.count() // FEATURES_MOST)), radius, width), "features")
    tree = FeatureTree(radius, width)
    for r in features.orderBy("sums", "n").toLocalIterator():  # FEATURES_MOST at most
        tree.add(r["n"], np.array(r["sums"]), r["squares"])
    n, sums, squares = tree.entries()
    while len(n) > most:
        radius *= 1.5
        tree = FeatureTree(radius, width)
        for one in zip(n, sums, squares, strict=True):
            tree.add(*one)
        n, sums, squares = tree.entries()
    centers = sums / n[:, None]
    label = K.cut_tree(K.linkage(centers, "ward", n), min(k, len(n))) if len(n) > 1 else np.zeros(1, dtype=int)

    def told(x: pd.Series) -> pd.Series:
        return pd.Series(label[np.argmin(K._distances(np.stack(x.to_numpy()), centers), axis=1)] if len(x) else [], dtype="int32")

    return m.select(N.q(key), F.pandas_udf(told, "int")(f).alias("prediction"))


def _summed(rows: DataFrame, partial: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """Sum over all rows of the matrix that ``partial`` gives for an Arrow batch of them; a task sends its matrix, row by row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            if len(f):
                part = partial(f)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": range(len(total)), "v": list(total)})

    parts = rows.mapInPandas(run, "i int, v array<double>")
    told = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("v")).alias("v")).orderBy("i").collect()  # a row a landmark
    return np.array([r["v"].toArray() for r in told])


def ties(x: np.ndarray, centers: np.ndarray, near: int) -> np.ndarray:
    """Each row's ties to its ``near`` nearest landmarks, adding up to 1; they fall off with the distance to the last of them."""
    d = K._distances(x, centers)
    near = min(near, len(centers))
    at = np.argpartition(d, near - 1, axis=1)[:, :near]
    own = np.take_along_axis(d, at, axis=1)
    scale = np.maximum(own.max(axis=1, keepdims=True), 1e-12)
    weight = np.exp(-((own / scale) ** 2) * 2)
    out = np.zeros_like(d)
    np.put_along_axis(out, at, weight / weight.sum(axis=1, keepdims=True), axis=1)
    return out


def spectral(m: DataFrame, key: str, k: int, most: int = LANDMARKS, near: int = NEAR, seed: int = 42) -> DataFrame:
    """(key, prediction): rows are joined through landmarks, so the graph's leading vectors come from a landmark-by-landmark matrix.

    The ties Z of all rows to ``most`` landmarks give the graph Z D^-1 Z'. Spark sums Z'Z, the driver solves it (``most``
    squared), and k-means runs over all rows' places in its first ``k`` directions.
    """
    _, centers, sizes = _micro(m, most, seed)
    centers = centers[sizes > 0]

    def gram(f: pd.DataFrame) -> np.ndarray:
        z = ties(np.stack(f["x"].to_numpy()), centers, near)
        return np.column_stack([z.T @ z, z.sum(axis=0)])

    told = _summed(m.select(vector_to_array("features").alias("x")), gram)
    mass = np.sqrt(np.maximum(told[:, -1], 1e-12))
    values, vectors = np.linalg.eigh(told[:, :-1] / mass[:, None] / mass[None, :])
    first = np.argsort(values)[::-1][: min(k, len(centers))]
    turn = vectors[:, first] / np.sqrt(np.maximum(values[first], 1e-12)) / mass[:, None]

    def place(x: pd.Series) -> pd.Series:
        u = ties(np.stack(x.to_numpy()), centers, near) @ turn if len(x) else np.zeros((0, len(first)))
        return pd.Series((u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)).tolist())

    placed = m.select(N.q(key), array_to_vector(F.pandas_udf(place, "array<double>")(vector_to_array("features"))).alias("features")).persist()
    try:
        return K.kmeans(placed, k).transform(placed).select(N.q(key), "prediction")
    finally:
        placed.unpersist()


def _weighed(m: DataFrame, width: int) -> tuple[DataFrame, list[str]]:
    """Distinct points (x0, x1, ..., n rows), dealt into four files a core; the names of the coordinates."""
    axes = [f"x{j}" for j in range(width)]
    points = m.groupBy(vector_to_array("features").alias("f")).agg(F.count("*").alias("n")).select(*[F.col("f")[j].alias(a) for j, a in enumerate(axes)], "n")
    cores = m.sparkSession.sparkContext.defaultParallelism
    return workspace.keep(points.repartition(4 * cores), "points"), axes


def bandwidth_of(m: DataFrame, quantile: float = 0.2, most: int = BANDWIDTH_MOST) -> float:
    """Mean distance to the neighbour that a share ``quantile`` of a bounded sample is nearer than."""
    x = K._matrix(K.bounded(m, most))
    if len(x) < 2:
        return 0.0
    place = max(1, int(len(x) * quantile)) - 1
    return float(np.partition(K._distances(x, x), place, axis=1)[:, place].mean())


def mean_shift(m: DataFrame, key: str, bandwidth: float | None = None, quantile: float = 0.2, seeds: int = SEEDS) -> tuple[DataFrame, list[list[float]]]:
    """(key, prediction) and the peaks: each seed climbs to the mean of all rows within ``bandwidth`` until it rests.

    Seeds are a bounded sample of rows; a peak that a share p of the rows leads to is missed with probability (1 - p)^seeds.
    The rows are prepared once: distinct points with their number of rows, as plain columns, dealt evenly to the tasks that every climb reads them with.
    Peaks within ``bandwidth`` of one with more rows around it are dropped; rows go to the nearest peak.
    """
    reach = bandwidth or bandwidth_of(m, quantile) or 1.0
    at = np.unique(K._matrix(K.bounded(m.select("features"), seeds)), axis=0)
    mass, moving = np.zeros(len(at)), np.arange(len(at))
    points, axes = _weighed(m, at.shape[1])
    for _ in range(STEPS):
        start = at[moving]

        def near(f: pd.DataFrame, start: np.ndarray = start) -> np.ndarray:
            x, n = f[axes].to_numpy(dtype=float), f["n"].to_numpy(dtype=float)
            inside = (K._distances(start, x) <= reach).astype(float)
            return inside @ np.column_stack([x * n[:, None], n])

        told = _summed(points, near) if len(at) else np.zeros((0, at.shape[1] + 1))
        held = told[:, -1] > 0
        to = np.where(held[:, None], told[:, :-1] / np.maximum(told[:, -1:], 1), start)
        at[moving], mass[moving] = to, told[:, -1]
        moving = moving[np.linalg.norm(to - start, axis=1) > 1e-3 * reach]
        if not len(moving):
            break
    workspace.drop(points)
    peaks: list[np.ndarray] = []
    for i in sorted(range(len(at)), key=lambda i: (-mass[i], *at[i])):
        if all(math.dist(at[i], p) >= reach for p in peaks):
            peaks.append(at[i])
    listed = [p.tolist() for p in peaks]
    return K.nearest(m, key, listed), listed
