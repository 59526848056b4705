"""Segmentation: matrices, algorithms, choice of k, validation and profiles."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as N
from ..functions import parsing as P
from ..functions import stats as S
from ..plans import order as O
from ..sources import workspace
from .learning import Preprocessor, fit_preprocessor

# Samples that quadratic work is bounded to.
SILHOUETTE_MOST, HIERARCHY_MOST, GRID_MOST, PROBES = 5_000, 4_000, 3_000, 300
PIECE_ROWS = 32_768  # distinct points of either side that a task holds for silhouettes of all rows
TILE = 1 << 20  # distances worked out at once


@dataclass
class ClusterResult:
    name: str
    labels: DataFrame | None = None
    metrics: dict = field(default_factory=dict)
    model: object = None
    error: str | None = None


def prepare_matrix(df: DataFrame, features: list[str], key: list[str], scaler: str = "standard", encoder: str = "onehot") -> tuple[DataFrame, Preprocessor]:
    """``key`` and the vector ``features``, imputed, scaled and encoded."""
    ready = fit_preprocessor(df, features, scaler=scaler, encoder=encoder)
    return ready.transform(df).select(*[N.q(k) for k in key], "features"), ready


def bounded(df: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows, chosen by a hash of their place, not of their values: equal rows are drawn one by one."""
    placed = df.withColumn("__at", F.monotonically_increasing_id()).withColumn("__draw", F.xxhash64(F.lit(seed), "__at"))
    # each task would send ``most`` rows to the driver: rows that the sample can't reach are left out before
    edges = [-(2**63) + 2 ** (64 - k) - 1 for k in range(1, 40)]
    held = df.select(F.monotonically_increasing_id().alias("__at")).agg(*[F.count_if(F.xxhash64(F.lit(seed), "__at") <= e).alias(f"k{k}") for k, e in enumerate(edges)]).first()
    enough = [e for k, e in enumerate(edges) if held[k] >= most + most // 4 + 100]  # some to spare, should the two passes number rows differently
    some = placed.filter(F.col("__draw") <= min(enough)) if enough else placed
    return some.orderBy("__draw", "__at").limit(most).drop("__at", "__draw")


def _matrix(df: DataFrame) -> np.ndarray:
    rows = df.select(vector_to_array("features").alias("f")).collect()  # of a bounded sample
    return np.array([r["f"] for r in rows], dtype=float).reshape(len(rows), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(gap, 0))


# --- algorithms -------------------------------------------------------------------------------


def kmeans(m: DataFrame, k: int, seeds: int = 3, seed: int = 42):
    """The best of several starts by cost."""
    return min((KMeans(k=k, seed=seed + s, maxIter=50).fit(m) for s in range(seeds)), key=lambda f: f.summary.trainingCost)


def dbscan(m: DataFrame, key: str, eps: float, min_samples: int) -> DataFrame:
    """(key, prediction): clusters of dense points, -1 for noise; border points go to the cluster of the smallest label.

    Equal points are one point with a weight. Any two points of a cell (side eps / sqrt(width)) are near, so a cell of
    ``min_samples`` rows has core points only, and the core points of a cell are one node. Points and cells meet in
    neighbouring buckets of cells over the first three coordinates; clusters are components of the nodes.
    """
    x = m.select(N.q(key).cast("long").alias("id"), vector_to_array("features").alias("f"))
    width = len(x.first()["f"])
    side, wide, axes = eps / math.sqrt(width) * (1 - 1e-9), math.isqrt(width) + 1, min(3, width)
    buckets = [f"b{k}" for k in range(axes)]
    near = lambda p, q: _unit(p, q) <= eps * eps
    meet = lambda left, right: _around(left, buckets).alias("a").join(right.alias("b"), [F.col(f"a.{b}") == F.col(f"b.{b}") for b in buckets])

    points = x.groupBy("f").agg(F.min("id").alias("u"), F.count("*").alias("w")).withColumn("g", F.transform("f", lambda v: F.floor(v / side).cast("long")))
    points = points.join(points.groupBy("g").agg(F.sum("w").alias("held")), "g")
    points = points.select("*", *[F.floor(F.element_at("g", k + 1) / wide).cast("long").alias(b) for k, b in enumerate(buckets)]).checkpoint()
    sparse = points.filter(F.col("held") < min_samples)
    seen = meet(sparse, points).filter(near(F.col("a.f"), F.col("b.f"))).groupBy(F.col("a.u").alias("u")).agg(F.sum("b.w").alias("n"))
    core = points.filter(F.col("held") >= min_samples).unionByName(sparse.join(seen.filter(F.col("n") >= min_samples), "u", "left_semi").select(*points.columns)).checkpoint()

    # the outermost core points of a cell settle most pairs of cells; all points meet only for pairs that stay apart
    edge = [pick("f", F.element_at("f", k + 1)) for k in range(axes) for pick in (F.min_by, F.max_by)]
    cells = core.groupBy("g", *buckets).agg(F.min("u").alias("node"), F.count("*").alias("size"), F.array_distinct(F.array(*edge)).alias("edge")).checkpoint()
    apart = F.aggregate(F.zip_with("a.g", "b.g", lambda u, v: F.pow(F.greatest(F.abs(u - v) - 1, F.lit(0)), 2)), F.lit(0.0), lambda s, v: s + v) * side * side
    pairs = meet(cells, cells).filter((F.col("a.node") < F.col("b.node")) & (apart <= eps * eps))
    met = F.exists("a.edge", lambda p: F.exists("b.edge", lambda q: near(p, q)))
    pairs = pairs.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"), met.alias("met"), ((F.col("a.size") > 1) | (F.col("b.size") > 1)).alias("more")).checkpoint()
    links = pairs.filter("met").select("u", "v")
    labels = _components(cells.select(F.col("node").alias("u")), links)
    name = lambda c: labels.select(F.col("u").alias(c), F.col("label").alias(f"{c}_label"))
    open_ = pairs.filter("not met and more").join(name("u"), "u").join(name("v"), "v").filter("u_label <> v_label").select("u", "v")
    placed = core.join(cells.select("g", "node"), "g").select("node", "f")
    late = open_.join(placed.select(F.col("node").alias("u"), F.col("f").alias("p")), "u").join(placed.select(F.col("node").alias("v"), F.col("f").alias("q")), "v")
    late = late.filter(near(F.col("p"), F.col("q"))).select("u", "v").distinct().checkpoint()
    if not late.isEmpty():
        labels = _components(cells.select(F.col("node").alias("u")), links.unionByName(late))

    inner = core.join(cells.select("g", "node"), "g").join(labels.select(F.col("u").alias("node"), "label"), "node").select("u", "f", "label", *buckets)
    outer = meet(sparse.join(core.select("u"), "u", "left_anti"), inner).filter(near(F.col("a.f"), F.col("b.f"))).groupBy(F.col("a.f").alias("f")).agg(F.min("b.label").alias("label"))
    found = x.join(inner.select("f", "label").unionByName(outer), "f", "left")
    names = labels.select("label").distinct().withColumn("prediction", F.row_number().over(W.orderBy("label")) - 1)  # a row a cluster
    return found.join(F.broadcast(names), "label", "left").select(F.col("id").alias(key), F.coalesce("prediction", F.lit(-1)).alias("prediction"))


def _around(df: DataFrame, buckets: list[str]) -> DataFrame:
    """Each row once in its own and in every neighbouring bucket."""
    for b in buckets:
        df = df.withColumn(b, F.explode(F.sequence(F.col(b) - 1, F.col(b) + 1)))
    return df


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(u, label): the smallest node of each component, spreading along links until nothing changes."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).unionByName(nodes.select("u", F.col("u").alias("v"))).checkpoint()
    labels = nodes.select("u", F.col("u").alias("label"))
    while True:
        spread = both.join(labels, "u").groupBy(F.col("v").alias("u")).agg(F.min("label").alias("label"))
        jumped = spread.join(spread.select(F.col("u").alias("label"), F.col("label").alias("next")), "label").select("u", F.least("label", "next").alias("label")).checkpoint()
        done = jumped.join(labels.withColumnRenamed("label", "old"), "u").filter("label <> old").isEmpty()
        labels = jumped
        if done:
            return labels


def linkage(x: np.ndarray, method: str = "ward", sizes: np.ndarray | None = None) -> np.ndarray:
    """Merges (a, b, height, size) of a bounded sample, by the nearest-neighbour chain with Lance-Williams updates.

    ``sizes``: how many rows each point stands for (one by default).
    """
    n = len(x)
    d, size = _distances(x, x), np.ones(n) if sizes is None else sizes.astype(float)
    if method == "ward":
        d = d**2 * (2 * size[:, None] * size[None, :] / (size[:, None] + size[None, :]))
    np.fill_diagonal(d, np.inf)
    alive, merges, chain = np.ones(n, dtype=bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            b = int(np.argmin(np.where(alive, d[a], np.inf)))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        a, b = sorted((a, b))
        height, na, nb = d[a, b], size[a], size[b]
        others = alive.copy()
        others[[a, b]] = False
        if method == "ward":
            nk = size[others]
            fresh = ((na + nk) * d[a, others] + (nb + nk) * d[b, others] - nk * height) / (na + nb + nk)
        else:
            fresh = {"complete": np.maximum, "single": np.minimum}.get(method, lambda p, q: (na * p + nb * q) / (na + nb))(d[a, others], d[b, others])
        d[a, others] = d[others, a] = fresh
        d[b, :] = d[:, b] = np.inf
        alive[b] = False
        size[a] = na + nb
        merges.append((a, b, math.sqrt(height) if method == "ward" else height, na + nb))
    order = np.argsort([m[2] for m in merges], kind="stable")
    name, out = list(range(n)), []
    for k, i in enumerate(order):
        a, b, h, s = merges[i]
        out.append((name[a], name[b], h, s))
        name[a] = n + k
    return np.array(out).reshape(-1, 4)


def cut_tree(z: np.ndarray, k: int) -> np.ndarray:
    """Labels 0..k-1 of the leaves after all but the last k-1 merges."""
    n = len(z) + 1
    parent = list(range(2 * n - 1))

    def root(a: int) -> int:
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(n - k):
        parent[root(int(z[i, 0]))] = parent[root(int(z[i, 1]))] = n + i
    roots = [root(a) for a in range(n)]
    names = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    return np.array([names[r] for r in roots])


def hierarchical(m: DataFrame, key: str, k: int, method: str = "ward", most: int = HIERARCHY_MOST) -> tuple[DataFrame, np.ndarray]:
    """(key, prediction) of all rows: a bounded sample is clustered, every row then goes to the nearest centroid."""
    x = _matrix(bounded(m, most))
    z = linkage(x, method)
    own = cut_tree(z, k)
    centers = [x[own == c].mean(axis=0).tolist() for c in range(k)]
    return nearest(m, key, centers), z


def nearest(m: DataFrame, key: str, centers: list[list[float]]) -> DataFrame:
    f = vector_to_array("features")
    gap = lambda c: F.aggregate(F.zip_with(f, F.array(*[F.lit(v) for v in c]), lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)
    all_ = F.array(*[gap(c) for c in centers])
    return m.select(N.q(key), (F.array_position(all_, F.array_min(all_)) - 1).cast("int").alias("prediction"))


def run_clustering(m: DataFrame, key: str, name: str, k: int = 3, **params) -> ClusterResult:
    """One algorithm by name, with its metrics; what fails is reported in ``error``."""
    from . import density, landmarks, mixture  # they build on this module

    out = ClusterResult(name)
    try:
        if name in ("KMeans", "MiniBatchKMeans"):
            out.model = kmeans(m, k)
        elif name == "Gaussian Mixture":
            out.model = mixture.Mixture(k, params.get("covariance_type", "full")).fit(m)
        elif name == "Bisecting KMeans":
            out.model = BisectingKMeans(k=k, seed=42).fit(m)
        elif name == "Jerárquico":
            out.labels, out.model = hierarchical(m, key, k, **params)
        elif name == "DBSCAN":
            out.labels = dbscan(m, key, params.get("eps", 0.5), params.get("min_samples", 5))
        elif name == "HDBSCAN":
            out.labels = density.hdbscan(m, key, params.get("min_cluster_size", 15), params.get("min_samples", 5))
        elif name == "Birch":
            out.labels = landmarks.birch(m, key, k, **params)
        elif name == "Spectral":
            out.labels = landmarks.spectral(m, key, k, **params)
        elif name == "Mean Shift":
            out.labels, out.model = landmarks.mean_shift(m, key, **params)
        else:
            raise ValueError(f"algoritmo desconocido: {name}")
        if out.labels is None:
            out.labels = out.model.transform(m).select(key, "prediction")
        out.metrics = cluster_metrics(m.join(out.labels, key)).first().asDict()
    except Exception as e:  # the comparison lists it as failed
        out.error = str(e).splitlines()[0][:200]
    return out


def compare_algorithms(m: DataFrame, key: str, names: list[str], k: int = 3) -> DataFrame:
    rows = []
    for r in (run_clustering(m, key, n, k) for n in names):
        x = r.metrics
        rows.append((r.name, x.get("clusters"), x.get("silueta"), x.get("calinski_harabasz"), x.get("davies_bouldin"), x.get("ruido_pct"), r.error))
    table = m.sparkSession.createDataFrame(rows, "algoritmo string, clusters long, silueta double, calinski_harabasz double, davies_bouldin double, `%_ruido` double, error string")
    return table.orderBy(F.desc_nulls_last("silueta"))


# --- validation -------------------------------------------------------------------------------


def _unit(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)


def _centroids(labelled: DataFrame, label: str) -> DataFrame:
    """(cluster, n, c): means by coordinate, pre-aggregated before the shuffle."""
    each = labelled.select(F.col(label).alias("cluster"), F.posexplode(vector_to_array("features")).alias("pos", "v"))
    return each.groupBy("cluster", "pos").agg(F.avg("v").alias("m"), F.count("*").alias("n")).groupBy("cluster").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("c")).select("cluster", "n", F.transform("c", lambda p: p["m"]).alias("c"))


def compactness(labelled: DataFrame, label: str = "prediction") -> DataFrame:
    """calinski_harabasz and davies_bouldin of the rows that aren't noise, from aggregates by cluster."""
    rows = labelled.filter(F.col(label) >= 0)
    centers = _centroids(rows, label)
    whole = _centroids(rows.withColumn("__all", F.lit(0)), "__all").select(F.col("c").alias("g"), F.col("n").alias("total"))
    gap = _unit(vector_to_array("features"), F.col("c"))
    spread = rows.join(F.broadcast(centers), F.col(label) == F.col("cluster")).groupBy("cluster", "n", "c").agg(F.sum(gap).alias("ss"), F.avg(F.sqrt(gap)).alias("s"))
    both = spread.crossJoin(F.broadcast(whole))  # one row
    ch = both.agg((S.ratio(F.sum(F.col("n") * _unit(F.col("c"), F.col("g"))) / F.nullif(F.count("*") - 1, F.lit(0)), F.nullif(F.sum("ss") / (F.max("total") - F.count("*")), F.lit(0.0)))).alias("calinski_harabasz"), F.count("*").alias("clusters"), F.sum("ss").alias("inercia"))
    a, b = spread.alias("a"), spread.alias("b")
    worst = a.join(F.broadcast(b), F.col("a.cluster") != F.col("b.cluster")).groupBy("a.cluster").agg(F.max(S.ratio(F.col("a.s") + F.col("b.s"), F.nullif(F.sqrt(_unit(F.col("a.c"), F.col("b.c"))), F.lit(0.0)))).alias("r"))
    return ch.crossJoin(worst.agg(F.avg("r").alias("davies_bouldin")))  # one row by one row


def silhouette_points(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    d = _distances(x, x)
    names = np.unique(labels)
    mean = np.stack([d[:, labels == c].sum(axis=1) for c in names], axis=1)
    return _silhouettes(mean, np.searchsorted(names, labels), np.array([(labels == c).sum() for c in names]))


def _silhouettes(mean: np.ndarray, own: np.ndarray, size: np.ndarray) -> np.ndarray:
    """From the sums of distances to each cluster, each row's own cluster and the clusters' sizes."""
    rows = np.arange(len(mean))
    a = mean[rows, own] / np.maximum(size[own] - 1, 1)
    other = mean / size
    other[rows, own] = np.inf
    b = other.min(axis=1)
    return np.where(size[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)


def _precise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all pairs; those of nearly equal points, which the product of matrices leaves to rounding, are taken from their differences."""
    gap = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    near = 1e-6 * gap
    gap -= 2 * a @ b.T
    i, j = np.nonzero(gap < near)
    for lo in range(0, len(i), TILE // max(a.shape[1], 1) + 1):
        at = slice(lo, lo + TILE // max(a.shape[1], 1) + 1)
        gap[i[at], j[at]] = ((a[i[at]] - b[j[at]]) ** 2).sum(1)
    return np.sqrt(gap)


def silhouette_each(labelled: DataFrame, key: str, label: str = "prediction", piece: int = PIECE_ROWS) -> DataFrame:
    """(key, cluster, silueta) of all rows outside the noise, Euclidean and exact; 0 for a single cluster and in clusters of one row.

    Equal points of a cluster are one point with a weight. Points are dealt into pieces, and each pair of pieces is met by a task of
    its own, which gives the sum of distances from each point to each cluster. The work grows as the square of the distinct points.
    """
    spark = labelled.sparkSession
    rows = labelled.filter(F.col(label) >= 0).select(N.q(key), F.col(label).alias("cluster"), vector_to_array("features").alias("f"))
    sizes = {r["cluster"]: r["count"] for r in rows.groupBy("cluster").count().collect()}  # a row a cluster
    if len(sizes) < 2:
        return rows.select(N.q(key), "cluster", F.lit(0.0).alias("silueta"))
    names = np.array(sorted(sizes))
    size = np.array([sizes[c] for c in names.tolist()])
    points = workspace.keep(rows.groupBy("cluster", "f").agg(F.count("*").alias("n")).withColumn("u", F.monotonically_increasing_id()), "points")
    n = points.count()
    pieces = max(-(-n // piece), min(4, -(-n // 1_024)))
    every, own = F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))), F.pmod(F.xxhash64("u"), F.lit(pieces)).cast("int")
    left = points.select("u", "f", own.alias("a"), every.alias("b")).repartition(pieces * pieces, "a", "b")
    right = points.select("cluster", "f", "n", own.alias("b"), every.alias("a")).repartition(pieces * pieces, "a", "b")

    def sums(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"u": [], "sums": []})
        place = np.searchsorted(names, q["cluster"].to_numpy())
        order = np.argsort(place, kind="stable")
        held, start = np.unique(place[order], return_index=True)
        x, y, copies = np.stack(p["f"].to_numpy()), np.stack(q["f"].to_numpy())[order], q["n"].to_numpy(dtype=float)[order]
        middle = y.mean(axis=0)
        x, y = x - middle, y - middle
        out, step = np.zeros((len(x), len(names))), max(1, TILE // len(y))
        for lo in range(0, len(x), step):
            out[lo : lo + step, held] = np.add.reduceat(_precise(x[lo : lo + step], y) * copies, start, axis=1)
        return pd.DataFrame({"u": p["u"], "sums": list(out)})

    def value(cluster: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(_silhouettes(np.stack(total.to_numpy()), np.searchsorted(names, cluster.to_numpy()), size) if len(total) else [], dtype=float)

    met = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(sums, "u long, sums array<double>")
    total = F.aggregate(F.collect_list("sums"), F.array_repeat(F.lit(0.0), len(names)), lambda s, x: F.zip_with(s, x, lambda u, v: u + v))
    told = points.join(met.groupBy("u").agg(total.alias("total")), "u").select("cluster", "f", F.pandas_udf(value, "double")("cluster", "total").alias("silueta"))
    told = workspace.keep(told, "silhouettes")
    return rows.join(told, ["cluster", "f"]).select(N.q(key), "cluster", "silueta")


def silhouette(labelled: DataFrame, label: str = "prediction", most: int = SILHOUETTE_MOST) -> float | None:
    """Euclidean, over a bounded sample without noise."""
    some = bounded(labelled.filter(F.col(label) >= 0).select("features", label), most)
    rows = some.select(vector_to_array("features").alias("f"), label).collect()
    y = np.array([r[label] for r in rows])
    if len(np.unique(y)) < 2:
        return None
    return float(silhouette_points(np.array([r["f"] for r in rows]), y).mean())


def cluster_metrics(labelled: DataFrame, label: str = "prediction") -> DataFrame:
    noise = labelled.agg((100 * F.avg((F.col(label) < 0).cast("int"))).alias("ruido_pct"))
    return compactness(labelled, label).crossJoin(noise).withColumn("silueta", F.lit(silhouette(labelled, label)).cast("double"))


def elbow(inertia: dict[int, float]) -> int | None:
    ks = sorted(inertia)
    bends = {k: inertia[ks[i - 1]] - 2 * inertia[k] + inertia[ks[i + 1]] for i, k in enumerate(ks) if 0 < i < len(ks) - 1}
    return max(bends, key=bends.get) if bends else None


def k_selection(m: DataFrame, low: int = 2, high: int = 10) -> DataFrame:
    rows, inertia = [], {}
    for k in range(low, high + 1):
        model = kmeans(m, k, seeds=1)
        labelled = model.transform(m)
        x = compactness(labelled).first()
        inertia[k] = model.summary.trainingCost
        rows.append([k, inertia[k], silhouette(labelled), x["calinski_harabasz"], x["davies_bouldin"], 100 * (inertia[k] - inertia[k - 1]) / inertia[k - 1] if k - 1 in inertia and inertia[k - 1] else None])
    tags = {elbow(inertia): "codo", max(rows, key=lambda r: r[2] or -2)[0]: "silueta", max(rows, key=lambda r: r[3] or 0)[0]: "calinski_harabasz", min(rows, key=lambda r: r[4] or math.inf)[0]: "davies_bouldin"}
    out = [(*r, ", ".join(t for k, t in tags.items() if k == r[0]) or None) for r in rows]
    return m.sparkSession.createDataFrame(out, "k int, inercia double, silueta double, calinski_harabasz double, davies_bouldin double, `delta_inercia_%` double, recomendado string")


def hopkins(m: DataFrame, seed: int = 42, most: int = SILHOUETTE_MOST) -> float | None:
    """Near 1: clustered; near 0.5: uniform. None under 20 rows. Over a bounded sample."""
    x = _matrix(bounded(m, most))
    n = len(x)
    if n < 20:
        return None
    rng, k = np.random.default_rng(seed), min(PROBES, max(10, n // 10))
    probes = rng.uniform(x.min(axis=0), x.max(axis=0), (k, x.shape[1]))
    picked = rng.choice(n, k, replace=False)
    u = _distances(probes, x).min(axis=1)
    own = _distances(x[picked], x)
    own[np.arange(k), picked] = np.inf
    w = own.min(axis=1)
    return float(u.sum() / max(u.sum() + w.sum(), 1e-300))


def k_distances(m: DataFrame, k: int, most: int = GRID_MOST) -> np.ndarray:
    """Sorted distances to the k-th neighbour, the point itself being the first."""
    x = _matrix(bounded(m, most))
    return np.sort(np.sort(_distances(x, x), axis=1)[:, min(k, len(x)) - 1])


def suggest_eps(curve: np.ndarray) -> float:
    """The knee: where the curve lies farthest under its chord."""
    span = curve[-1] - curve[0]
    if len(curve) < 2 or span == 0:
        return float(curve[-1]) if len(curve) else 0.5
    xs, ys = np.linspace(0, 1, len(curve)), (curve - curve[0]) / span
    return float(curve[np.argmax(np.abs(ys - xs))])


def dbscan_labels(d: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    near = d <= eps
    core = near.sum(axis=1) >= min_samples
    labels, name = np.full(len(d), -1), 0
    for i in np.flatnonzero(core):
        if labels[i] >= 0:
            continue
        front = np.zeros(len(d), dtype=bool)
        front[i] = True
        seen = front.copy()
        while front.any():
            front = near[front & core].any(axis=0) & ~seen if (front & core).any() else np.zeros_like(front)
            seen |= front
        labels[seen & (labels < 0)] = name
        name += 1
    return labels


def dbscan_grid(m: DataFrame, points: int = 36, min_samples: tuple[int, ...] = (3, 4, 5, 8, 10, 15), most: int = GRID_MOST) -> DataFrame:
    """Clusters, noise and silhouette for a grid of settings, over one distance matrix of a bounded sample."""
    x = _matrix(bounded(m, most))
    d = _distances(x, x)
    fifth = np.sort(d, axis=1)[:, min(4, len(x) - 1)]
    low, high = 0.7 * np.percentile(fifth, 2), 1.6 * np.percentile(fifth, 99)
    low, high = (low, high) if high > low > 0 else (0.1, 2.0)
    rows = []
    for eps in np.linspace(low, high, points):
        for ms in min_samples:
            y = dbscan_labels(d, eps, ms)
            inside = y >= 0
            k = len(np.unique(y[inside]))
            s = float(silhouette_points(x[inside], y[inside]).mean()) if k > 1 else None
            noise = int((~inside).sum())
            rows.append((float(eps), ms, k, noise, 100.0 * noise / len(y), s, s * float(inside.mean()) if s is not None else None))
    return m.sparkSession.createDataFrame(rows, "eps double, min_samples int, clusters int, ruido int, `%_ruido` double, silueta double, silueta_con_ruido double")


def recommend_dbscan(grid: DataFrame, most_noise: float = 30.0) -> DataFrame:
    good = grid.filter("silueta is not null")
    inside = good.filter((F.col("%_ruido") >= 0.5) & (F.col("%_ruido") <= most_noise))
    return (inside if not inside.isEmpty() else good).orderBy(F.desc("silueta"), F.asc("%_ruido")).limit(1)


def external_validation(df: DataFrame, cluster: str, reference: str) -> DataFrame:
    """ari, nmi (arithmetic) and n against a reference, from the contingency table."""
    cells = df.groupBy(F.col(cluster).cast("string").alias("a"), N.as_label(N.q(reference)).alias("b")).agg(F.count("*").cast("double").alias("n"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("cb"))
    two = lambda c: c * (c - 1) / 2
    nlog = lambda c: c * F.ln(c)
    t = cells.agg(F.sum(two(F.col("n"))).alias("sij"), F.sum("n").alias("n"), F.sum(nlog(F.col("n"))).alias("lij"))
    t = t.crossJoin(rows.agg(F.sum(two(F.col("ra"))).alias("si"), F.sum(nlog(F.col("ra"))).alias("li"))).crossJoin(cols.agg(F.sum(two(F.col("cb"))).alias("sj"), F.sum(nlog(F.col("cb"))).alias("lj")))  # single rows
    expected = F.col("si") * F.col("sj") / F.nullif(two(F.col("n")), F.lit(0.0))
    ari = F.coalesce(S.ratio(F.col("sij") - expected, F.nullif((F.col("si") + F.col("sj")) / 2 - expected, F.lit(0.0))), F.lit(1.0))
    n = F.col("n")
    ha, hb = F.ln(n) - F.col("li") / n, F.ln(n) - F.col("lj") / n
    mi = F.ln(n) + (F.col("lij") - F.col("li") - F.col("lj")) / n
    nmi = F.coalesce(S.ratio(mi, F.nullif((ha + hb) / 2, F.lit(0.0))), F.lit(1.0))
    return t.select(ari.alias("ari"), nmi.alias("nmi"), n.cast("long").alias("n"))


def best_matching(table: dict[tuple, int]) -> tuple[dict, float]:
    """The one-to-one matching of clusters and classes with most rows in common, and their share (a k by k assignment)."""
    rows, cols = sorted({a for a, _ in table}), sorted({b for _, b in table})
    k = max(len(rows), len(cols))
    cost = np.zeros((k + 1, k + 1))
    for (a, b), n in table.items():
        cost[rows.index(a) + 1, cols.index(b) + 1] = -n
    u, v, match, way = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1, dtype=int), np.zeros(k + 1, dtype=int)
    for i in range(1, k + 1):
        match[0], j = i, 0
        least, used = np.full(k + 1, np.inf), np.zeros(k + 1, dtype=bool)
        while True:
            used[j] = True
            free = ~used
            free[0] = False
            gap = cost[match[j]] - u[match[j]] - v
            better = free & (gap < least)
            least[better], way[better] = gap[better], j
            nxt = int(np.argmin(np.where(free, least, np.inf)))
            step = least[nxt]
            u[match[used]] += step
            v[used] -= step
            least[free] -= step
            j = nxt
            if match[j] == 0:
                break
        while j:
            match[j] = match[way[j]]
            j = way[j]
    pairs = {rows[match[j] - 1]: cols[j - 1] for j in range(1, len(cols) + 1) if match[j] - 1 < len(rows)}
    total = sum(table.values())
    return pairs, sum(table.get((a, b), 0) for a, b in pairs.items()) / max(total, 1)


# --- profiles ---------------------------------------------------------------------------------


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    counts = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n_registros"))
    share = S.percent(F.col("n_registros"), F.sum("n_registros").over(W.partitionBy()))  # a row a cluster
    return counts.select("cluster", "n_registros", share.alias("%_del_total"), F.when(F.col("cluster").cast("string") == "-1", "Ruido").otherwise(F.concat(F.lit("Segmento "), F.col("cluster").cast("string"))).alias("etiqueta"))


def profile_clusters(df: DataFrame, cluster: str, features: list[str]) -> DataFrame:
    """How each cluster differs from the whole, by variable, in standard deviations."""
    out = None
    for c in features:
        if N.is_numeric(df, c):
            x = P.to_float(N.q(c))
            whole = df.agg(F.avg(x).alias("gm"), F.stddev_pop(x).alias("gs"))
            per = df.groupBy(F.col(cluster).alias("cluster")).agg(F.avg(x).alias("m"), F.count(x).alias("n")).crossJoin(F.broadcast(whole))  # one row
            per = O.with_median(per, df, "cluster", F.col(cluster), x, "med")
            one = per.select("cluster", F.lit(c).alias("variable"), F.lit("numérica").alias("tipo"), F.col("m").cast("string").alias("valor_cluster"), F.col("med").alias("mediana_cluster"), F.col("gm").cast("string").alias("valor_global"),
                             (100 * S.ratio(F.col("m") - F.col("gm"), F.nullif(F.abs("gm"), F.lit(0.0)))).alias("diferencia_%"), ((F.col("m") - F.col("gm")) / F.when(F.col("gs") != 0, F.col("gs")).otherwise(1.0)).alias("z_diferencia"), "n")
        else:
            cells = df.groupBy(F.col(cluster).alias("cluster"), N.as_label(N.q(c)).alias("v")).agg(F.count("*").alias("k"))
            whole = cells.groupBy("v").agg(F.sum("k").alias("gk"))
            per = cells.join(whole, "v").withColumn("n", F.sum("k").over(W.partitionBy("cluster"))).withColumn("N", F.sum("k").over(W.partitionBy()))
            best = per.withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("k"), "v"))).filter("r = 1")
            share, g = F.col("k") / F.col("n"), F.col("gk") / F.col("N")
            sd = F.sqrt(g * (1 - g))
            one = best.select("cluster", F.lit(c).alias("variable"), F.lit("categórica").alias("tipo"), F.col("v").alias("valor_cluster"), F.lit(None).cast("double").alias("mediana_cluster"), F.round(100 * g, 2).cast("string").alias("valor_global"),
                              (100 * (share - g)).alias("diferencia_%"), ((share - g) / F.when(sd != 0, sd).otherwise(1.0)).alias("z_diferencia"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def centroids_table(df: DataFrame, cluster: str, features: list[str]) -> DataFrame:
    """Means by cluster and, in row GLOBAL, of all: one rollup."""
    means = [F.avg(P.to_float(N.q(c))).alias(c) for c in features]
    rolled = df.withColumn("cluster", F.col(cluster).cast("string")).rollup("cluster").agg(F.grouping("cluster").alias("__g"), *means)
    return rolled.select(F.when(F.col("__g") == 1, "GLOBAL").otherwise(F.col("cluster")).alias("cluster"), *[N.q(c) for c in features])


def target_by_cluster(df: DataFrame, cluster: str, target: str) -> DataFrame:
    x = P.to_float(N.q(target))
    whole = df.agg(F.avg(x).alias("g"))
    per = df.groupBy(F.col(cluster).alias("cluster")).agg(F.avg(x).alias("promedio"), F.min(x).alias("minimo"), F.max(x).alias("maximo"), F.count(x).alias("n")).crossJoin(F.broadcast(whole))  # one row
    per = O.with_median(per, df, "cluster", F.col(cluster), x, "mediana").withColumn("vs_global_%", 100 * S.ratio(F.col("promedio") - F.col("g"), F.nullif(F.abs("g"), F.lit(0.0))))
    return per.select("cluster", "promedio", "mediana", "minimo", "maximo", "n", "vs_global_%")


def name_clusters(df: DataFrame, cluster: str, features: list[str], traits: int = 2) -> DataFrame:
    """A name for each cluster from its most distinctive traits."""
    p = profile_clusters(df, cluster, features).withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy(F.abs("z_diferencia").desc(), "variable"))).filter(F.col("r") <= traits)
    phrase = F.when(F.col("tipo") == "numérica", F.concat("variable", F.when(F.col("z_diferencia") >= 0, " alto").otherwise(" bajo"))).otherwise(F.concat("variable", F.lit(" = "), "valor_cluster"))
    named = p.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", phrase.alias("t")))), lambda x: x["t"]), " · ").alias("caracteristicas"))
    return cluster_sizes(df, cluster).join(named, "cluster").select("cluster", F.concat(F.lit("Segmento "), F.col("cluster").cast("string"), F.lit(": "), "caracteristicas").alias("nombre_sugerido"), "n_registros", "%_del_total", "caracteristicas")


# --- projection -------------------------------------------------------------------------------


def pca(m: DataFrame, k: int = 2) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Centred scores (adds ``scores``), the variance table and the loadings."""
    mean = np.array([r["m"] for r in m.select(F.posexplode(vector_to_array("features")).alias("p", "v")).groupBy("p").agg(F.avg("v").alias("m")).orderBy("p").collect()])
    k = min(k, len(mean))
    model = PCA(k=k, inputCol="features", outputCol="__pc").fit(m)
    shift = [float(v) for v in model.pc.toArray().T @ mean]
    scores = F.zip_with(vector_to_array("__pc"), F.array(*[F.lit(v) for v in shift]), lambda a, b: a - b)
    ratio = model.explainedVariance.toArray()
    table = m.sparkSession.createDataFrame([(f"PC{i + 1}", float(100 * v), float(100 * ratio[: i + 1].sum())) for i, v in enumerate(ratio)], "componente string, `varianza_%` double, `acumulada_%` double")
    return model.transform(m).withColumn("scores", scores).drop("__pc"), table, model.pc.toArray()


def project(m: DataFrame, key: str, method: str = "PCA", perplexity: float = 30.0) -> tuple[DataFrame, dict]:
    """(key, dim_1, dim_2) of all rows by principal components or t-SNE, and what was done; another method is taken as PCA."""
    from . import projection  # it builds on this module

    if method == "t-SNE":
        if m.select("features").distinct().limit(8).count() >= 8:
            return projection.tsne(m, key, perplexity), {"metodo": "t-SNE", "perplexity": perplexity}
        info = {"metodo": "PCA", "aviso": "Muy pocos registros para t-SNE: se muestra PCA."}
    else:
        info = {"metodo": "PCA"}
    scores, table, loadings = pca(m, 2)
    dim = lambda k: F.coalesce(F.get("scores", F.lit(k)), F.lit(0.0)).alias(f"dim_{k + 1}")
    return scores.select(N.q(key), dim(0), dim(1)), info | {"varianza": table, "loadings": loadings}


def as_vector(column: str) -> Column:
    return array_to_vector(F.transform(F.col(column), lambda v: v.cast("double")))


def assign_new(model, rows: DataFrame) -> DataFrame | None:
    return model.transform(rows) if hasattr(model, "transform") else None


def detect_reference(df: DataFrame) -> list[str]:
    """Columns that look like known labels: a telling name and 2 to 20 values."""
    words = ("label", "class", "clase", "target", "segment", "cluster", "grupo", "group", "tipo", "categoria")
    some = [c for c in N.data_columns(df) if any(w in c.lower() for w in words)]
    counts = df.agg(*[F.count_distinct(N.q(c)).alias(c) for c in some]).first() if some else {}
    return [c for c in some if 2 <= counts[c] <= 20]


#: Names of columns that hold the real groups, which must not be clustered on.
LABEL_NAME = re.compile(
    r"^(cultivar|clase|class|target|label|labels|etiqueta|objetivo|y|grupo|group|cluster|segmento|segment|categoria|category|especie|species|variedad|"
    r"variety|outcome|resultado|diagnostico|diagnosis)(_?\d+)?$"
)
NEAR_CONSTANT, GAPS_MOST = 0.95, 0.5


def suggest_features(df: DataFrame, roles: dict, most: int = 15, exclude: Sequence[str] = (), close: float = 0.85, categorical: bool = False, drop_redundant: bool = False) -> DataFrame:
    """Which columns to cluster on, and why: (variable, rol, sugerida, motivo), the suggested ones first, each part in the order of the table.

    Left out are excluded columns, identifiers, constants, columns named like a label with 2 to 20 values, dates, free text, categories (unless ``categorical``; numeric codes are numbers),
    columns of one value but for a twentieth, those of nulls by more than half, and numbers beyond the ``most`` of largest relative
    variation. Closely correlated numbers are noted, and left out only if ``drop_redundant``. Of all rows, in three passes and one more for categories.
    """
    columns = N.data_columns(df)
    role = {c: roles[c].role if c in roles else "?" for c in columns}
    value = {c: F.when(~F.isnan(N.q(c)), N.q(c)) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else N.q(c) for c in columns}
    named = [c for c in columns if LABEL_NAME.match(N.normalize_names([c])[0]) and not N.is_nested(df, c)]
    kinds = dict(zip(named, df.agg(*[F.count_distinct(value[c]) for c in named]).first(), strict=True)) if named else {}

    def barred(c: str) -> str | None:
        fixed = {"id": "identificador: agruparía por código, no por comportamiento", "constante": "constante: no tiene variación"}
        if c in exclude:
            return "excluida: es la variable objetivo o la de referencia"
        if role[c] in fixed:
            return fixed[role[c]]
        if 2 <= kinds.get(c, 0) <= 20:
            return "parece la etiqueta real (clase/grupo): úsala como referencia para validar, nunca para agrupar"
        if role[c] == "fecha":
            return "fecha: extrae año/mes en ETL si la quieres usar"
        if role[c] == "texto":
            return "texto libre o alta cardinalidad"
        if role[c] in ("categorica", "booleana") and not N.is_numeric(df, c) and not categorical:
            return "categórica: actívalas si quieres incluirlas (se codifican one-hot)"
        return None

    reasons = {c: barred(c) for c in columns}
    some = [c for c in columns if reasons[c] is None]
    numbers = [c for c in some if N.is_numeric(df, c)]
    levels = O.tallies(df, {c: N.q(c) for c in some if c not in numbers}, "string")
    facts = {}
    if some:
        x = {c: value[c].cast("double") for c in numbers}
        more = {c: [F.avg(x[c]).alias("mean"), F.stddev_samp(x[c]).alias("sd"), F.percentile_approx(value[c], 0.5).alias("mid")] for c in numbers}
        facts = dict(zip(some, df.agg(*[F.struct(F.count(value[c]).alias("n"), F.count("*").alias("rows"), *more.get(c, [])).alias(f"v{k}") for k, c in enumerate(some)]).first(), strict=True))
    top = {c: k for c, (_, _, k) in levels.items()}
    if numbers:  # a value of more than half the rows is the median
        top |= dict(zip(numbers, df.agg(*[F.count_if(value[c] == F.lit(facts[c]["mid"])).alias(f"v{k}") for k, c in enumerate(numbers)]).first(), strict=True))
    for c in some:
        n, rows = facts[c]["n"], facts[c]["rows"]
        if n and top[c] / n > NEAR_CONSTANT:
            reasons[c] = f"casi constante ({100 * top[c] / n:.0f}% es un solo valor)"
        elif rows and (rows - n) / rows > GAPS_MOST:
            reasons[c] = f"{100 * (rows - n) / rows:.0f}% de nulos"
    numbers = [c for c in numbers if reasons[c] is None]

    def variation(c: str) -> float:
        mean, sd = facts[c]["mean"], facts[c]["sd"]
        if facts[c]["n"] < 2:
            return 0.0
        return abs(sd / mean) if mean and math.isfinite(mean) else sd or 0.0

    from .eda import corr_pearson

    bound = {frozenset((r["variable_1"], r["variable_2"])): abs(r["correlacion"] or 0.0) for r in corr_pearson(df, numbers).collect()} if len(numbers) > 1 else {}
    allowed = set(sorted(numbers, key=variation, reverse=True)[:most])
    kept: list[str] = []
    out = []
    for c in columns:
        if reasons[c]:
            out.append((c, role[c], False, reasons[c]))
        elif c not in numbers:
            out.append((c, role[c], categorical, f"categórica con {levels[c][0]} niveles" if categorical else "categórica (no incluida)"))
        else:
            twin = next(((e, r) for e in kept if (r := bound[frozenset((c, e))]) > close), None)
            told = f"con {twin[0]} (r = {twin[1]:.2f})" if twin else ""
            if c not in allowed:
                out.append((c, role[c], False, f"fuera del top {most} por variabilidad"))
            elif twin and drop_redundant:
                out.append((c, role[c], False, f"redundante {told}"))
            else:
                kept.append(c)
                out.append((c, role[c], True, f"numérica · ojo: muy correlacionada {told}" if twin else f"numérica, variabilidad relativa {variation(c):.2f}"))
    return df.sparkSession.createDataFrame(sorted(out, key=lambda r: not r[2]), "variable string, rol string, sugerida boolean, motivo string")
