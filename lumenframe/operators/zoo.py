"""Models that Spark ML lacks, from its parts: ridge classifier, AdaBoost, nearest neighbours.

Each has ``fit(df)`` over (features, label), which gives a model whose ``transform`` adds ``prediction`` and, for classes, ``probability``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import space as X


def _classes(df: DataFrame) -> int:
    return int(df.agg(F.max("label")).first()[0]) + 1


def _best(scores: list[Column]) -> Column:
    """The place of the largest score, the first of equal ones."""
    listed = F.array(*scores)
    return (F.array_position(listed, F.array_max(listed)) - 1).cast("double")


# --- ridge classifier -------------------------------------------------------------------------


@dataclass
class RidgeClassifier:
    """Least squares with a quadratic penalty on -1 and 1, a model a class (one for two classes); no probabilities."""

    alpha: float = 1.0
    weight: str | None = None

    def fit(self, df: DataFrame) -> RidgeModel:
        k = _classes(df)
        parts = []
        for c in [1] if k == 2 else range(k):
            own = df.withColumn("__t", F.when(F.col("label") == c, 1.0).otherwise(-1.0))
            facts = own.agg(F.sum(self.weight or F.lit(1.0)).alias("n"), F.stddev_samp("__t").alias("sd")).first()
            fitted = R.LinearRegression(labelCol="__t", solver="l-bfgs", elasticNetParam=0.0, standardization=False, regParam=self.alpha * (facts["sd"] or 1.0) / max(facts["n"], 1), maxIter=500, tol=1e-10,
                                        **({"weightCol": self.weight} if self.weight else {})).fit(own)
            parts.append((fitted.coefficients.toArray().tolist(), float(fitted.intercept)))
        return RidgeModel(parts)


@dataclass
class RidgeModel:
    parts: list[tuple[list[float], float]]

    def transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array("features")
        dot = lambda w, b: F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda u, v: u * v), F.lit(b), lambda s, v: s + v)
        scores = [dot(*p) for p in self.parts]
        return df.withColumn("prediction", (scores[0] > 0).cast("double") if len(scores) == 1 else _best(scores))


# --- boosting by weights ----------------------------------------------------------------------


def tree_column(node, x: Column) -> Column:
    """A fitted tree of continuous splits as an expression over the array ``x``."""
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    at = node.split()
    return F.when(F.element_at(x, at.featureIndex() + 1) <= float(at.threshold()), tree_column(node.leftChild(), x)).otherwise(tree_column(node.rightChild(), x))


CARRIED = 8  # trees that weights are an expression of; the sum over those before is held as a column


class Carried:
    """``df`` with ``__t``, the sum over the rounds so far. Every ``CARRIED`` rounds it is held, so that neither a round's plan nor its work for a row grows with the rounds."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df.select("features", "label", F.lit(0.0).alias("__t"))
        self.held: list[DataFrame] = []
        self.open: list[Column] = []

    def add(self, term: Column) -> None:
        self.open.append(term)
        if len(self.open) == CARRIED:
            self.df = self.df.select("features", "label", self.total().alias("__t")).persist()
            self.held.append(self.df)
            self.open = []
            self.df.count()
            for old in self.held[:-1]:  # a lost block is worked out again from the rows
                old.unpersist()
            del self.held[:-1]

    def total(self) -> Column:
        return sum(self.open, F.col("__t"))

    def drop(self) -> None:
        for old in self.held:
            old.unpersist()


@dataclass
class AdaBoostClassifier:
    """SAMME over stumps. Weights are an expression of the last stumps and of the sum over those before (``Carried``)."""

    rounds: int = 50
    seed: int = 42

    def fit(self, df: DataFrame) -> AdaBoostClassModel:
        k, carried = _classes(df), Carried(df)
        try:
            return self._boosted(carried, AdaBoostClassModel(k), k)
        finally:
            carried.drop()

    def _boosted(self, carried: Carried, out: AdaBoostClassModel, k: int) -> AdaBoostClassModel:
        x = vector_to_array("features")
        missed = lambda t: (tree_column(t, x) != F.col("label")).cast("double")
        for r in range(self.rounds):
            own = carried.df.withColumn("__w", F.exp(carried.total() - sum(out.alphas)))  # at most 1; only their ratios count
            own = own.withColumn("label", F.col("label").alias("label", metadata={"ml_attr": {"type": "nominal", "vals": [str(c) for c in range(max(k, 2))]}}))  # so no fit counts the classes
            tree = C.DecisionTreeClassifier(labelCol="label", weightCol="__w", maxDepth=1, seed=self.seed + r).fit(own)
            root = tree._java_obj.rootNode()
            facts = own.agg(F.sum(F.col("__w") * missed(root)).alias("bad"), F.sum("__w").alias("all")).first()
            error = facts["bad"] / facts["all"] if facts["all"] else 1.0
            if error >= 1 - 1 / k and out.trees:
                break
            out.models.append(tree)
            out.trees.append(root)
            out.alphas.append(1.0 if error <= 0 or error >= 1 - 1 / k else math.log((1 - error) / error) + math.log(k - 1))
            carried.add(F.lit(out.alphas[-1]) * missed(root))
            if error <= 0 or error >= 1 - 1 / k:
                break
        return out


@dataclass
class AdaBoostClassModel:
    classes: int
    models: list = field(default_factory=list)  # keep the trees' nodes alive
    trees: list = field(default_factory=list)
    alphas: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        k, x, whole = self.classes, vector_to_array("features"), sum(self.alphas) or 1.0
        votes = [F.when(tree_column(t, x) == c, F.lit(a)).otherwise(F.lit(-a / max(k - 1, 1))) for c in range(k) for t, a in zip(self.trees, self.alphas, strict=True)]
        n = len(self.trees)
        scores = [sum(votes[c * n : (c + 1) * n], F.lit(0.0)) / whole for c in range(k)]
        raised = [F.exp(s / max(k - 1, 1)) for s in scores]
        share = F.array(*[e / sum(raised[1:], raised[0]) for e in raised])
        return df.withColumn("prediction", _best(scores)).withColumn("probability", array_to_vector(share))


@dataclass
class AdaBoostRegressor:
    """R2 boosting with linear loss over trees of depth 3, which take the weights as they are in place of drawn samples."""

    rounds: int = 50
    seed: int = 42

    def fit(self, df: DataFrame) -> AdaBoostRegModel:
        carried = Carried(df)
        try:
            return self._boosted(carried, AdaBoostRegModel())
        finally:
            carried.drop()

    def _boosted(self, carried: Carried, out: AdaBoostRegModel) -> AdaBoostRegModel:
        x = vector_to_array("features")
        gap = lambda t: F.abs(tree_column(t, x) - F.col("label"))
        for r in range(self.rounds):
            own = carried.df.withColumn("__w", F.exp(carried.total()))
            tree = R.DecisionTreeRegressor(labelCol="label", weightCol="__w", maxDepth=3, seed=self.seed + r).fit(own)
            root = tree._java_obj.rootNode()
            facts = own.agg(F.max(gap(root)).alias("worst"), F.sum(F.col("__w") * gap(root)).alias("bad"), F.sum("__w").alias("all")).first()
            loss = facts["bad"] / facts["worst"] / facts["all"] if facts["worst"] else 0.0
            if loss >= 0.5 and out.trees:
                break
            out.models.append(tree)
            out.trees.append(root)
            out.worst.append(facts["worst"] or 1.0)
            out.betas.append(loss / (1 - loss) if 0 < loss < 0.5 else 1e-10 if loss <= 0 else math.exp(-1))
            carried.add(F.lit(math.log(out.betas[-1])) * (1 - gap(root) / out.worst[-1]))
            if loss <= 0 or loss >= 0.5:
                break
        return out


@dataclass
class AdaBoostRegModel:
    models: list = field(default_factory=list)
    trees: list = field(default_factory=list)
    worst: list[float] = field(default_factory=list)
    betas: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """The weighted median of the trees' values."""
        x, heavy = vector_to_array("features"), [-math.log(b) for b in self.betas]
        told = F.array_sort(F.array(*[F.struct(tree_column(t, x).alias("v"), F.lit(w).alias("w")) for t, w in zip(self.trees, heavy, strict=True)]))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))
        half = sum(heavy) / 2
        step = lambda s, e: F.struct((s["sum"] + e["w"]).alias("sum"), F.coalesce(s["at"], F.when(s["sum"] + e["w"] >= half * (1 - 1e-12), e["v"])).alias("at"))
        return df.withColumn("prediction", F.aggregate(told, start, step)["at"])


# --- nearest neighbours -----------------------------------------------------------------------


@dataclass
class Neighbours:
    """The ``k`` nearest training rows vote, or give their mean. All rows count; blocks of space too far away are not met (``space.nearest``). Ties go to the smaller label."""

    k: int = 15
    classify: bool = True

    def fit(self, df: DataFrame) -> NeighboursModel:
        rows = df.groupBy(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label")).agg(F.count("*").alias("n"))
        return NeighboursModel(rows, self.k, _classes(df) if self.classify else 0)


@dataclass
class NeighboursModel:
    rows: DataFrame
    k: int
    classes: int

    def transform(self, df: DataFrame) -> DataFrame:
        k, width = self.k, len((self.rows.first() or {"x": []})["x"])
        keys = [f"x{j}" for j in range(width)]
        spread = lambda d: d.select("*", *[F.col("x")[j].alias(c) for j, c in enumerate(keys)])

        def kernel(q: pd.DataFrame, r: pd.DataFrame) -> pa.Table | None:
            out = []
            a, b, label, n = q[keys].to_numpy(dtype=float), r[keys].to_numpy(dtype=float), r["label"].to_numpy(), r["n"].to_numpy()
            for part in X.tiles(a, len(b)):
                far = X.squared(a[part], b)
                i, at = X.taken(far, label, k)
                out.append((a[part], i, far[i, at], label[at], n[at], {}))
            return X.lists(out, keys)

        queries = spread(df.select(vector_to_array("features").alias("x")).distinct()).select(*keys)
        blocks = X.leaves_of(spread(self.rows).select(*keys, "label", "n"), keys, "n")
        found = X.nearest(queries, blocks, kernel, ", ".join(f"{c} double" for c in keys) + ", near array<struct<d:double,value:double,n:bigint>>", keys, k)
        found = found.select(F.array(*keys).alias("x"), "near")
        merged = found.groupBy("x").agg(F.flatten(F.collect_list("near")).alias("near")).select("x", B.nearest_of("near", k).alias("top"))
        total = lambda part: F.aggregate("top", F.lit(0.0), lambda s, e: s + part(e))
        size = total(lambda e: e["n"].cast("double"))
        if self.classes:
            shares = [total(lambda e, c=c: F.when(e["value"] == c, e["n"].cast("double")).otherwise(0.0)) / size for c in range(self.classes)]
            told = merged.select(F.col("x").alias("__x"), _best(shares).alias("prediction"), array_to_vector(F.array(*shares)).alias("probability"))
        else:
            told = merged.select(F.col("x").alias("__x"), (total(lambda e: e["value"] * e["n"]) / size).alias("prediction"))
        return df.withColumn("__x", vector_to_array("features")).join(told, "__x", "left").drop("__x")
