"""Why a model says what it says: importances, partial dependence, Shapley values, consensus."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import parsing as P
from ..functions import stats as S
from ..plans import order as O
from ..sources import workspace
from .clustering import bounded
from .learning import Preprocessor, evaluate, spread, variable_of
from .metrics import LOWER_IS_BETTER, regression_columns

PERMUTATION_MOST, REPEATS, SHAP_ROWS, SHAP_BACKGROUND = 4_000, 8, 500, 80


def aggregate_importance(values: DataFrame) -> DataFrame:
    """(variable, importancia) summed by variable, with shares and their running sum."""
    per = values.groupBy("variable").agg(F.sum(F.abs("importancia")).alias("importancia"))
    share = per.withColumn("importancia_%", 100 * S.ratio(F.col("importancia"), F.nullif(F.sum("importancia").over(W.partitionBy()), F.lit(0.0))))
    running = W.orderBy(F.desc("importancia"), "variable").rowsBetween(W.unboundedPreceding, 0)  # a row a variable
    return share.withColumn("acumulado_%", F.sum("importancia_%").over(running))


def _weights(model) -> np.ndarray | None:
    if hasattr(model, "featureImportances"):
        return np.array(model.featureImportances.toArray())
    if hasattr(model, "coefficientMatrix"):
        return np.array(model.coefficientMatrix.toArray())
    if hasattr(model, "coefficients"):
        return np.array(model.coefficients.toArray())
    return None


def native_importance(spark, model, ready: Preprocessor, columns: list[str]) -> DataFrame | None:
    w = _weights(model)
    if w is None:
        return None
    mean = np.abs(w).mean(axis=0) if w.ndim > 1 else np.abs(w)
    rows = [(variable_of(f, columns), float(v)) for f, v in zip(ready.names, mean, strict=True)]
    return aggregate_importance(spark.createDataFrame(rows, "variable string, importancia double"))


def signed_coefficients(spark, model, ready: Preprocessor, columns: list[str]) -> DataFrame | None:
    w = _weights(model)
    if w is None or hasattr(model, "featureImportances"):
        return None
    mean = w.mean(axis=0) if w.ndim > 1 else w
    rows = [(f, float(v), variable_of(f, columns), "aumenta" if v > 0 else "disminuye") for f, v in zip(ready.names, mean, strict=True)]
    return spark.createDataFrame(rows, "feature string, coeficiente double, variable string, efecto string").orderBy(F.abs("coeficiente").desc(), "feature")


def _numbered(df: DataFrame, seed: int, key: list[str]) -> DataFrame:
    """``df`` with ``__n``, its place in an order drawn by hash of ``key``: rows are numbered in 4,096 ranges of the hash, which start where the one before ends."""
    rows = df.withColumn("__d", F.xxhash64(F.lit(seed), *[N.q(k) for k in key])).withColumn("__b", F.shiftrightunsigned("__d", 52))
    sizes = rows.groupBy("__b").agg(F.count("*").alias("__k"))
    before = W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)  # 4,096 rows
    heads = sizes.select("__b", F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__o"))
    inside = W.partitionBy("__b").orderBy("__d", *[N.q(c) for c in df.columns])  # rows that tie are equal
    return rows.withColumn("__i", F.row_number().over(inside)).join(F.broadcast(heads), "__b").select(*[N.q(c) for c in df.columns], (F.col("__o") + F.col("__i")).alias("__n"))


def _metric_by(out: DataFrame, group: str, values: list[str], task: str, metric: str) -> dict[str, float]:
    """The metric for each value of ``group``."""
    if task == "regresion" and (column := regression_columns().get(metric)) is not None:
        return {r[0]: r[1] for r in out.groupBy(group).agg(column).collect()}  # a row a value
    return {v: evaluate(out.filter(F.col(group) == v), task)[metric] for v in values}


def permutation_importance(df: DataFrame, model, ready: Preprocessor, features: list[str], key: list[str], task: str, metric: str, repeats: int = REPEATS) -> DataFrame:
    """How much the metric falls when a column is shuffled among all rows; negative falls count as 0.

    A repeat numbers the rows in two drawn orders and gives each row the values of the row with its number, so all values of a column are dealt anew;
    each column in turn takes them. So a repeat shuffles the rows twice and predicts each as often as there are columns.
    """
    sign = -1 if metric in LOWER_IS_BETTER else 1
    base = _metric_by(model.transform(ready.transform(df)).withColumn("__variable", F.lit("")), "__variable", [""], task, metric)[""]
    own, keys, given = [f"__x{j}" for j in range(len(features))], [f"__k{j}" for j in range(len(key))], [f"__v{j}" for j in range(len(features))]
    rows = df.select("label", *[N.q(c).alias(x) for c, x in zip(features, own, strict=True)], *[N.q(c).alias(k) for c, k in zip(key, keys, strict=True)])
    placed = workspace.keep(_numbered(rows, -1, keys).select("label", *own, "__n"), "placed")
    falls: dict[str, list[float]] = {c: [] for c in features}
    for seed in range(repeats):
        pairs = placed.join(_numbered(rows, seed, keys).select("__n", *[F.col(x).alias(v) for x, v in zip(own, given, strict=True)]), "__n")
        shapes = [F.struct(F.lit(c).alias("__variable"), *[F.col(given[j] if j == at else own[j]).alias(f) for j, f in enumerate(features)]) for at, c in enumerate(features)]
        out = model.transform(ready.transform(pairs.select("label", F.inline(F.array(*shapes)))))
        for c, score in _metric_by(out, "__variable", features, task, metric).items():
            falls[c].append(sign * (base - score))
    workspace.drop(placed)
    table = df.sparkSession.createDataFrame([(c, max(float(np.mean(f)), 0.0), float(np.std(f))) for c, f in falls.items()], "variable string, importancia double, desv_std double")
    return aggregate_importance(table).join(table.select("variable", "desv_std"), "variable")


def _output(model_out: DataFrame):
    return F.element_at(vector_to_array("probability"), -1) if "probability" in model_out.columns else F.col("prediction")


def partial_dependence(df: DataFrame, model, ready: Preprocessor, feature: str, points: int = 25, most: int = PERMUTATION_MOST) -> DataFrame:
    """Mean prediction as one column takes values between its 5th and 95th percentile (or each of its values, if few), over a bounded sample."""
    some = bounded(df, most)
    if N.is_numeric(df, feature):
        x = P.to_float(N.q(feature))
        values = sorted(r["v"] for r in some.select(x.alias("v")).dropna().distinct().limit(points + 1).collect())
        if len(values) > points:
            low, high = O.quantiles(some, {0: (x, (0.05, 0.95))})[0]
            values = [low + (high - low) * k / (points - 1) for k in range(points)]
    else:
        values = [r["v"] for r in some.groupBy(N.q(feature).cast("string").alias("v")).count().filter("v is not null").orderBy(F.desc("count"), "v").limit(points).collect()]
    grid = some.withColumn(feature, F.explode(F.array(*[F.lit(v) for v in values])))
    out = model.transform(ready.transform(grid))
    return out.groupBy(N.q(feature)).agg(F.avg(_output(out)).alias("prediccion_promedio")).orderBy(N.q(feature))


def trend_text(curve: DataFrame) -> str:
    rows = [r["prediccion_promedio"] for r in curve.collect()]
    if len(rows) < 2 or abs(rows[-1] - rows[0]) < 1e-9:
        return "sin efecto claro"
    return "creciente" if rows[-1] > rows[0] else "decreciente"


def linear_shap(m: DataFrame, model) -> DataFrame:
    """Exact for linear models: coefficient times the distance from the mean, an array a row."""
    w = [float(v) for v in np.atleast_2d(_weights(model))[-1]]
    mean = [r["a"] for r in m.select(F.posexplode(vector_to_array("features")).alias("p", "v")).groupBy("p").agg(F.avg("v").alias("a")).orderBy("p").collect()]
    part = F.zip_with(F.zip_with(vector_to_array("features"), F.array(*[F.lit(v) for v in mean]), lambda x, a: x - a), F.array(*[F.lit(v) for v in w]), lambda d, c: d * c)
    return m.withColumn("shap", part)


@dataclass
class TreeLeaf:
    """A leaf's value, and for each feature on its path: its place, the interval (low, high] or set that leads here, and the share of rows that take its splits."""

    value: float
    features: list[int]
    low: list[float]
    high: list[float]
    sets: list[frozenset | None]
    share: np.ndarray
    cover: float

    def meets(self, x: np.ndarray) -> np.ndarray:
        """rows x features of the path: does the row's value lead here."""
        out = np.empty((len(x), len(self.features)), dtype=bool)
        for k, (j, low, high, own) in enumerate(zip(self.features, self.low, self.high, self.sets, strict=True)):
            v = x[:, j]
            out[:, k] = (v > low) & (v <= high)
            if own is not None:
                out[:, k] &= np.isin(v, list(own))
        return out


def tree_leaves(spark, model) -> list[TreeLeaf]:
    """Leaves of a fitted tree or forest, read from the nodes that Spark saves; values are scaled by the trees' weights.

    A forest of classes gives the probability of the last class, boosted classes their margin, a tree or forest of numbers its prediction.
    """
    path = workspace.fresh(spark, "trees")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    ensemble = "nodeData" in nodes.columns
    flat = nodes.select("treeID", "nodeData.*") if ensemble else nodes.withColumn("treeID", F.lit(0))
    boosted = "GBT" in type(model).__name__
    weights = {i: w for i, w in enumerate(model.treeWeights)} if boosted else dict.fromkeys(range(model.getNumTrees if ensemble else 1), 1.0 / (model.getNumTrees if ensemble else 1))
    classes = hasattr(model, "numClasses") and not boosted
    trees: dict[int, dict[int, object]] = {}
    for r in flat.select("treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild", "split").collect():  # the model's nodes
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    out: list[TreeLeaf] = []
    for tree, known in trees.items():
        cover = {i: float(sum(r["impurityStats"])) if classes else float(r["impurityStats"][0]) for i, r in known.items()}
        todo: list[tuple[int, dict[int, tuple[float, float, frozenset | None, float]]]] = [(0, {})]
        while todo:
            i, path_ = todo.pop()
            r = known[i]
            if r["leftChild"] < 0:
                stats = r["impurityStats"]
                value = stats[-1] / max(sum(stats), 1e-300) if classes else r["prediction"]
                own = sorted(path_)
                out.append(TreeLeaf(value * weights[tree], own, *([path_[j][k] for j in own] for k in range(3)), np.array([path_[j][3] for j in own]), cover[i] / max(cover[0], 1e-300)))
                continue
            split = r["split"]
            j, given = split["featureIndex"], split["leftCategoriesOrThreshold"]
            low, high, own, share = path_.get(j, (-math.inf, math.inf, None, 1.0))
            for child, left in ((r["leftChild"], True), (r["rightChild"], False)):
                part = share * cover[child] / max(cover[i], 1e-300)
                if split["numCategories"] < 0:
                    step = (low, min(high, given[0]), own, part) if left else (max(low, given[0]), high, own, part)
                else:
                    side = frozenset(given) if left else frozenset(float(c) for c in range(split["numCategories"])) - frozenset(given)
                    step = (low, high, side if own is None else own & side, part)
                todo.append((child, path_ | {j: step}))
    return out


def leaf_shares(met: np.ndarray, share: np.ndarray) -> np.ndarray:
    """For each row of ``met`` (rows x features) the Shapley share of each feature in a leaf of value 1.

    The value of a set of features is the product of what is met inside the set and of the shares outside. Sums over sets of a size are
    coefficients of the product of (share + met t) over the other features.
    """
    rows, m = met.shape
    weight = [math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)]
    out = np.zeros((rows, m))
    for i in range(m):
        c = np.zeros((rows, m))
        c[:, 0] = 1.0
        for j in range(m):
            if j != i:
                up = np.zeros_like(c)
                up[:, 1:] = c[:, :-1] * met[:, j, None]
                c = c * share[j] + up
        out[:, i] = (met[:, i] - share[i]) * (c @ weight)
    return out


def path_codes(leaf: TreeLeaf, x: np.ndarray) -> np.ndarray:
    """Each row's features of the path that lead to the leaf, as the bits of a number."""
    return leaf.meets(x) @ (1 << np.arange(len(leaf.features), dtype=np.int64))


CODED_MOST = 10  # features of a path up to which the shares of all its codes are worked out once a leaf


def coded_shares(leaf: TreeLeaf) -> np.ndarray | None:
    """The leaf's part in the Shapley values for every code of its path; None for a long path."""
    m = len(leaf.features)
    if m > CODED_MOST:
        return None
    met = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
    return leaf.value * leaf_shares(met, leaf.share)


def tree_shap(m: DataFrame, model) -> tuple[DataFrame, float]:
    """``m`` with ``shap``: exact path-dependent Shapley values of a tree, forest or boosted trees, an array a row; and the base value.

    base + sum(shap) is the model's output (see ``tree_leaves``). All rows are explained, by Arrow batch; rows that meet a leaf's path alike share the work.
    """
    leaves = tree_leaves(m.sparkSession, model)
    width = model.numFeatures
    known = [coded_shares(leaf) for leaf in leaves if leaf.features]

    def run(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        a = np.stack(x.to_numpy())
        out = np.zeros((len(a), width))
        for leaf, shares in zip((leaf for leaf in leaves if leaf.features), known, strict=True):
            code = path_codes(leaf, a)
            if shares is None:
                some, code = np.unique(code, return_inverse=True)
                shares = leaf.value * leaf_shares((some[:, None] >> np.arange(len(leaf.features)) & 1).astype(float), leaf.share)
            out[:, leaf.features] += shares[code]
        return pd.Series(list(out))

    base = float(sum(leaf.value * leaf.cover for leaf in leaves))
    return spread(m).withColumn("shap", F.pandas_udf(run, "array<double>")(vector_to_array("features"))), base


def shap_importance(explained: DataFrame, ready: Preprocessor, columns: list[str]) -> DataFrame:
    """Mean absolute Shapley value by feature, summed by variable."""
    each = explained.select(F.posexplode("shap").alias("pos", "v")).groupBy("pos").agg(F.avg(F.abs("v")).alias("importancia"))
    names = explained.sparkSession.createDataFrame([(k, variable_of(f, columns)) for k, f in enumerate(ready.names)], "pos int, variable string")
    return aggregate_importance(each.join(names, "pos").select("variable", "importancia"))


def sampled_shap(m: DataFrame, model, d: int, draws: int = 20, most: int = SHAP_ROWS, background: int = SHAP_BACKGROUND, seed: int = 5) -> DataFrame:
    """Monte-Carlo Shapley values of a bounded number of rows for any model: (row, pos, shap)."""
    rng = np.random.default_rng(seed)
    rows = [r["f"] for r in bounded(m.select("features"), most).select(vector_to_array("features").alias("f")).collect()]
    back = [r["f"] for r in bounded(m.select("features"), background, seed).select(vector_to_array("features").alias("f")).collect()]
    steps = []
    for i, x in enumerate(rows):
        for k in range(draws):
            z, order = list(back[rng.integers(len(back))]), rng.permutation(d)
            steps.append((i, k, -1, list(z)))
            for at, j in enumerate(order):
                z[j] = x[j]
                steps.append((i, k, int(at) * d + int(j), list(z)))
    frame = m.sparkSession.createDataFrame(steps, "row int, draw int, step int, f array<double>").withColumn("features", array_to_vector("f"))
    out = model.transform(frame)
    out = out.select("row", "draw", "step", _output(out).alias("y"))
    gain = F.col("y") - F.lag("y").over(W.partitionBy("row", "draw").orderBy("step"))
    return out.withColumn("g", gain).filter("step >= 0").groupBy("row", F.pmod("step", F.lit(d)).alias("pos")).agg(F.avg("g").alias("shap"))


def top_features(importance: DataFrame, k: int = 10) -> DataFrame:
    return importance.orderBy(F.desc("importancia_%"), "variable").limit(k)


def features_for_share(importance: DataFrame, share: float = 80.0) -> int:
    return importance.filter(F.col("acumulado_%") - F.col("importancia_%") < share).count()


def importance_consensus(methods: dict[str, DataFrame]) -> DataFrame:
    """Ranks by method (ties take the smallest) and their mean over the methods that have the variable; mean share with absent as 0."""
    out = None
    for name, table in methods.items():
        one = table.select("variable", F.col("`importancia_%`").alias(f"%_{name}"))
        one = one.withColumn(f"rank_{name}", F.rank().over(W.orderBy(F.desc(F.col(f"`%_{name}`")))))  # a row a variable
        out = one if out is None else out.join(one, "variable", "full")
    ranks = [F.col(f"rank_{n}") for n in methods]
    known = sum((r.isNotNull().cast("int") for r in ranks), F.lit(0))
    mean = sum((F.coalesce(r, F.lit(0)) for r in ranks), F.lit(0)) / known
    share = sum((F.coalesce(F.col(f"`%_{n}`"), F.lit(0.0)) for n in methods), F.lit(0.0)) / len(methods)
    return out.withColumn("rank_promedio", mean).withColumn("importancia_promedio_%", share).orderBy("rank_promedio", "variable")
