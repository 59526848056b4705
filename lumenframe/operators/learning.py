"""Supervised models: task, split, preprocessing, the model zoo, training and comparison."""

from __future__ import annotations

import math
import random
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import parsing as P
from ..functions import stats as S
from ..plans import order as O
from ..plans.fusion import AggFusion
from ..sources import workspace
from . import metrics as M
from . import nets
from . import quality as Q
from . import zoo as Z
from .extra_trees import ExtraTrees

ONE_HOT_MOST, RARE_SHARE = 30, 0.01
SPREAD_LEAST, SPREAD_MOST = 5_000, 8_000_000  # rows of a task at least, and of a table whose files make few tasks
AT_ONCE, AT_ONCE_LARGE = 8, 2  # models fitted together: most of their jobs are too small to fill a cluster; those of large tables fill it, and each holds a copy of its rows
SLOW = ("AdaBoost", "HistGradientBoosting", "Extra Trees", "Gradient Boosting", "Random Forest", "SVM lineal (aprox.)", "MLP", "K-Vecinos (KNN)")  # begun first, so that none is left to run alone
CODES_LISTED, CODES_SENT = 1_000, 100_000  # ordinal codes held in the plan, and sent to all tasks; beyond that they are joined


def detect_task(df: DataFrame, target: str, force: str | None = None) -> str:
    """binaria, multiclase or regresion, from one pass."""
    if force:
        return force
    y = N.q(target)
    if not N.is_numeric(df, target):
        return "binaria" if df.agg(F.count_distinct(y)).first()[0] <= 2 else "multiclase"
    x = P.to_float(y)
    r = df.agg(F.count_distinct(x).alias("k"), F.count(x).alias("n"), F.count_if(x % 1 != 0).alias("broken")).first()
    if r["k"] == 2:
        return "binaria"
    if r["k"] > 2 and not r["broken"] and r["k"] <= 20 and r["k"] / max(r["n"], 1) < 0.05:
        return "multiclase"
    return "regresion"


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as it has rows for, where few small files would leave most of the cluster idle through costly steps; large tables stay as they are read."""
    n = df.count()
    tasks = min(2 * df.sparkSession.sparkContext.defaultParallelism, n // SPREAD_LEAST)
    return df.repartition(tasks) if tasks > 1 and n < SPREAD_MOST else df


def gathered(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` rows in no more tasks than have ``SPREAD_LEAST`` rows each: models pass over a table hundreds of times, and a task costs the same with few rows."""
    return df.coalesce(max(1, min(-(-n // SPREAD_LEAST), SPREAD_MOST // SPREAD_LEAST))) if n < SPREAD_MOST else df


def split(df: DataFrame, target: str | None, key: list[str], test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: the first ceil(test * n) rows of each class by hash of ``key``; stratified if every class has two rows.

    The cut is found from bucketed counts: only the bucket that it falls in, one of 1,024 of each class, is sorted; other rows stay where they are.
    """
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[N.q(k) for k in key]), 12)
    stratum = N.as_label(N.q(target)) if target else F.lit("")
    rows = df.withColumn("__y", stratum).withColumn("__d", draw).withColumn("__b", F.shiftright("__d", 42))
    sizes = rows.groupBy("__y", "__b").agg(F.count("*").alias("k"))
    if target:
        sizes = workspace.keep(sizes, "sizes")  # 1,024 rows a class
        if sizes.groupBy("__y").agg(F.sum("k").alias("n")).filter("n < 2").count():
            rows, sizes = rows.withColumn("__y", F.lit("")), sizes.withColumn("__y", F.lit("")).groupBy("__y", "__b").agg(F.sum("k").alias("k"))
    before = W.partitionBy("__y").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    heads = sizes.select("__y", "__b", "k", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("__o"), F.ceil(F.sum("k").over(W.partitionBy("__y")) * test).alias("__t"))
    cuts = heads.filter((F.col("__o") < F.col("__t")) & (F.col("__t") <= F.col("__o") + F.col("k"))).select("__y", F.col("__b").alias("__c"), (F.col("__t") - F.col("__o")).alias("__left"))
    placed = rows.join(workspace.keep(cuts, "cuts"), "__y", "left").withColumn("__c", F.coalesce("__c", F.lit(-1)))  # a row a class
    columns = [N.q(c) for c in df.columns]
    inside = W.partitionBy("__y").orderBy("__d", *[N.q(k) for k in key])
    cut = placed.filter(F.col("__b") == F.col("__c")).withColumn("is_test", F.row_number().over(inside) <= F.col("__left"))
    rest = placed.filter(F.col("__b") != F.col("__c")).withColumn("is_test", F.col("__b") < F.col("__c"))
    return rest.select(*columns, "is_test").unionByName(cut.select(*columns, "is_test"))


def folds(df: DataFrame, target: str | None, key: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` 0..k-1: rows of a class take turns, by hash of ``key``."""
    draw = F.xxhash64(F.lit(seed + 1), *[N.q(c) for c in key])
    stratum = N.as_label(N.q(target)) if target else F.lit("")
    rows = df.withColumn("__y", stratum).withColumn("__d", draw).withColumn("__b", F.pmod("__d", F.lit(1024)))
    turn = F.row_number().over(W.partitionBy("__y", "__b").orderBy("__d", *[N.q(c) for c in key])) - 1
    # buckets start their turn where the one before left off
    sizes = rows.groupBy("__y", "__b").agg(F.count("*").alias("n"))
    before = W.partitionBy("__y").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    heads = sizes.select("__y", "__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__o"))
    placed = rows.withColumn("__i", turn).join(heads, ["__y", "__b"])
    return placed.select(*[N.q(c) for c in df.columns], F.pmod(F.col("__o") + F.col("__i"), F.lit(k)).cast("int").alias("fold"))


# --- preprocessing ----------------------------------------------------------------------------


@dataclass
class Preprocessor:
    """What was fitted on the training rows: literals for imputing and scaling, kept categories, the encoder."""

    numeric: list[str]
    dates: list[str]
    one_hot: list[str]
    ordinal: list[str]
    fills: dict[str, object]
    centers: dict[str, float]
    scales: dict[str, float]
    kept: dict[str, list[str]]
    names: list[str] = field(default_factory=list)
    codes: dict[str, DataFrame] = field(default_factory=dict)  # (v, code) of columns with too many values to list

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds the vector ``features``."""
        columns, known = [], [N.q(c) for c in df.columns]
        for c in [*self.numeric, *self.dates]:
            x = F.unix_micros(N.q(c).cast("timestamp")) / 86.4e9 if c in self.dates else P.to_float(N.q(c))
            x = F.coalesce(x, F.lit(float(self.fills[c])))
            columns.append(((x - self.centers[c]) / self.scales[c]).cast("double"))
        for c in self.one_hot:
            v = F.coalesce(N.q(c).cast("string"), F.lit(self.fills[c]))
            columns += [(v == k).cast("double") for k in self.kept[c] if k != OTHER]
            if OTHER in self.kept[c]:
                frequent = [k for k in self.kept[c] if k != OTHER]
                columns.append((~v.isin(frequent) & v.isin(self.fills[f"{c}/rare"])).cast("double"))
        for c in self.ordinal:
            v = F.coalesce(N.q(c).cast("string"), F.lit(self.fills[c]))
            if c in self.codes:
                at = len(columns)
                df = df.withColumn(f"__v{at}", v).join(self.codes[c].toDF(f"__v{at}", f"__code{at}"), f"__v{at}", "left")
                columns.append(F.coalesce(F.col(f"__code{at}"), F.lit(-1.0)))
                continue
            columns.append((F.array_position(F.array(*[F.lit(k) for k in self.kept[c]]), v).cast("double")) - 1)
        from pyspark.ml.functions import array_to_vector

        return df.select(*known, array_to_vector(F.array(*(columns or [F.lit(0.0)]))).alias("features"))


OTHER = "<infrecuente>"


def fit_preprocessor(train: DataFrame, features: list[str], num_impute: str = "median", cat_impute: str = "most_frequent", scaler: str = "standard",
                     encoder: str = "onehot", max_onehot: int = ONE_HOT_MOST) -> Preprocessor:
    """Everything learned from ``train`` alone, in one pass for numbers and one grouping for each category column.

    Scalers: standard (population deviation), minmax, robust, ninguno; constant columns are left at 0. Categories under
    one percent share a column; unknown ones are all zeros (-1 in ordinal codes, which are alphabetical). Every value of
    an ordinal column has its code: many of them stay a table, which ``transform`` joins.
    """
    dates = [c for c in features if N.is_datetime(train, c)]
    numeric = [c for c in features if N.is_numeric(train, c)]
    rest = [c for c in features if c not in dates and c not in numeric and not N.is_nested(train, c)]
    facts = AggFusion(train)
    number = {c: F.unix_micros(N.q(c).cast("timestamp")) / 86.4e9 if c in dates else P.to_float(N.q(c)) for c in [*numeric, *dates]}
    for c, x in number.items():
        facts.want(c, F.struct(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"), F.count("*").alias("rows")))
    got = {c: r.asDict() for c, r in (facts.run() if facts.wanted else {}).items()}
    for c, (low, mid, high) in O.quantiles(train, {c: (x, (0.25, 0.5, 0.75)) for c, x in number.items()}).items():
        got[c] |= {"mid": mid, "iqr": None if low is None else high - low, "fill": got[c]["mean"] if num_impute == "mean" and c in numeric else mid}
    if num_impute == "most_frequent":
        for c, (_, top, _) in O.tallies(train, {c: number[c] for c in numeric}).items():
            got[c]["fill"] = top
    fills, centers, scales, kept, codes = {}, {}, {}, {}, {}
    for c, r in got.items():
        fill = fills[c] = float(r["fill"]) if r["fill"] is not None else 0.0
        n, gaps = r["n"], r["rows"] - r["n"]
        if n == 0:
            centers[c], scales[c] = 0.0, 1.0
            continue
        mean = (r["mean"] * n + fill * gaps) / (n + gaps)  # of the imputed column
        var = (n * (r["sd"] ** 2 + (r["mean"] - mean) ** 2) + gaps * (fill - mean) ** 2) / (n + gaps)
        centers[c], scales[c] = {"standard": (mean, math.sqrt(var)), "minmax": (r["lo"], r["hi"] - r["lo"]), "robust": (r["mid"], r["iqr"])}.get(scaler, (0.0, 1.0))
        scales[c] = scales[c] or 1.0
    one_hot, ordinal = [], []
    for c in rest:
        counts = train.groupBy(N.q(c).cast("string").alias("v")).agg(F.count("*").alias("k"))
        known = counts.filter("v is not null").orderBy(F.desc("k"), "v").limit(max(CODES_LISTED, max_onehot) + 1).collect()
        fills[c] = (known[0]["v"] if known and cat_impute == "most_frequent" else "DESCONOCIDO")
        total = max(train.count() if not known else sum(r["k"] for r in known), 1)
        if encoder == "onehot" and len(known) <= max_onehot:
            one_hot.append(c)
            rare = [r["v"] for r in known if r["k"] / total < RARE_SHARE]
            kept[c] = sorted(r["v"] for r in known if r["v"] not in rare) + ([OTHER] if rare else [])
            fills[f"{c}/rare"] = rare
        else:
            ordinal.append(c)
            kept[c] = sorted(r["v"] for r in known)
            if len(known) > CODES_LISTED:
                kept[c] = []
                codes[c] = Q.with_position(counts.filter("v is not null").select("v"), ["v"]).select("v", F.col("__pos").cast("double").alias("code"))
                if codes[c].count() <= CODES_SENT:
                    codes[c] = F.broadcast(codes[c])
    names = [*numeric, *dates, *[f"{c}={k}" for c in one_hot for k in kept[c]], *ordinal]
    return Preprocessor(numeric, dates, one_hot, ordinal, fills, centers, scales, kept, names, codes)


def variable_of(feature: str, columns: list[str]) -> str:
    """The column an encoded feature comes from: the longest that it is or starts with."""
    return max((c for c in columns if feature == c or feature.startswith(f"{c}=")), key=len, default=feature)


# --- models -----------------------------------------------------------------------------------


@dataclass
class Constant:
    """Predicts the commonest class or the mean: what any model has to beat."""

    value: float
    prior: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        out = df.withColumn("prediction", F.lit(self.value))
        return out.withColumn("probability", array_to_vector(F.array(*[F.lit(p) for p in self.prior]))) if self.prior else out


def model_zoo(task: str, n_rows: int, sd_y: float = 1.0, fast: bool = False, weight: str | None = None, seed: int = 42, n_features: int = 1, n_classes: int = 2) -> dict:
    """name -> estimator. Penalties are those of per-row-sum objectives, restated for Spark's per-row-mean ones.

    Kernel machines go by random features. Spark's boosted trees are
    of histograms, so the second kind of boosting differs by depth and bins only. The README lists what is left out.
    """
    trees = 60 if fast else 300
    if task != "regresion":
        common = {"labelCol": "label", **({"weightCol": weight} if weight else {})}
        gbt = C.GBTClassifier(labelCol="label", maxIter=20 if fast else 100, maxDepth=3, stepSize=0.1, seed=seed)
        hist = C.GBTClassifier(labelCol="label", maxIter=100, maxDepth=5, stepSize=0.1, maxBins=255, seed=seed)
        zoo = {
            "Regresión Logística": C.LogisticRegression(regParam=1.0 / max(n_rows, 1), elasticNetParam=0.0, standardization=False, maxIter=200, **common),
            "Árbol de Decisión": C.DecisionTreeClassifier(maxDepth=12, seed=seed, **common),
            "Random Forest": C.RandomForestClassifier(numTrees=trees, maxDepth=5 if fast else 15, featureSubsetStrategy="sqrt", seed=seed, **common),
            "Extra Trees": ExtraTrees(classes=n_classes, weight=weight, seed=seed + 1),
            "Gradient Boosting": gbt if task == "binaria" else C.OneVsRest(classifier=gbt, labelCol="label", parallelism=4),
            "HistGradientBoosting": hist if task == "binaria" else C.OneVsRest(classifier=hist, labelCol="label", parallelism=4),
            "AdaBoost": Z.AdaBoostClassifier(seed=seed),
            "K-Vecinos (KNN)": Z.Neighbours(15),
            "Ridge Classifier": Z.RidgeClassifier(weight=weight),
            "Naive Bayes": C.NaiveBayes(modelType="gaussian", **common),
            "SVM": nets.KernelClassifier(classes=n_classes, weight=weight, seed=seed),
            "SVM lineal (aprox.)": C.LinearSVC(labelCol="label", maxIter=100) if task == "binaria" else C.OneVsRest(classifier=C.LinearSVC(maxIter=50), labelCol="label"),
            "MLP": C.MultilayerPerceptronClassifier(labelCol="label", layers=[max(n_features, 1), 128, 64, n_classes], maxIter=100, seed=seed),
        }
        return {k: zoo[k] for k in ("Regresión Logística", "Árbol de Decisión", "Random Forest")} if fast else zoo
    zoo = {
        "Regresión Lineal": R.LinearRegression(regParam=0.0),
        "Ridge": R.LinearRegression(solver="l-bfgs", elasticNetParam=0.0, standardization=False, regParam=sd_y / max(n_rows, 1), maxIter=500, tol=1e-10),
        "Lasso": R.LinearRegression(elasticNetParam=1.0, standardization=False, regParam=1.0, maxIter=500),
        "Elastic Net": R.LinearRegression(solver="l-bfgs", elasticNetParam=0.5 / (0.5 + 0.5 * sd_y), standardization=False, regParam=0.5 + 0.5 * sd_y, maxIter=500),
        "Árbol de Decisión": R.DecisionTreeRegressor(maxDepth=12, seed=seed),
        "Random Forest": R.RandomForestRegressor(numTrees=trees, maxDepth=5 if fast else 15, featureSubsetStrategy="all", seed=seed),
        "Extra Trees": ExtraTrees(seed=seed + 1),
        "Gradient Boosting": R.GBTRegressor(maxIter=20 if fast else 100, maxDepth=3, stepSize=0.1, seed=seed),
        "HistGradientBoosting": R.GBTRegressor(maxIter=100, maxDepth=5, stepSize=0.1, maxBins=255, seed=seed),
        "AdaBoost": Z.AdaBoostRegressor(seed=seed),
        "K-Vecinos (KNN)": Z.Neighbours(15, classify=False),
        "SVM (aprox.)": nets.KernelRegressor(seed=seed),
        "MLP": nets.NetRegressor(seed=seed),
    }
    return {k: zoo[k] for k in ("Regresión Lineal", "Ridge", "Árbol de Decisión", "Random Forest")} if fast else zoo


BASELINE = {"binaria": "Baseline (mayoritaria)", "multiclase": "Baseline (mayoritaria)", "regresion": "Baseline (media)"}


@dataclass
class ModelResult:
    name: str
    model: object = None
    metrics: dict = field(default_factory=dict)
    train_metrics: dict = field(default_factory=dict)
    cv: list[float] = field(default_factory=list)
    seconds: float = 0.0
    error: str | None = None


@dataclass
class TrainingOutput:
    task: str
    target: str
    features: list[str]
    classes: list[str]
    preprocessor: Preprocessor
    results: list[ModelResult]
    train: DataFrame
    test: DataFrame

    def leaderboard(self) -> DataFrame:
        return build_leaderboard(self)


def encode_labels(df: DataFrame, target: str, task: str) -> tuple[DataFrame, list[str]]:
    """Adds ``label``: the number itself, or the place of the class in alphabetical order."""
    if task == "regresion":
        return df.withColumn("label", P.to_float(N.q(target))).filter("label is not null"), []
    known = df.filter(N.q(target).isNotNull())
    classes = sorted(r["v"] for r in known.select(N.q(target).cast("string").alias("v")).distinct().collect())  # the classes
    return known.withColumn("label", (F.array_position(F.array(*[F.lit(c) for c in classes]), N.q(target).cast("string")) - 1).cast("double")), classes


def evaluate(scored: DataFrame, task: str, n_features: int = 1) -> dict:
    """The metrics of a model's predictions, which are worked out once and held while they are measured."""
    told = ["label", "prediction"]
    if task != "regresion" and "probability" in scored.columns:
        told.append(F.element_at(vector_to_array("probability"), 2).alias("score") if task == "binaria" else "probability")
    scored = scored.select(*told).persist()
    try:
        if task == "regresion":
            return M.regression_metrics(scored, n_features=n_features).first().asDict()
        out = M.classification_metrics(scored, binary=task == "binaria").first().asDict()
        if "probability" in scored.columns:
            out |= M.multiclass_ranking(scored).first().asDict()
        if "score" in scored.columns:
            out |= M.ranking_metrics(scored).first().asDict()
        return out
    finally:
        scored.unpersist()


def fit_one(train: DataFrame, name: str, estimator, task: str) -> object:
    if estimator is not None:
        return estimator.fit(train)
    if task == "regresion":
        return Constant(train.agg(F.avg("label")).first()[0], [])
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}  # the classes
    total, k = sum(counts.values()), int(max(counts)) + 1
    best = max(sorted(counts), key=lambda c: counts[c])
    return Constant(float(best), [counts.get(float(c), 0) / total for c in range(k)])


def train_models(df: DataFrame, target: str, features: list[str], key: list[str], models: list[str] | None = None, task: str | None = None, test: float = 0.2, cv: int = 0,
                 balanced: bool = False, fast: bool = True, seed: int = 42, zoo: dict | None = None) -> TrainingOutput:
    """Splits, prepares on the training rows only, fits each model and measures it on the rest; a model that fails is reported.

    ``models`` names models of either zoo; the fast one's settings hold if ``fast`` and it has the name. An unknown name is an error.
    """
    task = detect_task(df, target, task)
    labelled, classes = encode_labels(df, target, task)
    used = labelled.select(*[N.q(c) for c in dict.fromkeys([*key, *features]) if c != "label"], "label")  # the rest of a wide table isn't held
    parted = split(spread(used), None if task == "regresion" else "label", key, test, seed).cache()
    train, rest = parted.filter("not is_test"), parted.filter("is_test")
    ready = fit_preprocessor(train, features)
    weight = None
    if balanced and classes:
        counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
        share = F.create_map(*[F.lit(x) for c, k in counts.items() for x in (c, sum(counts.values()) / (len(counts) * k))])
        train, weight = train.withColumn("weight", share[F.col("label")]), "weight"
    keep = ["label", "features", *key, *([weight] if weight else [])]
    sizes = {r["is_test"]: r["count"] for r in parted.groupBy("is_test").count().collect()}
    fit_on = gathered(ready.transform(train).select(*keep), sizes.get(False, 0)).cache()
    check_on = gathered(ready.transform(rest).select("label", "features", *key), sizes.get(True, 0)).cache()
    facts = fit_on.agg(F.count("*").alias("n"), F.stddev_samp("label").alias("sd")).first()
    if cv <= 1 and check_on.count() == sizes.get(True, 0):
        parted.unpersist()  # both parts are held as features from here on
    made = lambda fast: model_zoo(task, facts["n"], facts["sd"] or 1.0, fast, weight, seed, len(ready.names), max(len(classes), 2))
    known = zoo or (made(fast) if models is None else made(False) | (made(True) if fast else {}))
    unknown = sorted(set(models or ()) - set(known) - {BASELINE[task]})
    if unknown:
        raise ValueError(f"modelos desconocidos: {', '.join(unknown)}")
    chosen = {k: v for k, v in known.items() if models is None or k in models} | {BASELINE[task]: None}

    def fitted(name: str, estimator) -> ModelResult:
        began, result = time.perf_counter(), ModelResult(name)
        try:
            result.model = fit_one(fit_on, name, estimator, task)
            result.metrics = evaluate(result.model.transform(check_on), task, len(features))
            result.train_metrics = evaluate(result.model.transform(fit_on), task, len(features))
            if cv > 1:
                result.cv = cross_validate(train, features, key, estimator, name, task, cv, seed)
        except Exception as e:  # one model's failure is a row of the leaderboard
            result.error = str(e).splitlines()[0][:200]
        result.seconds = time.perf_counter() - began
        return result

    first = sorted(chosen, key=lambda name: SLOW.index(name) if name in SLOW else len(SLOW))
    with ThreadPoolExecutor(AT_ONCE if facts["n"] < SPREAD_MOST else AT_ONCE_LARGE) as pool:
        waited = {name: pool.submit(inheritable_thread_target(df.sparkSession)(fitted), name, chosen[name]) for name in first}
        results = [waited[name].result() for name in chosen]
    return TrainingOutput(task, target, features, classes, ready, results, fit_on, check_on)


def cross_validate(train: DataFrame, features: list[str], key: list[str], estimator, name: str, task: str, k: int, seed: int = 42) -> list[float]:
    """The primary metric on each fold, everything refitted on the others."""
    parts = folds(train, None if task == "regresion" else "label", key, k, seed).cache()
    scores = []
    for fold in range(k):
        own = parts.filter(F.col("fold") != fold)
        ready = fit_preprocessor(own, features)
        model = fit_one(ready.transform(own), name, estimator, task)
        scores.append(evaluate(model.transform(ready.transform(parts.filter(F.col("fold") == fold))), task, len(features)).get(M.PRIMARY[task]))
    parts.unpersist()
    return [s for s in scores if s is not None]


def random_search(out: TrainingOutput, df: DataFrame, key: list[str], name: str, estimator, grid: dict[str, list], n_iter: int = 5, cv: int = 3, seed: int = 42) -> tuple[dict, float]:
    """The best of ``n_iter`` drawn settings by the primary metric, cross-validated. A setting that fails or has no score is left out; if all are, that is an error."""
    rng, tried, failed = random.Random(seed), [], []
    for _ in range(n_iter):
        drawn = {p: rng.choice(v) for p, v in sorted(grid.items())}
        try:
            candidate = estimator.copy({getattr(estimator, p): v for p, v in drawn.items()})
            scores = cross_validate(df, out.features, key, candidate, name, out.task, cv, seed)
        except Exception as e:  # one setting's failure doesn't end the search
            failed.append(f"{drawn}: {str(e).splitlines()[0][:200]}")
            continue
        if scores:
            tried.append((sum(scores) / len(scores), drawn))
    if not tried:
        raise ValueError("ninguna combinación se pudo evaluar" + "".join(f"; {x}" for x in failed[:3]))
    best = max(tried, key=lambda t: t[0])
    return best[1], best[0]


def build_leaderboard(out: TrainingOutput) -> DataFrame:
    primary = M.PRIMARY[out.task]
    names = sorted({m for r in out.results for m in r.metrics})
    gap = "r2" if out.task == "regresion" else "accuracy"
    rows = []
    for r in out.results:
        mean = sum(r.cv) / len(r.cv) if r.cv else None
        dev = (sum((x - mean) ** 2 for x in r.cv) / len(r.cv)) ** 0.5 if r.cv else None
        over = r.train_metrics[gap] - r.metrics[gap] if r.metrics.get(gap) is not None and r.train_metrics.get(gap) is not None else None
        rows.append((r.name, "error" if r.error else "ok", *[round(r.metrics[m], 4) if r.metrics.get(m) is not None else None for m in names], mean, dev, over, round(r.seconds, 2), r.error))
    schema = "modelo string, estado string, " + ", ".join(f"`{m}` double" for m in names) + ", `CV media` double, `CV desv` double, sobreajuste double, tiempo_s double, detalle string"
    table = out.train.sparkSession.createDataFrame(rows, schema)
    order = F.desc_nulls_last(primary) if primary in names else F.asc("modelo")
    return table.withColumn("ranking", F.row_number().over(W.orderBy(order, "modelo")))  # a row a model


def learning_curve(df: DataFrame, target: str, features: list[str], key: list[str], estimator, task: str, sizes: tuple[float, ...] = (0.1, 0.28, 0.46, 0.64, 0.82, 1.0), cv: int = 3, seed: int = 42) -> DataFrame:
    labelled, _ = encode_labels(df, target, task)
    parts = folds(labelled, None if task == "regresion" else "label", key, cv, seed).withColumn("__u", F.pmod(F.xxhash64(F.lit(seed), *[N.q(k) for k in key]), F.lit(1000)) / 1000).cache()
    rows = []
    for share in sizes:
        train_scores, check_scores, n = [], [], 0
        for fold in range(cv):
            own = parts.filter((F.col("fold") != fold) & (F.col("__u") < share))
            ready = fit_preprocessor(own, features)
            fitted = ready.transform(own)
            n = fitted.count()
            model = fit_one(fitted, "", estimator, task)
            train_scores.append(evaluate(model.transform(fitted), task)[M.PRIMARY[task]])
            check_scores.append(evaluate(model.transform(ready.transform(parts.filter(F.col("fold") == fold))), task)[M.PRIMARY[task]])
        mean = lambda v: sum(v) / len(v)
        dev = lambda v: (sum((x - mean(v)) ** 2 for x in v) / len(v)) ** 0.5
        rows.append((n, mean(train_scores), mean(check_scores), dev(train_scores), dev(check_scores)))
    return df.sparkSession.createDataFrame(rows, "n_muestras long, entrenamiento double, validacion double, entrenamiento_std double, validacion_std double")


def learning_verdict(curve: DataFrame) -> str:
    rows = sorted(curve.collect(), key=lambda r: r["n_muestras"])
    if rows[-1]["entrenamiento"] - rows[-1]["validacion"] > 0.1:
        return "Sobreajuste: la brecha entre entrenamiento y validación es grande"
    if len(rows) > 1 and rows[-1]["validacion"] - rows[-2]["validacion"] > 0.01:
        return "Más datos ayudarían: la validación aún sube"
    return "Ajuste estable"
