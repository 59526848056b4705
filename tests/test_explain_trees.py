"""Shapley values of trees, kernel classifiers and metrics of several classes against plain re-statements."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import VectorIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lumenframe.operators import explain, learning, metrics, nets


def points(spark, x, y):
    df = spark.createDataFrame([(i, [float(v) for v in p], float(t)) for i, (p, t) in enumerate(zip(x, y, strict=True))], "id int, x array<double>, label double")
    return df.select("id", "label", array_to_vector("x").alias("features")).cache()


@pytest.fixture(scope="module")
def four(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 4))
    x[:, 3] = rng.integers(0, 3, 240)
    y = 2 * x[:, 0] + x[:, 1] * x[:, 2] + (x[:, 3] == 1) * 3
    return points(spark, x, y), x, points(spark, x, (y > 1).astype(int))


def value_of(leaves, x, known):
    """The expectation of the output when only the features in ``known`` are known, leaf by leaf."""
    total = 0.0
    for leaf in leaves:
        met = leaf.meets(x[None, :])[0]
        total += leaf.value * math.prod(float(met[k]) if j in known else leaf.share[k] for k, j in enumerate(leaf.features))
    return total


def enumerated(leaves, x, d):
    out = []
    for i in range(d):
        rest, phi = [j for j in range(d) if j != i], 0.0
        for size in range(d):
            for s in itertools.combinations(rest, size):
                phi += math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d) * (value_of(leaves, x, {*s, i}) - value_of(leaves, x, set(s)))
        out.append(phi)
    return out


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted", "classes", "boosted classes", "categories"])
def test_tree_shap_equals_all_subsets_and_sums_to_the_output(spark, four, kind):
    numbers, x, classes = four
    if kind == "categories":
        numbers = VectorIndexer(inputCol="features", outputCol="f", maxCategories=3).fit(numbers).transform(numbers).select("id", "label", F.col("f").alias("features"))
    estimator, df = {
        "tree": (R.DecisionTreeRegressor(maxDepth=5), numbers), "categories": (R.DecisionTreeRegressor(maxDepth=5), numbers),
        "forest": (R.RandomForestRegressor(numTrees=4, maxDepth=4, seed=1), numbers), "boosted": (R.GBTRegressor(maxIter=4, maxDepth=3), numbers),
        "classes": (C.RandomForestClassifier(numTrees=4, maxDepth=4, seed=1), classes), "boosted classes": (C.GBTClassifier(maxIter=3, maxDepth=3), classes),
    }[kind]
    model = estimator.fit(df)
    told, base = explain.tree_shap(model.transform(df), model)
    rows = told.orderBy("id").collect()
    leaves = explain.tree_leaves(spark, model)
    assert base == pytest.approx(sum(leaf.value * leaf.cover for leaf in leaves))
    if kind in ("tree", "categories"):
        assert base == pytest.approx(np.mean([r["label"] for r in rows]))
        assert any(leaf.sets[k] for leaf in leaves for k in range(len(leaf.sets))) == (kind == "categories")
    for r in rows:
        if kind == "classes":
            output = r["probability"][1]
        elif kind == "boosted classes":
            output = r["rawPrediction"][1]
        else:
            output = r["prediction"]
        assert base + sum(r["shap"]) == pytest.approx(output, abs=1e-9)
    for i in range(0, 240, 40):
        assert rows[i]["shap"] == pytest.approx(enumerated(leaves, x[i], 4), abs=1e-9)


def test_a_lone_leaf_explains_nothing(spark):
    df = points(spark, [(1, 2), (3, 4)], [5, 5])
    model = R.DecisionTreeRegressor().fit(df)
    told, base = explain.tree_shap(df, model)
    assert base == 5 and [r["shap"] for r in told.collect()] == [[0, 0], [0, 0]]


def test_kernel_classifier_learns_a_ring_that_no_line_cuts(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 2))
    y = (np.hypot(*x.T) > 1.1).astype(int)
    train, rest = points(spark, x[:500], y[:500]), points(spark, x[500:], y[500:])
    share = lambda m: m.transform(rest).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    kernel = nets.KernelClassifier(rounds=15).fit(train)
    assert share(kernel) > 0.93 > share(C.LinearSVC(maxIter=50).fit(train)) + 0.2
    scored = kernel.transform(rest)
    p = vector_to_array("probability")
    assert scored.filter(F.abs(p[0] + p[1] - 1) > 1e-9).count() == 0
    found = metrics.ranking_metrics(scored.withColumn("score", p[1])).first()
    assert found["roc_auc"] > 0.97 and found["log_loss"] < 0.3  # calibrated: far below that of a coin, 0.69
    three = points(spark, x, np.digitize(np.hypot(*x.T), [0.8, 1.5]))
    model = nets.KernelClassifier(classes=3, rounds=12).fit(three)
    told = model.transform(three)
    assert told.filter(F.col("prediction") == F.col("label")).count() > 0.85 * 700
    assert metrics.multiclass_ranking(told).first()["roc_auc"] > 0.95


def test_multiclass_ranking_equals_pairs(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.dirichlet((1, 1, 1), 200), 1) + 0.05  # many ties
    y = rng.integers(0, 3, 200)
    df = spark.createDataFrame([(float(t), [float(v) for v in r]) for t, r in zip(y, p, strict=True)], "label double, probability array<double>")
    aucs = []
    for k in range(3):
        a, b = p[y == k, k], p[y != k, k]
        aucs.append(((a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum()) / (len(a) * len(b)))
    got = metrics.multiclass_ranking(df).first()
    assert got["roc_auc"] == pytest.approx(np.mean(aucs))
    assert got["log_loss"] == pytest.approx(-np.mean(np.log(p[np.arange(200), y] / p.sum(axis=1))))
    assert metrics.multiclass_ranking(df.filter("label < 2")).first()["roc_auc"] is None  # class 2 has no row
    vectors = df.withColumn("probability", array_to_vector("probability"))
    assert metrics.multiclass_ranking(vectors).first() == got


def test_leaderboard_of_three_classes_and_names(spark):
    rows = [(i, float(i % 7), "abc"[i % 3]) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, x double, y string")
    out = learning.train_models(df, "y", ["x"], ["id"], models=["Regresión Logística"])
    board = out.leaderboard().collect()
    assert {"roc_auc", "log_loss"} <= set(board[0].asDict()) and all(r["estado"] == "ok" for r in board)
    with pytest.raises(ValueError, match="Marte"):
        learning.train_models(df, "y", ["x"], ["id"], models=["Regresión Logística", "Marte"])
    net = learning.train_models(df, "y", ["x"], ["id"], models=["SVM"])
    assert [r.name for r in net.results] == ["SVM", "Baseline (mayoritaria)"] and not net.results[0].error


def test_search_leaves_out_settings_that_fail(spark):
    df = spark.createDataFrame([(i, float(i % 5), float(i % 5 > 2)) for i in range(90)], "id int, x double, y double")
    out = learning.train_models(df, "y", ["x"], ["id"], models=["Árbol de Decisión"], task="binaria")
    labelled, _ = learning.encode_labels(df, "y", "binaria")
    tree = C.DecisionTreeClassifier(labelCol="label")
    best, score = learning.random_search(out, labelled, ["id"], "t", tree, {"maxDepth": [3, 31]}, n_iter=6, cv=2)  # 30 is the deepest
    assert best == {"maxDepth": 3} and score == 1.0
    with pytest.raises(ValueError, match="ninguna"):
        learning.random_search(out, labelled, ["id"], "t", tree, {"maxDepth": [31]}, n_iter=2, cv=2)


def test_shares_by_code_equal_those_of_the_rows():
    """One table of shares a leaf serves all rows."""
    leaf = explain.TreeLeaf(3.0, [0, 2], [0.0, -np.inf], [1.0, 5.0], [None, None], np.array([0.25, 0.5]), 0.1)
    x = np.random.default_rng(1).uniform(-2, 8, size=(50, 3))
    assert np.allclose(explain.coded_shares(leaf)[explain.path_codes(leaf, x)], 3.0 * explain.leaf_shares(leaf.meets(x).astype(float), leaf.share))
