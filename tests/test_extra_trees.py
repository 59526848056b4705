"""Extremely randomised trees: random thresholds, every row in every tree, sums as rows give them."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from lumenframe.operators import extra_trees as ET
from lumenframe.operators import learning


def points(spark, x, y, w=None):
    rows = [(i, [float(v) for v in p], float(t), float(1 if w is None else w[i])) for i, (p, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id int, x array<double>, label double, weight double").select("id", "label", "weight", array_to_vector("x").alias("features")).repartition(5).cache()


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    x[:, 2] = rng.integers(0, 2, 400)
    return x, (np.hypot(x[:, 0], x[:, 1]) > 1.1).astype(int), x[:, 0] ** 2 + 3 * x[:, 2]


def check_tree(t, x, y, classes):
    """Node sums are those of the rows routed there, and a threshold lies inside the node's range."""
    todo = [(0, np.arange(len(x)))]
    while todo:
        i, own = todo.pop()
        want = np.bincount(y[own].astype(int), minlength=classes) if classes else [len(own), y[own].sum(), (y[own] ** 2).sum()]
        assert np.allclose(t.sums[i], want) and len(own)
        if t.feature[i] >= 0:
            v = x[own, t.feature[i]]
            assert v.min() <= t.threshold[i] < v.max()
            todo += [(t.left[i], own[v <= t.threshold[i]]), (t.right[i], own[v > t.threshold[i]])]


@pytest.mark.parametrize("at_once", [25, 4])
def test_classes(spark, data, monkeypatch, at_once):
    monkeypatch.setattr(ET, "TREES_AT_ONCE", at_once)
    x, y, _ = data
    df = points(spark, x, y)
    model = ET.ExtraTrees(classes=2, trees=12, depth=8).fit(df)
    for t in model.trees:
        check_tree(t, x, y, 2)
    roots = {(t.feature[0], t.threshold[0]) for t in model.trees}
    assert len(roots) == 12  # no two trees share a threshold
    middles = {j: set(np.round((np.sort(x[:, j])[1:] + np.sort(x[:, j])[:-1]) / 2, 12)) for j in range(3)}
    assert sum(np.round(v, 12) in middles[j] for j, v in roots) == 0  # nor takes the middle between neighbours, as a searched split does
    told = model.transform(df).orderBy("id").collect()
    assert np.mean([r["prediction"] == v for r, v in zip(told, y, strict=True)]) > 0.9
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in told)
    assert model.featureImportances[2] < 0.2 and abs(sum(model.featureImportances) - 1) < 1e-9


def test_numbers_weights_and_the_same_draws_again(spark, data):
    x, _, y = data
    df = points(spark, x, y)
    model = ET.ExtraTrees(trees=8, depth=7).fit(df)
    for t in model.trees:
        check_tree(t, x, y, 0)
    again = ET.ExtraTrees(trees=8, depth=7).fit(df.repartition(2))
    assert [t.feature for t in model.trees] == [t.feature for t in again.trees] and np.allclose(model.trees[3].threshold, again.trees[3].threshold)
    told = np.array([r["prediction"] for r in model.transform(df).orderBy("id").collect()])
    assert 1 - ((told - y) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.8
    doubled = ET.ExtraTrees(trees=2, depth=3, weight="weight").fit(points(spark, x, y, np.full(len(y), 2.0)))
    assert doubled.trees[0].sums[0][0] == 2 * len(y)


def test_constant_labels_and_features(spark):
    flat = ET.ExtraTrees(trees=2).fit(points(spark, [(1, 2)] * 6, [1, 2, 3, 1, 2, 3]))
    assert [t.feature for t in flat.trees] == [[-1], [-1]]
    assert flat.transform(points(spark, [(5, 5)], [0])).first()["prediction"] == 2
    same = ET.ExtraTrees(classes=2, trees=2).fit(points(spark, [(1, 2), (3, 4)], [1, 1]))
    assert same.transform(points(spark, [(0, 0)], [0])).first()["prediction"] == 1


def test_zoo_has_it(spark):
    zoo = learning.model_zoo("binaria", 10), learning.model_zoo("regresion", 10)
    assert all(isinstance(z["Extra Trees"], ET.ExtraTrees) for z in zoo)
