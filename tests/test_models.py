"""Models built from Spark's parts, and nearest rows by blocks, against brute force."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lumenframe.operators import learning, recipe, space, views, zoo


def points(spark, rows):
    df = spark.createDataFrame([(i, [float(v) for v in x], float(y)) for i, (x, y) in enumerate(rows)], "id int, x array<double>, label double")
    return df.select("id", "label", array_to_vector("x").alias("features")).cache()


@pytest.fixture(scope="module")
def ring(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    return x, (np.hypot(*x.T) > 1.1).astype(int)


def predicted(model, df):
    return np.array([r["prediction"] for r in model.transform(df).orderBy("id").collect()])


def test_adaboost_learns_a_ring_and_gives_shares(spark, ring):
    x, y = ring
    df = points(spark, zip(x, y, strict=True))
    model = zoo.AdaBoostClassifier(rounds=5).fit(df)
    assert (predicted(model, df) == y).mean() > 0.7
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in model.transform(df).select("probability").collect())
    weights = np.ones(len(y))  # the same stumps reweighed by hand
    for tree, alpha in zip(model.models, model.alphas, strict=True):
        miss = np.array([r["prediction"] for r in tree.transform(df.select("id", "features")).orderBy("id").collect()]) != y
        error = weights[miss].sum() / weights.sum()
        assert alpha == pytest.approx(np.log((1 - error) / error), rel=1e-6)
        weights *= np.exp(alpha * miss)


def test_adaboost_of_three_classes_and_of_a_perfect_stump(spark):
    df = points(spark, [((k, 0), k // 10) for k in range(30)])
    assert (predicted(zoo.AdaBoostClassifier(rounds=4).fit(df), df) == np.arange(30) // 10).mean() > 0.9
    two = points(spark, [((k, 0), int(k > 4)) for k in range(10)])
    model = zoo.AdaBoostClassifier().fit(two)
    assert len(model.trees) == 1 and (predicted(model, two) == (np.arange(10) > 4)).all()


def test_adaboost_regression(spark):
    x = np.linspace(0, 6, 200)
    df = points(spark, [((v,), np.sin(v)) for v in x])
    got = predicted(zoo.AdaBoostRegressor(rounds=4).fit(df), df)
    assert np.abs(got - np.sin(x)).mean() < 0.2
    same = points(spark, [((v,), 2.0) for v in x[:5]])
    assert (predicted(zoo.AdaBoostRegressor().fit(same), same) == 2).all()


def test_ridge_classifier_is_least_squares_on_signs(spark, ring):
    x, _ = ring
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.2).astype(int)
    df = points(spark, zip(x, y, strict=True))
    t, c = 2.0 * y - 1, x - x.mean(axis=0)
    w = np.linalg.solve(c.T @ c + np.eye(2), c.T @ (t - t.mean()))
    want = (c @ w + t.mean() > 0).astype(int)
    assert (predicted(zoo.RidgeClassifier().fit(df), df) == want).all()
    three = points(spark, [((k, k % 2), k // 10) for k in range(30)])
    assert set(predicted(zoo.RidgeClassifier().fit(three), three)) <= {0.0, 1.0, 2.0}


@pytest.mark.parametrize("size", [7, 1000])
def test_neighbours_equal_brute_force_in_any_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(space, "LEAF_ROWS", size)
    monkeypatch.setattr(space, "GROUP_ROWS", max(2, size // 3))
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 5, size=(60, 2)), rng.integers(0, 3, 60)  # many copies and ties
    df = points(spark, zip(x, y, strict=True))
    probe = points(spark, [(v, 0) for v in [(1, 1), (1, 1), (4, 0), (9, 9)]])
    model = zoo.Neighbours(5).fit(df)

    def want(p, mean=False):
        order = sorted(range(60), key=lambda i: (float(((x[i] - p) ** 2).sum()), y[i]))[:5]
        near = [int(y[i]) for i in order]
        return np.mean(near) if mean else max(range(3), key=lambda c: (near.count(c), -c))

    at = np.array([(1, 1), (1, 1), (4, 0), (9, 9)])
    assert predicted(model, probe).tolist() == [want(p) for p in at]
    assert predicted(zoo.Neighbours(5, classify=False).fit(df), probe).tolist() == pytest.approx([want(p, True) for p in at])


def test_knn_impute_uses_all_rows(spark, monkeypatch):
    monkeypatch.setattr(space, "LEAF_ROWS", 6)
    monkeypatch.setattr(space, "GROUP_ROWS", 4)
    rng = np.random.default_rng(9)
    x = rng.integers(0, 9, size=(50, 3)).astype(float)
    x[rng.random(x.shape) < 0.25] = np.nan
    x[0] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, a double, `b.c` double, d double")
    got = {r[0]: tuple(r)[1:] for r in recipe.knn_impute(df, ["a", "b.c", "d"], 3).collect()}
    assert len(got) == 50
    for i, r in enumerate(x):
        for j in range(3):
            if not np.isnan(r[j]):
                assert got[i][j] == r[j]
                continue
            able = []
            for s in x:
                both = ~np.isnan(r) & ~np.isnan(s)
                if not np.isnan(s[j]) and both.any():
                    able.append((float(((r - s)[both] ** 2).sum()) * 3 / both.sum(), s[j]))
            near = [v for _, v in sorted(able)[:3]]
            assert got[i][j] == pytest.approx(np.mean(near) if near else np.nanmean(x[:, j]))
    empty = recipe.knn_impute(df.limit(0), ["a", "d"], 3)
    assert empty.columns == df.columns and empty.count() == 0
    hollow = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    assert sorted(tuple(r) for r in recipe.knn_impute(hollow, ["a", "b"], 3).collect()) == [(1.0, None), (1.0, None)]


def test_queries_look_at_boxes_near_their_run_only(spark, monkeypatch):
    monkeypatch.setattr(space, "LEAF_ROWS", 8)
    monkeypatch.setattr(space, "RUN", 16)
    rows = spark.createDataFrame([(float(k), float(k % 7)) for k in range(2000)], "x double, y double")
    leaves = space.leaves_of(rows, ["x", "y"])
    count = len(leaves.boxes.number)
    queries = rows.filter("x % 5 = 0")
    looked = space.sent(queries, leaves, lambda far, pdf, some: np.ones(far.shape, dtype=bool), lambda pdf: np.full(len(pdf), 9.0))
    assert count > 150 and looked.count() < 400 * count / 8
    near = space.sent(queries, leaves, lambda far, pdf, some: far <= 9.0, lambda pdf: np.full(len(pdf), 9.0)).collect()
    every = leaves.boxes.far(np.array([(r["x"], r["y"]) for r in queries.collect()]))
    assert len(near) == (every <= 9.0).sum()


def test_ordinal_codes_of_more_values_than_are_listed(spark, monkeypatch):
    monkeypatch.setattr(learning, "CODES_LISTED", 40)
    values = [f"v{k:03d}" for k in range(100)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*values, "v007", None])], "id int, `t x` string")
    for sent in (0, 1000):
        monkeypatch.setattr(learning, "CODES_SENT", sent)
        ready = learning.fit_preprocessor(df, ["t x"], encoder="ordinal")
        more = df.unionByName(spark.createDataFrame([(999, "unseen")], df.schema))
        out = ready.transform(more)
        assert out.columns == [*df.columns, "features"]
        got = {r["id"]: r["features"][0] for r in out.collect()}
        assert [got[k] for k in range(102)] == [*map(float, range(100)), 7.0, 7.0] and got[999] == -1


def test_jump_bars_and_scale(spark):
    line = spark.createDataFrame([([0.0],), ([1.0],), ([10.0],), ([11.5],)], "x array<double>").select(array_to_vector("x").alias("features"))
    row = views.jump_k(views.dendrogram(line, "single")).first()
    assert (row["k"], row["altura_antes"], row["altura_despues"]) == (2, 1.5, 9.0)
    assert views.jump_k(views.dendrogram(line.limit(2))).count() == 0
    df = spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double")
    assert [r[0] for r in df.select(views.colour_scale(df, ["v"])["v"]).collect()] == [0.0, 0.0, None]
    alerts = spark.createDataFrame([("OK",), ("NULOS | OUTLIERS",), ("NULOS",), (None,), ("",)], "alerta string")
    assert {r["alerta"]: r["n"] for r in views.alert_frequency(alerts).collect()} == {"NULOS": 2, "OUTLIERS": 1}


def test_full_zoo_trains(spark, ring):
    x, y = ring
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, y int")
    new = ["HistGradientBoosting", "AdaBoost", "K-Vecinos (KNN)", "Ridge Classifier"]
    zoo_ = {k: v for k, v in learning.model_zoo("binaria", 240, n_features=2).items() if k in new}
    zoo_["HistGradientBoosting"] = zoo_["HistGradientBoosting"].copy({zoo_["HistGradientBoosting"].maxIter: 3})
    zoo_["AdaBoost"].rounds = 2
    board = learning.train_models(df, "y", ["a", "b"], ["id"], zoo=zoo_, fast=False).leaderboard()
    got = {r["modelo"]: r for r in board.collect()}
    assert all(got[k]["estado"] == "ok" for k in new), [(k, r["detalle"]) for k, r in got.items()]
    assert got["K-Vecinos (KNN)"]["accuracy"] > 0.8 and got["K-Vecinos (KNN)"]["roc_auc"] > 0.8
    assert df.agg(F.count("*")).first()[0] == 300


def test_silhouettes_of_all_rows_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(4_300, 3)), 1) + 100  # many equal points, more rows than a sample held
    label = rng.integers(-1, 4, len(x))
    label[7] = 9  # alone
    x[8], label[7:9] = x[7], (9, 0)
    df = spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, label, strict=True))], "id int, prediction int, x array<double>")
    told = {r["id"]: r for r in views.silhouette_by_point(df.select("id", "prediction", array_to_vector("x").alias("features")), "id").collect()}
    some = np.flatnonzero(label >= 0)
    assert sorted(told) == some.tolist()
    far = np.sqrt(((x[some, None, :] - x[None, some, :]) ** 2).sum(2))
    for i in [7, 8, *some[:300]]:
        d, own = far[np.searchsorted(some, i)], label[some] == label[i]
        a, b = d[own].sum() / max(own.sum() - 1, 1), min(d[label[some] == c].mean() for c in set(label[some]) - {label[i]})
        assert told[i]["silueta"] == pytest.approx((b - a) / max(a, b) if own.sum() > 1 else 0.0, abs=1e-9) and told[i]["cluster"] == label[i]


def test_small_files_are_spread_and_only_the_cut_is_sorted(spark):
    df = spark.range(40_000).coalesce(1).withColumn("y", F.col("id") % 2)
    assert learning.spread(df).rdd.getNumPartitions() == 8
    told = learning.split(df, "y", ["id"])
    moved = told.groupBy("y", F.spark_partition_id().alias("p")).count().groupBy("y").agg(F.max("count").alias("n")).collect()
    assert all(r["n"] > 19_000 for r in moved)  # rows away from the cut stay in the one task that read them
    assert {(r["y"], r["n"]) for r in told.filter("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()} == {(0, 4_000), (1, 4_000)}


def test_a_bounded_sample_leaves_out_most_rows_before_it_is_ordered(spark, capsys):
    """Each task would send as many rows as the sample has; the sample stays the same."""
    from lumenframe.operators import clustering

    df = spark.range(0, 20_000, 1, 4)
    told = clustering.bounded(df, 100)
    told.explain()
    assert "Filter" in capsys.readouterr().out
    placed = df.withColumn("at", F.monotonically_increasing_id()).orderBy(F.xxhash64(F.lit(42), "at"), "at").limit(100)
    assert [r[0] for r in told.collect()] == [r["id"] for r in placed.collect()]
    assert clustering.bounded(df, 30_000).count() == 20_000
