"""Segmentation by landmarks, nets, grouped quantiles, samples of repeated rows and the demonstration tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lumenframe.operators import clustering as K
from lumenframe.operators import eda, landmarks, nets, recipe
from lumenframe.plans import order
from lumenframe.sources import demo


def vectors(spark, x, y=None):
    rows = [(i, [float(v) for v in p], float(y[i]) if y is not None else 0.0) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<double>, label double").select("id", "label", array_to_vector("x").alias("features")).cache()


def blobs(per=120, seed=5):
    rng = np.random.default_rng(seed)
    centers = np.array([[0, 0], [6, 0], [0, 6]])
    return np.concatenate([rng.normal(c, 0.5, (per, 2)) for c in centers]), np.repeat(range(3), per)


def same_groups(found, truth):
    pairs = set(zip(found, truth, strict=True))
    return len(pairs) == len(set(found)) == len(set(truth))


def labels(df):
    return [r["prediction"] for r in df.orderBy("id").collect()]


def test_landmark_methods_find_separate_blobs(spark):
    x, truth = blobs()
    m = vectors(spark, x)
    assert same_groups(labels(landmarks.birch(m, "id", 3)), truth)
    assert same_groups(labels(landmarks.spectral(m, "id", 3, most=40, near=5)), truth)
    found, peaks = landmarks.mean_shift(m, "id", bandwidth=2.0, seeds=60)
    assert same_groups(labels(found), truth) and len(peaks) == 3
    for p in peaks:  # each peak is the mean of what it reaches
        assert np.allclose(x[np.linalg.norm(x - p, axis=1) <= 2.0].mean(axis=0), p, atol=0.01)
    out = K.run_clustering(m.select("id", "features"), "id", "Birch", 3)
    assert out.error is None and out.metrics["clusters"] == 3


def test_spectral_tells_rings_apart(spark):
    rng = np.random.default_rng(1)
    turn, inner = rng.uniform(0, 2 * np.pi, 600), np.repeat([1, 0], 300)
    x = np.where(inner, 1.0, 6.0)[:, None] * np.column_stack([np.cos(turn), np.sin(turn)])
    assert same_groups(labels(landmarks.spectral(vectors(spark, x), "id", 2, most=60, near=4)), inner)


def test_landmarks_of_few_and_equal_rows(spark):
    m = vectors(spark, [(1, 1)] * 6 + [(2, 2)] * 3)
    assert same_groups(labels(landmarks.birch(m, "id", 2)), [0] * 6 + [1] * 3)
    assert labels(landmarks.mean_shift(vectors(spark, [(1, 1)] * 4), "id")[0]) == [0] * 4


def test_mean_shift_climbs_over_distinct_points_in_many_tasks(spark, monkeypatch):
    met, whole = [], landmarks._summed
    monkeypatch.setattr(landmarks, "_summed", lambda rows, partial: met.append((rows.count(), rows.rdd.getNumPartitions())) or whole(rows, partial))
    x, truth = blobs(20)
    own = np.concatenate([x, x, x[:20]])  # the first group counts three times
    found, peaks = landmarks.mean_shift(vectors(spark, own).coalesce(1), "id", bandwidth=2.0, seeds=60)
    assert same_groups(labels(found), np.concatenate([truth, truth, truth[:20]])) and len(peaks) == 3
    assert {n for n, _ in met} == {60} and min(tasks for _, tasks in met) >= 4
    assert np.allclose(peaks[0], x[:20].mean(axis=0), atol=0.01)


def test_ward_of_weighted_points_is_ward_of_repeated_ones():
    rng = np.random.default_rng(2)
    x, n = rng.normal(size=(9, 2)), rng.integers(1, 5, 9)
    whole = K.linkage(np.repeat(x, n, axis=0))
    assert np.allclose(K.linkage(x, "ward", n)[:, 2], whole[-8:, 2])


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(4)
    parts = [rng.normal(size=s) for s in ((3, 5), (5,), (5, 4), (4,), (4, 1), (1,))]
    x, y = rng.normal(size=(7, 3)), rng.normal(size=7)
    _, slopes = nets.net_gradient(parts, x, y)
    for k, p in enumerate(parts):
        for at in np.ndindex(p.shape):
            moved = [q.copy() for q in parts]
            moved[k][at] += 1e-6
            assert slopes[k][at] == pytest.approx((nets.net_gradient(moved, x, y)[0] - nets.net_gradient(parts, x, y)[0]) / 1e-6, abs=1e-4)


@pytest.mark.parametrize("kind", [nets.NetRegressor, nets.KernelRegressor])
def test_nets_learn_a_curve(spark, kind):
    x = np.random.default_rng(6).uniform(-2, 2, (800, 1))
    y = 100 + 40 * np.sin(2 * x[:, 0])
    df = vectors(spark, x, y)
    got = np.array(labels(kind().fit(df).transform(df)))
    assert 1 - ((got - y) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.9
    flat = vectors(spark, x[:5], [3.0] * 5)
    assert np.allclose(labels(kind(rounds=2).fit(flat).transform(flat)), 3, atol=1.5)


def test_group_quantiles_equal_percentiles(spark):
    rng = np.random.default_rng(8)
    rows = [(g, float(v)) for g, n in (("a", 5_000), ("b", 7), ("c", 1), (None, 50)) for v in rng.integers(0, 900, n) / 7]
    df = spark.createDataFrame([*rows, ("d", None)], "g string, x double").repartition(5)
    ps = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    found = {r["g"]: r["q"] for r in order.group_quantiles(df, F.col("g"), F.col("x"), ps, accuracy=200).collect()}
    asked = df.filter("x is not null").groupBy("g").agg(F.percentile("x", F.array(*[F.lit(p) for p in ps])).alias("q")).collect()
    assert found.keys() == {"a", "b", "c", None}
    for r in asked:
        assert found[r["g"]] == pytest.approx(r["q"], rel=1e-12)
    assert {r["g"]: r["mediana"] for r in eda.group_summary(df, "g", "x").collect()}["d"] is None


def test_equal_rows_are_drawn_one_by_one(spark):
    df = spark.createDataFrame(pd.DataFrame({"v": [1.0] * 900 + [float(k) for k in range(2, 102)]})).repartition(4)
    share = lambda rows: np.mean([r["v"] == 1.0 for r in rows])
    assert 0.75 < share(K.bounded(df, 200).collect()) < 1
    assert 0.75 < share(recipe.sample(df, n=200).collect()) < 1


def test_demonstration_tables(spark):
    churn = demo.churn_customers(spark).cache()
    assert churn.count() == 3_070 and churn.distinct().count() == 3_000 == churn.select("cliente_id").distinct().count()
    some = churn.dropDuplicates()
    assert some.filter("ciudad = ' bogotá '").count() == 60 and some.filter("metodo_pago = ''").count() == 40
    gaps = some.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in churn.columns]).first().asDict()
    assert {c for c, v in gaps.items() if v} == {"satisfaccion", "cargo_total", "plan"} and 0.07 < gaps["satisfaccion"] < 0.11
    assert 0.15 < some.agg(F.avg((F.col("abandono") == "Sí").cast("int"))).first()[0] < 0.85
    assert some.agg(F.avg("llamadas_soporte")).first()[0] == pytest.approx(1.2, abs=0.1)
    assert sorted(map(str, demo.churn_customers(spark, 50).collect())) == sorted(map(str, demo.churn_customers(spark, 50).repartition(3).collect()))
    homes = demo.property_sales(spark).cache()
    assert homes.count() == 2_500 and homes.agg(F.avg("area_m2")).first()[0] == pytest.approx(125, abs=4)
    assert homes.agg(F.corr("area_m2", "precio_millones")).first()[0] > 0.1 and demo.churn_customers(spark, 0).count() == 0


def test_feature_tree_keeps_sums_and_radii():
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(1500, 3)), np.zeros((20, 3))])
    counts = []
    for radius in (0.05, 0.3, 0.8, 3.0):
        tree = landmarks.FeatureTree(radius, 3, branching=6)
        for p in x:
            tree.add(1.0, p, float(p @ p))
        n, sums, squares = tree.entries()
        assert n.sum() == len(x) and np.allclose(sums.sum(axis=0), x.sum(axis=0)) and np.isclose(squares.sum(), (x * x).sum())
        assert (squares / n - ((sums / n[:, None]) ** 2).sum(axis=1) <= radius**2 + 1e-9).all()
        whole = tree.root.whole()
        assert whole[0] == len(x) and np.allclose(whole[1], x.sum(axis=0))
        counts.append(len(n))
    assert counts == sorted(counts, reverse=True) and counts[0] > 1000 and counts[-1] < 20


def test_birch_follows_the_threshold_and_rises_it_when_it_must(spark, monkeypatch):
    x, truth = blobs()
    m = vectors(spark, x)
    fine = landmarks._condensed(m.select(F.lit(1.0).alias("n"), vector_to_array("features").alias("sums"), F.lit(0.0).alias("squares")).limit(0), 0.1, x.shape[1])
    assert fine.agg(F.sum("n")).first()[0] is None
    for threshold in (0.05, 1.0):
        assert same_groups(labels(landmarks.birch(m, "id", 3, threshold)), truth)
    monkeypatch.setattr(landmarks, "FEATURES_MOST", 40)
    assert same_groups(labels(landmarks.birch(m, "id", 3, 0.01, most=30)), truth)
    assert landmarks.birch(m.limit(0), "id", 3).count() == 0
