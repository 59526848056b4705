"""Mixtures of every covariance form against EM on one array."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array

from lumenframe.operators import clustering, mixture


def frame(spark, x):
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, x array<double>")
    return df.select("id", array_to_vector("x").alias("features"))


def plain_em(x, own, k, form, rounds, floor=1e-6):
    """EM from hard parts, written with densities as such and one row at a time sums."""
    n, d = x.shape
    r = np.eye(k)[own]
    for step in range(rounds + 1):
        held = r.sum(0)
        means = np.array([(r[:, c, None] * x).sum(0) / held[c] for c in range(k)])
        each = [sum(r[i, c] * np.outer(x[i] - means[c], x[i] - means[c]) for i in range(n)) / held[c] for c in range(k)]
        if form == "full":
            cov = [e + floor * np.eye(d) for e in each]
        elif form == "tied":
            cov = [sum(h * e for h, e in zip(held, each, strict=True)) / n + floor * np.eye(d)] * k
        elif form == "diag":
            cov = [np.diag(np.diag(e) + floor) for e in each]
        else:
            cov = [np.eye(d) * (np.trace(e) / d + floor) for e in each]
        if step == rounds:
            return held / n, means, cov, r
        density = np.array([[held[c] / n * np.exp(-0.5 * (p - means[c]) @ np.linalg.inv(cov[c]) @ (p - means[c])) / np.sqrt(np.linalg.det(2 * np.pi * cov[c])) for c in range(k)] for p in x])
        r = density / density.sum(1, keepdims=True)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(250, 2)) @ [[1.0, 0.6], [0, 0.5]], rng.normal(size=(150, 2)) * [0.4, 1.5] + [4, 1], rng.normal(size=(100, 2)) * 0.7 + [0, 5]])
    return x, frame(spark, x).repartition(5).cache()


@pytest.mark.parametrize("form", mixture.FORMS)
def test_em_equals_plain_em(cloud, form):
    x, m = cloud
    fitted = mixture.Mixture(3, form, rounds=6, tol=-1.0).fit(m)
    own = clustering.kmeans(m, 3, seeds=1).transform(m).orderBy("id").select("prediction").toPandas()["prediction"].to_numpy()
    weights, means, cov, _ = plain_em(x, own, 3, form, 6)
    assert fitted.rounds == 6 and np.allclose(fitted.weights, weights) and np.allclose(fitted.means, means)
    full = {"full": lambda c: fitted.covariance[c], "tied": lambda c: fitted.covariance, "diag": lambda c: np.diag(fitted.covariance[c]), "spherical": lambda c: np.eye(2) * fitted.covariance[c]}[form]
    assert all(np.allclose(full(c), cov[c]) for c in range(3))
    rows = fitted.transform(m).select("id", "prediction", vector_to_array("probability").alias("p")).orderBy("id").collect()
    *_, r = plain_em(x, own, 3, form, 7)
    assert np.allclose([row["p"] for row in rows], r) and [row["prediction"] for row in rows] == r.argmax(1).tolist()


def test_ends_by_gain_and_runs_by_name(spark, cloud):
    _, m = cloud
    fitted = mixture.Mixture(3, "diag").fit(m)
    assert 1 < fitted.rounds < 100
    for form in ("tied", "full"):
        out = clustering.run_clustering(m, "id", "Gaussian Mixture", 3, covariance_type=form)
        assert out.error is None and out.metrics["clusters"] == 3
    assert "covariance_type" in clustering.run_clustering(m, "id", "Gaussian Mixture", 3, covariance_type="odd").error
    same = mixture.Mixture(2, "full", rounds=3).fit(frame(spark, [(1.0, 2.0)] * 5 + [(3.0, 2.0)] * 4))  # a constant column
    assert np.isfinite(same.log_likelihood)
    assert same.transform(frame(spark, [(1.0, 2.0), (3.0, 2.0)])).select("prediction").distinct().count() == 2
