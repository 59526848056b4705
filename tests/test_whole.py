"""Operators and queries over the whole of their tables."""

import numpy as np
import pytest

from lumenframe.operators import clustering as K
from lumenframe.operators import eda
from lumenframe.plans import q_cluster


@pytest.mark.parametrize("eps, least", [(0.3, 4), (0.15, 8), (1.0, 60)])
def test_dbscan_equals_brute_force(spark, eps, least):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.round(rng.normal(size=(250, 2)), 1), np.repeat([[4.0, 4.0]], 30, axis=0), rng.uniform(-4, 6, (80, 2)), 0.05 * rng.normal(size=(60, 2)) + [4.35, 4.0]])
    m = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "i long, f array<double>").select("i", K.as_vector("f").alias("features"))
    got = {r["i"]: r["prediction"] for r in K.dbscan(m, "i", eps, least).collect()}
    exact = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert [got[i] for i in range(len(x))] == K.dbscan_labels(exact, eps, least).tolist()


def test_cluster_queries_see_the_whole_table(spark, tmp_path, monkeypatch):
    rows = spark.range(1, 2301).selectExpr("id as p_partkey", "cast(1 + id % 50 as int) as p_size", "900 + (id * 7919) % 1000 as p_retailprice")
    rows.write.parquet(str(tmp_path / "part.parquet"))
    assert q_cluster.dbscan(spark, str(tmp_path)).count() == 2300
    seen = {}
    monkeypatch.setattr(K, "dbscan_grid", lambda m, **own: seen.update(grid=own) or m)
    monkeypatch.setattr(K, "hierarchical", lambda m, key, k, **own: seen.update(tree=own) or (m, None))
    q_cluster.dbscan_grid(spark, str(tmp_path))
    spark.createDataFrame([(1, 0, [0.5])], "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    q_cluster.hierarchical(spark, str(tmp_path))
    assert seen == {"grid": {}, "tree": {}}


@pytest.mark.parametrize("rows", [1 << 14, 200])
def test_kendall_takes_all_rows(spark, rows):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=2600), 1)
    y = np.where(np.arange(2600) % 3 > 0, np.round(x + rng.normal(size=2600), 1), rng.normal(size=2600))
    df = spark.createDataFrame([*zip(x.tolist(), y.tolist(), strict=True), (None, 1.0), (1.0, None)], "x double, y double")
    sx, sy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    want = (sx * sy).sum() / np.sqrt((sx * sx).sum() * (sy * sy).sum())
    assert eda.corr_kendall(df, "x", "y", rows=rows).first()["correlacion"] == pytest.approx(want, abs=1e-12)
    assert eda.corr_kendall(df.limit(0), "x", "y").first()["correlacion"] is None
