"""Permutation importance over all rows."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from lumenframe.operators import explain, learning


def test_permutation_importance_takes_all_rows(spark):
    """The one row that says what x is worth stood outside a sample of 4,000."""
    keys = spark.range(9_000).withColumnRenamed("id", "key")
    last = keys.orderBy(F.xxhash64(F.lit(7), "key").desc()).first()["key"]
    x = F.when(F.col("key") == last, 1e5).otherwise(F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(1000)) / 1000)
    df = keys.select("key", x.alias("x"), F.pmod(F.xxhash64(F.lit(2), "key"), F.lit(1000)).alias("z")).withColumn("label", F.col("x") + F.col("z"))
    ready = learning.fit_preprocessor(df, ["x", "z"])
    model = LinearRegression().fit(ready.transform(df))
    got = {r["variable"]: r for r in explain.permutation_importance(df, model, ready, ["x", "z"], ["key"], "regresion", "r2", repeats=2).collect()}
    share = {c: df.agg(2 * F.var_pop(c) / F.var_pop("label")).first()[0] for c in ("x", "z")}  # what the error of a line grows by, on average
    assert got["x"]["importancia"] == pytest.approx(share["x"], rel=0.01) and got["z"]["importancia"] == pytest.approx(share["z"], rel=0.1)
    assert got["x"]["importancia_%"] == pytest.approx(100 * share["x"] / sum(share.values()), rel=0.01)
    classes = df.withColumn("label", (F.col("z") > 500).cast("double"))
    logit = LogisticRegression().fit(ready.transform(classes))
    told = {r["variable"]: r["importancia"] for r in explain.permutation_importance(classes, logit, ready, ["x", "z"], ["key"], "binaria", "accuracy", repeats=1).collect()}
    assert told["x"] < 0.02 and told["z"] == pytest.approx(0.5, abs=0.03)


def test_rows_are_numbered_once_each_in_every_drawn_order(spark):
    rows = spark.range(5_000).select((F.col("id") % 1_700).alias("k"), "id")  # keys repeat
    drawn = [{r["id"]: r["__n"] for r in explain._numbered(rows, seed, ["k"]).collect()} for seed in (-1, 0)]
    assert all(sorted(d.values()) == list(range(1, 5_001)) for d in drawn)
    a, b = (np.array([d[i] for i in range(5_000)]) for d in drawn)
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.1 and abs(np.corrcoef(a, np.arange(5_000))[0, 1]) < 0.1
