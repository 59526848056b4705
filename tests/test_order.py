"""Exact quantiles and counts against numpy, with tiny sketches so that the brackets matter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.plans import order


@pytest.mark.parametrize("accuracy", [10, 10_000])
def test_quantiles_equal_numpy(spark, accuracy):
    rng = np.random.default_rng(4)
    columns = {"a": rng.normal(size=3000), "b": rng.integers(0, 4, 3000).astype(float), "c": np.where(rng.random(3000) < 0.9, 7.0, rng.random(3000)), "d": np.full(3000, -2.5)}
    rows = [tuple(float(v) for v in r) for r in zip(*columns.values(), strict=True)]
    df = spark.createDataFrame([*rows, (None, None, None, None)], "a double, b double, c double, d double").repartition(5)
    ps = (0.0, 0.05, 0.25, 0.5, 0.501, 0.75, 0.95, 1.0)
    got = order.quantiles(df, {c: (F.col(c), ps) for c in columns}, accuracy)
    for c, x in columns.items():
        assert got[c] == pytest.approx(np.quantile(x, ps)), c


def test_quantiles_of_few_and_no_values(spark):
    df = spark.createDataFrame([(1.0, None), (4.0, None), (2.0, None)], "a double, b double")
    assert order.quantiles(df, {"a": (F.col("a"), (0.0, 0.25, 0.5, 0.9)), "b": (F.col("b"), (0.5,))}) == {"a": [1.0, 1.5, 2.0, pytest.approx(3.6)], "b": [None]}
    assert order.quantiles(df.limit(0), {"a": (F.col("a"), (0.5,))}) == {"a": [None]} and order.quantiles(df, {}) == {}


def test_tallies_and_distinct(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 1.0), ("y", 0.0), (None, -0.0), ("x", None)], "s string, v double")
    assert order.tallies(df, {"v": F.col("v")}) == {"v": (2, 0.0, 2)}
    assert order.tallies(df, {"s": F.col("s")}, "string") == {"s": (2, "x", 2)}
    assert order.distinct_counts(df, {"s": F.col("s"), "v": F.col("v"), "n": F.lit(None).cast("string")}) == {"s": 2, "v": 2, "n": 0}
    assert order.distinct_rows(df, [F.col("s"), F.col("v")]) == 5


def test_rows_meet_the_brackets_of_few_groups_without_a_shuffle(spark, capsys):
    """Rows dealt by a few groups would put a large share of the table into one task."""
    df = spark.range(2_000_000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"))
    told = order.group_quantiles(df, F.col("g"), F.col("x"), (0.5,))
    told.explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {r["g"]: r["q"] for r in told.collect()} == {0: [999_999.0], 1: [1_000_000.0], 2: [999_999.5]}
