"""Training passes over small tables in few tasks, and over large ones with what the models need only."""

import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lumenframe.operators import extra_trees, learning, zoo


def test_small_parts_are_held_in_few_tasks(spark):
    df = spark.range(400).repartition(16).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 7 * 2 + F.col("id") % 3).cast("double").alias("y"))
    out = learning.train_models(df, "y", ["a"], ["id"], models=["Regresión Lineal"], task="regresion")
    assert out.train.rdd.getNumPartitions() == 1 and out.test.rdd.getNumPartitions() == 1
    assert (out.train.count(), out.test.count()) == (320, 80) and out.results[0].metrics["r2"] > 0.8


def test_columns_that_no_model_reads_are_not_held(spark, monkeypatch):
    seen = []
    plain = learning.split
    monkeypatch.setattr(learning, "split", lambda df, *a: seen.append(df.columns) or plain(df, *a))
    df = spark.range(100).select("id", (F.col("id") % 5).cast("double").alias("a"), F.lit("long text").alias("text"), (F.col("id") % 5).cast("double").alias("label"), F.col("id").alias("y"))
    out = learning.train_models(df, "y", ["a", "id"], ["id"], models=["Regresión Lineal"], task="regresion")
    assert seen == [["id", "a", "label"]] and out.results[0].error is None


@pytest.mark.parametrize("classify", [True, False])
def test_carried_sums_give_the_same_weights(spark, monkeypatch, classify):
    df = spark.range(300).select(array_to_vector(F.array(F.col("id") % 17 * 1.0, F.col("id") % 23 * 1.0)).alias("features"), ((F.col("id") % 17 * (F.col("id") % 23)) % 5 > 1).cast("double").alias("label")).cache()
    told = []
    for carried in (1, 3, 100):
        monkeypatch.setattr(zoo, "CARRIED", carried)
        model = zoo.AdaBoostClassifier(rounds=7).fit(df) if classify else zoo.AdaBoostRegressor(rounds=7).fit(df.withColumn("label", F.sin(vector_to_array("features")[0])))
        told.append(model.alphas if classify else model.betas)
    assert len(told[0]) > 3 and told[0] == told[1] == told[2]


def test_trees_whose_sums_are_few_grow_together(spark, monkeypatch):
    df = spark.range(200).select(array_to_vector(F.array(F.col("id") % 17 * 1.0, F.col("id") % 23 * 1.0)).alias("features"), (F.col("id") % 3 == 0).cast("double").alias("label")).cache()
    passes, plain = [], extra_trees._passed
    monkeypatch.setattr(extra_trees, "_passed", lambda *a: passes.append(1) or plain(*a))
    model = extra_trees.ExtraTrees(classes=2, trees=60, depth=2).fit(df)
    assert len(model.trees) == 60 and len(passes) == 5  # the whole, and two a level


def test_predictions_are_worked_out_once_for_all_metrics(spark):
    df = spark.range(500).coalesce(1).withColumn("label", (F.col("id") % 11).cast("double"))
    made = spark.sparkContext.accumulator(0)

    def told(x):
        made.add(len(x))
        return x % 7.0

    scored = df.withColumn("prediction", F.pandas_udf(told, "double")(F.col("id").cast("double")))
    assert learning.evaluate(scored, "regresion")["mae"] > 0
    assert made.value == 500
