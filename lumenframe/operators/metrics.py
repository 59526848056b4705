"""Exact classification and regression metrics and curves, as aggregates and windows over distinct scores."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats as S
from ..plans import order as O
from ..sources import workspace

LOWER_IS_BETTER = {"rmse", "mae", "mape", "smape", "mediana_ae", "log_loss", "rmse_norm"}
PRIMARY = {"binaria": "roc_auc", "multiclase": "f1_weighted", "regresion": "r2"}


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(real, predicho, n) over the full grid of labels; the grid is as small as the set of classes."""
    counts = df.groupBy(F.col(label).alias("real"), F.col(prediction).alias("predicho")).agg(F.count("*").alias("n"))
    names = counts.select(F.col("real").alias("c")).unionByName(counts.select(F.col("predicho").alias("c"))).distinct()
    grid = names.select(F.col("c").alias("real")).crossJoin(F.broadcast(names.select(F.col("c").alias("predicho"))))  # classes by classes
    return grid.join(counts, ["real", "predicho"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def report_table(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """clase, precision, recall, f1, soporte for each class, then accuracy, macro and weighted means."""
    return _report(confusion(df, label, prediction))


def _per_class(grid: DataFrame) -> DataFrame:
    cells = F.col("n")
    rows = grid.select(F.explode(F.array(
        F.struct(F.col("real").cast("string").alias("clase"), cells.alias("real_n"), F.lit(0).cast("long").alias("pred_n"), F.when(F.col("real") == F.col("predicho"), cells).otherwise(0).alias("hit")),
        F.struct(F.col("predicho").cast("string").alias("clase"), F.lit(0).cast("long").alias("real_n"), cells.alias("pred_n"), F.lit(0).cast("long").alias("hit")),
    )).alias("c")).select("c.*")
    sums = rows.groupBy("clase").agg(F.sum("hit").alias("hit"), F.sum("real_n").alias("soporte"), F.sum("pred_n").alias("pred"))
    p, r = F.coalesce(S.ratio(F.col("hit"), F.col("pred")), F.lit(0.0)), F.coalesce(S.ratio(F.col("hit"), F.col("soporte")), F.lit(0.0))
    return sums.select("clase", "hit", "pred", p.alias("precision"), r.alias("recall"), F.coalesce(S.ratio(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "soporte")


def _report(grid: DataFrame) -> DataFrame:
    per = _per_class(grid)
    each = per.select("clase", "precision", "recall", "f1", "soporte")
    weighted = lambda c: F.sum(F.col(c) * F.col("soporte")) / F.sum("soporte")
    total = F.sum("soporte").alias("soporte")
    exact = (F.sum("hit") / F.sum("soporte"))
    return (
        each.unionByName(per.agg(F.lit("accuracy").alias("clase"), exact.alias("precision"), exact.alias("recall"), exact.alias("f1"), total))
        .unionByName(per.agg(F.lit("macro avg").alias("clase"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total))
        .unionByName(per.agg(F.lit("weighted avg").alias("clase"), weighted("precision").alias("precision"), weighted("recall").alias("recall"), weighted("f1").alias("f1"), total))
    )


def score_table(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """For each distinct score, from high to low: pos, neg, and tp, fp up to and with it.

    Equal scores are counted together first; running sums are taken by ranges of scores, not in one task.
    """
    counts = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    ranged = workspace.keep(counts.repartitionByRange(F.col("s").desc()).withColumn("__part", F.spark_partition_id()), "scores")  # both uses see the same ranges
    inside = W.partitionBy("__part").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, 0)
    running = ranged.withColumn("tp", F.sum("pos").over(inside)).withColumn("fp", F.sum("neg").over(inside))
    part = ranged.groupBy("__part").agg(F.sum("pos").alias("sp"), F.sum("neg").alias("sn"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    part = part.select("__part", F.coalesce(F.sum("sp").over(before), F.lit(0)).alias("op"), F.coalesce(F.sum("sn").over(before), F.lit(0)).alias("on"), F.sum("sp").over(W.partitionBy()).alias("P"), F.sum("sn").over(W.partitionBy()).alias("N"))
    return running.join(F.broadcast(part), "__part").select("s", "pos", "neg", (F.col("tp") + F.col("op")).alias("tp"), (F.col("fp") + F.col("on")).alias("fp"), "P", "N")


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return score_table(df, label, score).select(F.col("s").alias("umbral"), S.ratio(F.col("fp"), F.col("N")).alias("fpr"), S.ratio(F.col("tp"), F.col("P")).alias("tpr"))


def pr_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    t = score_table(df, label, score)
    return t.select(F.col("s").alias("umbral"), S.ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), S.ratio(F.col("tp"), F.col("P")).alias("recall"))


def ranking_metrics(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """roc_auc (ties half), average_precision and log_loss, exact, one row."""
    t = score_table(df, label, score)
    auc = S.ratio(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)), F.max(F.col("P") * F.col("N")))
    ap = S.ratio(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("P"))
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("s")))
    loss = -S.ratio(F.sum(F.col("pos") * F.ln(p) + F.col("neg") * F.ln(1 - p)), F.sum(F.col("pos") + F.col("neg")))
    return t.agg(auc.alias("roc_auc"), ap.alias("average_precision"), loss.alias("log_loss"))


def multiclass_ranking(df: DataFrame, label: str = "label", probability: str = "probability") -> DataFrame:
    """roc_auc (each class against the rest, mean over the classes) and log_loss, exact, one row.

    ``probability`` is a vector with the share of class 0, 1, ... One table of (class, score) counts serves all classes: scores of all classes
    are dealt by range together, ranks inside a range are running sums, and the ranges before are added by class. Shares are put to a sum of 1 for the loss.
    A class that no row has, or that all have, has no curve; then roc_auc is null.
    """
    shares = vector_to_array(F.col(probability)) if df.schema[probability].dataType.typeName() != "array" else F.col(probability)
    rows = df.select(F.col(label).cast("int").alias("y"), shares.alias("p"))
    each = rows.select("y", F.posexplode("p").alias("c", "s"))
    counts = each.groupBy("c", "s").agg(F.count_if(F.col("y") == F.col("c")).alias("pos"), F.count_if(F.col("y") != F.col("c")).alias("neg"))
    ranged = counts.repartitionByRange("c", F.col("s").desc()).withColumn("__part", F.spark_partition_id())
    inside = W.partitionBy("__part", "c").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, 0)
    run = ranged.withColumn("up", F.sum("pos").over(inside) - F.col("pos") / 2)
    part = run.groupBy("c", "__part").agg(F.sum(F.col("neg") * F.col("up")).alias("area"), F.sum("pos").alias("sp"), F.sum("neg").alias("sn"))
    before = W.partitionBy("c").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    part = part.withColumn("earlier", F.coalesce(F.sum("sp").over(before), F.lit(0)))
    auc = part.groupBy("c").agg(S.ratio(F.sum(F.col("area") + F.col("sn") * F.col("earlier")), F.nullif(F.sum("sp") * F.sum("sn"), F.lit(0)).cast("double")).alias("auc"))
    mean = auc.agg(F.when(F.count("auc") == F.count("*"), F.avg("auc")).alias("roc_auc"))
    tiny = F.lit(2.220446049250313e-16)
    clip = lambda x: F.greatest(tiny, F.least(1 - tiny, x))
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
    loss = rows.agg(F.avg(-F.ln(clip(F.get("p", F.col("y")) / total))).alias("log_loss"))
    return mean.crossJoin(loss)  # one row by one row


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", binary: bool | None = None) -> DataFrame:
    """Count metrics from one grouping by (label, prediction), one row; ``binary`` takes class 1 for precision, recall and f1."""
    grid = df.groupBy(F.col(label).cast("string").alias("real"), F.col(prediction).cast("string").alias("predicho")).agg(F.count("*").alias("n"))
    per = _per_class(grid)
    n = F.sum("soporte")
    hits = F.sum("hit")
    cross = F.sum(F.col("soporte") * F.col("pred"))
    mcc = S.ratio(hits * n - cross, F.sqrt(n * n - F.sum(F.col("pred") * F.col("pred"))) * F.sqrt(n * n - F.sum(F.col("soporte") * F.col("soporte"))))
    pe = cross / (n * n)
    one = lambda c: F.max(F.when(F.col("clase").isin("1", "1.0"), F.col(c)))
    pick = (lambda c: one(c)) if binary else (lambda c: F.avg(c))
    weighted = lambda c: F.sum(F.col(c) * F.col("soporte")) / n
    return per.agg(
        (hits / n).alias("accuracy"), F.avg(F.when(F.col("soporte") > 0, F.col("recall"))).alias("balanced_accuracy"), pick("precision").alias("precision"),
        pick("recall").alias("recall"), pick("f1").alias("f1"), weighted("f1").alias("f1_weighted"), F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"), F.coalesce(mcc, F.lit(0.0)).alias("mcc"), S.ratio(hits / n - pe, 1 - pe).alias("kappa"),
    )


def threshold_analysis(df: DataFrame, label: str = "label", score: str = "score", steps: int = 101) -> DataFrame:
    """Metrics at evenly spaced thresholds: scores are placed between thresholds once, and counts run down from the top."""
    grid = [0.01 + 0.98 * k / (steps - 1) for k in range(steps)]
    line = lambda k: F.lit(0.01) + F.lit(0.98) * k / (steps - 1)
    near = F.least(F.greatest(F.floor((F.col(score) - 0.01) * (steps - 1) / 0.98), F.lit(-1)), F.lit(steps - 1)).cast("int")
    # how many thresholds are reached: the estimate, put right against its neighbours
    place = (near + 1 - ((near >= 0) & (line(near) > F.col(score))).cast("int") + ((near + 1 < steps) & (line(near + 1) <= F.col(score))).cast("int"))
    counts = df.filter(F.col(score).isNotNull()).groupBy(place.alias("k")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count("*").alias("n"))
    thresholds = df.sparkSession.createDataFrame([(k + 1, g) for k, g in enumerate(grid)], "k int, umbral double")
    full = thresholds.unionByName(df.sparkSession.createDataFrame([(0, None)], "k int, umbral double")).join(F.broadcast(counts), "k", "left").fillna(0, ["pos", "n"])
    down = W.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0)  # ``steps`` rows
    run = full.select("umbral", F.sum("pos").over(down).alias("tp"), F.sum("n").over(down).alias("pp"), F.sum("pos").over(W.partitionBy()).alias("P"), F.sum("n").over(W.partitionBy()).alias("n"))
    p, r = F.coalesce(S.ratio(F.col("tp"), F.col("pp")), F.lit(0.0)), F.coalesce(S.ratio(F.col("tp"), F.col("P")), F.lit(0.0))
    right = F.col("tp") + F.col("n") - F.col("P") - (F.col("pp") - F.col("tp"))
    return run.filter("umbral is not null").select(
        "umbral", S.ratio(right, F.col("n")).alias("accuracy"), p.alias("precision"), r.alias("recall"), F.coalesce(S.ratio(2 * p * r, p + r), F.lit(0.0)).alias("f1"), S.percent(F.col("pp"), F.col("n")).alias("positivos_predichos_%")
    )


def best_threshold(table: DataFrame) -> DataFrame:
    return table.agg(F.max_by("umbral", "f1").alias("umbral"), F.max("f1").alias("f1"))


def regression_columns(real: str = "label", predicted: str = "prediction", n_features: int = 1) -> dict[str, Column]:
    """The regression metrics that are aggregates: all but the median of the errors."""
    y, e = F.col(real).cast("double"), F.col(real).cast("double") - F.col(predicted)
    n, sse, sst = F.count("*"), F.sum(e * e), F.var_pop(y) * F.count("*")
    r2 = 1 - S.ratio(sse, F.nullif(sst, F.lit(0.0)))
    rmse = F.sqrt(sse / n)
    span = F.max(y) - F.min(y)
    return {
        "r2": r2, "r2_ajustado": 1 - (1 - r2) * (n - 1) / F.greatest(n - n_features - 1, F.lit(1)), "rmse": rmse, "mae": F.avg(F.abs(e)),
        "mape": 100 * F.avg(F.when(F.abs(y) > 1e-9, F.abs(e / y))), "smape": 100 * F.avg(2 * F.abs(e) / F.greatest(F.abs(y) + F.abs(F.col(predicted)), F.lit(1e-9))),
        "varianza_explicada": 1 - S.ratio(F.var_pop(e), F.nullif(F.var_pop(y), F.lit(0.0))), "rmse_norm": 100 * rmse / F.when(span != 0, span).otherwise(1.0),
    }


def regression_metrics(df: DataFrame, real: str = "label", predicted: str = "prediction", n_features: int = 1) -> DataFrame:
    """All regression metrics: one pass, and the median of the errors."""
    middle = O.quantiles(df, {"e": (F.abs(F.col(real).cast("double") - F.col(predicted)), (0.5,))})["e"][0]
    columns = regression_columns(real, predicted, n_features) | {"mediana_ae": F.lit(middle).cast("double")}
    order = ("r2", "r2_ajustado", "rmse", "mae", "mape", "smape", "mediana_ae", "varianza_explicada", "rmse_norm")
    return df.agg(*[columns[c].alias(c) for c in order])


def residuals(df: DataFrame, real: str = "label", predicted: str = "prediction") -> DataFrame:
    e = F.col(real) - F.col(predicted)
    return df.select(F.col(real).alias("real"), F.col(predicted).alias("predicho"), e.alias("residuo"), F.abs(e).alias("residuo_abs"), (100 * S.ratio(F.abs(e), F.abs(real))).alias("error_%"))


def normalized(column: Column, over: W) -> Column:
    """Min-max over a window, 0 where all are equal."""
    low, high = F.min(column).over(over), F.max(column).over(over)
    return F.coalesce(S.ratio(column - low, F.nullif(high - low, F.lit(0.0))), F.lit(0.0))
