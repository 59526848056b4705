"""Splits, metrics, curves, preprocessing and training."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import explain, learning, metrics
from .inputs import rounded, table


def _scored(spark, d):
    """A deterministic pseudo-score with ties: from orders, label by status."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("label"), ((F.col("o_orderkey") * 37 % 101) / 101.0 * 0.7 + F.when(F.col("o_orderstatus") == "F", 0.3).otherwise(0.0)).alias("score"))


_S = "(select o_orderkey, (o_orderstatus = 'F')::int as label, (o_orderkey * 37 % 101) / 101.0::double * 0.7::double + case when o_orderstatus = 'F' then 0.3::double else 0.0::double end as score from orders)"


def _classes(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderstatus").alias("label"), F.when(F.col("o_orderkey") % 4 == 0, "F").when(F.col("o_orderkey") % 7 == 0, "P").otherwise(F.col("o_orderstatus")).alias("prediction"))


_C = "(select o_orderstatus as label, case when o_orderkey % 4 = 0 then 'F' when o_orderkey % 7 = 0 then 'P' else o_orderstatus end as prediction from orders)"
_PER = f"""per as (select c as clase, count(*) filter (where label = c and prediction = c) as hit, count(*) filter (where prediction = c) as pred, count(*) filter (where label = c) as soporte
 from {_C}, (select distinct c from (select label as c from {_C} union select prediction from {_C})) group by c),
m as (select clase, hit, pred, soporte, coalesce(hit * 1.0 / nullif(pred, 0), 0) as p, coalesce(hit * 1.0 / nullif(soporte, 0), 0) as r from per),
f as (select *, coalesce(2 * p * r / nullif(p + r, 0), 0) as f1 from m)"""
_REPORT = f"""with {_PER}
select clase, round(p, 4)::double as precision, round(r, 4)::double as recall, round(f1, 4)::double as f1, soporte from f
union all select 'accuracy', round(sum(hit) / sum(soporte), 4)::double, round(sum(hit) / sum(soporte), 4)::double, round(sum(hit) / sum(soporte), 4)::double, sum(soporte)::bigint from f
union all select 'macro avg', round(avg(p), 4)::double, round(avg(r), 4)::double, round(avg(f1), 4)::double, sum(soporte)::bigint from f
union all select 'weighted avg', round(sum(p * soporte) / sum(soporte), 4)::double, round(sum(r * soporte) / sum(soporte), 4)::double, round(sum(f1 * soporte) / sum(soporte), 4)::double, sum(soporte)::bigint from f"""
_METRICS = f"""with {_PER}, s as (select sum(soporte)::double as n, sum(hit)::double as h, sum(soporte * pred)::double as x, sum(pred * pred)::double as pp, sum(soporte * soporte)::double as ss from f)
select round(h / n, 4) as accuracy, round((select avg(r) from f where soporte > 0), 4)::double as balanced_accuracy, round((select avg(p) from f), 4)::double as precision, round((select avg(r) from f), 4)::double as recall,
 round((select avg(f1) from f), 4)::double as f1, round((select sum(f1 * soporte) from f) / n, 4)::double as f1_weighted, round((select avg(p) from f), 4)::double as precision_macro, round((select avg(r) from f), 4)::double as recall_macro,
 round((h * n - x) / (sqrt(n * n - pp) * sqrt(n * n - ss)), 4) as mcc, round((h / n - x / (n * n)) / (1 - x / (n * n)), 4) as kappa from s"""
_CURVE = f"""t as (select score as s, count(*) filter (where label = 1) as pos, count(*) filter (where label = 0) as neg from {_S} group by 1),
c as (select *, sum(pos) over (order by s desc) as tp, sum(neg) over (order by s desc) as fp, sum(pos) over () as p, sum(neg) over () as n from t)"""


def clf_metrics(spark, d):
    return rounded(metrics.classification_metrics(_classes(spark, d)))


def confusion(spark, d):
    return metrics.confusion(_classes(spark, d))


def report_table(spark, d):
    return rounded(metrics.report_table(_classes(spark, d)))


def roc_curve(spark, d):
    return rounded(metrics.roc_curve(_scored(spark, d)), 6)


def pr_curve(spark, d):
    return rounded(metrics.pr_curve(_scored(spark, d)), 6)


def ranking(spark, d):
    return rounded(metrics.ranking_metrics(_scored(spark, d)))


def threshold_analysis(spark, d):
    return rounded(metrics.threshold_analysis(_scored(spark, d)), pct_positivos="positivos_predichos_%")


_THRESHOLD = f"""with g as (select 0.01::double + 0.98::double * k / 100 as u from range(101) r(k)), c as (select u, count(*) filter (where score >= u and label = 1) as tp, count(*) filter (where score >= u) as pp, count(*) filter (where label = 1) as p, count(*) as n from g, {_S} group by u),
m as (select *, coalesce(tp * 1.0 / nullif(pp, 0), 0) as pr, coalesce(tp * 1.0 / nullif(p, 0), 0) as re from c)
select round(u, 4) as umbral, round((tp + n - p - (pp - tp)) * 1.0 / n, 4)::double as accuracy, round(pr, 4)::double as precision, round(re, 4)::double as recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 4)::double as f1, round(100.0 * pp / n, 2)::double as pct_positivos from m"""


def _predicted(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1000 + F.col("l_discount") * 50).alias("prediction"))


_P = "(select l_extendedprice as label, l_quantity * 1000 + l_discount * 50 as prediction from lineitem)"


def reg_metrics(spark, d):
    return rounded(metrics.regression_metrics(_predicted(spark, d), n_features=2))


_REG = f"""select round(r2, 4) as r2, round(1 - (1 - r2) * (n - 1) / greatest(n - 2 - 1, 1), 4) as r2_ajustado, round(rmse, 4) as rmse, round(mae, 4) as mae, round(mape, 4) as mape, round(smape, 4) as smape, round(med, 4) as mediana_ae, round(ve, 4) as varianza_explicada, round(100 * rmse / span, 4) as rmse_norm
from (select count(*) as n, 1 - sum((label - prediction) ** 2) / (var_pop(label) * count(*)) as r2, sqrt(avg((label - prediction) ** 2)) as rmse, avg(abs(label - prediction)) as mae, 100 * avg(abs((label - prediction) / label)) filter (where abs(label) > 1e-9) as mape,
 100 * avg(2 * abs(label - prediction) / greatest(abs(label) + abs(prediction), 1e-9)) as smape, median(abs(label - prediction)) as med, 1 - var_pop(label - prediction) / var_pop(label) as ve, max(label) - min(label) as span from {_P})"""


def residuals(spark, d):
    return rounded(metrics.residuals(_predicted(spark, d)), error_pct="error_%")


def split_stratified(spark, d):
    return learning.split(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"])


def cv_folds(spark, d):
    return learning.folds(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"], 5)


def _features(scaler="standard", encoder="onehot", columns=("o_totalprice",)):
    def run(spark, d):
        from pyspark.ml.functions import vector_to_array

        o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
        ready = learning.fit_preprocessor(o, list(columns), scaler=scaler, encoder=encoder)
        values = vector_to_array("features")
        return ready.transform(o).select("o_orderkey", *[F.round(F.element_at(values, k + 1), 4).alias(f"f{k}") for k in range(len(ready.names))])

    return run


_SCALED = {
    "standard": "(o_totalprice - (select avg(o_totalprice) from orders)) / (select stddev_pop(o_totalprice) from orders)",
    "minmax": "(o_totalprice - (select min(o_totalprice) from orders)) / (select max(o_totalprice) - min(o_totalprice) from orders)",
    "robust": "(o_totalprice - (select median(o_totalprice) from orders)) / (select quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) from orders)",
}
_ONE_HOT = "select o_orderkey, " + ", ".join(f"(o_orderpriority = (select p from (select distinct o_orderpriority as p from orders) order by p limit 1 offset {k}))::int::double as f{k}" for k in range(5)) + " from orders"
_ORDINAL = "select o_orderkey, (dense_rank() over (order by o_orderpriority) - 1)::double as f0 from orders"


def _board(target, features, key, name, models=None):
    def run(spark, d):
        df = table(spark, d, name)
        out = learning.train_models(df, target, features, key, models=models, fast=True)
        return out.leaderboard().drop("tiempo_s")

    return run


def train_leaderboard_clf(spark, d):
    docs = table(spark, d, "documents").drop("text").join(table(spark, d, "labels"), "doc_id")
    return learning.train_models(docs, "quality", ["n_chars", "lang", "toxic"], ["doc_id"], fast=True).leaderboard().drop("tiempo_s")


def train_nets(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_brand", "p_retailprice")
    return learning.train_models(p, "p_retailprice", ["p_size", "p_brand", "p_partkey"], ["p_partkey"], models=["SVM (aprox.)", "MLP"], fast=False).leaderboard().drop("tiempo_s")


def train_zoo_clf(spark, d):
    """Every model for classes."""
    docs = table(spark, d, "documents").drop("text").join(table(spark, d, "labels"), "doc_id")
    return learning.train_models(docs, "quality", ["n_chars", "lang", "toxic"], ["doc_id"], fast=False).leaderboard().drop("tiempo_s")


def train_zoo_reg(spark, d):
    """Every model for numbers."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return learning.train_models(s, "s_acctbal", ["s_suppkey", "s_nationkey"], ["s_suppkey"], fast=False).leaderboard().drop("tiempo_s")


def cv_search(spark, d):
    """Cross-validated forests over drawn settings."""
    docs = table(spark, d, "documents").drop("text").join(table(spark, d, "labels"), "doc_id")
    out = learning.train_models(docs, "quality", ["n_chars", "lang"], ["doc_id"], models=["Árbol de Decisión"], cv=3)
    tree = learning.model_zoo(out.task, 1)["Árbol de Decisión"]
    labelled, _ = learning.encode_labels(docs, "quality", out.task)
    best, score = learning.random_search(out, labelled, ["doc_id"], "Árbol de Decisión", tree, {"maxDepth": [2, 4, 8], "minInstancesPerNode": [1, 5]}, n_iter=3)
    return spark.createDataFrame([(k, float(v), score, *out.results[0].cv) for k, v in sorted(best.items())], "parametro string, valor double, mejor double, cv1 double, cv2 double, cv3 double")


def learning_curve(spark, d):
    docs = table(spark, d, "documents").drop("text").join(table(spark, d, "labels"), "doc_id")
    tree = learning.model_zoo("binaria", 1)["Árbol de Decisión"]
    return rounded(learning.learning_curve(docs, "quality", ["n_chars", "lang"], ["doc_id"], tree, "binaria", sizes=(0.25, 0.5, 1.0)))


def multiclass_ranking(spark, d):
    """Three classes, shares with ties that sum to 1."""
    o = table(spark, d, "orders")
    a, b = ((F.col("o_orderkey") * k % 17 + F.when(F.col("o_orderstatus") == s, 9).otherwise(1)).cast("double") for k, s in ((5, "F"), (3, "O")))
    c = (F.col("o_orderkey") * 7 % 13 + F.when(F.col("o_orderstatus") == "P", 9).otherwise(1)).cast("double")
    label = (F.array_position(F.array(*[F.lit(x) for x in "FOP"]), F.col("o_orderstatus")) - 1).cast("double")
    return rounded(metrics.multiclass_ranking(o.select(label.alias("label"), F.array(*[x / (a + b + c) for x in (a, b, c)]).alias("probability"))), 6)


_MULTI = """with r as (select case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as y, (o_orderkey * 5 % 17 + case when o_orderstatus = 'F' then 9 else 1 end)::double as a,
 (o_orderkey * 3 % 17 + case when o_orderstatus = 'O' then 9 else 1 end)::double as b, (o_orderkey * 7 % 13 + case when o_orderstatus = 'P' then 9 else 1 end)::double as c from orders),
e as (select y, 0 as k, a / (a + b + c) as s from r union all select y, 1, b / (a + b + c) from r union all select y, 2, c / (a + b + c) from r),
t as (select k, s, count(*) filter (where y = k) as pos, count(*) filter (where y <> k) as neg from e group by 1, 2),
u as (select *, sum(pos) over (partition by k order by s desc) as tp from t), auc as (select k, sum(neg * (tp - pos / 2.0)) / (sum(pos) * sum(neg)) as auc from u group by k)
select round((select avg(auc) from auc), 6)::double as roc_auc, round((select avg(-ln(s)) from e where y = k), 6)::double as log_loss"""


def _price_model(spark, d, name):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    out = learning.train_models(p, "p_retailprice", ["p_size", "p_partkey"], ["p_partkey"], models=[name])
    return p, out, out.results[0].model


def shap_trees(spark, d):
    """Shapley values of a forest for all parts, with what they must sum to."""
    p, out, model = _price_model(spark, d, "Random Forest")
    told, base = explain.tree_shap(model.transform(out.preprocessor.transform(p).select("p_partkey", "features")), model)
    return rounded(told.select("p_partkey", "prediction", F.col("shap")[0].alias("shap_0"), F.col("shap")[1].alias("shap_1"), F.lit(base).alias("base")))


def importance_models(spark, d):
    """Shares of importance by each method, of a forest and of a line."""
    p, out, forest = _price_model(spark, d, "Random Forest")
    told, _ = explain.tree_shap(out.preprocessor.transform(p), forest)
    line = _price_model(spark, d, "Regresión Lineal")
    linear = explain.linear_shap(line[1].preprocessor.transform(p), line[2])
    methods = {
        "nativa": explain.native_importance(spark, forest, out.preprocessor, out.features), "shap": explain.shap_importance(told, out.preprocessor, out.features),
        "lineal": explain.shap_importance(linear, line[1].preprocessor, out.features), "coeficientes": explain.native_importance(spark, line[2], line[1].preprocessor, out.features),
    }
    return rounded(explain.importance_consensus(methods))


def signed_coefficients(spark, d):
    _, out, line = _price_model(spark, d, "Regresión Lineal")
    return rounded(explain.signed_coefficients(spark, line, out.preprocessor, out.features))


def permutation_importance(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_brand", "p_retailprice")
    out = learning.train_models(p, "p_retailprice", ["p_size", "p_brand", "p_partkey"], ["p_partkey"], models=["Regresión Lineal"])
    best = out.results[0]
    labelled = p.withColumn("label", F.col("p_retailprice"))
    return explain.permutation_importance(labelled, best.model, out.preprocessor, out.features, ["p_partkey"], out.task, "r2")


def partial_dependence(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    out = learning.train_models(p, "p_retailprice", ["p_size", "p_partkey"], ["p_partkey"], models=["Regresión Lineal"])
    return explain.partial_dependence(p, out.results[0].model, out.preprocessor, "p_size", 10)


def importance_consensus(spark, d):
    """Shares of the segments by customers and, but for one of them, by positive balance."""
    c = table(spark, d, "customer")
    share = lambda df, x: df.groupBy(F.col("c_mktsegment").alias("variable")).agg(x.alias("v")).select("variable", (100 * F.col("v") / F.sum("v").over(W.partitionBy())).alias("importancia_%"))  # noqa: E731  a row a segment
    a, b = share(c, F.count("*")), share(c.filter("c_mktsegment <> 'BUILDING'"), F.sum(F.greatest("c_acctbal", F.lit(0.0))))
    return rounded(explain.importance_consensus({"a": a, "b": b}), pct_a="%_a", pct_b="%_b", importancia_promedio_pct="importancia_promedio_%")


_CONSENSUS = """with a as (select c_mktsegment as variable, 100.0::double * count(*) / (select count(*) from customer) as pct_a from customer group by 1),
s as (select c_mktsegment as variable, sum(greatest(c_acctbal, 0.0)) as v from customer where c_mktsegment <> 'BUILDING' group by 1), b as (select variable, 100 * v / (select sum(v) from s) as pct_b from s),
ra as (select *, rank() over (order by pct_a desc)::int as rank_a from a), rb as (select *, rank() over (order by pct_b desc)::int as rank_b from b)
select variable, round(pct_a, 4) as pct_a, rank_a, round(pct_b, 4) as pct_b, rank_b, round((coalesce(rank_a, 0) + coalesce(rank_b, 0)) / ((rank_a is not null)::int + (rank_b is not null)::int), 4)::double as rank_promedio, round((coalesce(pct_a, 0) + coalesce(pct_b, 0)) / 2, 4)::double as importancia_promedio_pct
from ra full join rb using (variable)"""


QUERIES = {
    "clf_metrics": (clf_metrics, _METRICS),
    "confusion": (confusion, f"select real, predicho, count(c.label) as n from (select distinct label as real from {_C}) cross join (select distinct prediction as predicho from {_C}) left join {_C} c on c.label = real and c.prediction = predicho group by real, predicho"),
    "report_table": (report_table, _REPORT),
    "roc_curve": (roc_curve, f"with {_CURVE} select round(s, 6) as umbral, round(fp / n::double, 6) as fpr, round(tp / p::double, 6) as tpr from c"),
    "pr_curve": (pr_curve, f"with {_CURVE} select round(s, 6) as umbral, round(tp / (tp + fp)::double, 6) as precision, round(tp / p::double, 6) as recall from c"),
    "ranking_metrics": (ranking, f"with {_CURVE} select round(sum(neg * (tp - pos / 2.0)) / max(p * n), 4)::double as roc_auc, round(sum(pos * tp / (tp + fp)::double) / max(p), 4)::double as average_precision, round(-sum(pos * ln(greatest(1e-9, least(1 - 1e-9, s))) + neg * ln(1 - greatest(1e-9, least(1 - 1e-9, s)))) / sum(pos + neg), 4)::double as log_loss from c"),
    "threshold_analysis": (threshold_analysis, _THRESHOLD),
    "reg_metrics": (reg_metrics, _REG),
    "residuals": (residuals, f"select round(label, 4) as real, round(prediction, 4) as predicho, round(label - prediction, 4) as residuo, round(abs(label - prediction), 4) as residuo_abs, round(100 * abs(label - prediction) / nullif(abs(label), 0), 4) as error_pct from {_P}"),
    "split_stratified": (split_stratified, None),
    "cv_folds": (cv_folds, None),
    **{f"scale_{k}": (_features(k), f"select o_orderkey, round({v}, 4) as f0 from orders") for k, v in _SCALED.items()},
    "ohe_rare": (_features(columns=("o_orderpriority",)), _ONE_HOT),
    "ordinal_encode": (_features(encoder="ordinal", columns=("o_orderpriority",)), _ORDINAL),
    "train_leaderboard_clf": (train_leaderboard_clf, None),
    "train_leaderboard_reg": (_board("l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "lineitem"), None),
    "train_nets": (train_nets, None),
    "train_zoo_clf": (train_zoo_clf, None),
    "train_zoo_reg": (train_zoo_reg, None),
    "cv_search": (cv_search, None),
    "learning_curve": (learning_curve, None),
    "multiclass_ranking": (multiclass_ranking, _MULTI),
    "shap_trees": (shap_trees, None),
    "importance_models": (importance_models, None),
    "signed_coefficients": (signed_coefficients, None),
    "permutation_importance": (permutation_importance, None),
    "partial_dependence": (partial_dependence, None),
    "importance_consensus": (importance_consensus, _CONSENSUS),
}
