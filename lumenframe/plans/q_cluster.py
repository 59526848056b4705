"""Segmentation, scenarios and segment advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering as K
from ..operators import density, insights, landmarks, mixture, roles
from .inputs import rounded, table


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", K.as_vector("embedding").alias("features"))


def kmeans_labels(spark, d):
    m = _vectors(spark, d)
    return K.kmeans(m, 10, seeds=2).transform(m).select("vec_id", "prediction")


def compactness(spark, d):
    return rounded(K.compactness(_vectors(spark, d), "label").drop("inercia"))


_CD = """e as (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as p from embeddings), c as (select label, p, avg(v) as m, count(*) as n from e group by label, p), g as (select p, avg(v) as m from e group by p),
dist as (select e.vec_id, e.label, sum((v - m) * (v - m)) as ss from e join c on e.label = c.label and e.p = c.p group by 1, 2), s as (select label, avg(sqrt(ss)) as s, sum(ss) as ss, count(*) as n from dist group by 1)"""
_COMPACT = f"""with {_CD}, b as (select sum(c.n * (c.m - g.m) * (c.m - g.m)) as b from c join g using (p)), k as (select count(*) as k, sum(n)::bigint as n, sum(ss) as w from s),
cc as (select a.label as i, b.label as j, sqrt(sum((a.m - b.m) * (a.m - b.m))) as d from c a join c b on a.p = b.p and a.label <> b.label group by 1, 2),
r as (select i, max((x.s + y.s) / d) as r from cc join s x on x.label = i join s y on y.label = j group by i)
select round((b / (k - 1)) / (w / (n - k)), 4) as calinski_harabasz, k as clusters, round((select avg(r) from r), 4) as davies_bouldin from b, k"""


def external(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 3).alias("cluster"), "o_orderstatus")
    return rounded(K.external_validation(o, "cluster", "o_orderstatus"))


_EXT = """with c as (select o_orderkey % 3 as a, o_orderstatus as b, count(*)::double as n from orders group by 1, 2), ra as (select sum(n) as r from c group by a), cb as (select sum(n) as r from c group by b), t as (select sum(n) as n, sum(n * (n - 1) / 2) as sij, sum(n * ln(n)) as lij from c),
s as (select t.n, sij, lij, (select sum(r * (r - 1) / 2) from ra) as si, (select sum(r * (r - 1) / 2) from cb) as sj, (select sum(r * ln(r)) from ra) as li, (select sum(r * ln(r)) from cb) as lj from t)
select round((sij - si * sj / (n * (n - 1) / 2)) / ((si + sj) / 2 - si * sj / (n * (n - 1) / 2)), 4) as ari, round((ln(n) + (lij - li - lj) / n) / ((ln(n) - li / n + ln(n) - lj / n) / 2), 4) as nmi, n::bigint as n from s"""


def cluster_sizes(spark, d):
    return rounded(K.cluster_sizes(table(spark, d, "customer"), "c_mktsegment"), pct_del_total="%_del_total")


def cluster_profile(spark, d):
    out = K.profile_clusters(table(spark, d, "customer"), "c_mktsegment", ["c_acctbal"])
    return rounded(out.select("cluster", "variable", F.col("valor_cluster").cast("double").alias("valor_cluster"), "mediana_cluster", F.col("`diferencia_%`").alias("diferencia_pct"), "z_diferencia", "n"))


_PROFILE = """select c_mktsegment as cluster, 'c_acctbal' as variable, round(avg(c_acctbal), 4) as valor_cluster, round(median(c_acctbal), 4) as mediana_cluster, round(100 * (avg(c_acctbal) - g) / abs(g), 4) as diferencia_pct, round((avg(c_acctbal) - g) / s, 4) as z_diferencia, count(*) as n
from customer, (select avg(c_acctbal) as g, stddev_pop(c_acctbal) as s from customer) group by c_mktsegment, g, s"""


def centroids_rollup(spark, d):
    return rounded(K.centroids_table(table(spark, d, "customer"), "c_mktsegment", ["c_acctbal", "c_nationkey"]))


def target_by_cluster(spark, d):
    return rounded(K.target_by_cluster(table(spark, d, "customer"), "c_mktsegment", "c_acctbal"), vs_global_pct="vs_global_%")


_TARGET = """select c_mktsegment as cluster, round(avg(c_acctbal), 4) as promedio, round(median(c_acctbal), 4) as mediana, round(min(c_acctbal), 4) as minimo, round(max(c_acctbal), 4) as maximo, count(*) as n, round(100 * (avg(c_acctbal) - g) / abs(g), 4) as vs_global_pct
from customer, (select avg(c_acctbal) as g from customer) group by c_mktsegment, g"""


def k_selection(spark, d):
    return rounded(K.k_selection(_vectors(spark, d).select("vec_id", "features")))


def pca_variance(spark, d):
    return rounded(K.pca(_vectors(spark, d), 5)[1])


def hopkins(spark, d):
    return spark.createDataFrame([(round(K.hopkins(_vectors(spark, d)), 4),)], "hopkins double")


def dbscan(spark, d):
    m, _ = K.prepare_matrix(table(spark, d, "part"), ["p_size", "p_retailprice"], ["p_partkey"])
    return K.dbscan(m, "p_partkey", 0.15, 8)


def hdbscan(spark, d):
    m, _ = K.prepare_matrix(table(spark, d, "part"), ["p_size", "p_retailprice"], ["p_partkey"])
    return density.hdbscan(m, "p_partkey")


def dbscan_grid(spark, d):
    m, _ = K.prepare_matrix(table(spark, d, "part"), ["p_size", "p_retailprice"], ["p_partkey"])
    return rounded(K.dbscan_grid(m))


def hierarchical(spark, d):
    return K.hierarchical(_vectors(spark, d), "vec_id", 10)[0]


def birch(spark, d):
    return landmarks.birch(_vectors(spark, d), "vec_id", 10)


def spectral(spark, d):
    return landmarks.spectral(_vectors(spark, d), "vec_id", 10)


def mean_shift(spark, d):
    m, _ = K.prepare_matrix(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"], ["c_custkey"])
    return landmarks.mean_shift(m, "c_custkey")[0]


def gmm_forms(spark, d):
    """Labels of customers by mixtures of every covariance form."""
    m, _ = K.prepare_matrix(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"], ["c_custkey"])
    out = m.select("c_custkey")
    for form in mixture.FORMS:
        out = out.join(mixture.Mixture(4, form, rounds=30).fit(m).transform(m).select("c_custkey", F.col("prediction").alias(form)), "c_custkey")
    return out


def compare_algorithms(spark, d):
    m, _ = K.prepare_matrix(table(spark, d, "supplier"), ["s_acctbal", "s_nationkey"], ["s_suppkey"])
    return rounded(K.compare_algorithms(m, "s_suppkey", ["KMeans", "Gaussian Mixture", "Jerárquico", "Birch", "DBSCAN"], 4), pct_ruido="%_ruido")


def suggest_features(spark, d):
    p = table(spark, d, "part")
    return K.suggest_features(p, roles.infer_roles(p))


def tsne(spark, d):
    return rounded(K.project(_vectors(spark, d).select("vec_id", "features"), "vec_id", "t-SNE")[0])


def name_clusters(spark, d):
    return rounded(K.name_clusters(table(spark, d, "customer"), "c_mktsegment", ["c_acctbal", "c_nationkey"]))


def optimizer_grid(spark, d):
    """Levers take the values of the table, the rest stays at its mean."""
    li = table(spark, d, "lineitem")
    levers = {c: [float(r[0]) for r in li.select(c).distinct().orderBy(c).collect()] for c in ("l_linenumber", "l_discount")}  # 7 and 11 values
    mean = li.agg(F.avg("l_extendedprice")).first()[0]
    grid = insights.scenario_grid(spark, {"l_extendedprice": mean}, levers)
    scored = 2 * F.col("l_linenumber") - 0.1 * F.col("l_discount") + F.col("l_extendedprice")
    return rounded(insights.optimize(grid, scored, mean, list(levers)), mejora_pct="mejora_%")


_OPT = """with z as (select avg(l_extendedprice) as z from lineitem), p as (select l_linenumber::double as x, row_number() over (order by l_linenumber) - 1 as a from (select distinct l_linenumber from lineitem)),
q as (select l_discount as y, row_number() over (order by l_discount) - 1 as b, count(*) over () as n from (select distinct l_discount from lineitem)),
g as (select a * n + b as i, x, y, 2 * x - 0.1::double * y + z as r, z from p, q, z)
select row_number() over (order by r desc, i)::int as ranking, i::bigint as escenario, x as l_linenumber, round(y, 4) as l_discount, round(r, 4) as resultado_esperado, round(r - z, 4) as vs_escenario_actual, round(100 * (r - z) / z, 4) as mejora_pct from g"""


def segment_actions(spark, d):
    return insights.segment_actions(K.cluster_sizes(table(spark, d, "orders"), "o_orderstatus")).select("cluster", F.col("tamaño").alias("n"), "prioridad")


_SEG = """select o_orderstatus as cluster, count(*) as n, case when 100.0 * count(*) / (select count(*) from orders) >= 30 then 'Alta' when 100.0 * count(*) / (select count(*) from orders) <= 5 then 'Baja' else 'Media' end as prioridad from orders group by 1"""


QUERIES = {
    "kmeans_labels": (kmeans_labels, None),
    "ch_db_index": (compactness, _COMPACT),
    "external_validation": (external, _EXT),
    "cluster_sizes": (cluster_sizes, "select c_mktsegment as cluster, count(*) as n_registros, round(100.0 * count(*) / (select count(*) from customer), 2) as pct_del_total, 'Segmento ' || c_mktsegment as etiqueta from customer group by 1"),
    "cluster_profile": (cluster_profile, _PROFILE),
    "centroids_rollup": (centroids_rollup, "select case when grouping(c_mktsegment) = 1 then 'GLOBAL' else c_mktsegment end as cluster, round(avg(c_acctbal), 4) as c_acctbal, round(avg(c_nationkey), 4) as c_nationkey from customer group by rollup(c_mktsegment)"),
    "target_by_cluster": (target_by_cluster, _TARGET),
    "k_selection": (k_selection, None),
    "pca_variance": (pca_variance, None),
    "hopkins": (hopkins, None),
    "dbscan": (dbscan, None),
    "hdbscan": (hdbscan, None),
    "dbscan_grid": (dbscan_grid, None),
    "hierarchical": (hierarchical, None),
    "birch": (birch, None),
    "spectral": (spectral, None),
    "mean_shift": (mean_shift, None),
    "gmm_forms": (gmm_forms, None),
    "compare_algorithms": (compare_algorithms, None),
    "suggest_features": (suggest_features, None),
    "tsne": (tsne, None),
    "name_clusters": (name_clusters, None),
    "optimizer_grid": (optimizer_grid, _OPT),
    "segment_actions": (segment_actions, _SEG),
}
