"""Files written and read back, and the tables behind charts, scenarios and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering as K
from ..operators import eda, explain, insights, learning, metrics, quality, recipe, views, zoo
from ..sources import demo, reader, sinks, workspace
from . import q_eda, q_ml, q_profile
from .inputs import LI_NULL_SQL, li_null, rounded, table

# --- sources and sinks ------------------------------------------------------------------------


def _orders(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_orderstatus", "o_totalprice", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_orderpriority"))


_ORDERS = "select o_orderkey{k} as o_orderkey, o_orderstatus, o_totalprice, nullif(o_orderpriority, '5-LOW') as o_orderpriority from orders"


def csv_round_trip(sep: str):
    def run(spark, d):
        path = workspace.fresh(spark, "orders") + ".csv"
        sinks.write_csv(_orders(spark, d), path, sep)
        return reader.read_any(spark, path)[0]

    return run


def json_round_trip(spark, d):
    path = workspace.fresh(spark, "orders") + ".jsonl"
    _orders(spark, d).write.json(path)
    return reader.read_any(spark, path)[0].select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def parquet_read(spark, d):
    return reader.read_any(spark, f"{d}/supplier.parquet")[0]


def decimal_comma(spark, d):
    """Numbers with a decimal comma and dots between thousands, semicolons between columns."""
    shown = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    path = workspace.fresh(spark, "prices") + ".csv"
    sinks.write_csv(table(spark, d, "orders").select("o_orderkey", shown.alias("precio")), path, ";")
    return reader.read_any(spark, path)[0]


def csv_line_breaks(spark, d):
    """Whole texts, with their quotes and line breaks, written and read back."""
    path = workspace.fresh(spark, "texts") + ".csv"
    sinks.write_csv(table(spark, d, "documents").select("doc_id", F.concat(F.lit('"'), "text", F.lit('\n"fin", ')).alias("texto")), path)
    back = reader.read_any(spark, path)[0]
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2("texto", 256).alias("texto_sha256"))


def csv_late_latin1(spark, d):
    """A row like the header, and letters outside ASCII only in the last rows of a Latin-1 file."""
    c = table(spark, d, "customer")
    most = c.agg(F.max("c_custkey")).first()[0]
    rows = c.select(F.col("c_custkey").cast("string").alias("clave"), F.concat("c_name", F.when(F.col("c_custkey") > most - 3, " Ñandú").otherwise("")).alias("nombre"))
    rows = rows.unionByName(spark.createDataFrame([("clave", "nombre")], "clave string, nombre string")).coalesce(1)
    path = workspace.fresh(spark, "names") + ".csv"
    sinks.write_csv(rows, path, encoding="ISO-8859-1")
    return reader.read_any(spark, path)[0]


_LATE = """select c_custkey::varchar as clave, c_name || case when c_custkey > (select max(c_custkey) from customer) - 3 then ' Ñandú' else '' end as nombre from customer
union all select 'clave', 'nombre'"""


def labelled_data(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    labels = o.select("o_orderkey", (F.col("o_orderkey") % 3).cast("int").alias("prediction"))
    names = spark.createDataFrame([(0, "uno"), (1, "dos")], "cluster int, nombre_sugerido string")
    return sinks.labelled_data(o, labels, "o_orderkey", names)


def predictions_table(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    scored = lambda k: o.select("o_orderkey", (F.col("o_orderkey") % k).cast("double").alias("prediction"))
    return sinks.predictions_table(o, ["o_orderkey"], "o_orderstatus", {"a": scored(2), "b": scored(3)}, ["F", "O", "P"])


# --- recipes and quality ----------------------------------------------------------------------


def _gaps(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.when(F.col("c_custkey") % 9 != 4, F.col("c_acctbal")).alias("saldo"), F.when(F.col("c_custkey") % 7 != 3, F.col("c_nationkey").cast("double")).alias("pais"))


def knn_whole(spark, d):
    return rounded(recipe.knn_impute(_gaps(spark, d), ["saldo", "pais"], 5))


_KNN = """with t as (select c_custkey as id, case when c_custkey % 9 <> 4 then c_acctbal end as x, case when c_custkey % 7 <> 3 then c_nationkey::double end as y from customer),
fx as (select id, avg(v) as v from (select q.id, r.x as v, row_number() over (partition by q.id order by 2 * (q.y - r.y) * (q.y - r.y), r.x) as p from t q join t r on q.x is null and q.y is not null and r.x is not null and r.y is not null) where p <= 5 group by id),
fy as (select id, avg(v) as v from (select q.id, r.y as v, row_number() over (partition by q.id order by 2 * (q.x - r.x) * (q.x - r.x), r.y) as p from t q join t r on q.y is null and q.x is not null and r.y is not null and r.x is not null) where p <= 5 group by id)
select t.id as c_custkey, round(coalesce(x, fx.v, (select avg(x) from t)), 4) as saldo, round(coalesce(y, fy.v, (select avg(y) from t)), 4) as pais from t left join fx using (id) left join fy using (id)"""


def knn_model(spark, d):
    """Nearest 15 customers by balance, trained on two thirds of them, vote for the segment of the rest."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", K.array_to_vector(F.array("c_acctbal")).alias("features"))
    labelled, _ = learning.encode_labels(c, "c_mktsegment", "multiclase")
    model = zoo.Neighbours(15).fit(labelled.filter("c_custkey % 3 <> 0"))
    return model.transform(labelled.filter("c_custkey % 3 = 0")).select("c_custkey", "prediction")


_KNN_MODEL = """with t as (select c_custkey, c_acctbal as x, (dense_rank() over (order by c_mktsegment) - 1)::double as y from customer),
near as (select q.c_custkey, r.y, row_number() over (partition by q.c_custkey order by (q.x - r.x) * (q.x - r.x), r.y) as p from t q join t r on q.c_custkey % 3 = 0 and r.c_custkey % 3 <> 0),
votes as (select c_custkey, y, count(*) as n from near where p <= 15 group by 1, 2)
select c_custkey, y as prediction from (select *, row_number() over (partition by c_custkey order by n desc, y) as p from votes) where p = 1"""


def etl_rename_drop(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_name")
    return recipe.drop_columns(recipe.rename(c, {"c_custkey": "clave", "c_acctbal": "saldo"}), ["c_name", "ausente"])


def normalize_names(spark, d):
    c = table(spark, d, "nation").select(F.col("n_nationkey").alias("Nación Clave"), F.col("n_name").alias(" Nombre (País) "))
    return recipe.normalize_column_names(c)


def _alerts(spark, d):
    profile = quality.column_profile_numeric(li_null(spark, d), q_profile.NUM)
    return spark.createDataFrame([(r["variable"], quality.row_alert(r.asDict())) for r in profile.collect()], "variable string, alerta string")  # a row a column


_STATS = "\nunion all\n".join(
    f"""select '{c}' as variable, 100.0 * (count(*) - count({c})) / count(*) as nulos, 100.0 * count(*) filter (where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) / count(*) as fuera,
 abs(skewness({c})) as sesgo, count(distinct {c}) <= 1 as fijo from {LI_NULL_SQL}, (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {LI_NULL_SQL})""" for c in q_profile.NUM
)
_FLAGS = f"select variable, unnest([case when fijo then 'CONSTANTE' end, case when nulos >= 50 then 'NULOS ALTOS' when nulos > 5 then 'NULOS' end, case when fuera > 5 then 'OUTLIERS' end, case when sesgo > 2 then 'ASIMETRIA' end]) as alerta from ({_STATS})"


def alert_frequency(spark, d):
    return views.alert_frequency(_alerts(spark, d))


def row_alerts(spark, d):
    return _alerts(spark, d)


def missing_bars(spark, d):
    e = table(spark, d, "events")
    e = e.select(F.when(F.col("event_id") % 11 == 0, "n/a").when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("tipo"), F.when(F.col("event_id") % 5 != 0, F.col("user_id").cast("string")).alias("usuario"), F.lit("x").alias("lleno"))
    return rounded(views.missing_bars(quality.column_profile_text(e, ["tipo", "usuario", "lleno"])), nulos="%_nulos", vacios="%_vacios")


_BARS = """select variable, nulos, vacios, round(nulos + vacios, 4) as total from (
 select 'tipo' as variable, round(100.0 * count(*) filter (where event_id % 11 <> 0 and event_id % 7 = 0) / count(*), 2)::double as nulos, round(100.0 * count(*) filter (where event_id % 11 = 0) / count(*), 2)::double as vacios from events
 union all select 'usuario', round(100.0 * count(*) filter (where event_id % 5 = 0) / count(*), 2)::double, 0.0::double from events) where nulos + vacios > 0"""


# --- charts -----------------------------------------------------------------------------------


def metric_radar(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("modelo")).agg(F.avg("o_totalprice").alias("m1"), F.max("o_totalprice").alias("m2"), F.min("o_totalprice").alias("m3"), F.lit(2.0).alias("m4"))
    board = o.select("*", F.lit("ok").alias("estado"), F.col("modelo").alias("ranking"))
    return rounded(views.metric_radar(board, ["m1", "m2", "m3", "m4", "ausente"], top=4))


_RADAR = """with b as (select o_orderpriority as modelo, avg(o_totalprice) as m1, max(o_totalprice) as m2, min(o_totalprice) as m3, 2.0::double as m4 from orders group by 1 order by 1 limit 4),
u as (unpivot b on m1, m2, m3, m4 into name metrica value valor)
select modelo, metrica, round(valor, 4) as valor, round(case when max(valor) over w > min(valor) over w then (valor - min(valor) over w) / (max(valor) over w - min(valor) over w) else 1 end, 4) as relativo from u window w as (partition by metrica)"""


def colour_scale(spark, d):
    li = table(spark, d, "lineitem")
    scale = views.colour_scale(li, ["l_extendedprice", "l_quantity"])
    return rounded(li.select("l_orderkey", "l_linenumber", scale["l_extendedprice"].alias("precio"), scale["l_quantity"].alias("cantidad")))


_COLOUR = """select l_orderkey, l_linenumber, round(least(greatest((l_extendedprice - p0) / (p1 - p0), 0), 1), 4)::double as precio, round(least(greatest((l_quantity - q0) / (q1 - q0), 0), 1), 4)::double as cantidad
from lineitem, (select quantile_cont(l_extendedprice, 0.02) as p0, quantile_cont(l_extendedprice, 0.98) as p1, quantile_cont(l_quantity, 0.02) as q0, quantile_cont(l_quantity, 0.98) as q1 from lineitem)"""


def _labelled_vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("prediction"), K.as_vector("embedding").alias("features"))


def silhouette_points(spark, d):
    return rounded(views.silhouette_by_point(_labelled_vectors(spark, d), "vec_id"))


_SILHOUETTE = """with e as (select vec_id, label, embedding::double[] as v from embeddings), p as (select a.vec_id, a.label, b.label as other, sum(list_distance(a.v, b.v)) as s, count(*) as n from e a cross join e b group by all),
m as (select vec_id, label, max(case when other = label then s / nullif(n - 1, 0) end) as a, min(case when other <> label then s / n end) as b, max(case when other = label then n end) as own from p group by 1, 2)
select vec_id, label as cluster, round(case when own > 1 then (b - a) / greatest(a, b) else 0 end, 4) as silueta from m"""


def silhouette_bars(spark, d):
    points = table(spark, d, "orders").select(F.col("o_orderstatus").alias("cluster"), F.col("o_totalprice").alias("silueta"))
    return rounded(views.silhouette_bars(points))


_SILBARS = """select o_orderstatus as cluster, (row_number() over (partition by o_orderstatus order by o_totalprice) - 1 + coalesce((select sum(n + 12) from (select o_orderstatus as s, count(*) as n from orders group by 1) where s < o_orderstatus), 0))::bigint as posicion,
 round(o_totalprice, 4) as silueta, round((select avg(o_totalprice) from orders), 4) as media from orders"""


def best_rows(spark, d):
    n = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("media"), F.count("*").alias("n"))
    return views.best_rows(n, "c_nationkey", {"media": "min", "n": "max"})


_BEST = """with t as (select c_nationkey, avg(c_acctbal) as media, count(*) as n from customer group by 1)
select 'media' as criterio, (select c_nationkey from t order by media, c_nationkey limit 1) as c_nationkey union all select 'n', (select c_nationkey from t order by n desc, c_nationkey limit 1)"""


def dendrogram_jump(spark, d):
    """Single linkage of customers' balances by nation: merge heights are the gaps between neighbours, so SQL finds the jump too."""
    means = table(spark, d, "customer").groupBy("c_nationkey").agg(K.array_to_vector(F.array(F.avg("c_acctbal"))).alias("features"))
    return rounded(views.jump_k(views.dendrogram(means.select("features"), "single")))


_JUMP = """with g as (select x - lag(x) over (order by x) as h from (select avg(c_acctbal) as x from customer group by c_nationkey)), r as (select h, row_number() over (order by h) as i, count(*) over () as n, lead(h) over (order by h) as up from g where h is not null)
select (n + 1 - i)::int as k, round(h, 4) as altura_antes, round(up, 4) as altura_despues, round(up - h, 4) as salto from r where up is not null order by up - h desc, i limit 1"""


# --- learning and scenarios -------------------------------------------------------------------


def task_kinds(spark, d):
    o = table(spark, d, "orders").withColumn("dos", F.col("o_orderkey") % 2).withColumn("siete", F.col("o_orderkey") % 7)
    return spark.createDataFrame([(c, learning.detect_task(o, c)) for c in ("o_orderstatus", "o_totalprice", "dos", "siete", "o_custkey")], "variable string, tarea string")


_TASKS = """select 'o_orderstatus' as variable, case when count(distinct o_orderstatus) <= 2 then 'binaria' else 'multiclase' end as tarea from orders
""" + "".join(
    f"""union all select '{name}', case when count(distinct x) = 2 then 'binaria' when count(distinct x) > 2 and count(distinct x) <= 20 and count(distinct x) * 1.0 / count(x) < 0.05 and count(*) filter (where x % 1 <> 0) = 0 then 'multiclase' else 'regresion' end from (select {x} as x from orders)
""" for name, x in {"o_totalprice": "o_totalprice", "dos": "o_orderkey % 2", "siete": "o_orderkey % 7", "o_custkey": "o_custkey"}.items()
)


def label_encode(spark, d):
    return learning.encode_labels(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "multiclase")[0]


def split_sizes(spark, d):
    parted = learning.split(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"])
    return parted.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if("is_test").alias("prueba"))


def fold_sizes(spark, d):
    parts = learning.folds(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"], 5)
    return parts.groupBy("o_orderstatus", "fold").agg(F.count("*").alias("n"))


_FOLDS = "select o_orderstatus, fold::int as fold, ((n - fold + 4) // 5)::bigint as n from (select o_orderstatus, count(*) as n from orders group by 1), range(5) r(fold) where (n - fold + 4) // 5 > 0"


def ordinal_wide(spark, d):
    """Ordinal codes of a column with a value a row."""
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    ready = learning.fit_preprocessor(c, ["c_name"], scaler="ninguno", encoder="ordinal")
    return ready.transform(c).select("c_custkey", F.element_at(K.vector_to_array("features"), 1).alias("f0"))


def best_threshold(spark, d):
    return rounded(metrics.best_threshold(metrics.threshold_analysis(q_ml._scored(spark, d))).select("f1"))


def importance_shares(spark, d):
    values = table(spark, d, "customer").select(F.col("c_mktsegment").alias("variable"), F.col("c_acctbal").alias("importancia"))
    out = explain.aggregate_importance(values)
    return rounded(explain.top_features(out, 3), pct="importancia_%", acumulado="acumulado_%")


_SHARES = """with v as (select c_mktsegment as variable, sum(abs(c_acctbal)) as i from customer group by 1)
select variable, round(i, 4) as importancia, round(100 * i / sum(i) over (), 4) as pct, round(100 * sum(i) over (order by i desc, variable) / sum(i) over (), 4) as acumulado from v order by i desc, variable limit 3"""


def features_for_share(spark, d):
    values = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("variable"), F.col("c_acctbal").alias("importancia"))
    return spark.createDataFrame([(explain.features_for_share(explain.aggregate_importance(values)),)], "n long")


_FOR_SHARE = """with v as (select c_nationkey as variable, sum(abs(c_acctbal)) as i from customer group by 1)
select count(*) as n from (select 100 * (sum(i) over (order by i desc, variable) - i) / sum(i) over () as before from v) where before < 80"""


def base_scenario(spark, d):
    got = insights.base_scenario(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_returnflag"])
    a, b, c = got.values()
    return spark.createDataFrame([(round(a, 4), round(b, 4), str(c))], "cantidad double, precio double, moda string")


def lever_values(spark, d):
    return rounded(spark.createDataFrame([(k, v) for k, v in enumerate(insights.lever_values(table(spark, d, "lineitem"), "l_extendedprice"))], "paso int, valor double"))


_LEVERS = """select k::int as paso, round(a + (b - a) * k / 4, 4) as valor from range(5) r(k), (select quantile_cont(l_extendedprice, 0.05) as a, quantile_cont(l_extendedprice, 0.95) as b from lineitem)"""


def association_matrix(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority")
    return rounded(eda.categorical_association(o, ["o_orderstatus", "o_orderpriority"]))


# --- words ------------------------------------------------------------------------------------


def _faulty(spark, d):
    """Customers with copies, a column twice, a constant and a column that is mostly missing."""
    c = table(spark, d, "customer")
    c = c.unionByName(c.filter("c_custkey % 10 = 0"))
    return c.select("c_custkey", F.col("c_custkey").alias("copia"), "c_mktsegment", F.lit("x").alias("fijo"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("escaso"))


def findings(spark, d):
    rows = quality.quality_findings(_faulty(spark, d))
    return spark.createDataFrame([(r["severidad"], r["hallazgo"], r["detalle"]) for r in rows], "severidad string, hallazgo string, detalle string")  # a row a finding


_FINDINGS = """with k as (select count(*) filter (where c_custkey % 10 = 0) as copies, count(*) as n from customer)
select 'Crítica' as severidad, 'Columnas con 50 % de nulos o más' as hallazgo, 'escaso' as detalle
union all select case when 100.0 * copies / (n + copies) > 5 then 'Alta' else 'Media' end, 'Filas duplicadas', copies || ' copias' from k
union all select 'Alta', 'Columnas idénticas', 'c_custkey = copia' union all select 'Media', 'Columnas constantes', 'fijo'"""


def narrative(spark, d):
    """Statements about the table, what to do about it, and a summary, line by line."""
    df = _faulty(spark, d)
    diagnostics = quality.dataset_diagnostics(df)
    score = quality.quality_score(df, diagnostics)
    report = insights.descriptive_report(df, "c_mktsegment")
    actions = insights.prescriptive_actions(score=score["score_total"], rows=diagnostics["filas"], weak_features=3)
    lines = [("informe", x) for x in report] + [("accion", f"{a['prioridad']}: {a['accion']}") for a in actions] + [("resumen", insights.executive_summary(report, actions))]
    return spark.createDataFrame([(k, *x) for k, x in enumerate(lines)], "linea int, parte string, texto string")


def sensitivity(spark, d):
    """A line's predictions as the size of a part moves and the rest stays at its middle."""
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    out = learning.train_models(p, "p_retailprice", ["p_size", "p_partkey"], ["p_partkey"], models=["Regresión Lineal"])
    base = insights.base_scenario(p, out.features)
    return rounded(insights.sensitivity(p, base, "p_size", out.preprocessor, out.results[0].model))


QUERIES = {
    "read_csv_comma": (csv_round_trip(","), _ORDERS.format(k="::double")),
    "read_csv_tab": (csv_round_trip("\t"), _ORDERS.format(k="::double")),
    "read_csv_bar": (csv_round_trip("|"), _ORDERS.format(k="::double")),
    "read_json_lines": (json_round_trip, _ORDERS.format(k="")),
    "demo_churn": (lambda spark, d: demo.churn_customers(spark, numbers=table(spark, d, "customer").select("c_custkey")), None),
    "demo_homes": (lambda spark, d: demo.property_sales(spark, numbers=table(spark, d, "part").select("p_partkey")), None),
    "read_parquet": (parquet_read, "select * from supplier"),
    "read_decimal_comma": (decimal_comma, "select o_orderkey::double as o_orderkey, round(o_totalprice, 2) as precio from orders"),
    "labelled_data": (labelled_data, "select o_orderkey, o_orderstatus, (o_orderkey % 3)::int as cluster, case o_orderkey % 3 when 0 then 'uno' when 1 then 'dos' end as segmento from orders"),
    "predictions_table": (predictions_table, "select o_orderkey, o_orderstatus as real, ['F', 'O', 'P'][(o_orderkey % 2 + 1)::int] as pred_a, ['F', 'O', 'P'][(o_orderkey % 3 + 1)::int] as pred_b from orders"),
    "etl_rename_drop": (etl_rename_drop, "select c_custkey as clave, c_mktsegment, c_acctbal as saldo from customer"),
    "etl_normalize_names": (normalize_names, "select n_nationkey as nacion_clave, n_name as nombre_pais from nation"),
    "quality_findings": (findings, _FINDINGS),
    "narrative": (narrative, None),
    "sensitivity": (sensitivity, None),
    "csv_line_breaks": (csv_line_breaks, """select doc_id, sha256('"' || text || chr(10) || '"fin", ') as texto_sha256 from documents"""),
    "csv_late_latin1": (csv_late_latin1, _LATE),
    "etl_impute_knn_whole": (knn_whole, _KNN),
    "knn_model": (knn_model, _KNN_MODEL),
    "row_alerts": (row_alerts, f"select variable, coalesce(string_agg(alerta, ' | '), 'OK') as alerta from ({_FLAGS}) group by 1"),
    "alert_frequency": (alert_frequency, f"select alerta, count(*) as n from ({_FLAGS}) where alerta is not null group by 1"),
    "missing_bars": (missing_bars, _BARS),
    "metric_radar": (metric_radar, _RADAR),
    "colour_scale": (colour_scale, _COLOUR),
    "silhouette_points": (silhouette_points, _SILHOUETTE),
    "silhouette_bars": (silhouette_bars, _SILBARS),
    "best_rows": (best_rows, _BEST),
    "dendrogram_jump": (dendrogram_jump, _JUMP),
    "task_kinds": (task_kinds, _TASKS),
    "label_encode": (label_encode, "select o_orderkey, o_orderpriority, (dense_rank() over (order by o_orderpriority) - 1)::double as label from orders"),
    "split_sizes": (split_sizes, "select o_orderstatus, count(*) as n, ceil(count(*) * 0.2)::bigint as prueba from orders group by 1"),
    "fold_sizes": (fold_sizes, _FOLDS),
    "ordinal_wide": (ordinal_wide, "select c_custkey, (dense_rank() over (order by c_name) - 1)::double as f0 from customer"),
    "best_threshold": (best_threshold, f"select max(f1) as f1 from ({q_ml._THRESHOLD})"),
    "importance_shares": (importance_shares, _SHARES),
    "features_for_share": (features_for_share, _FOR_SHARE),
    "base_scenario": (base_scenario, "select round(median(l_quantity), 4) as cantidad, round(median(l_extendedprice), 4) as precio, (select l_returnflag from lineitem group by 1 order by count(*) desc, 1 limit 1) as moda from lineitem"),
    "lever_values": (lever_values, _LEVERS),
    "association_matrix": (association_matrix, q_eda._v_sql("o_orderstatus", "o_orderpriority", "orders")),
}
