"""Profiles, roles, diagnostics and the quality score."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import eda, quality, roles
from .inputs import LI_NULL_SQL, li_null, rounded, table

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def describe_numeric(spark, d):
    out = eda.describe_numeric(li_null(spark, d), NUM)
    return rounded(out.drop("distribucion"), cv_pct="cv_%", ceros_pct="ceros_%")


def _each(columns: list[str], select: str, source: str) -> str:
    return "\nunion all\n".join(select.replace("@", c).replace("$", source) for c in columns)


_DESCRIBE = """select '@' as variable, count(x) as n, count(*) - count(x) as nulos, round(avg(x), 4) as media, round(median(x), 4) as mediana,
 round((select x from (select @ as x, count(*) as c from $ where @ is not null group by @) order by c desc, x limit 1), 4) as moda,
 round(stddev_samp(x), 4) as desv_std, round(100 * stddev_samp(x) / nullif(abs(avg(x)), 0), 4) as cv_pct, round(min(x), 4) as min,
 round(quantile_cont(x, 0.05), 4) as p5, round(quantile_cont(x, 0.25), 4) as p25, round(quantile_cont(x, 0.75), 4) as p75, round(quantile_cont(x, 0.95), 4) as p95,
 round(max(x), 4) as max, round(max(x) - min(x), 4) as rango, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 4) as iqr,
 round(skewness(x), 4) as asimetria, round(kurtosis(x), 4) as curtosis, round(100.0 * count(*) filter (where x = 0) / count(x), 2) as ceros_pct
from (select @ as x from $)"""


def column_profile_numeric(spark, d):
    out = quality.column_profile_numeric(li_null(spark, d), NUM)
    return rounded(out.drop("curtosis"), pct_nulos="%_nulos", completitud_pct="completitud_%", pct_unicos="%_unicos", cv_pct="cv_%", pct_outliers="%_outliers")


_PROFILE = """select '@' as variable, count(*) - count(x) as nulos, round(100.0 * (count(*) - count(x)) / count(*), 2) as pct_nulos,
 round(100.0 * count(x) / count(*), 2) as completitud_pct, count(distinct x) as unicos, round(100.0 * count(distinct x) / count(*), 2) as pct_unicos,
 greatest(count(x) - count(distinct x), 0) as valores_repetidos, count(distinct x) <= 1 as constante, round(min(x), 4) as min, round(any_value(q1), 4) as p25,
 round(median(x), 4) as mediana, round(avg(x), 4) as media, round(any_value(q3), 4) as p75, round(max(x), 4) as max, round(stddev_pop(x), 4) as desv_std,
 round(100 * stddev_pop(x) / nullif(abs(avg(x)), 0), 4) as cv_pct, round(skewness(x), 4) as asimetria,
 count(*) filter (where x = 0) as ceros, count(*) filter (where x < 0) as negativos,
 count(*) filter (where x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1)) as outliers_iqr,
 round(100.0 * count(*) filter (where x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1)) / count(*), 2) as pct_outliers,
 count(*) filter (where abs((x - m) / s) > 3) as outliers_z3
from (select @ as x, (select quantile_cont(@, 0.25) from $) as q1, (select quantile_cont(@, 0.75) from $) as q3, (select avg(@) from $) as m, (select stddev_pop(@) from $) as s from $)"""


def column_profile_text(spark, d):
    out = quality.column_profile_text(_ev_text(spark, d), ["event_type", "monto"])
    return rounded(out, pct_nulos="%_nulos", pct_vacios="%_vacios", completitud_pct="completitud_%", pct_unicos="%_unicos", pct_moda="%_moda")


def _ev_text(spark, d):
    e = table(spark, d, "events")
    return e.select(F.when(F.col("event_id") % 11 == 0, " n/a ").when(F.col("event_id") % 13 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("event_type"), F.concat(F.lit("$ "), F.col("user_id").cast("string")).alias("monto"))


_EV_TEXT = "(select case when event_id % 11 = 0 then ' n/a ' when event_id % 13 = 0 then upper(event_type) else event_type end as event_type, '$ ' || user_id as monto from events)"
_TEXT = """select '@' as variable, count(*) - count(x) as nulos, round(100.0 * (count(*) - count(x)) / count(*), 2) as pct_nulos,
 count(*) filter (where lower(trim(x)) in ('', '-', '--', 'n/a', 'na', 'null', 'none', 'nan', 'sin dato', 'desconocido', '?', '.')) as vacios_texto,
 round(100.0 * count(*) filter (where lower(trim(x)) in ('', '-', '--', 'n/a', 'na', 'null', 'none', 'nan', 'sin dato', 'desconocido', '?', '.')) / count(*), 2) as pct_vacios,
 round(100.0 * (count(x) - count(*) filter (where lower(trim(x)) in ('', '-', '--', 'n/a', 'na', 'null', 'none', 'nan', 'sin dato', 'desconocido', '?', '.'))) / count(*), 2) as completitud_pct,
 count(distinct x) as unicos, round(100.0 * count(distinct x) / count(*), 2) as pct_unicos, greatest(count(x) - count(distinct x), 0) as valores_repetidos,
 count(distinct x) <= 1 as constante, (select v from (select @ as v, count(*) as c from $ where @ is not null group by @) order by c desc, v limit 1) as moda,
 (select c from (select @ as v, count(*) as c from $ where @ is not null group by @) order by c desc, v limit 1) as frec_moda,
 round(100.0 * (select c from (select @ as v, count(*) as c from $ where @ is not null group by @) order by c desc, v limit 1) / count(*), 2) as pct_moda,
 min(length(x)) as long_min, max(length(x)) as long_max, count(*) filter (where x <> trim(x)) as espacios_sobrantes,
 count(distinct x) - count(distinct lower(trim(x))) as may_min_inconsistente
from (select @ as x from $)"""


def column_roles(spark, d):
    out = None
    for name in ("customer", "orders", "part", "documents"):
        one = roles.roles_table(table(spark, d, name).select(*[c for c in ROLE_COLUMNS[name]])).select(F.lit(name).alias("tabla"), "variable", "rol", "unicos")
        out = one if out is None else out.unionByName(one)
    return out


ROLE_COLUMNS = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "orders": ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
                "part": ["p_partkey", "p_brand", "p_size", "p_retailprice"], "documents": ["doc_id", "lang", "source", "n_chars"]}
_KIND = {"c_custkey": "i", "c_name": "s", "c_nationkey": "i", "c_acctbal": "f", "c_mktsegment": "s", "o_orderkey": "i", "o_orderstatus": "s", "o_totalprice": "f", "o_orderdate": "d", "o_orderpriority": "s",
         "p_partkey": "i", "p_brand": "s", "p_size": "i", "p_retailprice": "f", "doc_id": "i", "lang": "s", "source": "s", "n_chars": "i"}


def _role_sql() -> str:
    rows = []
    for t, columns in ROLE_COLUMNS.items():
        for c in columns:
            rule = {"d": "'fecha'", "i": "case when k <= 15 then 'categorica' else 'numerica' end", "f": "'numerica'",
                    "s": "case when k * 1.0 / n > 0.92 and k > 40 then 'id' when k <= 50 then 'categorica' else 'texto' end"}[_KIND[c]]
            rows.append(f"select '{t}' as tabla, '{c}' as variable, case when k <= 1 then 'constante' else {rule} end as rol, k as unicos from (select count(distinct {c}) as k, count(*) as n from {t})")
    return "\nunion all\n".join(rows)


def dataset_diagnostics(spark, d):
    docs = table(spark, d, "documents").drop("doc_id")
    x = quality.dataset_diagnostics(docs, None)
    row = [(x["filas"], x["columnas"], x["celdas"], x["celdas_nulas"], x["celdas_vacias"], x["filas_duplicadas"], x["filas_vacias"])]
    return spark.createDataFrame(row, "filas long, columnas int, celdas long, celdas_nulas long, celdas_vacias long, filas_duplicadas long, filas_vacias long")


_BLANKS = "('', '-', '--', 'n/a', 'na', 'null', 'none', 'nan', 'sin dato', 'desconocido', '?', '.')"
_DIAG = f"""select count(*) as filas, 4 as columnas, count(*) * 4 as celdas,
 count(*) * 4 - count(text) - count(lang) - count(source) - count(n_chars) as celdas_nulas,
 count(*) filter (where lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) in {_BLANKS}) + count(*) filter (where lower(trim(lang)) in {_BLANKS}) + count(*) filter (where lower(trim(source)) in {_BLANKS}) as celdas_vacias,
 count(*) - (select count(*) from (select distinct text, lang, source, n_chars from documents)) as filas_duplicadas,
 count(*) filter (where text is null and lang is null and source is null and n_chars is null) as filas_vacias
from documents"""


def duplicate_rows(spark, d):
    docs = table(spark, d, "documents").select("text", "lang")
    return quality.duplicate_rows(docs)


def duplicate_key_rows(spark, d):
    return quality.duplicate_keys(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


def identical_columns(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", F.col("l_quantity").alias("copia"), F.reverse(F.col("l_quantity").cast("string")).alias("otra"), "l_tax")
    groups = quality.identical_columns(li)
    return spark.createDataFrame([("=".join(g),) for g in groups], "grupo string")


_IDENTICAL = """select 'l_quantity=copia' as grupo from (select count(*) filter (where l_quantity is distinct from l_quantity) as k from lineitem) where k = 0"""


def mixed_type_columns(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string")).otherwise(F.col("event_type")).alias("mezcla"), "event_type")
    return spark.createDataFrame([(c,) for c in quality.mixed_type_columns(e, ["event_id"])], "variable string")


_MIXED = """select variable from (
 select 'mezcla' as variable, avg((try_cast(replace(x, ',', '.') as double) is not null)::int) as s from (select case when event_id % 3 = 0 then value::varchar else event_type end as x from events where event_type is not null order by event_id limit 1000)
 union all select 'event_type', avg((try_cast(replace(event_type, ',', '.') as double) is not null)::int) from (select event_type from events order by event_id limit 1000)
) where s > 0.15 and s < 0.85"""


def quality_score(spark, d):
    li = li_null(spark, d).select(*NUM, "l_returnflag", "l_linestatus")
    s = quality.quality_score(li)
    row = [(*[round(s[k], 4) for k in ("score_total", "completitud", "unicidad", "consistencia", "validez")], s["nivel"])]
    return spark.createDataFrame(row, "score_total double, completitud double, unicidad double, consistencia double, validez double, nivel string")


def _score_sql() -> str:
    far = ", ".join(
        f"(select 100.0 * count(*) filter (where x < q1 - 3 * (q3 - q1) or x > q3 + 3 * (q3 - q1)) / count(x) from (select {c} as x, (select quantile_cont({c}, 0.25) from li) as q1, (select quantile_cont({c}, 0.75) from li) as q3 from li))" for c in NUM
    )
    nulls = " + ".join(f"(count(*) - count({c}))" for c in [*NUM, "l_returnflag", "l_linestatus"])
    return f"""with li as (select {', '.join(NUM)}, l_returnflag, l_linestatus from {LI_NULL_SQL}),
p as (
 select 100 - 100.0 * ({nulls}) / (count(*) * 6) as completitud,
  100 - 100.0 * (count(*) - (select count(*) from (select distinct * from li))) / count(*) as unicidad, 100.0 as consistencia,
  greatest(0, 100 - 3 * list_avg([{far}])) as validez
 from li
), t as (select *, 0.35 * completitud + 0.25 * unicidad + 0.20 * consistencia + 0.20 * validez as total from p)
select round(total, 4) as score_total, round(completitud, 4)::double as completitud, round(unicidad, 4)::double as unicidad, round(consistencia, 4)::double as consistencia, round(validez, 4)::double as validez,
 case when total >= 90 then 'Excelente' when total >= 75 then 'Buena' when total >= 60 then 'Aceptable' when total >= 40 then 'Deficiente' else 'Crítica' end as nivel from t"""


def missing_correlation(spark, d):
    return rounded(quality.missing_correlation(li_null(spark, d)))


def _missing_sql() -> str:
    c = ["l_quantity", "l_discount"]
    return "\nunion all\n".join(
        f"select '{a}' as variable_1, '{b}' as variable_2, round(corr(({a} is null)::int, ({b} is null)::int), 4) as correlacion from {LI_NULL_SQL}" for a in c for b in c
    )


def missing_matrix(spark, d):
    from .inputs import ev_null

    return quality.missing_matrix(ev_null(spark, d).select("event_id", "event_type", "value"), ["event_id"])


_MATRIX = f"""select pos as posicion, (event_id is null)::int as event_id, (event_type is null)::int as event_type, (value is null)::int as value
from (select *, row_number() over (order by event_id) - 1 as pos, count(*) over () as n from {"(select * replace (nullif(event_type, 'error') as event_type, case when event_id % 7 = 0 then null else value end as value) from events)"})
where pos % greatest(n // 500, 1) = 0"""


QUERIES = {
    "describe_numeric": (describe_numeric, _each(NUM, _DESCRIBE, LI_NULL_SQL)),
    "column_profile_numeric": (column_profile_numeric, _each(NUM, _PROFILE, LI_NULL_SQL)),
    "column_profile_text": (column_profile_text, _each(["event_type", "monto"], _TEXT, _EV_TEXT)),
    "column_roles": (column_roles, _role_sql()),
    "dataset_diagnostics": (dataset_diagnostics, _DIAG),
    "duplicate_rows": (duplicate_rows, "select count(*) as filas, count(*) - (select count(*) from (select distinct text, lang from documents)) as duplicados from documents"),
    "duplicate_key_rows": (duplicate_key_rows, "select * from (select l_orderkey, l_linenumber, l_partkey, count(*) over (partition by l_orderkey, l_linenumber) as copias from lineitem) where copias > 1"),
    "identical_columns": (identical_columns, _IDENTICAL),
    "mixed_type_columns": (mixed_type_columns, _MIXED),
    "quality_score": (quality_score, _score_sql()),
    "missing_correlation": (missing_correlation, _missing_sql()),
    "missing_matrix": (missing_matrix, _MATRIX),
}
