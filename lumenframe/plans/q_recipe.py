"""The recipe operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recipe as R
from .inputs import EV_NULL_SQL, LI_NULL_SQL, LINE, ev_null, li_null, rounded, table

_KEY = ", ".join(LINE)


def _docs_dup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return docs.unionByName(docs.filter("doc_id % 10 = 0").withColumn("doc_id", F.col("doc_id") + 10_000_000))


_DUP = "(select doc_id, text, lang, source from documents union all select doc_id + 10000000, text, lang, source from documents where doc_id % 10 = 0)"


def _dedup(keep):
    return lambda spark, d: R.drop_duplicates(_docs_dup(spark, d), ["text", "lang"], keep, ["doc_id"]).select("doc_id", "lang")


def _dedup_sql(keep):
    if keep is False:
        return f"select doc_id, lang from (select *, count(*) over (partition by text, lang) as k from {_DUP}) where k = 1"
    return f"select doc_id, lang from (select *, row_number() over (partition by text, lang order by doc_id {'desc' if keep == 'last' else ''}) as k from {_DUP}) where k = 1"


def _impute(**params):
    return lambda spark, d: rounded(R.impute(ev_null(spark, d).select("event_id", "event_type", "value"), columns=["event_type", "value"], order=["event_id"], **params))


def _num(fill: str, mode: str = "mode") -> str:
    m = f"(select event_type from (select event_type, count(*) as c from {EV_NULL_SQL} where event_type is not null group by 1) order by c desc, event_type limit 1)"
    return f"select event_id, coalesce(event_type, {m}) as event_type, round(coalesce(value, {fill}), 4) as value from {EV_NULL_SQL}"


_FFILL = f"""select event_id,
 coalesce(last_value(event_type ignore nulls) over b, first_value(event_type ignore nulls) over a) as event_type,
 round(coalesce(last_value(value ignore nulls) over b, first_value(value ignore nulls) over a), 4) as value
from {EV_NULL_SQL}
window b as (order by event_id rows between unbounded preceding and current row), a as (order by event_id rows between current row and unbounded following)"""

_LERP = f"""with p as (select *, row_number() over (order by event_id) as pos from {EV_NULL_SQL}), q as (
 select event_id, event_type, value, pos,
  last_value(case when value is not null then pos end ignore nulls) over b as p0, last_value(value ignore nulls) over b as v0,
  first_value(case when value is not null then pos end ignore nulls) over a as p1, first_value(value ignore nulls) over a as v1
 from p window b as (order by pos rows between unbounded preceding and current row), a as (order by pos rows between current row and unbounded following))
select event_id, coalesce(event_type, (select event_type from (select event_type, count(*) as c from {EV_NULL_SQL} where event_type is not null group by 1) order by c desc, event_type limit 1)) as event_type,
 round(coalesce(value, v0 + (v1 - v0) * (pos - p0) / nullif(p1 - p0, 0), v0, v1), 4) as value from q"""

_BOUNDS = {
    "iqr": ("quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))", "quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"),
    "zscore": ("avg({c}) - 1.5 * stddev_pop({c})", "avg({c}) + 1.5 * stddev_pop({c})"),
    "percentil": ("quantile_cont({c}, 0.01)", "quantile_cont({c}, 0.99)"),
}


def _outliers(method, action):
    def run(spark, d):
        li = li_null(spark, d).select(*LINE[:4], "l_quantity", "l_extendedprice")
        return rounded(R.outliers(li, ["l_quantity", "l_extendedprice"], method, action))

    return run


def _outliers_sql(method, action):
    lo, hi = _BOUNDS[method]
    b = ", ".join(f"{lo.format(c=c)} as {c}_lo, {hi.format(c=c)} as {c}_hi" for c in ("l_quantity", "l_extendedprice"))
    cols = ("l_quantity", "l_extendedprice")
    if action == "eliminar":
        where = " and ".join(f"coalesce(not ({c} < {c}_lo or {c} > {c}_hi), true)" for c in cols)
        pick = ", ".join(f"round({c}, 4) as {c}" for c in cols)
    else:
        where = "true"
        pick = ", ".join(
            f"round(case when {c} < {c}_lo then {'null' if action == 'nulo' else f'{c}_lo'} when {c} > {c}_hi then {'null' if action == 'nulo' else f'{c}_hi'} else {c} end, 4) as {c}" for c in cols
        )
    return f"select {', '.join(LINE[:4])}, {pick} from {LI_NULL_SQL}, (select {b} from {LI_NULL_SQL}) where {where}"


def etl_drop_empty(spark, d):
    li = li_null(spark, d).select(F.nullif("l_linenumber", F.lit(3)).alias("a"), "l_discount", F.when(F.col("l_discount").isNotNull(), F.col("l_quantity")).alias("l_quantity"))
    return R.drop_empty_rows(li, thresh_pct=40)


def etl_drop_na(spark, d):
    return R.drop_null_rows(li_null(spark, d).select(*LINE[:4], "l_quantity", "l_discount"), ["l_quantity", "l_discount"])


def etl_convert_types(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("$ "), F.format_string("%.2f", F.col("o_totalprice"))).alias("precio"),
        F.when(F.col("o_orderstatus") == "F", "Sí").when(F.col("o_orderstatus") == "O", " no ").otherwise("?").alias("si_no"),
        F.concat(F.col("o_custkey").cast("string"), F.lit(",5")).alias("entero"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("fecha"),
        F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit("%")).alias("parte"),
    )
    out = R.convert_types(o, {"precio": "numerica", "si_no": "booleana", "entero": "numerica", "fecha": "fecha", "parte": "numerica"})
    return rounded(out.withColumn("fecha", F.date_format("fecha", "yyyy-MM-dd")))


_CONVERT = """select o_orderkey, round(round(o_totalprice, 2), 4) as precio, case o_orderstatus when 'F' then true when 'O' then false end as si_no, round(o_custkey + 0.5, 4)::double as entero,
 strftime(o_orderdate, '%Y-%m-%d') as fecha, round((o_orderkey % 100) / 100.0, 4)::double as parte from orders"""


def etl_clean_text(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit(" \t"), F.replace("p_type", F.lit(" "), F.lit("   ")), F.lit("  ")).alias("p_type"))
    return R.clean_text(p, ["p_type"], case="lower")


def etl_blanks_to_null(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, " N/A ").otherwise(F.col("event_type")).alias("event_type"))
    return R.blanks_to_null(e)


def etl_filter_expr(spark, d):
    return R.filter_rows(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"),
                         "o_totalprice > 1000 and o_orderstatus in ['F', 'O'] and not o_orderpriority == '1-URGENT' and 10 <= o_orderkey < 9000")


def etl_new_column(spark, d):
    # a little is added before rounding, here and in the SQL, as exact ties are rounded differently by the two engines
    return rounded(R.new_column(table(spark, d, "lineitem").select(*LINE[:4], "l_extendedprice", "l_discount", "l_tax"), "neto", "l_extendedprice * (1 - l_discount) / (l_tax * 100) + 0.0000001"))


def etl_date_features(spark, d):
    out = R.date_features(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate"], list(R.DATE_PARTS), drop_original=True)
    return out.toDF("o_orderkey", *[c.replace("o_orderdate_", "") for c in out.columns[1:]])


_DATES = """select o_orderkey, year(o_orderdate) as anio, month(o_orderdate) as mes, day(o_orderdate) as dia, isodow(o_orderdate) - 1 as dia_semana, weekofyear(o_orderdate) as semana,
 quarter(o_orderdate) as trimestre, hour(o_orderdate) as hora, (isodow(o_orderdate) >= 6)::bigint as es_fin_semana from orders"""


def etl_group_rare(spark, d):
    return R.group_rare(table(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"], 10.0)


_RARE = """select doc_id, case when s * 100.0 / n >= 10 then source else 'OTROS' end as source, case when l * 100.0 / n >= 10 then lang else 'OTROS' end as lang
from (select doc_id, source, lang, count(*) over (partition by source) as s, count(*) over (partition by lang) as l, count(*) over () as n from documents)"""


def _transform(method):
    return lambda spark, d: rounded(R.transform_numeric(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], method))


_SCALE = {
    "log1p": "ln(1 + c_acctbal - least(0, (select min(c_acctbal) from customer)))", "sqrt": "sqrt(c_acctbal - least(0, (select min(c_acctbal) from customer)))",
    "zscore": "(c_acctbal - (select avg(c_acctbal) from customer)) / (select stddev_pop(c_acctbal) from customer)",
    "minmax": "(c_acctbal - (select min(c_acctbal) from customer)) / (select max(c_acctbal) - min(c_acctbal) from customer)",
}


def _bins(method):
    def run(spark, d):
        out = R.binning(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 4, method, labels=["a", "b", "c", "d"], new_name="tramo")
        return out.select("p_partkey", "tramo")

    return run


_BIN_Q = """select p_partkey, case when p_retailprice <= quantile_cont_25 then 'a' when p_retailprice <= quantile_cont_50 then 'b' when p_retailprice <= quantile_cont_75 then 'c' else 'd' end as tramo
from part, (select quantile_cont(p_retailprice, 0.25) as quantile_cont_25, quantile_cont(p_retailprice, 0.5) as quantile_cont_50, quantile_cont(p_retailprice, 0.75) as quantile_cont_75 from part)"""
_BIN_E = """select p_partkey, case when p_retailprice <= lo + (hi - lo) * 1 / 4 then 'a' when p_retailprice <= lo + (hi - lo) * 2 / 4 then 'b' when p_retailprice <= lo + (hi - lo) * 3 / 4 then 'c' else 'd' end as tramo
from part, (select min(p_retailprice) as lo, max(p_retailprice) as hi from part)"""


def etl_sample(spark, d):
    return R.sample(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), frac=0.1, key=["o_orderkey"])


def recipe_chain(spark, d):
    steps = [
        {"op": "vacios_a_nulos"}, {"op": "filtrar", "query": "value > 10 or event_type == 'click'"}, {"op": "nueva_columna", "name": "doble", "expression": "value * 2 + 1"},
        {"op": "imputar", "strategy_num": "mediana", "strategy_cat": "moda", "columns": ["event_type"]}, {"op": "eliminar_columnas", "columns": ["props", "ts"]},
    ]
    out, log = R.apply_recipe(ev_null(spark, d), steps)
    assert all(x["estado"] == "ok" for x in log), log
    return rounded(out)


_CHAIN = f"""with f as (select * from {EV_NULL_SQL} where coalesce(value > 10, false) or coalesce(event_type = 'click', false))
select event_id, user_id, coalesce(event_type, (select event_type from (select event_type, count(*) as c from f where event_type is not null group by 1) order by c desc, event_type limit 1)) as event_type,
 round(value, 4) as value, round(value * 2 + 1, 4) as doble from f"""


def recipe_auto(spark, d):
    docs = ev_null(spark, d).withColumn("fijo", F.lit("x")).withColumn("monto", F.concat(F.lit("$ "), F.col("user_id").cast("string"))).drop("ts", "props")
    steps = R.auto_recipe(docs, ["event_id"])
    import json

    return spark.createDataFrame([(k, json.dumps(s, ensure_ascii=False)) for k, s in enumerate(steps, 1)], "paso int, detalle string")


QUERIES = {
    **{f"etl_dedup_{n}": (_dedup(k), _dedup_sql(k)) for n, k in (("first", "first"), ("last", "last"), ("none", False))},
    "etl_drop_empty": (etl_drop_empty, f"select * from (select nullif(l_linenumber, 3) as a, l_discount, case when l_discount is not null then l_quantity end as l_quantity from {LI_NULL_SQL}) where (a is not null)::int + (l_discount is not null)::int + (l_quantity is not null)::int >= 2"),
    "etl_drop_na": (etl_drop_na, f"select {', '.join(LINE[:4])}, l_quantity, l_discount from {LI_NULL_SQL} where l_quantity is not null and l_discount is not null"),
    "etl_convert_types": (etl_convert_types, _CONVERT),
    "etl_clean_text": (etl_clean_text, "select p_partkey, lower(p_type) as p_type from part"),
    "etl_blanks_to_null": (etl_blanks_to_null, "select event_id, case when event_id % 11 = 0 then null else event_type end as event_type from events"),
    "etl_impute_mean": (_impute(strategy_num="media"), _num(f"(select avg(value) from {EV_NULL_SQL})")),
    "etl_impute_median": (_impute(strategy_num="mediana"), _num(f"(select median(value) from {EV_NULL_SQL})")),
    "etl_impute_zero": (_impute(strategy_num="cero"), _num("0")),
    "etl_impute_ffill": (_impute(strategy_num="ffill", strategy_cat="ffill"), _FFILL),
    "etl_impute_interpolate": (_impute(strategy_num="interpolar"), _LERP),
    "etl_impute_flag": (_impute(strategy_num="cero", add_flag=True), _num("0").replace(" as value from", " as value, (event_type is null)::int as event_type__faltante, (value is null)::int as value__faltante from")),
    "etl_impute_knn": (lambda s, d: rounded(R.impute(li_null(s, d).select(*LINE[:6], "l_discount"), "knn", columns=["l_quantity", "l_extendedprice", "l_discount"])), None),
    **{f"etl_outliers_{m}_{a}": (_outliers(m, a), _outliers_sql(m, a)) for m in ("iqr", "zscore", "percentil") for a in ("winsorizar", "nulo", "eliminar")},
    "etl_filter_expr": (etl_filter_expr, "select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority from orders where o_totalprice > 1000 and o_orderstatus in ('F', 'O') and o_orderpriority <> '1-URGENT' and o_orderkey >= 10 and o_orderkey < 9000"),
    "etl_new_column": (etl_new_column, f"select {', '.join(LINE[:4])}, round(l_extendedprice, 4) as l_extendedprice, round(l_discount, 4) as l_discount, round(l_tax, 4) as l_tax, round(case when l_tax <> 0 then l_extendedprice * (1 - l_discount) / (l_tax * 100) + 0.0000001::double end, 4) as neto from lineitem"),
    "etl_date_features": (etl_date_features, _DATES),
    "etl_group_rare": (etl_group_rare, _RARE),
    **{f"etl_{m}": (_transform(m), f"select c_custkey, round({x}, 4) as c_acctbal from customer") for m, x in _SCALE.items()},
    "etl_yeo_johnson": (_transform("boxcox_yeo"), None),
    "etl_bin_quantile": (_bins("cuantiles"), _BIN_Q),
    "etl_bin_equal": (_bins("iguales"), _BIN_E),
    "etl_sample": (etl_sample, None),
    "recipe_chain": (recipe_chain, _CHAIN),
    "recipe_auto": (recipe_auto, None),
}
