"""Descriptive statistics, association and time series."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..operators import eda
from .inputs import EV_NULL_SQL, LI_NULL_SQL, ev_null, li_null, rounded, table

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = list(itertools.combinations(NUM, 2))


def describe_categorical(spark, d):
    out = eda.describe_categorical(ev_null(spark, d), ["event_type"])
    return rounded(out, pct_moda="%_moda", cardinalidad_pct="cardinalidad_%")


_CATEGORICAL = f"""with c as (select event_type as v, count(*) as k from {EV_NULL_SQL} group by 1), n as (select sum(k)::bigint as rows, (sum(k) filter (where v is not null))::bigint as n, count(v) as kinds from c)
select 'event_type' as variable, n, rows - n as nulos, kinds as categorias, (select v from c where v is not null order by k desc, v limit 1) as moda,
 (select k from c where v is not null order by k desc, v limit 1) as frec_moda, round(100.0 * (select k from c where v is not null order by k desc, v limit 1) / rows, 2) as pct_moda,
 (select string_agg(v || ' (' || k || ')', ', ' order by k desc, v) from (select * from c where v is not null order by k desc, v limit 3)) as top_categorias,
 round((select -sum(k * 1.0 / n * log2(k * 1.0 / n)) from c where v is not null), 4) as entropia,
 round((select -sum(k * 1.0 / n * log2(k * 1.0 / n)) from c where v is not null) / case when kinds > 1 then log2(kinds) else 1 end, 4) as balance,
 round(100.0 * kinds / rows, 2) as cardinalidad_pct from n"""


def value_counts(spark, d):
    return rounded(eda.value_counts(ev_null(spark, d), "event_type"), pct="%", pct_acumulado="%_acumulado")


_COUNTS = f"""with c as (select coalesce(event_type, 'nan') as categoria, count(*) as frecuencia from {EV_NULL_SQL} group by 1),
p as (select *, round(100.0 * frecuencia / (select sum(frecuencia) from c), 2) as pct from c order by frecuencia desc, categoria limit 20)
select categoria, frecuencia, pct, round(sum(pct) over (order by frecuencia desc, categoria), 2) as pct_acumulado from p"""


def corr_pearson(spark, d):
    return rounded(eda.corr_pearson(li_null(spark, d), NUM))


_PEARSON = "\nunion all\n".join(f"select '{a}' as variable_1, '{b}' as variable_2, round(corr({a}, {b}), 4) as correlacion from {LI_NULL_SQL}" for a, b in PAIRS)


def corr_spearman(spark, d):
    return rounded(eda.corr_spearman(li_null(spark, d), NUM))


_SPEARMAN = "\nunion all\n".join(
    f"""select '{a}' as variable_1, '{b}' as variable_2, round(corr(ra, rb), 4) as correlacion from (
 select rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2.0 as ra, rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2.0 as rb
 from {LI_NULL_SQL} where {a} is not null and {b} is not null)""" for a, b in PAIRS
)


def corr_kendall(spark, d):
    return rounded(eda.corr_kendall(table(spark, d, "customer"), "c_nationkey", "c_acctbal"))


_KENDALL = """select 'c_nationkey' as variable_1, 'c_acctbal' as variable_2, round(sum(sign(a.c_nationkey - b.c_nationkey) * sign(a.c_acctbal - b.c_acctbal)) /
 sqrt(sum(sign(a.c_nationkey - b.c_nationkey) * sign(a.c_nationkey - b.c_nationkey)) * sum(sign(a.c_acctbal - b.c_acctbal) * sign(a.c_acctbal - b.c_acctbal))), 4)::double as correlacion
 from customer a join customer b on a.c_custkey < b.c_custkey"""


def corr_kendall_whole(spark, d):
    return rounded(eda.corr_kendall(table(spark, d, "part"), "p_size", "p_retailprice"))


_KENDALL_WHOLE = """select 'p_size' as variable_1, 'p_retailprice' as variable_2, round(sum(sign(a.p_size - b.p_size) * sign(a.p_retailprice - b.p_retailprice)) /
 sqrt(sum(sign(a.p_size - b.p_size) * sign(a.p_size - b.p_size)) * sum(sign(a.p_retailprice - b.p_retailprice) * sign(a.p_retailprice - b.p_retailprice))), 4)::double as correlacion
from part a join part b on a.p_partkey < b.p_partkey"""


def top_correlations(spark, d):
    li = table(spark, d, "lineitem").withColumn("neto", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rounded(eda.top_correlations(eda.corr_pearson(li, [*NUM, "neto"]), 0.5))


_TOP = f"""select variable_1, variable_2, round(c, 4) as correlacion, case when abs(c) >= 0.9 then 'Muy fuerte' when abs(c) >= 0.7 then 'Fuerte' else 'Moderada' end as fuerza,
 case when c > 0 then 'Positiva' else 'Negativa' end as sentido
from ({" union all ".join(f"select '{a}' as variable_1, '{b}' as variable_2, corr({a}, {b}) as c from (select *, l_extendedprice * (1 - l_discount) as neto from lineitem)" for a, b in [*PAIRS, *((c, "neto") for c in NUM)])}) where abs(c) >= 0.5 order by abs(c) desc limit 25"""


def cramers_v(spark, d):
    return rounded(eda.cramers_v(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus").unionByName(eda.cramers_v(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")))


def _chi_cte(a: str, b: str, t: str) -> str:
    return f"""o as (select {a} as a, {b} as b, count(*) as o from {t} group by 1, 2), ra as (select a, sum(o) as ra from o group by a), cb as (select b, sum(o) as cb from o group by b),
n as (select sum(o) as n from o), g as (select coalesce(o.o, 0) as o, ra * cb * 1.0 / n as e from ra cross join cb cross join n left join o on o.a = ra.a and o.b = cb.b),
t as (select sum((o - e) * (o - e) / e) as chi2, (select n from n) as n, (select count(*) from ra) as r, (select count(*) from cb) as k from g)"""


def _v_sql(a: str, b: str, t: str) -> str:
    return f"""select * from (with {_chi_cte(a, b, t)}
select '{a}' as variable_1, '{b}' as variable_2, round(sqrt(greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) / (least(k - (k - 1) * (k - 1) / (n - 1), r - (r - 1) * (r - 1) / (n - 1)) - 1)), 4) as v from t)"""


def chi2(spark, d):
    return rounded(eda.chi_square(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority").drop("yates"))


def correlation_ratio(spark, d):
    return rounded(eda.correlation_ratio(li_null(spark, d), "l_returnflag", "l_quantity"))


_ETA = f"""with x as (select l_returnflag as g, l_quantity as x from {LI_NULL_SQL} where l_quantity is not null), m as (select avg(x) as m, count(*) as n from x),
s as (select g, count(*) as n, avg(x) as a from x group by g), w as (select sum((x.x - s.a) * (x.x - s.a)) as ssw from x join s using (g)),
b as (select sum(s.n * (s.a - m.m) * (s.a - m.m)) as ssb, count(*) as g from s, m)
select m.n as n, b.g as g, round(sqrt(ssb / (ssb + ssw)), 4) as eta, round((ssb / (b.g - 1)) / (ssw / (m.n - b.g)), 4) as f from b, w, m"""


def target_relationship(spark, d):
    li = table(spark, d, "lineitem").select("l_extendedprice", "l_quantity", "l_discount", "l_returnflag")
    out = eda.target_relationship(li, "l_extendedprice")
    return rounded(out.select("variable", "metrica", "valor", "spearman"))


_TARGET = f"""select 'l_quantity' as variable, 'Pearson' as metrica, round(corr(l_quantity, l_extendedprice), 4) as valor, (select round(corr(a, b), 4) from (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as a, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 as b from lineitem)) as spearman from lineitem
union all select 'l_discount', 'Pearson', round(corr(l_discount, l_extendedprice), 4), (select round(corr(a, b), 4) from (select rank() over (order by l_discount) + (count(*) over (partition by l_discount) - 1) / 2.0 as a, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 as b from lineitem)) from lineitem
union all select 'l_returnflag', 'Eta', round(sqrt((select sum(n * (a - m) * (a - m)) from (select count(*) as n, avg(l_extendedprice) as a from lineitem group by l_returnflag), (select avg(l_extendedprice) as m from lineitem)) / (var_pop(l_extendedprice) * count(*))), 4), null from lineitem"""


def group_summary(spark, d):
    return rounded(eda.group_summary(li_null(spark, d), "l_returnflag", "l_quantity"), pct_del_total="%_del_total")


_GROUP = f"""select l_returnflag, count(l_quantity) as n, round(avg(l_quantity), 4) as promedio, round(median(l_quantity), 4) as mediana, round(stddev_samp(l_quantity), 4) as desv, round(min(l_quantity), 4) as minimo, round(max(l_quantity), 4) as maximo,
 round(100.0 * count(l_quantity) / sum(count(l_quantity)) over (), 2) as pct_del_total from {LI_NULL_SQL} group by 1"""


def crosstab_pct(spark, d):
    return rounded(eda.crosstab_pct(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority"))


_CROSS = """select o_orderstatus as a, o_orderpriority as b, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (partition by o_orderstatus), 2) as pct from orders group by 1, 2"""


def class_balance(spark, d):
    return rounded(eda.class_balance(table(spark, d, "orders"), "o_orderstatus"), pct="%")


_BALANCE = """select o_orderstatus as clase, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 2) as pct, round(count(*) * 1.0 / max(count(*)) over (), 4) as ratio_vs_mayoritaria from orders group by 1"""


def outlier_table(spark, d):
    return rounded(eda.outlier_table(li_null(spark, d), NUM), pct_outliers="%_outliers")


_OUT = "\nunion all\n".join(
    f"""select '{c}' as variable, round(lo, 4) as limite_inferior, round(hi, 4) as limite_superior, count(*) filter (where {c} < lo or {c} > hi) as n_outliers,
 round(100.0 * count(*) filter (where {c} < lo or {c} > hi) / count({c}), 2) as pct_outliers, round(min({c}) filter (where {c} < lo or {c} > hi), 4) as min_outlier, round(max({c}) filter (where {c} < lo or {c} > hi), 4) as max_outlier
from {LI_NULL_SQL}, (select quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as lo, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as hi from {LI_NULL_SQL}) group by lo, hi""" for c in NUM
)


def _series(name, date, value, freq):
    def run(spark, d):
        # a little is added before rounding, here and in the SQL, as exact ties are rounded differently by the two engines
        out = eda.timeseries_summary(table(spark, d, name), date, value, freq).withColumn("promedio", F.col("promedio") + 1e-7)
        out = rounded(out, variacion_pct="variacion_%")
        return out.withColumn(date, F.col(date).cast("string")).withColumnRenamed(date, "periodo")

    return run


def _series_sql(name, date, value, unit, step):
    return f"""with p as (select date_trunc('{unit}', {date})::date as p, sum({value}) as t, avg({value}) as m, count(*) as n from {name} where {value} is not null group by 1),
c as (select unnest(generate_series((select min(p) from p)::timestamp, (select max(p) from p)::timestamp, interval {step}))::date as p),
f as (select ((c.p + interval {step})::date - 1)::varchar as periodo, coalesce(t, 0) as total, m, coalesce(n, 0) as n from c left join p on c.p = p.p)
select periodo, round(total, 4) as total, round(m + 1e-7, 4) as promedio, n, round(100 * (total - lag(total) over (order by periodo)) / nullif(lag(total) over (order by periodo), 0), 4) as variacion_pct from f"""


def histogram(spark, d):
    return rounded(eda.histogram(table(spark, d, "lineitem"), "l_extendedprice", 40), 2)


_HIST = """with r as (select min(l_extendedprice) as lo, (max(l_extendedprice) - min(l_extendedprice)) / 40 as w from lineitem)
select least(floor((l_extendedprice - lo) / w), 39)::bigint as bin, count(*) as n, round(lo + least(floor((l_extendedprice - lo) / w), 39)::bigint * w, 2) as desde, round(lo + (least(floor((l_extendedprice - lo) / w), 39)::bigint + 1) * w, 2) as hasta
from lineitem, r group by 1, 3, 4"""


def box_stats(spark, d):
    return rounded(eda.box_stats(table(spark, d, "orders"), "o_totalprice", "o_orderpriority"))


_BOX = """with q as (select o_orderpriority as grupo, count(*) as n, quantile_cont(o_totalprice, 0.25) as p25, median(o_totalprice) as mediana, quantile_cont(o_totalprice, 0.75) as p75 from orders group by 1)
select grupo, n, round(p25, 4) as p25, round(mediana, 4) as mediana, round(p75, 4) as p75, round(min(o_totalprice) filter (where o_totalprice >= p25 - 1.5 * (p75 - p25)), 4) as bigote_inf, round(max(o_totalprice) filter (where o_totalprice <= p75 + 1.5 * (p75 - p25)), 4) as bigote_sup
from orders join q on o_orderpriority = grupo group by grupo, n, p25, mediana, p75"""


def regr_trend(spark, d):
    return rounded(eda.trend_line(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


def normality(spark, d):
    return rounded(eda.normality_tests(table(spark, d, "customer"), ["c_acctbal"]), es_normal="es_normal_95%")


_ORDERS = ("orders", "o_orderdate", "o_totalprice")
QUERIES = {
    "describe_categorical": (describe_categorical, _CATEGORICAL),
    "value_counts": (value_counts, _COUNTS),
    "corr_pearson": (corr_pearson, _PEARSON),
    "corr_spearman": (corr_spearman, _SPEARMAN),
    "corr_kendall": (corr_kendall, _KENDALL),
    "corr_kendall_whole": (corr_kendall_whole, _KENDALL_WHOLE),
    "top_correlations": (top_correlations, _TOP),
    "cramers_v": (cramers_v, _v_sql("l_returnflag", "l_linestatus", "lineitem") + " union all " + _v_sql("o_orderstatus", "o_orderpriority", "orders")),
    "chi2": (chi2, f"with {_chi_cte('o_orderstatus', 'o_orderpriority', 'orders')} select n::bigint as n, r, k, round(chi2, 4) as chi2 from t"),
    "correlation_ratio": (correlation_ratio, _ETA),
    "target_relationship": (target_relationship, _TARGET),
    "group_summary": (group_summary, _GROUP),
    "crosstab_pct": (crosstab_pct, _CROSS),
    "class_balance": (class_balance, _BALANCE),
    "outlier_table": (outlier_table, _OUT),
    "timeseries_day": (_series("events", "ts", "value", "D"), _series_sql("events", "ts", "value", "day", "1 day")),
    "timeseries_week": (_series("events", "ts", "value", "W"), _series_sql("events", "ts", "value", "week", "7 day")),
    "timeseries_month": (_series(*_ORDERS, "ME"), _series_sql(*_ORDERS, "month", "1 month")),
    "timeseries_quarter": (_series(*_ORDERS, "QE"), _series_sql(*_ORDERS, "quarter", "3 month")),
    "timeseries_year": (_series(*_ORDERS, "YE"), _series_sql(*_ORDERS, "year", "1 year")),
    "histogram": (histogram, _HIST),
    "box_stats": (box_stats, _BOX),
    "regr_trend": (regr_trend, "select round(regr_slope(l_extendedprice, l_quantity), 4) as pendiente, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercepto, round(regr_r2(l_extendedprice, l_quantity), 4) as r2 from lineitem"),
    "normality_tests": (normality, None),
}
