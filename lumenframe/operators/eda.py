"""Descriptive statistics, association, tests and time series."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import parsing as P
from ..functions import special
from ..functions import stats as S
from ..plans import order
from ..plans.fusion import AggFusion, stacked
from ..sources import workspace

SHAPIRO_MOST, SHAPIRO_LEAST = 5_000, 20
#: Rows of a range bucket that one task counts discordant pairs in (more only beyond KENDALL_BUCKETS of them).
KENDALL_ROWS, KENDALL_BUCKETS = 1 << 14, 1_024
STRENGTH = ((0.9, "Muy fuerte"), (0.7, "Fuerte"), (0.5, "Moderada"), (0.3, "Débil"))


def shape_label(skew: Column, kurt: Column) -> Column:
    base = F.when(skew.isNull(), "Sin datos").when(skew > 0.5, "Asimétrica a la derecha").when(skew < -0.5, "Asimétrica a la izquierda").otherwise("Aproximadamente simétrica")
    return F.when(kurt > 3, F.concat(base, F.lit(", colas pesadas"))).otherwise(base)


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a numeric column: moments from one pass, quantiles and modes from others."""
    columns = columns or N.numeric_columns(df)
    x = lambda c: P.to_float(N.q(c))
    stats = {
        "n": lambda c: F.count(x(c)), "nulos": lambda c: F.count("*") - F.count(x(c)), "media": lambda c: F.avg(x(c)),
        "desv_std": lambda c: F.stddev_samp(x(c)), "min": lambda c: F.min(x(c)), "max": lambda c: F.max(x(c)),
        "asimetria": lambda c: S.skewness(x(c)), "curtosis": lambda c: S.kurtosis(x(c)), "ceros": lambda c: F.count_if(x(c) == 0),
    }
    kinds = {k: "long" if k in ("n", "nulos", "ceros") else "double" for k in stats}
    out = stacked(df, columns, stats, kinds)
    cuts = order.quantiles(df, {c: (x(c), (0.05, 0.25, 0.5, 0.75, 0.95)) for c in columns})
    tops = order.tallies(df, {c: x(c) for c in columns})
    placed = df.sparkSession.createDataFrame([(c, tops[c][1], *cuts[c]) for c in columns], "variable string, moda double, p5 double, p25 double, mediana double, p75 double, p95 double")
    out = out.join(F.broadcast(placed), "variable")  # a row a column
    return out.select(
        "variable", "n", "nulos", "media", "mediana", "moda", "desv_std", (100 * S.ratio(F.col("desv_std"), F.abs("media"))).alias("cv_%"), "min", "p5", "p25", "p75", "p95", "max",
        (F.col("max") - F.col("min")).alias("rango"), (F.col("p75") - F.col("p25")).alias("iqr"), "asimetria", "curtosis",
        S.percent(F.col("ceros"), F.col("n")).alias("ceros_%"), shape_label(F.col("asimetria"), F.col("curtosis")).alias("distribucion"),
    )


def describe_categorical(df: DataFrame, columns: list[str] | None = None, top: int = 3) -> DataFrame:
    """One row a categorical column: mode, its share of all rows, top values, entropy of the non-null ones in bits, balance."""
    out = None
    for c in columns or N.text_columns(df):
        counts = df.groupBy(N.q(c).cast("string").alias("v")).agg(F.count("*").alias("k"))
        total = F.sum(F.when(F.col("v").isNotNull(), F.col("k")))
        facts = counts.agg(
            F.coalesce(total, F.lit(0)).alias("n"), F.sum("k").alias("rows"), F.count("v").alias("kinds"),
            F.sum(F.when(F.col("v").isNotNull(), F.col("k") * F.log2("k"))).alias("klog"),
        )
        best = counts.filter("v is not null").orderBy(F.desc("k"), "v").limit(top)
        best = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("m"), "v"))).alias("best"))
        entropy = F.when(F.col("n") > 0, F.log2(F.nullif("n", F.lit(0))) - F.col("klog") / F.col("n"))
        row = facts.crossJoin(best).select(  # one row by one row
            F.lit(c).alias("variable"), "n", (F.col("rows") - F.col("n")).alias("nulos"), F.col("kinds").alias("categorias"),
            F.try_element_at("best", F.lit(1))["v"].alias("moda"), (-F.try_element_at("best", F.lit(1))["m"]).alias("frec_moda"),
            S.percent(-F.try_element_at("best", F.lit(1))["m"], F.col("rows")).alias("%_moda"),
            F.array_join(F.transform("best", lambda b: F.concat(b["v"], F.lit(" ("), (-b["m"]).cast("string"), F.lit(")"))), ", ").alias("top_categorias"),
            entropy.alias("entropia"), (entropy / F.when(F.col("kinds") > 1, F.log2(F.col("kinds"))).otherwise(F.lit(1.0))).alias("balance"),
            S.percent(F.col("kinds"), F.col("rows")).alias("cardinalidad_%"),
        )
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("there is no categorical column")
    return out


def value_counts(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """Most frequent values, missing being one, with shares and the running sum of the rounded shares."""
    counts = df.groupBy(N.as_label(N.q(column)).alias("categoria")).agg(F.count("*").alias("frecuencia"))
    total = counts.agg(F.sum("frecuencia").alias("total"))
    best = counts.orderBy(F.desc("frecuencia"), "categoria").limit(top).crossJoin(F.broadcast(total))  # one row
    running = W.orderBy(F.desc("frecuencia"), "categoria").rowsBetween(W.unboundedPreceding, 0)  # ``top`` rows
    share = best.withColumn("%", S.percent(F.col("frecuencia"), F.col("total")))
    return share.select("categoria", "frecuencia", "%", F.round(F.sum("%").over(running), 2).alias("%_acumulado"))


# --- correlation and association --------------------------------------------------------------


def _pairs(columns: list[str]) -> list[tuple[str, str]]:
    return list(itertools.combinations(columns, 2))


def corr_pearson(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows (variable_1, variable_2, correlacion) of the upper triangle; each pair over the rows that have both; one pass."""
    columns = columns or N.numeric_columns(df)
    x = {c: P.to_float(N.q(c)) for c in columns}
    return _unfold(df, {(a, b): F.corr(x[a], x[b]) for a, b in _pairs(columns)})


def _unfold(df: DataFrame, found: dict[tuple[str, str], Column]) -> DataFrame:
    if not found:
        return df.sparkSession.createDataFrame([], "variable_1 string, variable_2 string, correlacion double")
    rows = F.array(*[F.struct(F.lit(a).alias("variable_1"), F.lit(b).alias("variable_2"), v.alias("correlacion")) for (a, b), v in found.items()])
    return df.agg(rows.alias("r")).select(F.inline("r"))


def _running(counts: DataFrame, key: str, n: str) -> DataFrame:
    """``before``: the sum of ``n`` over smaller keys, by ranges of keys and then inside each."""
    # written, so that both uses see the same ranges, whatever is lost meanwhile
    ranged = workspace.keep(counts.repartitionByRange(F.col(key)).withColumn("__part", F.spark_partition_id()), "ranges")
    inside = W.partitionBy("__part").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    sized = ranged.withColumn("__in", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    part = sized.groupBy("__part").agg(F.sum(n).alias("__s"))
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    part = part.select("__part", F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__off"))
    return sized.join(F.broadcast(part), "__part").withColumn("before", F.col("__off") + F.col("__in")).drop("__part", "__in", "__off")


def corr_spearman(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """As ``corr_pearson`` on average ranks, each pair ranked over the rows that have both.

    The ranks of all pairs come from one table of counted values; columns without gaps are ranked once.
    """
    columns = columns or N.numeric_columns(df)
    clean = df.select(*[P.to_float(N.q(c)).alias(c) for c in columns])
    gaps = clean.agg(*[F.count_if(N.q(c).isNull()).alias(f"g{k}") for k, c in enumerate(columns)]).first()
    full = {c for k, c in enumerate(columns) if not gaps[k]}
    ranked: dict[tuple[str, str | None], Column] = {}  # a column, and the other one that its rows must have
    for pair in _pairs(columns):
        for c, other in (pair, pair[::-1]):
            key = (c, None if other in full else other)
            ranked[key] = N.q(c) if key[1] is None else F.when(N.q(other).isNotNull(), N.q(c))
    placed = workspace.keep(order.ranks(clean, list(ranked.values())), "ranks")
    wide = clean
    for k, value in enumerate(ranked.values()):  # each rank is joined to the rows once, for all pairs that use it
        own = placed.filter(F.col("c") == k).select(F.col("value").alias(f"__v{k}"), (F.col("before") + (F.col("n") + 1) / 2).alias(f"__r{k}"))
        wide = wide.join(own, value == F.col(f"__v{k}"), "left").drop(f"__v{k}")
    number = {key: k for k, key in enumerate(ranked)}
    rank = lambda c, other: F.col(f"__r{number[c, None if other in full else other]}")
    both = lambda a, b: N.q(a).isNotNull() & N.q(b).isNotNull()
    return _unfold(wide, {(a, b): F.corr(F.when(both(a, b), rank(a, b)), F.when(both(a, b), rank(b, a))) for a, b in _pairs(columns)})


def corr_kendall(df: DataFrame, a: str, b: str, rows: int = KENDALL_ROWS) -> DataFrame:
    """Tau-b of two columns over all rows that have both.

    Values are counted by (x, y). With places in the order of (x, y) and of (y, x), two pairs are discordant if the
    orders disagree. Both orders are cut into range buckets: discordant pairs are counted inside a bucket of x,
    inside a bucket of y between buckets of x, and, for pairs apart in both, from the counts of a small grid.
    """
    cells = df.select(P.to_float(N.q(a)).alias("x"), P.to_float(N.q(b)).alias("y")).filter("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
    two = lambda c: F.coalesce(F.sum(F.col(c) * (F.col(c) - 1) / 2), F.lit(0.0))
    facts = cells.agg(F.count("*").alias("cells"), two("n").alias("both"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n")).first()
    tied = [cells.groupBy(c).agg(F.sum("n").alias("n")).agg(two("n")).first()[0] for c in ("x", "y")]
    size = max(rows, -(-facts["cells"] // KENDALL_BUCKETS))
    placed = cells.select("n", F.struct("x", "y").alias("p"), F.struct("y", "x").alias("q"), F.lit(1).alias("one"))
    for order, place in (("p", "i"), ("q", "j")):
        placed = _running(placed, order, "one").withColumnRenamed("before", place)
    placed = placed.select("n", "i", "j", F.floor(F.col("i") / size).alias("bi"), F.floor(F.col("j") / size).alias("bj"))
    inside = placed.groupBy("bi").applyInPandas(lambda t: _inversions(t, "i"), "d double")
    across = placed.groupBy("bj").applyInPandas(lambda t: _inversions(t, "bi"), "d double")
    discordant = inside.unionByName(across).agg(F.coalesce(F.sum("d"), F.lit(0.0))).first()[0]
    buckets = -(-facts["cells"] // size)
    grid = np.zeros((buckets, buckets))
    for r in placed.groupBy("bi", "bj").agg(F.sum("n").alias("n")).toLocalIterator():
        grid[r["bi"], r["bj"]] = r["n"]
    if buckets > 1:
        earlier = np.cumsum(grid, axis=0)[:-1]  # of smaller x, up to this bucket of y
        above = earlier.sum(axis=1, keepdims=True) - np.cumsum(earlier, axis=1)
        discordant += float((above * grid[1:]).sum())
    pairs = facts["n"] * (facts["n"] - 1) / 2
    apart = (pairs - tied[0]) * (pairs - tied[1])
    tau = (pairs - tied[0] - tied[1] + facts["both"] - 2 * discordant) / math.sqrt(apart) if apart > 0 else None
    return df.sparkSession.createDataFrame([(a, b, tau)], "variable_1 string, variable_2 string, correlacion double")


def _inversions(t, by: str):
    """The weight of pairs with smaller ``by`` and larger j, level by level over the bits of the place in ``by``."""
    import pandas as pd

    w, j = t["n"].to_numpy(dtype=float), t["j"].to_numpy()
    _, place = np.unique(t[by].to_numpy(), return_inverse=True)
    total, down = 0.0, np.argsort(-j, kind="stable")
    w, place = w[down], place[down]
    for level in range(int(place.max()).bit_length()):
        order = np.argsort(place >> (level + 1), kind="stable")  # by block, then by falling j
        block, late = (place >> (level + 1))[order], ((place >> level) & 1)[order].astype(bool)
        run = np.cumsum(np.where(late, 0.0, w[order]))
        first = np.searchsorted(block, block)
        total += float((w[order] * (run - np.where(first > 0, run[first - 1], 0.0)))[late].sum())
    return pd.DataFrame({"d": [total]})


def correlation_matrix(df: DataFrame, method: str = "pearson", columns: list[str] | None = None) -> DataFrame:
    if method == "kendall":
        out = None
        for a, b in _pairs(columns or N.numeric_columns(df)):
            one = corr_kendall(df, a, b)
            out = one if out is None else out.unionByName(one)
    else:
        out = {"pearson": corr_pearson, "spearman": corr_spearman}[method](df, columns)
    return out.withColumn("correlacion", F.round("correlacion", 3))


def strength(c: Column) -> Column:
    out = F.lit("Muy débil")
    for least, name in reversed(STRENGTH):
        out = F.when(F.abs(c) >= least, name).otherwise(out)
    return out


def top_correlations(corr: DataFrame, threshold: float = 0.5, top: int = 25) -> DataFrame:
    kept = corr.filter(F.abs("correlacion") >= threshold).orderBy(F.abs("correlacion").desc(), "variable_1", "variable_2").limit(top)
    return kept.select("variable_1", "variable_2", "correlacion", strength(F.col("correlacion")).alias("fuerza"), F.when(F.col("correlacion") > 0, "Positiva").otherwise("Negativa").alias("sentido"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(N.as_label(N.q(a)).alias("a"), N.as_label(N.q(b)).alias("b")).agg(F.count("*").alias("o"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, r, k, chi2, yates): over the full grid, empty cells included; ``yates`` has the continuity correction (2 by 2)."""
    cells = contingency(df, a, b)
    rows = cells.groupBy("a").agg(F.sum("o").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("cb"))
    total = rows.agg(F.sum("ra").alias("n"), F.count("*").alias("r")).crossJoin(cols.agg(F.count("*").alias("k")))  # one row by one row
    full = cells.join(rows, "a").join(cols, "b").crossJoin(F.broadcast(total))  # one row
    e = F.col("ra") * F.col("cb") / F.col("n")
    # sum of O^2/E over filled cells is n more than chi-square, as empty ones add E - 2*0 + 0
    short = F.least(F.lit(0.5), F.abs(F.col("o") - e))
    return full.groupBy("n", "r", "k").agg((F.sum(F.col("o") * F.col("o") / e) - F.max("n")).alias("chi2"), F.sum(F.pow(F.abs(F.col("o") - e) - short, 2) / e).alias("yates"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Bias-corrected V, (variable_1, variable_2, v); null for fewer than two values on a side."""
    t = chi_square(df, a, b)
    n1 = F.greatest(F.col("n") - 1, F.lit(1))
    phi = F.greatest(F.lit(0.0), F.col("chi2") / F.col("n") - (F.col("k") - 1) * (F.col("r") - 1) / n1)
    least = F.least(F.col("k") - F.pow(F.col("k") - 1, 2) / n1, F.col("r") - F.pow(F.col("r") - 1, 2) / n1) - 1
    v = F.when((F.col("r") >= 2) & (F.col("k") >= 2) & (least > 0), F.sqrt(F.greatest(phi, F.lit(0.0)) / F.nullif(least, F.lit(0.0))))
    return t.select(F.lit(a).alias("variable_1"), F.lit(b).alias("variable_2"), v.alias("v"))


def categorical_association(df: DataFrame, columns: list[str] | None = None, max_cols: int = 15) -> DataFrame:
    out = None
    for a, b in _pairs((columns or N.text_columns(df))[:max_cols]):
        out = cramers_v(df, a, b) if out is None else out.unionByName(cramers_v(df, a, b))
    return out


def correlation_ratio(df: DataFrame, cat: str, val: str) -> DataFrame:
    """Eta and the F statistic of a category on a number: (n, g, eta, f)."""
    x = df.select(N.as_label(N.q(cat)).alias("g"), P.to_float(N.q(val)).alias("x")).filter("x is not null")
    groups = x.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    within = F.sum(F.col("n") * F.col("v"))
    mean = S.ratio(F.sum(F.col("n") * F.col("m")), F.sum("n"))
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum("n") * mean * mean
    row = groups.agg(F.sum("n").alias("n"), F.count("*").alias("g"), between.alias("ssb"), within.alias("ssw"))
    eta = F.when(F.col("g") >= 2, F.sqrt(S.ratio(F.greatest(F.col("ssb"), F.lit(0.0)), F.nullif(F.col("ssb") + F.col("ssw"), F.lit(0.0)))))
    f = S.ratio(F.col("ssb") / F.nullif(F.col("g") - 1, F.lit(0)), F.nullif(S.ratio(F.col("ssw"), F.nullif(F.col("n") - F.col("g"), F.lit(0))), F.lit(0.0)))
    return row.select("n", "g", eta.alias("eta"), f.alias("f"))


def target_relationship(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """How each feature goes with the target: r, eta or V by type, with its p-value, strongest first."""
    rows = []
    numeric_target = N.is_numeric(df, target)
    for c in features or [c for c in N.data_columns(df) if c != target]:
        number = N.is_numeric(df, c)
        if not number and not N.is_text(df, c) and not N.is_bool(df, c):
            continue
        rank = None
        if number and numeric_target:
            pair = df.select(P.to_float(N.q(c)).alias("x"), P.to_float(N.q(target)).alias("y")).dropna()
            r = pair.agg(F.count("*").alias("n"), F.corr("x", "y").alias("r")).first()
            rank = corr_spearman(pair, ["x", "y"]).first()["correlacion"]
            kind, name, value, p = "numérica", "Pearson", r["r"], special.pearson_p(r["r"], r["n"])
        elif number or numeric_target:
            cat, val = (target, c) if number else (c, target)
            r = correlation_ratio(df, cat, val).first()
            kind, name, value = "numérica" if number else "categórica", "Eta", r["eta"]
            p = special.f_sf(r["f"], r["g"] - 1, r["n"] - r["g"]) if r["f"] is not None else None
        else:
            t, v = chi_square(df, c, target).first(), cramers_v(df, c, target).first()["v"]
            dof = (t["r"] - 1) * (t["k"] - 1) if t else 0
            kind, name, value = "categórica", "V de Cramér", v
            p = special.chi2_sf(t["yates"] if t["r"] == t["k"] == 2 else t["chi2"], dof) if dof else None
        rows.append((c, kind, name, value, rank, p, None if p is None or math.isnan(p) else p < 0.05))
    out = df.sparkSession.createDataFrame(rows, "variable string, tipo_variable string, metrica string, valor double, spearman double, p_valor double, `significativo_95%` boolean")
    return out.withColumn("fuerza", strength(F.col("valor"))).orderBy(F.abs("valor").desc_nulls_last(), "variable")


def normality_tests(df: DataFrame, columns: list[str] | None = None, max_n: int = SHAPIRO_MOST) -> DataFrame:
    """Shapiro-Wilk on at most ``max_n`` rows' values a column (chosen by a hash of the row's place); columns under 20 values are left out."""
    rows = []
    for c in columns or N.numeric_columns(df):
        x = df.select(P.to_float(N.q(c)).alias("x")).dropna()
        placed = x.withColumn("at", F.monotonically_increasing_id())
        values = [r["x"] for r in placed.orderBy(F.xxhash64("at"), "at").limit(max_n).collect()] if max_n else []
        if len(values) < SHAPIRO_LEAST:
            continue
        w, p = special.shapiro_wilk(values)
        skew = x.agg(S.skewness(F.col("x"))).first()[0]
        advice = "Normal" if p >= 0.05 else "Transformación log" if (skew or 0) > 1 else "Pruebas no paramétricas"
        rows.append((c, w, p, p >= 0.05, skew, advice))
    return df.sparkSession.createDataFrame(rows, "variable string, shapiro_W double, p_valor double, `es_normal_95%` boolean, asimetria double, sugerencia string")


# --- groups -----------------------------------------------------------------------------------


def group_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    g, x = N.as_label(N.q(by)).alias(by), P.to_float(N.q(value))
    per = df.groupBy(g).agg(F.count(x).alias("n"), F.avg(x).alias("promedio"), F.stddev_samp(x).alias("desv"), F.min(x).alias("minimo"), F.max(x).alias("maximo"))
    per = order.with_median(per, df, by, N.as_label(N.q(by)), x, "mediana")
    share = S.percent(F.col("n"), F.sum("n").over(W.partitionBy())).alias("%_del_total")  # a row a group
    return per.select(N.q(by), "n", "promedio", "mediana", "desv", "minimo", "maximo", share)


def crosstab_pct(df: DataFrame, a: str, b: str) -> DataFrame:
    """Row-normalised counts in long form: (a, b, n, pct)."""
    cells = contingency(df, a, b)
    return cells.select("a", "b", F.col("o").alias("n"), S.percent(F.col("o"), F.sum("o").over(W.partitionBy("a"))).alias("pct"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(N.as_label(N.q(a)).alias(a)).pivot(b).count().fillna(0)


def class_balance(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(N.as_label(N.q(column)).alias("clase")).agg(F.count("*").alias("n"))
    all_ = W.partitionBy()  # a row a class
    return counts.select("clase", "n", S.percent(F.col("n"), F.sum("n").over(all_)).alias("%"), F.round(F.col("n") / F.max("n").over(all_), 4).alias("ratio_vs_mayoritaria"))


def outlier_table(df: DataFrame, columns: list[str] | None = None, factor: float = 1.5) -> DataFrame:
    """Bounds by the quartile range and what lies beyond; columns under five values are left out."""
    columns = columns or N.numeric_columns(df)
    facts = AggFusion(df)
    x = {c: P.to_float(N.q(c)) for c in columns}
    for c in columns:
        facts.want(c, F.count(x[c]))
    enough = {c for c, n in (facts.run() if columns else {}).items() if n >= 5}
    found = order.quantiles(df, {c: (x[c], (0.25, 0.75)) for c in columns if c in enough})
    low = {c: a - factor * (b - a) for c, (a, b) in found.items()}
    high = {c: b + factor * (b - a) for c, (a, b) in found.items()}
    out = lambda c: (x[c] < low[c]) | (x[c] > high[c])
    stats = {
        "limite_inferior": lambda c: F.lit(low[c]), "limite_superior": lambda c: F.lit(high[c]), "n": lambda c: F.count(x[c]), "n_outliers": lambda c: F.count_if(out(c)),
        "min_outlier": lambda c: F.min(F.when(out(c), x[c])), "max_outlier": lambda c: F.max(F.when(out(c), x[c])),
    }
    kinds = {k: "long" if k in ("n", "n_outliers") else "double" for k in stats}
    rows = stacked(df, list(found), stats, kinds)
    return rows.select("variable", "limite_inferior", "limite_superior", "n_outliers", S.percent(F.col("n_outliers"), F.col("n")).alias("%_outliers"), "min_outlier", "max_outlier").orderBy(F.desc("n_outliers"), "variable")


# --- time -------------------------------------------------------------------------------------

FREQUENCIES = {"D": ("day", "1 day"), "W": ("week", "7 days"), "ME": ("month", "1 month"), "QE": ("quarter", "3 months"), "YE": ("year", "1 year")}


def timeseries_summary(df: DataFrame, date_col: str, value_col: str, freq: str = "ME") -> DataFrame:
    """Totals by period, labelled by its last day; periods without rows are kept with total 0. Change in percent against the one before."""
    unit, step = FREQUENCIES[freq]
    start = F.to_date(F.date_trunc(unit, N.q(date_col).cast("timestamp_ntz")))
    rows = df.select(start.alias("p"), P.to_float(N.q(value_col)).alias("x")).filter("p is not null and x is not null")
    per = rows.groupBy("p").agg(F.sum("x").alias("t"), F.avg("x").alias("promedio"), F.count("*").alias("k"))
    span = per.agg(F.min("p").alias("a"), F.max("p").alias("b")).filter("a is not null")
    calendar = span.select(F.explode(F.expr(f"sequence(a, b, interval {step})")).alias("p"))
    last = F.date_sub(F.to_date(F.expr(f"p + interval {step}")), 1)
    full = calendar.join(per, "p", "left").select(last.alias(date_col), F.coalesce("t", F.lit(0.0)).alias("total"), "promedio", F.coalesce("k", F.lit(0)).alias("n"))
    before = F.lag("total").over(W.orderBy(date_col))  # a row a period
    return full.withColumn("variacion_%", 100 * S.ratio(F.col("total") - before, before))


# --- what charts need -------------------------------------------------------------------------


def histogram(df: DataFrame, column: str, bins: int = 40, by: str | None = None, top_groups: int = 8) -> DataFrame:
    """Counts of equal-width bins, (grupo,) bin, desde, hasta, n."""
    x = P.to_float(N.q(column))
    row = df.agg(F.min(x), F.max(x)).first()
    low, high = (row[0], row[1]) if row[0] is not None else (0.0, 0.0)
    width = (high - low) / bins or 1.0
    place = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("long").alias("bin")
    source, keys = df.filter(x.isNotNull()), [place]
    if by:
        label = N.as_label(N.q(by))
        often = [r["v"] for r in df.groupBy(label.alias("v")).count().orderBy(F.desc("count"), "v").limit(top_groups).collect()]
        source, keys = source.filter(label.isin(often)), [label.alias("grupo"), place]
    out = source.groupBy(*keys).agg(F.count("*").alias("n"))
    return out.withColumn("desde", low + F.col("bin") * width).withColumn("hasta", low + (F.col("bin") + 1) * width)


def box_stats(df: DataFrame, column: str, by: str, top_groups: int = 8) -> DataFrame:
    """Quartiles and whiskers (the farthest values within 1.5 quartile ranges) of the largest groups."""
    rows = df.select(N.as_label(N.q(by)).alias("grupo"), P.to_float(N.q(column)).alias("x")).filter("x is not null")
    listed = rows.groupBy("grupo").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "grupo").limit(top_groups).collect()
    own = order.quantiles(rows, {r["grupo"]: (F.when(F.col("grupo") == r["grupo"], F.col("x")), (0.25, 0.5, 0.75)) for r in listed})
    often = df.sparkSession.createDataFrame([(r["grupo"], r["n"], *own[r["grupo"]]) for r in listed], "grupo string, n long, p25 double, mediana double, p75 double")
    reach = 1.5 * (F.col("p75") - F.col("p25"))
    inside = (F.col("x") >= F.col("p25") - reach) & (F.col("x") <= F.col("p75") + reach)
    return rows.join(F.broadcast(often), "grupo").groupBy("grupo", "n", "p25", "mediana", "p75").agg(F.min(F.when(inside, F.col("x"))).alias("bigote_inf"), F.max(F.when(inside, F.col("x"))).alias("bigote_sup"))


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    a, b = P.to_float(N.q(x)), P.to_float(N.q(y))
    return df.agg(F.regr_slope(b, a).alias("pendiente"), F.regr_intercept(b, a).alias("intercepto"), F.regr_r2(b, a).alias("r2"))
