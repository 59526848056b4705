"""Recipes: reproducible chains of table operations, replayed lazily from the raw table."""

from __future__ import annotations

import inspect
import json
import math
import unicodedata
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import parsing as P
from ..functions import stats as S
from ..plans import order as O
from ..plans.fusion import AggFusion
from . import blocks as B
from . import space as X
from .expressions import translate
from .quality import dataset_diagnostics, with_position


def _present(df: DataFrame, columns: list[str] | None, default: list[str]) -> list[str]:
    return [c for c in (columns or default) if c in df.columns]


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """All columns in order, some computed anew, further ones appended; one projection."""
    kept = [new[c].alias(c) if c in new else N.q(c) for c in df.columns]
    return df.select(*kept, *[v.alias(k) for k, v in new.items() if k not in df.columns])


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.toDF(*[mapping.get(c, c) for c in df.columns])


def normalize_column_names(df: DataFrame) -> DataFrame:
    plain = N.normalize_names(N.data_columns(df))
    fresh = dict(zip(N.data_columns(df), plain, strict=True))
    return df.toDF(*[fresh.get(c, c) for c in df.columns])


def drop_duplicates(df: DataFrame, subset: list[str] | None = None, keep: str | bool = "first", order: list[str] | None = None) -> DataFrame:
    """First, last or (keep=False) no copy of rows equal in ``subset``, nulls being equal; ``order`` says what is first."""
    keys = [N.q(c) for c in _present(df, subset, N.data_columns(df))]
    over = W.partitionBy(*keys)
    if keep is False:
        return df.withColumn("__n", F.count("*").over(over)).filter("__n = 1").drop("__n")
    by = [N.q(c) for c in (order or ([N.ROW_ID] if N.ROW_ID in df.columns else []))]
    if not by:  # whole rows: any copy is the first one
        return df.dropDuplicates(subset) if subset else df.distinct()
    ranked = over.orderBy(*[c.desc() if keep == "last" else c.asc() for c in by])
    return df.withColumn("__n", F.row_number().over(ranked)).filter("__n = 1").drop("__n")


def drop_empty_rows(df: DataFrame, how: str = "all", thresh_pct: float | None = None) -> DataFrame:
    columns = N.data_columns(df)
    if thresh_pct is not None:
        return df.dropna(thresh=math.ceil(len(columns) * (1 - thresh_pct / 100)), subset=[f"`{c}`" for c in columns])
    return df.dropna(how=how, subset=[f"`{c}`" for c in columns])


def convert_types(df: DataFrame, mapping: dict[str, str], letter_share: dict[str, float] | None = None) -> DataFrame:
    """Columns to numerica, entero, fecha, texto, categorica or booleana; what can't be read becomes null."""
    new = {}
    text = {c: N.is_text(df, c) for c in mapping if c in df.columns}
    numeric = [c for c, t in mapping.items() if t in ("numerica", "entero") and text.get(c)]
    lettered = AggFusion(df)
    for c in numeric:
        lettered.want(c, F.struct(F.count_if(P.has_letters(N.q(c))).alias("k"), F.count(N.q(c)).alias("n")))
    share = {c: r["k"] / max(r["n"], 1) for c, r in (lettered.run() if numeric else {}).items()}
    for c, target in mapping.items():
        if c not in df.columns:
            continue
        col = N.q(c)
        if target in ("numerica", "entero"):
            if text[c]:
                # texts full of letters are read strictly, so that codes don't turn into numbers
                number = col.try_cast("double") if share[c] > 0.15 else P.parse_number(col)
            else:
                number = P.to_float(col) if not N.is_datetime(df, c) else F.unix_micros(col.cast("timestamp")) / 1e6
            new[c] = F.round(number).cast("long") if target == "entero" else number
        elif target == "fecha":
            new[c] = col if N.is_datetime(df, c) else P.parse_datetime(col)
        elif target == "booleana":
            new[c] = col if N.is_bool(df, c) else P.parse_bool(col)
        else:
            new[c] = col.cast("string")
    return _replace(df, new)


def _title(c: Column) -> Column:
    """As titles: a capital after anything that isn't a letter (initcap knows white space only)."""

    def titled(s: pd.Series) -> pd.Series:
        return s.str.title()

    return F.pandas_udf(titled, "string")(c)


def _without_accents(c: Column) -> Column:
    def plain(s: pd.Series) -> pd.Series:
        return s.map(lambda v: unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode(), na_action="ignore")

    return F.pandas_udf(plain, "string")(c)


def clean_text(df: DataFrame, columns: list[str] | None = None, strip: bool = True, case: str = "none", remove_accents: bool = False, collapse_spaces: bool = True) -> DataFrame:
    """Strips, collapses spaces, changes case, removes accents: in this order."""
    new = {}
    for c in _present(df, columns, N.text_columns(df)):
        col = N.q(c)
        if strip:
            col = P.stripped(col)
        if collapse_spaces:
            col = F.regexp_replace(col, r"[\s\p{Z}]+", " ")
        col = {"lower": F.lower, "upper": F.upper, "title": _title}.get(case, lambda x: x)(col)
        if remove_accents:
            ascii_only = ~F.coalesce(col.rlike(r"[^\x00-\x7F]"), F.lit(False))
            col = F.when(ascii_only, col).otherwise(_without_accents(col))
        new[c] = col
    return _replace(df, new)


def blanks_to_null(df: DataFrame) -> DataFrame:
    return _replace(df, {c: F.when(~P.is_blank(N.q(c)), N.q(c)) for c in N.text_columns(df)})


def _carried(c: Column, order: list[Column]) -> tuple[Column, Column]:
    """The last value up to here and the first from here, in order."""
    back = W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.orderBy(*[o.desc() for o in order]).rowsBetween(W.unboundedPreceding, 0)
    return F.last(c, ignorenulls=True).over(back), F.last(c, ignorenulls=True).over(ahead)


def _neighbours(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """For each column the nearest value before and after in ``order``, and their positions.

    Each range of rows is carried apart; what a range leaves over comes from a table of one row a range, so no
    task sees more than its range.
    """
    placed = with_position(df, order).withColumn("__part", F.floor(F.col("__pos") / 100_000))
    # both ways run down from the frame's start: a frame that ends at the last row would be gone through anew for each row
    forth = W.partitionBy("__part").orderBy("__pos").rowsBetween(W.unboundedPreceding, 0)
    back_to = W.partitionBy("__part").orderBy(F.desc("__pos")).rowsBetween(W.unboundedPreceding, 0)
    edge = placed.groupBy("__part").agg(*[
        F.struct(F.max_by(F.struct(N.q(c).alias("v"), F.col("__pos").alias("p")), F.when(N.q(c).isNotNull(), F.col("__pos"))).alias("last"),
                 F.min_by(F.struct(N.q(c).alias("v"), F.col("__pos").alias("p")), F.when(N.q(c).isNotNull(), F.col("__pos"))).alias("first")).alias(f"__e{k}")
        for k, c in enumerate(columns)
    ])
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy(F.desc("__part")).rowsBetween(W.unboundedPreceding, -1)
    edge = edge.select("__part", *[
        x for k in range(len(columns)) for x in (
            F.last(F.col(f"__e{k}.last"), ignorenulls=True).over(before).alias(f"__b{k}"), F.last(F.col(f"__e{k}.first"), ignorenulls=True).over(after).alias(f"__a{k}"))
    ])
    out = placed.join(F.broadcast(edge), "__part")  # a row for each 100,000
    here = lambda c: F.when(N.q(c).isNotNull(), F.struct(N.q(c).alias("v"), F.col("__pos").alias("p")))
    for k, c in enumerate(columns):
        back = F.last(here(c), ignorenulls=True).over(forth)
        ahead = F.last(here(c), ignorenulls=True).over(back_to)
        out = out.withColumn(f"__b{k}", F.coalesce(back, f"__b{k}")).withColumn(f"__a{k}", F.coalesce(ahead, f"__a{k}"))
    return out


def impute(df: DataFrame, strategy_num: str = "mediana", strategy_cat: str = "moda", columns: list[str] | None = None, constant_value: object = None,
           add_flag: bool = False, knn_neighbors: int = 5, order: list[str] | None = None) -> DataFrame:
    """Fills missing values: media, mediana, cero, constante, interpolar, ffill, knn or ninguna; moda, constante, ffill or ninguna for text.

    ``order`` says which rows are neighbours for interpolar and ffill (the row id by default).
    """
    wanted = _present(df, columns, N.data_columns(df))
    kept = df.columns
    flags = [f"{c}__faltante" for c in wanted] if add_flag else []
    if add_flag:
        df = df.select("*", *[N.q(c).isNull().cast("int").alias(f"{c}__faltante") for c in wanted])
    numbers = [c for c in wanted if N.is_numeric(df, c)]
    texts = [c for c in wanted if N.is_text(df, c) or N.is_bool(df, c)]
    by = order or [N.ROW_ID]
    new: dict[str, Column] = {}
    facts = AggFusion(df)
    if strategy_num in ("media", "mediana"):
        for c in numbers:
            if strategy_num == "media":
                facts.want(c, F.avg(P.to_float(N.q(c))))
    got = facts.run() if facts.wanted else {}
    if strategy_num == "mediana":
        got |= {c: v[0] for c, v in O.quantiles(df, {c: (P.to_float(N.q(c)), (0.5,)) for c in numbers}).items()}
    if strategy_cat == "moda":
        got |= {c: t[1] for c, t in O.tallies(df, {c: N.q(c) for c in texts}, "string").items()}
    for c in numbers:
        kind = df.schema[c].dataType
        if strategy_num in ("media", "mediana"):
            whole = got[c] is None or float(got[c]).is_integer()
            new[c] = F.coalesce(P.to_float(N.q(c)), F.lit(got[c])).cast(kind if whole else "double")
        elif strategy_num == "cero":
            new[c] = F.coalesce(N.q(c), F.lit(0).cast(kind))
        elif strategy_num == "constante":
            new[c] = F.coalesce(N.q(c), F.lit(0 if constant_value is None else constant_value).try_cast(kind))
    for c in texts:
        if strategy_cat == "moda":
            new[c] = F.coalesce(N.q(c), F.lit(got[c] if got[c] is not None else "DESCONOCIDO").cast(df.schema[c].dataType))
        elif strategy_cat == "constante":
            new[c] = F.coalesce(N.q(c).cast("string"), F.lit(str(constant_value) if constant_value is not None else "DESCONOCIDO"))
    along = (numbers if strategy_num in ("interpolar", "ffill") else []) + (texts if strategy_cat == "ffill" else [])
    if along:
        df = _neighbours(df, along, by)
        for k, c in enumerate(along):
            back, ahead = F.col(f"__b{k}"), F.col(f"__a{k}")
            if c in numbers and strategy_num == "interpolar":
                part = (F.col("__pos") - back["p"]) / F.nullif(ahead["p"] - back["p"], F.lit(0))
                between = back["v"].cast("double") + (ahead["v"].cast("double") - back["v"].cast("double")) * part
                new[c] = F.coalesce(N.q(c).cast("double"), between, back["v"].cast("double"), ahead["v"].cast("double"))
            else:
                new[c] = F.coalesce(N.q(c), back["v"], ahead["v"])
    out = _replace(df, new).select(*[N.q(c) for c in [*kept, *flags]])
    return knn_impute(out, numbers, knn_neighbors) if strategy_num == "knn" and numbers else out


def knn_impute(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """Mean of the ``k`` nearest rows that have the value, by distance over the columns both have.

    All rows are donors, dealt into blocks of space; a row meets the nearest block, then only those whose box lies within the distance of the
    ``k``-th it found there (``space.nearest``). The distance is scaled up by the share of columns that both have; of equally near
    ones the smaller values are taken. A row that shares no column with any donor gets the column's mean; a column without
    values stays null.
    """
    keys = [f"c{j}" for j in range(len(columns))]
    value_of = [P.to_float(N.q(c)) for c in columns]
    number = [F.when(~F.isnan(x), x).alias(key) for key, x in zip(keys, value_of, strict=True)]
    facts = df.select(*number)
    means = facts.agg(*[F.avg(c).alias(c) for c in keys]).first()
    present = sum((F.col(c).isNotNull().cast("int") for c in keys[1:]), F.col(keys[0]).isNotNull().cast("int"))
    donors = facts.filter(present > 0).groupBy(*keys).agg(F.count("*").alias("n"))
    queries = facts.filter((present > 0) & (present < len(keys))).distinct()

    def kernel(q, r):
        """Rows of a leaf have the same columns, so the distances of queries with the same columns need no look at what is missing."""
        out = []
        a, b, n = q[keys].to_numpy(dtype=float), r[keys].to_numpy(dtype=float), r["n"].to_numpy()
        has = np.isfinite(b[0])
        known = np.isfinite(a)
        for pattern in np.unique(known, axis=0):
            shared, lacking = np.flatnonzero(pattern & has), np.flatnonzero(~pattern & has)
            if not len(shared) or not len(lacking):
                continue
            own = a[(known == pattern).all(axis=1)]
            for v, i, at, far in X.closest(own[:, shared], b[:, shared], [b[:, j] for j in lacking], k, lambda d, m=len(shared): d * len(keys) / m):
                out.append((own, i, far, b[at, lacking[v]], n[at], {"j": np.int32(lacking[v])}))
        return X.lists(out, keys)

    def home(far, pdf, some):
        """For each value that a row lacks the nearest block that has it, with enough rows if there is one."""
        x = pdf[keys].to_numpy(dtype=float)
        chosen = np.zeros(far.shape, dtype=bool)
        filled, held = blocks.filled[some], blocks.held[some]
        for j in range(len(keys)):
            able = np.flatnonzero(filled[:, j] & (held >= k))
            able = able if len(able) else np.flatnonzero(filled[:, j])
            lacking = np.flatnonzero(~np.isfinite(x[:, j]))
            if len(able) and len(lacking):
                chosen[lacking, able[np.argmin(far[np.ix_(lacking, able)], axis=1)]] = True
        return chosen

    schema = ", ".join(f"{c} double" for c in keys) + ", j int, near array<struct<d:double,value:double,n:bigint>>"
    leaves = X.leaves_of(donors, keys, "n")
    blocks = leaves.boxes
    found = X.nearest(queries, leaves, kernel, schema, [*keys, "j"], k, home)
    top = found.groupBy(*keys, "j").agg(F.flatten(F.collect_list("near")).alias("near")).select(*keys, "j", B.nearest_of("near", k).alias("top"))
    total = lambda part: F.aggregate("top", F.lit(0.0), lambda s, e: s + part(e))
    value = total(lambda e: e["value"] * e["n"]) / F.nullif(total(lambda e: e["n"].cast("double")), F.lit(0.0))
    told = top.groupBy(*keys).agg(*[F.max(F.when(F.col("j") == j, value)).alias(f"__f{j}") for j in range(len(keys))])
    whole = df.withColumns({f"__{c}": x for c, x in zip(keys, number, strict=True)})
    on = reduce(lambda x, y: x & y, [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in keys])
    filled = {c: F.coalesce(F.col(f"__c{j}"), F.col(f"__f{j}"), F.lit(means[f"c{j}"])).cast("double") for j, c in enumerate(columns)}
    return whole.join(told.toDF(*keys, *[f"__f{j}" for j in range(len(keys))]), on, "left").select(*[filled[c].alias(c) if c in filled else N.q(c) for c in df.columns])


def drop_null_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropna(subset=[f"`{c}`" for c in _present(df, columns, N.data_columns(df))])


def outlier_bounds(df: DataFrame, columns: list[str], method: str = "iqr", factor: float = 1.5, lower_q: float = 0.01, upper_q: float = 0.99) -> dict[str, tuple]:
    """(low, high) for each column."""
    number = {c: P.to_float(N.q(c)) for c in columns}
    if method == "zscore":
        facts = AggFusion(df)
        for c, x in number.items():
            facts.want(c, F.struct(F.avg(x), F.stddev_pop(x)))
        found = facts.run() if columns else {}
    else:
        found = O.quantiles(df, {c: (x, (0.25, 0.75) if method == "iqr" else (lower_q, upper_q)) for c, x in number.items()})
    out = {}
    for c, (a, b) in found.items():
        if a is None or b is None:
            continue
        out[c] = (a - factor * (b - a), b + factor * (b - a)) if method == "iqr" else (a - factor * b, a + factor * b) if method == "zscore" else (a, b)
    return out


def outliers(df: DataFrame, columns: list[str] | None = None, method: str = "iqr", action: str = "winsorizar", factor: float = 1.5, lower_q: float = 0.01, upper_q: float = 0.99) -> DataFrame:
    """Values beyond bounds that are taken on the input: clipped (winsorizar), made null (nulo), or their rows dropped (eliminar)."""
    bounds = outlier_bounds(df, _present(df, columns, N.numeric_columns(df)), method, factor, lower_q, upper_q)
    if action == "eliminar":
        bad = F.lit(False)
        for c, (low, high) in bounds.items():
            bad = bad | F.coalesce((N.q(c) < low) | (N.q(c) > high), F.lit(False))
        return df.filter(~bad)
    new = {}
    for c, (low, high) in bounds.items():
        x = N.q(c)
        if action == "nulo":
            new[c] = F.when((x >= low) & (x <= high), x)
        else:
            new[c] = F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x.cast("double"))
    return _replace(df, new)


def filter_rows(df: DataFrame, query: str) -> DataFrame:
    return df.filter(translate(query, df.columns)) if query and query.strip() else df


def new_column(df: DataFrame, name: str, expression: str) -> DataFrame:
    return _replace(df, {name: translate(expression, df.columns)})


DATE_PARTS: dict[str, Callable[[Column], Column]] = {
    "anio": F.year, "mes": F.month, "dia": F.dayofmonth, "dia_semana": F.weekday, "semana": F.weekofyear, "trimestre": F.quarter, "hora": F.hour,
    "es_fin_semana": lambda c: F.coalesce((F.weekday(c) >= 5).cast("int"), F.lit(0)),
}


def date_features(df: DataFrame, columns: list[str] | None = None, parts: list[str] | None = None, drop_original: bool = False) -> DataFrame:
    chosen = _present(df, columns, N.datetime_columns(df))
    date = {c: N.q(c) if N.is_datetime(df, c) else P.parse_datetime(N.q(c)) for c in chosen}
    new = {f"{c}_{p}": DATE_PARTS[p](date[c]).cast("long") for c in chosen for p in (parts or ["anio", "mes", "dia", "dia_semana"])}
    out = _replace(df, new)
    return out.drop(*chosen) if drop_original else out


def group_rare(df: DataFrame, columns: list[str] | None = None, min_freq_pct: float = 1.0, other_label: str = "OTROS") -> DataFrame:
    """Values under ``min_freq_pct`` percent of the non-null rows become one. The frequent ones are few (100 / min_freq_pct at most)."""
    chosen = _present(df, columns, N.text_columns(df))
    counts = AggFusion(df)
    for c in chosen:
        counts.want(c, F.count(N.q(c)))
    totals = counts.run() if chosen else {}
    new = {}
    for c in chosen:
        often = df.groupBy(N.q(c).cast("string").alias("v")).count().filter("v is not null")
        often = [r["v"] for r in often.filter(100 * F.col("count") / max(totals[c], 1) >= min_freq_pct).select("v").collect()]
        new[c] = F.when(N.q(c).isNull() | N.q(c).cast("string").isin(often), N.q(c)).otherwise(F.lit(other_label))
    return _replace(df, new)


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, lam) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, 2 - lam) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_lambda(df: DataFrame, column: str, low: float = -3.0, high: float = 5.0, passes: int = 4, points: int = 17) -> float:
    """The likeliest exponent: a grid of exponents is judged in one pass, then a finer one around the best, and so on."""
    x = P.to_float(N.q(column))
    for _ in range(passes):
        grid = [low + (high - low) * k / (points - 1) for k in range(points)]
        row = df.agg(F.count(x).alias("n"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("s"), *[F.var_pop(yeo_johnson(x, g)).alias(f"v{k}") for k, g in enumerate(grid)]).first()
        if not row["n"]:
            return 1.0
        fit = [-row["n"] / 2 * math.log(row[f"v{k}"]) + (g - 1) * row["s"] if row[f"v{k}"] and row[f"v{k}"] > 0 else -math.inf for k, g in enumerate(grid)]
        best = max(range(points), key=lambda k: fit[k])
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, points - 1)]
    return (low + high) / 2


def transform_numeric(df: DataFrame, columns: list[str] | None = None, method: str = "log1p") -> DataFrame:
    chosen = _present(df, columns, N.numeric_columns(df))
    facts = AggFusion(df)
    for c in chosen:
        x = P.to_float(N.q(c))
        facts.want(c, F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd")))
    got = {c: r.asDict() for c, r in (facts.run() if chosen else {}).items()}
    if method not in ("log1p", "sqrt", "zscore", "minmax"):
        for c, (mid,) in O.quantiles(df, {c: (P.to_float(N.q(c)), (0.5,)) for c in chosen}).items():
            got[c]["mid"] = mid
    new = {}
    for c in chosen:
        r, x = got[c], P.to_float(N.q(c))
        if r["lo"] is None:
            continue
        if method in ("log1p", "sqrt"):
            moved = x - min(0.0, r["lo"])
            new[c] = F.log1p(moved) if method == "log1p" else F.sqrt(moved)
        elif method == "zscore":
            new[c] = (x - r["mean"]) / (r["sd"] or 1.0)
        elif method == "minmax":
            new[c] = (x - r["lo"]) / ((r["hi"] - r["lo"]) or 1.0)
        else:
            full = df.select(F.coalesce(x, F.lit(r["mid"])).alias(c))
            y = yeo_johnson(F.coalesce(x, F.lit(r["mid"])), yeo_johnson_lambda(full, c))
            m = df.agg(F.avg(y).alias("m"), F.stddev_pop(y).alias("s")).first()
            new[c] = (y - m["m"]) / (m["s"] or 1.0)
    return _replace(df, new)


def bin_edges(df: DataFrame, column: str, bins: int, method: str) -> list[float]:
    x = P.to_float(N.q(column))
    if method == "cuantiles":
        edges = O.quantiles(df, {0: (x, [k / bins for k in range(bins + 1)])})[0]
        return sorted({e for e in edges if e is not None})
    row = df.agg(F.min(x), F.max(x)).first()
    if row[0] is None:
        return []
    low, high = row
    if low == high:
        low, high = low - 0.001 * abs(low or 1), high + 0.001 * abs(high or 1)
        return [low + (high - low) * k / bins for k in range(bins + 1)]
    edges = [low + (high - low) * k / bins for k in range(bins + 1)]
    edges[0] -= 0.001 * (high - low)
    return edges


def _shown(v: float) -> str:
    text = f"{v:.3g}" if abs(v) < 1000 and not float(v).is_integer() else f"{v:.1f}" if float(v).is_integer() else f"{v:.3f}".rstrip("0")
    return text


def binning(df: DataFrame, column: str, bins: int = 5, method: str = "cuantiles", labels: list[str] | None = None, new_name: str | None = None) -> DataFrame:
    """Right-closed intervals by quantiles or of equal width, as text; the lowest value belongs to the first."""
    edges = bin_edges(df, column, bins, method)
    x = P.to_float(N.q(column))
    out = F.lit(None).cast("string")
    first = edges[0] - 0.001 if edges and method == "cuantiles" else edges[0] if edges else 0.0
    shown = [first, *edges[1:]]
    for k in reversed(range(len(edges) - 1)):
        label = labels[k] if labels and len(labels) == len(edges) - 1 else f"({_shown(shown[k])}, {_shown(shown[k + 1])}]"
        inside = (x > edges[k]) & (x <= edges[k + 1]) if k else (x >= edges[0]) & (x <= edges[1])
        out = F.when(inside, F.lit(label)).otherwise(out)
    return _replace(df, {new_name or f"{column}_bin": out})


def sample(df: DataFrame, n: int | None = None, frac: float | None = None, random_state: int = 42, key: list[str] | None = None) -> DataFrame:
    """A sample of exact size without replacement, in shuffled order; rows are ranked by a hash of ``key`` (of their place by default)."""
    if n is None:
        n = round((frac if frac is not None else 1.0) * df.count())
    by = key or ([N.ROW_ID] if N.ROW_ID in df.columns else ["__place"])
    placed = df.withColumn("__place", F.monotonically_increasing_id())  # equal rows are drawn one by one
    return placed.orderBy(F.xxhash64(F.lit(random_state), *[N.q(c) for c in by]), *[N.q(c) for c in by], "__place").limit(n).drop("__place")


OPERATIONS: dict[str, Callable[..., DataFrame]] = {
    "eliminar_columnas": drop_columns, "renombrar": rename, "normalizar_nombres": normalize_column_names, "eliminar_duplicados": drop_duplicates,
    "eliminar_filas_vacias": drop_empty_rows, "convertir_tipos": convert_types, "limpiar_texto": clean_text, "vacios_a_nulos": blanks_to_null,
    "imputar": impute, "eliminar_filas_nulas": drop_null_rows, "outliers": outliers, "filtrar": filter_rows, "nueva_columna": new_column,
    "features_fecha": date_features, "agrupar_raras": group_rare, "transformar_numerica": transform_numeric, "discretizar": binning, "muestrear": sample,
}
#: Operations whose plan is a projection or a filter alone: these also run on streams.
STATELESS = {"eliminar_columnas", "renombrar", "normalizar_nombres", "eliminar_filas_vacias", "limpiar_texto", "vacios_a_nulos", "eliminar_filas_nulas", "filtrar", "nueva_columna", "features_fecha"}


def _short(params: dict, limit: int = 90) -> str:
    text = json.dumps(params, ensure_ascii=False, default=str)
    return text if len(text) <= limit else text[: limit - 1] + "…"


def apply_recipe(df: DataFrame, recipe: list[dict], log_counts: bool = False) -> tuple[DataFrame, list[dict]]:
    """Folds the steps over the table; a step that can't be planned is logged and skipped.

    Row counts before and after cost a job a step, so they are only taken with ``log_counts``.
    """
    log, out = [], df
    count = lambda d: d.count() if log_counts else None
    rows = count(df)
    for k, step in enumerate(recipe, 1):
        name, params = step.get("op"), {p: v for p, v in step.items() if p != "op"}
        before, columns = rows, len(N.data_columns(out))
        status, detail = "ok", _short(params)
        try:
            if name not in OPERATIONS:
                raise KeyError(f"operación desconocida: {name}")
            done = OPERATIONS[name](out, **params)
            done.schema  # noqa: B018  analysis errors surface here
            rows = count(done) if log_counts else None
            out = done
        except Exception as e:  # the log carries it, as the recipe's contract says
            status, detail = "error", str(e).splitlines()[0][:200]
        log.append({"paso": k, "operacion": name, "estado": status, "filas_antes": before, "filas_despues": rows, "cols_antes": columns, "cols_despues": len(N.data_columns(out)), "detalle": detail})
    return out, log


def recipe_to_code(recipe: list[dict], var: str = "df") -> str:
    lines = ["from lumenframe.operators.recipe import OPERATIONS", ""]
    for step in recipe:
        args = "".join(f", {p}={v!r}" for p, v in step.items() if p != "op")
        lines.append(f"{var} = OPERATIONS[{step['op']!r}]({var}{args})")
    return "\n".join(lines)


def auto_recipe(df: DataFrame, order: list[str] | None = None) -> list[dict]:
    """A recipe that mends what the diagnostics find."""
    d = dataset_diagnostics(df, order)
    recipe: list[dict] = [{"op": "vacios_a_nulos"}]
    if d["filas_vacias"]:
        recipe.append({"op": "eliminar_filas_vacias"})
    if d["filas_duplicadas"]:
        recipe.append({"op": "eliminar_duplicados"})
    gone = sorted({*d["columnas_constantes"], *[c for g in d["columnas_duplicadas"] for c in g[1:]], *d["columnas_50_nulos"]})
    if gone:
        recipe.append({"op": "eliminar_columnas", "columns": gone})
    change = {c: t for c, t in d["convertibles"].items() if c not in gone and d["roles"][c] == "texto"}
    if change:
        recipe.append({"op": "convertir_tipos", "mapping": change})
    recipe.append({"op": "limpiar_texto"})
    recipe.append({"op": "imputar", "strategy_num": "mediana", "strategy_cat": "moda"})
    return recipe


def parameters(name: str) -> dict:
    """The parameters of an operation and their defaults."""
    return {p.name: None if p.default is p.empty else p.default for p in list(inspect.signature(OPERATIONS[name]).parameters.values())[1:]}


def downcast(df: DataFrame) -> DataFrame:
    """Narrowest numeric types that hold the values, from one pass of minima and maxima."""
    whole = [c for c in N.data_columns(df) if N.is_integer(df, c)]
    facts = AggFusion(df)
    for c in whole:
        facts.want(c, F.struct(F.min(N.q(c)).alias("lo"), F.max(N.q(c)).alias("hi")))
    new = {}
    for c, r in (facts.run() if whole else {}).items():
        if r["lo"] is not None:
            new[c] = N.q(c).cast(next(t for t, b in (("byte", 7), ("short", 15), ("int", 31), ("long", 63)) if -(1 << b) <= r["lo"] and r["hi"] < 1 << b))
    new |= {c: N.q(c).cast("float") for c, t in df.dtypes if t == "double"}
    return _replace(df, new)
