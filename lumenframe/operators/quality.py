"""Column profiles, dataset diagnostics, the quality score and its findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import parsing as P
from ..functions import stats as S
from ..plans import order as O
from ..plans.fusion import AggFusion, stacked
from ..sources import workspace
from .roles import roles_with

WEIGHTS = {"completitud": 0.35, "unicidad": 0.25, "consistencia": 0.20, "validez": 0.20}
LEVELS = ((90, "Excelente"), (75, "Buena"), (60, "Aceptable"), (40, "Deficiente"))
MIXED_PROBE, MIXED_LOW, MIXED_HIGH = 1000, 0.15, 0.85
SEVERITY = {"Crítica": 0, "Alta": 1, "Media": 2, "Baja": 3, "Info": 4}


def column_profile_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Numeric profile, one row a column: bounds by 1.5 times the quartile range, population deviation.

    Moments come from one pass, quartiles and distinct values from others; counts outside the bounds need them, so from a last one.
    """
    columns = columns or N.numeric_columns(df)
    number = lambda c: P.to_float(N.q(c))
    first = {
        "filas": ("long", lambda c: F.count("*")),
        "n": ("long", lambda c: F.count(number(c))),
        "min": ("double", lambda c: F.min(number(c))),
        "media": ("double", lambda c: F.avg(number(c))),
        "max": ("double", lambda c: F.max(number(c))),
        "desv_std": ("double", lambda c: F.stddev_pop(number(c))),
        "asimetria": ("double", lambda c: S.skewness(number(c))),
        "curtosis": ("double", lambda c: S.kurtosis(number(c))),
        "ceros": ("long", lambda c: F.count_if(number(c) == 0)),
        "negativos": ("long", lambda c: F.count_if(number(c) < 0)),
    }
    base = stacked(df, columns, {k: f for k, (_, f) in first.items()}, {k: t for k, (t, _) in first.items()})
    cuts = O.quantiles(df, {c: (number(c), (0.25, 0.5, 0.75)) for c in columns})
    kinds = O.distinct_counts(df, {c: number(c) for c in columns})
    facts = {r["variable"]: {**r.asDict(), "unicos": kinds[r["variable"]], **dict(zip(("p25", "mediana", "p75"), cuts[r["variable"]], strict=True))} for r in base.collect()}  # a row a column

    def outside(c: str) -> Column:
        r = facts[c]
        if r["p25"] is None:
            return F.sum(F.lit(0))
        reach = 1.5 * (r["p75"] - r["p25"])
        return F.count_if((number(c) < r["p25"] - reach) | (number(c) > r["p75"] + reach))

    def beyond(c: str) -> Column:
        r = facts[c]
        return F.count_if(F.abs((number(c) - r["media"]) / r["desv_std"]) > 3) if r["desv_std"] else F.sum(F.lit(0))

    tails = stacked(df, columns, {"outliers_iqr": outside, "outliers_z3": beyond}, {"outliers_iqr": "long", "outliers_z3": "long"})
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema] + ["unicos long", "p25 double", "mediana double", "p75 double"])
    known = df.sparkSession.createDataFrame([tuple(r.values()) for r in facts.values()], schema)
    n = F.col("filas")
    return known.join(tails, "variable").select(
        "variable", (n - F.col("n")).alias("nulos"), S.percent(n - F.col("n"), n).alias("%_nulos"), S.percent(F.col("n"), n).alias("completitud_%"),
        "unicos", S.percent(F.col("unicos"), n).alias("%_unicos"), F.greatest(F.col("n") - F.col("unicos"), F.lit(0)).alias("valores_repetidos"),
        (F.col("unicos") <= 1).alias("constante"), "min", "p25", "mediana", "media", "p75", "max", "desv_std",
        (100 * S.ratio(F.col("desv_std"), F.abs("media"))).alias("cv_%"), "asimetria", "curtosis", "ceros", "negativos",
        "outliers_iqr", S.percent(F.col("outliers_iqr"), n).alias("%_outliers"), "outliers_z3",
    )


def column_profile_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Profile of text columns: blanks, mode, lengths, stray spaces, and values that differ by case or space only."""
    columns = columns or N.text_columns(df)
    folded = lambda c: F.lower(P.stripped(N.q(c)))
    wanted = {
        "filas": ("long", lambda c: F.count("*")),
        "n": ("long", lambda c: F.count(N.q(c))),
        "vacios_texto": ("long", lambda c: F.count_if(P.is_blank(N.q(c)))),
        "long_min": ("long", lambda c: F.min(F.char_length(N.q(c)))),
        "long_max": ("long", lambda c: F.max(F.char_length(N.q(c)))),
        "espacios_sobrantes": ("long", lambda c: F.count_if(N.q(c) != P.stripped(N.q(c)))),
    }
    base = stacked(df, columns, {k: f for k, (_, f) in wanted.items()}, {k: t for k, (t, _) in wanted.items()})
    tops = O.tallies(df, {c: N.q(c) for c in columns}, "string")
    alike = O.distinct_counts(df, {c: folded(c) for c in columns})
    rows = [(c, tops[c][0], alike[c], tops[c][1], tops[c][2] if tops[c][0] else None) for c in columns]
    n = F.col("filas")
    joined = base.join(F.broadcast(df.sparkSession.createDataFrame(rows, "variable string, unicos long, distintos_sin_caja long, moda string, frec_moda long")), "variable")  # a row a column
    return joined.select(
        "variable", (n - F.col("n")).alias("nulos"), S.percent(n - F.col("n"), n).alias("%_nulos"), "vacios_texto",
        S.percent(F.col("vacios_texto"), n).alias("%_vacios"), S.percent(F.col("n") - F.col("vacios_texto"), n).alias("completitud_%"),
        "unicos", S.percent(F.col("unicos"), n).alias("%_unicos"), F.greatest(F.col("n") - F.col("unicos"), F.lit(0)).alias("valores_repetidos"),
        (F.col("unicos") <= 1).alias("constante"), "moda", "frec_moda", S.percent(F.col("frec_moda"), n).alias("%_moda"),
        "long_min", "long_max", "espacios_sobrantes", (F.col("unicos") - F.col("distintos_sin_caja")).alias("may_min_inconsistente"),
    )


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent non-null values; ties by value."""
    value = N.q(column).cast("string")
    return df.select(value.alias("valor")).filter("valor is not null").groupBy("valor").agg(F.count("*").alias("frecuencia")).orderBy(F.desc("frecuencia"), "valor").limit(k)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Copies beyond the first of each row, nulls being equal: one row (filas, duplicados)."""
    rows = df.select(O.hashed(*[N.q(c) if not N.is_nested(df, c) else F.to_json(F.struct(N.q(c))) for c in N.data_columns(df)]).alias("v"))
    copies = rows.groupBy("v.h", "v.g").agg(F.count("*").alias("n"))
    return copies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("filas"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicados"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once, with its count."""
    per_key = df.groupBy(*[N.q(k) for k in keys]).agg(F.count("*").alias("copias")).filter("copias > 1")
    left, right = df.alias("l"), per_key.alias("r")
    return left.join(right, [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys]).select("l.*", "copias")


def _text(df: DataFrame, c: str) -> Column:
    return N.q(c).cast("string") if not N.is_nested(df, c) else F.to_json(F.struct(N.q(c)))


def identical_columns(df: DataFrame, facts: dict[str, tuple[int, int]] | None = None) -> list[list[str]]:
    """Groups of columns equal in every row. Candidates by a sum of hashes, each then confirmed row by row.

    An order-insensitive digest alone would also group a column with a permutation of itself; that is not done here.
    ``facts`` (nulls, distinct values) by column, where known, spare columns that differ in them the hashing.
    """
    columns = N.data_columns(df)
    text = lambda c: _text(df, c)
    # as text, numbers with a point may have one value more: -0.0
    loose = lambda a, b: int(df.schema[a].dataType.typeName() in ("float", "double") or df.schema[b].dataType.typeName() in ("float", "double"))
    alike = lambda a, b: facts is None or facts[a][0] == facts[b][0] and abs(facts[a][1] - facts[b][1]) <= loose(a, b)
    columns = [a for a in columns if any(a != b and alike(a, b) for b in columns)]
    sums = AggFusion(df)
    for c in columns:
        h = F.xxhash64(text(c))
        sums.want(c, F.struct(F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)))
    found = sums.run() if columns else {}
    by_sum: dict = {}
    for c in columns:
        by_sum.setdefault(tuple(found[c]), []).append(c)
    pairs = AggFusion(df)
    for group in by_sum.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                pairs.want((a, b), F.count_if(~text(a).eqNullSafe(text(b))))
    differ = pairs.run() if pairs.wanted else {}
    out = []
    for group in by_sum.values():
        rest = list(group)
        while rest:
            head, same = rest[0], [rest[0]]
            same += [b for b in rest[1:] if differ[head, b] == 0]
            rest = [c for c in rest if c not in same]
            if len(same) > 1:
                out.append(same)
    return out


def number_share(c: str) -> Column:
    """The share of a text column's values that read as numbers; null without values."""
    text = F.replace(P.stripped(N.q(c)), F.lit(","), F.lit("."))
    # a cast that fails is dear, and most words can't be numbers: the first sign tells
    number = F.when(F.instr(F.lit("0123456789+-.iInN"), F.substring(text, 1, 1)) > 0, text.try_cast("double"))
    return F.avg(F.when(N.q(c).isNotNull(), number.isNotNull().cast("int")))


def mixed_type_columns(df: DataFrame, order: list[str] | None = None) -> list[str]:
    """Text columns of whose values a part, but not nearly all, reads as numbers; of the first values only, if ``order`` says which those are."""
    out, columns = [], N.text_columns(df)
    if not order:
        facts = AggFusion(df)
        for c in columns:
            facts.want(c, number_share(c))
        return _mixed(facts.run() if columns else {})
    for c in columns:
        share = df.filter(N.q(c).isNotNull()).orderBy(*order).limit(MIXED_PROBE).agg(number_share(c)).first()[0]
        out += _mixed({c: share})
    return out


def _mixed(shares: dict[str, float | None]) -> list[str]:
    return [c for c, share in shares.items() if share is not None and MIXED_LOW < share < MIXED_HIGH]


def dataset_diagnostics(df: DataFrame, order: list[str] | None = None) -> dict:
    """Rows, columns, missing and blank cells, copies, and columns that need attention."""
    columns = N.data_columns(df)
    facts: dict = {"n": F.count("*")}  # one pass for all of them, with what the roles need
    gap = {c: (P.to_float(N.q(c)) if N.is_numeric(df, c) else N.q(c)).isNull() for c in columns}
    for c in columns:
        facts[c, "null"] = F.count_if(gap[c])
        if N.is_text(df, c):
            facts[c, "blank"] = F.count_if(P.is_blank(N.q(c)))
            if not order:
                facts[c, "numbers"] = number_share(c)
    every = None
    for c in columns:
        every = gap[c] if every is None else every & gap[c]
    facts["empty"] = F.count_if(every) if every is not None else F.sum(F.lit(0))
    roles, got = roles_with(df, facts)
    n, m = got["n"], len(columns)
    nulls = sum(got[c, "null"] for c in columns)
    blanks = sum(got.get((c, "blank"), 0) for c in columns)
    copies = duplicate_rows(df).first()["duplicados"] if columns else 0
    cells = n * m
    return {
        "filas": n, "columnas": m, "celdas": cells, "celdas_nulas": nulls, "%_celdas_nulas": 100 * nulls / cells if cells else 0.0,
        "celdas_vacias": blanks, "filas_duplicadas": copies, "%_filas_duplicadas": 100 * copies / n if n else 0.0, "filas_vacias": got["empty"] or 0,
        "columnas_duplicadas": identical_columns(df, {c: (got[c, "null"], roles[c].distinct) for c in columns}), "columnas_constantes": [c for c, r in roles.items() if r.role == "constante"],
        "columnas_id": [c for c, r in roles.items() if r.role == "id"],
        "columnas_50_nulos": [c for c in columns if n and got[c, "null"] / n >= 0.5], "columnas_mixtas": mixed_type_columns(df, order) if order else _mixed({c: got[c, "numbers"] for c in columns if N.is_text(df, c)}),
        "convertibles": {c: r.convertible_to for c, r in roles.items() if r.convertible_to}, "roles": {c: r.role for c, r in roles.items()},
        "nulos_por_columna": {c: got[c, "null"] for c in columns},
    }


def far_outside_share(df: DataFrame, counts: dict[str, int] | None = None) -> float:
    """Mean over numeric columns of the percentage beyond three quartile ranges; columns under five values or without range don't count.

    ``counts``: values by column, if a pass has taken them already.
    """
    columns = N.numeric_columns(df)
    number = {c: P.to_float(N.q(c)) for c in columns}
    if counts is None:
        first = AggFusion(df)
        for c in columns:
            first.want(c, F.count(number[c]))
        counts = first.run() if columns else {}
    cuts = O.quantiles(df, {c: (number[c], (0.25, 0.75)) for c in columns})
    facts = {c: {"n": counts[c], "lo": cuts[c][0], "hi": cuts[c][1]} for c in columns}
    second = AggFusion(df)
    for c, r in facts.items():
        if r["n"] >= 5 and r["hi"] > r["lo"]:
            reach = 3 * (r["hi"] - r["lo"])
            second.want(c, F.count_if((number[c] < r["lo"] - reach) | (number[c] > r["hi"] + reach)))
    tails = second.run() if second.wanted else {}
    return sum(100 * v / facts[c]["n"] for c, v in tails.items()) / len(tails) if tails else 0.0


def level(score: float) -> str:
    return next((name for least, name in LEVELS if score >= least), "Crítica")


def quality_score(df: DataFrame, diagnostics: dict | None = None) -> dict:
    """0 to 100: completeness, uniqueness, consistency and validity, weighted."""
    d = diagnostics or dataset_diagnostics(df)
    m, cells = max(d["columnas"], 1), max(d["celdas"], 1)
    parts = {
        "completitud": min(100.0, max(0.0, 100 - d["%_celdas_nulas"] - 100 * d["celdas_vacias"] / cells)),
        "unicidad": min(100.0, max(0.0, 100 - d["%_filas_duplicadas"] - 100 * len(d["columnas_duplicadas"]) / m)),
        "consistencia": max(0.0, 100 - 100 * len(d["columnas_constantes"]) / m - 100 * len(d["columnas_mixtas"]) / m),
        "validez": max(0.0, 100 - 3 * far_outside_share(df, {c: d["filas"] - k for c, k in d["nulos_por_columna"].items()})),
    }
    total = sum(WEIGHTS[k] * v for k, v in parts.items())
    return {"score_total": total, **parts, "nivel": level(total)}


def quality_findings(df: DataFrame, diagnostics: dict | None = None) -> list[dict]:
    """What is wrong, most severe first, with what to do about it."""
    d = diagnostics or dataset_diagnostics(df)
    found: list[tuple[str, str, str, str]] = []
    add = lambda *x: found.append(x)
    if d["columnas_50_nulos"]:
        add("Crítica", "Columnas con 50 % de nulos o más", ", ".join(d["columnas_50_nulos"]), "Eliminar o investigar el origen")
    if d["filas_duplicadas"]:
        severity = "Alta" if d["%_filas_duplicadas"] > 5 else "Media"
        add(severity, "Filas duplicadas", f"{d['filas_duplicadas']} copias", "Eliminar duplicados")
    if d["columnas_duplicadas"]:
        add("Alta", "Columnas idénticas", "; ".join(" = ".join(g) for g in d["columnas_duplicadas"]), "Conservar una de cada grupo")
    if d["columnas_constantes"]:
        add("Media", "Columnas constantes", ", ".join(d["columnas_constantes"]), "Eliminar")
    if d["columnas_mixtas"]:
        add("Alta", "Columnas con tipos mezclados", ", ".join(d["columnas_mixtas"]), "Unificar el tipo")
    if d["convertibles"]:
        add("Media", "Columnas de texto convertibles", ", ".join(f"{c} a {t}" for c, t in d["convertibles"].items()), "Convertir el tipo")
    if d["celdas_vacias"]:
        add("Media", "Textos vacíos o de relleno", f"{d['celdas_vacias']} celdas", "Pasar a nulo")
    if d["filas_vacias"]:
        add("Alta", "Filas vacías", f"{d['filas_vacias']} filas", "Eliminar filas vacías")
    if d["columnas_id"]:
        add("Baja", "Identificadores", ", ".join(d["columnas_id"]), "Excluir del modelo")
    if not found:
        add("Info", "Sin hallazgos", "No se detectaron problemas", "Continuar")
    keys = ("severidad", "hallazgo", "detalle", "accion_sugerida")
    return [dict(zip(keys, f, strict=True)) for f in sorted(found, key=lambda f: SEVERITY[f[0]])]


def row_alert(profile: dict) -> str:
    """Flags of one profile row, joined."""
    flags = []
    if profile.get("constante"):
        flags.append("CONSTANTE")
    if (profile.get("%_nulos") or 0) >= 50:
        flags.append("NULOS ALTOS")
    elif (profile.get("%_nulos") or 0) > 5:
        flags.append("NULOS")
    if (profile.get("%_vacios") or 0) > 0:
        flags.append("VACIOS")
    if (profile.get("%_outliers") or 0) > 5:
        flags.append("OUTLIERS")
    if abs(profile.get("asimetria") or 0) > 2:
        flags.append("ASIMETRIA")
    if profile.get("espacios_sobrantes"):
        flags.append("ESPACIOS")
    if profile.get("may_min_inconsistente"):
        flags.append("MAYUSCULAS")
    if profile.get("rol") == "categorica" and (profile.get("unicos") or 0) > 50:
        flags.append("ALTA CARDINALIDAD")
    return " | ".join(flags) or "OK"


def missing_matrix(df: DataFrame, order: list[str], most: int = 500) -> DataFrame:
    """Null flags of about ``most`` evenly spaced rows. ``order`` must be unique; positions are found without a global sort."""
    n = df.count()
    step = max(1, n // most)
    placed = with_position(df, order)
    return placed.filter(F.pmod(F.col("__pos"), F.lit(step)) == 0).select(F.col("__pos").alias("posicion"), *[N.q(c).isNull().cast("int").alias(c) for c in N.data_columns(df)])


def with_position(df: DataFrame, order: list[str]) -> DataFrame:
    """``__pos``, the 0-based position in ``order``: ranges are sorted apart and shifted by the counts before them."""
    # written, so that both uses see the same ranges, whatever is lost meanwhile
    ranged = workspace.keep(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id()), "ranges")
    inside = W.partitionBy("__part").orderBy(*order)
    numbered = ranged.withColumn("__in", F.row_number().over(inside))
    sizes = numbered.groupBy("__part").agg(F.count("*").alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return numbered.join(F.broadcast(offsets), "__part").withColumn("__pos", F.col("__off") + F.col("__in") - 1).drop("__part", "__in", "__off")


def missing_correlation(df: DataFrame) -> DataFrame:
    """Correlation of the null flags of columns that have nulls: (variable_1, variable_2, correlacion); empty under two such columns."""
    columns = N.data_columns(df)
    counts = AggFusion(df)
    for c in columns:
        counts.want(c, F.struct(F.count_if(N.q(c).isNull()).alias("k"), F.count("*").alias("n")))
    got = counts.run() if columns else {}
    some = [c for c, r in got.items() if 0 < r["k"]]
    flags = {c: N.q(c).isNull().cast("double") for c in some}
    pairs = [(a, b) for a in some for b in some]
    schema = "variable_1 string, variable_2 string, correlacion double"
    if len(some) < 2:
        return df.sparkSession.createDataFrame([], schema)
    rows = F.array(*[F.struct(F.lit(a).alias("variable_1"), F.lit(b).alias("variable_2"), F.corr(flags[a], flags[b]).alias("correlacion")) for a, b in pairs])
    return df.agg(rows.alias("r")).select(F.inline("r"))
