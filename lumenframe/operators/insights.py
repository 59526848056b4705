"""From results to words and decisions: findings, actions, what-if tables and segment advice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as N
from ..functions import parsing as P
from ..functions import stats as S
from ..plans import order as O
from . import eda, quality

SCENARIOS_MOST = 4_000
PRIORITY = {"Alta": 0, "Media": 1, "Baja": 2}


def descriptive_report(df: DataFrame, target: str | None = None) -> list[str]:
    """Plain statements about size, quality, shape, balance and association."""
    d = quality.dataset_diagnostics(df)
    score = quality.quality_score(df, d)
    lines = [f"La tabla tiene {d['filas']:,} filas y {d['columnas']} columnas; su calidad es {score['nivel']} ({score['score_total']:.1f}/100)."]
    if d["filas"] < 100:
        lines.append("Hay menos de 100 filas: las conclusiones son tentativas.")
    elif d["filas"] < 1000:
        lines.append("Hay menos de 1.000 filas: conviene validar con más datos.")
    if d["celdas_nulas"]:
        worst = max(d["nulos_por_columna"], key=d["nulos_por_columna"].get)
        lines.append(f"Falta el {d['%_celdas_nulas']:.1f} % de las celdas; la columna con más nulos es {worst}.")
    if N.numeric_columns(df):
        for r in eda.describe_numeric(df).collect():
            if abs(r["asimetria"] or 0) > 1.5:
                lines.append(f"{r['variable']} es muy asimétrica ({r['asimetria']:.2f}).")
            if (r["cv_%"] or 0) > 150:
                lines.append(f"{r['variable']} varía mucho (CV {r['cv_%']:.0f} %).")
    for c in N.text_columns(df):
        r = eda.describe_categorical(df, [c]).first()
        if (r["%_moda"] or 0) > 90:
            lines.append(f"{c} está dominada por «{r['moda']}» ({r['%_moda']:.0f} %).")
        if r["categorias"] > 50:
            lines.append(f"{c} tiene {r['categorias']} valores distintos.")
    if target and not N.is_numeric(df, target):
        least = eda.class_balance(df, target).agg(F.min("%")).first()[0]
        if least is not None and least < 10:
            lines.append(f"La clase menor de {target} es solo el {least:.1f} %.")
    return lines


def _action(priority, area, action, why, impact, how) -> dict:
    return {"prioridad": priority, "area": area, "accion": action, "por_que": why, "impacto_esperado": impact, "como_hacerlo": how}


def prescriptive_actions(score: float | None = None, rows: int | None = None, metric: float | None = None, baseline: float | None = None, overfit: float | None = None,
                         simple_metric: float | None = None, tuned: bool = True, threshold: float | None = None, needed_features: int | None = None, n_features: int | None = None,
                         weak_features: int = 0, silhouette: float | None = None, noise_pct: float | None = None) -> list[dict]:
    """Actions that the measurements call for, most pressing first, each once."""
    out = []
    if score is not None and score < 70:
        out.append(_action("Alta", "Datos", "Mejorar la calidad de los datos", f"El puntaje es {score:.0f}/100", "Modelos más fiables", "Aplicar la receta automática"))
    if rows is not None and rows < 500:
        out.append(_action("Alta", "Datos", "Reunir más filas", f"Solo hay {rows}", "Estimaciones estables", "Ampliar el periodo o las fuentes"))
    if metric is not None and baseline is not None and metric - baseline <= 0.02:
        out.append(_action("Alta", "Modelo", "Revisar las variables", "El modelo apenas supera al de referencia", "Señal real", "Crear variables o cambiar el objetivo"))
    if overfit is not None and overfit > 0.10:
        out.append(_action("Alta", "Modelo", "Reducir el sobreajuste", f"La brecha es {overfit:.2f}", "Mejor generalización", "Regularizar, podar o usar más datos"))
    if metric is not None:
        if metric > 0.98:
            out.append(_action("Alta", "Modelo", "Buscar fuga de información", "El resultado es casi perfecto", "Evitar un modelo inútil en producción", "Revisar variables posteriores al objetivo"))
        elif metric < 0.50:
            out.append(_action("Alta", "Modelo", "No usar aún el modelo", f"La métrica es {metric:.2f}", "Evitar malas decisiones", "Volver a los datos"))
        elif metric < 0.70:
            out.append(_action("Media", "Modelo", "Mejorar el modelo", f"La métrica es {metric:.2f}", "Más precisión", "Probar más algoritmos y variables"))
    if metric is not None and simple_metric is not None and metric - simple_metric <= 0.02:
        out.append(_action("Baja", "Modelo", "Preferir el modelo simple", "Rinde casi igual", "Más fácil de explicar", "Elegir el modelo lineal"))
    if not tuned:
        out.append(_action("Media", "Modelo", "Ajustar hiperparámetros", "No se han ajustado", "Unos puntos más", "Activar la búsqueda aleatoria"))
    if threshold is not None and abs(threshold - 0.5) > 0.05:
        out.append(_action("Media", "Decisión", "Cambiar el umbral", f"El mejor umbral es {threshold:.2f}", "Mejor equilibrio", "Usar el umbral de mayor F1"))
    if needed_features and n_features and needed_features < n_features:
        out.append(_action("Baja", "Variables", "Simplificar las variables", f"{needed_features} explican el 80 %", "Modelo más ligero", "Conservar las principales"))
    if weak_features >= 3:
        out.append(_action("Baja", "Variables", "Quitar variables sin aporte", f"{weak_features} aportan menos del 0,5 %", "Menos ruido", "Eliminarlas y reentrenar"))
    if silhouette is not None and silhouette < 0.25:
        out.append(_action("Media", "Segmentos", "Revisar los segmentos", f"La silueta es {silhouette:.2f}", "Grupos más claros", "Cambiar k, variables o algoritmo"))
    if noise_pct is not None and noise_pct > 20:
        out.append(_action("Media", "Segmentos", "Reducir el ruido", f"El {noise_pct:.0f} % queda sin grupo", "Más cobertura", "Aumentar eps o bajar min_samples"))
    seen: set[str] = set()
    once = [a for a in out if not (a["accion"] in seen or seen.add(a["accion"]))]
    return sorted(once, key=lambda a: PRIORITY[a["prioridad"]])


def executive_summary(report: list[str], actions: list[dict], best_model: str | None = None, metric: float | None = None) -> str:
    parts = [report[0]] if report else []
    if best_model:
        parts.append(f"El mejor modelo es {best_model}" + (f", con {metric:.3f}." if metric is not None else "."))
    if actions:
        parts.append("Lo primero: " + "; ".join(a["accion"].lower() for a in actions[:3]) + ".")
    return " ".join(parts)


# --- what if ----------------------------------------------------------------------------------


def base_scenario(df: DataFrame, features: list[str]) -> dict:
    """Median or mode of each column."""
    middle = O.quantiles(df, {c: (P.to_float(N.q(c)), (0.5,)) for c in features if N.is_numeric(df, c)})
    rest = [c for c in features if c not in middle]
    texts = {c: N.q(c) for c in rest if df.schema[c].dataType.typeName() == "string"}
    found = {c: v[0] for c, v in middle.items()} | {c: v[1] for c, v in O.tallies(df, texts, "string").items()}
    rest = [c for c in rest if c not in texts]
    modes = df.agg(*[S.mode(N.q(c)).alias(f"v{k}") for k, c in enumerate(rest)]).first() if rest else []
    found |= dict(zip(rest, modes, strict=True))
    return {c: found[c] for c in features}


def lever_values(df: DataFrame, column: str, points: int = 5) -> list:
    if N.is_numeric(df, column):
        low, high = O.quantiles(df, {column: (P.to_float(N.q(column)), (0.05, 0.95))})[column]
        return [low + (high - low) * k / (points - 1) for k in range(points)]
    return [r["v"] for r in df.groupBy(N.q(column).alias("v")).count().filter("v is not null").orderBy(F.desc("count"), "v").limit(20).collect()]


def scenario_grid(spark: SparkSession, base: dict, levers: dict[str, list], most: int = SCENARIOS_MOST) -> DataFrame:
    """Every combination of lever values on the base scenario, at most ``most``, in the order of the last lever fastest."""
    out = spark.createDataFrame([(0,)], "escenario long")
    for name, values in levers.items():
        kind = "double" if isinstance(values[0], (int, float)) else "string"
        listed = spark.createDataFrame([(i, float(v) if kind == "double" else str(v)) for i, v in enumerate(values)], f"__i int, `{name}` {kind}")
        out = out.crossJoin(F.broadcast(listed)).withColumn("escenario", F.col("escenario") * len(values) + F.col("__i")).drop("__i")  # a few listed values
        out = out.filter(F.col("escenario") < most) if name == list(levers)[-1] else out
    fixed = [F.lit(float(v) if isinstance(v, (int, float)) else v).alias(c) for c, v in base.items() if c not in levers]
    return out.select("*", *fixed)


def optimize(grid: DataFrame, scored: Column, base_value: float, levers: list[str], maximize: bool = True) -> DataFrame:
    """The scenarios by score, with the gain against the base."""
    gain = F.col("resultado_esperado") - F.lit(base_value)
    out = grid.withColumn("resultado_esperado", scored).withColumn("vs_escenario_actual", gain).withColumn("mejora_%", 100 * gain / (abs(base_value) or 1.0))
    order = F.desc("resultado_esperado") if maximize else F.asc("resultado_esperado")
    return out.withColumn("ranking", F.row_number().over(W.orderBy(order, "escenario"))).select("ranking", "escenario", *levers, "resultado_esperado", "vs_escenario_actual", "mejora_%")  # at most SCENARIOS_MOST rows


def predict_row(spark: SparkSession, row: dict, ready, model) -> dict:
    kinds = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType()}
    schema = T.StructType([T.StructField(k, kinds.get(type(v), T.StringType())) for k, v in row.items()])
    out = model.transform(ready.transform(spark.createDataFrame([tuple(row.values())], schema))).first()
    found = {"prediccion": out["prediction"]}
    return found | ({"probabilidades": list(out["probability"])} if "probability" in out else {})


def sensitivity(df: DataFrame, base: dict, column: str, ready, model, points: int = 15) -> DataFrame:
    """Predictions as one column moves over its values and the rest stays at the base: one table, one transform."""
    grid = scenario_grid(df.sparkSession, base, {column: lever_values(df, column, points)})
    return model.transform(ready.transform(grid)).select(N.q(column), "prediction").orderBy(N.q(column))


def recommendations(scenarios: DataFrame, levers: list[str], k: int = 3) -> list[str]:
    rows = scenarios.filter(F.col("vs_escenario_actual") != 0).orderBy("ranking").limit(k).collect()
    return [" · ".join(f"{c} = {r[c]:.3g}" if isinstance(r[c], float) else f"{c} = {r[c]}" for c in levers) + f": {r['mejora_%']:+.1f} %" for r in rows]


def segment_actions(sizes: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """What to do with each segment, by its share."""
    share = F.col("%_del_total")
    noise = F.col("cluster").cast("string") == "-1"
    priority = F.when(noise, "Media").when(share >= 30, "Alta").when(share <= 5, "Baja").otherwise("Media")
    advice = (
        F.when(noise, "Revisar caso a caso: no pertenecen a ningún grupo").when(share >= 30, "Estrategia principal: concentra la mayor parte")
        .when(share <= 5, "Nicho: evaluar si merece una acción propia").otherwise("Campaña específica según sus rasgos")
    )
    out = sizes.withColumn("prioridad", priority).withColumn("accion_recomendada", advice)
    if named is not None:
        out = out.join(named.select("cluster", F.col("caracteristicas").alias("rasgos_distintivos")), "cluster", "left")
    else:
        out = out.withColumn("rasgos_distintivos", F.lit(None).cast("string"))
    return out.select("cluster", F.col("n_registros").alias("tamaño"), "rasgos_distintivos", "prioridad", "accion_recomendada")


def scenario_label(levers: list[str]) -> Column:
    return F.concat_ws(" · ", *[F.concat(F.lit(f"{c}="), N.q(c).cast("string")) for c in levers])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
