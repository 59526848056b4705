"""Columns suggested for clustering."""

import math

from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lumenframe.operators import clustering, roles


def test_suggested_features_by_every_step(spark):
    n = F.col("id")
    df = spark.range(1_000).select(
        n.alias("a"), (n * 2 + n % 7).alias("twin"), F.when(n < 960, 5.0).otherwise(n.cast("double")).alias("flat"), F.when(n % 3 == 0, (n % 11).cast("double")).alias("gaps"),
        F.when(n % 3 == 0, n * 1.5).otherwise(float("nan")).alias("nans"), (n % 3).alias("Clase"), (n % 40).alias("class_2"), (n % 5).alias("code"), F.concat(F.lit("g"), n % 4).alias("group_name"),
        F.lit(1).alias("one"), F.date_add(F.lit("2020-01-01"), (n % 90).cast("int")).alias("day"), (n % 9 == 0).alias("flag"), (n % 13 + 100).alias("goal"), (n * 7919 % 1009 + 1).alias("wide"),
    )
    found = roles.infer_roles(df)
    told = [tuple(r) for r in clustering.suggest_features(df, found, exclude=["goal"]).collect()]
    by = {r[0]: r[2:] for r in told}
    assert [r[0] for r in told] == ["a", "twin", "class_2", "code", "wide", "flat", "gaps", "nans", "Clase", "group_name", "one", "day", "flag", "goal"]
    assert [r[2] for r in told] == [True] * 5 + [False] * 9
    sd = math.sqrt(sum((i - 499.5) ** 2 for i in range(1_000)) / 999)
    assert by["a"] == (True, f"numérica, variabilidad relativa {sd / 499.5:.2f}") and by["twin"] == (True, "numérica · ojo: muy correlacionada con a (r = 1.00)")
    assert by["flat"][1] == "casi constante (96% es un solo valor)" and by["gaps"][1] == by["nans"][1] == "67% de nulos"
    assert by["Clase"][1].startswith("parece la etiqueta real") and by["goal"][1].startswith("excluida") and by["one"][1].startswith("constante") and by["day"][1].startswith("fecha")
    assert by["group_name"][1].startswith("categórica") and by["flag"][1].startswith("categórica")
    few = {r["variable"]: r["motivo"] for r in clustering.suggest_features(df, found, most=3, categorical=True, drop_redundant=True).filter("variable in ('twin', 'goal', 'group_name', 'a')").collect()}
    assert few == {"a": f"numérica, variabilidad relativa {sd / 499.5:.2f}", "twin": few["twin"], "goal": "fuera del top 3 por variabilidad", "group_name": "categórica con 4 niveles"}
    assert few["twin"].startswith(("redundante con a (r = 1.00)", "fuera del top 3"))
    assert clustering.suggest_features(df.limit(0), {}).filter("sugerida").count() == sum(isinstance(f.dataType, NumericType) for f in df.schema)
