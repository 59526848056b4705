"""Recipes, expressions, parsers, roles and statistics on small hand-made tables."""

import math
import re
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.functions import names, parsing, special
from lumenframe.operators import clustering as K
from lumenframe.operators import eda, insights, learning, metrics, quality, recipe, roles
from lumenframe.operators.expressions import ExpressionError, translate
from lumenframe.streaming.recipes import apply_to_stream


def column(df, name):
    return [r[name] for r in df.collect()]


def test_parse_numbers(spark):
    texts = ["1.234,56", "1,234.56", "$ 1.200", "45%", "(12)", "abc", "1,234,567", None, " 7 ", "-3,5", "1e3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert column(df.select(parsing.parse_number(F.col("t")).alias("x")), "x") == [1234.56, 1234.56, 1.2, 0.45, 12.0, None, None, None, 7.0, -3.5, 1000.0]


def test_parse_dates(spark):
    df = spark.createDataFrame([(0, "31/12/2024"), (1, "2024-12-31"), (2, "12/31/2024"), (3, "zz"), (4, None)], "i int, t string").orderBy("i")
    got = column(df.select(F.date_format(parsing.parse_datetime(F.col("t")), "yyyyMMdd").alias("d")), "d")
    assert got == ["20241231", "20241231", "20241231", None, None]


def test_names():
    assert names.normalize_names(["Año Nuevo", "ano nuevo", "%", "a.b`c"]) == ["ano_nuevo", "ano_nuevo_1", "columna_3", "a_b_c"]
    assert names.clean_column_name("  a \n b ", 0) == "a b" and names.clean_column_name(None, 2) == "columna_3"


def test_roles(spark):
    rows = [(i, f"CLI-{i:06d}", "x", ("a", "b")[i % 2], f"{i},5", f"{i % 28 + 1:02d}/01/2024", i % 2, i / 7, "word %d" % (i % 60)) for i in range(200)]
    df = spark.createDataFrame(rows, "n long, cliente_id string, c string, k string, num string, fecha string, flag int, v double, `texto libre` string")
    got = {c: (r.role, r.convertible_to) for c, r in roles.infer_roles(df).items()}
    assert got == {"n": ("numerica", None), "cliente_id": ("id", None), "c": ("constante", None), "k": ("categorica", None), "num": ("id", None), "fecha": ("texto", "fecha"),
                   "flag": ("booleana", None), "v": ("numerica", None), "texto libre": ("texto", None)}


def test_identical_columns_are_not_permutations(spark):
    df = spark.createDataFrame([(1, 3, 1, None), (2, 1, 2, 5), (3, 2, 3, 5)], "a int, b int, c int, d int")
    assert quality.identical_columns(df) == [["a", "c"]]


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(5.0, None, float("nan"))] * 6, "k double, gone double, nan double")
    got = {r["variable"]: r for r in eda.describe_numeric(df).collect()}
    assert got["k"]["asimetria"] == 0 and got["k"]["curtosis"] == 0 and got["gone"]["n"] == 0 and got["nan"]["nulos"] == 6
    assert eda.describe_numeric(df.limit(0)).count() == 3
    assert eda.outlier_table(df.limit(0)).count() == 0
    assert quality.quality_score(df)["nivel"] in ("Excelente", "Buena", "Aceptable", "Deficiente", "Crítica")


def test_interpolation_and_fill(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])], "i int, v double")
    assert column(recipe.impute(df, "interpolar", columns=["v"], order=["i"]).orderBy("i"), "v") == [1, 1, 2, 3, 4, 4]
    assert column(recipe.impute(df, "ffill", columns=["v"], order=["i"]).orderBy("i"), "v") == [1, 1, 1, 1, 4, 4]


def test_bins(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 9)], "x double")
    assert list(dict.fromkeys(column(recipe.binning(df, "x", 4).orderBy("x"), "x_bin"))) == ["(0.999, 2.75]", "(2.75, 4.5]", "(4.5, 6.25]", "(6.25, 8.0]"]
    assert list(dict.fromkeys(column(recipe.binning(df, "x", 2, "iguales").orderBy("x"), "x_bin"))) == ["(0.993, 4.5]", "(4.5, 8.0]"]


def test_text_and_conversion(spark):
    df = spark.createDataFrame([("  Ñandú  mundo-x ", "Sí", "12,5"), (None, "?", "7")], "t string, b string, n string")
    out = recipe.clean_text(df, ["t"], case="title", remove_accents=True)
    assert column(out, "t") == ["Nandu Mundo-X", None]
    got = recipe.convert_types(df, {"b": "booleana", "n": "entero"}).collect()
    assert [r["b"] for r in got] == [True, None] and [r["n"] for r in got] == [13, 7]


def test_expressions(spark):
    df = spark.createDataFrame([(1, 2.0, "ab", 0), (None, 3.0, None, 1), (5, 0.0, "cd", 0)], "a int, `b c` double, s string, z int")
    pick = lambda e: [r["b c"] for r in df.filter(translate(e, df.columns)).collect()]
    assert pick("a > 1") == [0.0] and pick("a != 1") == [3.0, 0.0] and pick("1 <= a < 6 and `b c` == 0") == [0.0]
    assert pick("s.str.contains('a') or a.isna()") == [2.0, 3.0] and pick("(s in ['cd']) | (z == 1)") == [3.0, 0.0] and pick("not (a > 1)") == [2.0, 3.0]
    assert column(df.select(translate("a / z", df.columns).alias("v")), "v") == [None, None, None]
    for bad in ("__import__('os')", "a.b", "(lambda: 1)()", "a if z else 1", "nope > 1", "[x for x in a]"):
        with pytest.raises(ExpressionError):
            translate(bad, df.columns)


def test_recipe_log_and_errors(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "x int, y string")
    steps = [{"op": "eliminar_duplicados"}, {"op": "nada"}, {"op": "filtrar", "query": "w > 1"}, {"op": "imputar"}]
    out, log = recipe.apply_recipe(df, steps, log_counts=True)
    assert [x["estado"] for x in log] == ["ok", "error", "error", "ok"] and log[0]["filas_despues"] == 2 and out.count() == 2
    assert "OPERATIONS['imputar']" in recipe.recipe_to_code(steps) and len(recipe.OPERATIONS) == 18
    assert recipe.auto_recipe(df)[0] == {"op": "vacios_a_nulos"}


def test_recipe_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, " a "), (2, "n/a"), (3, "c")], "x int, y string").write.parquet(source)
    stream = spark.readStream.schema("x int, y string").parquet(source)
    steps = [{"op": "vacios_a_nulos"}, {"op": "limpiar_texto"}, {"op": "filtrar", "query": "x < 3"}]
    query = apply_to_stream(stream, steps).writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("cleaned").collect())) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError, match="whole table"):
        apply_to_stream(stream, [{"op": "imputar"}])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-1e4, 1e4)), min_size=5, max_size=30))
def test_describe_equals_pandas(spark, values):
    got = eda.describe_numeric(spark.createDataFrame([(v,) for v in values], "x double")).first()
    s = pd.Series(values, dtype=float)
    want = {"n": s.count(), "media": s.mean(), "mediana": s.median(), "desv_std": s.std(), "p25": s.quantile(0.25), "p95": s.quantile(0.95)}
    for k, v in want.items():
        assert (got[k] is None and math.isnan(v)) or got[k] == pytest.approx(v, rel=1e-6, abs=1e-6)


def test_tail_probabilities():
    assert special.t_sf2(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.f_sf(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-6) and special.chi2_sf(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    rng = np.random.default_rng(0)
    ideal = [NormalDist(3, 2).inv_cdf((i + 0.5) / 500) for i in range(500)]
    assert special.shapiro_wilk(ideal)[1] > 0.9 and special.shapiro_wilk(list(rng.exponential(size=500)))[1] < 1e-6


def test_chi_square_with_and_without_correction(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 5
    r = eda.chi_square(spark.createDataFrame(rows, "p string, q string"), "p", "q").first()
    o, e = np.array([[10, 20], [30, 5]]), np.outer([30, 35], [40, 25]) / 65
    assert r["chi2"] == pytest.approx(((o - e) ** 2 / e).sum()) and r["yates"] == pytest.approx(((abs(o - e) - 0.5) ** 2 / e).sum())


def test_ranking_extremes(spark):
    frame = lambda s: spark.createDataFrame([(1, s), (1, s), (0, 1 - s), (0, 1 - s)], "label int, score double")
    assert metrics.ranking_metrics(frame(0.9)).first()["roc_auc"] == 1 and metrics.ranking_metrics(frame(0.1)).first()["roc_auc"] == 0 and metrics.ranking_metrics(frame(0.5)).first()["roc_auc"] == 0.5


def test_split_is_exact_and_stable(spark):
    df = spark.createDataFrame([(i, "ab"[i % 10 == 0]) for i in range(1000)], "i long, y string")
    one = learning.split(df, "y", ["i"])
    assert {(r["y"], r["is_test"]): r["count"] for r in one.groupBy("y", "is_test").count().collect()} == {("a", True): 180, ("a", False): 720, ("b", True): 20, ("b", False): 80}
    assert one.filter("is_test").join(learning.split(df.repartition(7), "y", ["i"]).filter("is_test"), "i").count() == 200
    sizes = [r["count"] for r in learning.folds(df, "y", ["i"], 5).groupBy("y", "fold").count().filter("y = 'a'").collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_models_beat_the_baseline(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), "uv"[int(x > 0)], float(3 * x + rng.normal(0, 0.1)), "sí" if x + rng.normal(0, 0.2) > 0 else "no") for i, x in enumerate(rng.normal(size=400))]
    df = spark.createDataFrame(rows, "i long, x double, c string, y double, z string")
    reg = learning.train_models(df, "y", ["x", "c"], ["i"], models=["Regresión Lineal", "Ridge"])
    board = {r["modelo"]: r for r in reg.leaderboard().collect()}
    assert reg.task == "regresion" and board["Ridge"]["r2"] > 0.95 > 0.1 > board["Baseline (media)"]["r2"] and board["Ridge"]["ranking"] <= 2
    clf = learning.train_models(df, "z", ["x"], ["i"], models=["Regresión Logística"], cv=2)
    assert clf.task == "binaria" and clf.classes == ["no", "sí"] and clf.results[0].metrics["roc_auc"] > 0.9 and len(clf.results[0].cv) == 2


def test_dbscan_two_blobs_and_noise(spark):
    points = [(i, [0.1 * (i % 5), 0.1 * (i // 5)]) for i in range(20)] + [(100 + i, [5 + 0.1 * (i % 5), 5 + 0.1 * (i // 5)]) for i in range(20)] + [(999, [2.5, 2.5])]
    m = spark.createDataFrame(points, "i long, f array<double>").select("i", K.as_vector("f").alias("features"))
    labels = {r["i"]: r["prediction"] for r in K.dbscan(m, "i", 0.15, 3).collect()}
    assert labels[999] == -1 and len({v for k, v in labels.items() if k < 20}) == 1 and len({v for v in labels.values()}) == 3
    x = np.array([p[1] for p in points])
    z = K.linkage(x)
    assert len(set(K.cut_tree(z, 2))) == 2 and (np.diff(z[:, 2]) >= -1e-9).all()
    assert K.best_matching({("a", "p"): 5, ("a", "q"): 1, ("b", "q"): 7, ("b", "p"): 3})[1] == 12 / 16


def test_insights(spark):
    actions = insights.prescriptive_actions(score=50, rows=100, metric=0.6, baseline=0.59, overfit=0.2, tuned=False, silhouette=0.1)
    assert [a["prioridad"] for a in actions] == sorted([a["prioridad"] for a in actions], key=insights.PRIORITY.get) and len({a["accion"] for a in actions}) == len(actions)
    df = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(50)], "x double, g string")
    assert insights.base_scenario(df, ["x", "g"]) == {"x": 24.5, "g": "a"}
    assert insights.descriptive_report(df)[0].startswith("La tabla tiene 50 filas")
    assert insights.scenario_grid(spark, {}, {"a": list(range(100)), "b": list(range(100))}).count() == insights.SCENARIOS_MOST


def test_dates_are_parsed_only_where_their_shape_fits(spark):
    """A failed parse costs an exception, so texts without a date's shape must not reach the parser."""
    formats = [*parsing.ISO, *parsing.DAY_FIRST, *parsing.MONTH_FIRST]
    fits = lambda t: [f for f in formats if re.match(parsing.date_shape(f), t)]
    assert not any(fits(t) for t in ("Customer#000000001", "4-NOT SPECIFIED", "Brand#12", "$ 1234.50", "hot bolt"))
    assert fits("25/12/2020") == ["d/M/yyyy", "d/M/yy", "M/d/yyyy"] and fits("2020-12-25t10:00:00") == ["yyyy-MM-dd'T'HH:mm:ss"]
    moment = F.lit("2021-11-09 10:11:12").cast("timestamp")
    written = spark.range(1).select(*[F.date_format(moment, f).alias(f"f{k}") for k, f in enumerate(formats)]).first()
    assert all(f in fits(written[k]) for k, f in enumerate(formats))
