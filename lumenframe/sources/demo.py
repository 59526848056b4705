"""Two made-up tables with planted faults, for trying things out: each value is a function of the row's number and the seed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 42


class Draws:
    """Random columns over the row number ``__i``; a name is a stream of its own, so neither partitions nor order matter."""

    def __init__(self, seed: int = SEED):
        self.seed = seed

    def uniform(self, name: str) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), F.lit(name), F.col("__i")), 11)
        return (bits.cast("double") + 0.5) / float(1 << 53)

    def normal(self, name: str, mean: float = 0.0, sd: float = 1.0) -> Column:
        return mean + sd * F.sqrt(-2 * F.log(self.uniform(name))) * F.cos(2 * math.pi * self.uniform(name + "'"))

    def whole(self, name: str, low: int, high: int) -> Column:
        """From ``low`` to under ``high``."""
        return (low + F.floor(self.uniform(name) * (high - low))).cast("int")

    def pick(self, name: str, options: list, shares: list[float] | None = None) -> Column:
        shares, u = shares or [1 / len(options)] * len(options), self.uniform(name)
        out = F.lit(options[-1])
        for k in reversed(range(len(options) - 1)):
            out = F.when(u < sum(shares[: k + 1]), F.lit(options[k])).otherwise(out)
        return out

    def poisson(self, name: str, mean: float) -> Column:
        u, total, out = self.uniform(name), 0.0, F.lit(0)
        for k in range(25):
            total += math.exp(-mean) * mean**k / math.factorial(k)
            out = out + (u > total).cast("int")
        return out

    def gamma(self, name: str, shape: int, scale: float) -> Column:
        """Of a whole ``shape``: a sum of exponential draws."""
        return -scale * sum((F.log(self.uniform(f"{name}{k}")) for k in range(shape)), F.lit(0.0))

    def chance(self, name: str, share: float) -> Column:
        return self.uniform(name) < share

    def marked(self, df: DataFrame, name: str, count: int) -> DataFrame:
        """``df`` with the flag ``name`` set in exactly ``count`` rows (all, if there are fewer)."""
        some = df.select("__i", self.uniform(name).alias("__u")).orderBy("__u", "__i").limit(count).select("__i", F.lit(True).alias(name))
        return df.join(F.broadcast(some), "__i", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def churn_customers(spark: SparkSession, n: int = 3_000, seed: int = SEED, dirty: int = 60, blank: int = 40, copies: int = 70, numbers: DataFrame | None = None) -> DataFrame:
    """``n`` telephone customers and ``copies`` repeated rows: a column to predict, gaps, blanks, a dirty city name and a constant.

    ``numbers`` (one column of distinct whole numbers) gives the customers' numbers in place of 1 to ``n``.
    """
    d = Draws(seed)
    df = numbers.toDF("__i") if numbers is not None else spark.range(1, n + 1).withColumnRenamed("id", "__i")
    # fixed values: names, shares and coefficients of the demonstration table
    df = df.select(
        "__i",
        F.format_string("CLI-%06d", "__i").alias("cliente_id"),
        d.pick("ciudad", ["Bogotá", "Medellín", "Cali", "Barranquilla", "Bucaramanga"], [0.40, 0.22, 0.18, 0.12, 0.08]).alias("ciudad"),
        d.pick("plan", ["Básico", "Estándar", "Premium"], [0.45, 0.35, 0.20]).alias("plan"),
        d.pick("contrato", ["Mes a mes", "Un año", "Dos años"], [0.55, 0.28, 0.17]).alias("tipo_contrato"),
        d.pick("pago", ["Débito automático", "Tarjeta", "Transferencia", "Efectivo"]).alias("metodo_pago"),
        d.whole("antiguedad", 1, 72).alias("antiguedad_meses"),
        F.round(F.least(F.greatest(d.normal("cargo", 70, 25), F.lit(18.0)), F.lit(160.0)), 2).alias("cargo_mensual"),
        d.poisson("soporte", 1.2).alias("llamadas_soporte"),
        d.pick("fibra", [0, 1], [0.45, 0.55]).alias("tiene_fibra"),
        F.round(F.least(F.greatest(d.normal("satisfaccion", 7, 2), F.lit(1.0)), F.lit(10.0)), 1).alias("satisfaccion"),
        F.date_add(F.lit("2019-01-01").cast("date"), d.whole("alta", 0, 1_800)).cast("timestamp").alias("fecha_alta"),
        F.lit("Colombia").alias("pais"),
    )
    bound = F.when(F.col("tipo_contrato") == "Mes a mes", 1.3).when(F.col("tipo_contrato") == "Un año", 0.2).otherwise(-0.9)
    leaning = (
        bound - 1.1 - 0.045 * F.col("antiguedad_meses") + 0.022 * F.col("cargo_mensual") + 0.38 * F.col("llamadas_soporte") - 0.30 * F.col("satisfaccion")
        + F.when(F.col("metodo_pago") == "Efectivo", 0.55).otherwise(0.0) - 0.25 * F.col("tiene_fibra") + d.normal("ruido", 0, 0.55)
    )
    df = df.withColumn("abandono", F.when(1 / (1 + F.exp(-leaning)) > d.uniform("abandono"), "Sí").otherwise("No"))
    df = df.withColumn("cargo_total", F.round(F.col("cargo_mensual") * F.col("antiguedad_meses") * (0.9 + 0.2 * d.uniform("total")), 2))
    for column, share in (("satisfaccion", 0.09), ("cargo_total", 0.05), ("plan", 0.04)):
        df = df.withColumn(column, F.when(~d.chance(f"hueco {column}", share), F.col(column)))
    df = d.marked(d.marked(d.marked(df, "__dirty", dirty), "__blank", blank), "__copy", copies)
    df = df.withColumn("ciudad", F.when(F.col("__dirty"), " bogotá ").otherwise(F.col("ciudad")))
    df = df.withColumn("metodo_pago", F.when(F.col("__blank"), "").otherwise(F.col("metodo_pago")))
    df = df.withColumn("__times", F.explode(F.when(F.col("__copy"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return df.select("cliente_id", "ciudad", "plan", "tipo_contrato", "metodo_pago", "antiguedad_meses", "cargo_mensual", "cargo_total", "llamadas_soporte", "tiene_fibra", "satisfaccion", "fecha_alta", "pais", "abandono")


def property_sales(spark: SparkSession, n: int = 2_500, seed: int = SEED, numbers: DataFrame | None = None) -> DataFrame:
    """``n`` homes, or one for each of ``numbers``, with a price to predict and gaps in the area."""
    d = Draws(seed)
    inside = lambda c, low, high: F.least(F.greatest(F.round(c), F.lit(float(low))), F.lit(float(high))).cast("int")
    df = numbers.toDF("__i") if numbers is not None else spark.range(1, n + 1).withColumnRenamed("id", "__i")
    # fixed values: names, shares and coefficients of the demonstration table
    df = df.withColumn("area_m2", F.round(d.gamma("area", 6, 15.0) + 35, 1))
    df = df.withColumn("habitaciones", inside(F.col("area_m2") / 38 + d.normal("habitaciones", 0, 0.7), 1, 6))
    df = df.withColumn("banos", inside(F.col("habitaciones") * 0.7 + d.normal("banos", 0, 0.5), 1, 4))
    df = df.select(
        "*",
        F.format_string("INM-%05d", "__i").alias("inmueble_id"),
        d.pick("zona", ["Norte", "Centro", "Sur", "Occidente", "Chapinero"]).alias("zona"),
        d.pick("estrato", [2, 3, 4, 5, 6], [0.15, 0.30, 0.28, 0.17, 0.10]).alias("estrato"),
        d.whole("antiguedad", 0, 45).alias("antiguedad_anios"),
        d.pick("parqueadero", [0, 1, 2], [0.35, 0.50, 0.15]).alias("parqueaderos"),
        d.whole("piso", 1, 20).alias("piso"),
        d.pick("ascensor", [0, 1], [0.3, 0.7]).alias("tiene_ascensor"),
        F.date_add(F.lit("2023-01-01").cast("date"), d.whole("publicada", 0, 700)).cast("timestamp").alias("fecha_publicacion"),
    )
    price = (
        95 * F.col("area_m2") + 9_000 * F.col("habitaciones") + 12_000 * F.col("banos") - 1_400 * F.col("antiguedad_anios") + 26_000 * F.col("estrato")
        + 15_000 * F.col("parqueaderos") + 900 * F.col("piso") + F.when(F.col("zona") == "Chapinero", 60_000).when(F.col("zona") == "Norte", 45_000).otherwise(0) + d.normal("precio", 0, 22_000)
    )
    df = df.withColumn("precio_millones", F.round(F.round(F.greatest(price, F.lit(60_000.0)), -3) / 1_000, 2))
    df = df.withColumn("area_m2", F.when(~d.chance("hueco area", 0.06), F.col("area_m2")))
    return df.select("inmueble_id", "zona", "estrato", "area_m2", "habitaciones", "banos", "antiguedad_anios", "parqueaderos", "piso", "tiene_ascensor", "fecha_publicacion", "precio_millones")
