"""Tables that charts are drawn from: bars, frequencies, scaled metrics, colour scales, silhouettes, merge heights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from ..plans import order as O
from . import clustering as K

DENDROGRAM_ROWS, BAR_GAP = 800, 12


def missing_bars(profile: DataFrame, top: int = 25) -> DataFrame:
    """The ``top`` columns of a profile with the largest share of nulls and blanks together; full columns are left out."""
    total = F.coalesce(F.col("`%_nulos`"), F.lit(0.0)) + F.coalesce(F.col("`%_vacios`"), F.lit(0.0))
    return profile.select("variable", F.col("`%_nulos`"), F.col("`%_vacios`"), total.alias("total")).filter("total > 0").orderBy(F.desc("total"), "variable").limit(top)


def alert_frequency(alerts: DataFrame, column: str = "alerta") -> DataFrame:
    """How many columns carry each flag; "OK", empty and null alerts carry none."""
    flags = alerts.filter(F.col(column) != "OK").select(F.explode(F.split(column, r"\|")).alias("alerta")).select(F.trim("alerta").alias("alerta"))
    return flags.filter("alerta <> ''").groupBy("alerta").agg(F.count("*").alias("n"))


def metric_radar(board: DataFrame, metrics: list[str], top: int = 5) -> DataFrame:
    """(modelo, metrica, valor, relativo): metrics of the first ``top`` models without error, each scaled to 0..1; 1 where all agree.

    Fewer than three metrics, or no model, give no rows.
    """
    known = [m for m in metrics if m in board.columns]
    long = board.filter("estado = 'ok'").orderBy("ranking").limit(top)
    if len(known) < 3:
        return long.select("modelo", F.lit("").alias("metrica"), F.lit(0.0).alias("valor"), F.lit(0.0).alias("relativo")).limit(0)
    cells = F.array(*[F.struct(F.lit(m).alias("metrica"), N.q(m).cast("double").alias("valor")) for m in known])
    rows = long.select("modelo", F.inline(cells))
    own = W.partitionBy("metrica")  # ``top`` rows
    low, high = F.min("valor").over(own), F.max("valor").over(own)
    return rows.withColumn("relativo", F.when(high > low, (F.col("valor") - low) / (high - low)).otherwise(F.when(F.col("valor").isNotNull(), 1.0)))


def colour_scale(df: DataFrame, columns: list[str], low: float = 0.02, high: float = 0.98) -> dict[str, Column]:
    """For each column its values between two quantiles as 0..1, cut off beyond them; a span of 0 counts as 1."""
    cuts = O.quantiles(df, {c: (N.q(c).cast("double"), (low, high)) for c in columns})
    out = {}
    for c, (a, b) in cuts.items():
        x = N.q(c).cast("double")
        out[c] = F.lit(None).cast("double") if a is None else F.when(x.isNotNull(), F.least(F.greatest((x - a) / ((b - a) or 1.0), F.lit(0.0)), F.lit(1.0)))
    return out


def silhouette_by_point(labelled: DataFrame, key: str, label: str = "prediction") -> DataFrame:
    """(key, cluster, silueta) of all rows outside the noise, see ``clustering.silhouette_each``."""
    return K.silhouette_each(labelled, key, label)


def silhouette_bars(points: DataFrame, gap: int = BAR_GAP) -> DataFrame:
    """(cluster, posicion, silueta, media): bars from small to large inside a cluster, clusters one after another with a gap between."""
    sizes = points.groupBy("cluster").agg(F.count("*").alias("n"))
    before = W.orderBy("cluster").rowsBetween(W.unboundedPreceding, -1)  # a row a cluster
    starts = sizes.select("cluster", F.coalesce(F.sum(F.col("n") + gap).over(before), F.lit(0)).alias("start"))
    mean = points.agg(F.avg("silueta").alias("media"))
    placed = points.withColumn("place", F.row_number().over(W.partitionBy("cluster").orderBy("silueta")) - 1)
    return placed.join(F.broadcast(starts), "cluster").crossJoin(F.broadcast(mean)).select("cluster", (F.col("start") + F.col("place")).alias("posicion"), "silueta", "media")  # one row


def best_rows(table: DataFrame, key: str, best: dict[str, str]) -> DataFrame:
    """(criterio, key) of the best row by each column: "max" or "min"; the smallest key of ties."""
    worth = {c: N.q(c).cast("double") if kind == "max" else -N.q(c).cast("double") for c, kind in best.items()}
    tops = [F.struct(F.lit(c).alias("criterio"), (-F.max(F.when(w.isNotNull(), F.struct(w.alias("w"), (-N.q(key)).alias("k"))))["k"]).alias(key)) for c, w in worth.items()]
    return table.agg(F.array(*tops).alias("t")).select(F.inline("t"))


def dendrogram(m: DataFrame, method: str = "ward", most: int = DENDROGRAM_ROWS, last: int | None = None) -> DataFrame:
    """(paso, a, b, altura, n): merges of a bounded sample, lowest first; only the ``last`` ones if given."""
    z = K.linkage(K._matrix(K.bounded(m, most)), method)
    rows = [(i + 1, int(a), int(b), float(h), int(s)) for i, (a, b, h, s) in enumerate(z)]
    return m.sparkSession.createDataFrame(rows if last is None else rows[-last:], "paso int, a int, b int, altura double, n int")


def jump_k(merges: DataFrame) -> DataFrame:
    """One row (k, altura_antes, altura_despues, salto): the clusters left below the largest gap between merge heights; none for a single merge."""
    along = W.orderBy("paso")  # of a bounded sample
    gaps = merges.select("paso", F.col("altura").alias("altura_antes"), F.lead("altura").over(along).alias("altura_despues"), F.max("paso").over(W.partitionBy()).alias("pasos"))
    widest = gaps.filter("altura_despues is not null").withColumn("salto", F.col("altura_despues") - F.col("altura_antes")).orderBy(F.desc("salto"), "paso").limit(1)
    return widest.select((F.col("pasos") + 1 - F.col("paso")).cast("int").alias("k"), "altura_antes", "altura_despues", "salto")
