"""Exact quantiles, modes and distinct counts of many columns, without a map of all values and without sorting all rows."""

from __future__ import annotations

import math
from collections.abc import Hashable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import workspace
from .fusion import AggFusion

ACCURACY = 10_000  # of the sketches: a bracket holds about four rows in so many
WIDEST = 48  # columns unfolded in one pass


def _chunks(keys: list) -> list[list]:
    return [keys[at : at + WIDEST] for at in range(0, len(keys), WIDEST)]


def _placed(df: DataFrame, columns: list[Column], cuts: list[list[float]]) -> DataFrame:
    """Rows (c, cell, x) for each value x of the c-th column: cell is the number of its cuts (increasing) that x reaches."""
    names = [f"x{c}" for c in range(len(columns))]
    narrow = df.select(*[x.alias(n) for x, n in zip(columns, names, strict=True)])
    # a binary search a value: a chain of conditions would outgrow what the compiler takes
    splits = [[-math.inf, *(v for v in own if not math.isinf(v)), math.inf] for own in cuts]
    splits = [s if len(s) > 2 else [-math.inf, 0.0, math.inf] for s in splits]
    narrow = Bucketizer(splitsArray=splits, inputCols=names, outputCols=[f"{n}_cell" for n in names], handleInvalid="keep").transform(narrow)
    parts = [F.struct(F.lit(c).alias("c"), F.col(f"{n}_cell").cast("int").alias("cell"), F.col(n).alias("x")) for c, n in enumerate(names)]
    return _unfolded(narrow, parts).filter("x is not null")


def _unfolded(df: DataFrame, parts: list[Column]) -> DataFrame:
    return df.select(F.inline(F.array(*parts)))


def quantiles(df: DataFrame, wanted: dict[Hashable, tuple[Column, Sequence[float]]], accuracy: int = ACCURACY) -> dict[Hashable, list[float | None]]:
    """For each key the linearly interpolated quantiles of its column, exact; None for a column without values.

    One aggregate takes sketches of bounded size, which bracket the rank of each quantile. A second one
    counts the rows between the brackets and, by value, those in them (a few in ``accuracy``). Running counts over these
    cells give the two values that each quantile lies between. Two rows a quantile reach the driver.
    """
    out: dict[Hashable, list[float | None]] = {}
    for part in _chunks(list(wanted)):
        out |= _quantiles(df, {k: wanted[k] for k in part}, accuracy)
    return out


def _quantiles(df: DataFrame, wanted: dict[Hashable, tuple[Column, Sequence[float]]], accuracy: int) -> dict[Hashable, list[float | None]]:
    if not wanted:
        return {}
    facts, slack = AggFusion(df), 2.0 / accuracy
    number = {k: x.cast("double") for k, (x, _) in wanted.items()}
    for k, (_, ps) in wanted.items():
        around = [F.lit(min(1.0, max(0.0, p + d))) for p in ps for d in (-slack, slack)]
        facts.want(k, F.struct(F.count(number[k]).alias("n"), F.percentile_approx(number[k], F.array(*around), F.lit(accuracy)).alias("at")))
    sketched = facts.run()
    some = [k for k in wanted if sketched[k]["n"]]
    if not some:
        return {k: [None] * len(ps) for k, (_, ps) in wanted.items()}
    cuts, places = [], []
    for c, k in enumerate(some):
        at, brackets = sketched[k]["at"], []
        for low, high in sorted(zip(at[::2], at[1::2], strict=True)):
            high = math.nextafter(high, math.inf)
            if brackets and low <= brackets[-1][1]:
                brackets[-1][1] = max(high, brackets[-1][1])
            else:
                brackets.append([low, high])
        cuts.append([v for b in brackets for v in b])  # odd cells are brackets
        ranks = {r for p in wanted[k][1] for r in (math.floor((sketched[k]["n"] - 1) * p), math.ceil((sketched[k]["n"] - 1) * p))}
        places += [(c, r) for r in sorted(ranks)]
    cells = _placed(df, [number[k] for k in some], cuts).withColumn("value", F.when(F.col("cell") % 2 == 1, F.col("x")))
    counted = cells.groupBy("c", "cell", "value").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    order = W.partitionBy("c").orderBy("cell", "value").rowsBetween(W.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    sought = F.broadcast(df.sparkSession.createDataFrame(places, "c int, rank long"))  # two a quantile
    hit = counted.join(sought, "c").filter("rank >= before and rank < before + n").collect()
    found = {(r["c"], r["rank"]): r["lo"] if r["rank"] == r["before"] else r["hi"] for r in hit if r["lo"] == r["hi"] or r["rank"] in (r["before"], r["before"] + r["n"] - 1)}
    out: dict[Hashable, list[float | None]] = {k: [None] * len(ps) for k, (_, ps) in wanted.items()}
    for c, k in enumerate(some):
        for i, p in enumerate(wanted[k][1]):
            at = (sketched[k]["n"] - 1) * p
            low, high = found.get((c, math.floor(at))), found.get((c, math.ceil(at)))
            if low is None or high is None:  # outside its bracket, which the sketches' error bound rules out
                out[k][i] = df.agg(F.percentile(number[k], F.lit(p))).first()[0]
            else:
                out[k][i] = low if low == high or at == math.floor(at) else (math.ceil(at) - at) * low + (at - math.floor(at)) * high
    return out


def group_quantiles(df: DataFrame, group: Column, x: Column, ps: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """(g, q): for each value of ``group`` the linearly interpolated quantiles ``ps`` of ``x``, exact.

    As ``quantiles``, but groups stay in Spark: a sketch a group brackets each rank, rows are counted between and in
    the brackets before they are shuffled, and no task holds a map of a group's values. Groups without values are left out.
    """
    slack = 2.0 / accuracy
    around = F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in ps for d in (-slack, slack)])
    rows = df.select(group.alias("g"), x.cast("double").alias("x")).filter("x is not null")
    facts = rows.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("x", around, F.lit(accuracy)).alias("at"))
    facts = workspace.keep(facts, "brackets")  # a row a group; its size is known then, so that few groups are broadcast and rows aren't shuffled by them
    placed = rows.join(facts.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h")))

    def part(i: int) -> Column:
        cell = F.when(F.col("x") < F.col("at")[2 * i], 0).when(F.col("x") <= F.col("at")[2 * i + 1], 1).otherwise(2)
        return F.struct(F.lit(i).alias("i"), cell.alias("cell"), F.when(cell == 1, F.col("x")).alias("value"), F.col("x").alias("y"))

    cells = placed.select("g", "n", F.inline(F.array(*[part(i) for i in range(len(ps))])))
    counted = cells.groupBy("g", "n", "i", "cell", "value").agg(F.count("*").alias("m"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    before = F.coalesce(F.sum("m").over(W.partitionBy("g", "n", "i").orderBy("cell", "value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = (F.col("n") - 1) * F.element_at(F.array(*[F.lit(float(p)) for p in ps]), F.col("i") + 1)

    def value(rank: Column) -> Column:
        first, last = F.col("before"), F.col("before") + F.col("m") - 1
        return F.max(F.when((rank == first) | ((F.col("lo") == F.col("hi")) & rank.between(first, last)), F.col("lo")).when(rank == last, F.col("hi")))

    ranked = counted.withColumn("before", before).withColumn("place", place)
    ends = ranked.groupBy("g", "i", "place").agg(value(F.floor("place")).alias("low"), value(F.ceil("place")).alias("high"))
    up, down = F.ceil("place") - F.col("place"), F.col("place") - F.floor("place")
    between = F.when((F.col("low") == F.col("high")) | (down == 0), F.col("low")).otherwise(up * F.col("low") + down * F.col("high"))
    return ends.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", between.alias("v")))).alias("q")).select("g", F.transform("q", lambda e: e["v"]).alias("q"))


def with_median(per: DataFrame, df: DataFrame, name: str, group: Column, x: Column, label: str) -> DataFrame:
    """``per``, a row a group in column ``name``, with the median of ``x`` over the group's rows of ``df``."""
    found = group_quantiles(df, group, x, (0.5,)).select(F.col("g").alias("__g"), F.col("q")[0].alias(label))
    return per.join(found, F.col(f"`{name}`").eqNullSafe(F.col("__g")), "left").drop("__g")


def tallies(df: DataFrame, columns: dict[Hashable, Column], kind: str = "double") -> dict[Hashable, tuple[int, object, int]]:
    """For each key: distinct values, the most frequent one (the smallest of ties) and its count; nulls don't count.

    Values of all columns are counted together, combined before the one shuffle. All columns are taken as ``kind``.
    """
    out: dict[Hashable, tuple[int, object, int]] = {k: (0, None, 0) for k in columns}
    for part in _chunks(list(columns)):
        long = _unfolded(df, [F.struct(F.lit(c).alias("c"), columns[k].cast(kind).alias("v")) for c, k in enumerate(part)])
        counts = long.filter("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))
        best = counts.groupBy("c").agg(F.count("*").alias("kinds"), F.min(F.struct((-F.col("n")).alias("m"), "v")).alias("top"))
        out |= {part[r["c"]]: (r["kinds"], r["top"]["v"], -r["top"]["m"]) for r in best.collect()}
    return out


def ranks(df: DataFrame, columns: list[Column], rows_a_cell: int = 1_000_000, most_cells: int = 4_096) -> DataFrame:
    """Rows (c, value, n, before): how often the c-th column has a value, and how many of its rows are smaller.

    Values are counted, dealt into cells by the cuts of a sketch, and summed up inside cells and then over them, so
    no task sorts a whole column. Null values have no rank.
    """
    columns = [x.cast("double") for x in columns]
    facts = AggFusion(df)
    for c, x in enumerate(columns):
        facts.want(c, F.count(x))
    n = facts.run()
    sketches = AggFusion(df)
    cells = {c: min(most_cells, 1 + n[c] // rows_a_cell) for c in n}
    for c, x in enumerate(columns):
        if cells[c] > 1:
            sketches.want(c, F.percentile_approx(x, F.array(*[F.lit(k / cells[c]) for k in range(1, cells[c])]), F.lit(ACCURACY)))
    cuts = sketches.run() if sketches.wanted else {}
    placed = _placed(df, columns, [sorted(set(cuts.get(c) or ())) for c in range(len(columns))])
    counted = placed.groupBy("c", "cell", F.col("x").alias("value")).agg(F.count("*").alias("n"))
    inside = counted.withColumn("inside", F.coalesce(F.sum("n").over(W.partitionBy("c", "cell").orderBy("value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sizes = counted.groupBy("c", "cell").agg(F.sum("n").alias("s"))
    sizes = sizes.select("c", "cell", F.coalesce(F.sum("s").over(W.partitionBy("c").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    return inside.join(F.broadcast(sizes), ["c", "cell"]).select("c", "value", "n", (F.col("earlier") + F.col("inside")).alias("before"))  # most_cells a column


def hashed(*columns: Column) -> Column:
    """128 bits of a row of values: equal rows agree, and others but for a chance that no table reaches."""
    return F.struct(F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit(20_240_117), *columns).alias("g"))


def distinct_counts(df: DataFrame, columns: dict[Hashable, Column]) -> dict[Hashable, int]:
    """Distinct non-null values of each column, by 128-bit hashes: long texts are not shuffled."""
    out: dict[Hashable, int] = dict.fromkeys(columns, 0)
    for part in _chunks(list(columns)):
        long = _unfolded(df, [F.struct(F.lit(c).alias("c"), F.when(columns[k].isNotNull(), hashed(columns[k])).alias("v")) for c, k in enumerate(part)])
        rows = long.filter("v is not null").select("c", "v.h", "v.g").distinct().groupBy("c").count().collect()
        out |= {part[r["c"]]: r["count"] for r in rows}
    return out


def distinct_rows(df: DataFrame, columns: list[Column]) -> int:
    return df.select(hashed(*columns).alias("v")).select("v.h", "v.g").distinct().count()
