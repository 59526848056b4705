"""Many statistics of many columns in few passes over the data."""

from __future__ import annotations

from collections.abc import Hashable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDEST = 180  # expressions in one aggregate: generated methods stay compilable


class AggFusion:
    """Collects (key, aggregate) requests and answers them from one wide aggregate for each ``WIDEST``."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df
        self.wanted: dict[Hashable, Column] = {}

    def want(self, key: Hashable, column: Column) -> None:
        self.wanted.setdefault(key, column)

    def run(self) -> dict[Hashable, object]:
        out: dict[Hashable, object] = {}
        keys = list(self.wanted)
        for at in range(0, len(keys), WIDEST):
            part = keys[at : at + WIDEST]
            row = self.df.agg(*[self.wanted[k].alias(f"v{n}") for n, k in enumerate(part)]).first()
            out |= {k: row[n] for n, k in enumerate(part)}
        return out


def stacked(df: DataFrame, columns: list[str], stats: dict, kinds: dict[str, str]) -> DataFrame:
    """One row a column from one aggregate: ``stats`` maps a name to a function of the column.

    Columns are aggregated side by side in a single pass; the one wide row is then unfolded, lazily.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "variable string, " + ", ".join(f"`{k}` {t}" for k, t in kinds.items()))
    one = lambda c: F.struct(F.lit(c).alias("variable"), *[f(c).cast(kinds[k]).alias(k) for k, f in stats.items()])
    parts = []
    for at in range(0, len(columns), max(1, WIDEST // max(len(stats), 1))):
        part = columns[at : at + max(1, WIDEST // max(len(stats), 1))]
        parts.append(df.agg(F.array(*[one(c) for c in part]).alias("rows")).select(F.inline("rows")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
