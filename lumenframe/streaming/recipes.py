"""The stateless recipe operations on streams: plain projections and filters, planned as for tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.recipe import OPERATIONS, STATELESS


def apply_to_stream(stream: DataFrame, recipe: list[dict]) -> DataFrame:
    """A recipe on ``readStream``. Steps that need the whole table (statistics, order, samples) are refused."""
    out = stream
    for step in recipe:
        name = step["op"]
        if name not in STATELESS:
            raise ValueError(f"{name} needs the whole table; fit it on a table and use its literals")
        out = OPERATIONS[name](out, **{k: v for k, v in step.items() if k != "op"})
    return out
