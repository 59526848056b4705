"""A Bloom filter of bounded size over a set of ids, applied where a table is scanned."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .shingles import mix

HASHES = 5
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27  # 8 KB to 16 MB, whatever the number of ids


def _positions(ids: np.ndarray, bits: int) -> np.ndarray:
    h = mix(ids.astype(np.int64).view(np.uint64))
    with np.errstate(over="ignore"):
        step = mix(h) | np.uint64(1)
        return np.stack([(h + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(HASHES)])


@dataclass
class Bloom:
    """Membership with false positives, never false negatives."""

    words: np.ndarray

    def has(self, ids: pa.Array) -> np.ndarray:
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        at = _positions(values, len(self.words) * 64)
        inside = ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)
        return inside & ids.is_valid().to_numpy(zero_copy_only=False)


def bloom_of(ids: DataFrame, key: str) -> Bloom:
    """Built by Spark; the driver gets the filter's words, at most 16 MB however many ids there are.

    Beyond about 13 million ids it lets more rows pass; what uses it stays right, as a join follows.
    """
    count = ids.count()
    bits = LEAST_BITS
    while bits < min(10 * count, MOST_BITS):
        bits *= 2

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = np.unique(_positions(batch.column(0).drop_null().to_numpy(zero_copy_only=False), bits).reshape(-1))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], ["word", "mask"])

        return step

    parts = map_batches(ids.select(F.col(key).cast("long")), make, "word long, mask long")
    table = parts.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[table.column("word").to_numpy()] = table.column("mask").to_numpy().view(np.uint64)
    return Bloom(words)


def without_ids(df: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """``df`` without the rows whose ``key`` is in ``rejected``; rows without key stay.

    An anti-join that moves little: rows that the filter rules out pass where they are scanned, and only the
    others, the rejected ones and a few more, are joined.
    """
    wanted = bloom_of(rejected.select(key), key)

    def through(inside: bool):
        def make():
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                has = wanted.has(batch.column(key).cast(pa.int64()))
                return batch.filter(pa.array(has if inside else ~has))

            return step

        return make

    doubtful = map_batches(df, through(True), df.schema).join(rejected.select(key).distinct(), key, "left_anti").select(*df.columns)
    return map_batches(df, through(False), df.schema).unionByName(doubtful)
