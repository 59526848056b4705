"""Document fingerprints by winnowing: the minimum k-gram hash of each window, the rightmost of equal ones."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, release
from .shingles import Powers, mix

K, WINDOW = 24, 32  # code points of a gram, grams of a window: a match of K + WINDOW - 1 code points is never missed
CHUNK = 1 << 18  # windows hashed at once
RUN = 1 << 19  # code points of texts fingerprinted at once, about (one text at least)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(codes: np.ndarray, k: int, powers: Powers) -> np.ndarray:
    """The rolling hash of each ``k`` code points: differences of prefix sums, shifted to the same power."""
    up, down = powers.upto(len(codes) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], dtype=np.uint64)))
        return mix((total[k:] - total[:-k]) * down[: len(total) - k])


def _least(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window of hashes the place of its least one, the rightmost of equal ones; by doubling."""
    value, place, size = hashes, np.arange(len(hashes)), 1
    while size < window:
        shift = min(size, window - size)
        left, right = value[:-shift], value[shift:]
        take = right <= left
        value, place, size = np.where(take, right, left), np.where(take, place[shift:], place[:-shift]), size + shift
    return place


def winnow(texts: list[np.ndarray], k: int = K, window: int = WINDOW, powers: Powers | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) of each text of code points, ascending by position.

    A text with fewer grams than a window is one window; one shorter than a gram is one gram; an empty one has none.
    """
    powers = powers or Powers()
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    codes = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
    span = k + window - 1
    edge = np.zeros(len(codes) + 1, dtype=np.int64)  # a window starts where no text ends within its span
    long = sizes >= span
    np.add.at(edge, first[:-1][long], 1)
    np.add.at(edge, first[:-1][long] + sizes[long] - span + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at in range(0, max(0, len(codes) - span + 1), CHUNK):
        own = valid[at : at + CHUNK]
        if not own.any():
            continue
        grams = _grams(codes[at : at + CHUNK + span - 1], k, powers)
        place = _least(grams, window)
        place = np.unique(place[own[: len(place)]])
        places.append(place + at)
        hashes.append(grams[place])
    place, value = np.concatenate(places), np.concatenate(hashes)
    new = np.ones(len(place), dtype=bool)
    new[1:] = place[1:] != place[:-1]  # windows of two chunks may share a minimum
    place, value = place[new], value[new]
    cut = np.searchsorted(place, first)
    out = []
    for i, size in enumerate(sizes):
        if size >= span:
            out.append((place[cut[i] : cut[i + 1]] - first[i], value[cut[i] : cut[i + 1]]))
        elif size:
            grams = _grams(texts[i], min(k, int(size)), powers)
            best = len(grams) - 1 - int(np.argmin(grams[::-1]))
            out.append((np.array([best], np.int64), grams[best : best + 1]))
        else:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.uint64)))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sets of hashes; two empty ones are equal."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_chars, positions array<int>, hashes array<long>.

    Every two texts that share ``k + window - 1`` code points in a row share the hash of a gram inside them. Null text is empty; null
    doc_id and repeated rows stay. Nothing is shuffled; other columns are not read; an empty table gives an empty result.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for ids, texts in _runs(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                codes = [_codes(t) for t in texts]
                found = winnow(codes, k, window, powers)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([len(c) for c in codes], pa.int64()), _list(p.astype(np.int32) for p, _ in found), _list(h.view(np.int64) for _, h in found)],
                    ["doc_id", "n_chars", "positions", "hashes"],
                )
        release()

    return source.mapInArrow(run, "doc_id long, n_chars long, positions array<int>, hashes array<long>")


def _runs(rows: Iterator[tuple[int | None, str]]) -> Iterator[tuple[list[int | None], list[str]]]:
    ids, texts, held = [], [], 0
    for i, text in rows:
        ids.append(i)
        texts.append(text)
        held += len(text)
        if held >= RUN:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _list(arrays) -> pa.ListArray:
    arrays = list(arrays)
    cuts = np.cumsum([0, *[len(a) for a in arrays]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, positions array<int>, hashes array<long>, "
    "edited_positions array<int>, edited_hashes array<long>, near_edited double, near_next double"
)


def _in_order(source: DataFrame) -> DataFrame:
    """Rows (doc_id, text, echo) in ranges of ascending doc_id, one a task, each closed by a copy (``echo``) of the next range's first row.

    A first pass deals only (doc_id, hash of the text) by range; the least of each range, one a task, are the bounds by which the
    texts are then dealt, once. The first row of a range goes to the range before it as well; that of the first range to the last.
    """
    spark = source.sparkSession
    key = F.struct(F.col("doc_id").isNotNull().alias("has"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h"))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = source.select(key.alias("key")).repartitionByRange(tasks, "key")
    least = sorted(tuple(r["least"]) for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("least")).collect())
    if not least:
        return source.withColumn("echo", F.lit(False))
    kind = "struct<has: boolean, id: bigint, h: bigint>"
    bounds = F.from_json(F.lit(json.dumps([dict(zip(("has", "id", "h"), x, strict=True)) for x in least])), f"array<{kind}>")
    steps = [1 << m for m in reversed(range(len(least).bit_length()))]

    def found(at: Column, step: Column) -> Column:
        """A step of binary search: to the last bound that is not above the key."""
        return F.when(F.get(bounds, at + step) <= F.col("key"), at + step).otherwise(at)

    placed = source.withColumn("key", key).withColumn("place", F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), found))
    own = F.struct("place", F.lit(False).alias("echo"))
    before = F.struct(F.pmod(F.col("place") - 1, F.lit(len(least))).alias("place"), F.lit(True).alias("echo"))
    copies = F.when(F.get(bounds, F.col("place")) == F.col("key"), F.array(own, before)).otherwise(F.array(own))
    rows = placed.select("doc_id", "text", F.col("key.h").alias("h"), F.explode(copies).alias("at")).select("doc_id", "text", "h", "at.*")
    return rows.repartitionById(len(least), "place").sortWithinPartitions("place", "echo", "doc_id", "h").select("doc_id", "text", "place", "echo")


def edited_fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, share: int = 4) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the fingerprints of its text and of its edited text, and likenesses.

    Edited, the last floor(n_chars / ``share``) code points are replaced by the first as many (or all) of the next document, in
    ascending doc_id; after the last comes the first. Returned: doc_id, n_chars, edited_sha256, positions, hashes,
    edited_positions, edited_hashes, near_edited and near_next: the Jaccard index of the text's hashes with the edited
    text's and with the next document's.

    Texts are shuffled once, by range (see ``_in_order``), and each range is read row by row. Null text is empty, null doc_ids come first,
    repeated doc_ids are ordered by a hash of their texts. A single document is its own next one. Two empty
    texts are alike (1). Other columns are not read; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, size, place, done = Powers(), [], 0, None, False
        known: tuple[np.ndarray, np.ndarray] | None = None  # the fingerprint of held[0]
        for batch in batches:
            for i, text, where, echo in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "place", "echo")), strict=True):
                if where != place:
                    held, size, place, known, done = [], 0, where, None, False
                if done:
                    continue
                held.append((i, text))
                size += len(text)
                done = echo  # the next range's first row: what follows are repeats of it
                if (size >= RUN or done) and len(held) > 1:
                    out, known = _pairs(held, known, k, window, share, powers)
                    yield out
                    held, size = held[-1:], len(held[-1][1])
        release()

    return _in_order(source).mapInArrow(run, EDITED)


def _pairs(rows: list[tuple[int | None, str]], known, k: int, window: int, share: int, powers: Powers):
    """Results for all rows but the last, which is only the next of the one before it; and the last one's fingerprint."""
    codes = [_codes(t) for _, t in rows]
    own = ([known] if known else []) + winnow(codes[1:] if known else codes, k, window, powers)
    cut = [len(c) // share for c in codes]
    edited = [np.concatenate((a[: len(a) - n], b[:n])) for a, b, n in zip(codes, codes[1:], cut, strict=False)]
    theirs = winnow(edited, k, window, powers)
    digest = [hashlib.sha256((a[: len(a) - n] + b[:n]).encode()).hexdigest() for (_, a), (_, b), n in zip(rows, rows[1:], cut, strict=False)]
    out = pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in rows[:-1]], pa.int64()), pa.array([len(c) for c in codes[:-1]], pa.int64()), pa.array(digest, pa.string()),
         _list(p.astype(np.int32) for p, _ in own[:-1]), _list(h.view(np.int64) for _, h in own[:-1]),
         _list(p.astype(np.int32) for p, _ in theirs), _list(h.view(np.int64) for _, h in theirs),
         pa.array([likeness(a[1], b[1]) for a, b in zip(own, theirs, strict=False)], pa.float64()),
         pa.array([likeness(a[1], b[1]) for a, b in zip(own, own[1:], strict=False)], pa.float64())],
        [x.split()[0] for x in EDITED.split(", ")],
    )
    return out, own[-1]
