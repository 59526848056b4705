"""Drop lines that many documents share, keeping each in one document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom, bloom_of
from .common import map_batches, materialize, text_only, utf8

#: Dropped keys applied where texts are scanned: at most so many (24 bytes each); beyond that they are joined.
MOST_KEYS = 1_000_000
STRIPPED = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The normalised line's 128-bit hash, or None if it is shorter than ``min_chars`` code points."""
    line = line.strip(STRIPPED)
    if len(line) < min_chars or (not line.isascii() and len(line.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(line.lower())  # bytes.lower() folds A-Z only


def _halves(keys: list[bytes]) -> tuple[pa.Array, pa.Array]:
    pairs = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
    return pa.array(pairs[:, 0]), pa.array(pairs[:, 1])


def _line_keys(min_chars: int, wanted: Bloom | None = None):
    """(doc_id, key) once a document, of the keys that ``wanted`` lets pass."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys: list[bytes] = []
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            for i, text in enumerate(utf8(batch.column("text"))):
                found = {line_key(x, min_chars) for x in text.split(b"\n")} if text else set()
                found.discard(None)
                keys.extend(found)
                counts[i] = len(found)
            ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), counts)
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *_halves(keys)], ["doc_id", "ha", "hb"])
            return out if wanted is None else out.filter(pa.array(wanted.has(out.column("ha"))))

        return step

    return make


def _without(min_chars: int, gone: pa.Table):
    """Texts without the lines whose key is in ``gone`` (ha, hb, keeper), but for the keeper's."""
    order = np.lexsort((gone.column("hb").to_numpy(), gone.column("ha").to_numpy()))
    ha, hb, keeper = (gone.column(c).to_numpy()[order] for c in ("ha", "hb", "keeper"))
    longest = int(np.unique(ha, return_counts=True)[1].max()) if len(ha) else 0

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column("doc_id").to_pylist()
            lines = [(text or b"").split(b"\n") for text in utf8(batch.column("text"))]
            keys, where = [], []
            for i, own in enumerate(lines):
                for k, line in enumerate(own if ids[i] is not None else ()):
                    key = line_key(line, min_chars)
                    if key is not None:
                        keys.append(key)
                        where.append((i, k))
            found = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
            at = np.searchsorted(ha, found[:, 0])
            drop: list[set[int]] = [set() for _ in lines]
            for step_on in range(longest):  # equal first halves, all but never more than one
                spot = np.minimum(at + step_on, len(ha) - 1)
                for hit in np.flatnonzero((ha[spot] == found[:, 0]) & (hb[spot] == found[:, 1])):
                    i, k = where[hit]
                    if keeper[spot[hit]] != ids[i]:
                        drop[i].add(k)
            texts = [b"\n".join(x for k, x in enumerate(own) if k not in out).decode() for own, out in zip(lines, drop, strict=True)]
            others = [c for c in batch.schema.names if c != "text"]
            return pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in others], pa.array(texts, pa.string()), pa.array([len(x) for x in lines], pa.int64()), pa.array([len(x) for x in drop], pa.int64())],
                [*others, "text", "n_lines", "n_dropped"],
            )

        return step

    return make


def _reassemble(min_chars: int):
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(utf8(batch.column("text")), batch.column("drop").to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                kept = lines
                if drop:
                    gone = {np.array([d["ha"], d["hb"]], dtype=np.int64).tobytes() for d in drop}
                    kept = [x for x in lines if line_key(x, min_chars) not in gone]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                texts.append(b"\n".join(kept).decode())
            others = [batch.column(c) for c in batch.schema.names if c not in ("text", "drop")]
            names = [c for c in batch.schema.names if c not in ("text", "drop")]
            return pa.RecordBatch.from_arrays(
                [*others, pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                [*names, "text", "n_lines", "n_dropped"],
            )

        return step

    return make


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, most_keys: int = MOST_KEYS, carry: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text without dropped lines, n_lines, n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least
    ``min_chars`` code points held by at least ``min_docs`` documents lose all their lines, but for those in
    the largest doc_id that holds the key. The lines that stay keep their order and form.

    Lines are exploded to 128-bit hashes once a document. A first count with map-side combining finds the keys
    that may be frequent; only their lines (behind a Bloom filter of bounded size) are then counted by
    distinct document, so a hot line costs a row a document and never meets in one task. Up to ``most_keys``
    dropped keys, with their keepers, go to the tasks that scan the texts, and no text is shuffled; beyond that
    the keys that a document loses are joined to it.

    Null or empty texts are one empty line. Rows without doc_id count for no key and lose no line. Repeated
    rows of a doc_id count once and lose the same lines. An empty table gives an empty result.
    Other columns are not read; with ``carry`` they come along as the struct ``carried``.
    """
    source = text_only(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    whole, extra = source, ""
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if carry else []
    if others:
        whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("carried"))
        extra = f", carried {whole.schema['carried'].dataType.simpleString()}"
    lines = map_batches(source.filter("doc_id is not null"), _line_keys(min_chars), "doc_id long, ha long, hb long")
    maybe = materialize(lines.groupBy("ha", "hb").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("ha", "hb"), "frequent")
    wanted = bloom_of(maybe, "ha")
    lines = map_batches(source.filter("doc_id is not null"), _line_keys(min_chars, wanted), "doc_id long, ha long, hb long")
    holders = materialize(lines.join(maybe, ["ha", "hb"]), "holders")
    dropped = materialize(
        holders.groupBy("ha", "hb")
        .agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n") >= min_docs)
        .select("ha", "hb", "keeper"),
        "dropped",
    )
    schema = f"doc_id long{extra}, text string, n_lines long, n_dropped long"
    if dropped.count() <= most_keys:
        return map_batches(whole, _without(min_chars, dropped.toArrow()), schema)
    losers = holders.join(dropped, ["ha", "hb"]).filter("doc_id <> keeper")
    drop = losers.groupBy("doc_id").agg(F.collect_set(F.struct("ha", "hb")).alias("drop"))
    joined = whole.join(materialize(drop, "drops"), "doc_id", "left")
    return map_batches(joined, _reassemble(min_chars), schema)
