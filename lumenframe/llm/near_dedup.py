"""Near-duplicate documents: MinHash banding, verification, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom, bloom_of
from .common import bound_batches, discard, map_batches, materialize, release, text_only, utf8
from .components import connected_components
from .shingles import Powers, mix, shingle_set, word_hashes

SEED = 20_240_117
BLOCK_ITEMS = 1 << 16  # shingles in a block, about
PACKED_ITEMS = 1 << 20  # shingles of small buckets that one call takes, about
TASK_ITEMS = 1 << 22  # shingles that one task takes, about


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 1 << 32, count, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """``count`` universal-hash minima for each non-empty set, as rows of uint32."""
    a, b = _permutations(count)
    out = np.empty((len(sets), count), dtype=np.uint32)
    at = 0
    while at < len(sets):
        end, held = at, 0
        while end < len(sets) and (end == at or held + len(sets[end]) <= 100_000):
            held += len(sets[end])
            end += 1
        starts = np.cumsum([0, *[len(s) for s in sets[at : end - 1]]])
        joined = np.concatenate(sets[at:end])
        x = (joined ^ (joined >> np.uint64(32))).astype(np.uint32)
        y = np.empty_like(x)
        for k in range(count):
            np.multiply(x, a[k], out=y)
            np.add(y, b[k], out=y)
            out[at:end, k] = np.minimum.reduceat(y, starts)
        at = end
    return out


def _sketch(words: int, bands: int, rows: int):
    def make():
        powers = Powers()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(w, words) for w in word_hashes(utf8(batch.column("text")), powers)]
            n = np.array([len(s) for s in sets], dtype=np.int64)
            some = np.flatnonzero(n)
            fa, fb = np.zeros(len(sets), dtype=np.uint64), np.zeros(len(sets), dtype=np.uint64)
            offsets = np.zeros(len(sets) + 1, dtype=np.int32)
            keys = np.zeros(0, dtype=np.uint64)
            if len(some):
                with np.errstate(over="ignore"):
                    for i in some:
                        fa[i] = np.add.reduce(mix(sets[i] ^ np.uint64(0x51ED270B)))
                        fb[i] = np.add.reduce(mix(sets[i] + np.uint64(0x2545F491)))
                keys = band_keys(signatures([sets[i] for i in some], bands * rows), bands, rows).reshape(-1)
                offsets[1:] = np.cumsum((n > 0) * bands)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(fa.view(np.int64)), pa.array(fb.view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64)))],
                ["doc_id", "n_shingles", "fa", "fb", "bands"],
            )

        return step

    return make


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature; the band's number is part of the key."""
    part = sig.reshape(-1, bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), part.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for r in range(rows):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + part[:, :, r])
    return h


def _chosen(words: int, count: int, wanted: Bloom, full: bool):
    """Signature, and with ``full`` the whole set, of the documents that ``wanted`` lets pass."""

    def make():
        powers = Powers()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            batch = batch.filter(pa.array(wanted.has(batch.column("doc_id"))))
            sets = [shingle_set(w, words) for w in word_hashes(utf8(batch.column("text")), powers)]
            keep = [i for i, s in enumerate(sets) if len(s)]
            batch, sets = batch.take(pa.array(keep, pa.int64())), [sets[i] for i in keep]
            sig = pa.array([row.tobytes() for row in signatures(sets, count)] if sets else [], pa.binary())
            columns = [batch.column("doc_id"), sig]
            if full:
                offsets = np.cumsum([0, *[len(s) for s in sets]]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64))))
            return pa.RecordBatch.from_arrays(columns, ["node", "sig", "items"][: len(columns)])

        return step

    return make


def _linked(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    inter = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * inter >= similarity * (len(a) + len(b) - inter)


def _block_links(count: int, least: int, similarity: int):
    """Of the members of a block (or of two), links that join its components; every pair across them is settled.

    Pairs are taken from the best agreeing signatures down. One whose components a link has joined by then needs
    no check; each other one whose signatures agree in ``least`` minima or more is checked on full sets.
    """

    def one(node, comp, side, sig, sets, same, out) -> None:
        n = np.array([len(x) for x in sets])
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        pairs = []
        for k in range(len(node)):
            other = (comp != comp[k]) & ((np.arange(len(node)) > k) if same else (side > side[k]))
            other &= 100 * np.minimum(n, n[k]) >= similarity * np.maximum(n, n[k])
            at = np.flatnonzero(other)
            agree = (sig[at] == sig[k]).sum(axis=1)
            good = agree >= least
            pairs += [(-c, k, x) for c, x in zip(agree[good].tolist(), at[good].tolist(), strict=True)]
        for _, k, x in sorted(pairs):
            a, b = root(int(comp[k])), root(int(comp[x]))
            if a != b and _linked(sets[k], sets[x], similarity):
                above[max(a, b)] = min(a, b)
                out.append((int(node[k]), int(node[x])))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("band")
        column = {c: table.column(c).to_numpy() for c in ("band", "node", "component", "block", "i", "j")}
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, count)
        items = table.column("items").combine_chunks()
        flat, cuts = items.values.to_numpy(), items.offsets.to_numpy()
        out: list[tuple[int, int]] = []
        starts = np.flatnonzero(np.concatenate(([True], column["band"][1:] != column["band"][:-1])))
        for s, e in zip(starts, [*starts[1:], len(table)], strict=True):
            sets = [flat[cuts[r] : cuts[r + 1]] for r in range(s, e)]
            one(column["node"][s:e], column["component"][s:e], column["block"][s:e], sig[s:e], sets, column["i"][s] == column["j"][s], out)
        release()
        return pa.table([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    return run


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    similarity: int = 80,
    bands: int = 32,
    rows: int = 5,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked when ``100 * |intersection| >= similarity * |union|`` of their sets of
    distinct ``words``-word shingles; a component is everything reachable over links.

    1. One pass hashes shingles and takes ``bands * rows`` universal-hash minima, kept as a key a band.
       Documents with equal sets form a class, which its smallest doc_id represents from here on.
    2. In each band bucket the smallest member is paired with the others (linear, not all pairs). Pairs
       are verified on signatures, then on full sets; components follow by large-star/small-star.
    3. Buckets that still hold several components are compared in full, in blocks of about ``BLOCK_ITEMS``
       shingles that are dealt over tasks. A block tests its pairs across components on signatures and then on
       full sets, best first, and returns a link only where it joins two components. So no bucket is capped, no link
       between components is lost, and no list of pairs arises.

    Texts are never shuffled: signatures and sets of candidates are made where the text is scanned, behind
    a Bloom filter of bounded size, and only those are. With 32 bands of 5 a pair at exactly 0.8 shares a bucket
    but for 3 in a million; its signature falls below the verification limit (4.5 standard errors) as rarely.

    Null or empty texts have no shingles: linked with nothing, their own component. Rows without doc_id
    keep a null component and kept=true. Repeated rows of a doc_id are one document. An empty table
    gives an empty result. Other columns of ``docs`` are not read.
    """
    count = bands * rows
    j = similarity / 100
    least = int(np.floor(count * (j - 4.5 * np.sqrt(j * (1 - j) / count))))
    source = text_only(docs, "doc_id")
    source = source.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = materialize(map_batches(source, _sketch(words, bands, rows), "doc_id long, n_shingles long, fa long, fb long, bands array<long>"), "sketch")

    classes = materialize(
        sketch.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("fa", "fb", "n_shingles")
        .agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands")),
        "classes",
    )
    banded = classes.select("node", F.col("n_shingles").cast("int").alias("n"), F.explode("bands").alias("band"))
    groups = banded.groupBy("band").agg(F.min(F.struct("node", "n")).alias("center"), F.count("*").alias("members")).filter("members > 1")
    shared = materialize(banded.join(groups, "band").select("band", "node", "n", "members", F.col("center.node").alias("center"), F.col("center.n").alias("m")), "buckets")

    def chosen(nodes: DataFrame, full: bool, label: str) -> DataFrame:
        """(node, sig[, items]) of the given nodes and perhaps a few more, a row each."""
        found = map_batches(source, _chosen(words, count, bloom_of(nodes, "node"), full), "node long, sig binary" + ", items array<long>" * full)
        return materialize(found.dropDuplicates(["node"]), label)

    def beside(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
        side = lambda k: values.select(F.col("node").alias(k), F.col(value).alias(f"v{k}"))
        return pairs.join(side("a"), "a").join(side("b"), "b")

    near = 100 * F.least("n", "m") >= similarity * F.greatest("n", "m")
    stars = shared.filter("node > center").filter(near).select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    pairs = materialize(stars, "pairs")
    sigs = chosen(ends(pairs), False, "signatures")
    aligned = F.aggregate(
        F.sequence(F.lit(0), F.lit(count - 1)),
        F.lit(0),
        lambda n, i: n + (F.substring("va", i * 4 + 1, F.lit(4)) == F.substring("vb", i * 4 + 1, F.lit(4))).cast("int"),
    )
    likely = materialize(beside(pairs, sigs, "sig").filter(aligned >= least).select("a", "b"), "likely")
    discard(pairs, sigs)
    inter, both = F.size(F.array_intersect("va", "vb")), F.size("va") + F.size("vb")
    sets = chosen(ends(likely), True, "sets")
    links = materialize(beside(likely, sets, "items").filter(100 * inter >= similarity * (both - inter)).select("a", "b"), "links")
    discard(likely, sets)
    named = connected_components(links)

    # a bucket of two was settled above; of the others, those still holding several components remain
    placed = shared.filter("members > 2").select("band", "node", "n").join(named, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.sum("n").alias("total")).filter("x < y")
    placed = materialize(placed.join(mixed.select("band", "total"), "band"), "unsettled")
    if not placed.isEmpty():
        bound_batches(docs.sparkSession)
        items = placed.agg(F.sum(F.when(F.col("total") <= BLOCK_ITEMS, F.col("n"))).alias("small"), F.sum(F.col("n") * F.ceil(F.col("total") / BLOCK_ITEMS)).alias("dealt")).first()
        packs = 1 + (items["small"] or 0) // PACKED_ITEMS
        parts = F.ceil(F.col("total") / BLOCK_ITEMS).cast("int")
        sets = chosen(placed.select("node").distinct(), True, "unsettled_sets")
        dealt = (
            placed.join(sets, "node")
            .withColumn("block", F.pmod(F.xxhash64("node", "band"), parts).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
            .withColumn("i", F.least("block", "other"))
            .withColumn("j", F.greatest("block", "other"))
            .withColumn("pack", F.when(parts > 1, F.col("band")).otherwise(F.pmod(F.col("band"), F.lit(packs))))
        )
        dealt = dealt.repartition(int(1 + items["dealt"] // TASK_ITEMS), "pack", "i", "j")
        more = dealt.groupBy("pack", "i", "j").applyInArrow(_block_links(count, least, similarity), "a long, b long")
        more = materialize(more, "more_links")
        discard(placed, sets)
        named = connected_components(links.unionByName(more))

    classed = classes.select("fa", "fb", "n_shingles", "node").join(named, "node", "left").select(
        "fa", "fb", "n_shingles", F.coalesce("component", "node").alias("component")
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (
        sketch.select("doc_id", "n_shingles", "fa", "fb")
        .join(classed, ["fa", "fb", "n_shingles"], "left")
        .select(
            "doc_id",
            "n_shingles",
            component.alias("component_id"),
            F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        )
    )
