"""Merkle manifest of a dataset: a hash tree for each language over its ordered rows, and one over the trees' roots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, release

FANOUT = 8
PAGE_LEVELS = 4  # a page: the leaves under a node of this level, whose inner nodes a task rebuilds at once
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def depth_of(n: int, fanout: int = FANOUT) -> int:
    """Levels above ``n`` leaves, until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def leaf_digest(columns: dict[str, Column]) -> Column:
    """SHA-256 of all fields, each with its UTF-8 length before it, ``-`` where it is null."""
    parts = []
    for c in columns.values():
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.encode(F.concat(*parts), "utf-8"), 256)


class Range:
    """The mountain range of one run of neighbouring leaves of a tree: for each level the nodes not yet carried upwards.

    ``push`` takes the next node of a level. A full, aligned group of ``fanout`` nodes carries: its parent, a completed peak, is pushed
    one level up; and so does the tree's last group, however short, with no padding. A group whose beginning lies before
    the run can't be completed here, nor can what is left at the end: these nodes are edges, for ``merged``.
    """

    def __init__(self, tree: tuple, leaves: int, first: int, fanout: int = FANOUT) -> None:
        self.tree, self.fanout, self.next = tree, fanout, first
        self.sizes = [leaves]
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // fanout))
        self.stack: list[tuple[int, list[str]]] = []  # by level: index of the first node held, digests
        self.made: list[tuple[int, int, str]] = []  # completed peaks: level, index, digest
        self.edges: list[tuple[int, int, str]] = []

    def push(self, digest: str) -> None:
        at, level = self.next, 0
        self.next += 1
        while True:
            if level:
                self.made.append((level, at, digest))
            if self.sizes[level] == 1:
                return  # the root
            if level == len(self.stack):
                self.stack.append((at, []))
            start, held = self.stack[level]
            if not held:
                start = at
            held.append(digest)
            self.stack[level] = (start, held)
            if (at + 1) % self.fanout and at + 1 < self.sizes[level]:
                return
            self.stack[level] = (at + 1, [])
            if start % self.fanout:
                self.edges.extend((level, start + i, d) for i, d in enumerate(held))
                return
            level, at, digest = level + 1, at // self.fanout, _hash(held)

    def close(self) -> None:
        for level, (start, held) in enumerate(self.stack):
            self.edges.extend((level, start + i, d) for i, d in enumerate(held))
        self.stack = []


NODES = "tree long, level int, idx long, digest string, edge boolean"


def _peaks(fanout: int):
    """Node records of a partition's leaves (tree, idx, n, digest), which come in order; a break begins a new run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Range | None = None
        for batch in batches:
            out: list[tuple] = []
            for tree, idx, n, digest in zip(*(batch.column(c).to_pylist() for c in ("tree", "idx", "n", "digest")), strict=True):
                if now is None or now.tree != tree or now.next != idx:
                    out.extend(_drained(now, True))
                    now = Range(tree, n, idx, fanout)
                now.push(digest)
            out.extend(_drained(now, False))
            yield _records(out)
        yield _records(_drained(now, True))
        release()

    return run


def _drained(now: Range | None, ended: bool) -> list[tuple]:
    if now is None:
        return []
    if ended:
        now.close()
    # an edge above the leaves was recorded as made when it was carried up; here it only gets its mark
    out = [(now.tree, level, i, d, False) for level, i, d in now.made] + [(now.tree, level, i, d, True) for level, i, d in now.edges]
    now.made, now.edges = [], []
    return out


def _records(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["tree", "level", "idx", "digest", "edge"])


def merged(records: DataFrame, levels: int, fanout: int = FANOUT) -> DataFrame:
    """All inner nodes (tree, level, idx, digest) from the records of all partitions.

    Level by level, edges of neighbouring partitions meet by parent, ``fanout`` at most in a group, and make the next
    level's edges. There are a few edges a partition and level, whatever the number of rows.
    """
    found = [records.filter("not edge").select("tree", "level", "idx", "digest")]
    above = None
    for level in range(levels):
        edges = records.filter(F.col("edge") & (F.col("level") == level)).select("tree", "idx", "digest")
        if above is not None:
            edges = edges.unionByName(above)
        groups = edges.groupBy("tree", F.floor(F.col("idx") / fanout).cast("long").alias("parent"))
        made = groups.agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))
        joined = F.array_join(F.transform("run", lambda x: x["digest"]), "")
        above = made.select("tree", F.col("parent").alias("idx"), F.sha2(F.encode(joined, "utf-8"), 256).alias("digest"))
        found.append(above.withColumn("level", F.lit(level + 1)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _cell(idx: str | Column, levels: int, fanout: int) -> Column:
    return F.floor((F.col(idx) if isinstance(idx, str) else idx) / fanout**levels).cast("long")


def build(leaves: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, int]:
    """All inner nodes of the trees over ``leaves`` (tree, part, idx, n, digest), and the levels of the highest one.

    ``part`` numbers stretches of leaves that stand together: each is read in order by one task.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels = depth_of(most, fanout)
    tasks = max(1, int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = leaves.select("part", "tree", "idx", "n", "digest").repartition(tasks, "part").sortWithinPartitions("part", "tree", "idx")
    records = materialize(dealt.select("tree", "idx", "n", "digest").mapInArrow(_peaks(fanout), NODES), "node_records")
    return materialize(merged(records, levels, fanout), "nodes"), levels


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``place``, the row's number from 0 in ascending ``order``, and ``part``, the range (a task's) that it stands in.

    Rows are dealt by range and sorted there, then counted: a row's place is its place in the range and the rows of all ranges before.
    """
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ordered = materialize(ordered, "ordered").withColumns({"part": F.shiftright("at", 33), "spot": F.col("at").bitwiseAND((1 << 33) - 1)})
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # over one row a range
    counts = ordered.groupBy("part").agg(F.count("*").alias("held")).select("part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    return ordered.join(counts, "part").withColumn("place", F.col("before") + F.col("spot")).drop("at", "before", "spot")


def paths(nodes: DataFrame, sizes: DataFrame, low: int, levels: int, above: DataFrame | None = None, fanout: int = FANOUT) -> DataFrame:
    """For each node of level ``low``: (tree, idx, path), the runs that it and its ancestors stand in, upwards to the root.

    ``path`` is an array of (run, spot): the digests of a run and the ancestor's place in it. ``sizes`` (tree, n) has the leaves of each
    tree; ``above`` (tree, path) what follows over a tree's root. Nodes of one run meet by parent, ``fanout`` at most.
    """
    kind = "array<struct<run: array<string>, spot: int>>"
    roots = sizes.select("tree", F.lit(0).cast("long").alias("idx"))
    done = (roots.join(above, "tree") if above is not None else roots.withColumn("path", F.array().cast(kind))).select("tree", "idx", "path")
    height = F.lit(0)
    for level in range(levels):
        height = F.when(F.col("n") > fanout**level, level + 1).otherwise(height)
    tall = sizes.withColumn("height", height)
    now = done.join(tall.filter(F.col("height") == levels).select("tree"), "tree")
    for level in reversed(range(low, levels)):
        run = nodes.filter(F.col("level") == level).groupBy("tree", _cell("idx", 1, fanout).alias("parent")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))
        joined = run.join(now.select("tree", F.col("idx").alias("parent"), "path"), ["tree", "parent"])
        each = joined.select("tree", "path", F.transform("run", lambda x: x["digest"]).alias("run"), F.posexplode(F.transform("run", lambda x: x["idx"])).alias("spot", "idx"))
        now = each.select("tree", "idx", F.concat(F.array(F.struct("run", "spot")), "path").cast(kind).alias("path"))
        here = done.join(tall.filter(F.col("height") == level).select("tree"), "tree")
        now = now.unionByName(here)
    if levels <= low:  # every tree lies below
        return done
    low_ones = done.join(tall.filter(F.col("height") < low).select("tree"), "tree")
    return now.unionByName(low_ones)


@dataclass
class Manifest:
    """What ``merkle_manifest`` found: tables in the shared folder and the root.

    ``leaves``: tree, idx, n, digest and the row's own columns; ``nodes``: tree, level, idx, digest of every inner
    node; ``trees``: tree, lang, n, subroot, in order; ``top``: the nodes over the subroots; ``root``: null for an empty table.
    """

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    top: DataFrame
    levels: int
    top_levels: int
    root: str | None
    fanout: int


def merkle_manifest(docs: DataFrame, fanout: int = FANOUT) -> Manifest:
    """Leaves are the rows of ``docs`` (doc_id, source, lang, n_chars, text), by ``leaf_digest``; trees are languages.

    In a tree, leaves ascend by doc_id (null first, repeated ones by digest); while several nodes remain, every ``fanout``
    neighbours (the last run: fewer, even one) become the digest of their digests. The subroots, ordered by language (null
    first, bytewise), are the leaves of one more such tree, which gives the root.

    Texts are hashed where they are read; digests alone are dealt by range, so a language with most rows is spread over tasks. A task sees
    the place of its leaves by the counts of the ranges before it, and builds what lies in its range (``Range``); ``merged`` joins the edges.
    Rows are kept, nulls and repeats included. Other columns are not read. An empty table has no tree and no root.
    """
    kinds = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
    row = {c: F.col(c).cast(t) for c, t in kinds.items()}
    tampered = F.crc32(F.encode(row["doc_id"].cast("string"), "utf-8")) % 3 == 0
    changed = leaf_digest(row | {"text": F.translate(row["text"], _UPPER, _LOWER)})
    digests = docs.select(row["doc_id"].alias("doc_id"), row["lang"].alias("lang"), leaf_digest(row).alias("digest"), F.when(tampered, changed).alias("tampered"))
    placed = numbered(materialize(digests, "digests"), "lang", "doc_id", "digest")
    own = placed.groupBy("lang").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    own = materialize(own.withColumn("tree", F.col("first")), "trees")  # a tree is named by the place of its first leaf
    keyed = placed.join(own.withColumnRenamed("lang", "own_lang"), F.col("lang").eqNullSafe(F.col("own_lang")))
    leaves = materialize(keyed.select("tree", "part", (F.col("place") - F.col("first")).alias("idx"), "n", "digest", "doc_id", "tampered"), "leaves")
    nodes, levels = build(leaves, fanout)

    every = nodes.unionByName(leaves.filter("n = 1").select("tree", F.lit(0).alias("level"), F.lit(0).cast("long").alias("idx"), "digest"))
    level = F.lit(0)
    for k in range(levels):
        level = F.when(F.col("n") > fanout**k, k + 1).otherwise(level)
    subroots = own.withColumn("level", level).join(every, ["tree", "level"]).select("tree", "lang", "n", F.col("digest").alias("subroot"))
    trees = materialize(subroots, "subroots")
    count = trees.count()
    ranked = numbered(trees.select(F.col("tree").alias("own"), F.col("subroot").alias("digest")), "own")
    over = materialize(ranked.select(F.lit(0).cast("long").alias("tree"), "part", F.col("place").alias("idx"), F.lit(count).cast("long").alias("n"), "digest", "own"), "top_leaves")
    top, top_levels = build(over, fanout)
    every = top.unionByName(over.select("tree", F.lit(0).alias("level"), "idx", "digest"))
    root = every.filter(F.col("level") == top_levels).select("digest").first()
    trees = trees.join(over.select(F.col("own").alias("tree"), F.col("idx").alias("spot")), "tree")
    return Manifest(leaves, nodes, trees, every, levels, top_levels, root[0] if root else None, fanout)


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _fold(digest: str, path: list[tuple[list[str], int]]) -> str:
    for run, spot in path:
        digest = _hash([*run[:spot], digest, *run[spot + 1 :]])
    return digest


def _siblings(path: list[tuple[list[str], int]]) -> str:
    return "".join("".join(run[:spot]) + "".join(run[spot + 1 :]) for run, spot in path)


def _page_proofs(page_levels: int, fanout: int, root: str | None):
    def prove(leaves: pa.Table, above: pa.Table) -> pa.Table:
        rows = sorted(zip(*(leaves.column(c).to_pylist() for c in ("idx", "doc_id", "digest", "tampered", "n")), strict=True))
        path = [(x["run"], x["spot"]) for x in above.column("path")[0].as_py()]
        subroot = above.column("subroot")[0].as_py()
        first, n = rows[0][0], rows[0][4]
        inner = [[r[2] for r in rows]]
        levels = min(page_levels, depth_of(n, fanout))  # below the page's own node
        while len(inner) < levels:
            inner.append([_hash(inner[-1][k : k + fanout]) for k in range(0, len(inner[-1]), fanout)])
        upward = _siblings(path)
        out = []
        for idx, doc_id, digest, tampered, _ in rows:
            own, at = [], idx - first
            for level in inner[:levels]:
                start = at - at % fanout
                own.append((level[start : start + fanout], at - start))
                at //= fanout
            own_path = own + path
            folded = _fold(tampered or digest, own_path)
            proof = hashlib.sha256((_siblings(own) + upward).encode()).hexdigest()
            out.append((doc_id, digest, subroot, root, proof, folded, folded == root))
        kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PROOF.split(", ")])

    return prove


def merkle_proofs(made: Manifest) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256 (digest of all siblings up to the root), folded_root, verified.

    ``folded_root`` folds the tampered leaf, or the original where nothing is tampered with, with the original siblings up to the root.
    A task takes a page of at most ``fanout ** PAGE_LEVELS`` leaves of a tree and rebuilds the nodes inside it; what stands above comes
    with the page. So no tree, however large, meets in one task.
    """
    fanout = made.fanout
    trees = made.trees.select("tree", "n", "subroot", "spot")
    single = made.top.select("tree").distinct().withColumn("n", F.lit(fanout**made.top_levels).cast("long"))
    upper = paths(made.top, single, 0, made.top_levels, None, fanout)
    upper = upper.join(trees.select(F.col("tree").alias("own"), F.col("spot").alias("idx")), "idx").select(F.col("own").alias("tree"), "path")
    over = paths(made.nodes, trees.select("tree", "n"), PAGE_LEVELS, made.levels, upper, fanout)
    over = materialize(over.join(trees.select("tree", "subroot"), "tree").withColumnRenamed("idx", "page"), "paths")
    leaves = made.leaves.withColumn("page", _cell("idx", PAGE_LEVELS, fanout))
    groups = leaves.groupBy("tree", "page").cogroup(over.groupBy("tree", "page"))
    return groups.applyInArrow(_page_proofs(PAGE_LEVELS, fanout, made.root), PROOF)
