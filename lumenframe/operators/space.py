"""Nearest rows by a partition of space, exactly: blocks with bounding boxes, and a second round only where a box may hold something nearer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources import workspace

LEAF_ROWS = 1_024  # rows of a leaf, about; more leaves than MOST_LEAVES (MANY_LEAVES of few keys) aren't made, they grow instead
MOST_LEAVES, MANY_LEAVES, FEW_KEYS = 8_192, 131_072, 8
SAMPLED = 16  # rows of the sample from which the planes are taken, a leaf
GROUP_ROWS = 8_192  # rows of either side that a task meets at once
TILE = 1 << 18  # distances worked out at once
RUN = 128  # queries near each other that are compared with the boxes at once
PIECE, STREAM = 2_048, 4_096  # of many keys: queries of a task; rows that it reads at once
CLOSE = 64  # boxes near a run among which each of its queries finds its home
WINDOW = 32  # rows of a leaf next to a query along one key that are tried before all of them


@dataclass
class Boxes:
    """For each leaf its number, least and greatest value of each key (NaN without one), rows held and keys that it has values of."""

    keys: list[str]
    number: np.ndarray
    low: np.ndarray
    high: np.ndarray
    held: np.ndarray
    filled: np.ndarray

    def some(self, at: np.ndarray) -> Boxes:
        return Boxes(self.keys, self.number[at], self.low[at], self.high[at], self.held[at], self.filled[at])

    def far(self, q: np.ndarray, to: np.ndarray | None = None) -> np.ndarray:
        """Squared distances from points (or boxes from ``q`` to ``to``) to boxes, scaled up by the share of keys that both have; inf if none."""
        to = q if to is None else to
        out, shared = np.zeros((len(q), len(self.number))), np.zeros((len(q), len(self.number)))
        for j in range(q.shape[1]):
            gap = np.maximum(np.maximum(self.low[None, :, j] - to[:, j, None], q[:, j, None] - self.high[None, :, j]), 0.0)
            both = np.isfinite(gap)
            out += np.where(both, gap * gap, 0.0)
            shared += both
        return np.where(shared > 0, out * q.shape[1] / np.maximum(shared, 1), np.inf)


@dataclass
class Leaves:
    """Rows with ``__leaf``, and the boxes of the leaves.

    Rows with the same keys missing share a tree of planes; the planes come from a sample, the boxes from all rows, so the sample decides the work but never a result.
    """

    rows: DataFrame
    boxes: Boxes
    planes: Planes


def _planes(sample: np.ndarray, leaves: int) -> dict[int, list]:
    """For each pattern of present keys a tree: [key, value, left, right] or a leaf's number."""
    masks = (np.isfinite(sample) @ (1 << np.arange(sample.shape[1]))).astype(np.int64)
    least = max(2, len(sample) // max(leaves, 1))
    trees, count = {}, 0

    def grow(x: np.ndarray):
        nonlocal count
        spread = np.nanmax(x, axis=0) - np.nanmin(x, axis=0) if len(x) and x.shape[1] else np.zeros(0)
        if len(x) <= least or not len(spread) or not spread.max() > 0:
            count += 1
            return count - 1
        j = int(np.argmax(spread))
        at = float(np.median(x[:, j]))
        left = x[:, j] <= at
        if left.all():  # more than half are the greatest value
            at = float(x[x[:, j] < at, j].max())
            left = x[:, j] <= at
        return [j, at, grow(x[left]), grow(x[~left])]

    for mask in np.unique(masks):
        present = [j for j in range(sample.shape[1]) if mask >> j & 1]
        tree = grow(sample[masks == mask][:, present])
        trees[int(mask)] = _renamed(tree, present)
    return trees


def _renamed(tree, present: list[int]):
    return tree if isinstance(tree, int) else [present[tree[0]], tree[1], _renamed(tree[2], present), _renamed(tree[3], present)]


class Planes:
    """The trees as flat lists, which all rows of a batch go down together, step by step."""

    def __init__(self, trees: dict[int, list]) -> None:
        key, cut, below, self.roots = [], [], [], {}

        def put(tree) -> int:
            if isinstance(tree, int):
                return -1 - tree
            at = len(key)
            key.append(tree[0])
            cut.append(tree[1])
            below.append([0, 0])
            below[at] = [put(tree[2]), put(tree[3])]
            return at

        for mask, tree in trees.items():
            self.roots[mask] = put(tree)
        self.key, self.cut, self.below = np.array(key, dtype=np.int64), np.array(cut, dtype=float), np.array(below, dtype=np.int64).reshape(-1, 2)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        masks = (np.isfinite(x) @ (1 << np.arange(x.shape[1]))).astype(np.int64)
        out = -1 - masks  # a pattern that the sample lacks is a leaf of its own
        for mask in np.unique(masks):
            root = self.roots.get(int(mask))
            if root is None:
                continue
            rows = np.flatnonzero(masks == mask)
            node = np.full(len(rows), root)
            while len(rows):
                done = node < 0
                out[rows[done]] = -1 - node[done]
                rows, node = rows[~done], node[~done]
                node = self.below[node, (x[rows, self.key[node]] > self.cut[node]).astype(np.int64)]
        return out


def leaves_of(rows: DataFrame, keys: list[str], copies: str | None = None, leaf_rows: int | None = None) -> Leaves:
    """Deals ``rows`` (double columns ``keys``, null allowed) into leaves; ``copies`` counts the rows that one stands for."""
    n = rows.count()
    most = MANY_LEAVES if len(keys) <= FEW_KEYS else MOST_LEAVES
    wanted = min(most, max(1, -(-n // (leaf_rows or LEAF_ROWS))))
    some = rows.select(*keys)
    if n > 2 * SAMPLED * wanted:
        some = some.sample(SAMPLED * wanted / n, seed=5)
    sample = some.limit(2 * SAMPLED * most).toPandas().to_numpy(dtype=float).reshape(-1, len(keys))
    planes = Planes(_planes(sample, wanted))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["__leaf"] = planes.leaf(pdf[keys].to_numpy(dtype=float))
            yield pdf

    placed = workspace.keep(rows.mapInPandas(place, T.StructType([*rows.schema.fields, T.StructField("__leaf", T.LongType())])), "leaves")
    weight = F.sum(copies) if copies else F.count("*")
    facts = placed.groupBy("__leaf").agg(weight.alias("held"), *[f(k).alias(f"{f.__name__}{j}") for j, k in enumerate(keys) for f in (F.min, F.max)])
    found = facts.toPandas().sort_values("__leaf")  # a row a leaf
    grid = lambda what: np.stack([found[f"{what}{j}"].to_numpy(dtype=float) for j in range(len(keys))], axis=1)
    low = grid("min")
    return Leaves(placed, Boxes(keys, found["__leaf"].to_numpy(np.int64), low, grid("max"), found["held"].to_numpy(np.int64), np.isfinite(low)), planes)


def sent(queries: DataFrame, leaves: Leaves, choose: Callable[[np.ndarray, pd.DataFrame, np.ndarray], np.ndarray], within: Callable[[pd.DataFrame], np.ndarray] | None = None, close: bool = False) -> DataFrame:
    """``queries`` once for each leaf that ``choose(distances to boxes, batch, places of the boxes)`` marks for them, with ``__leaf``.

    Queries go in runs of near ones: only boxes are looked at that lie no farther from the run's own box than the largest of ``within(batch)``
    (squared), or with ``close`` the ``CLOSE`` nearest ones. So a query isn't compared with all boxes, of which there are the more the more rows there are.
    """
    boxes, planes = leaves.boxes, leaves.planes
    keys, number = boxes.keys, boxes.number
    spread = np.nan_to_num(np.nanmax(boxes.high, axis=0) - np.nanmin(boxes.low, axis=0)) if len(number) else np.zeros(len(keys))
    wide = int(np.argmax(spread))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = RUN if within or close else max(1, TILE // max(len(number), 1))
        for whole in batches:
            x = whole[keys].to_numpy(dtype=float)
            masks, own = (np.isfinite(x) @ (1 << np.arange(x.shape[1]))).astype(np.int64), planes.leaf(x)
            order = np.lexsort((x[:, wide], own, masks))
            parts, whole = [], whole.iloc[order]
            x, masks = x[order], masks[order]
            for group in np.split(np.arange(len(x)), np.flatnonzero(np.diff(masks)) + 1):
                for lo in range(0, len(group), step):
                    at = group[lo : lo + step]
                    pdf = whole.iloc[at]
                    some = np.arange(len(number))
                    if within or close:
                        bound = boxes.far(x[at].min(axis=0, keepdims=True), x[at].max(axis=0, keepdims=True))[0]
                        if within:
                            some = np.flatnonzero(np.isfinite(bound) & (bound <= within(pdf).max()))
                        elif len(some) > CLOSE:
                            some = _closest(boxes, bound)
                    i, s = np.nonzero(choose(boxes.some(some).far(x[at]), pdf, some))
                    parts.append((at[i], number[some[s]]))
            rows = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
            out = whole.iloc[rows].copy()
            out["__leaf"] = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
            yield out

    return queries.mapInPandas(send, T.StructType([*queries.schema.fields, T.StructField("__leaf", T.LongType())]))


def _closest(boxes: Boxes, bound: np.ndarray) -> np.ndarray:
    """Of each pattern of present keys the ``CLOSE`` nearest boxes, those with most rows first: every key that some box has is among them."""
    pattern = boxes.filled @ (1 << np.arange(boxes.filled.shape[1]))
    order = np.lexsort((-boxes.held, bound, pattern))
    start = np.searchsorted(pattern[order], pattern[order])
    return np.sort(order[np.arange(len(order)) - start < CLOSE])


def meet(queries: DataFrame, rows: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pa.Table | None], schema: str, size: int | None = None) -> DataFrame:
    """``kernel(queries, rows)`` for each leaf. A leaf with many of either is met in pieces of about ``size`` rows, each pair of pieces by a task of its own."""
    size = size or GROUP_ROWS
    spark = queries.sparkSession
    held = queries.groupBy("__leaf").agg(F.count("*").alias("q")).join(rows.groupBy("__leaf").agg(F.count("*").alias("r")), "__leaf")
    plan = held.select("__leaf", F.ceil(F.col("q") / size).cast("int").alias("__qs"), F.ceil(F.col("r") / size).cast("int").alias("__rs"))
    plan = workspace.keep(plan, "leaf_plan")  # a row a leaf
    pieces = plan.agg(F.sum(F.col("__qs") * F.col("__rs"))).first()[0] or 0
    deal = lambda df, n: F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(plan, "__leaf").withColumn("__a", deal(queries, "__qs")).withColumn("__b", every("__rs")).drop("__qs", "__rs")
    right = rows.join(plan, "__leaf").withColumn("__b", deal(rows, "__rs")).withColumn("__a", every("__qs")).drop("__qs", "__rs")
    cell = ["__leaf", "__a", "__b"]
    tasks = max(1, min(pieces, max(int(spark.conf.get("spark.sql.shuffle.partitions")), pieces // 32)))  # the bytes are few and the work is not
    left, right = left.repartition(tasks, *cell), right.repartition(tasks, *cell)
    empty = to_arrow_schema(T.StructType.fromDDL(schema)).empty_table()

    def one(q: pa.Table, r: pa.Table) -> pa.Table:
        found = kernel(q.to_pandas(), r.to_pandas()) if len(q) and len(r) else None
        return empty if found is None else found

    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(one, schema)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, key by key: equal points are exactly 0 apart."""
    far = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        far += (a[:, j, None] - b[None, :, j]) ** 2
    return far


def tiles(a: np.ndarray, width: int) -> Iterator[slice]:
    step = max(1, TILE // max(width, 1))
    return (slice(lo, lo + step) for lo in range(0, len(a), step))


def taken(far: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines and places of each line's ``k`` smallest finite distances, of equal ones those of the smaller values, in this order."""
    at_most = np.partition(far, k - 1, axis=1)[:, k - 1] if far.shape[1] > k else np.full(len(far), np.inf)
    i, j = np.nonzero((far <= at_most[:, None]) & np.isfinite(far))
    order = np.lexsort((values[j] if values.ndim == 1 else values[i, j], far[i, j], i))  # values of the columns, or of each line its own
    i, j = i[order], j[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first]


def closest(a: np.ndarray, b: np.ndarray, values: list[np.ndarray], k: int, scale: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the values, lines of ``a``, rows of ``b``, distances) of what ``taken`` gives of ``scale(squared(a, b))``, for each of ``values``.

    A line first meets the ``WINDOW`` rows next to it along the widest key. If the ``k``-th of them is nearer than the window's ends are along that key alone, no other row
    can be as near; the rest of the lines meet all rows.
    """
    rest = np.arange(len(a))
    if len(b) > 4 * WINDOW and k <= WINDOW:
        s = int(np.argmax(b.max(axis=0) - b.min(axis=0)))
        order = np.argsort(b[:, s], kind="stable")
        c, missed = b[order], []
        for part in tiles(a, WINDOW):
            q, lines = a[part], rest[part]
            lo = np.clip(np.searchsorted(c[:, s], q[:, s]) - WINDOW // 2, 0, len(c) - WINDOW)
            at = lo[:, None] + np.arange(WINDOW)
            far = np.zeros(at.shape)
            for j in range(a.shape[1]):
                far += (q[:, j, None] - c[at, j]) ** 2
            far = scale(far)
            edge = np.partition(far, k - 1, axis=1)[:, k - 1]
            below = np.where(lo > 0, scale((q[:, s] - c[np.maximum(lo - 1, 0), s]) ** 2), np.inf)
            above = np.where(lo + WINDOW < len(c), scale((q[:, s] - c[np.minimum(lo + WINDOW, len(c) - 1), s]) ** 2), np.inf)
            sure = np.flatnonzero((below > edge) & (above > edge))
            missed.append(np.setdiff1d(lines, lines[sure]))
            for v, value in enumerate(values):
                i, w = taken(far[sure], value[order[at[sure]]], k)
                yield v, lines[sure][i], order[at[sure][i, w]], far[sure][i, w]
        rest = np.concatenate(missed) if missed else rest
    for part in tiles(rest, len(b)):
        lines = rest[part]
        far = scale(squared(a[lines], b))
        for v, value in enumerate(values):
            i, w = taken(far, value, k)
            yield v, lines[i], w, far[i, w]


def kth(near: str | Column, k: int) -> Column:
    """The distance of the ``k``-th of an array of (d, value, n) structs, n copies each; null if there are fewer."""
    start = F.struct(F.lit(k).cast("long").alias("left"), F.lit(None).cast("double").alias("d"))
    step = lambda s, x: F.struct((s["left"] - x["n"]).alias("left"), F.when((s["left"] > 0) & (s["left"] <= x["n"]), x["d"]).otherwise(s["d"]).alias("d"))
    return F.aggregate(F.array_sort(near), start, step)["d"]


def lists(found: list[tuple], keys: list[str]) -> pa.Table | None:
    """A table of ``keys``, what is extra and near, from pieces (points, place of the point, d, value, n, extra), ordered by place; points without any are left out."""
    out = []
    for points, i, d, value, n, extra in found:
        at, size = np.unique(i, return_counts=True)
        near = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.StructArray.from_arrays([pa.array(d), pa.array(value), pa.array(n)], ["d", "value", "n"]))
        columns = {c: pa.array(points[at, j], from_pandas=True) for j, c in enumerate(keys)}
        out.append(pa.table(columns | {c: pa.array(np.full(len(at), v)) for c, v in extra.items()} | {"near": near}))
    return pa.concat_tables(out) if out else None


def nearest(queries: DataFrame, leaves: Leaves, kernel: Callable, schema: str, by: list[str], k: int, home: Callable | None = None) -> DataFrame:
    """Rows of ``schema``, which has ``by`` and near array<struct<d, value, n>>: what the ``k`` nearest rows of each query must be among.

    ``queries`` are distinct and have the keys of the leaves, no more. First each meets its home (by default the nearest leaf near its run that holds ``k`` rows); its ``k``-th distance there, d squared, then bounds
    the leaves that it must meet besides. A query that finds fewer than ``k`` at home meets all leaves.
    """
    boxes = leaves.boxes
    keys, held, number = boxes.keys, boxes.held, boxes.number

    def nearest_leaf(far: np.ndarray, _: pd.DataFrame, some: np.ndarray) -> np.ndarray:
        out = np.zeros(far.shape, dtype=bool)
        able = np.flatnonzero(held[some] >= k)
        able = able if len(able) else np.arange(len(some))
        if len(able):
            out[np.arange(len(far)), able[np.argmin(far[:, able], axis=1)]] = True
        return out

    homes = workspace.keep(sent(queries, leaves, home or nearest_leaf, close=True), "homes")
    at_home = workspace.keep(meet(homes, leaves.rows, kernel, schema), "at_home")
    inf = F.lit(float("inf"))
    reach = at_home.groupBy(*by).agg(F.flatten(F.collect_list("near")).alias("near")).select(*keys, F.coalesce(kth("near", k), inf).alias("__reach"))
    reach = reach.groupBy(*keys).agg(F.max("__reach").alias("__reach"))
    named = reach.toDF(*[f"__{c}" for c in keys], "__reach")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    done = homes.groupBy(*keys).agg(F.collect_set("__leaf").alias("__done"))
    bounded = done.join(named, same, "left").select(*keys, "__done", F.coalesce("__reach", inf).alias("__reach"))

    def limit(pdf: pd.DataFrame) -> np.ndarray:
        return pdf["__reach"].to_numpy() * (1 + 1e-9)

    def others(far: np.ndarray, pdf: pd.DataFrame, some: np.ndarray) -> np.ndarray:
        near = np.isfinite(far) & (far <= limit(pdf)[:, None])
        size = [len(d) for d in pdf["__done"]]
        i, met = np.repeat(np.arange(len(pdf)), size), np.concatenate(list(pdf["__done"])) if sum(size) else np.zeros(0, np.int64)
        at = np.searchsorted(number[some], met)
        held = (at < len(some)) & (number[some][np.minimum(at, len(some) - 1)] == met) if len(some) else np.zeros(len(met), dtype=bool)
        near[i[held], at[held]] = False
        return near

    more = sent(bounded, leaves, others, limit).select(*keys, "__leaf")
    return at_home.unionByName(meet(workspace.keep(more, "within_reach"), leaves.rows, kernel, schema))


def among_all(points: DataFrame, axes: list[str], k: int) -> DataFrame:
    """(u, near array<struct<d, value, n>>): of each of ``points`` (u, w rows, ``axes``; kept) the ``k`` nearest ones, itself included, of equal ones the smaller u.

    For many keys, where boxes bound nothing: a task takes a piece of the points past all points, which it reads from the shared folder ``STREAM`` at a time, and
    holds ``k`` of each. So the work grows as the square of the points, but nothing is shuffled or written for a pair of pieces. Products screen the pairs; distances are worked out key by key.
    """
    folder, n, piece, stream = workspace.readable(points), points.count(), PIECE, STREAM
    cores = points.sparkSession.sparkContext.defaultParallelism
    pieces = max(-(-n // piece), min(4 * cores, -(-n // 64)), 1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, piece):
                own = whole.slice(lo, piece)
                i, d, value, copies = _past_all(_grid(own, axes), folder, axes, k, stream)
                size = np.bincount(i, minlength=own.num_rows)
                near = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.StructArray.from_arrays([pa.array(d), pa.array(value), pa.array(copies)], ["d", "value", "n"]))
                yield pa.RecordBatch.from_arrays([own.column("u"), near], ["u", "near"])

    return points.repartition(pieces).mapInArrow(search, "u long, near array<struct<d:double,value:bigint,n:bigint>>")


def _grid(batch: pa.RecordBatch, axes: list[str]) -> np.ndarray:
    return np.stack([batch.column(a).to_numpy(zero_copy_only=False) for a in axes], axis=1)


def _past_all(a: np.ndarray, folder: str, axes: list[str], k: int, stream: int) -> tuple[np.ndarray, ...]:
    """(line of ``a``, d, u, w) of the ``k`` nearest points of each line, ordered by line, d and u."""
    system, where = pafs.FileSystem.from_uri(folder)
    best = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    limit, length = np.full(len(a), np.inf), (a * a).sum(axis=1)
    for file in sorted(f.path for f in system.get_file_info(pafs.FileSelector(where)) if f.path.endswith(".parquet")):
        for batch in pq.ParquetFile(system.open_input_file(file)).iter_batches(stream, columns=["u", "w", *axes]):
            b = _grid(batch, axes)
            other = (b * b).sum(axis=1)
            about = length[:, None] + other[None, :] - 2 * a @ b.T
            slack = 1e-9 * (length + other.max(initial=0.0))  # far more than rounding takes
            if len(b) > k and np.isinf(limit).any():
                about_k = np.partition(about, k - 1, axis=1)[:, k - 1] + slack
                i, j = np.nonzero(about <= np.minimum(limit, about_k)[:, None] + slack[:, None])
            else:
                i, j = np.nonzero(about <= (limit + slack)[:, None])
            far = np.zeros(len(i))
            for x in range(len(axes)):
                far += (a[i, x] - b[j, x]) ** 2
            all_ = [np.concatenate(p) for p in zip(best, (i, far, batch.column("u").to_numpy()[j], batch.column("w").to_numpy()[j]), strict=True)]
            order = np.lexsort((all_[2], all_[1], all_[0]))
            line = all_[0][order]
            order = order[np.arange(len(line)) - np.searchsorted(line, line) < k]
            best = tuple(p[order] for p in all_)
            held = np.bincount(best[0], minlength=len(a))
            full = held == k
            limit[full] = best[1][np.cumsum(held)[full] - 1]
    return best
