"""Mix sources by temperature, as budgeted block permutations. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

STEPS = 64  # grid points a pass: six bisections in one aggregate
PASSES = 4
WORDS = r"[^ \t-\r]+"


def _measures(totals: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent: entropy of the weights, and the largest repetition relative to the smallest."""
    tried = totals.select("share", F.explode(F.array(*[F.lit(x) for x in exponents])).alias("x"))
    powered = F.pow("share", "x")
    pull = F.pow("share", F.col("x") - 1)
    rows = tried.groupBy("x").agg(F.sum(powered).alias("z"), F.sum(powered * F.log("share")).alias("l"), F.max(pull).alias("most"), F.min(pull).alias("least"))
    found = {r["x"]: (r["h"], r["rep"]) for r in rows.select("x", (F.log("z") - F.col("x") * F.col("l") / F.col("z")).alias("h"), (F.col("most") / F.col("least")).alias("rep")).collect()}
    return [found[x] for x in exponents]


def _bisect(totals: DataFrame, holds_high) -> float:
    """Between 0 and 1, the boundary of a condition that holds above it (``holds_high(entropy, repetition)``)."""
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        grid = [low + (high - low) * k / STEPS for k in range(STEPS + 1)]
        holds = [holds_high(h, r) for h, r in _measures(totals, grid)]
        k = holds.index(True) if True in holds else STEPS
        low, high = grid[max(k - 1, 0)], grid[k]
    return high


def exponent_for(totals: DataFrame, target_entropy: float, max_repetition: float) -> float:
    """The temperature exponent: bisected to the entropy target, then raised if the repetition limit asks for it.

    ``target_entropy`` is a fraction of the largest possible entropy. Entropy falls as the exponent grows, so
    the boundary is the largest exponent that still meets it; repetition falls too, and its limit wins.
    """
    count = totals.count()
    if count < 2:
        return 1.0
    goal = totals.agg(F.log(F.count("*").cast("double"))).first()[0] * target_entropy
    by_entropy = _bisect(totals, lambda h, _: h < goal)
    by_repetition = _bisect(totals, lambda _, r: r <= max_repetition)
    return max(by_entropy, by_repetition)


def _draw(*parts: Column | str) -> Column:
    """52 pseudo-random bits of a key."""
    key = F.concat_ws(":", *[p if isinstance(p, Column) else F.col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame,
    target_entropy: float = 0.95,
    max_repetition: float = 4.0,
    budget: int | None = None,
    block_tokens: int = 1_000_000,
    bucket_docs: int = 2048,
    seed: int = 17,
) -> DataFrame:
    """Rows (doc_id, source, epoch, block, position, n_tokens): the mix, in training order by (block, position).

    A document has a token for each word and one for its end. A source's weight is its token share to the
    power of an exponent between 0 and 1, normalised; ``exponent_for`` finds it. ``budget`` is the mix's tokens; by
    default it is the least that leaves no document out, so the largest source comes once and smaller ones up to
    ``max_repetition`` times.

    A source's stream is one pseudo-random permutation of its documents an epoch, cut where its part of the
    budget ends. Blocks of about ``block_tokens`` take from each source's stream in proportion, so
    every block has the target weights; inside a block documents are shuffled. Prefix sums run in two levels
    (by hash bucket of about ``bucket_docs``, then inside), so a source with a third of all rows is spread over tasks.

    A null source is a source of its own; null doc_id and null or empty text (one token) are kept. Repeated rows
    are documents of their own. An empty table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key"),
        (F.regexp_count(text, F.lit(WORDS)) + 1).cast("long").alias("n_tokens"),
    )
    rows = materialize(rows, "lengths")
    sums = rows.groupBy("key").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("docs"))
    everything = rows.agg(F.sum("n_tokens")).first()[0] or 0
    totals = materialize(sums.withColumn("share", F.col("total") / F.lit(float(everything or 1))), "shares")
    exponent = exponent_for(totals, target_entropy, max_repetition)
    z = totals.agg(F.sum(F.pow("share", F.lit(exponent)))).first()[0] or 1.0
    weighed = totals.withColumn("weight", F.pow("share", F.lit(exponent)) / F.lit(z))
    if budget is None:
        most = weighed.agg(F.max(F.col("share") / F.col("weight"))).first()[0] or 0.0
        budget = round(everything * most)
    blocks = max(1, -(-budget // block_tokens))
    plan = weighed.select(
        "key", "total", F.round(F.col("weight") * F.lit(float(budget))).cast("long").alias("target"), F.ceil(F.col("docs") / bucket_docs).cast("long").alias("buckets")
    ).withColumn("full", F.floor(F.col("target") / F.col("total")))
    plan = materialize(plan.withColumn("rest", F.col("target") - F.col("full") * F.col("total")), "plan")

    last = F.when(F.col("rest") > 0, F.col("full")).otherwise(F.col("full") - 1)
    drawn = (
        rows.join(plan, "key").filter(last >= 0)
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumn("draw", _draw(F.lit(str(seed)), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        .withColumn("bucket", F.floor(F.col("draw") / F.lit(float(1 << 52)) * F.col("buckets")))
    )
    cell = ["key", "epoch", "bucket"]
    heads = drawn.groupBy(*cell).agg(F.sum("n_tokens").alias("s"))
    earlier = W.partitionBy("key", "epoch").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select(*cell, F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("before"))
    inside = W.partitionBy(*cell).orderBy("draw", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    placed = drawn.join(heads, cell).withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside))
    taken = placed.filter((F.col("epoch") < F.col("full")) | (F.col("upto") <= F.col("rest")))
    at = F.col("epoch") * F.col("total") + F.col("upto") - F.col("n_tokens")
    blocked = taken.withColumn("block", F.floor(at / F.col("target") * F.lit(float(blocks))))
    shuffled = blocked.withColumn("order", _draw(F.lit(f"{seed}/block"), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    in_block = W.partitionBy("block").orderBy("order", "key", "epoch", "doc_id", "n_tokens")
    return shuffled.select("doc_id", "source", "epoch", "block", F.row_number().over(in_block).cast("long").alias("position"), "n_tokens")
