"""A document corpus made ready for training, in five stages.

Each stage reads what the one before wrote; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.bloom import without_ids
from lumenframe.llm.common import materialize, read_table
from lumenframe.llm.decontaminate import decontaminate
from lumenframe.llm.line_dedup import line_dedup
from lumenframe.llm.mixing import mix_sources
from lumenframe.llm.near_dedup import near_duplicates
from lumenframe.llm.toxicity import score_toxicity

#: Some stages use functions that SQL can't express (trees, hashed minima, an automaton).
ORACLE_SQL = None


def _keep(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the rejected doc_ids; rows without doc_id stay."""
    return without_ids(docs, materialize(rejected.select("doc_id").distinct(), "rejected"), "doc_id")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic."""
    scored = score_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return _keep(docs, scored.filter("predicted = 1"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that five documents or more share, but in one of them; n_chars follows the text."""
    kept = line_dedup(docs, carry=True)
    column = {c: F.col(f"carried.`{c}`").alias(c) for c in docs.columns} | {c: F.col(c) for c in ("doc_id", "text")}
    if "n_chars" in docs.columns:
        column["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("carried.n_chars")).alias("n_chars")
    return kept.select(*[column[c] for c in docs.columns])


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates."""
    found = near_duplicates(docs, words=5, similarity=80)
    return _keep(docs, found.filter("not kept"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages by the contamination rule."""
    hits = decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return _keep(docs, hits.filter("contaminated"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: every document at least once, small sources repeated."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", benchmark_decontamination),
    ("mixing", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
