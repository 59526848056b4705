"""Thin queries over the training-data operators, one for each, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .chat import chat_digests, format_chats, read_chats
from .common import read_table
from .decontaminate import decontaminate
from .fim import fim_restore, fim_transform
from .line_dedup import line_dedup
from .merkle import merkle_manifest, merkle_proofs
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .pii import find_pii
from .search import top_k
from .secrets import scan_secrets
from .toxicity import score_toxicity
from .warc import read_archives, write_archives
from .winnow import edited_fingerprints


def _spans(column: str) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(column, one), ",").alias("spans")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(read_table(spark, sf_dir, "pages"))
    return read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", _spans("spans"), F.size("spans").cast("long").alias("n_spans"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(read_table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=4, similarity=80)


def op6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the whole texts of all documents whose id is divisible by 20; all documents are searched."""
    docs = read_table(spark, sf_dir, "documents")
    return top_k(docs, docs.filter("doc_id % 20 = 0"), k=10)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", _spans("spans"), F.size("spans").cast("long").alias("n_spans"))


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "select -1L as conv_id, turn, role, '</s>[INST] ok [/INST]' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)"
    return chat_digests(read_chats(format_chats(turns.unionByName(spark.sql(own)))))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(ids, "utf-8"), 256).alias("items_sha256"), "contaminated",
    )


def _fingerprint(positions: str, hashes: str) -> Column:
    """position:hash pairs, the hashes as 16 hex digits."""
    pair = lambda p, h: F.concat(p.cast("string"), F.lit(":"), F.lpad(F.lower(F.hex(h)), 16, "0"))
    return F.array_join(F.zip_with(positions, hashes, pair), ",")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_fingerprints(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", _fingerprint("positions", "hashes").alias("fingerprint"),
        _fingerprint("edited_positions", "edited_hashes").alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_proofs(merkle_manifest(read_table(spark, sf_dir, "documents")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim_restore(fim_transform(read_table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("text").alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_secrets": op2_secrets,
        "op3_line_dedup": op3_line_dedup,
        "op4_toxicity": op4_toxicity,
        "op5_near_dedup": op5_near_dedup,
        "op6_search": op6_search,
        "op7_pii": op7_pii,
        "op8_chat_windows": op8_chat_windows,
        "op9_mixing": op9_mixing,
        "op10_decontaminate": op10_decontaminate,
        "op11_fingerprints": op11_fingerprints,
        "op12_merkle": op12_merkle,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
