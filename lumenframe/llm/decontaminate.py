"""Benchmark passages in documents, by one Aho-Corasick scan over normalised words."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, text_only, utf8

#: Separators become spaces and A-Z become a-z; digits, letters and all non-ASCII bytes stay.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
#: An automaton holds about so many pattern characters (and 8 for each item of a window) at most; a larger benchmark is scanned in several groups.
GROUP_CHARS = 8_000_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def windows_of(words: list[bytes], width: int) -> set[bytes]:
    if not words:
        return set()
    size = min(width, len(words))
    return {b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)}


def _automaton(windows: dict[bytes, list[int]]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for window, items in windows.items():
        found.add_word(f" {window.decode('latin-1')} ", (len(window) + 2, items))
    found.make_automaton()
    return found


def _scan(windows: dict[bytes, list[int]], *keys: str):
    def make():
        automaton = _automaton(windows) if windows else None

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_words, spans, items, offsets = [], [], [], []
            for text in utf8(batch.column("text")):
                words = words_of(text)
                n_words.append(len(words))
                hits: list[tuple[int, int]] = []
                ids: set[int] = set()
                if automaton is not None and words:
                    line = f" {b' '.join(words).decode('latin-1')} "
                    for end, (size, own) in automaton.iter(line):
                        hits.append((end - size + 1, end))
                        ids.update(own)
                merged: list[list[int]] = []
                raw: list[list[int]] = []
                if hits:
                    # the blank before word w stands at start[w]; a window runs from one blank to another
                    start = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))
                    firsts = np.searchsorted(start, [h[0] for h in hits])
                    lasts = np.searchsorted(start, [h[1] for h in hits])
                    for a, b in sorted(zip(firsts.tolist(), lasts.tolist(), strict=True)):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                    raw = _original(text, merged)
                spans.append(merged)
                offsets.append(raw)
                items.append(sorted(ids))
            kind = pa.list_(pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keys], pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array(offsets, kind), pa.array(items, pa.list_(pa.int64()))],
                [*keys, "n_words", "word_spans", "char_spans", "items"],
            )

        return step

    return make


def _original(text: bytes, word_spans: list[list[int]]) -> list[list[int]]:
    """Code-point offsets (end exclusive) in the original text of spans given in words."""
    flat = np.frombuffer(text.translate(_TABLE), dtype=np.uint8) != 0x20
    starts = np.flatnonzero(flat & ~np.concatenate(([False], flat[:-1])))
    ends = np.flatnonzero(flat & ~np.concatenate((flat[1:], [False]))) + 1
    point = np.concatenate(([0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)))
    return [[int(point[starts[a]]), int(point[ends[b - 1]])] for a, b in word_spans]


def _windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(window, items): each window of the benchmark once, with the items that have it."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            windows, items = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), utf8(batch.column("text")), strict=True):
                own = windows_of(words_of(text), width)
                windows.extend(own)
                items.extend([item] * len(own))
            return pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(items, pa.int64())], ["window", "item_id"])

        return step

    return map_batches(benchmark, make, "window binary, item_id long").groupBy("window").agg(F.collect_set("item_id").alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, group_chars: int = GROUP_CHARS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items, word_spans, char_spans, contaminated.

    A window is ``width`` consecutive words of an item (all words of a shorter one). Document words inside any
    occurrence of a window are hit; ``contaminated`` means n_hit > 0 and share * n_hit >= n_words. char_spans
    are the hit stretches as [start, end) code points of the original text.

    The benchmark's windows go into one Aho-Corasick automaton, which each task builds once; texts are
    normalised and scanned whole, once, without a shuffle. The automaton's size is bounded by
    about ``group_chars``: the windows of a benchmark beyond that are dealt into groups by hash. Each group is then
    scanned like this, one after the other, over a written copy of the texts with a key for each row, and the hits
    of a row are united. The driver holds one group at a time.

    Null texts have no words; null benchmark texts and item_ids make no window. Repeated items count once
    an item_id; repeated documents are scanned each. Empty tables give no hits or no rows. Other columns
    are not read.
    """
    source = text_only(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    items = text_only(benchmark, "item_id").withColumn("item_id", F.col("item_id").cast("long")).filter("item_id is not null and text is not null").distinct()
    schema = "doc_id long, n_words long, word_spans array<array<long>>, char_spans array<array<long>>, items array<long>"
    windows = materialize(_windows(items, width), "windows")
    chars = windows.agg(F.sum(F.length("window") + 8 * F.size("items"))).first()[0] or 0
    if chars <= group_chars:
        hits = map_batches(source, _scan(_collected(windows), "doc_id"), schema)
    else:
        dealt = windows.withColumn("group", F.pmod(F.xxhash64("window"), F.lit(-(-5 * chars // (4 * group_chars)))))  # a fifth of room for uneven groups
        rows = materialize(source.withColumn("row", F.monotonically_increasing_id()), "rows")
        hits = None
        for r in dealt.select("group").distinct().orderBy("group").toLocalIterator():
            part = map_batches(rows, _scan(_collected(dealt.filter(F.col("group") == r["group"])), "row", "doc_id"), f"row long, {schema}")
            part = materialize(part if hits is None else part.filter(F.size("items") > 0), "hits")
            hits = part if hits is None else hits.unionByName(part)
        hits = hits.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), _united(F.zip_with("word_spans", "char_spans", lambda w, c: F.concat(w, c))).alias("spans"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        hits = hits.select("doc_id", "n_words", F.transform("spans", lambda s: F.slice(s, 1, 2)).alias("word_spans"), F.transform("spans", lambda s: F.slice(s, 3, 2)).alias("char_spans"), "items")
    n_hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return hits.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def _collected(windows: DataFrame) -> dict[bytes, list[int]]:
    return {bytes(r["window"]): r["items"] for r in windows.toLocalIterator()}


def _united(column):
    """All spans (first and last word, first and last character) of a document, those that overlap or touch merged by words."""
    spans = F.sort_array(F.flatten(F.collect_list(column)))
    empty = F.array().cast("array<array<long>>")

    def step(done, span):
        last = F.try_element_at(done, F.lit(-1))
        joins = F.coalesce(span[0] <= last[1], F.lit(False))
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.array(last[0], F.greatest(last[1], span[1]), last[2], F.greatest(last[3], span[3]))))
        return F.when(joins, grown).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, empty, step)
