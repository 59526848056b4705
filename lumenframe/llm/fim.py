"""Fill-in-middle transformation: cut texts at unit boundaries and reorder prefix, middle and suffix between sentinels."""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

SENTINELS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
#: The ASCII characters at which the class of a unit changes. Code points have none: their number is the length of a gap.
CHANGES = {"line": "\n", "word": " \t\n\x0b\x0c\r", "char": ""}


def event_automaton(units: str, sentinels: tuple[str, str, str]) -> ahocorasick.Automaton:
    """One automaton for both kinds of events; a sentinel's value is true, a class change's false."""
    found = ahocorasick.Automaton()
    for c in CHANGES[units]:
        found.add_word(c, False)
    for s in sentinels:
        found.add_word(s, True)
    found.make_automaton()
    return found


def events(automaton: ahocorasick.Automaton, text: str) -> tuple[np.ndarray, bool]:
    """Offsets of the class-changing characters, and whether a sentinel occurs."""
    found = list(automaton.iter(text))
    marks = [at for at, is_sentinel in found if not is_sentinel]
    return np.array(marks, dtype=np.int64), len(marks) < len(found)


def unit_ranks(marks: np.ndarray, length: int, units: str) -> tuple[int, Callable[[int], int]]:
    """The number of units, and where the first ``r`` of them end, for any ``r`` up to that number.

    A line ends with its newline. A word takes the white space after it; leading white space is a unit of its own.
    Only the gaps between events are looked at: one without an event in it starts at most one line or word, and holds as many code points as it is long.
    """
    if units == "char":
        return length, lambda r: r
    after = marks + 1
    if units == "word":
        after = after[np.append(marks[1:], length) > after]  # a gap of some length begins a word
    else:
        after = after[after < length]
    starts = np.concatenate(([0], after)) if length and not (len(after) and after[0] == 0) else after
    return len(starts), lambda r: int(starts[r]) if r < len(starts) else length


def _pick(key: Column, group: int) -> Column:
    return F.conv(F.substring(key, 8 * group + 1, 8), 16, 10).cast("long")


def fim_transform(docs: DataFrame, units: str = "line", rate: int = 100, spm: int = 50, seed: str = "7", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n, form, prefix_chars, middle_chars, output.

    The text is cut into ``n`` units (lines, words or code points). The first 8-digit groups of the SHA-256 of ``seed``:doc_id
    choose: prefix and middle end after the smaller and the larger of h1 and h2 modulo n + 1; ``rate`` percent of texts
    are transformed (h3), ``spm`` percent of them with the suffix first (h4).
    One Aho-Corasick scan of a text finds sentinels and class-changing characters; ranks are looked up among these events.

    A text that holds a sentinel, is empty or isn't chosen stays as it is (form plain, lengths null). A null text
    is empty; a null doc_id draws as an empty one. Repeated rows are rows of their own, drawn alike. Nothing
    is shuffled; other columns are not read; an empty table gives an empty result.
    """
    if units not in CHANGES:
        raise ValueError(f"units must be one of {', '.join(CHANGES)}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), digest.alias("key"))
    drawn = source.select("doc_id", "text", *[_pick(F.col("key"), g).alias(f"h{g + 1}") for g in range(4)])
    before_prefix, before_suffix, before_middle = sentinels

    def make():
        automaton = event_automaton(units, sentinels)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text, *h in zip(*(batch.column(c).to_pylist() for c in ("text", "h1", "h2", "h3", "h4")), strict=True):
                marks, has_sentinel = events(automaton, text)
                n, end = unit_ranks(marks, len(text), units)
                if not text or has_sentinel or h[2] % 100 >= rate:
                    rows.append((n, "plain", None, None, text))
                    continue
                a, b = (end(r) for r in sorted((h[0] % (n + 1), h[1] % (n + 1))))
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                if h[3] % 100 < spm:
                    rows.append((n, "spm", a, b - a, f"{before_suffix}{suffix}{before_prefix}{prefix}{before_middle}{middle}"))
                else:
                    rows.append((n, "psm", a, b - a, f"{before_prefix}{prefix}{before_suffix}{suffix}{before_middle}{middle}"))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

        return step

    return map_batches(drawn, make, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def fim_restore(rows: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``rows`` (form, output, ...) with the exact ``text`` again, read from the output alone.

    Transformed texts hold no sentinel of their own, so an output splits at its sentinels into its three parts.
    """
    parts = F.split("output", "|".join("".join(f"\\x{{{ord(c):x}}}" for c in s) for s in sentinels), -1)
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}  # of prefix, middle and suffix
    text = F.when(F.col("form") == "plain", F.col("output"))
    for form, own in order.items():
        text = text.when(F.col("form") == form, F.concat(*[F.get(parts, F.lit(k)) for k in own]))
    return rows.withColumn("text", text)
