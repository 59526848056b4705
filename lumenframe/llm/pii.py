"""Personal data: fixed forms, and identifiers found through contexts that the fixed forms induce."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, text_only

KINDS = ("email", "ip", "card", "phone", "context")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: A sign that identifiers without digits have between letters or before them: handles, accounts, paths.
_SIGNED = re.compile(r"[@#_/\\](?=[^\W\d_])|\.(?<=[^\W\d_]\.)(?=[^\W\d_])")
#: Where words that may be identifiers are looked for: at a digit, or at a sign before a letter.
_SPOT = re.compile(r"[0-9]|[@#_/\\.](?=[^\W\d_])")
_EDGES = ".,;:!?\"'()[]{}<>"
_WORD_BEFORE = re.compile(r"[^\s]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """As the pattern matches from the left, in time linear in the text: from each @ outward."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        # what lies before this @ can't begin a later match that reaches over it
        done = max(done, at + 1)
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed forms, leftmost and non-overlapping for each kind, by kind and then start."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start() <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def _fold(word: str) -> str:
    return re.sub(r"[0-9]+", "0", word.lower().strip(_EDGES))


class Words:
    """The words of a text, to look up the two before and after a span."""

    def __init__(self, text: str) -> None:
        self.text = text
        found = list(_WORD_BEFORE.finditer(text))
        self.starts, self.ends = [m.start() for m in found], [m.end() for m in found]

    def around(self, a: int, b: int) -> tuple[list[str], list[str]]:
        """Folded; a word that the span cuts counts with what lies outside of it."""
        k = bisect_left(self.starts, a)
        before = [self.text[self.starts[i] : min(self.ends[i], a)] for i in range(max(0, k - 2), k)]
        k = bisect_right(self.ends, b)
        after = [self.text[max(self.starts[i], b) : self.ends[i]] for i in range(k, min(k + 2, len(self.ends)))]
        return [_fold(w) for w in before], [_fold(w) for w in after]


def contexts(words: Words, a: int, b: int) -> list[str]:
    """Lexical patterns around a span: two words before; one before and one after; two after. A slot that holds no word (signs alone) makes none."""
    before, after = words.around(a, b)
    before = ["^"] * (2 - len(before)) + before
    after = after + ["$"] * (2 - len(after))
    worded = lambda *ws: any(any(c.isalpha() for c in w) for w in ws) and all(w in ("^", "$") or any(c.isalnum() for c in w) for w in ws)
    found = []
    if worded(*before):
        found.append(f"{before[0]} {before[1]} _")
    if worded(before[1]) and worded(after[0]):
        found.append(f"{before[1]} _ {after[0]}")
    if worded(*after):
        found.append(f"_ {after[0]} {after[1]}")
    return found


def _named(value: str, longest: int) -> str:
    """A long value by its digest: the graph needs to tell values apart, not to hold them."""
    return value if len(value) <= longest else "sha256 " + hashlib.sha256(value.encode()).hexdigest()


def _extract(longest: int, shortest: int):
    """Base spans of a text, and every identifier-like token with its contexts."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    cand = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            base, found = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                own = base_spans(text)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
                likely = _SPOT.search(text) is not None
                words = Words(text if own or likely else "")
                tokens = [
                    {"start": a, "end": b, "value": _named(f"{k} {text[a:b].lower()}", longest), "seed": True, "patterns": contexts(words, a, b)} for k, a, b in own
                ]
                taken = sorted((a, b) for _, a, b in own)
                at = 0
                if likely:
                    done = -1
                    for spot in _SPOT.finditer(text):
                        if spot.start() <= done:
                            continue
                        k = bisect_right(words.starts, spot.start()) - 1
                        first, last = words.starts[k], words.ends[k]
                        done, w = last - 1, text[first:last]
                        if spot[0] == "." and not _DIGIT.search(w) and not _SIGNED.search(w):
                            continue
                        a = first + len(w) - len(w.lstrip(_EDGES))
                        b = first + len(w.rstrip(_EDGES))
                        while at < len(taken) and taken[at][1] <= a:
                            at += 1
                        free = at == len(taken) or taken[at][0] >= b
                        if free and b - a >= shortest and (sum(c.isdigit() for c in text[a:b]) >= 3 or _SIGNED.search(text, a, b)):
                            tokens.append({"start": a, "end": b, "value": _named(text[a:b].lower(), longest), "seed": False, "patterns": contexts(words, a, b)})
                found.append(tokens)
            digest = [hashlib.sha256(",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in own).encode()).hexdigest() for own in base]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(base, pa.list_(span)), pa.array(digest), pa.array(found, pa.list_(cand))],
                ["doc_id", "base", "base_sha256", "tokens"],
            )

        return step

    return make


def find_pii(
    docs: DataFrame,
    rounds: int = 3,
    min_seeds: int = 5,
    confidence: float = 0.5,
    longest: int = 64,
    shortest: int = 4,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The fixed forms seed a bootstrap over the whole corpus. Words around each seed and each other
    identifier-like token (a word of ``shortest`` code points or more with three digits or more, or with a sign such as @ _ / .
    before or between letters; values of more than ``longest`` go by their digest) make lexical patterns. Each round, a pattern's confidence is the mean confidence of its distinct
    instances, lowered for small support; it counts only with ``min_seeds`` seeds' worth of distinct values
    and at least ``confidence`` (half of its values are known or reached, by default: a higher one misses identifiers wherever unseen ones are frequent). An instance's confidence is the noisy-or of its patterns, seeds stay at 1.
    After ``rounds`` rounds the tokens in a confident pattern become kind ``context`` spans.

    The graph joins distinct (pattern, instance) pairs, so copies of a document add no support, and sums
    are combined before they are shuffled; nothing is collected. Fixed spans are never altered.

    Null and empty texts have none. Repeated rows are judged alike and returned each; an empty table gives an
    empty result. Other columns are not read.
    """
    source = text_only(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = (
        "doc_id long, base array<struct<kind:string,start:long,end:long>>, base_sha256 string, "
        "tokens array<struct<start:long,end:long,value:string,seed:boolean,patterns:array<string>>>"
    )
    read = materialize(map_batches(source, _extract(longest, shortest), schema).withColumn("row", F.monotonically_increasing_id()), "tokens")
    tokens = read.select("row", F.explode("tokens").alias("t")).select("row", "t.*")
    graph = materialize(
        tokens.select("value", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "graph"
    )
    # a pattern without a seed can't win support in the first round; those reached later come in by their instances
    belief = graph.groupBy("value").agg(F.max("seed").cast("double").alias("belief")).filter("belief > 0")
    strong = None
    for k in range(rounds):
        scored = graph.join(belief, "value", "left").groupBy("pattern").agg(F.sum(F.coalesce("belief", F.lit(0.0))).alias("mass"), F.count("*").alias("n"))
        strong = scored.withColumn("trust", F.col("mass") / (F.col("n") + F.lit(0.5))).filter((F.col("mass") >= min_seeds) & (F.col("trust") >= confidence))
        strong = materialize(strong.select("pattern", "trust"), "patterns")
        if k + 1 < rounds:
            reached = graph.join(strong, "pattern").groupBy("value").agg(
                F.max("seed").alias("seed"), (1 - F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.999)))))).alias("by_patterns")
            )
            seeds = graph.filter("seed").select("value").distinct().withColumn("belief", F.lit(1.0))
            belief = materialize(
                seeds.unionByName(reached.filter("not seed").select("value", F.col("by_patterns").alias("belief"))), "beliefs"
            )
    new = (
        tokens.filter("not seed").select("row", "start", "end", F.explode("patterns").alias("pattern"))
        .join(strong, "pattern")
        .groupBy("row").agg(F.sort_array(F.collect_set(F.struct(F.lit("context").alias("kind"), "start", "end"))).alias("new"))
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return (
        read.select("row", "doc_id", "base", "base_sha256").join(new, "row", "left")
        .select("doc_id", *[count(k) for k in KINDS[:4]], "base_sha256", F.concat("base", F.coalesce("new", F.array().cast("array<struct<kind:string,start:long,end:long>>"))).alias("spans"))
    )
