"""Toxicity: boosted trees over dense lexical features, calibrated by isotonic regression."""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, text_only

#: Insults to start from, and second-person words, in the corpus's languages.
INSULTS = """
idiot moron stupid loser pathetic disgusting worthless scum trash clown dumb fool jerk imbecile retard
idiota estúpido imbécil basura asqueroso inútil payaso tonto
idiote stupide imbécile crétin débile ordure minable dégoûtant nul clown
dumm dummkopf trottel abschaum müll erbärmlich widerlich wertlos versager blöd
""".split()
SECOND_PERSON = frozenset("you your yours yourself u ur tú tu usted ustedes te ti vosotros vous ton ta tes toi votre vos du dich dir dein deine ihr euch".split())
#: Digits and signs that stand for letters.
LOOKALIKE = str.maketrans("013457@$!|8", "oieastasiib")

FEATURES = (
    "seed_rate", "word_rate", "stem_rate", "weight_rate", "hits", "kinds", "near_you", "you_rate",
    "capitals", "shouted", "punctuation", "exclamations", "obfuscated", "obfuscated_hits", "digits", "length",
)
TRAIN_ROWS = 24_000  # labelled rows that are fitted on, at most
LEXICON = 3_000  # learned terms, at most
STEMS = (4, 5, 6)
NEAR = 24  # bytes of UTF-8 between the ends of a hit and of a second-person word

_WORDS = re.compile(r"[^\W\d_]+")
_SIGNS = frozenset("0123456789@$!*|.-")
_SIGN_BEFORE_LETTER = re.compile(r"[0-9@$!*|.\-]+(?=[^\W\d_])")
_EDGE_SIGNS = "!*|.-"
#: ASCII letters and all non-ASCII bytes stay, all else becomes a blank.
_BLANKED = bytes(c if 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_CLASSES = np.zeros(256, dtype=np.int64)
_CLASSES[0x41:0x5B] = 1
_CLASSES[0x61:0x7B] = 2
_CLASSES[0x80:] = 2
_CLASSES[0x30:0x3A] = 3
_CLASSES[[ord(c) for c in ".,;:?\"'()[]{}#%&*$@^~<>/\\|+=_-"]] = 4
_CLASSES[ord("!")] = 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _terms(text: str) -> set[str]:
    words = set(_WORDS.findall(text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


def _count_terms(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Documents with each term in this batch, toxic and not."""
    seen: dict[str, list[int]] = {}
    for text, toxic in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
        for term in _terms(text or ""):
            seen.setdefault(term, [0, 0])[int(toxic)] += 1
    return pa.RecordBatch.from_arrays(
        [pa.array(list(seen)), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())],
        ["term", "bad", "good"],
    )


def learn_lexicon(rows: DataFrame, most: int = LEXICON) -> dict[str, float]:
    """Words and stems (``abcd*``) that mark toxic texts, with smoothed log odds; at most ``most``."""
    sums = rows.groupBy().agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good")).first()
    if not sums["bad"] or not sums["good"]:
        return {}
    counted = map_batches(rows.select("text", "label"), lambda: _count_terms, "term string, bad long, good long", slice_bytes=None)
    odds = F.log((F.col("bad") + 0.5) / (sums["bad"] + 1)) - F.log((F.col("good") + 0.5) / (sums["good"] + 1))
    best = (
        counted.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .filter(F.col("bad") >= 4)
        .withColumn("odds", odds)
        .filter(F.col("odds") >= 2.5)
        .orderBy(F.desc(F.col("odds") * F.log1p("bad")), "term")
        .limit(most)
    )
    return {r["term"]: r["odds"] for r in best.collect()}


def obfuscated_words(text: str) -> list[str]:
    """Words in which digits or signs stand between letters or lead them; signs at a word's edges are punctuation.

    A word is a run of letters, digits and the signs that stand for letters. The text is gone through once.
    """
    out, done = [], 0
    part = lambda c: c.isalpha() or c in _SIGNS
    for m in _SIGN_BEFORE_LETTER.finditer(text):
        if m.start() < done:
            continue
        a, b = m.start(), m.end()
        while a > done and part(text[a - 1]):
            a -= 1
        while b < len(text) and part(text[b]):
            b += 1
        done = b
        word = text[a:b].strip(_EDGE_SIGNS)
        if _SIGN_BEFORE_LETTER.search(word):
            out.append(word)
    return out


class Scorer:
    """Dense features of a text, in time linear in it."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, tuple[int, float]] = {}
        for term, odds in lexicon.items():
            entries[f" {term[:-1]}" if term.endswith("*") else f" {term} "] = (2 if term.endswith("*") else 1, odds)
        entries |= {f" {w} ": (0, lexicon.get(w, 2.0)) for w in INSULTS}
        entries |= {f" {w} ": (3, 0.0) for w in SECOND_PERSON}
        for term, value in entries.items():
            self.automaton.add_word(term.encode().decode("latin-1"), (term, *value))
        self.automaton.make_automaton()
        self.bad_words = set(INSULTS) | {t for t in lexicon if not t.endswith("*")}
        self.bad_stems = tuple(t[:-1] for t in lexicon if t.endswith("*"))

    def features(self, text: str) -> list[float]:
        data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        kinds = np.bincount(_CLASSES[data], minlength=6).astype(float)
        chars = max(len(text), 1)
        line = f" {text.lower().encode('utf-8', 'replace').translate(_BLANKED).decode('latin-1')} "
        words = max(len(line.split()), 1)
        hits = [0, 0, 0]
        weight, distinct = 0.0, set()
        bad_at, you_at = [], []
        for end, (term, kind, odds) in self.automaton.iter(line):
            if kind == 3:
                you_at.append(end)
            else:
                hits[kind] += 1
                weight += odds
                distinct.add(term)
                bad_at.append(end)
        near = 0
        if bad_at and you_at:
            spots, you = np.array(bad_at), np.array(you_at)
            k = np.searchsorted(you, spots)
            gap = np.minimum(np.abs(you[np.minimum(k, len(you) - 1)] - spots), np.abs(spots - you[np.maximum(k - 1, 0)]))
            near = int((gap <= NEAR).sum())
        obfuscated = obfuscated_hits = 0
        if kinds[3] or kinds[4] or kinds[5]:
            for word in obfuscated_words(text):
                obfuscated += 1
                plain = "".join(c for c in word.lower().translate(LOOKALIKE) if c.isalpha())
                obfuscated_hits += plain in self.bad_words or (bool(self.bad_stems) and plain.startswith(self.bad_stems))
        letters = max(kinds[1] + kinds[2], 1)
        shouted = sum(1 for w in text.split() if len(w) > 2 and w.isupper()) if kinds[1] / letters > 0.1 else 0
        rate = 100.0 / words
        return [
            hits[0] * rate, hits[1] * rate, hits[2] * rate, weight * rate, float(np.log1p(sum(hits))), float(min(len(distinct), 50)),
            near / max(len(bad_at), 1), len(you_at) * rate, kinds[1] / letters, shouted * rate, kinds[4] / chars, kinds[5] / chars,
            obfuscated * rate, float(obfuscated_hits), kinds[3] / chars, float(np.log1p(words)),
        ]


def _featurize(lexicon: dict[str, float]):
    def make():
        scorer = Scorer(lexicon)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            table = np.array([scorer.features(t or "") for t in batch.column("text").to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            others = [c for c in batch.schema.names if c != "text"]
            return pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *[pa.array(table[:, k]) for k in range(len(FEATURES))]], [*others, *FEATURES])

        return step

    return make


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train_rows: int = TRAIN_ROWS,
    threshold: float = 0.3,
    trees: int = 30,
    depth: int = 4,
    seed: int = 11,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1), predicted.

    Learns from ``labels`` (doc_id, toxic) only where ``crc32(doc_id as text) mod 4`` is not 2, and from at
    most ``train_rows`` of those, chosen by hash. Of them two fifths give the lexicon (words and stems by log
    odds of document frequency, beside the fixed insults), two fifths the trees, one fifth the isotonic
    calibration, so no stage sees counts it was fitted on. Every document is then scored whole, where it is
    scanned, without a shuffle: lexicon densities, nearness to the second person, capitals, punctuation and
    obfuscation. The score is the calibrated probability; a thousandth of it is the raw one, which keeps order
    inside the calibration's steps.

    Null and empty texts are scored like any (as texts without features). Null labels don't count; of repeated
    labels the largest does. Rows without doc_id are not held out. Without labels of both kinds the score
    is the rate of the fixed insults, capped at 1. Repeated rows are scored alike; an empty table gives an
    empty result. Other columns, lang, source and doc_id among them, are not read for the score.
    """
    source = text_only(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id").limit(train_rows)
    rows = source.join(F.broadcast(drawn), "doc_id")  # bounded by train_rows
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed + 1)), F.lit(5))
    sample = materialize(rows.select("text", "label", part.alias("part")), "toxic_sample")
    kinds = {(r["p"], r["label"]) for r in sample.select(F.expr("case when part < 2 then 0 when part < 4 then 1 else 2 end").alias("p"), "label").distinct().collect()}
    lexicon = learn_lexicon(sample.filter("part < 2"))
    columns = ", ".join(f"{c} double" for c in FEATURES)
    featured = map_batches(source, _featurize(lexicon), f"doc_id long, {columns}")
    out = lambda frame, score: frame.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
    if not {(1, 0), (1, 1), (2, 0), (2, 1)} <= kinds:
        return out(featured, F.least(F.col("seed_rate") / 10, F.lit(1.0)))

    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    fitted = vector.transform(map_batches(sample.select("label", "part", "text"), _featurize(lexicon), f"label int, part long, {columns}")).select("label", "part", "features")
    fitted = materialize(fitted, "toxic_features").coalesce(2).cache()
    gbt = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed, minInstancesPerNode=5, cacheNodeIds=False)
    model = gbt.fit(fitted.filter("part in (2, 3)"))
    raw = lambda frame: frame.withColumn("raw", _second(F.col("probability")))
    calibration = raw(model.transform(fitted.filter("part = 4"))).select(F.col("label").cast("double").alias("label"), "raw")
    isotonic = IsotonicRegression(featuresCol="raw", labelCol="label").fit(calibration)
    fitted.unpersist()
    scored = isotonic.transform(raw(model.transform(vector.transform(featured)).select("doc_id", "probability"))).withColumnRenamed("prediction", "level")
    return out(scored, 0.999 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("level"))) + 0.001 * F.col("raw"))


def _second(probability: Column) -> Column:
    from pyspark.ml.functions import vector_to_array

    return F.element_at(vector_to_array(probability), 2)
