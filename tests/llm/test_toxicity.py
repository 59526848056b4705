"""Toxicity: held-out accuracy, and what the features and edges should be."""

import math
import re
import zlib

import numpy as np
import pytest

from lumenframe.llm.queries import op4_toxicity
from lumenframe.llm.toxicity import FEATURES, INSULTS, SECOND_PERSON, STEMS, Scorer, obfuscated_words, score_toxicity


def auc(y, s):
    order = np.argsort(np.argsort(s))
    return (order[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.fixture(scope="module")
def scored(spark):
    return op4_toxicity(spark, "/root/testdata/sf0.1").toPandas()


def test_held_out_accuracy(spark, scored):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    rows = scored.merge(labels, on="doc_id")
    rows = rows[rows.held_out]
    y = rows.toxic.to_numpy()
    assert auc(y, rows.score.to_numpy()) > 0.97
    assert y[rows.predicted == 1].mean() > 0.85 and rows.predicted[y == 1].mean() > 0.85
    assert ((rows.score - y) ** 2).mean() < 0.04  # calibrated


def test_contract(scored):
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.3)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(scored.doc_id, scored.held_out, strict=True))
    assert len(scored) == 10_000 and scored.doc_id.is_unique


def test_edges_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "you idiot", "x"), (4, "word " * 50_000, "x"), (1, None, "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = score_toxicity(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert max(got, key=lambda r: r["score"])["doc_id"] is None
    assert score_toxicity(docs.limit(0), labels).count() == 0


def test_features():
    f = dict(zip(FEATURES, Scorer({"grob": 3.0, "loweix*": 4.0}).features("YOU 1d10t! grob. loweixung, idiot you m0r0n")))
    assert f["seed_rate"] > 0 and f["word_rate"] > 0 and f["stem_rate"] > 0 and f["near_you"] > 0 and f["obfuscated_hits"] == 2
    assert all(np.isfinite(list(dict(zip(FEATURES, Scorer({}).features(""))).values())))


@pytest.mark.parametrize(("text", "words"), [
    ("1d10t! m0r0n.", ["1d10t", "m0r0n"]), ("a sentence. Another! (fin)", []), ("s-h.i*t", ["s-h.i*t"]), ("-list $cum @nd", ["$cum", "@nd"]), ("12 34.5 6-7", []),
    ("x1", []), ("1x", ["1x"]), ("!!!no", []), ("", []), ("é1é _1a", ["é1é", "1a"]), ("a1" * 5, ["a1" * 5]),
])
def test_obfuscated_words(text, words):
    assert obfuscated_words(text) == words


def brute_features(lexicon, text):
    """The features word by word, without an automaton."""
    words = re.sub(r"[\x00-\x40\x5b-\x60\x7b-\x7f]", " ", text.lower()).split(" ")
    ends, at = [], 0
    for w in words:
        at += len(w.encode()) + 1
        ends.append(at)
    n = max(sum(map(bool, words)), 1)
    hits, bad, you, kinds, weight = [0, 0, 0], [], [], set(), 0.0
    stems = {t[:-1]: o for t, o in lexicon.items() if t.endswith("*")}
    for w, end in zip(words, ends, strict=True):
        if w in SECOND_PERSON:
            you.append(end)
        elif w in INSULTS or w in lexicon:
            hits[0 if w in INSULTS else 1] += 1
            weight += lexicon.get(w, 2.0)
            kinds.add(w)
            bad.append(end)
        for k in STEMS:
            if len(w) >= k and w[:k] in stems:
                hits[2] += 1
                weight += stems[w[:k]]
                kinds.add(f"{w[:k]}*")
                bad.append(end - len(w.encode()) - 1 + len(w[:k].encode()))
    near = sum(any(abs(b - y) <= 24 for y in you) for b in bad)
    letters = max(sum(len(c.encode()) for c in text if c.isascii() and c.isalpha() or not c.isascii()), 1)
    capitals = sum("A" <= c <= "Z" for c in text)
    marks = sum(c in ".,;:?\"'()[]{}#%&*$@^~<>/\\|+=_-" for c in text)
    odd = obfuscated_words(text)
    plain = ["".join(c for c in w.lower().translate(str.maketrans("013457@$!|8", "oieastasiib")) if c.isalpha()) for w in odd]
    guessed = sum(p in INSULTS or p in lexicon or any(p.startswith(x) for x in stems) for p in plain)
    shouted = sum(len(w) > 2 and w.isupper() for w in text.split()) if capitals / letters > 0.1 else 0
    chars, rate = max(len(text), 1), 100 / n
    return [hits[0] * rate, hits[1] * rate, hits[2] * rate, weight * rate, math.log1p(sum(hits)), min(len(kinds), 50), near / max(len(bad), 1), len(you) * rate, capitals / letters,
            shouted * rate, marks / chars, text.count("!") / chars, len(odd) * rate, guessed, sum(c in "0123456789" for c in text) / chars, math.log1p(n)]


def test_features_equal_brute_force(spark):
    lexicon = {"grob": 3.0, "loweix*": 4.0, "the": 1.5, "thei*": 2.5, "ander*": 2.0, "crétin": 3.5}
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["", "YOU 1d10t! grob. loweixung, idiot you m0r0n", "the the you the", "CRÉTIN you!! loweix", " . ", "é" * 30, "thei your anderen ihr ander", "YOU ARE DUMB AND A CL0WN"]
    scorer = Scorer(lexicon)
    for t in texts:
        assert scorer.features(t or "") == pytest.approx(brute_features(lexicon, t or "")), t
