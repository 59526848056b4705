"""Fingerprints, Merkle manifest and fill-in-middle against plain re-statements."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm import fim, merkle, winnow
from lumenframe.llm.queries import op11_fingerprints, op12_merkle, op13_fill_in_middle

FIXTURE = "/root/testdata/sf0.001"
#: Extra columns have names that the operators use inside.
DOCS = "doc_id long, text string, source string, lang string, n_chars long, place string, echo string, idx string, tree string, key string, h1 string"


def frame(spark, rows):
    """Rows of (doc_id, text, lang)."""
    return spark.createDataFrame([(i, t, "s", lang, None if t is None else len(t), "p", "e", "i", "t", "k", "h") for i, t, lang in rows], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FIXTURE}/documents.parquet").select("doc_id", "text").collect()]


# --- fingerprints -----------------------------------------------------------------------------


def grams(text, k):
    size = min(k, len(text))
    return [text[i : i + size] for i in range(len(text) - size + 1)] if text else []


def plain_winnow(text, k, window):
    """Chosen positions, with the module's hash of each gram and nothing else of it."""
    own = [int(winnow._grams(winnow._codes(g), len(g), winnow.Powers())[0]) for g in grams(text, k)]
    picked = set()
    for start in range(max(1, len(own) - window + 1)) if own else ():
        part = own[start : start + window]
        picked.add(start + max(i for i, h in enumerate(part) if h == min(part)))
    return [(p, own[p]) for p in sorted(picked)]


def as_pairs(found):
    return list(zip(found[0].tolist(), found[1].tolist(), strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é😀\n", max_size=60), max_size=6), st.integers(1, 6), st.integers(1, 7), st.integers(1, 9))
def test_winnow_equals_windows_one_by_one(texts, k, window, chunk):
    before, winnow.CHUNK = winnow.CHUNK, chunk
    try:
        found = winnow.winnow([winnow._codes(t) for t in texts], k, window)
    finally:
        winnow.CHUNK = before
    assert [as_pairs(f) for f in found] == [plain_winnow(t, k, window) for t in texts]


def test_equal_hashes_take_the_rightmost_and_long_texts_are_whole():
    found = winnow.winnow([winnow._codes("a" * 200)], 4, 8)[0]
    assert found[0].tolist() == list(range(7, 197))
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(700_000))
    assert as_pairs(winnow.winnow([winnow._codes(text)], 5, 9)[0])[-3:] == [(p + 690_000, h) for p, h in plain_winnow(text[690_000:], 5, 9)][-3:]


def test_a_shared_passage_is_never_missed():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    for _ in range(100):
        shared = word(winnow.K + winnow.WINDOW - 1)
        a, b = (winnow.winnow([winnow._codes(word(rng.randrange(200)) + shared + word(rng.randrange(200)))])[0] for _ in range(2))
        assert set(a[1].tolist()) & set(b[1].tolist())


def plain_edited(rows):
    """(doc_id, n_chars, edited text, next text) in ascending doc_id."""
    out = []
    for at, (i, text) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        n = len(text) // 4
        out.append((i, len(text), text[: len(text) - n] + after[:n], after))
    return out


def check_edited(got, rows, k, window):
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    known = {}
    prints = lambda t: known.setdefault(t, plain_winnow(t, k, window))
    hashes = lambda t: {h for _, h in prints(t)}
    assert len(got) == len(rows)
    for r, (i, n, edited, after), (_, text) in zip(got, plain_edited(rows), rows, strict=True):
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (i, n, sha(edited))
        assert list(zip(r["positions"], [h % 2**64 for h in r["hashes"]], strict=True)) == prints(text)
        assert list(zip(r["edited_positions"], [h % 2**64 for h in r["edited_hashes"]], strict=True)) == prints(edited)
        assert r["near_edited"] == pytest.approx(jaccard(hashes(text), hashes(edited)))
        assert r["near_next"] == pytest.approx(jaccard(hashes(text), hashes(after)))


@pytest.mark.parametrize("run", [40, 1 << 19])
def test_edited_fingerprints_over_ranges(spark, monkeypatch, run):
    rng = random.Random(9)
    rows = [(i * 7 - 300, "".join(rng.choice("ab é😀\n") for _ in range(rng.randrange(90)))) for i in range(120)]
    rows += [(10_000, None), (10_001, ""), (10_002, "x"), (10_003, "long text " * 3000)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    monkeypatch.setattr(winnow, "RUN", run)
    found = winnow.edited_fingerprints(frame(spark, [(i, t, None) for i, t in shuffled]).repartition(7), 5, 6).collect()
    check_edited(sorted(found, key=lambda r: r["doc_id"]), [(i, t or "") for i, t in rows], 5, 6)


def test_fingerprint_edges(spark):
    assert winnow.edited_fingerprints(frame(spark, []).limit(0)).count() == 0 and winnow.fingerprints(frame(spark, []).limit(0)).count() == 0
    one = winnow.edited_fingerprints(frame(spark, [(None, "alone in the table, and long enough to have a window or two of grams", None)])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["doc_id"] is None
    same = winnow.edited_fingerprints(frame(spark, [(3, "same", None)] * 5 + [(None, "same", None)] * 4)).collect()
    assert len(same) == 9 and {r["near_next"] for r in same} == {1.0} and len({tuple(r["hashes"]) for r in same}) == 1
    a = {r["doc_id"]: r for r in winnow.fingerprints(frame(spark, [(1, "abc " * 50, None), (2, "", None), (3, None, None)])).collect()}
    assert a[1]["n_chars"] == 200 and a[2]["positions"] == a[3]["hashes"] == []


def test_op11_query(spark):
    docs = sorted((i, t or "") for i, t in documents(spark))
    got = sorted(op11_fingerprints(spark, FIXTURE).collect(), key=lambda r: r["doc_id"])
    by_text = defaultdict(set)
    for r, (i, n, edited, _), (_, text) in zip(got, plain_edited(docs), docs, strict=True):
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (i, n, sha(edited))
        by_text[text].add(r["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())
    for r, (_, text) in list(zip(got, docs, strict=True))[::20]:
        assert r["fingerprint"] == ",".join(f"{p}:{h:016x}" for p, h in plain_winnow(text, winnow.K, winnow.WINDOW))
    long = [r for r in got if r["n_chars"] > 1000]
    assert 0.45 < np.mean([r["near_edited"] for r in long]) < 0.75 and np.median([r["near_next"] for r in long]) < 0.1


# --- Merkle -----------------------------------------------------------------------------------


def plain_field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_leaf(row):
    return sha("".join(map(plain_field, row)))


def plain_levels(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + fanout])) for k in range(0, len(levels[-1]), fanout)])
    return levels


def plain_proof(levels, at, fanout, digest):
    said = ""
    for level in levels[:-1]:
        start = at - at % fanout
        run = level[start : start + fanout]
        said += "".join(run[: at - start] + run[at - start + 1 :])
        digest = sha("".join([*run[: at - start], digest, *run[at - start + 1 :]]))
        at //= fanout
    return said, digest


def plain_merkle(rows, fanout=8):
    """Rows of (doc_id, source, lang, n_chars, text)."""
    forest = defaultdict(list)
    for row in rows:
        forest[row[2]].append(row)
    langs = sorted(forest, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(forest[lang], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[lang] = own, plain_levels([plain_leaf(r) for r in own], fanout)
    top = plain_levels([trees[lang][1][-1][0] for lang in langs], fanout)
    out = []
    for spot, lang in enumerate(langs):
        own, levels = trees[lang]
        for at, row in enumerate(own):
            tampered = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                tampered = (*row[:4], "".join(c.lower() if c.isascii() else c for c in row[4]))
            below, digest = plain_proof(levels, at, fanout, plain_leaf(tampered))
            above, digest = plain_proof(top, spot, fanout, digest)
            out.append((row[0], plain_leaf(row), levels[-1][0], top[-1][0], sha(below + above), digest, digest == top[-1][0]))
    return sorted(out, key=repr)


def proofs(docs, fanout=8):
    return sorted((tuple(r) for r in merkle.merkle_proofs(merkle.merkle_manifest(docs, fanout)).collect()), key=repr)


def read(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_op12_query(spark):
    docs = spark.read.parquet(f"{FIXTURE}/documents.parquet")
    assert sorted((tuple(r) for r in op12_merkle(spark, FIXTURE).collect()), key=repr) == plain_merkle(read(docs))


@pytest.mark.parametrize(("fanout", "page"), [(8, 4), (2, 1), (3, 2)])
def test_proofs_over_many_levels_and_pages(spark, monkeypatch, fanout, page):
    """A language with most rows, languages of every small size, unaligned ranges (4 tasks), pages of a few leaves."""
    monkeypatch.setattr(merkle, "PAGE_LEVELS", page)
    rng = random.Random(fanout)
    rows = [(i, f"Text {i}" * rng.randrange(4), "hot") for i in range(150)]
    rows += [(1000 + 50 * k + j, "Ä B", f"l{k}") for k in range(1, 20) for j in range(k)]
    rows += [(None, None, None), (None, "X", None), (7, "Y", None), (7, "Y", None), (7, "Y", "hot"), (5000, "y" * 100_000 + "Z", ""), (5001, "", "é")]
    rng.shuffle(rows)
    docs = frame(spark, rows).repartition(5)
    got = proofs(docs, fanout)
    assert got == plain_merkle(read(docs), fanout)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65])
def test_small_tables(spark, n):
    docs = frame(spark, [(i, "T", "x") for i in range(n)])
    assert proofs(docs) == plain_merkle(read(docs))
    made = merkle.merkle_manifest(docs)
    assert made.root == (plain_merkle(read(docs))[0][3] if n else None)
    assert made.nodes.count() == sum(len(x) for x in plain_levels(["-"] * n, 8)[1:])  # every node once


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 90), st.integers(2, 5), st.data())
def test_ranges_and_their_edges_make_every_node(n, fanout, data):
    """However leaves are cut into runs, completed peaks and edges merged by parent are all nodes of the tree."""
    leaves = [f"{k:x}" for k in range(n)]
    cuts = sorted(data.draw(st.sets(st.integers(1, n - 1), max_size=8))) if n > 1 else []
    made, edges = {}, defaultdict(dict)
    for a, b in zip([0, *cuts], [*cuts, n], strict=True):
        own = merkle.Range((), n, a, fanout)
        for k in range(a, b):
            own.push(leaves[k])
        own.close()
        for level, i, d in own.made:
            assert made.setdefault((level, i), d) == d
        for level, i, d in own.edges:
            edges[level][i] = d
        assert len(own.edges) <= 2 * (fanout - 1) * len(own.sizes)
    levels = plain_levels(leaves, fanout)
    for level in range(len(levels) - 1):
        runs = defaultdict(dict)
        for i, d in edges[level].items():
            runs[i // fanout][i] = d
        for parent, run in runs.items():
            digest = sha("".join(run[i] for i in sorted(run)))
            assert (level + 1, parent) not in made
            made[level + 1, parent] = edges[level + 1][parent] = digest
    assert made == {(level, i): d for level, x in enumerate(levels) if level for i, d in enumerate(x)}


# --- fill-in-middle ---------------------------------------------------------------------------

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t-\r]+[ \t-\r]*|[ \t-\r]+", "char": r"(?s:.)"}


def plain_fim(doc_id, text, units="line", rate=100, spm=50):
    text = text or ""
    parts = re.findall(UNITS[units], text)
    key = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(key[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(parts)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\n \té😀\x0b<P>", max_size=40), st.sampled_from(sorted(UNITS)))
def test_ranks_from_events_equal_units(text, units):
    marks, sentinel = fim.events(fim.event_automaton(units, fim.SENTINELS), text)
    n, end = fim.unit_ranks(marks, len(text), units)
    parts = re.findall(UNITS[units], text)
    assert n == len(parts) and [end(r) for r in range(n + 1)] == [len("".join(parts[:r])) for r in range(n + 1)]
    assert sentinel == any(s in text for s in fim.SENTINELS)


@pytest.mark.parametrize(("units", "rate", "spm"), [("line", 100, 50), ("word", 50, 0), ("char", 90, 100)])
def test_transform_and_exact_round_trip(spark, units, rate, spm):
    texts = [None, "", "\n", "\n\n\n", "one line", "a\nb\r\nc", "holds <M> itself", "<S", "a<\n<P\nS>\n", "<<P", "é😀\n" * 9, "x" * 300_000 + "\n", "\n" * 50_000]
    rows = [(i, t, None) for i, t in enumerate(texts * 4)] + [(None, "no\nid\n", None), (3, "a\nb", None), (3, "a\nb", None)]
    docs = frame(spark, rows)
    got = fim.fim_restore(fim.fim_transform(docs, units, rate, spm)).collect()
    want = sorted((*plain_fim(i, t, units, rate, spm), t or "") for i, t, _ in rows if i is not None)
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == want
    assert [tuple(r) for r in got if r["doc_id"] is None] == [(*plain_fim(None, "no\nid\n", units, rate, spm), "no\nid\n")]
    assert fim.fim_transform(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="units"):
        fim.fim_transform(docs, "page")


def test_op13_query(spark):
    got = {r["doc_id"]: tuple(r) for r in op13_fill_in_middle(spark, FIXTURE).collect()}
    for i, text in documents(spark):
        *head, output = plain_fim(i, text)
        assert got[i] == (*head, sha(output), sha(text or ""))
