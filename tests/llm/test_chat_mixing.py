"""Chat windows and source mixing against plain re-statements."""

import hashlib
import math
from collections import defaultdict

import duckdb
import pandas as pd

from lumenframe.llm.chat import chat_digests, format_chats, read_chats
from lumenframe.llm.sql import mixing_sql
from lumenframe.llm.mixing import exponent_for, mix_sources
from lumenframe.llm.queries import op8_chat_windows

FIXTURE = "/root/testdata/sf0.001"
CHATS = "conv_id long, turn long, role string, text string, window long, tokens string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_chats(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))
    return out


def chat_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], CHATS)


def test_chat_query_reads_back_what_it_was_given(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FIXTURE}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: tuple(r)[1:5] for r in op8_chat_windows(spark, FIXTURE).collect()}
    assert got == brute_chats(rows)


def test_chat_edges(spark):
    nasty = "&lt;<s>[TURN assistant]x[/TURN]</s>&amp;&lb;]é\n"
    rows = [(1, 0, "system", nasty), (1, 1, "user", nasty), (1, 2, "assistant", nasty), (2, 5, None, None), (2, None, "assistant", "first"), (3, 0, "system", "alone"),
            (4, 1, "assistant", "x" * 50_000), (4, 2, "user", ""), (4, 2, "user", ""), (5, 0, "a]b", "q"), (None, 0, "assistant", "no id"), (0, 0, "assistant", "id 0")]
    rows += [(6, k, "assistant" if k % 2 else "user", f"turn {k} " * 40) for k in range(60)] + [(6, -1, "system", "be kind")]
    for chunk in (512, 3):
        windows = format_chats(chat_frame(spark, rows), budget=600, history_turns=3, history_tokens=200, chunk=chunk)
        got = {r["conv_id"]: tuple(r)[1:5] for r in chat_digests(read_chats(windows)).collect()}
        assert got == brute_chats(rows)
        long = sorted(windows.filter("conv_id = 6").collect(), key=lambda r: r["window"])
        assert len(long) > 5
        for k, w in enumerate(long):
            assert w["tokens"] <= 600 and w["formatted"].startswith(f"<s>[{'PAST' if k else 'TURN'} system]be kind")
            assert k == 0 or 1 <= w["formatted"].count("[PAST ") - 1 <= 3
    assert format_chats(chat_frame(spark, [])).count() == 0


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 1) for i, t, s in rows], "doc_id long, text string, source string, key string, total int")


def test_mix_keeps_all_and_meets_the_weights(spark):
    rows = [(i, "w " * (20 + i % 7), "big") for i in range(900)] + [(1000 + i, "w " * 30, "mid") for i in range(90)] + [(2000 + i, "w " * 25, None) for i in range(40)]
    rows += [(3000, None, ""), (3001, "", ""), (None, "x", "big"), (5, "w " * 25, "big")]
    got = mix_sources(docs(spark, rows), target_entropy=0.9, max_repetition=6.0, block_tokens=4000, bucket_docs=16).collect()
    assert {(r["doc_id"], r["source"]) for r in got} == {(i, s) for i, _, s in rows}
    tokens, once = defaultdict(int), defaultdict(int)
    for r in got:
        tokens[r["source"]] += r["n_tokens"]
    for _, t, s in rows:
        once[s] += len((t or "").split()) + 1
    times = {s: tokens[s] / once[s] for s in once}
    assert min(times.values()) >= 1 and max(times.values()) / min(times.values()) <= 6.3 and abs(times["big"] - 1) < 0.01
    blocks = defaultdict(lambda: defaultdict(int))
    for r in got:
        blocks[r["block"]][r["source"]] += r["n_tokens"]
    total = sum(tokens.values())
    for b in list(blocks)[:-1]:
        here = sum(blocks[b].values())
        assert abs(blocks[b]["big"] / here - tokens["big"] / total) < 0.05
    for b in blocks:
        assert sorted(r["position"] for r in got if r["block"] == b) == list(range(1, sum(r["block"] == b for r in got) + 1))
    for s in once:  # an epoch holds a row no more than once
        seen = [(r["epoch"], r["doc_id"]) for r in got if r["source"] == s and r["doc_id"] not in (5, None)]
        assert len(seen) == len(set(seen))


def test_mix_budget_and_empty(spark):
    rows = [(i, "w " * 9, "a" if i % 3 else "b") for i in range(300)]
    got = mix_sources(docs(spark, rows), budget=1000, block_tokens=250).collect()
    assert 960 <= sum(r["n_tokens"] for r in got) <= 1000
    assert mix_sources(docs(spark, [])).count() == 0
    assert mix_sources(docs(spark, rows[:1])).count() == 1


def test_exponent_is_bisected(spark):
    shares = [0.7, 0.2, 0.06, 0.04]
    totals = spark.createDataFrame([(s,) for s in shares], "share double")

    def entropy(x):
        w = [s**x for s in shares]
        return -sum(v / sum(w) * math.log(v / sum(w)) for v in w)

    x = exponent_for(totals, 0.9, 100.0)
    assert abs(entropy(x) - 0.9 * math.log(4)) < 1e-5
    x = exponent_for(totals, 0.99, 2.0)
    assert abs((0.7 / 0.04) ** (1 - x) - 2.0) < 1e-5
    assert exponent_for(totals, 0.1, 100.0) == 1.0


def test_many_buckets_agree_with_sql(spark):
    """A bucket a document: as many as a source of ten million documents has by default."""
    rows = [(i, "w " * (i % 9), "big" if i % 3 else "small") for i in range(5000)]
    got = [tuple(r) for r in mix_sources(docs(spark, rows), block_tokens=3000, bucket_docs=1).collect()]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    assert sorted(got) == sorted(con.execute(mixing_sql(block_tokens=3000, bucket_docs=1)).fetchall())
