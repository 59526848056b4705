"""The pipeline's stages against plain re-statements, each on its own input."""

import pytest

import corpus_pipeline as cp
from lumenframe.llm.toxicity import score_toxicity

from .test_text_ops import brute_lines, brute_near, brute_windows

FIXTURE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FIXTURE}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in cp.STAGES:
        done = stage(spark, out[-1][1], FIXTURE)
        out.append((name, spark.createDataFrame(done.collect(), done.schema)))
    return dict(out)


def texts(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(stages):
    for name in ("toxicity", "line_dedup", "near_dedup", "decontamination"):
        assert stages[name].dtypes == stages["documents"].dtypes


def test_toxicity_drops_what_is_predicted(spark, stages):
    docs = stages["documents"]
    bad = {r["doc_id"] for r in score_toxicity(docs, spark.read.parquet(f"{FIXTURE}/labels.parquet")).filter("predicted = 1").collect()}
    assert {i for i, _ in texts(stages["toxicity"])} == {i for i, _ in texts(docs)} - bad and bad


def test_lines(stages):
    want = {i: t for i, t, _, _ in brute_lines(texts(stages["toxicity"]))}
    assert dict(texts(stages["line_dedup"])) == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages["line_dedup"].collect())


def test_near_duplicates(stages):
    rows = texts(stages["line_dedup"])
    want = {i for i, (_, _, kept) in brute_near(rows, 5).items() if kept}
    assert {i for i, _ in texts(stages["near_dedup"])} == want


def test_decontamination(spark, stages):
    rows = texts(stages["near_dedup"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FIXTURE}/benchmark.parquet").collect()]
    want = {i for i, v in brute_windows(rows, items).items() if not v[4]}
    assert {i for i, _ in texts(stages["decontamination"])} == want


def test_mixing_leaves_nothing_out(stages):
    rows = stages["mixing"].collect()
    assert {r["doc_id"] for r in rows} == {i for i, _ in texts(stages["decontamination"])}


def test_run_is_the_stages_in_order(spark, stages):
    assert sorted(map(tuple, cp.run(spark, FIXTURE).collect())) == sorted(map(tuple, stages["mixing"].collect()))


def test_clashing_columns_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 9, "y"), (None, "a b c", None, None, None), (2, None, "x", 1, "z"), (2, None, "x", 1, "z")],
                                 "doc_id long, text string, source string, n_lines long, carried string")
    for _, stage in cp.STAGES[:-1]:
        done = stage(spark, docs, FIXTURE)
        assert done.dtypes == docs.dtypes and done.count() == 4
