"""Every stage of the corpus pipeline on its own input, against brute force."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from reachlab.llm.common import materialise
from tests.llm import helpers as H

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """[(name, input, output)] with the stages' results written and read again, as run() does."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = materialise(stage(spark, docs, SF), "test-stage")
        out.append((name, docs, result))
        docs = result
    return out


def test_columns(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_quality_keeps_good_documents(spark, stages):
    _, before, after = stages[0]
    kept = {r["doc_id"] for r in after.collect()}
    for r in before.collect():
        if H.quality_base(r["text"])["base_failed"]:
            assert r["doc_id"] not in kept
    good = [r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    good = [k for k in good if not H.quality_base(texts[k])["base_failed"]]
    assert sum(k in kept for k in good) >= 0.98 * len(good)


def test_lines(stages):
    _, before, after = stages[1]
    want = H.line_windows([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_near_duplicates(stages):
    _, before, after = stages[2]
    groups = H.near_groups({r["doc_id"]: r["text"] for r in before.collect()})
    assert {r["doc_id"] for r in after.collect()} == {k for k, (_, c) in groups.items() if k == c}


def test_mix(stages):
    _, before, after = stages[3]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    sizes, taken, times = Counter(), Counter(), Counter()
    for r in before.collect():
        sizes[r["source"]] += len(H.words(r["text"]))
    for r in after.collect():
        assert r["text"] in texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
        taken[r["source"]] += len(H.words(r["text"]))
        times[r["doc_id"]] += len(H.words(r["text"]))
    for s, target in H.water_fill(sizes).items():
        assert abs(taken[s] - target) <= 256
    assert all(n <= 3 * len(H.words(texts[k])) for k, n in times.items())


def test_packing(stages):
    _, before, after = stages[4]
    rows = after.collect()
    assert sum(r["piece"] == 0 for r in rows) == before.count()
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 2048) + 1


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got.collect()) == sorted(
        (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in stages[-1][2].collect())


def test_empty_tables(spark):
    docs = H.documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
