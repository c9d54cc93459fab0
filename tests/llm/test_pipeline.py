"""The stages, each by itself against what it must keep, on the smallest tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entries
import check
import corpus_pipeline as pipeline
from gaugework.llm import queries  # noqa: F401
from gaugework.llm.common import materialise
from gaugework.llm.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def stages(spark, checkpoint_folder):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tables = [docs]
    for name, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, FOLDER), f"test-{name}")
        tables.append(docs)
    return tables


def test_order_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "bpe"]
    for table in stages[:-1]:
        assert table.columns == stages[0].columns
    assert stages[-1].columns == ["doc_id", "source", "n_tokens", "ids", "decoded"]


def test_decisions_take_effect(stages):
    start, clean, distinct, apart, mix, tokens = (t.collect() for t in stages)
    assert 0.5 * len(start) < len(clean) <= len(start)
    texts = {}
    for r in clean:
        texts[r.text] = max(r.doc_id, texts.get(r.text, -1))
    assert sorted(r.doc_id for r in distinct) == sorted(texts.values())
    assert {r.doc_id for r in apart} <= {r.doc_id for r in distinct}
    words = lambda rows, s: sum(len((r.text or "").split()) for r in rows if r.source == s)
    counts = Counter(r.doc_id for r in mix)
    assert set(counts) <= {r.doc_id for r in apart} and max(counts.values()) <= 2
    assert any(words(mix, s) > words(apart, s) for s in {r.source for r in apart})
    assert sorted((r.doc_id, r.decoded) for r in tokens) == sorted((r.doc_id, r.text or "") for r in mix)


def test_registered():
    found = entries.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES} and found["pipeline"] is pipeline.run
    assert set(ORACLES) <= set(entries.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    verdict, count, _ = check.check(spark, check.connect(FOLDER), name, FOLDER)
    assert verdict == "ok" and count > 0
