from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gaugework.llm import common as scratch
from gaugework.llm import mixing
from gaugework.llm.common import scratch_scope


def fill(sizes, weights, total, epochs):
    clamped = set()
    while True:
        left = total - sum(epochs * sizes[i] for i in clamped)
        rest = sum(w for i, w in enumerate(weights) if i not in clamped)
        more = {i for i in range(len(sizes)) if i not in clamped and weights[i] * left > epochs * sizes[i] * rest}
        if not more:
            return [epochs * s if i in clamped else weights[i] * left / rest for i, s in enumerate(sizes)]
        clamped |= more


@pytest.fixture
def corpus(documents):
    rng = random.Random(3)
    names = ["a", "b", "B", "é", None, "", "zz", "hot"]
    rows = []
    for i in range(600):
        name = "hot" if i % 3 == 0 else rng.choice(names)
        rows.append((i, " ".join(["w"] * rng.randint(0, 40)), "en", name, None))
    rows += [(9000, None, "en", "a", None), (9001, " \t\x0b", "en", "a", None), (9002, "long " * 30_000, "en", "zz", None), (None, "no id", "en", "a", None)]
    return rows, documents(rows)


def test_targets_and_taken_words(corpus):
    rows, docs = corpus
    found = mixing.plan_mix(docs, [5, 2, 1]).collect()
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    wanted = dict(zip(names, fill([sizes[s] for s in names], [[5, 2, 1][k % 3] for k in range(len(names))], 1.5 * sum(sizes.values()), 2)))
    assert len(found) == len(rows)
    for name in names:
        own = [r for r in found if r.source == name]
        assert own[0].target == pytest.approx(wanted[name])
        assert abs(sum(r.taken for r in own) - wanted[name]) < 1
        assert all(0 <= r.taken <= 2 * r.size for r in own)
        assert all(r.source_size == sizes[name] for r in own)


def test_same_rows_on_rerun_and_other_partitions(corpus):
    _, docs = corpus
    first = sorted(map(tuple, mixing.plan_mix(docs, [5, 2, 1]).collect()), key=repr)
    assert first == sorted(map(tuple, mixing.plan_mix(docs.repartition(7), [5, 2, 1]).collect()), key=repr)
    other = sorted(map(tuple, mixing.plan_mix(docs, [5, 2, 1], seed="other").collect()), key=repr)
    assert first != other


def test_mixed_rows(corpus):
    _, docs = corpus
    plan = {(r.doc_id, r.size): r.repeats for r in mixing.plan_mix(docs, [5, 2, 1]).collect()}
    extra = docs.withColumn("repeats", F.lit("mine")).withColumn("size", F.lit(0))
    for clash in ("_size", "_source", "_file", "_row", "_metadata", "_repeats"):
        extra = extra.withColumn(clash, F.lit("mine"))
    out = mixing.mix(extra, [5, 2, 1])
    assert out.columns == extra.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {i: n for (i, _), n in plan.items() if n}


def test_crowd_of_equal_rows_is_cut_at_the_border(spark, documents, tmp_path):
    crowd = [(i, "a b c d", "en", "hot", 7) for i in [5] * 400 + [None] * 100]
    docs = documents(crowd + [(k, "x y", "en", "cold", None) for k in range(20)])
    target = {r.source: r.target for r in mixing.plan_mix(docs, [5, 2], share=0.5).collect()}
    docs.write.parquet(f"{tmp_path}/docs")
    for table in (docs, spark.read.parquet(f"{tmp_path}/docs")):
        out = {r.source: r["count"] for r in mixing.mix(table, [5, 2], share=0.5).groupBy("source").count().collect()}
        assert abs(4 * out["hot"] - target["hot"]) <= 2 and abs(2 * out["cold"] - target["cold"]) <= 1


def test_texts_are_not_shuffled_and_scratch_goes(spark, documents, tmp_path):
    documents([(k, "x y z", "en", "s", None) for k in range(50)]).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    seen = []
    with scratch_scope(spark):
        out = mixing.mix(docs, [5, 2, 1])
        plan = out._jdf.queryExecution().executedPlan().toString()
        seen += scratch._scopes[-1]
        assert "Exchange hashpartitioning" not in plan and out.count() == 75
    assert len(seen) >= 3 and not any(Path(p.removeprefix("file:")).exists() for p in seen)


def test_empty_tables(documents):
    assert mixing.plan_mix(documents([]), [5, 2, 1]).count() == 0
    assert mixing.mix(documents([]), [5, 2, 1]).count() == 0
    nothing = mixing.plan_mix(documents([(1, None), (2, "")]), [5, 2, 1]).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2
