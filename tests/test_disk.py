"""Files that iterations leave: those of past rounds are gone."""

from __future__ import annotations

import time
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import pytest

from gaugework.lineage import cut_lineage, drop_checkpoint, ensure_checkpoint_dir, in_place, shuffles_dropped
from gaugework.operators import embedding, factors
from helpers import frame, rows
from test_factors import als_by_hand, lda_by_hand


def checkpoints(spark):
    ensure_checkpoint_dir(spark)
    return {p.name for p in Path(urlparse(spark.sparkContext.getCheckpointDir()).path).glob("rdd-*")}


def shuffles(spark):
    """Numbers of the shuffles that have files."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    names = [blocks.apply(k).name() for k in range(blocks.size())]
    return {name.split("_")[1] for name in names if name.startswith("shuffle_")}


def left(spark, work):
    """Checkpoints and shuffles that ``work`` leaves; files of shuffles go a moment later."""
    before, shuffled = checkpoints(spark), shuffles(spark)
    kept = work()
    for _ in range(50):
        if not shuffles(spark) - shuffled:
            break
        time.sleep(0.1)
    assert kept is not None
    return len(checkpoints(spark) - before), len(shuffles(spark) - shuffled)


def test_a_table_kept_in_place_has_no_shuffle_files_and_lost_blocks_come_back(spark):
    made = []
    with shuffles_dropped(spark):
        df = spark.range(1000).selectExpr("id % 7 as a", "id as b").repartition(4, "a")
        assert left(spark, lambda: made.append(in_place(df)) or made) == (0, 0)
    kept = made[0]
    exact = rows(kept)
    plan = kept._jdf.queryExecution().withCachedData()
    cached = plan.cacheBuilder().cachedColumnBuffers().id()
    spark._jvm.org.apache.spark.SparkEnv.get().blockManager().master().removeRdd(cached, True)
    assert rows(kept.select("a", "b")) == exact and len(exact) == 1000
    kept.unpersist()


def test_dropped_checkpoints_are_gone(spark):
    before = checkpoints(spark)
    kept, past = cut_lineage(spark.range(10)), cut_lineage(spark.range(10))
    drop_checkpoint(past, None)
    assert len(checkpoints(spark) - before) == 1 and kept.count() == 10


def test_topics_leave_as_much_after_many_rounds_as_after_few(spark):
    df = frame(spark, [(k, [f"w{k % 5}", f"w{k % 7}", "x"]) for k in range(40)], "id int, words array<string>")
    few, many = (left(spark, lambda n=n: factors.lda(df, ["id"], "words", topics=2, iterations=n)) for n in (1, 5))
    assert few == many


def test_topics_in_waves_equal_the_rounds_by_hand(spark, monkeypatch):
    monkeypatch.setattr(factors, "BLOCK_EDGES", 20)
    monkeypatch.setattr(factors, "WAVE_NUMBERS", 1)
    docs = {k: [f"w{(k * k + j) % 11}" for j in range(k % 9)] for k in range(40)}
    edges = factors.word_counts(frame(spark, [*docs.items()], "id int, words array<string>"), ["id"], "words")[0]
    blocks = factors.LongBlocks(edges)
    assert len(blocks.waves(3)) > 2
    blocks.free()
    found, values = factors.lda(frame(spark, [*docs.items()], "id int, words array<string>"), ["id"], "words", topics=3, iterations=3)
    exact, exact_values = lda_by_hand(docs, 3, 3)
    got = {(r["topic"], r["word"]): r["weight"] for r in found.collect()}
    assert got.keys() == exact.keys() and all(got[k] == pytest.approx(exact[k], abs=1e-10) for k in exact)
    assert values == pytest.approx(exact_values)


def ratings(spark):
    data = [(u, i, 1.0 + (u * i) % 5) for u in range(25) for i in range(12) if (u * 7 + i * 3) % 4 != 1] + [(99, i, 2.0 + i % 3) for i in range(60)]
    return data, frame(spark, data, "user long, item long, rating double")


def test_factors_leave_as_much_after_many_rounds_as_after_few(spark):
    _, df = ratings(spark)
    few, many = (left(spark, lambda n=n: factors.als(df, rank=2, iterations=n)) for n in (1, 4))
    assert few == many


def test_factors_in_waves_equal_the_normal_equations(spark, monkeypatch):
    monkeypatch.setattr(factors, "BLOCK_EDGES", 40)
    monkeypatch.setattr(factors, "WAVE_NUMBERS", 1)
    data, df = ratings(spark)
    blocks = factors.Blocks(df, "user", "item", "rating")
    assert len(blocks.waves(3)) > 1
    blocks.free()
    users, items = factors.als(df, rank=3, iterations=2)
    for found, exact in zip((users, items), als_by_hand(data, 3, 2, 0.1)):
        got = {r["id"]: list(r["v"]) for r in found.collect()}
        assert got.keys() == exact.keys() and all(got[k] == pytest.approx(list(exact[k]), abs=1e-8) for k in exact)


def test_edges_find_their_blocks_by_the_first_of_each():
    import pyarrow as pa

    names = ["own", "_part", "other", "value", "parts"]
    keys = [(1, 0), (2, 0), (2, 1), (2, 2), (2, 3), (3, 0), (7, 0), (9, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), *[pa.array(range(8))] * 3], names)
    found = next(factors.dealt_by([(1, 0), (2, 1), (2, 3), (7, 0)])([batch]))
    assert found.column("block").to_pylist() == [0, 0, 1, 1, 2, 2, 3, 3]


def test_word_vectors_leave_as_much_after_many_rounds_as_after_few(spark):
    df = frame(spark, [(k, [f"w{k % 3}", f"v{k % 4}", "x"]) for k in range(30)], "id int, words array<string>")
    few, many = (left(spark, lambda n=n: embedding.word2vec(df, "words", size=2, min_count=1, iterations=n)) for n in (1, 4))
    assert few == many


@pytest.mark.parametrize("held", [3, 500_000])
def test_pairs_of_a_word_with_itself_and_of_texts_longer_than_a_chunk(spark, monkeypatch, held):
    monkeypatch.setattr(embedding, "HELD_WORDS", held)
    data = [(1, ["a", "a", None, "b", "a", "c", "b", "b"]), (2, None), (3, []), (4, ["b", "a"]), (5, ["rare"])]
    df = frame(spark, data, "id int, words array<string>").repartition(1)
    words = embedding.vocabulary(df, "words", 2)
    names = {r["number"]: r["word"] for r in words.collect()}
    exact = Counter()
    for _, ws in data:
        for i, a in enumerate(ws or []):
            for j, b in enumerate(ws or []):
                if i != j and abs(i - j) <= 2 and a in names.values() and b in names.values():
                    exact[a, b] += 1
    assert {(names[r["own"]], names[r["other"]]): r["n"] for r in embedding.pair_counts(df, "words", words, 2).collect()} == exact
