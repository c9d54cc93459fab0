from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugework.llm import toxicity

INSULTS = ["blockhead", "nitwit", "dimwit", "numbskull"]
PLAIN = ["river", "stone", "garden", "letter", "window", "market", "silver", "morning", "teacher", "bridge", "yellow", "little", "bottle"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(PLAIN) for _ in range(rng.randint(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark, corpus, checkpoint_folder):
    rows, labels = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_documents(spark, corpus, trained):
    rows, labels = corpus
    scored = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), trained, keep=["doc_id"])
    scored = scored.withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()
    label = dict(labels)
    for r in scored:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [(r.score >= toxicity.THRESHOLD, label[r.doc_id]) for r in scored if r.held_out]
    assert np.mean([p == bool(t) for p, t in held]) > 0.97


@pytest.mark.parametrize("text", ["you n1tw1t go", "what a b l o c k h e a d", "nitttwiiit", "d.i.m.w.i.t", "num8skull", "NITWIT!!!"])
def test_obscured_words_are_restored(spark, trained, documents, text):
    padded = "river stone garden " + text + " window market"
    scores = {r.doc_id: r.score for r in toxicity.score_documents(documents([(1, padded), (2, "river stone garden window market")]), trained).collect()}
    assert scores[1] >= toxicity.THRESHOLD > scores[2]


@pytest.fixture(scope="module")
def short_words(spark, checkpoint_folder):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(PLAIN) for _ in range(rng.randint(5, 40))] + [rng.choice(["the", "1984", "$100", "wow!"])]
        if i % 4 == 0:
            words += [rng.choice(["idiot", "hate", "ass", "shit"]) for _ in range(3)]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))


OBSCURED = ["1d107", "h473", "5h17", "a55", "a$$", "i d 1 0 t", "1 d 1 0 7", "i  d  i  o  t", "i d\ti \n o t", "i.d.1.0.t", "idiot!"]


def test_words_of_signs_and_wide_spacing_are_restored(short_words, documents):
    rows = [(k, f"river stone garden {w} window market") for k, w in enumerate(OBSCURED)]
    clean = ["river stone garden window market", "river 1984 stone $100 1 2 3 4", "garden! market! a b c", "3.14 192.168.10.1 12:30 +49 30 1234567"]
    rows += [(100 + k, w) for k, w in enumerate(clean)]
    found = {r.doc_id: r.score >= toxicity.THRESHOLD for r in toxicity.score_documents(documents(rows), short_words).collect()}
    assert {w: found[k] for k, w in enumerate(OBSCURED)} == dict.fromkeys(OBSCURED, True)
    assert not any(found[100 + k] for k in range(len(clean)))


def test_words_of_signs_alone_are_searched(short_words):
    features = toxicity.Evidence(short_words.trigrams)
    assert len(features.features(pa.array(["@$$"]))[0]) == 0  # a rare word: three breaks are likelier
    features.restorer.cache[b"@$$"] = b"ass"
    assert len(features.features(pa.array(["@$$"]))[0]) == 1


def test_search_is_the_best_of_all_readings(trained):
    restorer = toxicity.Restorer(trained.trigrams)

    def every(chunk, k=0):
        if k == len(chunk):
            yield [], 0.0
            return
        for byte, weight in restorer.options(chunk, k):
            for rest, total in every(chunk, k + 1):
                yield [byte, *rest], weight + total

    def value(reading, weight):
        p = q = 0
        for byte in reading:
            if not byte or (byte == 32 and q == 0):
                continue
            c = int(toxicity._CLASS[byte])
            weight += trained.trigrams[p, q, c]
            p, q = q, c
        return weight + (trained.trigrams[p, q, 0] if q else 0.0)

    for chunk in [b"n1t", b"s.t", b"tt1", b"$iii", b"0l1"]:
        best = max(every(chunk), key=lambda x: value(*x))
        clean = []
        for byte in best[0]:
            if byte and not (byte == 32 and (not clean or clean[-1] == 32)):
                clean.append(byte)
        assert restorer.search(chunk) == bytes(clean)


def test_edges(spark, trained, documents):
    docs = documents([(1, None), (2, ""), (None, "river"), (3, "nitwit"), (3, "nitwit"), (4, "stone " * 100_000 + "nitwit dimwit"), (5, "é ü 日本")])
    docs = docs.withColumn("score", F.lit("mine"))
    out = toxicity.score_documents(docs, trained)
    found = {r.doc_id: r.score for r in out.collect()}
    assert out.count() == 7 and out.columns.count("score") == 1
    assert found[1] == found[2] and found[1] < toxicity.THRESHOLD <= found[3] and found[4] >= toxicity.THRESHOLD
    assert toxicity.score_documents(documents([]), trained).count() == 0


def test_no_labels_and_empty_tables(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = documents([(1, "river"), (2, None)])
    assert {r.score < toxicity.THRESHOLD for r in toxicity.score_documents(docs, toxicity.train(docs, none)).collect()} == {True}
    assert toxicity.drop_toxic(documents([]), none).count() == 0


def test_labels_of_held_out_rows_teach_nothing(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    labels = spark.createDataFrame([(i, 1) for i in ids] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.sample_labels(labels).count() == 0


def test_trigram_counts_cover_all_texts(spark):
    docs = spark.createDataFrame([("Abc ab",), (None,), ("é a",)], "text string").repartition(2)
    counts = toxicity.count_trigrams(docs)
    a, b, c = 1, 2, 3
    assert counts[0, a, b] == 2 and counts[a, b, c] == 1 and counts[a, b, 0] == 1
    assert isinstance(toxicity.language_model(counts), np.ndarray)
    assert np.allclose(np.exp(toxicity.language_model(counts)).sum(axis=2), 1)


def test_distinct_words_of_a_batch(trained):
    text, found = toxicity.Evidence(trained.trigrams).features(pa.array(["one two one", None, "Two"]))
    assert text.tolist().count(0) == 2 and text.tolist().count(2) == 1 and len(found) == 3
