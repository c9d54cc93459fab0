from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators import factors, generators, learning
from helpers import frame


def draw(*what):
    return int(hashlib.md5(":".join(map(str, what)).encode()).hexdigest()[:12], 16) / (1 << 48)


def table(df):
    return {r["id"]: np.array(r["v"]) for r in df.collect()}


def als_by_hand(data, rank, rounds, reg):
    start = lambda side, i: np.array([draw(side, i, j) / math.sqrt(rank) for j in range(rank)])
    users, items = {u: start("user", u) for u, _, _ in data}, {i: start("item", i) for _, i, _ in data}

    def half(own, other, vectors):
        found = {}
        for key in {r[own] for r in data}:
            x = np.array([vectors[r[other]] for r in data if r[own] == key])
            y = np.array([r[2] for r in data if r[own] == key])
            found[key] = np.linalg.solve(x.T @ x + reg * len(y) * np.eye(rank), x.T @ y)
        return found

    for _ in range(rounds):
        items = half(1, 0, users)
        users = half(0, 1, items)
    return users, items


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_als_equals_the_normal_equations(spark, monkeypatch, parts):
    """Small blocks, and a user and an item that hold a third of the ratings and lie over several blocks."""
    monkeypatch.setattr(factors, "BLOCK_EDGES", 40)
    rng = np.random.default_rng(3)
    data = [(int(u), int(i), float(r)) for u, i, r in zip(rng.integers(0, 20, 150), rng.integers(0, 15, 150), rng.integers(1, 6, 150))]
    data += [(99, k, 3.0 + k % 3) for k in range(75)] + [(k, 77, 1.0 + k % 5) for k in range(75)]
    df = frame(spark, [*data, (None, 1, 1.0), (1, None, 1.0), (1, 1, None)], "user long, item long, rating double").repartition(parts)
    users, items = factors.als(df, rank=3, iterations=2)
    for found, exact in zip((table(users), table(items)), als_by_hand(data, 3, 2, 0.1)):
        assert found.keys() == exact.keys()
        assert all(np.allclose(found[k], exact[k], atol=1e-8) for k in exact)


def test_als_beats_the_mean_on_held_out_pairs(spark):
    ratings = generators.gen_ratings(generators.id_range(spark, 4000, 4), 60, 40).dropDuplicates(["user", "item"]).cache()
    train, test = learning.train_test_split(ratings, ["user", "item"])
    mean = train.agg(F.avg("rating")).first()[0]
    users, items = factors.als(train, rank=4, iterations=5)
    found = factors.als_predict(test, users, items)
    error, base = found.agg(F.avg(F.pow(F.col("rating") - F.col("prediction"), 2)), F.avg(F.pow(F.col("rating") - F.lit(mean), 2))).first()
    assert error < base / 2
    unknown = factors.als_predict(frame(spark, [(10**6, 1), (1, None)], "user long, item long"), users, items)
    assert [r["prediction"] for r in unknown.collect()] == [None, None]


def lda_by_hand(docs, topics, rounds, eta=1.1):
    alpha = 50 / topics + 1
    counts = {(d, w): n for d, words in docs.items() for w, n in Counter(words).items()}
    words = sorted({w for _, w in counts})
    total = Counter()
    for (_, w), n in counts.items():
        total[w] += n
    u = {w: np.array([0.5 + draw(w, k) for k in range(topics)]) for w in words}
    by_word = {w: u[w] * total[w] / u[w].sum() for w in words}
    by_doc = {d: np.full(topics, len(ws) / topics) for d, ws in docs.items() if ws}
    values = []
    for _ in range(rounds):
        norm = sum(by_word.values()) + len(words) * (eta - 1)
        phi = {w: (v + eta - 1) / norm for w, v in by_word.items()}
        theta = {d: (v + alpha - 1) / (v + alpha - 1).sum() for d, v in by_doc.items()}
        by_word, by_doc = {w: np.zeros(topics) for w in words}, {d: np.zeros(topics) for d in by_doc}
        value = sum((alpha - 1) * np.log(t).sum() for t in theta.values()) + sum((eta - 1) * np.log(p).sum() for p in phi.values())
        for (d, w), n in counts.items():
            share = phi[w] * theta[d]
            value += n * math.log(share.sum())
            by_word[w] += n * share / share.sum()
            by_doc[d] += n * share / share.sum()
        values.append(value)
    norm = sum(by_word.values()) + len(words) * (eta - 1)
    return {(k, w): (by_word[w][k] + eta - 1) / norm[k] for w in words for k in range(topics)}, values


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_topics_equal_the_rounds_by_hand(spark, monkeypatch, parts):
    monkeypatch.setattr(factors, "BLOCK_EDGES", 60)
    docs = {r["id"]: r["words"] for r in generators.gen_documents(generators.id_range(spark, 30, 2), 40, 15).collect()}
    docs |= {100: [], 101: ["w1"] * 60}
    df = frame(spark, [*docs.items(), (102, None), (103, [None])], "id long, words array<string>").repartition(parts)
    found, values = factors.lda(df, ["id"], "words", topics=3, iterations=4)
    exact, exact_values = lda_by_hand(docs, 3, 4)
    got = {(r["topic"], r["word"]): r["weight"] for r in found.collect()}
    assert got.keys() == exact.keys() and all(got[k] == pytest.approx(exact[k], abs=1e-10) for k in exact)
    assert values == pytest.approx(exact_values)
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:]))


def test_topics_find_two_vocabularies(spark):
    rng = np.random.default_rng(5)
    data = [(k, [f"{'ab'[k % 2]}{rng.integers(0, 12)}" for _ in range(30)]) for k in range(60)]
    found, _ = factors.lda(frame(spark, data, "id int, words array<string>"), ["id"], "words", topics=2, iterations=15, alpha=1.1)
    mass = found.groupBy("topic").agg(F.sum(F.when(F.col("word").startswith("a"), F.col("weight"))).alias("a"), F.sum("weight").alias("all"))
    shares = sorted(r["a"] for r in mass.collect())
    assert all(r["all"] == pytest.approx(1) for r in mass.collect())
    assert shares[0] < 0.1 and shares[1] > 0.9


def test_vocabulary_keeps_the_most_frequent_words_and_no_words_give_no_topics(spark):
    df = frame(spark, [(1, ["b", "a", "a"]), (1, ["c", "c", "c"]), (2, ["b", "d"])], "id int, words array<string>")
    edges, words = factors.word_counts(df, ["id"], "words", 3)
    assert [(r["word"], r["number"], r["n"]) for r in words.orderBy("number").collect()] == [("a", 1, 2), ("b", 2, 2), ("c", 3, 3)]
    assert edges.count() == 4  # both rows of id 1 are one document
    found, values = factors.lda(df.where("id > 5"), ["id"], "words", topics=2, iterations=2)
    assert found.count() == 0 and values == [0.0, 0.0]


def test_blocks_are_ranges_of_ids_so_neighbours_share_vectors(spark, monkeypatch):
    """Four groups of ids without links between them: a vector goes to the blocks of its own group alone."""
    monkeypatch.setattr(factors, "BLOCK_EDGES", 100)
    edges = spark.range(4000).selectExpr("id div 1000 * 100 + id % 100 as a", "id div 1000 * 10 + id div 100 % 10 as b", "1.0 as v").distinct()
    blocks = factors.Blocks(edges, "a", "b", "v")
    assert blocks.edges.count() == edges.count()
    routes, others = blocks.routes.count(), edges.select("b").distinct().count()
    blocks.free()
    assert routes <= 12 * others
