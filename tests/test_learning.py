from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators import bayes, generators, learning, patterns, quasi_newton
from helpers import frame, rows


@pytest.fixture(scope="module")
def linear(spark):
    return generators.gen_labeled_points(generators.id_range(spark, 2000, 4), 4).cache()


def arrays(df):
    data = df.orderBy("id").collect()
    return np.array([r["features"] for r in data]), np.array([r["label"] for r in data])


def test_regression_line(linear):
    df = linear.select(F.get("features", F.lit(0)).alias("x"), "label")
    x, y = arrays(linear)
    assert tuple(learning.regression_line(df, "x", "label").first()) == pytest.approx(tuple(np.polyfit(x[:, 0], y, 1)))


def test_regression_sgd(linear):
    x, y = arrays(linear)
    w, losses = np.zeros(4), []
    for t in range(1, 7):
        losses.append(((x @ w - y) ** 2).mean() / 2 + 0.05 * w @ w)
        w = w - 0.1 / np.sqrt(t) * (x.T @ (x @ w - y) / len(y) + 0.1 * w)
    got = learning.regression_sgd(linear, iterations=6, step=0.1).orderBy("t").collect()
    assert [r["loss"] for r in got[:6]] == pytest.approx(losses)
    assert got[-1]["weights"] == pytest.approx(w.tolist())
    assert got[-1]["loss"] < got[0]["loss"]


def test_classification(spark):
    points = generators.gen_classification_points(generators.id_range(spark, 3000, 4), 5)
    share = points.agg(F.avg(F.col("label"))).first()[0]
    assert share == pytest.approx(0.7, abs=0.03)
    for model in (learning.classification(points), learning.logistic_regression(points)):
        found = quasi_newton.predict(points, model)
        assert found.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0] > 0.8


def test_classification_sgd(spark):
    points = generators.gen_classification_points(generators.id_range(spark, 500, 4), 3)
    x, y = arrays(points)
    w = np.zeros(3)
    for t in range(1, 9):
        p = 1 / (1 + np.exp(-(x @ w)))
        w = w - 0.5 / np.sqrt(t) * (x.T @ (p - y) / len(y) + 0.1 * w)
    got = learning.classification_sgd(points, iterations=8, step=0.5).orderBy("t").collect()
    assert got[-1]["weights"] == pytest.approx(w.tolist()) and got[-1]["loss"] < got[0]["loss"]
    for wrong in ({"loss": "hinge"}, {"reg_type": "l1"}):
        with pytest.raises(ValueError):
            learning.classification_sgd(points, **wrong)


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_split_does_not_depend_on_partitions(spark, parts):
    train, test = learning.train_test_split(generators.id_range(spark, 10_000, parts), ["id"])
    held = [r["id"] for r in test.orderBy("id").collect()]
    assert len(held) == pytest.approx(2000, abs=150)
    assert train.count() + len(held) == 10_000
    assert held[:5] == [r["id"] for r in learning.train_test_split(spark.range(10_000), ["id"])[1].orderBy("id").limit(5).collect()]


def test_clusters_follow_the_centres(spark):
    df = generators.gen_cluster_points(generators.id_range(spark, 1000, 4), 6, centers=4, noise=0.02)
    df = df.union(df.limit(1).withColumn("features", F.lit(None).cast("array<double>")))
    centres = learning.kmeans(df, "id", "features", 4)
    model, history = learning.gmm(df, "id", "features", 4)
    assert all(b >= a - 1e-9 for a, b in zip(history, history[1:]))
    near = learning.kmeans_assign(df, "features", centres).withColumnRenamed("centre", "prediction")
    for found in (near, learning.gmm_assign(df, "features", model)):
        assert found.where("prediction is null").count() == 1
        pairs = found.where("prediction is not null").groupBy("center", "prediction").count()
        largest = pairs.groupBy("center").agg(F.max("count").alias("n")).agg(F.sum("n")).first()[0]
        assert largest > 700


def test_mixture_uses_all_components_in_many_dimensions(spark):
    df = generators.gen_cluster_points(generators.id_range(spark, 4000, 4), 100, centers=20, noise=0.05).cache()
    model, _ = learning.gmm(df, "id", "features", 20, 5)
    pairs = learning.gmm_assign(df, "features", model).groupBy("center", "prediction").count()
    assert pairs.select("prediction").distinct().count() == 20


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_kmeans_does_not_follow_the_partitions(spark, parts):
    df = generators.gen_cluster_points(generators.id_range(spark, 300, 4), 5, centers=6, noise=0.3)
    first = learning.kmeans(df.repartition(3), "id", "features", 6, 4)
    assert np.allclose(first, learning.kmeans(df.repartition(parts), "id", "features", 6, 4), atol=1e-9)


@pytest.mark.parametrize("parts", [1, 4])
def test_kmeans_assign(spark, parts):
    draw = np.random.default_rng(10)
    x, centres = draw.normal(size=(100, 3)), draw.normal(size=(5, 3))
    centres[4] = centres[1]  # a tie goes to the lower number
    df = frame(spark, [(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>").repartition(parts)
    d = ((x[:, None] - centres[None]) ** 2).sum(2)
    got = learning.kmeans_assign(df, "v", centres.tolist()).orderBy("id").collect()
    assert [r["centre"] for r in got] == d.argmin(1).tolist()
    assert [r["distance"] for r in got] == pytest.approx(d.min(1).tolist())


DOCS = [(1, "good good film", "+"), (2, "bad film", "-"), (3, "good", "+"), (4, "bad bad plot", "-"), (5, "", "+")]


def test_text_bayes(spark):
    docs = frame(spark, DOCS, "id int, text string, label string")
    model = bayes.text_bayes(docs, "text", "label")
    got = {(r["label"], r["word"]): (r["n"], r["log_p"]) for r in model.collect()}
    assert got["+", "good"] == (3, pytest.approx(math.log(4 / (4 + 4))))
    assert got["-", "film"] == (1, pytest.approx(math.log(2 / (5 + 4))))
    labels = bayes.text_bayes_labels(docs, "text", "label")
    by_label = {r["label"]: r for r in labels.collect()}
    assert by_label["+"]["log_prior"] == pytest.approx(math.log(3 / 5))
    assert by_label["-"]["log_p_unseen"] == pytest.approx(math.log(1 / 9))
    new = frame(spark, [(10, "good plot unheard"), (11, "")], "id int, text string")
    score = {(r["doc"], r["label"]): r["score"] for r in bayes.text_bayes_score(model, labels, new, "id", "text").collect()}
    assert score[10, "+"] == pytest.approx(math.log(3 / 5 * 4 / 8 * 1 / 8))
    assert score[10, "-"] == pytest.approx(math.log(2 / 5 * 1 / 9 * 2 / 9))
    assert score[11, "+"] == pytest.approx(math.log(3 / 5))


def test_text_bayes_predict(spark):
    docs = frame(spark, [(i, t, 1.0 if s == "+" else 0.0) for i, t, s in DOCS], "id int, text string, label double")
    new = frame(spark, [(10, "good film"), (11, "bad plot")], "id int, text string")
    got = bayes.text_bayes_predict(docs, new, "id", "text", "label")
    assert rows(got.select("id", "prediction")) == [(10, 1.0), (11, 0.0)]


def test_naive_bayes_agrees_with_the_library(spark):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import VectorAssembler

    draw = random.Random(12)
    data = [(float(i % 2), *[float(draw.randrange(5)) for _ in range(3)]) for i in range(50)]
    df = frame(spark, data, "label double, a double, b double, c double")
    model = NaiveBayes(smoothing=1.0).fit(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df))
    for r in bayes.naive_bayes(df, ["a", "b", "c"], "label").collect():
        assert r["log_p"] == pytest.approx(model.theta.toArray()[int(r["label"]), "abc".index(r["feature"])])


@pytest.mark.parametrize("block", [1 << 14, 4])
def test_naive_bayes_on_an_array(spark, monkeypatch, block):
    monkeypatch.setattr(bayes, "SUM_BLOCK", block)
    draw = np.random.default_rng(3)
    x, y = draw.integers(0, 6, (90, 10)), draw.integers(0, 3, 90)
    x[:, :2] += 9 * (y == 1)[:, None]
    data = [(i, f"l{c}", r.astype(float).tolist()) for i, (c, r) in enumerate(zip(y, x))]
    df = frame(spark, [*data, (100, None, [1.0] * 10), (101, "l0", None), (102, "l0", [None] * 10)], "id int, label string, v array<double>")
    model = bayes.naive_bayes_array(df.repartition(4), "v", "label")
    sums = np.array([x[y == c].sum(0) for c in range(3)])
    exact = np.log((sums + 1) / (sums.sum(1, keepdims=True) + 10))
    for r in model.collect():
        c = int(r["label"][1])
        assert r["log_p"] == pytest.approx(exact[c, r["first"] : r["first"] + block].tolist())
        assert r["log_prior"] == pytest.approx(math.log((y == c).mean()))
    found = {r["id"]: r["prediction"] for r in bayes.naive_bayes_predict(df, model, "v").collect()}
    best = (x @ exact.T + np.log(np.bincount(y) / 90)).argmax(1)
    assert [found[i] for i in range(90)] == [f"l{c}" for c in best] and found[100] and found[101] is None and found[102] is None


def test_baskets_and_sequences_hold_no_copies(spark):
    data = [(1, 2, "a")] * 500 + [(1, 1, "b"), (1, 2, "c"), (2, 5, "a")]
    df = frame(spark, data, "k int, t int, item string")
    assert rows(patterns.baskets(df, "k", "item").select("k", F.sort_array("items"))) == [(1, ["a", "b", "c"]), (2, ["a"])]
    assert rows(patterns.sequences(df, "k", "t", "item")) == [(1, [["b"], ["a", "c"]]), (2, [["a"]])]


def test_frequent_patterns(spark):
    df = frame(spark, [(["a", "b"],), (["a", "b", "c"],), (["a"],)], "items array<string>")
    got = patterns.fp_growth(df, min_support=0.6).freqItemsets.select(F.sort_array("items"), "freq")
    assert rows(got) == [(["a", "b"], 2), (["a"], 3), (["b"], 2)]
    sequences = frame(spark, [([["a"], ["b"]],), ([["a"], ["c"], ["b"]],), ([["b"], ["a"]],)], "sequence array<array<string>>")
    found = {str(r["sequence"]): r["freq"] for r in patterns.prefix_span(sequences).collect()}
    assert found == {"[['a']]": 3, "[['b']]": 3, "[['a'], ['b']]": 2}


def test_prefix_span_gives_the_patterns_of_spark_and_gathers_no_prefix(spark):
    from pyspark.ml.fpm import PrefixSpan

    rng = np.random.default_rng(4)
    draw = lambda: [sorted({f"i{k}" for k in rng.integers(0, 5, rng.integers(1, 4))}, reverse=True) for _ in range(rng.integers(0, 6))]
    data = [(draw(),) for _ in range(150)] * 2 + [(None,), ([["rare"], ["i1"]],)]
    sequences = frame(spark, data, "sequence array<array<string>>")
    named = lambda found: sorted((str([sorted(s) for s in r["sequence"]]), r["freq"]) for r in found.collect())
    for support, length in ((0.1, 10), (0.05, 2), (0.9, 10)):
        whole = PrefixSpan(minSupport=support, maxPatternLength=length).findFrequentSequentialPatterns(sequences)
        assert named(patterns.prefix_span(sequences, min_support=support, max_length=length)) == named(whole)

    assert patterns.prefix_span(sequences.limit(0)).collect() == []
    seen, cut = [], patterns.cut_lineage
    patterns.cut_lineage = lambda df: seen.append(cut(df)) or seen[-1]
    try:
        patterns.prefix_span(frame(spark, [([["a"], ["b"]],)] * 500, "sequence array<array<string>>"))
    finally:
        patterns.cut_lineage = cut
    assert seen and max(t.count() for t in seen) <= 3


def test_words_to_score_are_counted_without_a_shuffle_by_text(spark, capsys):
    docs = frame(spark, [("x x y", 0), ("y z", 1)], "text string, label int")
    model, labels = bayes.text_bayes(docs, "text", "label"), bayes.text_bayes_labels(docs, "text", "label")
    whole, pieces = (frame(spark, data, "id int, text string") for data in ([(1, "x y x")], [(1, "x y"), (1, "x")]))
    scores = [{r["label"]: r["score"] for r in bayes.text_bayes_score(model, labels, t, "id", "text").collect()} for t in (whole, pieces)]
    assert scores[0] == pytest.approx(scores[1])
    bayes.text_bayes_score(model, labels, whole, "id", "text").explain()
    shown = capsys.readouterr().out
    assert "hashpartitioning(word" in shown and not any("hashpartitioning(doc" in line and "word" in line.split("hashpartitioning")[1] for line in shown.splitlines() if "hashpartitioning" in line)
