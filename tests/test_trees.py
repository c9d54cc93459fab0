from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators import generators, learning, trees
from helpers import frame


def same(a: trees.Trees, b: trees.Trees) -> bool:
    return (
        all(np.array_equal(x, y) for x, y in zip(a.cuts, b.cuts))
        and np.array_equal(a.feature, b.feature) and np.array_equal(a.bin, b.bin) and np.array_equal(a.value, b.value)
    )


def exhaustive(x, y, depth):
    """Means of a tree that tries every cut between values."""

    def grow(rows, d):
        best = (1e-9, None)
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                left = x[rows, f] <= cut
                a, b = y[rows][left], y[rows][~left]
                gain = y[rows].var() * len(rows) - a.var() * len(a) - b.var() * len(b)
                if gain > best[0] + 1e-9:
                    best = (gain, left)
        if d == depth or best[1] is None:
            out[rows] = y[rows].mean()
        else:
            grow(rows[best[1]], d + 1)
            grow(rows[~best[1]], d + 1)

    out = np.zeros(len(y))
    grow(np.arange(len(y)), 0)
    return out


def table(spark, x, y, parts=3):
    return frame(spark, [(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, features array<double>, label double").repartition(parts)


def predicted(df, model):
    return np.array([r["prediction"] for r in trees.predict(df, model).orderBy("id").collect()])


def test_a_tree_equals_the_search_of_all_cuts(spark):
    draw = np.random.default_rng(1)
    x = np.round(draw.normal(size=(120, 3)) * 4)  # few values, so each is a bin
    y = x[:, 0] * 2 + (x[:, 1] > 1) * 7 + draw.normal(size=120)
    df = table(spark, x, y)
    assert predicted(df, learning.decision_tree(df, ["id"], depth=3)) == pytest.approx(exhaustive(x, y, 3), abs=1e-6)


@pytest.fixture(scope="module")
def mixed(spark):
    return generators.gen_mixed_table(generators.id_range(spark, 1200, 4), 6).cache()


FITS = {
    "tree": lambda d: learning.decision_tree(d, ["id"], depth=6),
    "forest": lambda d: learning.random_forest(d, ["id"], trees=5, depth=6),
    "boosted": lambda d: learning.gradient_boosted_tree(d, trees=5, depth=3),
}


@pytest.mark.parametrize("name", FITS)
def test_trees_beat_the_mean_and_do_not_follow_the_partitions(mixed, name):
    train, test = learning.train_test_split(mixed, ["id"])
    models = [FITS[name](train.repartition(parts)) for parts in (1, 4, 64)]
    assert same(models[0], models[1]) and same(models[0], models[2])
    error, variance = trees.predict(test, models[0]).agg(F.avg(F.pow(F.col("label") - F.col("prediction"), 2)), F.var_pop("label")).first()
    assert error < 0.6 * variance


def test_each_boosted_tree_lowers_the_error(mixed):
    errors = []
    for count in (1, 3, 6):
        found = trees.predict(mixed, learning.gradient_boosted_tree(mixed, trees=count, depth=3))
        errors.append(found.agg(F.avg(F.pow(F.col("label") - F.col("prediction"), 2))).first()[0])
    assert errors == sorted(errors, reverse=True)


def test_classes(spark):
    df = generators.gen_mixed_table(generators.id_range(spark, 800, 4), 6, label_type=3)
    model = learning.decision_tree(df, ["id"], depth=5, label_type=3)
    found = trees.predict(df, model)
    assert found.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] > 0.45
    assert {r[0] for r in found.select("prediction").distinct().collect()} <= {0.0, 1.0, 2.0}
    assert np.allclose(model.value[0, 0].sum(), 1)  # shares of the classes


def test_many_features_go_in_few_passes(spark):
    """200 features: one shuffle of at most a block per node for each level."""
    df = generators.gen_mixed_table(generators.id_range(spark, 600, 4), 200)
    before = spark.sparkContext.statusTracker()
    model = learning.random_forest(df, ["id"], trees=3, depth=3)
    assert before is not None and (model.feature[:, 0] >= 0).all()
    used = set(model.feature[model.feature >= 0].tolist())
    assert max(used) < 200 and len(used) > 5


def test_groups_of_nodes_give_the_same_trees(mixed, monkeypatch):
    whole = FITS["forest"](mixed)
    monkeypatch.setattr(trees, "MAX_CELLS", 6 * 32 * 2 * 30)  # thirty nodes a pass
    monkeypatch.setattr(trees, "FEATURE_BLOCK", 2)
    assert same(whole, FITS["forest"](mixed))


def test_subsets_of_features_and_bootstrap_weights(spark):
    assert trees.allowed_features(0, 0, 10, 10).all()
    sets = [tuple(np.flatnonzero(trees.allowed_features(t, n, 10, 3))) for t in range(3) for n in range(5)]
    assert all(len(s) == 3 for s in sets) and len(set(sets)) > 5
    assert [trees.subset_size("auto", 9, 1, 0), trees.subset_size("auto", 9, 5, 0), trees.subset_size("auto", 9, 5, 2)] == [9, 3, 3]
    with pytest.raises(ValueError):
        trees.subset_size("some", 9, 5, 0)
    drawn = spark.range(4000).select(F.explode(trees.bootstrap_weights(F.col("id"), 3)).alias("w"))
    mean, none = drawn.agg(F.avg("w"), F.avg((F.col("w") == 0).cast("int"))).first()
    assert mean == pytest.approx(1, abs=0.03) and none == pytest.approx(np.exp(-1), abs=0.02)


def test_buckets_keep_the_order_of_values():
    x = np.sort(np.concatenate([np.random.default_rng(2).normal(size=500) * 10.0 ** np.arange(-250, 250), [0.0, -0.0, 1, 2, 128, -1, np.inf, -np.inf]]))
    assert (np.diff(trees.buckets(x)) >= 0).all()
    assert len(np.unique(trees.buckets(np.arange(-200.0, 201.0)))) == 401


def test_nulls_one_label_and_no_rows(spark):
    schema = "id long, features array<double>, label double"
    data = [(k, [float(k % 5), None if k == 3 else float(k)], float(k % 5)) for k in range(40)]
    df = frame(spark, [*data, (50, None, 1.0), (51, [1.0, 1.0], None), (52, [1.0, 1.0], float("nan"))], schema)
    model = learning.decision_tree(df, ["id"], depth=4)
    found = {r["id"]: r["prediction"] for r in trees.predict(df, model).collect()}
    assert found[50] is None and all(found[k] == k % 5 for k in range(40))
    same_label = learning.decision_tree(frame(spark, [(k, [float(k)], 2.5) for k in range(9)], schema), ["id"])
    assert (same_label.feature < 0).all() and same_label.value[0, 0, 0] == 2.5
    with pytest.raises(ValueError):
        learning.decision_tree(df.limit(0), ["id"])
    with pytest.raises(ValueError):
        learning.decision_tree(df, ["id"], bins=300)


def test_a_pass_reads_blocks_of_rows_in_the_order_of_their_codes(spark):
    """Levels cost a row of bytes per block, not a row per line, and one file is dealt over several tasks."""
    df = generators.gen_mixed_table(generators.id_range(spark, 90_000, 1), 3).select("id", F.transform("features", lambda x: F.round(x)).alias("features"), "label")
    binned, cuts, n, _, _ = trees._prepared(df, "features", "label", ["id"], 2, True, 8)
    assert n == 90_000 and 1 < binned.count() <= 8
    batches = binned.toArrow().to_batches()
    for codes, y, drawn in trees._blocks(batches, len(cuts)):
        assert len(codes) == len(y) == len(drawn) and drawn.shape[1] == 2
        assert (np.lexsort(codes.T[::-1]) == np.arange(len(codes))).all()
