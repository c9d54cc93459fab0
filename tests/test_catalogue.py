from __future__ import annotations

import pytest

from gaugework.plans import catalogue
from gaugework.sources.lookups import WORKLOAD_CATEGORY, WORKLOAD_SIZES

SMALL = {
    "num-examples": 200, "num-features": 6, "num-rows": 80, "num-cols": 20, "num-users": 20, "num-products": 15,
    "num-rating": 200, "num-documents": 30, "num-vocab": 40, "num-sentences": 60, "num-words": 20, "num-baskets": 50,
    "num-items": 10, "num-sequences": 20, "m": 6, "k": 7, "n": 5,
}
SHORT = {
    "lda": {"num-iterations": 3, "num-topics": 3},
    "gmm": {"num-iterations": 3, "num-centers": 3},
    "kmeans": {"num-centers": 3},
    "pic": {"num-iterations": 5, "num-centers": 4},
    "pca": {"rank": 5},
    "als": {"num-iterations": 3},
    "word2vec": {"num-iterations": 1, "vector-size": 5},
    "decision-tree": {"tree-depth": 4},
    "random-forest": {"tree-depth": 4, "num-trees": 3},
    "gradient-boosted-tree": {"tree-depth": 3, "num-trees": 3},
    "prefix-span": {"avg-sequence-size": 2, "avg-itemset-size": 2},
}
ROWS = {"svd": 10, "summary-statistics": 20, "pearson": 400, "spearman": 400, "block-matrix-mult": 30,
        "chi-sq-feature": 20, "chi-sq-gof": 1, "chi-sq-mat": 1, "regression": 21, "classification": 21,
        "naive-bayes": 200, "kmeans": 200, "gmm": 200, "lda": 3, "pca": 80, "als": 200}


@pytest.mark.parametrize("workload", sorted(WORKLOAD_SIZES))
def test_every_workload_runs_by_name(spark, workload):
    sizes = {k: v for k, v in SMALL.items() if k in WORKLOAD_SIZES[workload][0]}
    count = catalogue.run_workload(spark, workload, "warmup", 4, {**sizes, **SHORT.get(workload, {})}).count()
    assert count == ROWS.get(workload, count) and count > 0


SUITE = [w for w, c in WORKLOAD_CATEGORY.items() if c != "ml" and w not in ("sleep", "dfsioe")]


@pytest.mark.parametrize("app", sorted(SUITE))
def test_every_suite_workload_runs_by_name(spark, app):
    assert catalogue.run_suite(spark, app, 300, 4).count() > 0


def test_unknown_names(spark):
    with pytest.raises(ValueError):
        catalogue.run_suite(spark, "nope", 10)
    with pytest.raises(KeyError):
        catalogue.run_workload(spark, "nope", "warmup")
