from __future__ import annotations

import numpy as np
import pytest

from gaugework.operators import matrix, wide_matrix
from helpers import frame


def table(spark, x, parts=3):
    return frame(spark, [(i, r.tolist()) for i, r in enumerate(x)], "id long, row array<double>").repartition(parts)


def low_rank(n, d, seed=4):
    draw = np.random.default_rng(seed)
    return draw.normal(size=(n, 6)) * [50, 30, 20, 9, 5, 3] @ draw.normal(size=(6, d)) + 0.1 * draw.normal(size=(n, d)) + 2.0


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_singular_values_equal_those_of_the_whole_matrix(spark, parts):
    x = low_rank(200, 60)
    found = wide_matrix.svd(table(spark, x, parts), "row", 5).collect()
    _, sigma, right = np.linalg.svd(x)
    assert [r["sigma"] for r in found] == pytest.approx(sigma[:5], rel=1e-9)
    for r, v in zip(found, right):
        assert abs(np.dot(r["v"], v)) == pytest.approx(1, abs=1e-6)


def test_both_routes_give_the_same_energies(spark):
    df = table(spark, low_rank(150, 40))
    narrow = [r["sigma"] for r in matrix.svd(df, "row", 8).collect()]
    assert [r["sigma"] for r in wide_matrix.svd(df, "row", 8).collect()] == pytest.approx(narrow, rel=1e-6)


def test_components_of_the_variance(spark):
    x = low_rank(120, 50)
    found = wide_matrix.pca(table(spark, x), "row", 4).collect()
    assert [r["variance"] for r in found] == pytest.approx(np.linalg.eigvalsh(np.cov(x.T))[::-1][:4], rel=1e-8)


def test_many_columns(spark):
    """The matrix of products would have 400 million entries."""
    x = low_rank(40, 20_000)
    found = wide_matrix.svd(table(spark, x, 4), "row", 3, rounds=2).collect()
    assert [r["sigma"] for r in found] == pytest.approx(np.linalg.svd(x, compute_uv=False)[:3], rel=1e-6)


def test_nulls_few_rows_and_none(spark):
    schema = "id long, row array<double>"
    df = frame(spark, [(1, [3.0, 0.0]), (2, None), (3, [0.0, None]), (4, [0.0, 4.0])], schema)
    assert [r["sigma"] for r in wide_matrix.svd(df, "row", 5).orderBy("component").collect()] == pytest.approx([4.0, 3.0])
    assert wide_matrix.svd(df.where("id = 2"), "row", 2).count() == 0
    assert wide_matrix.pca(df.where("id = 1"), "row", 1).collect()[0]["variance"] == 0


def test_projection(spark):
    x = low_rank(30, 20)
    df = table(spark, x)
    components = wide_matrix.pca(df, "row", 3)
    basis = np.array([r["v"] for r in components.orderBy("component").collect()])
    found = {r["id"]: r["projected"] for r in wide_matrix.project(df.union(frame(spark, [(99, None)], df.schema)), "row", components).collect()}
    assert np.allclose([found[i] for i in range(30)], x @ basis.T) and found[99] is None
