from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators import generators, learning, quasi_newton
from helpers import frame


def table(spark, x, y, parts=3):
    return frame(spark, [(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, features array<double>, label double").repartition(parts)


@pytest.fixture(scope="module")
def data():
    draw = np.random.default_rng(7)
    x = draw.normal(size=(500, 4)) * [1, 50, 0.01, 1] + [0, 1000, 3, 0]
    x[:, 3] = 2.0  # without deviation
    return x, x[:, 0] * 3 - x[:, 1] * 0.2 + x[:, 2] * 40 + 7 + draw.normal(size=500)


@pytest.mark.parametrize(("reg", "parts"), [(0.0, 1), (0.1, 4), (0.1, 64)])
def test_regression_equals_the_normal_equations(spark, data, reg, parts):
    x, y = data
    model = quasi_newton.fit(table(spark, x, y, parts), reg=reg)
    z = (x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0, ddof=1)
    exact = np.linalg.solve(z.T @ z / 500 + reg * np.eye(3), z.T @ (y - y.mean()) / 500)
    assert model.weights == pytest.approx(np.append(exact / x[:, :3].std(0, ddof=1), 0), rel=1e-7)
    assert model.margins(x) == pytest.approx(z @ exact + y.mean(), rel=1e-8)
    assert all(b <= a + 1e-12 for a, b in zip(model.history, model.history[1:]))


def test_logistic_equals_newtons_method(spark, data):
    x, y = data
    label = (y > np.median(y)).astype(float)
    model = quasi_newton.fit(table(spark, x, label), logistic=True, reg=0.05)
    z = np.c_[(x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0, ddof=1), np.ones(500)]
    held, w = 0.05 * np.diag([1, 1, 1, 0]), np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / 500 + held, z.T @ (p - label) / 500 + held @ w)
    assert model.margins(x) == pytest.approx(z @ w, abs=1e-6)


def test_ten_thousand_features(spark, monkeypatch):
    """More features than rows: blocks of sums, and a driver that holds a few vectors."""
    draw = np.random.default_rng(8)
    x = draw.normal(size=(60, 10_000))
    y = x[:, 0] * 5 + draw.normal(size=60) * 0.1
    monkeypatch.setattr(quasi_newton, "BLOCK", 1 << 10)
    model = quasi_newton.fit(table(spark, x, y), reg=0.01, iterations=12)
    assert len(model.weights) == 10_000 and model.history[-1] < model.history[0] / 10
    assert np.corrcoef(model.margins(x), y)[0, 1] > 0.99


def test_nulls_classes_and_no_rows(spark):
    schema = "id long, features array<double>, label double"
    rows = [(k, [float(k)], float(k > 4)) for k in range(10)] + [(20, None, 1.0), (21, [1.0], None), (22, [None], 0.0)]
    df = frame(spark, rows, schema)
    model = learning.classification(df)
    found = {r["id"]: r["prediction"] for r in quasi_newton.predict(df, model).collect()}
    assert [found[k] for k in range(10)] == [0.0] * 5 + [1.0] * 5
    assert found[20] is None and found[22] is None and found[21] == 0.0
    same = learning.regression(frame(spark, [(1, [1.0], 3.0), (2, [2.0], 3.0)], schema))
    assert same.weights.tolist() == [0.0] and same.constant == 3.0
    with pytest.raises(ValueError):
        learning.regression(df.limit(0))


def test_separated_classes_end(spark):
    df = generators.gen_classification_points(generators.id_range(spark, 400, 2), 3).withColumn("label", (F.col("features")[0] > 0).cast("double"))
    model = quasi_newton.fit(df, logistic=True, iterations=30)
    right = quasi_newton.predict(df, model).agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0]
    assert right > 0.99
