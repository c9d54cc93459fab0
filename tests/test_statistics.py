from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators import generators, matrix, statistics
from helpers import frame, rows


def numbers(spark, n=200, d=4, seed=6, parts=4):
    x = np.random.default_rng(seed).normal(size=(n, d))
    x[:, 0] = np.round(x[:, 0])  # many ties
    names = [f"c{i}" for i in range(d)]
    data = [(i, *map(float, r)) for i, r in enumerate(x)]
    return frame(spark, data, "id bigint, " + ", ".join(f"{n} double" for n in names)).repartition(parts), x, names


def test_summary_statistics(spark):
    df, x, names = numbers(spark)
    for i, row in enumerate(statistics.summary_statistics(df, names).orderBy("column").collect()):
        c = x[:, i]
        expected = [len(c), c.mean(), c.var(ddof=1), np.count_nonzero(c), c.min(), c.max(), abs(c).sum(), np.sqrt((c**2).sum())]
        assert list(row)[1:] == pytest.approx(expected)


def test_pearson(spark):
    df, x, names = numbers(spark)
    got = {(r["i"], r["j"]): r["corr"] for r in statistics.pearson(df, names).collect()}
    expected = np.corrcoef(x.T)
    assert all(got[a, b] == pytest.approx(expected[i, j]) for i, a in enumerate(names) for j, b in enumerate(names))


def mean_ranks(c):
    return np.array([(c < v).sum() + ((c == v).sum() + 1) / 2 for v in c])


@pytest.mark.parametrize("parts", [1, 4, 64])
@pytest.mark.parametrize("row_id", [["id"], None])
def test_spearman_with_ties(spark, parts, row_id):
    df, x, names = numbers(spark, n=120, d=3, parts=parts)
    got = {(r["i"], r["j"]): r["corr"] for r in statistics.spearman(df, names, row_id).collect()}
    expected = np.corrcoef(np.array([mean_ranks(x[:, i]) for i in range(3)]))
    assert all(got[a, b] == pytest.approx(expected[i, j]) for i, a in enumerate(names) for j, b in enumerate(names))


def chi_square(table):
    e = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    return ((table - e) ** 2 / e).sum(), (table.shape[0] - 1) * (table.shape[1] - 1)


def test_chi_square_matrix_with_an_empty_cell(spark):
    cells = {("a", "x"): 5, ("a", "y"): 7, ("b", "x"): 3, ("c", "x"): 2, ("c", "y"): 9}
    df = frame(spark, [k for k, n in cells.items() for _ in range(n)] + [(None, "x"), ("a", None)], "r string, c string")
    got = statistics.chi_square_matrix(df, "r", "c").first()
    assert tuple(got) == pytest.approx(chi_square(np.array([[5, 7], [3, 0], [2, 9.0]])))


def test_chi_square_gof(spark):
    df = frame(spark, [(c,) for c in "aaaabbc"], "c string")
    o = np.array([4, 2, 1.0])
    assert tuple(statistics.chi_square_gof(df, "c").first()) == pytest.approx((((o - 7 / 3) ** 2 / (7 / 3)).sum(), 2))
    shares = frame(spark, [("a", 0.5), ("b", 0.2), ("c", 0.2), ("d", 0.1)], "c string, share double")
    o, e = np.array([4, 2, 1, 0.0]), 7 * np.array([0.5, 0.2, 0.2, 0.1])
    assert tuple(statistics.chi_square_gof(df, "c", shares).first()) == pytest.approx((((o - e) ** 2 / e).sum(), 3))


def test_chi_square_feature_finds_the_dependent_one(spark):
    data = generators.gen_chi_square_data(generators.id_range(spark, 2000, 4), 3, 4)
    df = data.select(*[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(3)], "label")
    p = {r["feature"]: r["p_value"] for r in statistics.chi_square_feature(df, ["f0", "f1", "f2"], "label").collect()}
    assert p["f0"] < 1e-6 and min(p["f1"], p["f2"]) > 1e-4


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_gramian_covariance_and_svd(spark, parts):
    x = np.random.default_rng(7).normal(size=(90, 5)) + 100
    df = frame(spark, [(i, r.tolist()) for i, r in enumerate(x)], "id bigint, row array<double>").repartition(parts)
    gram, cov = x.T @ x, np.cov(x.T)
    for i, j, v in rows(matrix.gramian(df, "row")):
        assert v == pytest.approx(gram[i, j])
    for i, j, v in rows(matrix.covariance(df, "row")):
        assert v == pytest.approx(cov[i, j])
    solved = matrix.svd(df, "row", 3)
    sigma = np.linalg.svd(x, compute_uv=False)[:3]
    assert [r["sigma"] for r in solved.orderBy("component").collect()] == pytest.approx(sigma.tolist())
    u = np.array([r["u"] for r in matrix.left_vectors(df, "row", solved).collect()])
    assert u.T @ u == pytest.approx(np.eye(3), abs=1e-6)


def test_pca_explains_variance(spark):
    x = np.random.default_rng(8).normal(size=(100, 4)) * [5, 2, 1, 0.1]
    df = frame(spark, [(r.tolist(),) for r in x], "row array<float>")
    model, vectors = matrix.pca(df, "row", 2)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert model.explainedVariance.toArray() == pytest.approx(values[:2] / values.sum(), rel=1e-4)
    assert model.transform(vectors).count() == 100


@pytest.mark.parametrize("block", [3, 1024])
def test_block_matrix_multiply(spark, block):
    draw = np.random.default_rng(9)
    a = draw.integers(1, 9, size=(7, 11)) * (draw.random((7, 11)) < 0.4)
    b = draw.integers(1, 9, size=(11, 5)) * (draw.random((11, 5)) < 0.4)
    a[:, 0], b[0, :] = 3, 2  # one inner index that joins everything

    def entries(m, names):
        return frame(spark, [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], f"{names[0]} int, {names[1]} int, value double")

    product = a @ b
    got = {(r["i"], r["j"]): r["value"] for r in matrix.block_matrix_multiply(entries(a, "ik"), entries(b, "kj"), block).collect()}
    assert got == {(int(i), int(j)): float(product[i, j]) for i, j in zip(*np.nonzero(product))}


def test_sparse_entries_are_not_copied_to_each_block_of_rows(spark):
    a = frame(spark, [(i * 10, i % 40, 1.0) for i in range(400)], "i int, k int, value double")
    b = frame(spark, [(k, j, 1.0) for k in range(40) for j in range(5)], "k int, j int, value double")
    left, right = matrix.deal_blocks(a, b, 8)
    assert left.count() <= 4 * 400 and right.count() <= 16 * 200  # 50 copies each if every block of rows had its own
    groups = left.groupBy("bk", "p", "q").count().agg(F.max("count")).first()[0]
    assert groups <= 2 * 8 * 8


@pytest.mark.parametrize("cells", [1, 50, 1 << 22])
def test_sparse_and_full_groups_give_the_same_product(spark, monkeypatch, cells):
    monkeypatch.setattr(matrix, "MOST_CELLS", cells)
    draw = np.random.default_rng(4)
    a, b = (draw.integers(-3, 4, size=shape) * (draw.random(shape) < 0.3) for shape in ((30, 20), (20, 9)))
    sides = [frame(spark, [(int(x) * 7, int(y) * (7 if n == "kj" else 1), float(m[x, y])) for x, y in zip(*np.nonzero(m))], f"{n[0]} int, {n[1]} int, value double") for m, n in ((a, "ik"), (b, "kj"))]
    sides[1] = sides[1].withColumn("k", (F.col("k") / 7).cast("int"))
    got = {(r["i"] // 7, r["j"] // 7): r["value"] for r in matrix.block_matrix_multiply(*sides, 64).collect() if r["value"]}
    product = a @ b
    assert got == {(int(i), int(j)): float(product[i, j]) for i, j in zip(*np.nonzero(product))}


def test_block_multiply_keeps_null_rows_and_large_ids(spark):
    large = (1 << 60) + 1
    a = frame(spark, [(None, 1, 2.0), (large, 1, 3.0), (5, None, 1.0)], "i long, k long, value double")
    b = frame(spark, [(1, None, 5.0), (1, 4, 7.0), (None, 4, 1.0)], "k long, j long, value double")
    got = rows(matrix.block_matrix_multiply(a, b))
    assert got == sorted([(None, None, 10.0), (None, 4, 14.0), (large, None, 15.0), (large, 4, 21.0)], key=repr)


def test_block_multiply_of_one_table_with_itself(spark):
    m = frame(spark, [(0, 1, 2.0), (1, 0, 3.0)], "i int, k int, value double")
    square = matrix.block_matrix_multiply(m, m.select(F.col("i").alias("k"), F.col("k").alias("j"), "value"))
    assert rows(square) == [(0, 0, 6.0), (1, 1, 6.0)]




def test_rows_with_a_null_are_left_out_of_all_statistics(spark):
    draw = np.random.default_rng(3)
    data = [(None, 1.0)] + [(float(a), float(b)) for a, b in draw.integers(0, 9, size=(60, 2))] + [(4.0, None)]
    df = frame(spark, data, "a double, b double")
    whole = frame(spark, data[1:-1], "a double, b double")
    arrays = df.select(F.when(F.col("a").isNotNull(), F.array("a", "b")).alias("v"))
    for got, expected in (
        (statistics.summary_statistics(df, ["a", "b"]), statistics.summary_statistics(whole, ["a", "b"])),
        (statistics.summary_statistics(arrays, "v"), statistics.summary_statistics(whole.select(F.array("a", "b").alias("v")), "v")),
    ):
        for a, b in zip(rows(got), rows(expected)):
            assert a[0] == b[0] and a[1:] == pytest.approx(b[1:])
    for test in (statistics.pearson, statistics.spearman):
        got, expected = ({(r["i"], r["j"]): r["corr"] for r in test(t, ["a", "b"]).collect()} for t in (df, whole))
        assert got == pytest.approx(expected)


def test_unexpected_category_and_large_counts(spark):
    df = frame(spark, [("x",)] * 10 + [("odd",)] * 90, "c string")
    expected = frame(spark, [("x", 1.0), ("y", 1.0)], "c string, share double")
    assert statistics.chi_square_gof(df, "c", expected).first()["statistic"] == float("inf")
    seen = statistics.chi_square_gof(df.where("c = 'x'"), "c", expected).first()
    assert (seen["statistic"], seen["dof"]) == (10.0, 1)
    assert statistics.chi_square_gof(df.where("c is null"), "c").first()["statistic"] is None


def test_covariance_of_one_row_is_null(spark):
    one = frame(spark, [([1.0, 2.0],)], "v array<double>")
    assert [r["value"] for r in matrix.covariance(one, "v").collect()] == [None, None, None]


def test_rank_correlation_of_hot_and_rare_values_together(spark):
    """Ranks carry their rows, by which hot ones are broadcast; hot and rare values of one column are both ranked."""
    table = spark.range(6000).selectExpr("id", "double(CASE WHEN id % 3 = 0 THEN id ELSE -1 END) AS a", "double(id % 7) AS b")
    ranks = statistics._column_ranks(table, ["a", "b"])
    assert {r[0]: r[1] for r in ranks.groupBy("_column").sum("_n").collect()} == {"a": 6000, "b": 6000}
    found = {(r["i"], r["j"]): r["corr"] for r in statistics.spearman(table, ["a", "b"], ["id"]).collect()}
    rows = table.toPandas()
    assert abs(found["a", "b"] - rows["a"].rank().corr(rows["b"].rank())) < 1e-9
