"""Matrix workloads on rows held as arrays and on coordinate entries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.blas import one_thread
from gaugework.lineage import cut_lineage


def gramian(df: DataFrame, column: str, center: list[float] | None = None) -> DataFrame:
    """Sums of products ``(i, j, value)`` of the columns of a row matrix, i <= j.

    Each task adds up its Arrow batches as numpy products and emits one triangle; the shuffle moves
    those, added up in the map tasks by ``(i, j)``, never products of single rows. ``center`` is subtracted from every row first.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            rows = rows.astype("float64") - (0.0 if center is None else np.asarray(center))
            total = rows.T @ rows if total is None else total + rows.T @ rows
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "value"])

    rows = df.select(column).where(F.col(column).isNotNull())
    triangles = rows.mapInArrow(partial, "i int, j int, value double")
    return triangles.groupBy("i", "j").agg(F.sum("value").alias("value"))


def width(df: DataFrame, column: str) -> int:
    row = df.select(F.size(column)).where(F.col(column).isNotNull()).first()
    return row[0] if row else 0


def _vectors(column: str):
    return array_to_vector(F.col(column).cast("array<double>"))


def column_means(df: DataFrame, column: str) -> tuple[int, list[float]]:
    """Row count and mean of each column."""
    rows = df.where(F.col(column).isNotNull())
    count, mean = rows.select(Summarizer.metrics("count", "mean").summary(_vectors(column)).alias("s")).select("s.*").first()
    return count, mean.toArray().tolist()


def covariance(df: DataFrame, column: str) -> DataFrame:
    """Sample covariance ``(i, j, value)``, i <= j; the rows are centred before they are multiplied."""
    n, means = column_means(df, column)
    return gramian(df, column, means).withColumn("value", F.try_divide("value", F.lit(n - 1)))


def _dense(entries: DataFrame, d: int) -> np.ndarray:
    """A symmetric matrix of model size from its triangle."""
    triangle = entries.toPandas()
    full = np.zeros((d, d))
    full[triangle["i"], triangle["j"]] = triangle["value"]
    full[triangle["j"], triangle["i"]] = triangle["value"]
    return full


def svd(df: DataFrame, column: str, rank: int = 10) -> DataFrame:
    """The largest singular values with their right vectors, ``(component, sigma, v)``.

    The rows stay distributed; only the columns x columns matrix of sums is solved on the driver.
    """
    one_thread()
    values, vectors = np.linalg.eigh(_dense(gramian(df, column), width(df, column)))
    order = np.argsort(values)[::-1][:rank]
    data = [
        (k, float(np.sqrt(max(values[i], 0.0))), [float(x) for x in vectors[:, i]]) for k, i in enumerate(order)
    ]
    return df.sparkSession.createDataFrame(data, "component int, sigma double, v array<double>")


def left_vectors(df: DataFrame, column: str, decomposition: DataFrame, name: str = "u") -> DataFrame:
    """Add the row of U of each row: its products with the right vectors over their singular values."""
    solved = [r for r in decomposition.orderBy("component").collect() if r["sigma"] > 0]

    def dot(v: list[float], sigma: float):
        products = F.zip_with(F.col(column).cast("array<double>"), F.lit(v), lambda x, y: x * y)
        return F.aggregate(products, F.lit(0.0), lambda a, x: a + x) / F.lit(sigma)

    return df.withColumn(name, F.array(*[dot(r["v"], r["sigma"]) for r in solved]))


def pca(df: DataFrame, column: str, k: int = 50):
    """Fit principal components of the rows; the model's ``transform`` projects them."""
    vectors = df.withColumn("features", _vectors(column))
    return PCA(k=k, inputCol="features", outputCol="projected").fit(vectors), vectors


#: Numbers of a matrix, or products, that a group holds at once, and products of single entries that cost as much as one of a full matrix.
MOST_CELLS = 1 << 22
DENSE_COST = 100


def deal_blocks(a: DataFrame, b: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The entries of both matrices by the group ``bk, p, q`` in which they meet: ranges of ``k``, parts of A and of B.

    A null row or column is part -1, so that the ids of the other parts stay whole numbers in pandas.
    """
    full = block * block
    left, right = (
        cut_lineage(df.select(*names, F.col("value").cast("double").alias("value")).where("k is not null")) for df, names in ((a, "ik"), (b, "kj"))
    )
    own = F.floor(F.col("k") / F.lit(block))
    fill = [df.groupBy(own.alias("bk")).count().agg(F.avg("count")).first()[0] or 0 for df in (left, right)]
    wide = block * max(1, int(full // (2 * max(1, *fill))))
    left, right = (df.withColumn("bk", F.floor(F.col("k") / F.lit(wide))) for df in (left, right))

    def counted(df: DataFrame, by: str, name: str) -> DataFrame:
        parts = F.ceil(F.count(F.lit(1)) / F.lit(full)).cast("int")
        return df.groupBy("bk").agg(parts.alias(f"_{name}"), F.min(F.when(F.col(by).isNull(), -1).otherwise(0)).alias(f"_{name}_first"))

    parts = counted(left, "i", "p").join(counted(right, "j", "q"), "bk")

    def dealt(df: DataFrame, by: str, own: str, other: str) -> DataFrame:
        part = F.when(F.col(by).isNull(), -1).otherwise(F.pmod(F.xxhash64(by), F.col(f"_{own}")).cast("int")).alias(own)
        every = F.explode(F.sequence(F.col(f"_{other}_first"), F.col(f"_{other}") - 1)).alias(other)
        return df.join(parts, "bk").select("bk", part, every, *[c for c in ("i", "k", "j") if c in df.columns], "value")

    return dealt(left, "i", "p", "q"), dealt(right, "j", "q", "p")


def block_matrix_multiply(a: DataFrame, b: DataFrame, block: int = 1024) -> DataFrame:
    """Product of coordinate matrices ``a(i, k, value)`` and ``b(k, j, value)`` as ``(i, j, value)``.

    The ids ``k`` are cut into ranges, of ``block`` ids or, where there are few entries, of so many times ``block`` that a range
    holds about half as many entries as a full block of ``block`` x ``block``. Rows of A and columns of B of a range that
    holds more are dealt to parts, and each part of A meets each part of B in one group: about two full blocks however full a row or
    column is (one entry per cell), and hardly any copies of sparse ones. The partial products of a cell are added up. Cells that come out
    as zero are left out.
    """

    def multiply(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"i": [], "j": [], "value": []})
        x, y = x[x["k"].isin(y["k"])], y[y["k"].isin(x["k"])]
        if x.empty:
            return pd.DataFrame({"i": [], "j": [], "value": []})
        i, i_at = np.unique(x["i"], return_inverse=True)
        j, j_at = np.unique(y["j"], return_inverse=True)
        k, x_k = np.unique(x["k"], return_inverse=True)
        y_k = np.searchsorted(k, y["k"])
        one_thread()
        x_value, y_value = x["value"].to_numpy(), y["value"].to_numpy()
        met = np.bincount(y_k, minlength=len(k))[x_k]
        cells = max(len(i) * len(k), len(k) * len(j), len(i) * len(j))
        if cells <= MOST_CELLS and len(i) * len(k) * len(j) <= DENSE_COST * int(met.sum()):
            dense_x, dense_y = np.zeros((len(i), len(k))), np.zeros((len(k), len(j)))
            np.add.at(dense_x, (i_at, x_k), x_value)
            np.add.at(dense_y, (y_k, j_at), y_value)
            product = dense_x @ dense_y
            at_i, at_j = np.nonzero(product)
            return pd.DataFrame({"i": i[at_i], "j": j[at_j], "value": product[at_i, at_j]})
        # entry by entry, in the order of the rows of A, some products at a time; a row is summed before it is handed on
        by_k = np.argsort(y_k, kind="stable")
        first = np.searchsorted(y_k[by_k], np.arange(len(k)))
        by_i = np.argsort(i_at, kind="stable")
        until = np.cumsum(met[by_i])
        found, begin = [], 0
        while begin < len(by_i):
            done = until[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(until, done + MOST_CELLS, side="right")))
            rows = by_i[begin:stop]
            n = met[rows]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            other = by_k[np.repeat(first[x_k[rows]], n) + place]
            cell, at = np.unique(np.repeat(i_at[rows], n) * len(j) + j_at[other], return_inverse=True)
            found.append((cell, np.bincount(at.ravel(), np.repeat(x_value[rows], n) * y_value[other], len(cell))))
            begin = stop
        cell, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        value = np.bincount(at.ravel(), np.concatenate([v for _, v in found]), len(cell))
        cell, value = cell[value != 0], value[value != 0]
        return pd.DataFrame({"i": i[cell // len(j)], "j": j[cell % len(j)], "value": value})

    left, right = (df.groupBy("bk", "p", "q") for df in deal_blocks(a, b, block))
    partial = left.cogroup(right).applyInPandas(multiply, "i bigint, j bigint, value double")
    return partial.groupBy("i", "j").agg(F.sum("value").alias("value"))
