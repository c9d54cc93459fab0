"""Leading singular values and principal components of row matrices with many columns.

The columns x columns matrix of products is never formed. A block of ``rank`` + ``OVERSAMPLE`` directions starts from md5 of the
columns' numbers; a round is one pass that sends it through the matrix and back, adding up one columns x directions matrix
from the tasks. The directions of all rounds together hold the leading singular vectors. A last pass multiplies the rows
by an orthonormal basis of them; each task reduces its rows to the triangle of their QR factors, triangles are stacked and
reduced again in a tree, and the singular values of the last one are those of the matrix. The driver holds columns x
directions numbers for each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.blas import one_thread
from gaugework.operators.quasi_newton import sums

OVERSAMPLE = 10
ROUNDS = 4
#: Triangles that one task of the tree stacks at a time.
FAN_IN = 16


def _rows(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def start(columns: int, directions: int) -> np.ndarray:
    """Normal numbers that follow from the columns' numbers alone."""
    seed = int(hashlib.md5(f"{columns}:{directions}".encode()).hexdigest()[:8], 16)
    return np.random.default_rng(seed).normal(size=(columns, directions))


def triangle(x: DataFrame, basis: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The R factor of (rows - centre) x basis: one triangle a task, then a tree of them."""
    width = basis.shape[1]
    shared = x.sparkSession.sparkContext.broadcast((basis, centre))

    def reduced(stack: np.ndarray, part: int):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.linalg.qr(stack, mode="r").tobytes()], pa.binary())], ["part", "r"])

    def leaf(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        one_thread()
        own, middle = shared.value
        held = np.zeros((0, width))
        for batch in batches:
            if batch.num_rows:
                held = np.vstack([held, (_rows(batch.column(0)) - middle) @ own])
                if len(held) > 8 * width:
                    held = np.linalg.qr(held, mode="r")
        if len(held):
            yield reduced(held, TaskContext.get().partitionId())

    def join(batches: Iterator) -> Iterator:
        one_thread()
        held, part = np.zeros((0, width)), 0
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held, part = np.vstack([held, np.frombuffer(raw).reshape(-1, width)]), number
        if len(held):
            yield reduced(held, part // FAN_IN)

    schema = "part int, r binary"
    level, parts = x.mapInArrow(leaf, schema), x.rdd.getNumPartitions()
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        level = level.withColumn("_to", F.expr(f"part div {FAN_IN}")).repartition(parts, "_to").sortWithinPartitions("part").select("part", "r")
        level = level.mapInArrow(join, schema)
    found = [np.frombuffer(r["r"]).reshape(-1, width) for r in level.orderBy("part").collect()]
    return np.linalg.qr(np.vstack(found), mode="r") if found else np.zeros((0, width))


def leading(df: DataFrame, column: str, rank: int, centred: bool = False, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Singular values (largest first), right vectors as rows, the row count and the column means of the rows, less their means
    if ``centred``. Rows with a null, or a null entry, are left out."""
    one_thread()
    values = F.col(column).cast("array<double>")
    rows = df.select(values.alias("_x")).where("_x is not null and not exists(_x, v -> v is null)").persist()
    n, columns = rows.agg(F.count("_x"), F.max(F.size("_x"))).first()
    if not n:
        return np.zeros(0), np.zeros((0, 0)), 0, np.zeros(0)
    means = sums(rows, lambda x: x.sum(axis=0).astype(float), columns) / n
    centre = means if centred else np.zeros(columns)
    directions = min(columns, rank + OVERSAMPLE)
    block, basis = np.linalg.qr(start(columns, directions))[0], []
    for _ in range(rounds):

        def there_and_back(x: np.ndarray, block: np.ndarray = block) -> np.ndarray:
            y = x.astype(float) - centre
            return (y.T @ (y @ block)).ravel()

        basis.append(block)
        if sum(b.shape[1] for b in basis) >= columns:
            break
        block = np.linalg.qr(sums(rows, there_and_back, columns * directions).reshape(columns, directions))[0]
    basis = np.linalg.qr(np.hstack([*basis, block]))[0][:, :columns]
    _, sigma, right = np.linalg.svd(triangle(rows, basis, centre), full_matrices=False)
    rows.unpersist()
    some = min(rank, len(sigma))
    return sigma[:some], right[:some] @ basis.T, n, means


def svd(df: DataFrame, column: str, rank: int = 10, rounds: int = ROUNDS) -> DataFrame:
    """``component, sigma, v`` of the largest singular values, as :func:`gaugework.operators.matrix.svd` gives them."""
    sigma, right, _, _ = leading(df, column, rank, rounds=rounds)
    data = [(k, float(s), v.tolist()) for k, (s, v) in enumerate(zip(sigma, right))]
    return df.sparkSession.createDataFrame(data, "component int, sigma double, v array<double>")


def pca(df: DataFrame, column: str, rank: int = 50, rounds: int = ROUNDS) -> DataFrame:
    """``component, variance, v`` of the directions of largest sample variance."""
    sigma, right, n, _ = leading(df, column, rank, centred=True, rounds=rounds)
    data = [(k, float(s * s / max(n - 1, 1)), v.tolist()) for k, (s, v) in enumerate(zip(sigma, right))]
    return df.sparkSession.createDataFrame(data, "component int, variance double, v array<double>")


def project(df: DataFrame, column: str, components: DataFrame, name: str = "projected") -> DataFrame:
    """The rows with their products with the components; null where the row is, or has one. Components go to every task."""
    basis = np.array([r["v"] for r in components.orderBy("component").collect()]).T
    shared = df.sparkSession.sparkContext.broadcast(basis)
    keep = df.columns
    values = F.col(column).cast("array<double>")
    whole = F.when(~F.exists(values, lambda v: v.isNull()), values)
    schema = df.select("*", F.lit(None).cast("array<double>").alias(name)).schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one_thread()
        own = shared.value
        for batch in batches:
            column = batch.column(len(keep))
            known, found = column.is_valid().to_numpy(zero_copy_only=False), [None] * batch.num_rows
            if known.any() and own.size:
                for row, product in zip(np.flatnonzero(known), (_rows(column.filter(pa.array(known))) @ own).tolist()):
                    found[row] = product
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.list_(pa.float64()))], [*keep, name])

    return df.select(*keep, whole.alias("_row")).mapInArrow(run, schema)
