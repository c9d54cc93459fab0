"""Linear and logistic regression by a limited-memory quasi-Newton method, for any number of features.

A round is two passes over the packed rows, which stay in memory: one gives the loss at several steps along the direction, one
the gradient at the best of them. A task emits one vector, cut into blocks; the blocks are added up by the tasks that own
them. The driver holds the weights and the last ``MEMORY`` pairs of moves and gradient changes: a few vectors of one number
per feature, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.blas import one_thread
from gaugework.session import shuffle_partitions

MEMORY = 10
BLOCK = 1 << 14
#: Steps along a direction whose loss one pass gives: 4, 2, 1, 1/2, ...
STEPS = 2.0 ** np.arange(2, -14, -1)


@dataclass
class Linear:
    """Weights of the features as given, the constant, and the loss of each round."""

    weights: np.ndarray
    constant: float
    history: list[float]
    logistic: bool

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.constant


def _packed(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sums(rows: DataFrame, work: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``work(matrix)``, ``size`` numbers, over the packed rows of all Arrow batches."""

    def partial(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one_thread()
        total = None
        for batch in batches:
            if batch.num_rows:
                part = work(_packed(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            blocks = [total[a : a + BLOCK].tobytes() for a in range(0, size, BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["part", "sums"])

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        added: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(raw)
                added[part] = added[part] + values if part in added else values
        yield pa.RecordBatch.from_arrays([pa.array(list(added), pa.int32()), pa.array([v.tobytes() for v in added.values()], pa.binary())], ["part", "sums"])

    schema = "part int, sums binary"
    owners = min(shuffle_partitions(rows.sparkSession), -(-size // BLOCK))
    found = rows.mapInArrow(partial, schema).repartition(owners, "part").mapInArrow(add, schema).collect()
    total = np.zeros(size)
    for r in found:
        total[r["part"] * BLOCK : r["part"] * BLOCK + BLOCK] = np.frombuffer(r["sums"])
    return total


def _losses(margin: np.ndarray, y: np.ndarray, logistic: bool) -> float:
    return (np.logaddexp(0, margin) - y * margin).sum() if logistic else 0.5 * ((margin - y) ** 2).sum()


def _direction(gradient: np.ndarray, moves: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the inverse curvature of the last moves times the gradient."""
    q, kept = gradient.copy(), []
    for s, y in reversed(moves):
        a = (s @ q) / (s @ y)
        q -= a * y
        kept.append(a)
    if moves:
        s, y = moves[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(moves, reversed(kept)):
        q += (a - (y @ q) / (s @ y)) * s
    return -q


def fit(
    df: DataFrame, features: str = "features", label: str = "label", logistic: bool = False, reg: float = 0.0, iterations: int = 100, tolerance: float = 1e-10
) -> Linear:
    """Weights and constant of the least mean loss plus ``reg`` / 2 x the squares of the weights times their feature's deviation.

    ``features`` is an array column of one width. Rows with a null label or array, or a null in it, are left out. A feature without
    deviation has weight 0. Rounds end when the gradient is below ``tolerance`` of what it was, or no step lowers loss or gradient.
    """
    one_thread()
    values = F.col(features).cast("array<double>")
    rows = df.select(F.concat(values, F.array(F.col(label).cast("double"))).alias("_x"))
    rows = rows.where("_x is not null and not exists(_x, x -> x is null)").persist(StorageLevel.MEMORY_AND_DISK)
    n, width = rows.agg(F.count("_x"), F.max(F.size("_x"))).first()
    if not n:
        raise ValueError("no rows to fit on")
    d = width - 1
    mean = sums(rows, lambda x: x.sum(axis=0), width) / n
    deviation = np.sqrt(sums(rows, lambda x: ((x - mean) ** 2).sum(axis=0), width) / max(n - 1, 1))
    used = deviation[:d] > 1e-12 * np.maximum(np.abs(mean[:d]), 1e-300)
    scale = np.where(used, 1 / np.where(used, deviation[:d], 1.0), 0.0)
    centre, unit = mean[:d], 1.0 if logistic or not deviation[d] > 0 else deviation[d]  # labels of a regression in units of their own

    def standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = x[:, -1] if logistic else (x[:, -1] - mean[d]) / unit
        return (x[:, :-1] - centre) * scale, y

    def gradient_at(w: np.ndarray) -> tuple[float, np.ndarray]:
        def work(x: np.ndarray) -> np.ndarray:
            z, y = standard(x)
            margin = z @ w[:-1] + w[-1]
            error = 1 / (1 + np.exp(-np.clip(margin, -700, 700))) - y if logistic else margin - y
            return np.concatenate([z.T @ error, [error.sum(), _losses(margin, y, logistic)]])

        found = sums(rows, work, d + 2) / n
        return found[-1] + reg / 2 * w[:-1] @ w[:-1], found[:-1] + reg * np.append(w[:-1], 0.0)

    def losses_along(w: np.ndarray, p: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray) -> np.ndarray:
            z, y = standard(x)
            margin, move = z @ w[:-1] + w[-1], z @ p[:-1] + p[-1]
            return np.array([_losses(margin + t * move, y, logistic) for t in STEPS])

        weights = w[None, :-1] + STEPS[:, None] * p[None, :-1]
        return sums(rows, work, len(STEPS)) / n + reg / 2 * (weights * weights).sum(axis=1)

    w, moves = np.zeros(width), []
    loss, gradient = gradient_at(w)
    history, first = [loss], np.abs(gradient).max()
    for _ in range(iterations):
        if np.abs(gradient).max() <= tolerance * max(first, 1e-300):
            break
        p = _direction(gradient, moves)
        along = losses_along(w, p)
        best = int(along.argmin())
        lower = bool(along[best] < loss)
        move = (STEPS[best] if lower else 1.0) * p
        value, fresh = gradient_at(w + move)
        if not lower and not np.abs(fresh).max() < np.abs(gradient).max():
            if not moves:  # losses differ by less than their digits tell, and so do slopes
                break
            moves = []  # the curvature has led astray: once more from the slope alone
            continue
        if move @ (fresh - gradient) > 1e-300:
            moves = [*moves, (move, fresh - gradient)][-MEMORY:]
        w, gradient, loss = w + move, fresh, value
        history.append(loss)
    rows.unpersist()
    weights = w[:-1] * scale * unit
    constant = w[-1] * unit + (0.0 if logistic else mean[d]) - weights @ centre
    return Linear(weights, float(constant), history, logistic)


def predict(df: DataFrame, model: Linear, features: str = "features") -> DataFrame:
    """The rows with ``prediction``: the number, or class 1 where its probability is above a half. Rows with a null have none."""
    keep = df.columns
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = df.select("*", F.lit(None).cast("double").alias("prediction")).schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one_thread()
        own = shared.value
        for batch in batches:
            column = batch.column(len(keep))
            known, value = column.is_valid().to_numpy(zero_copy_only=False), np.full(batch.num_rows, np.nan)
            if known.any():
                value[known] = own.margins(_packed(column.filter(pa.array(known))).astype(float))
            missing = np.isnan(value)
            if own.logistic:
                value = (value > 0).astype(float)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(value, mask=missing)], [*keep, "prediction"])

    return df.select(*keep, F.col(features).cast("array<double>").alias("_features")).mapInArrow(run, schema)
