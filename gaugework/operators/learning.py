"""Model workloads with the catalogue's defaults: some are Spark's estimators, others jobs of this library."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.blas import one_thread
from gaugework.operators import quasi_newton
from gaugework.operators.trees import Trees, fit_boosted, fit_forest

SEED = 5


def regression(df: DataFrame, iterations: int = 20, reg: float = 0.1) -> quasi_newton.Linear:
    return quasi_newton.fit(df, reg=reg, iterations=iterations)


def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares for one feature, as two aggregates of one pass."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def regression_sgd(
    df: DataFrame, features: str = "features", label: str = "label", iterations: int = 20, step: float = 0.001, reg: float = 0.1
) -> DataFrame:
    """Full-batch gradient steps of size step/sqrt(t) on squared loss with L2, ``(t, loss, weights)``."""
    return _descend(df, features, label, "squared", iterations, step, reg)


def classification_sgd(
    df: DataFrame,
    features: str = "features",
    label: str = "label",
    iterations: int = 20,
    step: float = 1.0,
    reg: float = 0.1,
    loss: str = "logistic",
    reg_type: str = "l2",
) -> DataFrame:
    """The same on logistic loss for labels 0 and 1, without a constant, ``(t, loss, weights)``."""
    if loss != "logistic":
        raise ValueError(f"unknown loss {loss!r}")
    if reg_type not in ("l2", "none"):
        raise ValueError(f"unknown regularisation {reg_type!r}")
    return _descend(df, features, label, loss, iterations, step, reg if reg_type == "l2" else 0.0)


def _descend(df: DataFrame, features: str, label: str, loss: str, iterations: int, step: float, reg: float) -> DataFrame:
    """One pass over the table per step, for any width; a task moves one value per feature. ``features`` is an array
    column; rows with a null label or array are left out."""
    rows = df.select(F.concat(F.col(features).cast("array<double>"), F.array(F.col(label).cast("double"))).alias("_x"))
    rows = rows.where(F.col("_x").isNotNull() & F.element_at("_x", -1).isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    n, width = rows.agg(F.count("_x"), F.max(F.size("_x"))).first()
    w = np.zeros((width or 1) - 1)
    history = []
    for t in range(1, iterations + 2):
        gradient, total = _gradient_pass(rows, w, loss)
        scale = 0.5 if loss == "squared" else 1.0
        history.append((t, float(scale * total / max(n, 1) + reg / 2 * w @ w), w.tolist()))
        w = w - step / np.sqrt(t) * (gradient / max(n, 1) + reg * w)
    rows.unpersist()
    return df.sparkSession.createDataFrame(history, "t int, loss double, weights array<double>")


def _gradient_pass(rows: DataFrame, w: np.ndarray, loss: str) -> tuple[np.ndarray, float]:
    """Sums of error x feature and of the loss: one partial vector per task."""

    def partial(batches):
        import pyarrow as pa

        one_thread()
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                margin, y = x[:, :-1] @ w, x[:, -1]
                if loss == "squared":
                    error, value = margin - y, ((margin - y) ** 2).sum()
                else:
                    error, value = 1 / (1 + np.exp(-margin)) - y, (np.logaddexp(0, margin) - y * margin).sum()
                part = np.append(x[:, :-1].T @ error, value)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["i", "value"])

    sums = np.zeros(len(w) + 1)
    for entry in rows.mapInArrow(partial, "i int, value double").groupBy("i").agg(F.sum("value").alias("v")).collect():
        sums[entry["i"]] = entry["v"]
    return sums[:-1], float(sums[-1])


def classification(df: DataFrame, iterations: int = 20, reg: float = 0.1) -> quasi_newton.Linear:
    return quasi_newton.fit(df, logistic=True, reg=reg, iterations=iterations)


def logistic_regression(df: DataFrame) -> quasi_newton.Linear:
    return quasi_newton.fit(df, logistic=True)


def random_forest(
    df: DataFrame, key: list[str], trees: int = 10, depth: int = 10, bins: int = 32, label_type: int = 0, bootstrap: bool = True,
    subset: str = "auto",
) -> Trees:
    """Forest for a number (``label_type`` 0) or for a class (2 and more); ``key`` tells rows apart."""
    classes = label_type if label_type >= 2 else 0
    return fit_forest(df, key=key, trees=trees, depth=depth, bins=bins, classes=classes, bootstrap=bootstrap, subset=subset)


def decision_tree(df: DataFrame, key: list[str], depth: int = 10, bins: int = 32, label_type: int = 0) -> Trees:
    return random_forest(df, key, trees=1, depth=depth, bins=bins, label_type=label_type, bootstrap=False)


def gradient_boosted_tree(df: DataFrame, trees: int = 10, depth: int = 5, bins: int = 32) -> Trees:
    return fit_boosted(df, trees=trees, depth=depth, bins=bins)


def starting_points(df: DataFrame, id_column: str, column: str, k: int) -> np.ndarray:
    """The k points with the smallest hash of their id."""
    rows = df.where(F.col(column).isNotNull()).select(id_column, F.col(column).cast("array<double>").alias("_v"))
    found = rows.orderBy(F.md5(F.col(id_column).cast("string")), id_column).limit(k).collect()
    return np.array([r["_v"] for r in found], dtype=float)


#: Points per cluster that :func:`spread_points` chooses from.
START_POINTS = 20


def spread_points(df: DataFrame, id_column: str, column: str, k: int) -> np.ndarray:
    """k of the ``START_POINTS`` x k points with the smallest hash of their id: each next one is the farthest from those chosen."""
    found = starting_points(df, id_column, column, START_POINTS * k)
    if len(found) <= k:
        return found
    chosen = [0]
    far = ((found - found[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((found - found[chosen[-1]]) ** 2).sum(axis=1))
    return found[chosen]


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances rows x centres, differences first, so that near points keep their digits."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def kmeans(
    df: DataFrame, id_column: str, column: str, k: int = 20, iterations: int = 20, start: np.ndarray | None = None
) -> np.ndarray:
    """Centres of Lloyd's rounds from ``start`` or :func:`starting_points`, until none moves.

    A round is one pass that emits sums per centre and dimension from each task; the answer does not depend on how
    the table is cut. A centre without points stays. Null points are left out.
    """
    points = df.select(F.col(column).cast("array<double>").alias("_v")).where(F.col("_v").isNotNull())
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    centres = starting_points(df, id_column, column, k) if start is None else start
    for _ in range(iterations if len(centres) else 0):

        def partial(batches, centres=centres):
            import pyarrow as pa

            sums = np.zeros((len(centres), centres.shape[1] + 1))
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(0))
                    near = _squares(x, centres).argmin(axis=1)
                    np.add.at(sums, near, np.hstack([x, np.ones((len(x), 1))]))
            i, j = np.nonzero(np.repeat(sums[:, -1:] > 0, sums.shape[1], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[i, j])], ["i", "j", "v"])

        total = np.zeros((len(centres), centres.shape[1] + 1))
        for r in points.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            total[r["i"], r["j"]] = r["v"]
        seen = total[:, -1:] > 0
        moved = np.where(seen, total[:, :-1] / np.maximum(total[:, -1:], 1), centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    points.unpersist()
    return centres


def kmeans_assign(df: DataFrame, column: str, centres) -> DataFrame:
    """Nearest of the given centres per row, ``centre`` and ``distance`` (squared); the lower number wins a tie. A null
    point has neither."""
    centres = np.asarray(centres, dtype=float)
    keep = df.columns
    schema = df.select("*").schema.add("centre", "integer").add("distance", "double")

    def near(batches):
        import pyarrow as pa

        for batch in batches:
            known = batch.column(len(keep)).is_valid().to_numpy(zero_copy_only=False)
            label, distance = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            if known.any():
                d = _squares(_matrix(batch.column(len(keep)).filter(pa.array(known))), centres)
                label[known], distance[known] = d.argmin(axis=1), d.min(axis=1)
            made = [pa.array(label, pa.int32(), mask=~known), pa.array(distance, mask=~known)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, "centre", "distance"])

    return df.select(*keep, F.col(column).cast("array<double>").alias("_v")).mapInArrow(near, schema)


class Mixture:
    """Weights, means and covariances of normal components."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray):
        one_thread()
        self.weights, self.means, self.covariances = weights, means, covariances
        self.factors = np.linalg.cholesky(covariances)
        self.whitening = np.linalg.inv(self.factors)
        self.logs = np.log(np.maximum(weights, 1e-300)) - np.log(np.diagonal(self.factors, axis1=1, axis2=2)).sum(axis=1)

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        """Logarithm of weight times density, rows x components, by the inverse Cholesky factors."""
        out = np.empty((len(x), len(self.weights)))
        for k, (mean, whitening) in enumerate(zip(self.means, self.whitening)):
            z = (x - mean) @ whitening.T
            out[:, k] = self.logs[k] - 0.5 * (z * z).sum(axis=1)
        return out - 0.5 * x.shape[1] * np.log(2 * np.pi)


def gmm(df: DataFrame, id_column: str, column: str, k: int = 20, iterations: int = 20) -> tuple[Mixture, list[float]]:
    """Normal mixture by expectation-maximisation in the log domain on all dimensions; the model and, for each round, the
    mean log-likelihood plus log prior, which never falls.

    It starts from the clusters of :func:`kmeans`, with spread starts. The prior gives each covariance as many points of the round mean shape as
    there are dimensions, so a component of few points stays regular. A round is one pass; each task emits a weight, a
    sum and a matrix of products per component, and those of a component are added up by one task.
    """
    points = df.select(F.col(column).cast("array<double>").alias("_v")).where(F.col("_v").isNotNull())
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    centres = kmeans(df, id_column, column, k, start=spread_points(df, id_column, column, k))
    d = centres.shape[1]

    def total(responsibility, shift):
        def partial(batches):
            import pyarrow as pa

            one_thread()
            sums, seen, value = np.zeros((len(centres), 1 + d + d * d)), 0, 0.0
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(0))
                    r, logs = responsibility(x)
                    y = x - shift
                    for c in range(len(centres)):
                        weighted = y * r[:, c : c + 1]
                        sums[c] += np.concatenate([[r[:, c].sum()], weighted.sum(axis=0), (weighted.T @ y).ravel()])
                    seen, value = seen + len(x), value + logs
            rows = [s.tobytes() for s in sums] + [np.array([seen, value]).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(range(-len(sums), 1), pa.int32()), pa.array(rows, pa.binary())], ["part", "sums"])

        def add(batches):
            import pyarrow as pa

            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    values = np.frombuffer(raw)
                    sums[part] = sums[part] + values if part in sums else values
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["part", "sums"]
            )

        schema = "part int, sums binary"
        added = points.mapInArrow(partial, schema).repartition(len(centres) + 1, "part").mapInArrow(add, schema)
        found = {r["part"]: np.frombuffer(r["sums"]) for r in added.collect()}
        return np.array([found[c - len(centres)] for c in range(len(centres))]), found[0]

    def maximise(sums: np.ndarray, n: float, scale: float | None) -> tuple[Mixture, float]:
        weight = np.maximum(sums[:, 0], 1e-12)
        mean = sums[:, 1 : 1 + d] / weight[:, None]
        cov = sums[:, 1 + d :].reshape(-1, d, d) / weight[:, None, None] - mean[:, :, None] * mean[:, None, :]
        if scale is None:
            scale = max(float((np.trace(cov, axis1=1, axis2=2) * weight).sum() / n) / d, 1e-9)
        cov = (weight[:, None, None] * cov + d * scale * np.eye(d)) / (weight + d)[:, None, None]
        return Mixture(weight / n, mean + shift, cov), scale

    def log_prior(model: Mixture, scale: float) -> float:
        determinants = 2 * np.log(np.diagonal(model.factors, axis1=1, axis2=2)).sum(axis=1)
        inverses = np.trace(np.linalg.inv(model.covariances), axis1=1, axis2=2)
        return float(-0.5 * d * (determinants + scale * inverses).sum())

    shift = centres.mean(axis=0)

    def hard(x):
        return np.eye(len(centres))[_squares(x, centres).argmin(axis=1)], 0.0

    sums, (n, _) = total(hard, shift)
    (model, scale), history = maximise(sums, n, None), []
    for _ in range(iterations):

        def soft(x, model=model):
            parts = model.log_parts(x)
            top = parts.max(axis=1, keepdims=True)
            logs = top[:, 0] + np.log(np.exp(parts - top).sum(axis=1))
            return np.exp(parts - logs[:, None]), float(logs.sum())

        sums, (n, value) = total(soft, shift)
        history.append((value + log_prior(model, scale)) / n)
        model, _ = maximise(sums, n, scale)
    points.unpersist()
    return model, history


def gmm_assign(df: DataFrame, column: str, model: Mixture) -> DataFrame:
    """The likeliest component of each row as ``prediction``; null points have none."""
    keep = df.columns
    schema = df.select("*").schema.add("prediction", "integer")

    def best(batches):
        import pyarrow as pa

        one_thread()
        for batch in batches:
            known = batch.column(len(keep)).is_valid().to_numpy(zero_copy_only=False)
            label = np.full(batch.num_rows, -1)
            if known.any():
                label[known] = model.log_parts(_matrix(batch.column(len(keep)).filter(pa.array(known)))).argmax(axis=1)
            made = pa.array(label, pa.int32(), mask=~known)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], made], names=[*keep, "prediction"])

    return df.select(*keep, F.col(column).cast("array<double>").alias("_v")).mapInArrow(best, schema)


def train_test_split(df: DataFrame, row_id: list[str], fraction: float = 0.2, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Hold out a share of the rows by a hash of their id, so the split does not depend on partitioning."""
    words = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in row_id]
    drawn = F.conv(F.substring(F.md5(F.concat_ws(" ", *words, F.lit(str(seed)))), 1, 12), 16, 10).cast("bigint")
    held = drawn % 1_000_000 < int(fraction * 1_000_000)
    return df.where(~held), df.where(held)
