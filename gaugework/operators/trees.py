"""Decision trees, forests and boosting by histograms, one Arrow pass over binned rows per level.

- **Bins.** A value falls into a bucket by its sign, exponent and eight bits of fraction. Counts of buckets merge by addition, so the cuts
  (quantiles of the counts, at the largest value of a bucket) are the same however the table is dealt. Each feature's
  value becomes one byte, and the binned table is written once, in blocks of many rows: a pass reads it as fast as bytes are copied.
- **Levels.** Rows lie in the order of their bins. A pass sends every run of rows with the same bins down the trees so far and
  adds their weights and labels to the bins of its node. Labels are whole multiples of a
  power of two, so sums are exact integers and no order of addition can change a split. A task emits one vector per
  node and block of features; those are added and searched for the best cut by the task that owns them, and only the
  best cuts, one per node, come to the driver. Nodes are taken in groups so that a task's vectors stay below ``MAX_CELLS``.
- **Bootstrap.** The weight of a row in a tree is drawn from a hash of its key and the tree's number, as is the set of features of a node.

A tree has at most 2^(depth + 1) nodes, whatever the data is; that is all the driver and the broadcast hold.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.lineage import cut_lineage
from gaugework.session import shuffle_partitions

#: Bits of fraction that tell the buckets of a value apart.
FRACTION_BITS = 8
#: Sums that a task holds at a time.
MAX_CELLS = 8_000_000
FEATURE_BLOCK = 64
#: Rows and bytes that a part of the binned table has about, and rows below which a task does not pay.
PART_ROWS = 500_000
PART_BYTES = 32_000_000
LEAST_ROWS = 20_000
#: Cumulative shares of 0, 1, 2, ... draws for a row of a bootstrap sample (Poisson of mean 1).
DRAWS = [round(float(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))), 9) for k in range(9)]
_UNEQUAL = 1e-12


@dataclass
class Trees:
    """Complete binary trees in arrays, trees x nodes; node k has the children 2k+1 and 2k+2. ``feature`` is -1 at leaves."""

    cuts: list[np.ndarray]
    classes: int
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    weight: list[float] = field(default_factory=list)

    @classmethod
    def empty(cls, cuts: list[np.ndarray], classes: int, trees: int, depth: int) -> Trees:
        nodes = 2 ** (depth + 1) - 1
        channels = max(classes, 1)
        return cls(cuts, classes, np.full((trees, nodes), -1, np.int32), np.zeros((trees, nodes), np.int32), np.zeros((trees, nodes, channels)))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Number of the bin of each value: the cuts below it. Not a number is above all."""
        return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def nodes(self, codes: np.ndarray, tree: int) -> np.ndarray:
        """The node that each row has reached."""
        at = np.zeros(len(codes), np.int64)
        rows = np.arange(len(codes))
        while True:
            feature = self.feature[tree, at]
            inner = feature >= 0
            if not inner.any():
                return at
            right = codes[rows, np.maximum(feature, 0)] > self.bin[tree, at]
            at = np.where(inner, 2 * at + 1 + right, at)

    def predict(self, codes: np.ndarray) -> np.ndarray:
        """Mean of the trees, the weighted sum of boosted ones, or the class of the largest mean share (the lowest of equals)."""
        total = np.zeros((len(codes), self.value.shape[2]))
        for tree in range(len(self.feature)):
            value = self.value[tree, self.nodes(codes, tree)]
            total = total + (value if not self.weight else value * self.weight[tree])
        if self.classes:
            return total.argmax(axis=1).astype(float)
        return total[:, 0] if self.weight else total[:, 0] / len(self.feature)

    def threshold(self, tree: int, node: int) -> float:
        return float(self.cuts[self.feature[tree, node]][self.bin[tree, node]])


def buckets(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values: equal only for values that agree in sign, exponent and first bits."""
    bits = np.where(x == 0, 0.0, x).view(np.int64)
    bits = np.where(bits < 0, np.int64(-(2**63)) - bits, bits)
    return bits >> (52 - FRACTION_BITS)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def find_cuts(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """For each feature up to ``bins`` - 1 cuts; a value goes left of a cut that it does not exceed.

    A feature of no more than ``bins`` buckets is cut between all of them.
    """

    def partial(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            b = buckets(x)
            out = []
            for f in range(x.shape[1]):
                known = ~np.isnan(x[:, f])
                found, at, n = np.unique(b[known, f], return_inverse=True, return_counts=True)
                high = np.full(len(found), -np.inf)
                np.maximum.at(high, at, x[known, f])
                out.append((np.full(len(found), f, np.int32), found, n, high))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["feature", "bucket", "n", "high"])

    counted = rows.select("features").mapInArrow(partial, "feature int, bucket long, n long, high double")
    counted = counted.groupBy("feature", "bucket").agg(F.sum("n").alias("n"), F.max("high").alias("high"))

    def choose(key, table):
        import pyarrow as pa

        order = np.argsort(table.column("bucket").to_numpy())
        n, high = table.column("n").to_numpy()[order], table.column("high").to_numpy()[order]
        total = np.cumsum(n)
        share = total * bins // total[-1]
        cut = np.ones(len(n), bool) if len(n) <= bins else share > np.append(0, share[:-1])
        cut[-1] = False
        return pa.table({"feature": pa.array(np.full(cut.sum(), key[0].as_py(), np.int32)), "high": pa.array(high[cut])})

    chosen = counted.groupBy("feature").applyInArrow(choose, "feature int, high double").toArrow()
    feature, high = chosen.column("feature").to_numpy(), chosen.column("high").to_numpy()
    return [np.sort(high[feature == f]) for f in range(width)]


def bootstrap_weights(key: Column, trees: int) -> Column:
    """How often a row is drawn for each tree, from the md5 of its key and the tree's number."""

    def share(tree: Column) -> Column:
        digest = F.md5(F.concat(key.cast("string"), F.lit(":"), tree.cast("string")))
        return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)

    def weight(share: Column) -> Column:
        return sum(((share >= bar).cast("int") for bar in DRAWS), F.lit(0)).cast("tinyint")

    # two arrays: a draw is named nine times in its weight, and would be taken from its digest nine times
    return F.transform(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), share), weight)


def allowed_features(tree: int, node: int, width: int, some: int) -> np.ndarray:
    """Which ``some`` of the features a node may be cut by, from md5 of their names; all of them if it has no fewer."""
    if some >= width:
        return np.ones(width, bool)
    drawn = [hashlib.md5(f"{tree}:{node}:{f}".encode()).hexdigest() for f in range(width)]
    allowed = np.zeros(width, bool)
    allowed[sorted(range(width), key=lambda f: (drawn[f], f))[:some]] = True
    return allowed


def subset_size(strategy: str, width: int, trees: int, classes: int) -> int:
    """``auto``: all features for one tree, a third for a number, the root for a class."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt" if classes else "onethird"
    sizes = {"all": width, "sqrt": math.ceil(math.sqrt(width)), "onethird": math.ceil(width / 3), "log2": math.ceil(math.log2(max(width, 2)))}
    if strategy not in sizes:
        raise ValueError(f"unknown feature subset strategy {strategy!r}")
    return max(1, sizes[strategy])


def best_cuts(hist: np.ndarray, allowed: np.ndarray, first: int) -> tuple | None:
    """The best cut of a node in a block of features: ``hist`` is features x bins x (weight, label sums).

    Gain is the fall of the sum of squares around the means. Equal gains go to the lowest feature, then bin. None without a cut that
    parts unequal means.
    """
    left = np.cumsum(hist, axis=1)[:, :-1]
    whole = hist.sum(axis=1, keepdims=True)
    n, nl = whole[:, :, 0].astype(float), left[:, :, 0].astype(float)
    nr = n - nl
    gain = np.zeros(nl.shape)
    for c in range(1, hist.shape[2]):
        s, sl = whole[:, :, c].astype(float), left[:, :, c].astype(float)
        d = sl * n - s * nl
        d = np.where(np.abs(d) <= _UNEQUAL * (np.abs(sl) * n + np.abs(s) * nl), 0.0, d)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = gain + d * d / (n * nl * nr)
    gain = np.where((nl > 0) & (nr > 0) & allowed[first : first + len(hist), None], gain, 0.0)
    best = int(gain.argmax()) if gain.size else 0
    if not gain.size or not gain.flat[best] > 0:
        return None
    f, b = divmod(best, gain.shape[1])
    return float(gain.flat[best]), first + f, b, left[f, b], whole[f, 0] - left[f, b]


def _packed(codes: np.ndarray, y: np.ndarray, drawn: np.ndarray):
    """A block of rows as one row of bytes, in the order of the codes."""
    import pyarrow as pa

    order = np.lexsort(codes.T[::-1]) if codes.shape[1] else np.arange(len(codes))
    cells = [np.ascontiguousarray(a[order]).tobytes() for a in (codes, y, drawn)]
    return pa.RecordBatch.from_arrays([pa.array([len(codes)], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], ["n", "codes", "y", "weights"])


def _blocks(batches: Iterator, width: int) -> Iterator:
    """``codes, y, weights`` of each block: rows x features, rows, rows x trees (x 0 without a bootstrap)."""
    for batch in batches:
        for n, codes, y, drawn in zip(*batch.columns):
            n = n.as_py()
            weights = np.frombuffer(drawn.as_buffer(), np.uint8).reshape(n, -1)
            yield np.frombuffer(codes.as_buffer(), np.uint8).reshape(n, width), np.frombuffer(y.as_buffer(), float), weights


def _level(binned: DataFrame, model: Trees, active: list[tuple[int, int]], bins: int, some: int, goal, scale: float) -> dict:
    """Best cut ``(gain, feature, bin, left sums, right sums)`` and sums of each active ``(tree, node)``."""
    width, channels = len(model.cuts), 1 + max(model.classes, 1)
    slots = np.full(model.feature.shape, -1, np.int64)
    for k, (tree, node) in enumerate(active):
        slots[tree, node] = k
    trees = sorted({tree for tree, _ in active})
    shared = binned.sparkSession.sparkContext.broadcast((model, slots))

    def partial(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, place = shared.value
        hist = np.zeros((len(active), width, bins, channels), np.int64).reshape(-1, channels)
        for codes, y, drawn in _blocks(batches, width):
            # rows lie in the order of their codes: each run of equal ones goes down the trees once
            start = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]).any(axis=1)))
            codes, run = codes[start], np.repeat(np.arange(len(start)), np.diff(np.append(start, len(codes))))
            y = goal(own, codes, run, y)
            y = y.astype(np.int64) if own.classes else np.rint(y * scale).astype(np.int64)
            for tree in trees:
                slot = place[tree, own.nodes(codes, tree)]
                if not (slot >= 0).any():
                    continue
                weight = drawn[:, tree].astype(np.int64) if drawn.shape[1] else np.ones(len(y), np.int64)
                sums = [np.add.reduceat(weight, start)]
                if own.classes:
                    sums += [np.add.reduceat(weight * (y == c), start) for c in range(own.classes)]
                else:
                    sums.append(np.add.reduceat(weight * y, start))
                runs = np.flatnonzero((slot >= 0) & (sums[0] > 0))
                at = ((slot[runs, None] * width + np.arange(width)) * bins + codes[runs]).ravel()
                for c, of_run in enumerate(sums):
                    np.add.at(hist[:, c], at, np.repeat(of_run[runs], width))
        hist = hist.reshape(len(active), width, bins, channels)
        for k in np.flatnonzero(hist[:, 0, :, 0].any(axis=1)):
            firsts = range(0, width, FEATURE_BLOCK)
            sums = [hist[k, first : first + FEATURE_BLOCK].tobytes() for first in firsts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sums), k, np.int32)), pa.array(list(firsts), pa.int32()), pa.array(sums, pa.binary())], ["slot", "first", "sums"]
            )

    def best(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, held = None, None

        def searched() -> pa.RecordBatch:
            slot, first = key
            tree, node = active[slot]
            found = best_cuts(held.reshape(-1, bins, channels), allowed_features(tree, node, width, some), first)
            whole = held.reshape(-1, bins, channels)[0].sum(axis=0)
            gain, feature, at, left, right = found or (0.0, -1, -1, whole, whole * 0)
            row = [[slot], [gain], [feature], [at], [left.tolist()], [right.tolist()]]
            types = [pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["slot", "gain", "feature", "bin", "left", "right"])

        for batch in batches:
            for slot, first, sums in zip(*(c.to_pylist() for c in batch.columns)):
                values = np.frombuffer(sums, np.int64)
                if (slot, first) == key:
                    held = held + values
                else:
                    if key is not None:
                        yield searched()
                    key, held = (slot, first), values
        if key is not None:
            yield searched()

    summed = binned.mapInArrow(partial, "slot int, first int, sums binary")
    parts = min(shuffle_partitions(binned.sparkSession), len(active) * -(-width // FEATURE_BLOCK))
    dealt = summed.repartition(parts, "slot", "first").sortWithinPartitions("slot", "first")
    cuts = dealt.mapInArrow(best, "slot int, gain double, feature int, bin int, left array<long>, right array<long>")
    order = F.struct(F.col("gain").alias("g"), (-F.col("feature")).alias("f"))
    chosen = cuts.groupBy("slot").agg(F.max_by(F.struct("gain", "feature", "bin", "left", "right"), order).alias("best"))
    return {active[r["slot"]]: r["best"] for r in chosen.collect()}


def _grow(binned: DataFrame, model: Trees, trees: list[int], depth: int, bins: int, some: int, goal, scale: float, least_rows: int) -> None:
    """Grow the trees level by level, in place."""
    unit = 1.0 if model.classes else scale

    def value(sums) -> np.ndarray:
        return np.array(sums[1:], float) / unit / max(sums[0], 1)

    per_pass = max(1, MAX_CELLS // (len(model.cuts) * bins * (1 + max(model.classes, 1))))
    level = [(tree, 0) for tree in trees]
    for d in range(depth):
        grown = []
        for begin in range(0, len(level), per_pass):
            found = _level(binned, model, level[begin : begin + per_pass], bins, some, goal, scale)
            for (tree, node), cut in found.items():
                total = [a + b for a, b in zip(cut["left"], cut["right"])]
                if d == 0:
                    model.value[tree, node] = value(total)
                grown.append((tree, node, cut))
        level = []
        for tree, node, cut in sorted(grown, key=lambda g: g[:2]):  # only now, so that all groups of a level see the same trees
            if cut["feature"] < 0:
                continue
            model.feature[tree, node], model.bin[tree, node] = cut["feature"], cut["bin"]
            for child, sums in ((2 * node + 1, cut["left"]), (2 * node + 2, cut["right"])):
                model.value[tree, child] = value(sums)
                if sums[0] > least_rows:
                    level.append((tree, child))
        if not level:
            return


def _prepared(df: DataFrame, features: str, label: str, key: list[str], trees: int, bootstrap: bool, bins: int):
    """The binned and written table, a row for a block of rows (see :func:`_packed`), the cuts, the row count and the largest label."""
    if not 2 <= bins <= 256:
        raise ValueError("between 2 and 256 bins")
    rows = df.select(
        F.col(features).cast("array<double>").alias("features"),
        F.col(label).cast("double").alias("label"),
        F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]).alias("key") if key else F.lit("").alias("key"),
    ).where("features is not null and label is not null and not isnan(label)")
    n, width, most, top = rows.agg(F.count("label"), F.max(F.size("features")), F.max(F.abs("label")), F.max("label")).first()
    if not n:
        raise ValueError("no rows to fit on")
    cuts = find_cuts(rows, width, bins)
    coder = Trees.empty(cuts, 0, 1, 0)

    parts = max(-(-n // PART_ROWS), -(-n * (width + 8 + trees) // PART_BYTES), min(shuffle_partitions(df.sparkSession), -(-n // LEAST_ROWS)))

    def code(batches: Iterator) -> Iterator:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            drawn = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(batch.num_rows, -1)
            held.append((coder.codes(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False), drawn))
            size += batch.num_rows * (width + 8 + drawn.shape[1])
            if size >= PART_BYTES:
                yield _packed(*[np.concatenate(c) for c in zip(*held)])
                held, size = [], 0
        if held:
            yield _packed(*[np.concatenate(c) for c in zip(*held)])

    weights = bootstrap_weights(F.col("key"), trees) if bootstrap else F.array().cast("array<tinyint>")
    # parts of some size, however few or many the files are
    drawn = rows.repartition(parts).select("features", "label", weights.alias("weights"))
    binned = cut_lineage(drawn.mapInArrow(code, "n int, codes binary, y binary, weights binary"))
    return binned, cuts, n, most, int(top)


def _scale(n: int, most: float) -> float:
    """A power of two that labels are multiplied by before they are rounded: sums of so many stay within 62 bits."""
    return 2.0 ** min(44 - math.ceil(math.log2(max(most, 1e-300))), 58 - math.ceil(math.log2(n + 1)) - math.ceil(math.log2(max(most, 1e-300))))


def _as_given(model: Trees, codes: np.ndarray, run: np.ndarray, y: np.ndarray) -> np.ndarray:
    return y


def _what_is_left(model: Trees, codes: np.ndarray, run: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Twice what the trees so far leave: the slope of the squared loss. ``run`` is the place of a row's codes in ``codes``."""
    if not model.weight:
        return y
    return 2.0 * (y - model.predict(codes)[run])


def fit_forest(
    df: DataFrame, features: str = "features", label: str = "label", key: list[str] | None = None, trees: int = 10, depth: int = 10,
    bins: int = 32, classes: int = 0, bootstrap: bool = True, subset: str = "auto", least_rows: int = 1, scale: float | None = None,
) -> Trees:
    """Forest for a number (``classes`` 0) or for whole labels 0 to ``classes`` - 1.

    ``features`` is an array column of one width; rows with a null array or label are left out, a null or not-a-number entry lies
    above all cuts. ``key`` are the columns that tell rows apart for the bootstrap; rows that share them are drawn
    together. The answer follows from the rows alone, not from partitions or cores. ``scale`` fixes the resolution of labels: 1/scale.
    """
    binned, cuts, n, most, _ = _prepared(df, features, label, key or [], trees, bootstrap, bins)
    model = Trees.empty(cuts, classes, trees, depth)
    some = subset_size(subset, len(cuts), trees, classes)
    _grow(binned, model, list(range(trees)), depth, bins, some, _as_given, scale or _scale(8 * n, most), least_rows)
    return model


def fit_boosted(
    df: DataFrame, features: str = "features", label: str = "label", trees: int = 10, depth: int = 5, bins: int = 32, step: float = 0.1,
    least_rows: int = 1, scale: float | None = None,
) -> Trees:
    """Boosted trees on squared loss: the first fits the labels, each other one the slope of what is left and enters by ``step``."""
    binned, cuts, n, most, _ = _prepared(df, features, label, [], 1, False, bins)
    scale = scale or _scale(8 * n, most)
    model = Trees.empty(cuts, 0, 0, depth)
    for k in range(trees):
        more = Trees.empty(cuts, 0, k + 1, depth)
        more.feature[:k], more.bin[:k], more.value[:k] = model.feature, model.bin, model.value
        more.weight = [*model.weight, 0.0]  # the tree in growth does not count yet
        _grow(binned, more, [k], depth, bins, len(cuts), _what_is_left if k else _as_given, scale, least_rows)
        more.weight[k] = step if k else 1.0
        model = more
    return model


def predict(df: DataFrame, model: Trees, features: str = "features") -> DataFrame:
    """The rows with ``prediction``; a null array has none."""
    keep = df.columns
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = df.select("*", F.lit(None).cast("double").alias("prediction")).schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = shared.value
        for batch in batches:
            column = batch.column(len(keep))
            known = column.is_valid().to_numpy(zero_copy_only=False)
            value = np.zeros(batch.num_rows)
            if known.any():
                value[known] = own.predict(own.codes(_matrix(column.filter(pa.array(known)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(value, mask=~known)], [*keep, "prediction"])

    return df.select(*keep, F.col(features).cast("array<double>").alias("_features")).mapInArrow(run, schema)
