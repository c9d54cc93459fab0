"""Total orders over a whole table without passing it through one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.lineage import cut_lineage
from gaugework.session import shuffle_partitions

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def _place(ordered: DataFrame) -> DataFrame:
    """Fix the layout of a globally ordered table and add its slice number and the row number inside it."""
    slot = F.monotonically_increasing_id()
    return cut_lineage(ordered).withColumns(
        {"_slice": F.shiftright(slot, _ROW_BITS), "_row": slot.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))}
    )


def _offsets(placed: DataFrame, weight: Column) -> DataFrame:
    """Rows and weight before each slice. One row per range partition, so the open window stays tiny."""
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_slice").agg(F.sum(weight).alias("_weight"), F.count(F.lit(1)).alias("_rows"))
    return totals.select(
        "_slice",
        F.coalesce(F.sum("_weight").over(before), F.lit(0)).alias("_weight_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
    )


def number_rows(ordered: DataFrame, name: str = "position") -> DataFrame:
    """Number the rows of a globally ordered DataFrame from 1.

    Works on the output of ``orderBy`` or of a range repartition with sorted partitions: one count per
    partition gives the offsets, and the number inside the partition needs no further shuffle.
    """
    placed = _place(ordered)
    offsets = _offsets(placed, F.lit(1)).select("_slice", "_rows_before")
    return (
        placed.join(F.broadcast(offsets), "_slice")
        .withColumn(name, F.col("_rows_before") + F.col("_row") + 1)
        .drop("_slice", "_row", "_rows_before")
    )


def rank_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct key with ``n, rank, dense_rank, mean_rank`` in the order of the keys.

    Equal keys are counted before anything is ranged, so a key that holds most of the table is one row.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    ranged = counted.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = _place(ranged)
    inside = Window.partitionBy("_slice").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_weight_before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return placed.join(F.broadcast(_offsets(placed, F.col("n"))), "_slice").select(
        *keys,
        "n",
        (before + 1).alias("rank"),
        (F.col("_rows_before") + F.col("_row") + 1).alias("dense_rank"),
        (before + (F.col("n") + 1) / 2).alias("mean_rank"),
    )


def global_rank(df: DataFrame, keys: list[str], method: str = "rank", name: str = "rank") -> DataFrame:
    """Add the rank of each row in the order of ``keys``; ``method`` is a column of :func:`rank_table`.

    The ranks are unique per key, so a hot key is skewed on the row side only, which adaptive execution
    splits by itself.
    """
    ranks = rank_table(df, keys).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(method).alias(name))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(ranks, on).drop(*[f"_k_{k}" for k in keys])


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, parts: int | None = None) -> DataFrame:
    """The first ``n`` rows of each group.

    A limit on a row number is applied inside each map task too, yet a group that fills the table still
    sends ``n`` rows from every task to one place. So the group is cut to ``n`` rows per part first. A part is made
    of whole tasks, so each task lets no more than ``n`` rows of a group pass.
    """
    part = F.spark_partition_id() % (parts or shuffle_partitions(df.sparkSession))
    in_part = Window.partitionBy(*keys, "_part").orderBy(*order)
    in_group = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_part", part)
        .withColumn("_n", F.row_number().over(in_part))
        .where(F.col("_n") <= n)
        .withColumn("_n", F.row_number().over(in_group))
        .where(F.col("_n") <= n)
        .drop("_part", "_n")
    )
