"""Operators on the metric feeds of a run: one row per host, time and, for some feeds, device."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.operators.ranking import rank_table

IDENTITY_COLUMNS = ["interval", "CPU", "INTR"]


def metric_prune(df: DataFrame, drop: list[str] | None = None) -> DataFrame:
    """Drop columns that only identify the export. The device stays: a later rollup needs it."""
    return df.drop(*(IDENTITY_COLUMNS if drop is None else drop))


def metric_resample(df: DataFrame, seconds: int = 5, keys: list[str] | None = None) -> DataFrame:
    """First sample of each epoch-aligned bucket per host (and device); ``ts`` becomes the bucket start."""
    keys = ["host"] if keys is None else keys
    values = [c for c in df.columns if c not in keys and c != "ts"]
    window = F.window("ts", f"{seconds} seconds")
    if df.isStreaming:
        # the whole row goes along with the earliest time, so the values of a bucket come from one sample
        first = F.min_by(F.struct(*values), F.struct("ts", *values)).alias("_first")
        grouped = df.groupBy(*keys, window.alias("_w")).agg(first)
        return grouped.select(*keys, F.col("_w.start").alias("ts"), *[F.col(f"_first.`{v}`").alias(v) for v in values])
    # a limit on the row number is applied in the map tasks too, so a bucket sends one row from each; the buckets are dealt
    # by their start itself, so a later join on it needs no further shuffle
    table = df.withColumn("_start", window["start"])
    first = F.row_number().over(Window.partitionBy(*keys, "_start").orderBy("ts", *[F.col(f"`{v}`") for v in values]))
    return table.withColumn("_place", first).where("_place = 1").select(
        *keys, F.col("_start").alias("ts"), *[F.col(f"`{v}`") for v in values]
    )


def metric_device_rollup(df: DataFrame, aggs: list[Column], keys: list[str] | None = None) -> DataFrame:
    """One row per host and time over all devices, so that joining feeds does not multiply rows."""
    return df.groupBy(*(keys or ["host", "ts"])).agg(*aggs)


def metric_join(general: DataFrame, disk: DataFrame, network: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Inner join of the three feeds. Both joins use one key, so the second reuses the first shuffle."""
    on = on or ["host", "ts"]
    return general.join(disk, on, "inner").join(network, on, "inner")


def combined(name: str) -> Column:
    """Utilisation of the busiest device, the mean of sizes and waits, the sum of rates."""
    if "pct" in name:
        return F.max(name).alias(name)
    if name.endswith(("avgrq_sz", "avgqu_sz", "await", "svctm")):
        return F.avg(name).alias(name)
    return F.sum(name).alias(name)


def metric_table(general: DataFrame, disk: DataFrame, network: DataFrame, rollup: bool = True) -> DataFrame:
    """The joined table ``host, ts`` and all metrics of the three feeds as they are read.

    Devices are rolled up first; without it the result has a row per disk and interface.
    """
    feeds = [metric_prune(general), metric_prune(disk), metric_prune(network)]
    for i, device in ((1, "DEV"), (2, "IFACE")):
        if rollup:
            metrics = [c for c in feeds[i].columns if c not in ("host", "ts", device)]
            feeds[i] = metric_device_rollup(feeds[i], [combined(m) for m in metrics])
        else:
            feeds[i] = feeds[i].drop(device)
    return metric_join(*feeds)


def metric_rename(df: DataFrame, names: list[str]) -> DataFrame:
    """Impose names by position."""
    if len(df.columns) != len(names):
        raise ValueError(f"{len(df.columns)} columns cannot take {len(names)} names")
    return df.toDF(*names)


def metric_group(df: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """The keys and the columns whose names start with the group."""
    return df.select(*keys, *[F.col(f"`{c}`") for c in df.columns if c.startswith(group) and c not in keys])


def metric_long(df: DataFrame, keys: list[str], groups: list[str]) -> DataFrame:
    """Long form ``(keys, group, metric, value)``; map-side only."""
    columns = [c for c in df.columns if c not in keys and any(c.startswith(g) for g in groups)]
    group = reduce(
        lambda rest, g: F.when(F.startswith(F.col("metric"), F.lit(g)), F.lit(g)).otherwise(rest), groups, F.lit(None)
    )
    return df.unpivot(keys, [F.col(f"`{c}`") for c in columns], "metric", "value").withColumn("group", group)


def node_number(df: DataFrame, host: str = "host") -> DataFrame:
    """Number the distinct hosts 1..n in sorted order."""
    return rank_table(df.select(host).distinct(), [host]).select(host, F.col("dense_rank").alias("node_no"))


def with_node_number(df: DataFrame, host: str = "host") -> DataFrame:
    return df.join(node_number(df, host), host)


def run_metrics_union(parts: list[DataFrame]) -> DataFrame:
    """The tables of all nodes of a run as one; columns are matched by name, missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
