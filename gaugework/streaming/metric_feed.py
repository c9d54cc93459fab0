"""The metric feed while a run is still writing it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.functions.times import as_instant, from_instant
from gaugework.operators.metrics import combined, metric_join, metric_prune, metric_resample
from gaugework.sources.feeds import DEVICE_COLUMN, feed_options, feed_schema


def stream_metric_feed(spark: SparkSession, folder: str, kind: str, files_per_trigger: int = 1000) -> DataFrame:
    """The files of a feed as they arrive, with the schema of the batch reader."""
    reader = spark.readStream.schema(feed_schema(kind)).options(**feed_options())
    return reader.option("maxFilesPerTrigger", files_per_trigger).csv(folder)


def stream_resample(feed: DataFrame, seconds: int = 5, late: str = "1 minute", keys: list[str] | None = None) -> DataFrame:
    """First sample of each bucket; a bucket is final, and its state dropped, once the feed is ``late`` past it.

    A watermark needs an instant, so the clock time of the feed is read as UTC on the way in and turned
    back on the way out; the buckets are those of the batch operator in any session time zone.
    """
    marked = metric_prune(feed).withColumn("ts", as_instant(F.col("ts"))).withWatermark("ts", late)
    return metric_resample(marked, seconds, keys).withColumn("ts", from_instant(F.col("ts")))


def _buckets(feed: DataFrame, seconds: int, late: str, device: str | None) -> DataFrame:
    """``host, bucket`` (a window) and the metrics of its first sample, devices rolled up."""
    marked = metric_prune(feed).withColumn("ts", as_instant(F.col("ts"))).withWatermark("ts", late)
    keys = ["host", device] if device else ["host"]
    values = [c for c in marked.columns if c not in (*keys, "ts")]
    row = F.struct(*values)
    first = marked.groupBy(*keys, F.window("ts", f"{seconds} seconds").alias("bucket")).agg(
        F.min_by(row, F.struct("ts", *values)).alias("_first")
    )
    if not device:
        return first.select("host", "bucket", "_first.*")
    again = F.window(F.window_time("bucket"), f"{seconds} seconds").alias("bucket")
    samples = first.select("host", "bucket", "_first.*")
    return samples.groupBy("host", again).agg(*[combined(v) for v in values])


def stream_metric_table(
    general: DataFrame, disk: DataFrame, network: DataFrame, seconds: int = 5, late: str = "1 minute"
) -> DataFrame:
    """The metric table ``host, ts`` and all metrics of three growing feeds, for append mode.

    A bucket is joined and given out once all three feeds are ``late`` past it (the slowest feed holds the others), and its
    state in the rollups and in both joins is dropped then. A sample that comes after that changes nothing. A bucket that one
    feed lacks has no row, as in the batch table.
    """
    feeds = [_buckets(general, seconds, late, None)]
    feeds += [_buckets(feed, seconds, late, DEVICE_COLUMN[kind]) for feed, kind in ((disk, "disk"), (network, "network"))]
    table = metric_join(*feeds, on=["host", "bucket"])
    rest = [c for c in table.columns if c not in ("host", "bucket")]
    return table.select("host", from_instant(F.col("bucket.start")).alias("ts"), *rest)
