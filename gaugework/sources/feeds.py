"""Metric feeds, the metric table and plain text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.functions.text import strip_line_end
from gaugework.functions.times import clock_text
from gaugework.sources.metric_names import (
    DISK_METRICS,
    GENERAL_METRICS,
    METRIC_COLUMNS,
    NETWORK_METRICS,
    PLAIN_COLUMNS,
    plain_name,
)

STAMP = "yyyy-MM-dd HH:mm:ss"
FINE_STAMP = STAMP + "[.SSSSSS]"
DEVICE_COLUMN = {"disk": "DEV", "network": "IFACE"}
# What Python's splitlines takes as a line end besides the line feed and carriage return.
OTHER_LINE_ENDS = r"[\x0b\x0c\x1c\x1d\x1e\x85  ]"


def feed_columns(kind: str) -> list[str]:
    """Columns of a feed in file order, with the identity columns where the exporter puts them."""
    identity = ["host", "interval", "ts"]
    if kind == "general":
        metrics = [plain_name(m) for m in GENERAL_METRICS]
        at = metrics.index("intr_intr_per_s")
        return identity + ["CPU"] + metrics[:at] + ["INTR"] + metrics[at:]
    metrics = {"disk": DISK_METRICS, "network": NETWORK_METRICS}[kind]
    return identity + [DEVICE_COLUMN[kind]] + [plain_name(m) for m in metrics]


def feed_schema(kind: str) -> str:
    types = {"host": "string", "interval": "int", "ts": "timestamp_ntz", "CPU": "string", "INTR": "string",
             "DEV": "string", "IFACE": "string"}
    return ", ".join(f"{c} {types.get(c, 'double')}" for c in feed_columns(kind))


def feed_options() -> dict[str, str]:
    """Header lines start with a hash and may come again in the middle of a file, so they are comments."""
    return {"sep": ";", "comment": "#", "timestampNTZFormat": FINE_STAMP}


def read_metric_feed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One ``;``-separated feed (``general``, ``disk`` or ``network``) with its explicit schema."""
    return spark.read.schema(feed_schema(kind)).options(**feed_options()).csv(path)


def write_metric_feed(df: DataFrame, path: str, kind: str) -> None:
    """One feed as CSV. A time keeps its fraction of a second, if it has one: it orders the samples of a second."""
    columns = feed_columns(kind)
    short = {plain_name(m): m.split(".", 1)[1] for m in METRIC_COLUMNS[1:]}
    shown = ["# hostname", "interval", "timestamp", *[short.get(c, c) for c in columns[3:]]]
    out = df.select(*columns).withColumn("ts", F.col("ts").cast("timestamp_ntz").cast("string")).toDF(*shown)
    out.write.options(sep=";", header=True, comment="~").csv(path)


def write_metric_table(df: DataFrame, path: str) -> None:
    """The joined table as CSV under the fixed header of 73 names."""
    first, *metrics = PLAIN_COLUMNS
    shown = df.select(clock_text(F.col("ts")).alias(first), *metrics).toDF(*METRIC_COLUMNS)
    shown.write.option("header", True).csv(path)


def read_metric_table(spark: SparkSession, path: str) -> DataFrame:
    first, *metrics = PLAIN_COLUMNS
    schema = f"{first} timestamp_ntz, " + ", ".join(f"{m} double" for m in metrics)
    return spark.read.schema(schema).options(header=True, timestampNTZFormat=STAMP).csv(path)


def write_metric_store(df: DataFrame, path: str) -> None:
    """The main form: Parquet with a folder per run and host; needs ``run_id`` and ``host``."""
    df.write.partitionBy("run_id", "host").parquet(path)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``value`` without white space at their end."""
    lines = spark.read.text(path).select(F.explode(F.split("value", OTHER_LINE_ENDS)).alias("value"))
    return lines.select(strip_line_end(F.col("value")).alias("value"))
