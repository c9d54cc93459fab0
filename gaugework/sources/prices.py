"""Price history records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY_SCHEMA = "instance_type string, az string, product string, ts timestamp_ntz, SpotPrice string"


def read_price_history(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Records per type and zone; ``price`` is the number in the ``SpotPrice`` text, null if it is none."""
    raw = spark.read.schema(HISTORY_SCHEMA).format(format).load(path)
    return raw.withColumn("price", F.col("SpotPrice").try_cast("decimal(10,6)"))
