"""The given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_row_id(table: DataFrame) -> DataFrame:
    """Add ``row_file, row_index``: the place of the record in the Parquet files.

    The pair is unique and does not change when a task is run again, so it splits runs of equal rows
    where a generated id could not.
    """
    return table.select(
        "*", F.col("_metadata.file_path").alias("row_file"), F.col("_metadata.row_index").alias("row_index")
    )


def deal(table: DataFrame, by: list[str], rows: int = 20_000) -> DataFrame:
    """Deal a table anew by a hash of ``by``, in about ``rows`` rows a part, each sorted by ``by``.

    The parts follow from the rows alone, not from files or cores, so a fit that draws or sums by part gives the same
    answer anywhere. ``by`` should tell the rows apart.
    """
    parts = max(1, -(-table.count() // rows))
    return table.repartition(min(parts, 100_000), *by).sortWithinPartitions(*by)
