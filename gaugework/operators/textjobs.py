"""Row functions run as jobs over text and number columns of a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions import numbers, text


def fingerprint_rows(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """md5 of a text column with the number of copies and the first id; copies meet as partial counts.

    The digest stays hex: as an integer it has 128 bits, more than any Spark number.
    """
    return (
        df.select(F.md5(F.col(column).cast("binary")).alias("fp"), F.col(row_id).alias("_id"))
        .groupBy("fp")
        .agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first_id"))
    )


def fingerprint_lists(df: DataFrame, column: str, name: str = "fp") -> DataFrame:
    """md5 over the digests of the elements of an array column."""
    return df.withColumn(name, text.list_fingerprint(F.col(column)))


def grep_first_line(df: DataFrame, column: str, word: str, name: str = "line") -> DataFrame:
    """First line of each text that contains the word, null where there is none."""
    return df.withColumn(name, text.first_line_with(F.col(column), word))


def filter_by_pattern(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows in which the pattern occurs."""
    return df.where(F.col(column).rlike(pattern))


def power2_histogram(df: DataFrame, column: str) -> DataFrame:
    """Counts per nearest power of two."""
    return df.groupBy(numbers.nearest_power2(F.col(column)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
