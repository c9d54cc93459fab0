"""Record workloads: scan, aggregation, join, word count and the two sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.text import explode_tokens


def scan(df: DataFrame, columns: list[str], predicate: Column | None = None) -> DataFrame:
    """Project and filter; both reach the Parquet reader."""
    kept = df if predicate is None else df.where(predicate)
    return kept.select(*columns)


def aggregation(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Grouped aggregates with partial sums before the shuffle."""
    return df.groupBy(*keys).agg(*aggs)


def join(visits: DataFrame, rankings: DataFrame, lo: str, hi: str) -> DataFrame:
    """Average rank and total revenue per source, for visits dated ``lo`` to ``hi`` inclusive.

    ``visits(source, page, date, revenue)`` and ``rankings(page, rank)``. The date bounds take the type
    of the column so that the filter is pushed to the scan. No join hint: the planner broadcasts the
    rankings only while their size allows it and splits a hot page otherwise.
    """
    date_type = visits.schema["date"].dataType
    in_range = visits.where(F.col("date").between(F.lit(lo).cast(date_type), F.lit(hi).cast(date_type)))
    return (
        in_range.join(rankings, "page", "inner")
        .groupBy("source")
        .agg(F.avg("rank").alias("avg_rank"), F.sum("revenue").alias("revenue"))
    )


def join_ordered(visits: DataFrame, rankings: DataFrame, lo: str, hi: str) -> DataFrame:
    return join(visits, rankings, lo, hi).orderBy(F.desc("revenue"), "source")


def join_top1(visits: DataFrame, rankings: DataFrame, lo: str, hi: str, n: int = 1) -> DataFrame:
    """The ``n`` sources with the most revenue; order and limit run as one top-n per task."""
    return join_ordered(visits, rankings, lo, hi).limit(n)


def wordcount(df: DataFrame, text: str) -> DataFrame:
    return explode_tokens(df, text).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _order(df: DataFrame, keys: list[str], tiebreak: list[str] | None) -> list[str]:
    """The sort keys, then what tells rows with the same key apart, so that a hot key spans ranges."""
    rest = tiebreak if tiebreak is not None else [c for c in df.columns if c not in keys]
    return keys + rest


def sort(df: DataFrame, keys: list[str], tiebreak: list[str] | None = None) -> DataFrame:
    """All records in one global order. ``tiebreak`` defaults to all other columns; give a record id
    when many whole records may be equal."""
    return df.orderBy(*_order(df, keys, tiebreak))


def terasort(df: DataFrame, keys: list[str], slices: int, tiebreak: list[str] | None = None) -> DataFrame:
    """``slices`` range partitions, sorted inside, so that the files written from it are in total order."""
    order = _order(df, keys, tiebreak)
    return df.repartitionByRange(slices, *order).sortWithinPartitions(*order)
