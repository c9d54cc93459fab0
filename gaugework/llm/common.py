"""Scratch tables in the shared folder, seeded positions and running sums that never pass one task."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugework.lineage import scratch_path

#: White space of the word rule: ASCII space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
_POSITION_BITS = 60
_scopes: list[list[str]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs neither repeat its work nor depend on executors."""
    path = scratch_path(df.sparkSession, name)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove at the end the tables that :func:`materialise` wrote inside, on an error too.

    Whatever is still wanted must have been written outside of the scope's own tables by then: a DataFrame that reads one of
    them can no longer run. Scopes nest; a table belongs to the innermost.
    """
    _scopes.append([])
    try:
        yield
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs
        for name in _scopes.pop():
            path = hadoop.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise_last(make, spark: SparkSession, name: str) -> DataFrame:
    """Write what ``make()`` returns, remove the scratch tables that it wrote on its way, and read it back."""
    path = scratch_path(spark, name)
    with scratch_scope(spark):
        df = make()
        schema = df.schema
        df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(schema).parquet(path)


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """``_row`` (all columns of ``docs`` in a struct), ``_file, _at``: file and row index, a key of each row, of equal rows too.

    It is the same in every run over the table. Rows that do not come straight from files (columns chosen and rows left out
    are allowed) are written to a table first. As the given columns are in the struct, their names clash with none.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    stored = docs if plan.nodeName().startswith("LogicalRelation") else materialise(docs, name)
    place = stored.metadataColumn("_metadata")
    row = F.struct(*[stored[f"`{c}`"] for c in docs.columns]).alias("_row")
    return stored.select(row, place["file_path"].alias("_file"), place["row_index"].alias("_at"))


def seeded_position(seed: str, *columns: Column) -> Column:
    """A 60-bit position drawn from the values of ``columns``; the same in any engine with md5."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    digest = F.md5(F.concat_ws(":", F.lit(seed), *parts))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def position_cell(position: Column, cells: Column | int) -> Column:
    """Number of the equal range, of ``cells``, that a position lies in; rises with the position."""
    cells = cells if isinstance(cells, Column) else F.lit(cells)
    return F.floor(position / F.lit(float(1 << _POSITION_BITS)) * cells).cast("long")


def running_sum(df: DataFrame, group: list[str], cell: str, order: list[str], weight: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over the rows of the group that come before in ``order``.

    ``cell`` cuts each group into ranges of that order. Totals of the cells are summed first (pre-aggregated
    in the map tasks), so that only rows of one cell ever meet in a task. No column of ``group`` may be null.
    """
    totals = df.groupBy(*group, cell).agg(F.sum(weight).alias("_cell_sum"))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, cell, F.coalesce(F.sum("_cell_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(offsets, [*group, cell])
        .withColumn(name, F.col("_before") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .drop("_before")
    )


HOT_SHARE = 1000


def look_up(rows: DataFrame, entries: DataFrame, on: list[str], size: str, bar: int) -> DataFrame:
    """Left join of ``rows`` to ``entries`` (one per key), where ``size`` tells how many rows have the key.

    Entries above ``bar`` go by broadcast, so a hot key is never shuffled; with a bar of 1/HOT_SHARE of the rows there are
    fewer than HOT_SHARE of them. The rest is an equi-join. The keys must not be null.
    """
    given = [c for c in entries.columns if c not in on]
    hot = F.broadcast(entries.where(F.col(size) > bar))
    near = rows.join(hot, on, "left")
    done = near.where(F.col(size).isNotNull())
    rest = near.where(F.col(size).isNull()).drop(*given)
    return done.unionByName(rest.join(entries.where(F.col(size) <= bar), on, "left"))
