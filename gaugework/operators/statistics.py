"""Descriptive statistics, correlation and chi-square tests."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import ChiSquareTest, Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.lineage import cut_lineage
from gaugework.operators.ranking import rank_table
from gaugework.skew import MAX_HOT_KEYS

METRICS = {
    "count": "count", "mean": "mean", "variance": "variance", "numNonZeros": "nonzeros", "min": "min", "max": "max",
    "normL1": "norm_l1", "normL2": "norm_l2",
}


def names_of(df: DataFrame, columns: list[str] | str) -> list[str]:
    """The given columns, or the positions of an array column."""
    if not isinstance(columns, str):
        return columns
    row = df.select(F.size(columns)).where(F.col(columns).isNotNull()).first()
    return [str(i) for i in range(row[0] if row else 0)]


def vectors_of(df: DataFrame, columns: list[str] | str) -> DataFrame:
    """Numeric columns, or one array column, as the vector column ``features``. The one rule for nulls of all
    statistics on several columns: a row with a null in any of them is left out."""
    if isinstance(columns, str):
        whole = F.col(columns).isNotNull() & ~F.exists(columns, lambda x: x.isNull())
        return df.where(whole).select(array_to_vector(F.col(columns).cast("array<double>")).alias("features"))
    return assemble(df.dropna(subset=columns), columns, keep=[])


def assemble(df: DataFrame, columns: list[str], name: str = "features", keep: list[str] | None = None) -> DataFrame:
    """Numeric columns as one vector column."""
    rest = df.columns if keep is None else keep
    return VectorAssembler(inputCols=columns, outputCol=name).transform(df).select(*rest, name)


def summary_statistics(df: DataFrame, columns: list[str] | str) -> DataFrame:
    """Per column, or per position of an array column: count, mean, variance, nonzeros, min, max, L1 and L2
    norm, in one pass."""
    names = names_of(df, columns)
    summary = Summarizer.metrics(*METRICS).summary(F.col("features")).alias("s")
    one_row = vectors_of(df, columns).select(summary)
    arrays = [
        vector_to_array(F.col(f"s.{m}")).alias(n) if m != "count" else F.col("s.count").alias(n) for m, n in METRICS.items()
    ]
    zipped = F.arrays_zip(F.lit(names).alias("column"), *[n for m, n in METRICS.items() if m != "count"])
    return (
        one_row.select(*arrays)
        .select("count", F.explode(zipped).alias("z"))
        .select("z.column", "count", *[f"z.{n}" for m, n in METRICS.items() if m != "count"])
    )


def _matrix_rows(df: DataFrame, matrix, labels: list[str]) -> DataFrame:
    """A small square matrix of model size as ``(i, j, corr)``."""
    values = matrix.toArray()
    data = [(a, b, float(values[x, y])) for x, a in enumerate(labels) for y, b in enumerate(labels)]
    return df.sparkSession.createDataFrame(data, "i string, j string, corr double")


def pearson(df: DataFrame, columns: list[str] | str) -> DataFrame:
    """Correlation of all pairs of columns, or of positions of an array column, as ``(i, j, corr)``; only
    sums per column and pair move."""
    matrix = Correlation.corr(vectors_of(df, columns), "features", "pearson").first()[0]
    return _matrix_rows(df, matrix, names_of(df, columns))


def spearman(df: DataFrame, columns: list[str], row_id: list[str] | None = None) -> DataFrame:
    """Rank correlation of all pairs of columns, with the mean rank for equal values.

    A row with a null in any column is left out before anything is ranked. Values are counted per column before they are
    ranked, so a value shared by most rows is ranked once. The rows go through one long form: one join gives every
    value its rank, one grouping by ``row_id`` puts rows together again. Without a ``row_id`` rows get a number first.
    """
    table = df.select(*(row_id or []), *[F.col(c).cast("double") for c in columns]).dropna(subset=columns)
    if not row_id:
        row_id = ["_row"]
        table = cut_lineage(table.withColumn("_row", F.monotonically_increasing_id()))
    ranks = cut_lineage(_column_ranks(table, columns))
    long = table.unpivot(row_id, columns, "_column", "_value")
    of_column = [F.max(F.when(F.col("_column") == c, F.col("_rank"))).alias(c) for c in columns]
    # a value of more than 1/1000 of its column's rows has its rank broadcast (fewer than 1000 a column); its rows never meet in one task
    bar, on = max(1, table.count() // MAX_HOT_KEYS), ["_column", "_value"]
    near = long.join(F.broadcast(ranks.where(F.col("_n") > bar).drop("_n")), on, "left")
    rest = near.where("_rank is null").drop("_rank").join(ranks.where(F.col("_n") <= bar).drop("_n"), on)
    ranked = near.where("_rank is not null").unionByName(rest)
    return pearson(ranked.groupBy(*row_id).agg(*of_column), columns)


def _column_ranks(table: DataFrame, columns: list[str]) -> DataFrame:
    """``(_column, _value, _n, _rank)``: rows and mean rank of each distinct value inside its column."""
    values = table.select(*columns).unpivot([], columns, "_column", "_value")
    ranks = rank_table(values, ["_column", "_value"])
    start = ranks.groupBy("_column").agg((F.min("rank") - 1).alias("_start"))
    # one row per column of the table
    return ranks.join(F.broadcast(start), "_column").select(
        "_column", "_value", F.col("n").alias("_n"), (F.col("mean_rank") - F.col("_start")).alias("_rank")
    )


def chi_square_feature(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Independence of each categorical feature and the label: ``(feature, statistic, dof, p_value)``."""
    table = assemble(df.dropna(subset=[*features, label]), features, "_features", [F.col(label).cast("double").alias("_label")])
    names = F.array(*[F.lit(f) for f in features])
    return ChiSquareTest.test(table, "_features", "_label", flatten=True).select(
        F.get(names, F.col("featureIndex")).alias("feature"),
        "statistic",
        F.col("degreesOfFreedom").alias("dof"),
        F.col("pValue").alias("p_value"),
    )


def chi_square_gof(df: DataFrame, category: str, expected: DataFrame | None = None) -> DataFrame:
    """Goodness of fit of one column as ``(statistic, dof)``, uniform unless ``expected(category, share)``
    is given. Null values are no category. Squares of (o-e) are summed, not differences of sums of size n, so the
    statistic keeps its digits at any n. A category that occurs but is not expected makes it infinite; one that is
    expected but does not occur adds its expected count.
    """
    counts = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.count(F.lit(1)).cast("double").alias("_o"))
    if expected is None:
        joined = counts.withColumn("share", F.lit(1.0))
    else:
        joined = expected.join(counts, category, "full").withColumns(
            {"_o": F.coalesce("_o", F.lit(0.0)), "share": F.coalesce("share", F.lit(0.0))}
        )
    totals = joined.agg(F.sum("_o").alias("_n"), F.sum("share").alias("_all"))  # one row
    e = F.col("_n") * F.col("share") / F.col("_all")
    part = F.when(e > 0, (F.col("_o") - e) * (F.col("_o") - e) / e).otherwise(
        F.when(F.col("_o") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    )
    return joined.join(F.broadcast(totals)).agg(F.sum(part).alias("statistic"), (F.count(F.lit(1)) - 1).alias("dof"))


def chi_square_matrix(df: DataFrame, row: str, column: str) -> DataFrame:
    """Independence in a contingency table as ``(statistic, dof)``.

    Over the seen cells (o-e)^2/e is summed as it is; the cells that do not occur add their expected counts, which are n
    less those of the seen cells. So the grid is never built, and no two sums of size n^2 are subtracted.
    """
    cells = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column)
    cells = cells.agg(F.count(F.lit(1)).cast("double").alias("_o"))
    rows = cells.groupBy(row).agg(F.sum("_o").alias("_r"))
    columns = cells.groupBy(column).agg(F.sum("_o").alias("_c"))
    total = rows.agg(F.sum("_r").alias("_n"))  # one row
    parts = cells.join(rows, row).join(columns, column).join(F.broadcast(total))
    e = F.col("_r") * F.col("_c") / F.col("_n")
    seen = F.sum((F.col("_o") - e) * (F.col("_o") - e) / e)
    # o - e summed over the seen cells is the expected count of the others: small numbers, where those are few
    return parts.agg(
        (seen + F.sum(F.col("_o") - e)).alias("statistic"),
        ((F.countDistinct(row) - 1) * (F.countDistinct(column) - 1)).alias("dof"),
    )
