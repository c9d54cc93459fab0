"""Statistics on order lines and embeddings, and the matrix workloads."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.functions.numbers import seven_digits
from gaugework.operators import matrix, statistics, wide_matrix
from gaugework.plans.registry import query
from gaugework.sources.tables import load

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def seven_sql(expression: str) -> str:
    return f"CAST(CAST({expression} AS FLOAT) AS DOUBLE)"


def union_sql(select: str) -> str:
    return "\nUNION ALL ".join(select.replace("?", c) for c in NUMERIC)


@query(
    "summary_statistics",
    union_sql(f"""SELECT '?' AS "column", count(*) AS "count", {seven_sql("avg(?)")} AS mean,
  {seven_sql("var_samp(?)")} AS variance, CAST(count(*) FILTER (? <> 0) AS DOUBLE) AS nonzeros, min(?) AS min, max(?) AS max,
  {seven_sql("sum(abs(?))")} AS norm_l1, {seven_sql("sqrt(sum(? * ?))")} AS norm_l2 FROM lineitem"""),
)
def summary_statistics(spark, sf):
    table = statistics.summary_statistics(load(spark, sf, "lineitem"), NUMERIC)
    return table.withColumns({c: seven_digits(F.col(c)) for c in ["mean", "variance", "norm_l1", "norm_l2"]})


def pairs_sql(columns: list[str], expression: str, source: str) -> str:
    selects = [
        f"SELECT '{a}' AS i, '{b}' AS j, {'1.0::DOUBLE' if a == b else expression.replace('?1', a).replace('?2', b)} AS corr FROM {source}"
        + (" LIMIT 1" if a == b else "")
        for a in columns
        for b in columns
    ]
    return "\nUNION ALL ".join(f"({s})" for s in selects)


@query("pearson", pairs_sql(NUMERIC, "round(corr(?1, ?2), 6)", "lineitem"))
def pearson(spark, sf):
    return statistics.pearson(load(spark, sf, "lineitem"), NUMERIC).withColumn("corr", F.round("corr", 6))


MEAN_RANKS = ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in NUMERIC
)


@query(
    "spearman",
    f"WITH ranked AS MATERIALIZED (SELECT {MEAN_RANKS} FROM lineitem)\n"
    + pairs_sql(NUMERIC, "round(corr(?1::DOUBLE, ?2::DOUBLE), 6)", "ranked"),
)
def spearman(spark, sf):
    return statistics.spearman(load(spark, sf, "lineitem"), NUMERIC).withColumn("corr", F.round("corr", 6))


def categories(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("quantity"),
        F.round(F.col("l_discount") * 100).alias("discount"),
        F.round(F.col("l_tax") * 100).alias("tax"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("flag"),
    )


CATEGORIES_SQL = """
(SELECT l_linenumber AS line, l_quantity AS quantity, round(l_discount * 100) AS discount, round(l_tax * 100) AS tax,
        CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag FROM lineitem)
"""


def chi_square_sql(feature: str) -> str:
    return f"""
SELECT '{feature}' AS feature, round(sum((coalesce(o, 0) - r * c / n) ** 2 / (r * c / n)), 6) AS statistic,
       (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof
FROM (SELECT {feature} AS a, count(*)::DOUBLE AS r FROM {CATEGORIES_SQL} GROUP BY 1)
CROSS JOIN (SELECT flag AS b, count(*)::DOUBLE AS c FROM {CATEGORIES_SQL} GROUP BY 1)
CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM lineitem)
LEFT JOIN (SELECT {feature} AS a, flag AS b, count(*) AS o FROM {CATEGORIES_SQL} GROUP BY 1, 2) USING (a, b)
"""


FEATURES = ["line", "quantity", "discount", "tax"]


@query("chi_square_feature", "\nUNION ALL ".join(chi_square_sql(f) for f in FEATURES))
def chi_square_feature(spark, sf):
    test = statistics.chi_square_feature(categories(spark, sf), FEATURES, "flag")
    return test.select("feature", F.round("statistic", 6).alias("statistic"), F.col("dof").cast("bigint").alias("dof"))


@query(
    "chi_square_gof",
    """
SELECT round(sum((o - n / k) ** 2 / (n / k)), 6) AS statistic, count(*) - 1 AS dof
FROM (SELECT l_linenumber, count(*)::DOUBLE AS o FROM lineitem GROUP BY 1)
CROSS JOIN (SELECT count(*)::DOUBLE AS n, count(DISTINCT l_linenumber) AS k FROM lineitem)
""",
)
def chi_square_gof(spark, sf):
    fit = statistics.chi_square_gof(load(spark, sf, "lineitem"), "l_linenumber")
    return fit.withColumn("statistic", F.round("statistic", 6))


@query("chi_square_matrix", chi_square_sql("line").replace("'line' AS feature, ", ""))
def chi_square_matrix(spark, sf):
    table = statistics.chi_square_matrix(categories(spark, sf), "line", "flag")
    return table.withColumn("statistic", F.round("statistic", 6))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").select("vec_id", "embedding", "label")


GRAM_SQL = """
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
m AS (SELECT i, avg(v) AS mean FROM x GROUP BY 1),
c AS (SELECT vec_id, i, v {center} AS v FROM x JOIN m USING (i))
SELECT a.i::INTEGER AS i, b.i::INTEGER AS j, round(sum(a.v * b.v) {scale}, 6) + 0.0 AS value
FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2
"""


@query("svd_gramian", GRAM_SQL.format(center="", scale=""))
def svd_gramian(spark, sf):
    return matrix.gramian(vectors(spark, sf), "embedding").withColumn("value", F.round("value", 6) + F.lit(0.0))


@query("svd")
def svd(spark, sf):
    return matrix.svd(vectors(spark, sf), "embedding", 10).select("component", "sigma")


@query("pca_covariance", GRAM_SQL.format(center="- mean", scale="/ (SELECT count(*) - 1 FROM embeddings)"))
def pca_covariance(spark, sf):
    return matrix.covariance(vectors(spark, sf), "embedding").withColumn("value", F.round("value", 6) + F.lit(0.0))


@query("pca")
def pca(spark, sf):
    model, rows = matrix.pca(vectors(spark, sf), "embedding", 50)
    return model.transform(rows).select("vec_id", F.col("projected").cast("string").alias("projected"))


def supply(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Supplier x part quantities and part x ship year line counts."""
    lines = load(spark, sf, "lineitem")
    quantities = lines.groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("k")).agg(
        F.sum("l_quantity").alias("value")
    )
    years = lines.groupBy(F.col("l_partkey").alias("k"), F.year("l_shipdate").cast("bigint").alias("j")).agg(
        F.count(F.lit(1)).alias("value")
    )
    return quantities, years


@query(
    "block_matrix_multiply",
    """
SELECT i, j, sum(a.value * b.value) AS value
FROM (SELECT l_suppkey AS i, l_partkey AS k, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2) a
JOIN (SELECT l_partkey AS k, year(l_shipdate) AS j, count(*) AS value FROM lineitem GROUP BY 1, 2) b USING (k)
GROUP BY 1, 2
""",
)
def block_matrix_multiply(spark, sf):
    return matrix.block_matrix_multiply(*supply(spark, sf))


@query(
    "svd_energy",
    """
SELECT round(sum(v * v), 6) AS energy FROM (SELECT unnest(embedding::DOUBLE[]) AS v FROM embeddings)
""",
)
def svd_energy(spark, sf):
    """All squared singular values add up to the sum of all squared entries."""
    found = matrix.svd(load(spark, sf, "embeddings"), "embedding", 64)
    return found.agg(F.round(F.sum(F.col("sigma") * F.col("sigma")), 6).alias("energy"))


@query(
    "svd_wide_energy",
    """
SELECT round(sum(v * v), 6) AS energy FROM (SELECT unnest(embedding::DOUBLE[]) AS v FROM embeddings)
""",
)
def svd_wide_energy(spark, sf):
    """The same by directions and triangles, without the matrix of products."""
    found = wide_matrix.svd(load(spark, sf, "embeddings"), "embedding", 64)
    return found.agg(F.round(F.sum(F.col("sigma") * F.col("sigma")), 6).alias("energy"))


@query(
    "pca_wide_energy",
    """
SELECT round(sum(v), 6) AS variance FROM (
  SELECT place, var_samp(x) AS v FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS place FROM embeddings)
  GROUP BY place)
""",
)
def pca_wide_energy(spark, sf):
    found = wide_matrix.pca(load(spark, sf, "embeddings"), "embedding", 64)
    return found.agg(F.round(F.sum("variance"), 6).alias("variance"))


@query(
    "pca_energy",
    """
SELECT round(sum(v), 6) AS variance FROM (
  SELECT place, var_samp(x) AS v FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS place FROM embeddings)
  GROUP BY place)
""",
)
def pca_energy(spark, sf):
    """The variances along all principal components add up to those of all columns."""
    model, rows = matrix.pca(load(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 64)
    projected = model.transform(rows).select(F.col("projected").alias("features"))
    spread = projected.select(Summarizer.metrics("variance").summary(F.col("features")).alias("s"))
    total = F.aggregate(vector_to_array(F.col("s.variance")), F.lit(0.0), lambda a, x: a + x)
    return spread.select(F.round(total, 6).alias("variance"))
