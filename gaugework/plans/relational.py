"""Record workloads on lineitem (visits: supplier to part), part (rankings), orders and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.operators import ranking, relational
from gaugework.plans.registry import query
from gaugework.session import shuffle_partitions
from gaugework.sources.tables import load, with_row_id

LO, HI = "1997-01-01", "1997-12-31"


def visits(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("source"),
        F.col("l_partkey").alias("page"),
        F.col("l_shipdate").alias("date"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("revenue"),
    )


def rankings(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select(F.col("p_partkey").alias("page"), F.col("p_size").alias("rank"))


@query(
    "scan",
    """
SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, l_returnflag FROM lineitem WHERE l_quantity >= 25
""",
)
def scan(spark, sf):
    columns = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"]
    return relational.scan(load(spark, sf, "lineitem"), columns, F.col("l_quantity") >= 25)


@query(
    "aggregation",
    """
SELECT l_suppkey AS source, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM lineitem GROUP BY l_suppkey
""",
)
def aggregation(spark, sf):
    return relational.aggregation(visits(spark, sf), ["source"], [F.sum("revenue").cast("double").alias("revenue")])


JOIN_SQL = f"""
SELECT l_suppkey AS source, round(avg(p_size), 6) AS avg_rank,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_shipdate BETWEEN TIMESTAMP '{LO}' AND TIMESTAMP '{HI}'
GROUP BY l_suppkey
"""


def _shown(joined: DataFrame) -> DataFrame:
    return joined.select(
        "source", F.round("avg_rank", 6).alias("avg_rank"), F.col("revenue").cast("double").alias("revenue")
    )


@query("join", JOIN_SQL)
def join(spark, sf):
    return _shown(relational.join_ordered(visits(spark, sf), rankings(spark, sf), LO, HI))


@query("join_top1", JOIN_SQL + "ORDER BY revenue DESC, source LIMIT 1")
def join_top1(spark, sf):
    return _shown(relational.join_top1(visits(spark, sf), rankings(spark, sf), LO, HI))


@query(
    "wordcount",
    r"""
SELECT word, count(*) AS n
FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents)
WHERE word <> '' GROUP BY word
""",
)
def wordcount(spark, sf):
    return relational.wordcount(load(spark, sf, "documents").select("text"), "text")


LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]


@query(
    "sort",
    f"""
SELECT {", ".join(LINE_COLUMNS)}, row_number() OVER (ORDER BY l_shipdate, {", ".join(LINE_COLUMNS)}) AS position
FROM lineitem
""",
)
def sort(spark, sf):
    records = with_row_id(load(spark, sf, "lineitem"))
    ordered = relational.sort(records, ["l_shipdate"], LINE_COLUMNS + ["row_file", "row_index"])
    return ranking.number_rows(ordered).select(*LINE_COLUMNS, "position")


@query(
    "terasort",
    """
SELECT o_orderkey, o_custkey, o_totalprice,
       row_number() OVER (ORDER BY o_orderpriority, o_totalprice, o_orderkey, o_custkey) AS position
FROM orders
""",
)
def terasort(spark, sf):
    records = with_row_id(load(spark, sf, "orders"))
    ordered = relational.terasort(
        records,
        ["o_orderpriority", "o_totalprice"],
        shuffle_partitions(spark),
        ["o_orderkey", "o_custkey", "row_file", "row_index"],
    )
    return ranking.number_rows(ordered).select("o_orderkey", "o_custkey", "o_totalprice", "position")


@query(
    "global_rank",
    """
SELECT l_orderkey, l_linenumber, l_extendedprice, rank() OVER (ORDER BY l_extendedprice) AS rank FROM lineitem
""",
)
def global_rank(spark, sf):
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return ranking.global_rank(lines, ["l_extendedprice"])
