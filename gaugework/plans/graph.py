"""Graph workloads on the orders graph, and an index over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.operators import graph
from gaugework.plans.registry import query
from gaugework.sources.tables import load

ROUNDS = 3


def trade_links(spark: SparkSession, sf: str) -> DataFrame:
    """Customers (even ids) and the suppliers (odd ids) they buy from, linked both ways."""
    lines = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    pairs = (
        load(spark, sf, "orders")
        .select("o_orderkey", "o_custkey")
        .join(lines, "o_orderkey")
        .select((F.col("o_custkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b"))
        .distinct()
    )
    both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
                             F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return pairs.select(both.alias("e")).select("e.src", "e.dst")


LINKS_SQL = """
pairs AS (SELECT DISTINCT o_custkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
links AS (SELECT a AS src, b AS dst FROM pairs UNION ALL SELECT b, a FROM pairs),
degrees AS (SELECT src AS node, count(*) AS degree FROM links GROUP BY 1),
total AS (SELECT count(*) AS n FROM degrees),
r0 AS (SELECT node, degree, 1.0::DOUBLE / n AS rank FROM degrees, total)"""


def rounds_sql(rounds: int) -> str:
    steps = [
        f"""r{i} AS (SELECT d.node, d.degree, 0.15::DOUBLE / n + 0.85::DOUBLE * s.received AS rank
  FROM degrees d JOIN (SELECT dst AS node, sum(rank / degree) AS received FROM links JOIN r{i - 1} ON src = node GROUP BY 1) s
  USING (node), total)"""
        for i in range(1, rounds + 1)
    ]
    return ",\n".join([LINKS_SQL, *steps])


@query("pagerank", f"WITH {rounds_sql(ROUNDS)} SELECT node, round(rank, 9) AS rank FROM r{ROUNDS}")
def pagerank(spark, sf):
    return graph.pagerank(trade_links(spark, sf), ROUNDS).withColumn("rank", F.round("rank", 9))


@query(
    "inverted_index",
    r"""
WITH counts AS (
  SELECT term, doc_id, count(*) AS tf
  FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS term FROM documents)
  WHERE term <> '' GROUP BY 1, 2),
sizes AS (SELECT term, count(*) AS df FROM counts GROUP BY 1)
SELECT term, doc_id // 256 AS block, any_value(df) AS df,
       string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id) AS postings
FROM counts JOIN sizes USING (term) GROUP BY 1, 2
""",
)
def inverted_index(spark, sf):
    documents = load(spark, sf, "documents").select("doc_id", "text")
    index = graph.inverted_index(documents, "doc_id", "text", block=256)
    shown = F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc"], p["tf"])), " ")
    return index.withColumn("postings", shown)


def order_links(spark: SparkSession, sf: str) -> DataFrame:
    """Customer to order to part, in one id space; the second step weighs the quantity."""
    first = load(spark, sf, "orders").select(
        (F.col("o_custkey") * 3).alias("src"), (F.col("o_orderkey") * 3 + 1).alias("dst"), F.lit(1.0).alias("weight")
    )
    second = load(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 3 + 1).alias("src"),
        (F.col("l_partkey") * 3 + 2).alias("dst"),
        F.col("l_quantity").alias("weight"),
    )
    return first.unionByName(second)


@query(
    "n_hop_weight",
    """
SELECT o_custkey * 3 AS src, l_partkey * 3 + 2 AS dst, sum(l_quantity) AS weight
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 3
""",
)
def n_hop_weight(spark, sf):
    return graph.n_hop_weight(order_links(spark, sf), hops=2, top=3)
