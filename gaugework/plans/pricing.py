"""Price operators. Each order line stands for one price record; one zone holds half of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.operators import pricing
from gaugework.plans.registry import query
from gaugework.plans.runs import INSTANCES, RUN_SQL, pick, pick_sql, run_table
from gaugework.sources.lookups import DEPLOYMENTS, lookup_tables
from gaugework.sources.tables import load

ZONES = ["us-east-1a", "us-east-1b", "us-east-1c", "us-east-1d", "us-east-1e"] + ["us-east-1f"] * 5


def price_history(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").select(
        pick(INSTANCES, F.col("l_partkey")).alias("instance_type"),
        pick(ZONES, F.col("l_suppkey")).alias("az"),
        F.when(F.col("l_linenumber") == 7, "Windows").otherwise("Linux/UNIX").alias("product"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice").cast("decimal(10,2)") / F.lit(10000).cast("decimal(6,0)"))
        .cast("decimal(10,6)")
        .cast("string")
        .alias("SpotPrice"),
    )


HISTORY_SQL = f"""
(SELECT {pick_sql(INSTANCES, "l_partkey")} AS instance_type, {pick_sql(ZONES, "l_suppkey")} AS az,
        l_shipdate AS ts, CAST(CAST(l_extendedprice AS DECIMAL(10,2)) / 10000 AS DECIMAL(10,6)) AS price
 FROM lineitem WHERE l_linenumber <> 7)
"""

AVG_SQL = f"(SELECT instance_type, az, CAST(sum(price) AS DOUBLE) / count(*) AS price FROM {HISTORY_SQL} GROUP BY 1, 2)"

FILTERED_SQL = f"""
(SELECT a.instance_type, a.az, a.price FROM {AVG_SQL} a
 JOIN (SELECT instance_type, quantile_cont(price, 0.5) AS top FROM {AVG_SQL} GROUP BY 1) t USING (instance_type)
 WHERE a.price <= t.top)
"""

BID_SQL = f"""
(SELECT instance_type, az, price, CAST(CAST(round(CAST(price AS DECIMAL(18,9)) * 2, 3) AS DECIMAL(18,3)) AS VARCHAR) AS bid
 FROM {FILTERED_SQL})
"""


def shown(df: DataFrame) -> DataFrame:
    return df.withColumn("price", F.round("price", 9))


@query("avg_price", f"SELECT instance_type, az, round(price, 9) AS price FROM {AVG_SQL}")
def avg_price(spark, sf):
    return shown(pricing.avg_price(price_history(spark, sf)))


@query(
    "avg_price_latest",
    f"""
SELECT instance_type, az, round(CAST(sum(price) AS DOUBLE) / count(*), 9) AS price
FROM (SELECT *, row_number() OVER (PARTITION BY instance_type, az ORDER BY ts DESC, price DESC) AS n FROM {HISTORY_SQL})
WHERE n <= 1000 GROUP BY 1, 2
""",
)
def avg_price_latest(spark, sf):
    return shown(pricing.avg_price(price_history(spark, sf), latest=1000))


@query("filter_price_percentile", f"SELECT instance_type, az, round(price, 9) AS price FROM {FILTERED_SQL}")
def filter_price_percentile(spark, sf):
    return shown(pricing.filter_price_percentile(pricing.avg_price(price_history(spark, sf))))


def bids(spark: SparkSession, sf: str) -> DataFrame:
    return pricing.create_bids(pricing.filter_price_percentile(pricing.avg_price(price_history(spark, sf))))


@query("create_bids", f"SELECT instance_type, az, round(price, 9) AS price, bid FROM {BID_SQL}")
def create_bids(spark, sf):
    return shown(bids(spark, sf))


@query(
    "choose_zone",
    f"""
SELECT instance_type, az, round(price, 9) AS price, bid FROM {BID_SQL}
QUALIFY row_number() OVER (PARTITION BY instance_type ORDER BY md5(instance_type || ' ' || az || ' 5'), az) = 1
""",
)
def choose_zone(spark, sf):
    return shown(pricing.choose_zone(bids(spark, sf)))


CHEAPEST_SQL = f"""
(SELECT instance_type, az, price, bid FROM {BID_SQL}
 QUALIFY row_number() OVER (PARTITION BY instance_type ORDER BY price, az) = 1)
"""


@query("choose_zone_cheapest", f"SELECT instance_type, az, round(price, 9) AS price, bid FROM {CHEAPEST_SQL}")
def choose_zone_cheapest(spark, sf):
    return shown(pricing.choose_zone(bids(spark, sf), order=[F.col("price"), F.col("az")]))


@query(
    "deployment_filter",
    f"""
SELECT run, nodes, instance_type FROM {RUN_SQL}
WHERE nodes BETWEEN 4 AND 16 AND split_part(instance_type, '.', 1) IN ('c4', 'm4', 'r4')
  AND split_part(instance_type, '.', 2) IN ('xlarge', '2xlarge')
""",
)
def deployment_filter(spark, sf):
    table = run_table(spark, sf).select("run", "nodes", "instance_type")
    return pricing.deployment_filter(table, (4, 16), ["c4", "m4", "r4"], ["xlarge", "2xlarge"])


@query(
    "cost_estimate",
    f"""
SELECT round(sum((nodes + 1) * (CAST(bid AS DOUBLE) / 2 * 1.2) * 2), 6) AS cost,
       CAST(sum(CASE WHEN w.app = 'lr' AND w.size = 'huge' THEN nodes + 1 ELSE 0 END) AS BIGINT) AS instances
FROM {CHEAPEST_SQL} JOIN (VALUES {", ".join(f"({n}, '{s}')" for n, s in DEPLOYMENTS)}) d(nodes, shape)
  ON split_part(instance_type, '.', 2) = shape
CROSS JOIN (VALUES ('lr', 'huge'), ('lr', 'bigdata'), ('join', 'huge'), ('join', 'bigdata')) w(app, size)
""",
)
def cost_estimate(spark, sf):
    chosen = pricing.choose_zone(bids(spark, sf), order=[F.col("price"), F.col("az")])
    shape = F.split_part("instance_type", F.lit("."), F.lit(2))
    deployments = chosen.withColumn("shape", shape).join(F.broadcast(lookup_tables(spark)["deployments"]), "shape")
    total = pricing.cost_estimate(deployments, workloads_each=4)
    return total.withColumn("cost", F.round("cost", 6))
