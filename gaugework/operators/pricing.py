"""Price history, bids and cost."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.operators.ranking import top_rows

PRODUCT = "Linux/UNIX"
PRICE = "decimal(10,6)"


def avg_price(history: DataFrame, latest: int | None = None) -> DataFrame:
    """Mean price per type and zone over all records of the one product, or over the ``latest`` of each pair."""
    priced = history.where(F.col("product") == PRODUCT).select(
        "instance_type", "az", "ts", F.col("SpotPrice").try_cast(PRICE).alias("_price")
    )
    keys = ["instance_type", "az"]
    if latest is not None:
        priced = top_rows(priced, keys, [F.desc("ts"), F.desc("_price")], latest)
    return priced.groupBy(*keys).agg((F.sum("_price").cast("double") / F.count("_price")).alias("price"))


def filter_price_percentile(avg: DataFrame, percentile: float = 50) -> DataFrame:
    """Zones at or below the percentile of their type, interpolated linearly and exact.

    The input has one row per type and zone; equal prices of a type are counted before the percentile.
    """
    counts = avg.groupBy("instance_type", "price").agg(F.count(F.lit(1)).alias("_n"))
    limits = counts.groupBy("instance_type").agg(
        F.percentile("price", percentile / 100, F.col("_n")).alias("_limit")
    )
    return avg.join(limits, "instance_type").where(F.col("price") <= F.col("_limit")).drop("_limit")


def create_bids(prices: DataFrame, factor: float = 2) -> DataFrame:
    """Price times factor as text with three decimals, rounded half up on the decimal value."""
    bid = F.round(F.col("price").cast("decimal(18,9)") * F.lit(Decimal(str(factor))), 3)
    return prices.withColumn("bid", bid.cast("decimal(18,3)").cast("string"))


def choose_zone(bids: DataFrame, seed: int = 5, order: list[Column] | None = None) -> DataFrame:
    """One zone per type: a reproducible draw by hash, or the first in the given order."""
    order = order or [F.md5(F.concat_ws(" ", "instance_type", "az", F.lit(str(seed)))), F.col("az")]
    place = F.row_number().over(Window.partitionBy("instance_type").orderBy(*order))
    return bids.withColumn("_place", place).where("_place = 1").drop("_place")


def deployment_filter(df: DataFrame, nodes: tuple[int, int], families: list[str], shapes: list[str]) -> DataFrame:
    """Deployments with a node count in the range, of the given families and shapes."""
    family, shape = F.split_part("instance_type", F.lit("."), F.lit(1)), F.split_part("instance_type", F.lit("."), F.lit(2))
    return df.where(F.col("nodes").between(*nodes) & family.isin(families) & shape.isin(shapes))


def workload_cost(workers: Column, bid: Column, factor: float = 2) -> Column:
    """Two hours on all nodes at 1.2 times the price that the rounded bid stands for."""
    return (workers + 1) * (bid.cast("double") / F.lit(float(factor)) * F.lit(1.2)) * 2


def cost_estimate(deployments: DataFrame, workloads_each: int, factor: float = 2) -> DataFrame:
    """Total cost and instances of ``deployments(nodes, bid)``, each running ``workloads_each`` workloads.

    Cost counts every workload, instances count each deployment once, so the product is never built.
    """
    cost = F.sum(workload_cost(F.col("nodes"), F.col("bid"), factor)) * F.lit(workloads_each)
    return deployments.agg(cost.alias("cost"), F.sum(F.col("nodes") + 1).alias("instances"))
