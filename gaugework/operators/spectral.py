"""Power iteration clustering: rounds of a sparse matrix that stays in its blocks, and k-means on the vector they give."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.lineage import cut_lineage
from gaugework.operators.factors import Blocks, add_up, drawn, lists, place_of, stacked
from gaugework.operators.learning import kmeans, kmeans_assign
from gaugework.session import shuffle_partitions

#: The rounds end when no node's change differs from its last one by this, over the number of nodes.
ACCELERATION = 1e-5


def affinity(edges: DataFrame) -> DataFrame:
    """``src, dst, weight`` in both directions, each pair once with its weights added up, and rows summing to 1."""
    pairs = (
        edges.where("src <> dst and weight > 0")
        .groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .agg(F.sum("weight").cast("double").alias("w"))
    )
    both = cut_lineage(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w")))
    degrees = both.groupBy("src").agg(F.sum("w").alias("degree"))
    return both.join(degrees, "src").select("src", "dst", (F.col("w") / F.col("degree")).alias("weight"))


def _row_sums(edges, vectors):
    import pyarrow as pa

    own, at = np.unique(edges.column("own").to_numpy(), return_inverse=True)
    order, place = place_of(vectors.column("id").to_numpy(), edges.column("other").to_numpy())
    product = edges.column("value").to_numpy() * stacked(vectors.column("v"))[order][place, 0]
    block = edges.column("block")[0].as_py() if edges.num_rows else 0
    return pa.table({
        "id": pa.array(own, pa.int64()), "v": lists(np.bincount(at, product, len(own))[:, None]), "block": pa.array(np.full(len(own), block), pa.int64()),
    })


def power_vector(edges: DataFrame, iterations: int = 20, acceleration: float = ACCELERATION) -> DataFrame:
    """``id, v``: the vector after the rounds, absolute values summing to 1.

    It starts from md5 of the ids. Rounds end early when the change of no node differs from its change in the round before
    by more than ``acceleration`` / nodes: then all that is left is the slow common way to the constant vector.
    """
    blocks = Blocks(cut_lineage(affinity(edges)), "src", "dst", "weight")
    start = blocks.edges.select(F.col("own").alias("id")).distinct().withColumn("u", drawn(F.lit("power"), F.col("id")))
    n, total = start.agg(F.count("u"), F.sum("u")).first()
    current = cut_lineage(start.select("id", (F.col("u") / F.lit(total or 1.0)).alias("v"), F.lit(0.0).alias("change")))
    for done in range(1, iterations + 1):
        sums = blocks.meet(current.select("id", F.array("v").alias("v")), _row_sums, "id long, v array<double>, block long")
        summed = cut_lineage(add_up(sums, shuffle_partitions(edges.sparkSession)).select("id", F.get("v", F.lit(0)).alias("_next")))
        norm = summed.agg(F.sum(F.abs("_next"))).first()[0] or 1.0
        moved = summed.join(current, "id").select(
            "id", (F.col("_next") / F.lit(norm)).alias("v"), F.abs(F.col("_next") / F.lit(norm) - F.col("v")).alias("change"),
            F.abs(F.abs(F.col("_next") / F.lit(norm) - F.col("v")) - F.col("change")).alias("turn"),
        )
        moved = cut_lineage(moved)
        turn = moved.agg(F.max("turn")).first()[0]
        current = moved.drop("turn")
        if done > 1 and (turn or 0.0) < acceleration / max(n, 1):
            break
    blocks.free()
    return current.select("id", "v")


def power_iteration_clustering(edges: DataFrame, k: int = 40, iterations: int = 20) -> DataFrame:
    """Clusters ``(id, cluster)`` of ``edges(src, dst, weight)``, whole ids.

    Each pair is taken in both directions with its weights added up; loops, weights that are not above 0 and rows with a null are left out.
    """
    vector = power_vector(edges.dropna(), iterations)
    n = max(1, vector.count())
    points = vector.select("id", F.array(F.col("v") * n).alias("point"))
    centres = kmeans(points, "id", "point", k)
    if not len(centres):
        return points.select("id", F.lit(None).cast("int").alias("cluster"))
    return kmeans_assign(points, "point", centres).select("id", F.col("centre").alias("cluster"))
