"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns virtual nodes on a ring; a key belongs to the next node clockwise. No shard takes more than
``balance`` times the mean load: the keys of an arc that its full shard cannot take go on clockwise to the next node
whose shard has room. The ring is settled on loads of whole arcs, of which there are as many as virtual nodes
whatever the data is, and each key finds its place by the load before it in its arc.
"""

from __future__ import annotations

import bisect
import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.common import materialise, seeded_position

POSITIONS = 1 << 60


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise."""
    at = lambda s, v: int(hashlib.md5(f"node:{s}:{v}".encode()).hexdigest()[:15], 16)
    return sorted((at(s, v), s) for s in range(shards) for v in range(nodes))


def arc_of(position: Column, nodes: list[tuple[int, int]], steps: int = 4096) -> Column:
    """Number of the node that a position belongs to: a table of equal steps, then the few nodes inside the step."""
    places = [p for p, _ in nodes]
    width = POSITIONS // steps
    first = [bisect.bisect_left(places, k * width) for k in range(steps)]
    most = max((bisect.bisect_left(places, (k + 1) * width) - first[k] for k in range(steps)), default=0)
    table = F.lit(first)
    limits = F.lit(places + [POSITIONS] * (most + 1))
    begin = F.get(table, F.floor(position / F.lit(width)).cast("int"))
    arc = begin
    for k in range(most):
        arc = arc + F.when(F.get(limits, begin + k) < position, 1).otherwise(0)
    return (arc % len(nodes)).cast("int")


def settle(loads: dict[int, int], nodes: list[tuple[int, int]], shards: int, balance: float) -> list[tuple[int, int, int, int, int]]:
    """Segments (arc, number, from, to, shard) of the load of every arc.

    First each arc goes to its own shard while that has room, clockwise; then what is left over goes on
    clockwise from its arc to shards with room. The room is over the mean, so all of it finds a place.
    """
    total = sum(loads.values())
    room = [math.ceil(total * balance / shards)] * shards
    pieces: dict[int, list[tuple[int, int, int]]] = {arc: [] for arc in loads}
    over: list[tuple[int, int]] = []
    for arc in sorted(loads):
        shard = nodes[arc][1]
        take = min(loads[arc], room[shard])
        room[shard] -= take
        if take:
            pieces[arc].append((0, take, shard))
        if take < loads[arc]:
            over.append((arc, take))
    for arc, at in over:
        step = arc
        while at < loads[arc]:
            step = (step + 1) % len(nodes)
            shard = nodes[step][1]
            take = min(loads[arc] - at, room[shard])
            if take:
                room[shard] -= take
                pieces[arc].append((at, at + take, shard))
                at += take
    return [(arc, k, a, b, s) for arc, own in pieces.items() for k, (a, b, s) in enumerate(own)]


def shard_documents(
    docs: DataFrame,
    shards: int = 24,
    nodes: int = 128,
    balance: float = 1.001,
    seed: str = "shard-1",
    text: str = "text",
    id_column: str = "doc_id",
) -> DataFrame:
    """Per row ``doc_id, size, text_crc32, arc, shard, slot``.

    The load of a row is its UTF-8 bytes plus 8; a null text has none and the checksum of the empty one. The key is the
    id; rows that share an id lie together, told apart by checksum and size, and may be cut by the border of a segment like
    any others, so even an id that fills the table is dealt over several shards. ``slot`` numbers the rows of a shard
    from 0 without gaps. A row that begins inside a segment belongs to it whole, so a shard passes its bound by less
    than a row for each segment. Only loads and counts of arcs come to the driver.
    """
    spark = docs.sparkSession
    on_ring = ring(shards, nodes)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        seeded_position(seed, F.col(id_column)).alias("_position"),
    )
    rows = materialise(rows.withColumn("arc", arc_of(F.col("_position"), on_ring)), "shard-rows")
    loads = {r["arc"]: r["load"] for r in rows.groupBy("arc").agg(F.sum("size").alias("load")).collect()}
    segments = settle(loads, on_ring, shards, balance)
    segment_type = "arc int, part int, low long, high long, shard int"
    cut = F.broadcast(spark.createDataFrame(segments, segment_type))
    in_arc = Window.partitionBy("arc").orderBy("_position", "doc_id", "text_crc32", "size")
    placed = rows.withColumns(
        {
            "_before": F.coalesce(F.sum("size").over(in_arc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_row": F.row_number().over(in_arc).cast("long"),
        }
    )
    placed = placed.join(cut, "arc").where((F.col("_before") >= F.col("low")) & (F.col("_before") < F.col("high")))
    placed = materialise(placed.select("doc_id", "size", "text_crc32", "arc", "part", "shard", "_row"), "shard-places")
    counts = placed.groupBy("shard", "arc", "part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy("shard").orderBy("arc", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n", "shard")
    slot = (F.col("_offset") + F.col("_row") - F.col("_first")).cast("long")
    return placed.join(F.broadcast(offsets), ["arc", "part"]).select("doc_id", "size", "text_crc32", "arc", "shard", slot.alias("slot"))
