"""Link-graph workloads on edge lists ``(src, dst, weight)``."""

from __future__ import annotations

from pyspark import StorageLevel
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.text import count_tokens
from gaugework.lineage import cut_lineage
from gaugework.operators.ranking import top_rows
from gaugework.session import shuffle_partitions
from gaugework.skew import copy_rows, hot_keys, join_keys, split_rows

CUT_EVERY = 5


def pagerank(edges: DataFrame, iterations: int = 3, damping: float = 0.85) -> DataFrame:
    """Rank ``(node, rank)`` of every vertex of ``edges(src, dst)``; ranks sum to 1.

    The edges are shuffled once, with hot sources over several parts, and stay in place: each round
    moves only ranks and partial sums. A lost block is rebuilt from the source. The rank of vertices
    without links out is spread over all vertices.
    """
    slices = shuffle_partitions(edges.sparkSession)
    links = edges.select("src", "dst").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    hot = hot_keys(links, "src")
    placed = split_rows(links, "src", hot, ["dst"]).repartition(slices, *join_keys("src", hot))
    placed = placed.persist(StorageLevel.MEMORY_AND_DISK)
    placed.count()  # filled before its first join: only then do the joins see that it is partitioned

    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("out")),
                             F.struct(F.col("dst").alias("node"), F.lit(0).alias("out"))))
    nodes = links.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.out").alias("degree"))
    nodes = nodes.repartition(slices, "node").persist(StorageLevel.MEMORY_AND_DISK)
    n = nodes.count()
    links.unpersist()
    has_dangling = not nodes.where(F.col("degree") == 0).isEmpty()

    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for done in range(1, iterations + 1):
        lost = 0.0
        if has_dangling:
            lost = ranks.where(F.col("degree") == 0).agg(F.sum("rank")).first()[0]
        shares = ranks.where(F.col("degree") > 0).select(
            F.col("node").alias("src"), (F.col("rank") / F.col("degree")).alias("share")
        )
        received = (
            placed.join(copy_rows(shares, "src", hot), join_keys("src", hot))
            .groupBy(F.col("dst").alias("node"))
            .agg(F.sum("share").alias("received"))
        )
        base = (1.0 - damping + damping * lost) / max(n, 1)
        ranks = nodes.join(received, "node", "left").select(
            "node", "degree", (F.lit(base) + F.lit(damping) * F.coalesce("received", F.lit(0.0))).alias("rank")
        )
        # with dangling vertices each round is read twice, once for their mass
        if has_dangling or done % CUT_EVERY == 0 or done == iterations:
            ranks = cut_lineage(ranks)
    placed.unpersist()
    nodes.unpersist()
    return ranks.select("node", "rank")


def posting_lists(counts: DataFrame) -> DataFrame:
    """``term, block, _docs, postings`` of the rows ``doc, term, tf, block`` that lie together in order; rows of one id are added up."""
    columns = ["term", "block", "doc", "tf"]
    kind = counts.schema["doc"].dataType.simpleString()

    def changes(column: pa.Array) -> np.ndarray:
        null = column.is_null().to_numpy(zero_copy_only=False)
        other = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
        return np.append(True, other | (null[1:] != null[:-1]))

    def made(rows: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch:
        own = np.flatnonzero(new | changes(rows.column(2)))
        tf = np.add.reduceat(rows.column(3).to_numpy(), own)
        first = np.flatnonzero(new)
        begin = np.append(np.searchsorted(own, first), len(own)).astype(np.int32)
        entries = pa.StructArray.from_arrays([rows.column(2).take(pa.array(own)), pa.array(tf)], ["doc", "tf"])
        lists = pa.ListArray.from_arrays(pa.array(begin), entries)
        heads = [rows.column(k).take(pa.array(first)) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*heads, pa.array(np.diff(begin).astype(np.int64)), lists], ["term", "block", "_docs", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*rest, batch]).combine_chunks().to_batches()[0]
            new = changes(rows.column(0)) | changes(rows.column(1))
            # the last list may go on in the next batch
            cut = int(np.flatnonzero(new)[-1])
            rest = [rows.slice(cut)]
            if cut:
                yield made(rows.slice(0, cut), new[:cut])
        if rest:
            yield made(rest[0], np.append(True, np.zeros(rest[0].num_rows - 1, bool)))

    return counts.select(columns).mapInArrow(run, f"term string, block long, _docs long, postings array<struct<doc:{kind},tf:bigint>>")


def inverted_index(docs: DataFrame, doc_id: str, text: str, block: int = 1024) -> DataFrame:
    """Postings ``(doc, tf)`` per term in blocks of ``block`` consecutive document ids, with the document
    frequency ``df`` of the term.

    A term that occurs everywhere has a posting per document; the blocks bound each list at ``block``
    entries and keep the index whole.
    """
    counts = count_tokens(docs, text, F.col(doc_id), name="term").withColumn("block", F.floor(F.col("doc") / F.lit(block)))
    # dealt by term and block once and sorted: a list is a run of rows. Written once: the sizes come from the finished blocks
    blocks = cut_lineage(posting_lists(counts.repartition("term", "block").sortWithinPartitions("term", "block", "doc")))
    sizes = blocks.groupBy("term").agg(F.sum("_docs").alias("df"))
    return blocks.join(sizes, "term").select("term", "block", "df", "postings")


def n_hop_weight(edges: DataFrame, hops: int = 2, top: int = 3) -> DataFrame:
    """The ``top`` strongest vertices exactly ``hops`` steps away from each vertex.

    The weight of a path is the product of its edges, and paths with the same ends add up. All paths
    count; only the final report is cut. Edges of a hot middle vertex are split over several tasks.
    """
    links = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    if hops > 1:
        links = cut_lineage(links)
        hot = hot_keys(links, "src")
        renamed = {"src": "middle", "dst": "end", "weight": "step"}
        step = split_rows(links, "src", hot, ["dst"]).withColumnsRenamed(renamed)
    paths = links
    for hop in range(2, hops + 1):
        open_paths = paths.select("src", F.col("dst").alias("middle"), "weight")
        paths = (
            copy_rows(open_paths, "middle", hot, "src")
            .join(step, join_keys("middle", hot))
            .groupBy("src", F.col("end").alias("dst"))
            .agg(F.sum(F.col("weight") * F.col("step")).alias("weight"))
        )
        if hop < hops:
            paths = cut_lineage(paths)
    return top_rows(paths, ["src"], [F.desc("weight"), F.col("dst")], top)
