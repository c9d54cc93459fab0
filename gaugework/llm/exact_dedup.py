"""Exact duplicates through an extendible-hash index on shared files.

The key of a text is the head of its SHA-256. A directory over key prefixes doubles until no bucket holds more
distinct keys than its capacity: a bucket that is overfull at depth d splits into two at depth d + 1, others keep
their depth. Texts are compared byte by byte where equal keys meet (as the grouping value, combined in the map tasks,
so a crowd of copies is one row per task), texts with equal keys form a chain, and the tasks that own the key ranges
write the buckets in key order to the shared folder. Each row then looks up its entry.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.common import HOT_SHARE, look_up, materialise
from gaugework.session import shuffle_partitions

KEY_BITS = 60


def text_key(sha: Column) -> Column:
    return F.conv(F.substring(sha, 1, KEY_BITS // 4), 16, 10).cast("long")


def directory(keys: DataFrame, rows: int, capacity: int) -> DataFrame:
    """``cell, bucket, depth`` for every cell of the finest directory that so many rows can need.

    The finest cells are counted once, over distinct keys; the counts of all coarser depths are sums of those. A cell
    belongs to its shallowest prefix that is not overfull.
    """
    finest = max(1, math.ceil(math.log2(max(2.0, rows / capacity))) + 3)
    cell = F.shiftright("key", KEY_BITS - finest).cast("int").alias("cell")
    cells = keys.select("key").distinct().groupBy(cell).agg(F.count(F.lit(1)).alias("n"))
    prefixes = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(finest))).alias("depth"))
    prefixes = prefixes.withColumn("bucket", F.expr(f"shiftright(cell, {finest} - depth)"))
    held = prefixes.groupBy("depth", "bucket").agg(F.sum("n").alias("held"))
    fitting = held.where((F.col("held") <= capacity) | (F.col("depth") == finest)).drop("held")
    at = F.min(F.struct("depth", "bucket")).alias("at")
    chosen = prefixes.drop("n").join(fitting, ["depth", "bucket"]).groupBy("cell").agg(at)
    return chosen.select("cell", F.col("at.bucket").alias("bucket"), F.col("at.depth").alias("depth"), F.lit(finest).alias("finest"))


def _keyed(docs: DataFrame, text: str, id_column: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    hashed = docs.select(F.col(id_column).alias("doc_id"), body.alias("_text"), F.sha2(body, 256).alias("text_sha256"))
    return hashed.withColumn("key", text_key(F.col("text_sha256")))


def build_index(docs: DataFrame, text: str = "text", id_column: str = "doc_id", capacity: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The table of row keys (``doc_id, text_sha256, key``) and the index, both written to the shared folder.

    The index has one entry per distinct text: ``depth, bucket, key, chain, text_sha256, keep_id, group_size``, where
    ``chain`` numbers texts of equal key from 1.
    """
    keyed = _keyed(docs, text, id_column)
    keys = materialise(keyed.drop("_text"), "dedup-keys")
    places = directory(keys, keys.count(), capacity)
    grouped = keyed.groupBy("key", "_text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    entries = grouped.select("key", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size")
    finest = places.select(F.max("finest")).first()[0]
    if finest is None:
        finest = 1
    entries = entries.withColumn("cell", F.shiftright("key", KEY_BITS - finest).cast("int")).join(places.drop("finest"), "cell").drop("cell")
    # the width of a key range is that of its bucket, so ranges of the key are runs of whole buckets
    chain = F.row_number().over(Window.partitionBy("_owner", "key").orderBy("text_sha256"))
    owned = entries.withColumn("_owner", F.expr(f"shiftleft(bucket, {finest} - depth)")).repartition(shuffle_partitions(docs.sparkSession), "_owner")
    index = owned.withColumn("chain", chain).sortWithinPartitions("_owner", "key").drop("_owner")
    return keys, materialise(index, "dedup-index")


def find_copies(docs: DataFrame, text: str = "text", id_column: str = "doc_id", capacity: int = 4096) -> DataFrame:
    """Per row ``doc_id, keep_id, group_size, kept, text_sha256``. A null text counts as empty.

    Of equal texts the largest id stays. Rows that repeat both id and text are one document and share its verdict,
    but each counts in ``group_size``; a null id stays only where no row of the group has one. Entries of more than
    1/1000 of the rows (so fewer than 1000) are looked up by broadcast, the others by an equi-join on the key.
    """
    keys, index = build_index(docs, text, id_column, capacity)
    copied = index.where("group_size > 1").select("key", "text_sha256", "keep_id", "group_size")
    rows = look_up(keys, copied, ["key", "text_sha256"], "group_size", max(1, keys.count() // HOT_SHARE))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    rows = rows.withColumns({"keep_id": keep, "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, text: str = "text", id_column: str = "doc_id", capacity: int = 4096) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat both id and text a single one, whichever.

    Such rows are combined in the map tasks, so a crowd of them is one row per task; without any, nothing is combined.
    """
    found = find_copies(docs, text, id_column, capacity)
    lost = found.where("not kept").select(F.col("doc_id").alias("_lost_id"), F.col("text_sha256").alias("_lost_sha")).distinct()
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    left = docs.join(lost, F.col(id_column).eqNullSafe(F.col("_lost_id")) & (sha == F.col("_lost_sha")), "left_anti")
    repeated = found.where("kept and group_size > 1").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.isEmpty():
        return left
    return left.withColumn("_sha", sha).dropDuplicates([id_column, "_sha"]).drop("_sha")
