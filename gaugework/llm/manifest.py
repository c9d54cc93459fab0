"""Merkle manifest of a dataset: leaf places by rank in bitmaps of ids, levels by keyed slot arrays.

The place of a leaf is the number of rows of its source with a smaller id, and no table of leaves is sorted for it:

- ids of a source are merged into bitmaps, 64 ids a word and 64 words a chunk (``bit_or``, combined in the map tasks). Only words
  with a bit set are kept, each with the number of rows before it in its chunk: the popcount directory;
- a running sum over the chunks, of which there is one per 4096 ids at most, gives what lies before a chunk;
- the rank is chunk + directory + the bits set below one's own in the word. Words in which an id occurs twice or more are
  the exception: their rows are counted by (id, leaf) and placed by a running sum over those.

A level joins every 16 consecutive nodes. Nodes are dealt by (source, place div 256) and put into an array by their slot, and
two levels are taken from one array. On the way back each array hands every member its siblings, so a group never holds
more than 256 nodes, whatever a source holds. Subroots are leaves of one more such tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.llm.common import materialise
from gaugework.session import shuffle_partitions

FAN = 16
#: Levels taken from one array of slots, and the slots it has.
STEP = 2
SPAN = FAN**STEP
WORD_BITS = 6
CHUNK_BITS = 12
#: Equal rows are written out from their count in blocks of so many.
COPIES = 4096
#: Place of the rows without an id: a chunk below that of every long.
NO_ID = -(1 << 60)
HASH_OF = ["doc_id", "source", "lang", "n_chars", "text"]
LETTERS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(text: Column) -> Column:
    return F.sha2(F.concat(*[field(F.col(c)) for c in HASH_OF[:-1]], field(text)), 256)


def tampered(doc_id: Column, every: int) -> Column:
    """Whether the checksum of the decimal id is divisible by ``every``; no row without an id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % every == 0, F.lit(False))


def leaves(docs: DataFrame, every: int = 5) -> DataFrame:
    """``g, doc_id, chunk, word, bit, leaf, changed``: one scan of the texts. ``changed`` is the leaf of a tampered row, else null.

    ``g`` is never null and sorts as the source does, null first.
    """
    docs = docs.select(*HASH_OF)
    lowered = leaf_hash(F.translate("text", LETTERS, SMALL))
    own = F.col("doc_id").cast("long")
    low = F.coalesce(own.bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)), F.lit(0))
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("g"),
        own.alias("doc_id"),
        F.coalesce(F.shiftright(own, CHUNK_BITS), F.lit(NO_ID)).alias("chunk"),
        F.shiftright(low, WORD_BITS).cast("int").alias("word"),
        low.bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int").alias("bit"),
        leaf_hash(F.col("text")).alias("leaf"),
        F.when(tampered(F.col("doc_id"), every), lowered).alias("changed"),
    )


def running_sums(df: DataFrame, group: list[str], order: list[str], weight: str, name: str) -> DataFrame:
    """Add ``before`` and ``total``: the sums of ``weight`` over the group's rows that come before in ``order``, and over all.

    ``group`` and ``order`` together must be distinct and not null. The table is cut into ranges, which are written with their number;
    only rows of one range, or one row per range of a group, ever meet in a task.
    """
    keys = [*group, *order]
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).withColumn("_slice", F.spark_partition_id())
    stored = materialise(ranged, name)
    sums = stored.groupBy(*group, "_slice").agg(F.sum(weight).alias("_sum"))
    of_group = Window.partitionBy(*group)
    before = of_group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *group, "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(of_group).alias("total")
    )
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        stored.join(sums, [*group, "_slice"])
        .withColumn("before", F.col("_before") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .drop("_slice", "_before")
    )


def bitmaps(rows: DataFrame) -> DataFrame:
    """``g, chunk, n, words``: for each chunk of ids its rows and the words with a bit set, ``struct(word, bits, n, before)`` in order."""
    word = rows.groupBy("g", "chunk", "word").agg(
        F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.count(F.lit(1)).alias("n")
    )
    chunks = word.groupBy("g", "chunk").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("word", "bits", "n"))).alias("_words")
    )
    before = "aggregate(slice(_words, 1, i), 0L, (s, w) -> s + w.n)"
    words = f"transform(_words, (w, i) -> named_struct('word', w.word, 'bits', w.bits, 'n', w.n, 'before', {before}))"
    return chunks.select("g", "chunk", "n", F.expr(words).alias("words"))


def places(rows: DataFrame) -> DataFrame:
    """``g, pos, total, doc_id, leaf, changed``: the rows with their place in the source (from 0) and the rows it has.

    Rows of one id are in the order of their leaves; rows alike in both are alike in all, so any order of them is the same.
    """
    chunks = running_sums(bitmaps(rows), ["g"], ["chunk"], "n", "manifest-chunks")
    at = rows.join(chunks.drop("n"), ["g", "chunk"])
    at = at.withColumn("_w", F.expr("filter(words, w -> w.word = word)[0]")).drop("words")
    at = at.withColumn("_start", F.expr("before + _w.before")).withColumn("_single", F.expr("_w.n = bit_count(_w.bits)"))
    at = materialise(at, "manifest-ranks")
    kept = ["g", "total", "doc_id", "leaf", "changed"]
    rank = F.expr("_start + bit_count(_w.bits & ~shiftleft(-1L, bit))")
    ranked = at.where("_single").select(*kept, rank.alias("pos"))
    shared = at.where("not _single")
    if shared.isEmpty():
        return ranked
    alike = shared.groupBy("g", "chunk", "word", "bit", "leaf").agg(
        F.count(F.lit(1)).alias("n"), F.first("doc_id").alias("doc_id"), F.first("changed").alias("changed"),
        F.first("_start").alias("_start"), F.first("total").alias("_all"),
    )
    alike = running_sums(alike, ["g", "chunk", "word"], ["bit", "leaf"], "n", "manifest-alike").drop("total").withColumnRenamed("_all", "total")
    blocks = alike.withColumn("_b", F.expr(f"explode(sequence(0L, (n - 1) div {COPIES}))"))
    if not blocks.where("_b > 0").isEmpty():  # a crowd of equal rows is written out by many tasks
        blocks = blocks.repartition(shuffle_partitions(rows.sparkSession), "g", "chunk", "bit", "leaf", "_b")
    copy = F.explode(F.expr(f"sequence(_b * {COPIES}, least(n, (_b + 1) * {COPIES}) - 1)"))
    pos = F.col("_start") + F.col("before") + F.col("_copy")
    return ranked.unionByName(blocks.withColumn("_copy", copy).select(*kept, pos.alias("pos")))


def _joined(level: str) -> Column:
    """The next level of an array of digests."""
    return F.expr(
        f"transform(sequence(0, (size({level}) - 1) div {FAN}), k -> sha2(array_join(slice({level}, k * {FAN} + 1, {FAN}), ''), 256))"
    )


def _siblings(level: str, at: str) -> str:
    """The digests of one run left and right of the member ``at`` (from 0)."""
    left = f"array_join(slice({level}, {at} - {at} % {FAN} + 1, {at} % {FAN}), '')"
    right = f"array_join(slice({level}, {at} + 2, {FAN - 1} - {at} % {FAN}), '')"
    return f"named_struct('left', {left}, 'right', {right})"


def height(total: Column) -> Column:
    """Levels above so many leaves: 0 for one."""
    return sum(((total > F.lit(FAN**k)).cast("int") for k in range(15)), F.lit(0))


def climb(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The written slot arrays of each round, ``g, block, height, steps, items, l0, l1, apex``, from the leaves up.

    ``nodes`` holds ``g, pos, total, digest, payload``. The last round has one block per group, whose apex is its root. A group that is done
    earlier hands its root through.
    """
    most = nodes.agg(F.max(height(F.col("total")))).first()[0]
    rounds = max(1, -(-(most or 0) // STEP))
    current = nodes.select("g", "pos", height(F.col("total")).alias("height"), "digest", "payload")
    made = []
    for r in range(rounds):
        slot = F.struct((F.col("pos") % SPAN).alias("slot"), "digest", "payload")
        arrays = current.groupBy("g", F.expr(f"pos div {SPAN}").alias("block"), "height").agg(
            F.sort_array(F.collect_list(slot)).alias("items")
        )
        arrays = arrays.withColumn("steps", F.greatest(F.lit(0), F.least(F.lit(STEP), F.col("height") - STEP * r)))
        arrays = arrays.withColumn("l0", F.col("items.digest")).withColumn("l1", _joined("l0"))
        apex = F.when(F.col("steps") == 0, F.expr("l0[0]")).when(F.col("steps") == 1, F.expr("l1[0]")).otherwise(_joined("l1")[0])
        made.append(materialise(arrays.withColumn("apex", apex), f"{name}-{r}"))
        none = F.struct(F.lit(0).alias("none"))
        current = made[-1].select("g", F.col("block").alias("pos"), "height", F.col("apex").alias("digest"), none.alias("payload"))
    return made


def descend(rounds: list[DataFrame], tops: DataFrame, carry: list[str]) -> DataFrame:
    """``g, digest, payload, path`` and ``carry`` for the leaves of the rounds: ``path`` has the siblings of each level, left and right.

    ``tops`` gives the path above the root of each group, and the columns to carry down.
    """
    current = tops.withColumn("pos", F.lit(0).cast("long"))
    for arrays in reversed(rounds):
        met = arrays.join(current.withColumnRenamed("pos", "block"), ["g", "block"])
        items = met.select("g", "block", "steps", "l0", "l1", "path", *carry, F.posexplode("items").alias("_at", "_item"))
        own = F.expr(
            f"CASE steps WHEN 0 THEN path WHEN 1 THEN concat(array({_siblings('l0', '_at')}), path) "
            f"ELSE concat(array({_siblings('l0', '_at')}, {_siblings('l1', f'(_at div {FAN})')}), path) END"
        )
        pos = F.col("block") * SPAN + F.col("_at")
        current = items.select("g", pos.alias("pos"), F.col("_item.digest").alias("digest"), F.col("_item.payload").alias("payload"), own.alias("path"), *carry)
    return current.drop("pos")


def merkle_manifest(docs: DataFrame, every: int = 5) -> DataFrame:
    """Per row ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    A row with a null in any column is a leaf like any other; rows without an id come first in their source and are not
    tampered with, a null source is the first of the sources. Rows that share an id are in the order of their leaves, and equal rows
    are leaves of their own. An empty table has no row. Other columns are not looked at.
    """
    rows = materialise(leaves(docs, every), "manifest-leaves")
    at = places(rows)
    nodes = at.select("g", "pos", "total", F.col("leaf").alias("digest"), F.struct("doc_id", "changed").alias("payload"))
    rounds = climb(nodes, "manifest-levels")
    subroots = rounds[-1].select("g", "apex")
    ordered = running_sums(subroots.select(F.lit("").alias("_all"), "g", "apex", F.lit(1).alias("_one")), ["_all"], ["g"], "_one", "manifest-sources")
    named = F.struct(F.col("g").alias("g"))
    top = climb(ordered.select(F.col("_all").alias("g"), F.col("before").alias("pos"), "total", F.col("apex").alias("digest"), named.alias("payload")), "manifest-top")
    path = F.expr("cast(array() as array<struct<left: string, right: string>>)").alias("path")
    above = descend(top, top[-1].select("g", path, F.col("apex").alias("root")), ["root"])
    above = above.select(F.col("payload.g").alias("g"), "path", F.col("digest").alias("subroot"), "root")
    found = descend(rounds, materialise(above, "manifest-above"), ["subroot", "root"])
    found = found.select(F.col("payload.doc_id").alias("doc_id"), F.col("payload.changed").alias("_changed"), F.col("digest").alias("leaf"), "subroot", "root", "path")
    proof = F.expr("sha2(array_join(transform(path, s -> concat(s.left, s.right)), ''), 256)")
    folded = F.expr("aggregate(path, coalesce(_changed, leaf), (h, s) -> sha2(concat(s.left, h, s.right), 256))")
    found = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
