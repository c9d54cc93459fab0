"""Mixing sources to target weights: capped water-filling over the sources, seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import WORD, materialise, position_cell, running_sum, seeded_position, with_row_key
from gaugework.operators.ranking import number_rows
from gaugework.session import shuffle_partitions

SEED = "mix-1"
CELL_ROWS = 1_000_000
LEAST_CELLS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycling_weights(sources: DataFrame, order: list[str], weights: list[int]) -> DataFrame:
    """Add ``weight``: the weights repeat over the sources in their order."""
    ranged = sources.repartitionByRange(shuffle_partitions(sources.sparkSession), *order).sortWithinPartitions(*order)
    numbered = number_rows(ranged, "_place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_place") - 1) % len(weights) + 1).cast("int"))
    return numbered.withColumn("weight", weight.cast("long")).drop("_place")


def water_fill(sources: DataFrame, total: float, epochs: float) -> DataFrame:
    """Add ``target`` to ``source_size, weight``: shares of ``total`` by weight, none above ``epochs`` times its size.

    Rounds: share what is left by weight, clamp the sources that would pass their cap, and share their excess among
    the others until none passes. A round is one small aggregate; only its two sums come to the driver.
    """
    cap = F.lit(epochs) * F.col("source_size")
    clamped = F.lit(False)
    left, weights, fixed = total, None, -1
    while True:
        row = sources.agg(
            F.sum(F.when(clamped, cap).otherwise(0.0)).alias("given"),
            F.sum(F.when(clamped, F.lit(0)).otherwise(F.col("weight"))).alias("weights"),
            F.count_if(clamped).alias("clamped"),
        ).first()
        left, weights = total - (row["given"] or 0.0), row["weights"] or 0
        if row["clamped"] == fixed or not weights:
            break
        fixed = row["clamped"]
        clamped = clamped | (F.col("weight") * F.lit(left) > cap * F.lit(float(weights)))
    share = F.col("weight") * F.lit(left) / F.lit(float(weights or 1))
    return sources.withColumn("target", F.when(clamped, cap).otherwise(share))


def _placed(docs: DataFrame, seed: str, text: str, source: str, id_column: str) -> DataFrame:
    """Add the columns by which rows are ordered and their words counted: ``_none, _source, _size, _position``."""
    return docs.select(
        "*",
        F.col(source).isNull().alias("_none"),
        F.coalesce(F.col(source), F.lit("")).alias("_source"),
        word_count(F.col(text)).alias("_size"),
        seeded_position(seed, F.col(id_column)).alias("_position"),
    )


def _fill_sources(base: DataFrame, weights: list[int], share: float, epochs: int) -> tuple[DataFrame, DataFrame]:
    """The sources with ``target, _whole, _extra`` (whole epochs, words of the fraction), and the rows of ``base`` with all of
    that, ``_sum`` (words before the row in its source's order) and ``_part`` (words of the fraction that the row gives)."""
    sources = base.groupBy("_none", "_source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sources = materialise(cycling_weights(sources, ["_none", "_source"], weights), "mix-sources")
    totals = sources.agg(F.sum("source_size"), F.sum("_rows")).first()
    filled = water_fill(sources, share * float(totals[0] or 0), float(epochs))
    whole = F.least(F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))), F.lit(epochs)).cast("long")
    filled = filled.withColumn("_whole", whole).withColumn("_extra", F.floor("target").cast("long") - whole * F.col("source_size"))
    finest = max(LEAST_CELLS, (totals[1] or 0) // CELL_ROWS)
    cells = F.greatest(F.ceil(F.col("_rows") * F.lit(finest / max(1, totals[1] or 1))), F.lit(1))
    rows = base.join(filled.withColumn("_cells", cells), ["_none", "_source"])
    rows = rows.withColumn("_cell", position_cell(F.col("_position"), F.col("_cells")))
    order = [c for c in ("_position", "doc_id", "_size", "_file", "_at") if c in base.columns]
    before = running_sum(rows, ["_none", "_source"], "_cell", order, "_size", "_sum")
    part = F.least(F.greatest(F.col("_extra") - F.col("_sum"), F.lit(0)), F.col("_size"))
    return filled, before.withColumn("_part", part)


def _mostly() -> Column:
    """Whether a row gives at least half of its words to the fraction; one without words never does."""
    return (F.col("_size") > 0) & (2 * F.col("_part") >= F.col("_size"))


def plan_mix(
    docs: DataFrame,
    weights: list[int],
    share: float = 1.5,
    epochs: int = 2,
    seed: str = SEED,
    text: str = "text",
    source: str = "source",
    id_column: str = "doc_id",
) -> DataFrame:
    """Per row ``doc_id, size, source_size, target, repeats, taken`` (and ``source``).

    ``share`` times all words are dealt to the sources. A source whose target is e epochs of its words is taken floor(e)
    times whole; the fraction is a seeded sample: its documents in the order of a hashed position, as many as fit in the
    words that are left, the one at the border in part. So the taken words of a source are its target but for
    less than one word. ``taken`` counts words; ``repeats`` are whole documents, the one at the border rounded.

    A null text has no words; a null source is a source, the last. Equal positions (repeated ids) are told apart by
    size, and rows equal in both may swap places, which changes no row. Sums over a source come from
    cells of its hashed order, so no source meets in one task. Reruns and other partitionings give the same rows.
    """
    base = _placed(docs.select(F.col(id_column).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")), seed, "text", "source", "doc_id")
    base = materialise(base.drop("text", "source"), "mix-sizes")
    _, before = _fill_sources(base, weights, share, epochs)
    return before.select(
        "doc_id",
        F.when(~F.col("_none"), F.col("_source")).alias("source"),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        (F.col("_whole") + F.when(_mostly(), 1).otherwise(0)).cast("int").alias("repeats"),
        (F.col("_whole") * F.col("_size") + F.col("_part")).alias("taken"),
    )


def mix(
    docs: DataFrame,
    weights: list[int],
    share: float = 1.5,
    epochs: int = 2,
    seed: str = SEED,
    text: str = "text",
    source: str = "source",
    id_column: str = "doc_id",
) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as :func:`plan_mix` repeats it; rows taken no time are left out.

    Only ids, sizes and places are ordered. They give the last row of each source's fraction, and every row tells from its own
    place whether it comes before it, so texts are never shuffled. Rows that share id, size and position are told apart by
    file and row index: a crowd of equal rows at the border is cut at the word like any other.
    """
    base = _placed(with_row_key(docs, "mix-docs"), seed, *(f"_row.`{c}`" for c in (text, source, id_column)))
    id_of = F.col(f"_row.`{id_column}`")
    narrow = base.select(id_of.alias("doc_id"), "_none", "_source", "_size", "_position", "_file", "_at")
    filled, before = _fill_sources(materialise(narrow, "mix-sizes"), weights, share, epochs)
    place = F.struct("_position", F.col("doc_id").alias("_id"), "_size", "_file", "_at")
    border = before.where(_mostly()).groupBy("_none", "_source").agg(F.max(place).alias("_border"))
    fills = filled.select("_none", "_source", "_whole").join(border, ["_none", "_source"], "left")
    # a row for each source: a written table has a known size, by which the planner broadcasts it or not
    rows = base.join(materialise(fills, "mix-borders"), ["_none", "_source"])
    own = F.struct("_position", id_of.alias("_id"), "_size", "_file", "_at")
    extra = F.when((F.col("_size") > 0) & F.col("_border").isNotNull() & (own <= F.col("_border")), 1).otherwise(0)
    rows = rows.withColumn("_repeats", (F.col("_whole") + extra).cast("int")).where("_repeats > 0")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_repeats"))))
    return rows.select("_row.*")
