"""Frequent itemsets and sequences."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth, FPGrowthModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gaugework.lineage import cut_lineage


def baskets(df: DataFrame, basket: str, item: str) -> DataFrame:
    """Distinct items per basket. Repeats go away before the shuffle, so a basket never holds more than
    the catalogue of items."""
    return df.groupBy(basket).agg(F.collect_set(item).alias("items"))


def sequences(df: DataFrame, key: str, order: str, item: str) -> DataFrame:
    """Itemsets in order per key. Each place of a sequence is a set, and the places are distinct values of
    ``order``, so both are bounded by their domains and not by the rows of the key."""
    places = df.groupBy(key, order).agg(F.sort_array(F.collect_set(item)).alias("_set"))
    ordered = F.sort_array(F.collect_list(F.struct(order, "_set")))
    return places.groupBy(key).agg(F.transform(ordered, lambda place: place["_set"]).alias("sequence"))


def fp_growth(
    df: DataFrame, items: str = "items", min_support: float = 0.01, min_confidence: float = 0.8
) -> FPGrowthModel:
    return FPGrowth(itemsCol=items, minSupport=min_support, minConfidence=min_confidence).fit(df)


def _pattern_counts(grown: DataFrame, least: int) -> DataFrame:
    return cut_lineage(grown.groupBy("pattern").agg(F.sum("weight").alias("freq")).where(F.col("freq") >= least))


def _grow(state: DataFrame) -> DataFrame:
    """Each pattern that a sequence holds by one more item of the sequence: in a later set, or larger in the set of the last one."""
    nothing = F.lit([]).cast(state.schema["steps"].dataType.elementType)
    last, first = F.element_at("pattern", -1), F.col("places")[0]
    later = F.flatten(F.slice("steps", first + 2, F.size("steps")))
    beside = F.flatten(F.transform("places", lambda at: F.filter(F.get("steps", at), lambda x: x > F.array_max(last))))
    as_next = lambda items, joins: F.transform(F.array_distinct(items), lambda x: F.struct(x.alias("item"), F.lit(joins).alias("joins")))
    longer = state.withColumn("_next", F.explode(F.concat(as_next(later, False), as_next(F.coalesce(beside, nothing), True))))
    item, joins = F.col("_next.item"), F.col("_next.joins")
    holds = lambda at: F.array_contains(F.get("steps", at), item)
    after = F.filter(F.sequence(F.lit(0), F.size("steps") - 1), lambda at: (at > first) & holds(at))
    wider = F.concat(F.slice("pattern", 1, F.size("pattern") - 1), F.array(F.concat(last, F.array(item))))
    return longer.select(
        "weight",
        "steps",
        F.when(joins, wider).otherwise(F.concat("pattern", F.array(F.array(item)))).alias("pattern"),
        F.when(joins, F.filter("places", holds)).otherwise(after).alias("places"),
    )


def prefix_span(
    df: DataFrame,
    sequence: str = "sequence",
    min_support: float = 0.5,
    max_length: int = 10,
    max_local_size: int = 32_000_000,
) -> DataFrame:
    """Frequent sequential patterns ``(sequence, freq)`` of up to ``max_length`` items.

    Equal sequences count as one with their number as weight. Patterns grow by an item a round, each beside the places where its
    last set may stand; only frequent ones stay. Sequences of a prefix never meet in a task, as they do in Spark's ``PrefixSpan`` while
    they have fewer items than ``max_local_size``. So that bound, a parameter of the catalogue, has nothing left to hold down here.
    """
    # a name of its own: the column may be a path to a field
    steps = df.select(F.col(sequence).alias("steps")).where("steps is not null")
    weighed = cut_lineage(steps.groupBy("steps").agg(F.count(F.lit(1)).alias("weight")))
    least = math.ceil(min_support * (weighed.agg(F.sum("weight")).first()[0] or 0))
    items = weighed.select(F.explode(F.array_distinct(F.flatten("steps"))).alias("item"), "weight")
    kept = items.groupBy("item").agg(F.sum("weight").alias("n")).where(F.col("n") >= least)
    kept = F.broadcast(kept.agg(F.collect_list("item").alias("kept")))
    sets = F.transform("steps", lambda held: F.array_sort(F.array_intersect(held, F.col("kept"))))
    kind = weighed.schema["steps"].dataType
    state = weighed.crossJoin(kept).select("weight", F.filter(sets, lambda held: F.size(held) > 0).alias("steps")).where("size(steps) > 0")
    state = state.groupBy("steps").agg(F.sum("weight").alias("weight"))
    state = cut_lineage(state.select("weight", "steps", F.lit([]).cast(kind).alias("pattern"), F.array(F.lit(-1)).alias("places")))
    found = df.sparkSession.createDataFrame([], StructType([StructField("sequence", kind), StructField("freq", LongType())]))
    for length in range(1, max_length + 1):
        grown = _grow(state)
        counts = _pattern_counts(grown, least)
        if counts.isEmpty():
            break
        found = found.union(counts.select("pattern", "freq"))
        if length < max_length:
            state = cut_lineage(grown.join(F.broadcast(counts.select("pattern")), "pattern", "left_semi"))
    return found
