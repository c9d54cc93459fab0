from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gaugework.operators import ranking, relational
from helpers import frame, rows


def ranks(values):
    """Rank, dense rank and mean rank by the definition; null sorts first."""
    order = sorted(values, key=lambda v: (v is not None, v))
    first = {}
    for i, v in enumerate(order):
        first.setdefault(v, i + 1)
    dense = {v: i + 1 for i, v in enumerate(dict.fromkeys(order))}
    return {v: (first[v], dense[v], first[v] + (values.count(v) - 1) / 2) for v in first}


def table(spark, values, parts=4):
    return frame(spark, list(enumerate(values)), "id bigint, v int").repartition(parts)


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_rank_table(spark, parts):
    draw = random.Random(1)
    values = [7] * 100 + [draw.choice([None, *range(40)]) for _ in range(200)]  # a third is one value
    got = {r["v"]: (r["rank"], r["dense_rank"], r["mean_rank"]) for r in ranking.rank_table(table(spark, values, parts), ["v"]).collect()}
    assert got == ranks(values)


def test_global_rank_keeps_every_row_and_nulls(spark):
    values = [3, None, 3, 1, None]
    expected = ranks(values)
    got = rows(ranking.global_rank(table(spark, values), ["v"]).select("id", "rank"))
    assert got == sorted(((i, expected[v][0]) for i, v in enumerate(values)), key=repr)


@pytest.mark.parametrize("values", [[], [5], [None, None, None]])
def test_small_tables(spark, values):
    assert ranking.global_rank(table(spark, values), ["v"], "dense_rank").count() == len(values)
    assert ranking.number_rows(relational.sort(table(spark, values), ["v"])).count() == len(values)


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_number_rows_is_the_sort_order(spark, parts):
    draw = random.Random(2)
    values = [draw.randrange(20) for _ in range(500)]
    numbered = ranking.number_rows(relational.sort(table(spark, values, parts), ["v"]))
    got = [(r["v"], r["id"]) for r in numbered.orderBy("position").collect()]
    assert got == sorted((v, i) for i, v in enumerate(values))
    assert rows(numbered.select("position")) == sorted(((i,) for i in range(1, 501)), key=repr)


def test_terasort_ranges_do_not_overlap_even_for_one_hot_key(spark):
    values = [1] * 4000 + list(range(2000))
    slices = relational.terasort(table(spark, values, 8), ["v"], 8).withColumn("p", F.spark_partition_id())
    spans = slices.groupBy("p").agg(F.min(F.struct("v", "id")).alias("lo"), F.max(F.struct("v", "id")).alias("hi"), F.count("*").alias("n"))
    spans = sorted((tuple(r["lo"]), tuple(r["hi"]), r["n"]) for r in spans.collect())
    assert sum(n for *_, n in spans) == len(values)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert max(n for *_, n in spans) < 2000  # the hot key is spread by its tie-break


def test_top_rows_against_brute_force(spark):
    draw = random.Random(3)
    data = [("hot" if draw.random() < 0.5 else f"k{draw.randrange(9)}", draw.randrange(50), i) for i in range(2000)]
    df = frame(spark, data, "k string, v int, id int").repartition(16)
    got = rows(ranking.top_rows(df, ["k"], [F.desc("v"), F.col("id")], 7, parts=5))
    groups = {}
    for row in data:
        groups.setdefault(row[0], []).append(row)
    expected = [row for g in groups.values() for row in sorted(g, key=lambda r: (-r[1], r[2]))[:7]]
    assert got == sorted(expected, key=repr)
