from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gaugework import skew
from gaugework.operators import relational
from helpers import frame, rows

VISITS = "source int, page int, date timestamp_ntz, revenue decimal(18,2)"


def visits(spark, data):
    return frame(spark, [(s, p, dt.datetime.fromisoformat(d), r) for s, p, d, r in data], VISITS)


def test_join_bounds_are_inclusive_and_unmatched_pages_fall_out(spark):
    from decimal import Decimal as D

    v = visits(spark, [
        (1, 10, "2000-01-01", D("1.50")), (1, 11, "2000-12-31", D("2.50")), (1, 10, "2001-01-01", D("9")),
        (2, 99, "2000-06-01", D("5")), (3, 11, "2000-06-01", D("4")),
    ])
    r = frame(spark, [(10, 4), (11, 8)], "page int, rank int")
    got = relational.join_ordered(v, r, "2000-01-01", "2000-12-31")
    assert [tuple(x) for x in got.collect()] == [(1, 6.0, D("4.00")), (3, 8.0, D("4.00"))]
    assert [x["source"] for x in relational.join_top1(v, r, "2000-01-01", "2000-12-31").collect()] == [1]


def test_join_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "v")
    visits(spark, []).write.parquet(path)
    r = frame(spark, [(10, 4)], "page int, rank int")
    joined = relational.join(spark.read.parquet(path), r, "2000-01-01", "2000-12-31")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan and "LessThanOrEqual(date" in plan


def test_wordcount(spark):
    df = frame(spark, [("A  b\ta",), (" b ",), ("",), (None,)], "text string")
    assert rows(relational.wordcount(df, "text")) == [("a", 2), ("b", 2)]


def test_scan_reads_only_its_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select("id", F.lit("x").alias("a"), F.lit("y").alias("b")).write.parquet(path)
    got = relational.scan(spark.read.parquet(path), ["a"], F.col("id") > 7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 2 and "GreaterThan(id,7)" in plan and "b:string" not in plan


def test_aggregation_on_empty_and_null(spark):
    df = frame(spark, [(None, 1), (None, 2), ("a", None)], "k string, v int")
    assert rows(relational.aggregation(df, ["k"], [F.sum("v").alias("s")])) == [("a", None), (None, 3)]
    assert relational.aggregation(df.limit(0), ["k"], [F.sum("v").alias("s")]).count() == 0


def test_hot_keys_and_split_join(spark):
    data = [(0, i) for i in range(900)] + [(k, k) for k in range(1, 101)]
    right = frame(spark, data, "k int, v int")
    hot = skew.hot_keys(right, "k", max_hot=10, min_rows=50)
    assert rows(hot) == [(0, 9)]
    left = frame(spark, [(k, -k) for k in range(0, 101, 2)], "k int, w int")
    split = skew.split_rows(right, "k", hot, ["v"])
    assert split.where("k = 0").select("_part").distinct().count() == 9
    joined = skew.copy_rows(left, "k", hot).join(split, skew.join_keys("k", hot))
    assert rows(joined.select("k", "w", "v")) == rows(left.join(right, "k"))
    assert skew.hot_keys(right, "k") is None  # nothing here is worth a split by default
