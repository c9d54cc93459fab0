from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from gaugework.llm import exact_dedup

EDGE = [(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "A b"), (6, "a b "), (6, "a b "), (7, "x" * 300_000), (8, "x" * 300_000), (None, "a b"), (None, "z")]


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edges(documents):
    found = exact_dedup.find_copies(documents(EDGE))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected(EDGE)


def test_hot_group_and_small_buckets(documents):
    rows = [(i, "copy") for i in range(400)] + [(1000 + i, f"text {i // 2}") for i in range(600)]
    found = exact_dedup.find_copies(documents(rows), capacity=4)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected(rows)


def test_directory_splits_only_overfull_buckets(spark, documents):
    rows = [(i, f"text {i}") for i in range(500)]
    keys, index = exact_dedup.build_index(documents(rows), capacity=8)
    sizes = [r["count"] for r in index.groupBy("depth", "bucket").count().collect()]
    assert max(sizes) <= 8 and sum(sizes) == 500
    assert index.select("depth").distinct().count() > 1
    parents = index.select("depth", F.expr("shiftright(bucket, 1)").alias("up")).groupBy("depth", "up").count()
    assert parents.where("count > 8").count() > 0


def test_empty_table_and_clashing_columns(spark, documents):
    assert exact_dedup.find_copies(documents([])).count() == 0
    assert exact_dedup.drop_copies(documents([])).count() == 0
    extra = documents([(1, "a"), (2, "a"), (3, "b")]).withColumn("key", F.lit("k")).withColumn("keep_id", F.lit(9))
    left = exact_dedup.drop_copies(extra)
    assert sorted(r.doc_id for r in left.collect()) == [2, 3]
    assert left.columns == extra.columns


def test_one_of_rows_that_repeat_id_and_text_stays(documents):
    rows = [*EDGE, (9, "c"), (9, "d"), (10, None), (10, "")] + [(None, "crowd")] * 50 + [(11, "again")] * 50
    left = [(r.doc_id, r.text or "") for r in exact_dedup.drop_copies(documents(rows)).collect()]
    keep = {}
    for i, t in rows:
        keep[t or ""] = max((x for x in (i, keep.get(t or "")) if x is not None), default=None)
    assert sorted(left, key=repr) == sorted(((i, t) for t, i in keep.items()), key=repr)
