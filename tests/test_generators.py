from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gaugework import lineage
from gaugework.operators import generators
from gaugework.plans.generators import GENERATORS
from gaugework.sources.lookups import WORKLOAD_SIZES
from helpers import rows


@pytest.mark.parametrize("name", sorted(GENERATORS))
def test_rows_do_not_depend_on_partitions(spark, name):
    one, four, many = (rows(GENERATORS[name][0](generators.id_range(spark, 40, n))) for n in (1, 4, 64))
    assert one == four == many and len(one) >= 38


def test_label_follows_the_weights(spark):
    df = generators.gen_labeled_points(generators.id_range(spark, 3000, 4), 3, label_noise=0.1, intercept=2.0)
    weights = spark.range(3).select(generators.true_weight(F.col("id").cast("int")).alias("w")).collect()
    dot = sum(F.get("features", F.lit(i)) * r["w"] for i, r in enumerate(weights)) + 2.0
    mean, spread = df.select((F.col("label") - dot).alias("e")).agg(F.avg("e"), F.stddev("e")).first()
    assert mean == pytest.approx(0, abs=0.02) and spread == pytest.approx(0.1, rel=0.1)
    mean, spread = df.select(F.explode("features").alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert mean == pytest.approx(0, abs=0.05) and spread == pytest.approx(1, rel=0.05)


def test_mixed_table_kinds(spark):
    df = generators.gen_mixed_table(generators.id_range(spark, 1000, 4), 8, bins=32)
    distinct = [df.select(F.get("features", F.lit(i))).distinct().count() for i in range(8)]
    assert distinct[:4] == [2, 2, 32, 32] and min(distinct[4:]) == 1000


def test_shapes(spark):
    ids = generators.id_range(spark, 500, 4)
    graph = generators.gen_graph(ids, 500, degree=10, centers=5)
    assert graph.where("src = dst OR pmod(src, 5) <> pmod(dst, 5) OR dst >= 500").count() == 0
    assert 4000 < graph.count() <= 5000
    assert generators.gen_documents(ids, 100, 30).where(F.size("words") == 30).count() == 500
    sizes = generators.gen_baskets(ids, 10_000, 10).agg(F.avg(F.size("items")), F.max(F.size("items"))).first()
    assert sizes[0] == pytest.approx(10, abs=1) and sizes[1] <= 19
    sequence = generators.gen_sequences(ids, 1000, 6, 3).agg(F.avg(F.size("sequence"))).first()[0]
    assert sequence == pytest.approx(6, abs=0.6)
    assert generators.gen_matrix_entries(ids, 7).count() == 3500
    ratings = generators.gen_ratings(ids, 50, 20).agg(F.min("rating"), F.max("rating"), F.max("user"), F.max("item")).first()
    assert 1 <= ratings[0] < ratings[1] <= 5 and ratings[2] < 50 and ratings[3] < 20


@pytest.mark.parametrize("kind", ["rankings", "visits", "lines", "records", "links"])
def test_suite_inputs(spark, kind):
    assert generators.gen_suite_dataset(generators.id_range(spark, 100), kind, 20).count() == 100
    assert generators.suite_input(spark, kind, "small", 4).rdd.getNumPartitions() == 4


def test_unknown_suite_inputs(spark):
    with pytest.raises(ValueError):
        generators.gen_suite_dataset(spark.range(1), "nope", 1)
    with pytest.raises(KeyError):
        generators.suite_input(spark, "links", "nope")


@pytest.mark.parametrize("workload", sorted(WORKLOAD_SIZES))
def test_every_workload_has_an_input(spark, workload):
    made = generators.workload_input(spark, workload, "warmup", 64)
    for df in made if isinstance(made, tuple) else (made,):
        assert len(df.limit(2).collect()) == 2


class Session:
    """Stands for a session with the given settings and master."""

    def __init__(self, settings, master):
        self.conf, self.sparkContext, self.master = settings, self, master

    def getCheckpointDir(self):
        return None


def test_checkpoints_use_the_folder_of_the_session():
    assert lineage.shared_folder(Session({lineage.SETTING: "hdfs://x/y/"}, "yarn")) == "hdfs://x/y"
    with pytest.raises(RuntimeError, match=lineage.SETTING):
        lineage.shared_folder(Session({}, "yarn"))  # never a machine-local folder on a cluster


def test_cut_lineage(spark):
    cut = lineage.cut_lineage(spark.range(10, numPartitions=3).withColumn("x", F.col("id") * 2))
    assert "Range" not in cut._jdf.queryExecution().optimizedPlan().toString()
    assert rows(cut) == [(i, 2 * i) for i in range(10)]
    assert lineage.scratch_path(spark, "a") != lineage.scratch_path(spark, "a")
