"""Run a workload of the catalogue by name and size: make its input, run its operator, give the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.operators import bayes, embedding, factors, generators, graph, learning, matrix, patterns, quasi_newton, relational, spectral, statistics, trees, wide_matrix
from gaugework.session import shuffle_partitions
from gaugework.sources.lookups import workload_parameters


def _columns(df: DataFrame, array: str, width: int) -> DataFrame:
    return df.select("id", *[F.get(array, F.lit(i)).alias(f"c{i}") for i in range(width)])


def _tree(p: dict, df: DataFrame) -> DataFrame:
    train, test = learning.train_test_split(df, ["id"], p["test-data-fraction"])
    if p["ensemble-type"] == "GradientBoostedTrees":
        model = learning.gradient_boosted_tree(train, p["num-trees"], p["tree-depth"], p["max-bins"])
    else:
        model = learning.random_forest(
            train, ["id"], p["num-trees"], p["tree-depth"], p["max-bins"], p["label-type"], bootstrap=p["num-trees"] > 1,
            subset=p["feature-subset-strategy"],
        )
    return trees.predict(test, model).select("id", "label", "prediction")


def run_workload(
    spark: SparkSession, workload: str, size: str, partitions: int | None = None, overrides: dict | None = None
) -> DataFrame:
    """One of the 23 statistics and ML workloads with the catalogue's parameters."""
    p = {**workload_parameters(workload, size), **(overrides or {})}
    data = generators.workload_input(spark, workload, size, partitions, overrides)
    if workload == "regression":
        if p["loss"] not in ("l2", "squared") or p["reg-type"] not in ("l2", "none"):
            raise ValueError(f"unknown loss {p['loss']!r} or regularisation {p['reg-type']!r}")
        if p["optimizer"] == "sgd":
            return learning.regression_sgd(data, iterations=p["num-iterations"], step=p["step-size"], reg=p["reg-param"])
        if p["optimizer"] not in ("l-bfgs", "lbfgs"):
            raise ValueError(f"unknown optimizer {p['optimizer']!r}")
        if p["elastic-net-param"]:
            raise ValueError("only the squares of the weights are held down")
        model = learning.regression(data, p["num-iterations"], p["reg-param"])
        return quasi_newton.predict(data, model).select("id", "label", "prediction")
    if workload == "classification":
        if p["optimizer"] == "sgd":
            return learning.classification_sgd(
                data, iterations=p["num-iterations"], step=p["step-size"], reg=p["reg-param"], loss=p["loss"], reg_type=p["reg-type"]
            )
        if p["optimizer"] not in ("l-bfgs", "lbfgs"):
            raise ValueError(f"unknown optimizer {p['optimizer']!r}")
        model = learning.classification(data, p["num-iterations"], p["reg-param"])
        return quasi_newton.predict(data, model).select("id", "label", "prediction")
    if workload == "naive-bayes":
        if p["model-type"] != "multinomial":
            raise ValueError(f"unknown model type {p['model-type']!r}")
        model = bayes.naive_bayes_array(data, "features", "label", float(p["nb-lambda"]))
        return bayes.naive_bayes_predict(data, model, "features").select("id", "label", "prediction")
    if workload in ("decision-tree", "random-forest", "gradient-boosted-tree"):
        return _tree(p, data)
    if workload == "als":
        return factors.als_predict(data, *factors.als(data, p["rank"], p["num-iterations"], p["reg-param"]))
    if workload == "kmeans":
        centres = learning.kmeans(data, "id", "features", p["num-centers"], p["num-iterations"])
        return learning.kmeans_assign(data, "features", centres).select("id", "center", F.col("centre").alias("prediction"))
    if workload == "gmm":
        model, _ = learning.gmm(data, "id", "features", p["num-centers"], p["num-iterations"])
        return learning.gmm_assign(data, "features", model).select("id", "center", "prediction")
    if workload == "lda":
        if p["optimizer"] != "em":
            raise ValueError(f"unknown optimizer {p['optimizer']!r}")
        return factors.describe_topics(factors.lda(data, ["id"], "words", p["num-topics"], p["num-iterations"], p["num-vocab"])[0])
    if workload == "pic":
        return spectral.power_iteration_clustering(data, p["num-centers"], p["num-iterations"])
    if workload == "svd":
        return wide_matrix.svd(data, "row", p["rank"])
    if workload == "pca":
        return wide_matrix.project(data, "row", wide_matrix.pca(data, "row", p["rank"])).select("id", "projected")
    if workload == "summary-statistics":
        return statistics.summary_statistics(data, "row")
    if workload == "pearson":
        return statistics.pearson(data, "row")
    if workload == "spearman":
        table = _columns(data, "row", p["num-cols"])
        return statistics.spearman(table, table.columns[1:], ["id"])
    if workload == "block-matrix-mult":
        return matrix.block_matrix_multiply(*data, p["block-size"])
    if workload == "chi-sq-feature":
        table = _columns(data, "features", p["num-cols"]).join(data.select("id", "label"), "id")
        return statistics.chi_square_feature(table, [f"c{i}" for i in range(p["num-cols"])], "label")
    if workload == "chi-sq-gof":
        return statistics.chi_square_gof(data, "label")
    if workload == "chi-sq-mat":
        return statistics.chi_square_matrix(data.withColumn("row", F.get("features", F.lit(0))), "row", "label")
    if workload == "word2vec":
        return embedding.word2vec(data, "words", p["vector-size"], p["min-count"], p["num-iterations"])
    if workload == "fp-growth":
        return patterns.fp_growth(data, "items", p["min-support"]).freqItemsets
    return patterns.prefix_span(data, "sequence", p["min-support"], p["max-pattern-len"], p["max-local-proj-db-size"])


def run_suite(spark: SparkSession, app: str, rows: int, partitions: int | None = None) -> DataFrame:
    """One of the suite's record, web and graph workloads on ``rows`` made records; the suite's ML
    workloads are those of :func:`run_workload`."""
    ids, pages = generators.id_range(spark, rows, partitions), max(rows // 10, 1)

    def made(kind: str) -> DataFrame:
        return generators.gen_suite_dataset(ids, kind, pages)

    if app == "scan":
        return relational.scan(made("visits"), ["source", "page", "date", "revenue"])
    if app == "aggregation":
        return relational.aggregation(made("visits"), ["source"], [F.sum("revenue").alias("revenue")])
    if app == "join":
        rankings = generators.gen_suite_dataset(generators.id_range(spark, pages, partitions), "rankings", pages)
        return relational.join_ordered(made("visits"), rankings, "2001-01-01", "2003-12-31")
    if app == "wordcount":
        return relational.wordcount(made("lines"), "value")
    if app == "sort":
        return relational.sort(made("records"), ["key"])
    if app == "terasort":
        return relational.terasort(made("records"), ["key"], partitions or shuffle_partitions(spark))
    if app == "pagerank":
        return graph.pagerank(made("links"))
    if app == "nutchindexing":
        documents = generators.gen_sentences(ids, pages).withColumn("text", F.array_join("words", " "))
        return graph.inverted_index(documents, "id", "text")
    if app == "nweight":
        return graph.n_hop_weight(generators.gen_graph(ids, rows), hops=3)
    raise ValueError(f"unknown suite workload {app!r}")
