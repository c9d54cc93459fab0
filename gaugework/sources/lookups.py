"""Fixed lookup tables of the workload catalogue, as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Memory in MB used for sizing, by instance type.
INSTANCE_MEMORY = {
    "c3.large": 4096, "c3.xlarge": 8192, "c3.2xlarge": 16384,
    "c4.large": 4096, "c4.xlarge": 8192, "c4.2xlarge": 16384,
    "m3.large": 8192, "m3.xlarge": 16384, "m3.2xlarge": 32768,
    "m4.large": 8192, "m4.xlarge": 16384, "m4.2xlarge": 32768,
    "r3.large": 16384, "r3.xlarge": 32768, "r3.2xlarge": 65536,
    "r4.large": 16384, "r4.xlarge": 32768, "r4.2xlarge": 65536,
    "t2.large": 8192, "t2.xlarge": 16384, "t2.2xlarge": 32768,
}

# Fallback price in dollars per hour, by instance type.
INSTANCE_PRICE = {
    "c3.large": 0.032, "c3.xlarge": 0.086, "c3.2xlarge": 0.212,
    "c4.large": 0.045, "c4.xlarge": 0.092, "c4.2xlarge": 0.17,
    "m3.large": 0.061, "m3.xlarge": 0.12, "m3.2xlarge": 0.26,
    "m4.large": 0.044, "m4.xlarge": 0.105, "m4.2xlarge": 0.205,
    "r3.large": 0.061, "r3.xlarge": 0.081, "r3.2xlarge": 0.328,
    "r4.large": 0.062, "r4.xlarge": 0.12, "r4.2xlarge": 0.26,
}

# Cores are not part of the catalogue; these are the published counts of the three shapes.
SHAPE_CORES = {"large": 2, "xlarge": 4, "2xlarge": 8}

# Category by workload.
WORKLOAD_CATEGORY = {
    "wordcount": "micro", "terasort": "micro", "sort": "micro", "sleep": "micro", "dfsioe": "micro",
    "pagerank": "websearch", "nutchindexing": "websearch",
    "kmeans": "ml", "bayes": "ml", "lr": "ml", "als": "ml",
    "scan": "sql", "aggregation": "sql", "join": "sql",
    "nweight": "graph",
}

# Deployments of the distributed study as (workers, shape).
DEPLOYMENTS = [
    (4, "large"), (4, "xlarge"), (4, "2xlarge"),
    (6, "large"), (6, "xlarge"), (6, "2xlarge"),
    (8, "large"), (8, "xlarge"), (8, "2xlarge"),
    (10, "large"), (10, "xlarge"), (10, "2xlarge"),
    (12, "large"), (12, "xlarge"), (12, "2xlarge"),
    (16, "large"), (16, "xlarge"),
    (24, "large"), (20, "xlarge"),
    (32, "large"), (24, "xlarge"),
    (40, "large"),
    (48, "large"),
]

# Parameters common to the statistics and ML workloads.
COMMON_PARAMETERS = {"num-trials": 1, "inter-trial-wait": 1, "random-seed": 5}

_TREE = {
    "label-type": 0, "frac-categorical-features": 0.5, "frac-binary-features": 0.5, "max-bins": 32,
    "test-data-fraction": 0.2, "feature-subset-strategy": "auto",
}

# Default parameters by workload.
WORKLOAD_PARAMETERS = {
    "regression": {
        "num-iterations": 20, "feature-noise": 1.0, "step-size": 0.001, "reg-type": "l2", "reg-param": 0.1,
        "elastic-net-param": 0.0, "optimizer": "sgd", "intercept": 0.0, "label-noise": 0.1, "loss": "l2",
    },
    "classification": {
        "num-iterations": 20, "feature-noise": 1.0, "step-size": 0.001, "reg-type": "l2", "reg-param": 0.1,
        "elastic-net-param": 0.0, "optimizer": "sgd", "loss": "logistic", "per-negative": 0.3,
    },
    "naive-bayes": {"feature-noise": 1, "per-negative": 0.3, "nb-lambda": 1, "model-type": "multinomial"},
    "decision-tree": {**_TREE, "ensemble-type": "RandomForest", "tree-depth": 10, "num-trees": 1},
    "random-forest": {**_TREE, "ensemble-type": "RandomForest", "tree-depth": 10, "num-trees": 10},
    "gradient-boosted-tree": {**_TREE, "ensemble-type": "GradientBoostedTrees", "tree-depth": 5, "num-trees": 10},
    "als": {"num-iterations": 10, "reg-param": 0.1, "rank": 10},
    "kmeans": {"num-iterations": 20, "num-centers": 20},
    "gmm": {"num-iterations": 20, "num-centers": 20},
    "lda": {"optimizer": "em", "num-iterations": 40, "num-topics": 20, "document-length": 100},
    "pic": {"num-iterations": 20, "num-centers": 40, "node-degree": 20},
    "svd": {"rank": 10},
    "pca": {"rank": 50},
    "summary-statistics": {"rank": 50},
    "block-matrix-mult": {"block-size": 1024},
    "pearson": {},
    "spearman": {},
    "chi-sq-feature": {},
    "chi-sq-gof": {},
    "chi-sq-mat": {},
    "word2vec": {"num-iterations": 10, "vector-size": 100, "min-count": 5},
    "fp-growth": {"min-support": 0.01},
    "prefix-span": {
        "min-support": 0.5, "max-local-proj-db-size": 32000000, "avg-sequence-size": 50, "avg-itemset-size": 50,
        "max-pattern-len": 10,
    },
}

# Data size parameters by workload; the names, then one tuple per size.
WORKLOAD_SIZES = {
    "regression": (("num-examples", "num-features"), {
        "warmup": (1000, 100), "small": (50000, 10000), "medium": (100000, 10000), "large": (100000, 10000),
        "huge": (500000, 25000), "bigdata": (1000000, 50000)}),
    "classification": (("num-examples", "num-features"), {
        "warmup": (1000, 100), "small": (20000, 10000), "medium": (40000, 10000), "large": (80000, 10000)}),
    "naive-bayes": (("num-examples", "num-features"), {
        "warmup": (10000, 1000), "small": (100000, 10000), "medium": (200000, 10000), "large": (400000, 10000),
        "huge": (1000000, 25000), "bigdata": (1000000, 50000)}),
    "decision-tree": (("num-examples", "num-features"), {
        "warmup": (100000, 100), "small": (200000, 200), "medium": (400000, 200), "large": (800000, 200)}),
    "random-forest": (("num-examples", "num-features"), {
        "warmup": (100000, 100), "small": (400000, 100), "medium": (600000, 100), "large": (800000, 100)}),
    "gradient-boosted-tree": (("num-examples", "num-features"), {
        "warmup": (10000, 100), "small": (10000, 100), "medium": (20000, 100), "large": (800000, 100)}),
    "als": (("num-users", "num-products", "num-rating"), {
        "warmup": (10000, 10000, 10000), "small": (100000, 500000, 1000000),
        "medium": (100000, 500000, 1500000), "large": (200000, 500000, 2000000)}),
    "kmeans": (("num-examples", "num-features"), {
        "warmup": (1000, 100), "small": (10000, 10000), "medium": (25000, 10000), "large": (50000, 10000),
        "huge": (1000000, 10000), "bigdata": (2000000, 10000)}),
    "gmm": (("num-examples", "num-features"), {
        "warmup": (50000, 100), "small": (100000, 100), "medium": (200000, 100), "large": (200000, 200)}),
    "lda": (("num-documents", "num-vocab"), {
        "warmup": (2500, 1000), "small": (10000, 10000), "medium": (15000, 10000), "large": (20000, 10000)}),
    "pic": (("num-examples",), {"warmup": (1000,), "small": (50000,), "medium": (100000,), "large": (150000,)}),
    "svd": (("num-rows", "num-cols"), {
        "warmup": (50000, 500), "small": (100000, 500), "medium": (200000, 500), "large": (400000, 500)}),
    "pca": (("num-rows", "num-cols"), {
        "warmup": (50000, 1000), "small": (100000, 1000), "medium": (200000, 1000), "large": (400000, 1000)}),
    "summary-statistics": (("num-rows", "num-cols"), {
        "warmup": (50000, 500), "small": (100000, 1000), "medium": (200000, 2000), "large": (500000, 5000)}),
    "block-matrix-mult": (("m", "k", "n"), {
        "warmup": (1000, 10000, 10000), "small": (4000, 10000, 4000), "medium": (4000, 10000, 10000),
        "large": (5000, 5000, 5000)}),
    "pearson": (("num-rows", "num-cols"), {
        "warmup": (50000, 500), "small": (100000, 1000), "medium": (200000, 1500), "large": (200000, 2000)}),
    "spearman": (("num-rows", "num-cols"), {
        "warmup": (50000, 100), "small": (40000, 200), "medium": (80000, 200), "large": (60000, 200)}),
    "chi-sq-feature": (("num-rows", "num-cols"), {
        "warmup": (100000, 500), "small": (500000, 1000), "medium": (1000000, 1000), "large": (2000000, 1000),
        "huge": (10000000, 1000)}),
    "chi-sq-gof": (("num-rows", "num-cols"), {
        "warmup": (2500000, 0), "small": (5000000, 0), "medium": (1000000, 0), "large": (10000000, 0)}),
    "chi-sq-mat": (("num-rows", "num-cols"), {
        "warmup": (1000, 10), "small": (100000, 0), "medium": (200000, 0), "large": (5000, 0)}),
    "word2vec": (("num-sentences", "num-words"), {
        "warmup": (50000, 10000), "small": (100000, 10000), "medium": (200000, 10000), "large": (400000, 10000),
        "huge": (1000000, 100000)}),
    "fp-growth": (("num-baskets", "num-items", "avg-basket-size"), {
        "warmup": (1000, 100, 10), "small": (40000, 1000, 10), "medium": (60000, 1000, 10),
        "large": (80000, 1000, 10)}),
    "prefix-span": (("num-items", "num-sequences"), {
        "warmup": (500, 250000), "small": (10000, 500000), "medium": (20000, 500000), "large": (40000, 500000)}),
}


def size_parameters(workload: str, size: str) -> dict[str, int]:
    names, sizes = WORKLOAD_SIZES[workload]
    if size not in sizes:
        raise KeyError(f"{workload} has no size {size!r}, only {sorted(sizes)}")
    return dict(zip(names, sizes[size]))


def workload_parameters(workload: str, size: str, partitions: int = 1) -> dict[str, object]:
    """Common parameters, overlaid by those of the workload, then by those of the size."""
    return {
        **COMMON_PARAMETERS,
        "num-partitions": partitions,
        **WORKLOAD_PARAMETERS[workload],
        **size_parameters(workload, size),
    }


def instance_cores(instance: str) -> int:
    return SHAPE_CORES[instance.split(".")[1]]


def _text(parameters: dict) -> dict[str, str]:
    return {name: str(value) for name, value in parameters.items()}


def lookup_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """All lookup tables; each has a few dozen rows, fixed in this module, so broadcasting them is safe."""
    sizes = [(w, size, _text(size_parameters(w, size))) for w, (_, by_size) in WORKLOAD_SIZES.items() for size in by_size]
    return {
        "instances": spark.createDataFrame(
            [(i, mb, instance_cores(i)) for i, mb in INSTANCE_MEMORY.items()],
            "instance_type string, memory_mb int, cores int",
        ),
        "prices": spark.createDataFrame(list(INSTANCE_PRICE.items()), "instance_type string, price double"),
        "categories": spark.createDataFrame(list(WORKLOAD_CATEGORY.items()), "workload string, category string"),
        "parameters": spark.createDataFrame(
            [(w, _text(p)) for w, p in WORKLOAD_PARAMETERS.items()], "workload string, params map<string,string>"
        ),
        "sizes": spark.createDataFrame(sizes, "workload string, size string, params map<string,string>"),
        "deployments": spark.createDataFrame(DEPLOYMENTS, "nodes int, shape string"),
    }
