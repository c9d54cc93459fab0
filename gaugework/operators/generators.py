"""Seeded inputs of the workloads, computed from row ids.

Every value follows from the md5 of the id, the name of the draw and the seed, so a row does not depend on the
partitioning and a lost partition is made again as it was. ``ids`` is a DataFrame with a BIGINT ``id``:
a range from :func:`id_range`, or the keys of any table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.sources.lookups import workload_parameters

SEED = 5
_DIGITS = 13
_STEPS = 1 << 4 * _DIGITS  # whole numbers that a double holds exactly


def id_range(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    return spark.range(0, n, 1, partitions) if partitions else spark.range(n)


def draw(*what: Column, seed: int = SEED) -> Column:
    """A whole number of 52 bits from the md5 of the given columns and names, which any engine can repeat."""
    digest = F.md5(F.concat_ws(":", *[w.cast("string") for w in what], F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("bigint")


def uniform(*what: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) for the given columns and names."""
    return draw(*what, seed=seed) / F.lit(float(_STEPS))


def whole(below: int, *what: Column, seed: int = SEED) -> Column:
    """An integer in [0, below)."""
    return draw(*what, seed=seed) % F.lit(below)


def normal(*what: Column, seed: int = SEED) -> Column:
    """A standard normal number from two uniform ones."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(*what, F.lit("radius"), seed=seed)))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(*what, F.lit("angle"), seed=seed))


def each(n: int | Column, value) -> Column:
    """An array of ``value(j)`` for j = 0..n-1; ``n`` is at least 1."""
    last = F.lit(n - 1) if isinstance(n, int) else n - 1
    return F.transform(F.sequence(F.lit(0), last.cast("int")), value)


def gen_labeled_points(
    ids: DataFrame, features: int, feature_noise: float = 1.0, label_noise: float = 0.1, intercept: float = 0.0,
    seed: int = SEED,
) -> DataFrame:
    """``(id, features, label)`` with a label linear in the features plus noise; see :func:`true_weight`."""
    points = ids.select("id", each(features, lambda j: normal(F.col("id"), F.lit("x"), j, seed=seed) * feature_noise).alias("features"))
    weighted = F.zip_with("features", each(features, lambda j: true_weight(j, seed)), lambda x, w: x * w)
    noise = normal(F.col("id"), F.lit("label"), seed=seed) * label_noise
    return points.withColumn("label", F.aggregate(weighted, F.lit(float(intercept)), lambda a, x: a + x) + noise)


def true_weight(j: Column, seed: int = SEED) -> Column:
    """Weight of feature ``j`` in :func:`gen_labeled_points`."""
    return normal(j, F.lit("weight"), seed=seed)


def gen_classification_points(
    ids: DataFrame, features: int, per_negative: float = 0.3, feature_noise: float = 1.0, seed: int = SEED
) -> DataFrame:
    """``(id, features, label)`` with label 0 for the negative share; features are shifted by the label."""
    label = F.when(uniform(F.col("id"), F.lit("label"), seed=seed) < per_negative, 0.0).otherwise(1.0)

    def feature(j: Column) -> Column:
        return normal(F.col("id"), F.lit("x"), j, seed=seed) * feature_noise + F.col("label") * true_weight(j, seed)

    return ids.select("id", label.alias("label")).select("id", each(features, feature).alias("features"), "label")


def gen_mixed_table(
    ids: DataFrame, features: int, categorical: float = 0.5, binary: float = 0.5, bins: int = 32, label_type: int = 0,
    seed: int = SEED,
) -> DataFrame:
    """``(id, features, label)``: the first features are binary, then come those of ``bins`` categories,
    then the numeric ones. The label is a number for type 0 and one of ``label_type`` classes otherwise."""
    n_categorical = int(features * categorical)
    n_binary = int(n_categorical * binary)
    id = F.col("id")

    def feature(j: Column) -> Column:
        return (
            F.when(j < n_binary, whole(2, id, F.lit("x"), j, seed=seed).cast("double"))
            .when(j < n_categorical, whole(bins, id, F.lit("x"), j, seed=seed).cast("double"))
            .otherwise(normal(id, F.lit("x"), j, seed=seed))
        )

    points = ids.select("id", each(features, feature).alias("features"))
    scaled = F.zip_with("features", each(features, lambda j: true_weight(j, seed)), lambda x, w: x * w)
    score = F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x)
    label = score if label_type < 2 else F.pmod(F.floor(score), F.lit(label_type)).cast("double")
    return points.withColumn("label", label)


def gen_ratings(ids: DataFrame, users: int, products: int, seed: int = SEED) -> DataFrame:
    """``(user, item, rating)`` with ratings 1 to 5 that follow a taste of the user and of the item."""
    user, item = whole(users, F.col("id"), F.lit("user"), seed=seed), whole(products, F.col("id"), F.lit("item"), seed=seed)
    drawn = ids.select(user.cast("int").alias("user"), item.cast("int").alias("item"))
    taste = uniform(F.col("user"), F.lit("taste"), seed=seed) + uniform(F.col("item"), F.lit("taste"), seed=seed)
    return drawn.withColumn("rating", (F.lit(1) + F.floor(taste * 2.5)).cast("float"))


def gen_cluster_points(ids: DataFrame, features: int, centers: int = 20, noise: float = 0.1, seed: int = SEED) -> DataFrame:
    """``(id, center, features)`` around ``centers`` points of the unit cube, dealt out by id."""
    dealt = ids.select("id", F.pmod("id", F.lit(centers)).cast("int").alias("center"))

    def feature(j: Column) -> Column:
        at = uniform(F.col("center"), F.lit("center"), j, seed=seed)
        return at + normal(F.col("id"), F.lit("x"), j, seed=seed) * noise

    return dealt.withColumn("features", each(features, feature))


def _words(n: int | Column, vocabulary: int, *what: Column, seed: int) -> Column:
    """An array of ``n`` words; low word numbers are the frequent ones. All are drawn first: a draw is named twice in its word."""
    drawn = each(n, lambda j: uniform(*what, j, seed=seed))
    return F.transform(drawn, lambda u: F.concat(F.lit("w"), F.floor(u * u * vocabulary).cast("string")))


def gen_documents(ids: DataFrame, vocabulary: int, length: int = 100, seed: int = SEED) -> DataFrame:
    """``(id, words)`` with ``length`` words each."""
    return ids.select("id", _words(length, vocabulary, F.col("id"), F.lit("word"), seed=seed).alias("words"))


def gen_sentences(ids: DataFrame, words: int, mean_length: int = 20, seed: int = SEED) -> DataFrame:
    """``(id, words)`` with 1 to twice the mean length less one words."""
    length = F.lit(1) + whole(2 * mean_length - 1, F.col("id"), F.lit("length"), seed=seed)
    return ids.select("id", _words(length, words, F.col("id"), F.lit("word"), seed=seed).alias("words"))


def gen_graph(ids: DataFrame, vertices: int, degree: int = 20, centers: int = 40, seed: int = SEED) -> DataFrame:
    """``(src, dst, weight)``: ``degree`` draws per id among the vertices of its centre. Ids are taken modulo
    ``vertices``, so sources and targets lie below it; a draw of the vertex itself becomes the next of its centre. Every
    centre has at least two vertices where there are two."""
    centers = max(1, min(centers, vertices // 2))
    src = F.pmod("id", F.lit(vertices))
    own = F.pmod(src, F.lit(centers))
    # vertices of a centre: own, own + centers, ... below the number of vertices
    in_center = F.floor((F.lit(vertices - 1) - own) / centers) + 1

    def target(j: Column) -> Column:
        drawn = F.floor(uniform(F.col("id"), F.lit("dst"), j, seed=seed) * in_center)
        place = F.when(own + F.lit(centers) * drawn == src, F.pmod(drawn + 1, in_center)).otherwise(drawn)
        return (own + F.lit(centers) * place).cast("bigint")

    edges = ids.select(src.alias("src"), F.explode(F.array_distinct(each(degree, target))).alias("dst")).distinct()
    weight = uniform(F.col("src"), F.col("dst"), F.lit("weight"), seed=seed)
    return edges.where(F.col("src") != F.col("dst")).withColumn("weight", weight)


def gen_matrix(ids: DataFrame, columns: int, seed: int = SEED) -> DataFrame:
    """``(id, row)`` with normal entries."""
    return ids.select("id", each(columns, lambda j: normal(F.col("id"), F.lit("m"), j, seed=seed)).alias("row"))


def gen_matrix_entries(ids: DataFrame, columns: int, names: tuple[str, str] = ("i", "k"), seed: int = SEED) -> DataFrame:
    """The same matrix in coordinates, ``(i, k, value)``."""
    rows = gen_matrix(ids, columns, seed).select(F.col("id").alias(names[0]), F.posexplode("row").alias(names[1], "value"))
    return rows.withColumn(names[1], F.col(names[1]).cast("bigint"))


def gen_chi_square_data(ids: DataFrame, columns: int, categories: int = 10, seed: int = SEED) -> DataFrame:
    """``(id, features, label)`` of category numbers; the first feature follows the label, the others do not."""
    label = whole(categories, F.col("id"), F.lit("label"), seed=seed)

    def feature(j: Column) -> Column:
        free = whole(categories, F.col("id"), F.lit("x"), j, seed=seed)
        return F.when((j == 0) & (F.pmod("id", F.lit(2)) == 0), label).otherwise(free).cast("int")

    return ids.select("id", each(columns, feature).alias("features"), label.cast("int").alias("label"))


def gen_baskets(ids: DataFrame, items: int, mean_size: int = 10, seed: int = SEED) -> DataFrame:
    """``(id, items)``: distinct items, drawn 1 to twice the mean less one times."""
    size = F.lit(1) + whole(2 * mean_size - 1, F.col("id"), F.lit("size"), seed=seed)
    drawn = _words(size, items, F.col("id"), F.lit("item"), seed=seed)
    return ids.select("id", F.array_distinct(drawn).alias("items"))


def gen_sequences(
    ids: DataFrame, items: int, mean_sequence: int = 50, mean_itemset: int = 50, seed: int = SEED
) -> DataFrame:
    """``(id, sequence)`` of itemsets with distinct items; both sizes vary around their means."""
    id = F.col("id")

    def itemset(p: Column) -> Column:
        size = F.lit(1) + whole(2 * mean_itemset - 1, id, F.lit("set"), p, seed=seed)
        return F.array_distinct(_words(size, items, id, F.lit("item"), p, seed=seed))

    length = F.lit(1) + whole(2 * mean_sequence - 1, id, F.lit("length"), seed=seed)
    return ids.select("id", each(length, itemset).alias("sequence"))


# Rows of the suite inputs by scale name: our own choice, powers of ten.
SUITE_ROWS = {"small": 10**5, "medium": 10**6, "large": 10**7, "huge": 10**8, "bigdata": 10**9}


def gen_suite_dataset(ids: DataFrame, kind: str, pages: int, seed: int = SEED) -> DataFrame:
    """The input of a suite workload: ``rankings``, ``visits``, ``lines``, ``records`` or ``links`` over
    ``pages`` pages. Low page numbers are visited and linked most."""
    id = F.col("id")

    def page(name: str) -> Column:
        drawn = uniform(id, F.lit(name), seed=seed)
        return F.floor(drawn * drawn * pages)

    if kind == "rankings":
        return ids.select(id.alias("page"), (F.lit(1) + whole(100, id, F.lit("rank"), seed=seed)).cast("int").alias("rank"))
    if kind == "visits":
        day = F.date_add(F.lit("2000-01-01").cast("date"), whole(3650, id, F.lit("date"), seed=seed).cast("int"))
        cents = whole(100000, id, F.lit("revenue"), seed=seed) / F.lit(100)
        return ids.select(
            whole(max(pages // 10, 1), id, F.lit("source"), seed=seed).alias("source"),
            page("page").alias("page"),
            day.cast("timestamp_ntz").alias("date"),
            cents.cast("decimal(18,2)").alias("revenue"),
        )
    if kind == "lines":
        return gen_sentences(ids, pages, 10, seed).select(F.array_join("words", " ").alias("value"))
    if kind == "records":
        return ids.select(F.substring(F.md5(id.cast("string")), 1, 10).alias("key"), F.md5(F.concat(id, F.lit("v"))).alias("value"))
    if kind == "links":
        return ids.select(whole(pages, id, F.lit("src"), seed=seed).alias("src"), page("dst").alias("dst"))
    raise ValueError(f"unknown suite dataset {kind!r}")


def suite_input(spark: SparkSession, kind: str, scale: str, partitions: int | None = None) -> DataFrame:
    """A suite input at a named scale."""
    if scale not in SUITE_ROWS:
        raise KeyError(f"unknown scale {scale!r}, only {list(SUITE_ROWS)}")
    rows = SUITE_ROWS[scale]
    return gen_suite_dataset(id_range(spark, rows, partitions), kind, pages=max(rows // 10, 1))


def workload_input(
    spark: SparkSession, workload: str, size: str, partitions: int | None = None, overrides: dict | None = None
):
    """The input of a statistics or ML workload at a size of the catalogue, with the catalogue's parameters
    and any that ``overrides`` replaces.

    Returns one DataFrame, or the two factors for the matrix product.
    """
    p = {**workload_parameters(workload, size), **(overrides or {})}

    def ids(name: str) -> DataFrame:
        return id_range(spark, p[name], partitions)

    seed = p["random-seed"]
    if workload == "regression":
        return gen_labeled_points(ids("num-examples"), p["num-features"], p["feature-noise"], p["label-noise"], p["intercept"], seed)
    if workload in ("classification", "naive-bayes"):
        points = gen_classification_points(ids("num-examples"), p["num-features"], p["per-negative"], p["feature-noise"], seed)
        if workload == "naive-bayes":  # the multinomial model takes no negative numbers
            points = points.withColumn("features", F.transform("features", F.abs))
        return points
    if workload in ("decision-tree", "random-forest", "gradient-boosted-tree"):
        return gen_mixed_table(
            ids("num-examples"), p["num-features"], p["frac-categorical-features"], p["frac-binary-features"],
            p["max-bins"], p["label-type"], seed,
        )
    if workload == "als":
        return gen_ratings(ids("num-rating"), p["num-users"], p["num-products"], seed)
    if workload in ("kmeans", "gmm"):
        return gen_cluster_points(ids("num-examples"), p["num-features"], p["num-centers"], seed=seed)
    if workload == "lda":
        return gen_documents(ids("num-documents"), p["num-vocab"], p["document-length"], seed)
    if workload == "pic":
        return gen_graph(ids("num-examples"), p["num-examples"], p["node-degree"], p["num-centers"], seed)
    if workload in ("svd", "pca", "summary-statistics", "pearson", "spearman"):
        return gen_matrix(ids("num-rows"), p["num-cols"], seed)
    if workload == "block-matrix-mult":
        return gen_matrix_entries(ids("m"), p["k"], ("i", "k"), seed), gen_matrix_entries(ids("k"), p["n"], ("k", "j"), seed + 1)
    if workload in ("chi-sq-feature", "chi-sq-gof", "chi-sq-mat"):
        return gen_chi_square_data(ids("num-rows"), max(p["num-cols"], 1), seed=seed)
    if workload == "word2vec":
        return gen_sentences(ids("num-sentences"), p["num-words"], seed=seed)
    if workload == "fp-growth":
        return gen_baskets(ids("num-baskets"), p["num-items"], p["avg-basket-size"], seed)
    return gen_sequences(ids("num-sequences"), p["num-items"], p["avg-sequence-size"], p["avg-itemset-size"], seed)
