"""Model workloads on order lines, embeddings, documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.functions.numbers import seven_digits
from gaugework.functions.text import tokens
from gaugework.operators import bayes, embedding, factors, learning, matrix, patterns, quasi_newton, spectral
from gaugework.plans.graph import trade_links
from gaugework.plans.registry import query
from gaugework.sources.tables import load

PREDICTORS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
LINE = ["l_orderkey", "l_linenumber"]


def examples(spark: SparkSession, sf: str, label: F.Column) -> DataFrame:
    """Order lines with four features (line number as the category) and a label."""
    features = F.array(*[F.col(c).cast("double") for c in PREDICTORS])
    return load(spark, sf, "lineitem").select(*LINE, features.alias("features"), label.cast("double").alias("label"))


def is_returned() -> F.Column:
    return F.when(F.col("l_returnflag") == "R", 1).otherwise(0)


def scored(model: quasi_newton.Linear, rows: DataFrame) -> DataFrame:
    return quasi_newton.predict(rows, model).select(*LINE, "label", F.round("prediction", 3).alias("prediction"))


def solve_sql(name: str, start: str, d: int) -> str:
    """Tables that solve the equations in ``start (a_0_0 ... a_0_d, a_1_0 ...)``, column d the right side, into ``{name} (x_0 ...)``."""
    tables, at = [], start
    for p in range(d):
        columns = [f"a_{i}_{j}" for i in range(p + 1) for j in range(i, d + 1)]
        columns += [f"a_{i}_{j} - a_{i}_{p} / a_{p}_{p} * a_{p}_{j} AS a_{i}_{j}" for i in range(p + 1, d) for j in range(p + 1, d + 1)]
        tables.append(f"{name}_e{p} AS MATERIALIZED (SELECT {', '.join(columns)} FROM {at})")
        at = f"{name}_e{p}"
    for i in reversed(range(d)):
        rest = "".join(f" - a_{i}_{j} * x_{j}" for j in range(i + 1, d))
        tables.append(f"{name}_b{i} AS MATERIALIZED (SELECT *, (a_{i}_{d}{rest}) / a_{i}_{i} AS x_{i} FROM {at})")
        at = f"{name}_b{i}"
    return ", ".join([*tables, f"{name} AS MATERIALIZED (SELECT {', '.join(f'x_{i}' for i in range(d))} FROM {at})"])


def standard_sql(label: str) -> str:
    z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS z{k}" for k, c in enumerate(PREDICTORS))
    return f"z AS MATERIALIZED (SELECT l_orderkey, l_linenumber, {label} AS y, {z}, 1.0::DOUBLE AS z{len(PREDICTORS)} FROM lineitem)"


def ridge_sql(label: str, reg: float) -> str:
    d = len(PREDICTORS)
    cells = ", ".join(f"avg(z{i} * {f'z{j}' if j <= d else 'y'}){f' + {reg}' if i == j < d else ''} AS a_{i}_{j}" for i in range(d + 1) for j in range(d + 2))
    fitted = " + ".join(f"x_{k} * z{k}" for k in range(d + 1))
    return f"""
WITH {standard_sql(label)}, sums AS (SELECT {cells} FROM z), {solve_sql("w", "sums", d + 1)}
SELECT l_orderkey, l_linenumber, y AS label, round({fitted}, 3) AS prediction FROM z, w
"""


def newton_sql(label: str, reg: float, rounds: int) -> str:
    """Newton's rounds to the least loss, which is the only one."""
    d = len(PREDICTORS)
    tables = [standard_sql(label), f"w0 AS (SELECT {', '.join(f'0.0::DOUBLE AS x_{k}' for k in range(d + 1))})"]
    margin = " + ".join(f"x_{k} * z{k}" for k in range(d + 1))
    for t in range(rounds):
        held = [f"{reg} * any_value(x_{i})" if i < d else "0" for i in range(d + 1)]
        cells = [
            f"avg(p * (1 - p) * z{i} * z{j}){f' + {reg}' if i == j < d else ''} AS a_{i}_{j}" if j <= d else f"avg((y - p) * z{i}) - {held[i]} AS a_{i}_{j}"
            for i in range(d + 1) for j in range(d + 2)
        ]
        tables.append(f"s{t} AS (SELECT {', '.join(cells)} FROM (SELECT *, 1 / (1 + exp(-({margin}))) AS p FROM z, w{t}))")
        tables.append(solve_sql(f"d{t}", f"s{t}", d + 1))
        tables.append(f"w{t + 1} AS MATERIALIZED (SELECT {', '.join(f'w{t}.x_{k} + d{t}.x_{k} AS x_{k}' for k in range(d + 1))} FROM w{t}, d{t})")
    return f"""
WITH {", ".join(tables)}
SELECT l_orderkey, l_linenumber, y AS label, ({margin} > 0)::INTEGER::DOUBLE AS prediction FROM z, w{rounds}
"""


@query("regression", ridge_sql("l_extendedprice", 0.1))
def regression(spark, sf):
    rows = examples(spark, sf, F.col("l_extendedprice"))
    return scored(learning.regression(rows), rows)


@query(
    "regression_line",
    """
SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept FROM lineitem
""",
)
def regression_line(spark, sf):
    line = learning.regression_line(load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return line.select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query(
    "regression_sgd",
    """
WITH RECURSIVE sums AS (
  SELECT count(*) AS n, sum(q * q) AS qq, sum(q * t) AS qt, sum(t * t) AS tt, sum(q * y) AS qy, sum(t * y) AS ty, sum(y * y) AS yy
  FROM (SELECT l_quantity / 50 AS q, l_tax * 10 AS t, l_extendedprice / 100000 AS y FROM lineitem)),
steps AS (
  SELECT 1 AS t, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b
  UNION ALL
  SELECT t + 1, a - 0.001 / sqrt(t) * ((qq * a + qt * b - qy) / n + 0.1 * a),
         b - 0.001 / sqrt(t) * ((qt * a + tt * b - ty) / n + 0.1 * b)
  FROM steps, sums WHERE t <= 20)
SELECT t, round((qq * a * a + 2 * qt * a * b + tt * b * b - 2 * a * qy - 2 * b * ty + yy) / n / 2
                + 0.05 * (a * a + b * b), 9) AS loss,
       round(a, 9) AS w_quantity, round(b, 9) AS w_tax
FROM steps, sums
""",
)
def regression_sgd(spark, sf):
    rows = load(spark, sf, "lineitem").select(
        F.array(F.col("l_quantity") / 50, F.col("l_tax") * 10).alias("features"),
        (F.col("l_extendedprice") / 100000).alias("label"),
    )
    return learning.regression_sgd(rows).select(
        "t",
        F.round("loss", 9).alias("loss"),
        F.round(F.get("weights", F.lit(0)), 9).alias("w_quantity"),
        F.round(F.get("weights", F.lit(1)), 9).alias("w_tax"),
    )


@query(
    "classification_sgd",
    """
WITH RECURSIVE x AS (SELECT l_quantity / 50 AS q, l_tax * 10 AS t, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem),
steps AS (
  SELECT 1 AS t, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b
  UNION ALL
  SELECT any_value(s.t) + 1,
         any_value(s.a) - 1.0 / sqrt(any_value(s.t)) * (avg((1 / (1 + exp(-(s.a * q + s.b * x.t))) - y) * q) + 0.1 * any_value(s.a)),
         any_value(s.b) - 1.0 / sqrt(any_value(s.t)) * (avg((1 / (1 + exp(-(s.a * q + s.b * x.t))) - y) * x.t) + 0.1 * any_value(s.b))
  FROM steps s CROSS JOIN x WHERE s.t <= 20 GROUP BY s.t)
SELECT t, round(a, 9) AS w_quantity, round(b, 9) AS w_tax FROM steps
""",
)
def classification_sgd(spark, sf):
    rows = load(spark, sf, "lineitem").select(
        F.array(F.col("l_quantity") / 50, F.col("l_tax") * 10).alias("features"), is_returned().cast("double").alias("label")
    )
    weight = lambda k: F.round(F.get("weights", F.lit(k)), 9)
    return learning.classification_sgd(rows).select("t", weight(0).alias("w_quantity"), weight(1).alias("w_tax"))


@query("classification", newton_sql("(l_returnflag = 'R')::INTEGER::DOUBLE", 0.1, 8))
def classification(spark, sf):
    rows = examples(spark, sf, is_returned())
    return scored(learning.classification(rows), rows)


@query("logistic_regression", newton_sql("(l_extendedprice > 50000)::INTEGER::DOUBLE", 0.0, 14))
def logistic_regression(spark, sf):
    rows = examples(spark, sf, F.col("l_extendedprice") > 50000)
    return scored(learning.logistic_regression(rows), rows)


@query(
    "naive_bayes",
    "\nUNION ALL ".join(
        f"""SELECT l_returnflag AS label, '{f}' AS feature,
  CAST(CAST(ln(count(*) / (SELECT count(*) FROM lineitem)) AS FLOAT) AS DOUBLE) AS log_prior,
  CAST(CAST(ln((sum({f}) + 1) / (sum(l_quantity) + sum(l_discount) + sum(l_tax) + sum(l_linenumber) + 4)) AS FLOAT) AS DOUBLE) AS log_p
FROM lineitem GROUP BY 1"""
        for f in PREDICTORS
    ),
)
def naive_bayes(spark, sf):
    model = bayes.naive_bayes(load(spark, sf, "lineitem"), PREDICTORS, "l_returnflag")
    return model.withColumns({c: seven_digits(F.col(c)) for c in ["log_prior", "log_p"]})


@query(
    "naive_bayes_array",
    """
WITH cells AS (
  SELECT label, generate_subscripts(embedding, 1) - 1 AS feature, abs(unnest(embedding)::DOUBLE) AS v FROM embeddings WHERE label IS NOT NULL),
sums AS (SELECT label, feature, sum(v) AS s FROM cells GROUP BY 1, 2),
labels AS (SELECT label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY 1)
SELECT label, feature::INTEGER AS feature, round(ln(n / (SELECT sum(n) FROM labels)), 9) AS log_prior,
       round(ln((s + 1) / (sum(s) OVER (PARTITION BY label) + count(*) OVER (PARTITION BY label))), 9) AS log_p
FROM sums JOIN labels USING (label)
""",
)
def naive_bayes_array(spark, sf):
    """Sizes of the embeddings' entries by their label, from one array column."""
    vectors = load(spark, sf, "embeddings").select("label", F.transform("embedding", F.abs).alias("sizes"))
    model = bayes.naive_bayes_array(vectors, "sizes", "label")
    found = model.select("label", "first", F.round("log_prior", 9).alias("log_prior"), F.posexplode("log_p").alias("at", "log_p"))
    return found.select("label", (F.col("first") + F.col("at")).alias("feature"), "log_prior", F.round("log_p", 9).alias("log_p"))


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    documents = load(spark, sf, "documents").select("doc_id", "text")
    return documents.join(load(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


WORD_SQL = r"""
counts AS (
  SELECT label, word, count(*) AS n
  FROM (SELECT quality AS label, unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents JOIN labels USING (doc_id))
  WHERE word <> '' GROUP BY 1, 2),
totals AS (SELECT label, sum(n) + (SELECT count(DISTINCT word) FROM counts) AS total FROM counts GROUP BY 1)
"""


@query(
    "text_bayes",
    f"WITH {WORD_SQL} SELECT label, word, n, round(ln((n + 1) / total), 6) AS log_p FROM counts JOIN totals USING (label)",
)
def text_bayes(spark, sf):
    model = bayes.text_bayes(labelled_documents(spark, sf), "text", "quality")
    return model.withColumn("log_p", F.round("log_p", 6))


@query(
    "text_bayes_labels",
    f"""
WITH {WORD_SQL}, docs AS (SELECT quality AS label, count(*) AS docs FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT label, docs, round(ln(docs / (SELECT sum(docs) FROM docs)), 6) AS log_prior, round(ln(1 / total), 6) AS log_p_unseen
FROM docs JOIN totals USING (label)
""",
)
def text_bayes_labels(spark, sf):
    table = bayes.text_bayes_labels(labelled_documents(spark, sf), "text", "quality")
    return table.withColumns({c: F.round(c, 6) for c in ["log_prior", "log_p_unseen"]})


@query(
    "text_bayes_score",
    rf"""
WITH {WORD_SQL}, docs AS (SELECT quality AS label, count(*) AS docs FROM documents JOIN labels USING (doc_id) GROUP BY 1),
priors AS (SELECT label, total, ln(docs / (SELECT sum(docs) FROM docs)) AS log_prior FROM docs JOIN totals USING (label)),
vocabulary AS (SELECT DISTINCT word FROM counts),
seen AS (
  SELECT doc_id, word, count(*) AS tf
  FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents)
  WHERE word IN (SELECT word FROM vocabulary) GROUP BY 1, 2)
SELECT d.doc_id AS doc, p.label, round(any_value(log_prior) + coalesce(sum(tf * ln((coalesce(n, 0) + 1) / total)), 0), 4) AS score
FROM documents d CROSS JOIN priors p LEFT JOIN seen s ON s.doc_id = d.doc_id
LEFT JOIN counts c ON c.label = p.label AND c.word = s.word GROUP BY 1, 2
""",
)
def text_bayes_score(spark, sf):
    train = labelled_documents(spark, sf)
    model, labels = bayes.text_bayes(train, "text", "quality"), bayes.text_bayes_labels(train, "text", "quality")
    docs = load(spark, sf, "documents").select("doc_id", "text")
    return bayes.text_bayes_score(model, labels, docs, "doc_id", "text").withColumn("score", F.round("score", 4))


HELD_OUT = "('0x' || substr(md5({}::VARCHAR || ' 5'), 1, 12))::BIGINT % 1000000 < 200000"


@query(
    "text_bayes_predict",
    rf"""
WITH train AS (SELECT doc_id, text, quality FROM documents JOIN labels USING (doc_id) WHERE NOT {HELD_OUT.format("doc_id")}),
test AS (SELECT doc_id, text, quality FROM documents JOIN labels USING (doc_id) WHERE {HELD_OUT.format("doc_id")}),
{WORD_SQL.replace("documents JOIN labels USING (doc_id)", "train")},
docs AS (SELECT quality AS label, count(*) AS docs FROM train GROUP BY 1),
priors AS (SELECT label, total, ln(docs / (SELECT sum(docs) FROM docs)) AS log_prior FROM docs JOIN totals USING (label)),
vocabulary AS (SELECT DISTINCT word FROM counts),
seen AS (
  SELECT doc_id, word, count(*) AS tf
  FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM test)
  WHERE word IN (SELECT word FROM vocabulary) GROUP BY 1, 2),
scores AS (
  SELECT d.doc_id, d.quality, p.label, any_value(log_prior) + coalesce(sum(tf * ln((coalesce(n, 0) + 1) / total)), 0) AS score
  FROM test d CROSS JOIN priors p LEFT JOIN seen s ON s.doc_id = d.doc_id
  LEFT JOIN counts c ON c.label = p.label AND c.word = s.word GROUP BY 1, 2, 3)
SELECT doc_id, quality, label AS prediction FROM scores
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, label) = 1
""",
)
def text_bayes_predict(spark, sf):
    train, test = learning.train_test_split(labelled_documents(spark, sf), ["doc_id"])
    return bayes.text_bayes_predict(train, test, "doc_id", "text", "quality").select("doc_id", "quality", "prediction")


@query(
    "train_test_split",
    f"SELECT o_orderkey, CASE WHEN {HELD_OUT.format('o_orderkey')} THEN 'test' ELSE 'train' END AS part FROM orders",
)
def train_test_split(spark, sf):
    train, test = learning.train_test_split(load(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])
    return train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Mean quantity that a customer takes from a supplier."""
    lines = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_quantity")
    return (
        load(spark, sf, "orders")
        .select("o_orderkey", "o_custkey")
        .join(lines, "o_orderkey")
        .groupBy(F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("item"))
        .agg(F.avg("l_quantity").alias("rating"))
    )


@query("als")
def als(spark, sf):
    """Held-out pairs, predicted by ten factors after ten rounds."""
    train, test = learning.train_test_split(ratings(spark, sf), ["user", "item"])
    return factors.als_predict(test, *factors.als(train))


def two_factors_sql(rounds: int, reg: float = 0.1) -> str:
    def start(side: str, key: str) -> str:
        draw = lambda j: f"('0x' || substr(md5('{side}:' || {key}::VARCHAR || ':{j}'), 1, 12))::BIGINT / 281474976710656 / sqrt(2)"
        return f"SELECT DISTINCT {key} AS id, {draw(0)} AS x, {draw(1)} AS y FROM r"

    def half(own: str, other: str, vectors: str) -> str:
        return f"""SELECT id, (d * e - b * f) / (a * d - b * b) AS x, (a * f - b * e) / (a * d - b * b) AS y FROM (
    SELECT r.{own} AS id, sum(x * x) + {reg} * count(*) AS a, sum(x * y) AS b, sum(y * y) + {reg} * count(*) AS d,
           sum(rating * x) AS e, sum(rating * y) AS f FROM r JOIN {vectors} v ON r.{other} = v.id GROUP BY 1)"""

    tables = [f"u0 AS MATERIALIZED ({start('user', 'user')})"]
    for t in range(rounds):
        tables.append(f"i{t + 1} AS MATERIALIZED ({half('item', 'user', f'u{t}')})")
        tables.append(f"u{t + 1} AS MATERIALIZED ({half('user', 'item', f'i{t + 1}')})")
    return f"""
WITH r AS MATERIALIZED (
  SELECT o_custkey AS "user", l_suppkey AS item, avg(l_quantity) AS rating FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
{", ".join(tables)}
SELECT r.user AS "user", r.item AS item, round(u.x * i.x + u.y * i.y, 6) AS prediction
FROM r JOIN u{rounds} u ON u.id = r.user JOIN i{rounds} i ON i.id = r.item
"""


@query("als_two_factors", two_factors_sql(2).replace("r.user", 'r."user"').replace("DISTINCT user", 'DISTINCT "user"').replace("|| user::", '|| "user"::'))
def als_two_factors(spark, sf):
    """All pairs, predicted by two factors after two rounds."""
    pairs = ratings(spark, sf)
    found = factors.als_predict(pairs, *factors.als(pairs, rank=2, iterations=2))
    return found.select("user", "item", F.round("prediction", 6).alias("prediction"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").select("vec_id", "embedding")


K, ROUNDS = 20, 20


def lloyd_sql(rounds: int) -> str:
    """The rounds one after another; each takes the nearest centre of every point, then the means."""
    first = f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS i, embedding::DOUBLE[] AS c FROM embeddings
  ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT {K})"""

    def near(t: int) -> str:
        return f"""a{t} AS MATERIALIZED (
  SELECT vec_id, CAST(arg_min(i, (d, i)) AS INTEGER) AS i FROM (
    SELECT vec_id, i, list_sum([(p[1] - p[2]) ** 2 FOR p IN list_zip(embedding::DOUBLE[], c)]) AS d FROM embeddings CROSS JOIN c{t})
  GROUP BY 1)"""

    def mean(t: int) -> str:
        return f"""m{t} AS MATERIALIZED (
  SELECT i, list(m ORDER BY place) AS c FROM (
    SELECT i, place, avg(v) AS m FROM (
      SELECT a.i, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS place FROM a{t} a JOIN embeddings USING (vec_id))
    GROUP BY 1, 2) GROUP BY 1),
c{t + 1} AS MATERIALIZED (SELECT c{t}.i, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (i))"""

    steps = ",\n".join(f"{near(t)},\n{mean(t)}" for t in range(rounds))
    return f"WITH {first},\n{steps},\n{near(rounds)}\nSELECT vec_id, i AS prediction FROM a{rounds}"


@query("kmeans", lloyd_sql(ROUNDS))
def kmeans(spark, sf):
    rows = points(spark, sf)
    centres = learning.kmeans(rows, "vec_id", "embedding", K, ROUNDS)
    return learning.kmeans_assign(rows, "embedding", centres).select("vec_id", F.col("centre").alias("prediction"))


@query(
    "kmeans_assign",
    f"""
WITH centres AS (SELECT embedding::DOUBLE[] AS c, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings ORDER BY vec_id LIMIT {K}),
distances AS (
  SELECT vec_id, i, list_sum([(p[1] - p[2]) ** 2 FOR p IN list_zip(embedding::DOUBLE[], c)]) AS d FROM embeddings CROSS JOIN centres)
SELECT vec_id, CAST(arg_min(i, (d, i)) AS INTEGER) AS centre, round(min(d), 6) AS distance FROM distances GROUP BY 1
""",
)
def kmeans_assign(spark, sf):
    vectors = load(spark, sf, "embeddings").select("vec_id", "embedding")
    first = [row["embedding"] for row in vectors.orderBy("vec_id").limit(K).collect()]  # k starting centres
    return learning.kmeans_assign(vectors, "embedding", first).select(
        "vec_id", "centre", F.round("distance", 6).alias("distance")
    )


@query("gmm")
def gmm(spark, sf):
    rows = points(spark, sf)
    model, _ = learning.gmm(rows, "vec_id", "embedding", K, ROUNDS)
    return learning.gmm_assign(rows, "embedding", model).select("vec_id", "prediction")


def spoken(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").select("conv_id", "turn", tokens(F.col("text")).alias("words"))


@query("lda")
def lda(spark, sf):
    return factors.lda(spoken(spark, sf), ["conv_id", "turn"], "words")[0]


@query(
    "lda_vocabulary",
    r"""
SELECT word, CAST(count(*) AS DOUBLE) AS n
FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM conversations) WHERE word <> '' GROUP BY word
""",
)
def lda_vocabulary(spark, sf):
    """Every word that the topics are fitted on, with its count over all turns."""
    _, words = factors.word_counts(spoken(spark, sf), ["conv_id", "turn"], "words")
    return words.select("word", F.col("n").cast("double").alias("n"))


def topics_sql(topics: int, rounds: int, alpha: float, eta: float) -> str:
    tables = []
    for t in range(rounds):
        theta = f"SELECT doc, k, (n + {alpha - 1}) / (sum(n) OVER (PARTITION BY doc) + {topics * (alpha - 1)}) AS theta FROM d{t}"
        phi = f"SELECT word, k, (n + {eta - 1}) / (sum(n) OVER (PARTITION BY k) + size * {eta - 1}) AS phi FROM w{t}, size"
        tables.append(f"""
g{t} AS MATERIALIZED (
  SELECT doc, word, k, c * theta * phi / sum(theta * phi) OVER (PARTITION BY doc, word) AS n
  FROM counts JOIN ({theta}) USING (doc) JOIN ({phi}) USING (word, k)),
w{t + 1} AS MATERIALIZED (SELECT word, k, sum(n) AS n FROM g{t} GROUP BY 1, 2),
d{t + 1} AS MATERIALIZED (SELECT doc, k, sum(n) AS n FROM g{t} GROUP BY 1, 2)""")
    draw = "0.5 + ('0x' || substr(md5(word || ':' || k::VARCHAR), 1, 12))::BIGINT / 281474976710656"
    return rf"""
WITH counts AS MATERIALIZED (
  SELECT doc, word, count(*)::DOUBLE AS c
  FROM (SELECT item_id AS doc, unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM benchmark) WHERE word <> '' GROUP BY 1, 2),
size AS (SELECT count(DISTINCT word) AS size FROM counts),
u AS (SELECT word, k, {draw} AS u, n FROM (SELECT word, sum(c) AS n FROM counts GROUP BY 1), range({topics}) r(k)),
w0 AS MATERIALIZED (SELECT word, k, u * n / sum(u) OVER (PARTITION BY word) AS n FROM u),
d0 AS MATERIALIZED (SELECT doc, k, sum(c) / {topics} AS n FROM counts, range({topics}) r(k) GROUP BY 1, 2),{",".join(tables)}
SELECT k::INTEGER AS topic, word, round((n + {eta - 1}) / (sum(n) OVER (PARTITION BY k) + size * {eta - 1}), 9) AS weight FROM w{rounds}, size
"""


@query("lda_three_rounds", topics_sql(5, 3, 11.0, 1.1))
def lda_three_rounds(spark, sf):
    """Five topics of the benchmark items after three rounds."""
    items = load(spark, sf, "benchmark").select("item_id", tokens(F.col("text")).alias("words"))
    found, _ = factors.lda(items, ["item_id"], "words", topics=5, iterations=3)
    return found.select("topic", "word", F.round("weight", 9).alias("weight"))


def weighted_links(spark: SparkSession, sf: str) -> DataFrame:
    return trade_links(spark, sf).withColumn("weight", F.lit(1.0))


@query("power_iteration_clustering")
def power_iteration_clustering(spark, sf):
    return spectral.power_iteration_clustering(weighted_links(spark, sf))


def power_vector_sql(rounds: int) -> str:
    draw = "('0x' || substr(md5('power:' || id::VARCHAR), 1, 12))::BIGINT / 281474976710656"
    tables = "".join(
        f""",
s{t} AS MATERIALIZED (SELECT src AS id, sum(w / degree * v) AS v FROM b JOIN v{t} ON dst = id GROUP BY src),
v{t + 1} AS MATERIALIZED (SELECT id, v / sum(v) OVER () AS v FROM s{t})"""
        for t in range(rounds)
    )
    return f"""
WITH pairs AS (SELECT DISTINCT o_custkey * 2 AS a, l_suppkey * 2 + 1 AS b, 2.0::DOUBLE AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
b AS MATERIALIZED (
  SELECT *, sum(w) OVER (PARTITION BY src) AS degree FROM (SELECT a AS src, b AS dst, w FROM pairs UNION ALL SELECT b, a, w FROM pairs)),
v0 AS MATERIALIZED (SELECT id, {draw} / sum({draw}) OVER () AS v FROM (SELECT DISTINCT src AS id FROM b)){tables}
SELECT id, round(v * count(*) OVER (), 9) AS v FROM v{rounds}
"""


@query("power_iteration_vector", power_vector_sql(3))
def power_iteration_vector(spark, sf):
    """The vector after three rounds, times the number of nodes."""
    vector = spectral.power_vector(weighted_links(spark, sf), 3, acceleration=0.0)
    return vector.select("id", F.round(F.col("v") * F.lit(vector.count()), 9).alias("v"))


@query("word2vec")
def word2vec(spark, sf):
    found = embedding.word2vec(spoken(spark, sf), "words")
    return found.select("word", F.col("vector").cast("string").alias("vector"))


@query(
    "word2vec_vocabulary",
    r"""
SELECT word, count(*) AS n
FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM conversations)
WHERE word <> '' GROUP BY word HAVING count(*) >= 5
""",
)
def word2vec_vocabulary(spark, sf):
    return embedding.vocabulary(spoken(spark, sf), "words").select("word", "n")


def brand_baskets(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    brands = load(spark, sf, "part").select("p_partkey", "p_brand")
    return patterns.baskets(lines.join(brands, "p_partkey"), "l_orderkey", "p_brand")


@query(
    "fp_growth",
    """
WITH b AS (SELECT DISTINCT l_orderkey AS o, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey),
least AS (SELECT ceil(0.01 * count(DISTINCT o)) AS n FROM b)
SELECT i AS items, count(*) AS freq FROM b GROUP BY 1 HAVING count(*) >= (SELECT n FROM least)
UNION ALL
SELECT x.i || ',' || y.i, count(*) FROM b x JOIN b y ON x.o = y.o AND x.i < y.i GROUP BY 1 HAVING count(*) >= (SELECT n FROM least)
UNION ALL
SELECT x.i || ',' || y.i || ',' || z.i, count(*) FROM b x JOIN b y ON x.o = y.o AND x.i < y.i JOIN b z ON y.o = z.o AND y.i < z.i
GROUP BY 1 HAVING count(*) >= (SELECT n FROM least)
""",
)
def fp_growth(spark, sf):
    model = patterns.fp_growth(brand_baskets(spark, sf))
    return model.freqItemsets.select(F.array_join(F.sort_array("items"), ",").alias("items"), "freq")


@query(
    "fp_growth_rules",
    """
WITH b AS (SELECT DISTINCT l_orderkey AS o, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey),
baskets AS (SELECT count(DISTINCT o) AS n FROM b),
items AS (SELECT i, count(*) AS f FROM b GROUP BY 1),
pairs AS (SELECT x.i AS a, y.i AS c, count(*) AS f FROM b x JOIN b y ON x.o = y.o AND x.i <> y.i GROUP BY 1, 2),
triples AS (
  SELECT x.i AS a, y.i AS b, z.i AS c, count(*) AS f
  FROM b x JOIN b y ON x.o = y.o AND x.i < y.i JOIN b z ON y.o = z.o AND z.i <> x.i AND z.i <> y.i GROUP BY 1, 2, 3),
rules AS (
  SELECT a AS antecedent, c AS consequent, p.f AS f, x.f AS base FROM pairs p JOIN items x ON x.i = a
  UNION ALL
  SELECT t.a || ',' || t.b, t.c, t.f, p.f FROM triples t JOIN pairs p ON p.a = t.a AND p.c = t.b)
SELECT antecedent, consequent, round(r.f / base, 9) AS confidence, round((r.f / base) / (y.f / n), 9) AS lift,
       round(r.f / n, 9) AS support
FROM rules r JOIN items y ON y.i = consequent CROSS JOIN baskets
WHERE r.f >= ceil(0.01 * n) AND r.f / base >= 0.1
""",
)
def fp_growth_rules(spark, sf):
    rules = patterns.fp_growth(brand_baskets(spark, sf), min_confidence=0.1).associationRules
    sides = [F.array_join(F.sort_array(c), ",").alias(c) for c in ["antecedent", "consequent"]]
    return rules.select(*sides, *[F.round(c, 9).alias(c) for c in ["confidence", "lift", "support"]])


@query(
    "prefix_span",
    """
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS place, l_returnflag AS item FROM lineitem),
grown AS (
  SELECT o, place, item, item AS pattern FROM e
  UNION
  SELECT g.o, e.place, e.item, g.pattern || CASE WHEN e.place = g.place THEN '+' ELSE '>' END || e.item
  FROM grown g JOIN e ON g.o = e.o AND (e.place > g.place OR (e.place = g.place AND e.item > g.item)))
SELECT pattern, count(DISTINCT o) AS freq FROM grown GROUP BY 1
HAVING count(DISTINCT o) >= ceil(0.05 * (SELECT count(DISTINCT o) FROM e))
""",
)
def prefix_span(spark, sf):
    flags = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    places = patterns.sequences(flags, "l_orderkey", "l_linenumber", "l_returnflag")
    steps = F.transform("sequence", lambda s: F.array_join(F.sort_array(s), "+"))
    found = patterns.prefix_span(places, min_support=0.05)
    return found.select(F.array_join(steps, ">").alias("pattern"), F.col("freq"))
