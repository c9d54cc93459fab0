"""Generators with one row (basket, document, ...) per order, so that their work grows with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.operators import generators
from gaugework.plans.registry import query
from gaugework.sources.tables import load


def ids(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))


def by_place(df: DataFrame, array: str) -> DataFrame:
    """A row for each entry of a numeric array, doubles to nine digits."""
    rest = [F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes if c != array]
    long = df.select(*rest, F.posexplode(array).alias("place", "value"))
    return long.withColumn("value", F.round("value", 9)) if dict(long.dtypes)["value"] == "double" else long


def joined(df: DataFrame, array: str) -> DataFrame:
    """An array of words as one text."""
    return df.withColumn(array, F.array_join(array, " "))


# The same draws in SQL. IDS has one row per order, {n}-fold forms one per entry.

IDS = "(SELECT o_orderkey AS id FROM orders)"


def draw(*what: str) -> str:
    parts = ", ".join(f"({w})::VARCHAR" for w in what)
    return f"('0x' || substr(md5(concat_ws(':', {parts}, '5')), 1, 13))::BIGINT"


def uniform(*what: str) -> str:
    return f"({draw(*what)} / 4503599627370496.0::DOUBLE)"


def normal(*what: str) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {uniform(*what, chr(39) + 'radius' + chr(39))})) * cos(2 * pi() * {uniform(*what, chr(39) + 'angle' + chr(39))}))"


def word(count: int, *what: str) -> str:
    u = uniform(*what)
    return f"'w' || floor({u} * {u} * {count})::BIGINT::VARCHAR"


def entries(n: int | str) -> str:
    """A row per order and place below ``n``."""
    return f"(SELECT id, unnest(range({n})) AS j FROM {IDS})"


WEIGHT = normal("j", "'weight'")
X = normal("id", "'x'", "j")


def words_sql(count: int, length: int | str, name: str = "words", distinct: bool = False, kind: str = "word") -> str:
    drawn = f"SELECT id, j, {word(count, 'id', chr(39) + kind + chr(39), 'j')} AS word FROM {entries(length)}"
    if distinct:
        drawn = f"SELECT id, word, min(j) AS j FROM ({drawn}) GROUP BY id, word"
    return f"SELECT id, string_agg(word, ' ' ORDER BY j) AS {name} FROM ({drawn}) GROUP BY id"


PAGE = "floor({0} * {0} * 1000)::BIGINT"
EDGES = f"""
SELECT DISTINCT src, own + 40 * CASE WHEN own + 40 * drawn = src THEN (drawn + 1) % here ELSE drawn END AS dst
FROM (SELECT id, src, own, here, floor({uniform("id", "'dst'", "j")} * here)::BIGINT AS drawn
      FROM (SELECT id, id % 1000 AS src, id % 1000 % 40 AS own, (999 - id % 1000 % 40) // 40 + 1 AS here, unnest(range(20)) AS j FROM {IDS}))"""

GENERATORS = {
    "gen_labeled_points": (
        lambda i: by_place(generators.gen_labeled_points(i, 8), "features"),
        f"""SELECT id, j::INTEGER AS place, round(x, 9) AS value,
  round(sum(x * w) OVER (PARTITION BY id) + {normal("id", "'label'")} * 0.1, 9) AS label
FROM (SELECT id, j, {X} AS x, {WEIGHT} AS w FROM {entries(8)})""",
    ),
    "gen_classification_points": (
        lambda i: by_place(generators.gen_classification_points(i, 8), "features"),
        f"""SELECT id, j::INTEGER AS place, round({X} + label * {WEIGHT}, 9) AS value, label
FROM (SELECT *, CASE WHEN {uniform("id", "'label'")} < 0.3 THEN 0.0 ELSE 1.0 END::DOUBLE AS label FROM {entries(8)})""",
    ),
    "gen_mixed_table": (
        lambda i: by_place(generators.gen_mixed_table(i, 8), "features"),
        f"""SELECT id, j::INTEGER AS place, round(x, 9) AS value, round(sum(x * w) OVER (PARTITION BY id), 9) AS label
FROM (SELECT id, j, {WEIGHT} AS w, CASE WHEN j < 2 THEN ({draw("id", "'x'", "j")} % 2)::DOUBLE
  WHEN j < 4 THEN ({draw("id", "'x'", "j")} % 32)::DOUBLE ELSE {X} END AS x FROM {entries(8)})""",
    ),
    "gen_ratings": (
        lambda i: generators.gen_ratings(i, 1000, 200).withColumn("rating", F.col("rating").cast("int")),
        f"""SELECT "user", item, (1 + floor(({uniform('"user"', "'taste'")} + {uniform("item", "'taste'")}) * 2.5))::INTEGER AS rating
FROM (SELECT ({draw("id", "'user'")} % 1000)::INTEGER AS "user", ({draw("id", "'item'")} % 200)::INTEGER AS item FROM {IDS})""",
    ),
    "gen_cluster_points": (
        lambda i: by_place(generators.gen_cluster_points(i, 8), "features"),
        f"""SELECT id, center, j::INTEGER AS place, round({uniform("center", "'center'", "j")} + {X} * 0.1, 9) AS value
FROM (SELECT *, (id % 20)::INTEGER AS center FROM {entries(8)})""",
    ),
    "gen_documents": (lambda i: joined(generators.gen_documents(i, 1000), "words"), words_sql(1000, 100)),
    "gen_graph": (
        lambda i: generators.gen_graph(i, 1000).withColumn("weight", F.round("weight", 9)),
        f"""SELECT src, dst, round({uniform("src", "dst", "'weight'")}, 9) AS weight FROM ({EDGES}) WHERE src <> dst""",
    ),
    "gen_matrix": (
        lambda i: by_place(generators.gen_matrix(i, 16), "row"),
        f"""SELECT id, j::INTEGER AS place, round({normal("id", "'m'", "j")}, 9) AS value FROM {entries(16)}""",
    ),
    "gen_chi_square_data": (
        lambda i: by_place(generators.gen_chi_square_data(i, 8), "features"),
        f"""SELECT id, label, j::INTEGER AS place, CASE WHEN j = 0 AND id % 2 = 0 THEN label ELSE {draw("id", "'x'", "j")} % 10 END::INTEGER AS value
FROM (SELECT *, ({draw("id", "'label'")} % 10)::INTEGER AS label FROM {entries(8)})""",
    ),
    "gen_sentences": (
        lambda i: joined(generators.gen_sentences(i, 1000), "words"),
        words_sql(1000, f"1 + {draw('id', chr(39) + 'length' + chr(39))} % 39"),
    ),
    "gen_baskets": (
        lambda i: joined(generators.gen_baskets(i, 100), "items"),
        words_sql(100, f"1 + {draw('id', chr(39) + 'size' + chr(39))} % 19", "items", distinct=True, kind="item"),
    ),
    "gen_sequences": (
        lambda i: generators.gen_sequences(i, 100, 5, 3).withColumn(
            "sequence", F.array_join(F.transform("sequence", lambda s: F.array_join(s, " ")), " > ")
        ),
        f"""SELECT id, string_agg(items, ' > ' ORDER BY p) AS sequence FROM (
  SELECT id, p, string_agg(word, ' ' ORDER BY j) AS items FROM (
    SELECT id, p, word, min(j) AS j FROM (
      SELECT id, p, j, {word(100, "id", "'item'", "p", "j")} AS word
      FROM (SELECT id, p, unnest(range(1 + {draw("id", "'set'", "p")} % 5)) AS j
            FROM (SELECT id, unnest(range(1 + {draw("id", "'length'")} % 9)) AS p FROM {IDS})))
    GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY id""",
    ),
    "gen_suite_dataset": (
        lambda i: generators.gen_suite_dataset(i, "visits", 1000),
        f"""SELECT {draw("id", "'source'")} % 100 AS source, {PAGE.format(uniform("id", "'page'"))} AS page,
  (DATE '2000-01-01' + ({draw("id", "'date'")} % 3650)::INTEGER)::TIMESTAMP AS date,
  (({draw("id", "'revenue'")} % 100000) / 100)::DECIMAL(18, 2) AS revenue FROM {IDS}""",
    ),
    "gen_suite_rankings": (
        lambda i: generators.gen_suite_dataset(i, "rankings", 1000),
        f"""SELECT id AS page, (1 + {draw("id", "'rank'")} % 100)::INTEGER AS rank FROM {IDS}""",
    ),
    "gen_suite_lines": (
        lambda i: generators.gen_suite_dataset(i, "lines", 1000),
        f"SELECT words AS value FROM ({words_sql(1000, '1 + ' + draw('id', chr(39) + 'length' + chr(39)) + ' % 19')})",
    ),
    "gen_suite_records": (
        lambda i: generators.gen_suite_dataset(i, "records", 1000),
        f"SELECT substr(md5(id::VARCHAR), 1, 10) AS key, md5(id::VARCHAR || 'v') AS value FROM {IDS}",
    ),
    "gen_suite_links": (
        lambda i: generators.gen_suite_dataset(i, "links", 1000),
        f"""SELECT {draw("id", "'src'")} % 1000 AS src, {PAGE.format(uniform("id", "'dst'"))} AS dst FROM {IDS}""",
    ),
}


def _register(name: str) -> None:
    made, sql = GENERATORS[name]
    query(name, sql)(lambda spark, sf: made(ids(spark, sf)))


for _name in GENERATORS:
    _register(_name)
