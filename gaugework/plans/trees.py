"""Trees on order lines: the price in cents from quantity, discount, tax and line number, predicted for held-out lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.operators import learning, trees
from gaugework.plans.registry import query
from gaugework.sources.tables import load

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
KEY = ["l_orderkey", "l_linenumber"]
BINS = 32


def lines(spark: SparkSession, sf: str, label: F.Column) -> tuple[DataFrame, DataFrame]:
    table = load(spark, sf, "lineitem").select(*KEY, F.array(*[F.col(c).cast("double") for c in FEATURES]).alias("features"), label.cast("double").alias("label"))
    return learning.train_test_split(table, KEY)


def cents() -> F.Column:
    return F.round(F.col("l_extendedprice") * 100)


def base_sql(label: str, copies: int) -> str:
    """``a0``: every line with its bins, ``w`` of each tree (0 for held-out lines), and the tables of cuts that give the bins."""
    held = "('0x' || substr(md5(l_orderkey::VARCHAR || ' ' || l_linenumber::VARCHAR || ' 5'), 1, 12))::BIGINT % 1000000 < 200000"
    values = " UNION ALL ".join(f"SELECT {k} AS f, {c}::DOUBLE AS v FROM lines WHERE NOT held" for k, c in enumerate(FEATURES))
    lists = ", ".join(f"(SELECT coalesce(list(v), []) FROM cuts WHERE f = {k}) AS c{k}" for k in range(len(FEATURES)))
    bins = ", ".join(f"len([c FOR c IN c{k} IF c < {c}::DOUBLE]) AS b{k}" for k, c in enumerate(FEATURES))
    draw = "('0x' || substr(md5(l_orderkey::VARCHAR || ' ' || l_linenumber::VARCHAR || ':' || tree::VARCHAR), 1, 12))::BIGINT / 281474976710656"
    weight = " + ".join(f"({draw} >= {bar})::BIGINT" for bar in trees.DRAWS) if copies > 1 else "1"
    return f"""
lines AS MATERIALIZED (SELECT row_number() OVER () AS rid, *, {label} AS y, {held} AS held FROM lineitem),
counts AS (SELECT f, v, count(*) AS n FROM ({values}) GROUP BY 1, 2),
sums AS (
  SELECT f, v, sum(n) OVER (PARTITION BY f ORDER BY v) AS upto, sum(n) OVER (PARTITION BY f) AS total, count(*) OVER (PARTITION BY f) AS buckets,
         n, row_number() OVER (PARTITION BY f ORDER BY v DESC) AS back FROM counts),
cuts AS (SELECT f, v FROM sums WHERE back > 1 AND (buckets <= {BINS} OR upto * {BINS} // total > (upto - n) * {BINS} // total)),
lists AS (SELECT {lists}),
scale AS (
  SELECT 2.0 ** least(44 - ceil(log2(max(abs(y)))), 58 - ceil(log2(8 * count(*) + 1)) - ceil(log2(max(abs(y))))) AS scale
  FROM lines WHERE NOT held),
rows AS MATERIALIZED (
  SELECT rid, tree, y, held, CASE WHEN held THEN 0 ELSE {weight} END AS w, {bins}
  FROM lines, lists, range({copies}) t(tree))"""


def grow_sql(name: str, start: str, depth: int, some: int, classes: int = 0) -> str:
    """Tables ``{name}_1 ... {name}_depth`` over ``start (rid, tree, node, w, g..., b...)``: the node of each row, level by level."""
    width, goals = len(FEATURES), [f"g{c}" for c in range(max(classes, 1))]
    out = []
    for d in range(depth):
        at = start if d == 0 else f"{name}_{d}"
        spread = " UNION ALL ".join(
            f"SELECT tree, node, {k} AS f, b{k} AS b, w, {', '.join(goals)} FROM {at} WHERE w > 0 AND NOT done" for k in range(width)
        )
        left = ", ".join(f"sum({g}) OVER (PARTITION BY tree, node, f ORDER BY b)::BIGINT::DOUBLE AS l_{g}" for g in ["n", *goals])
        whole = ", ".join(f"sum({g}) OVER (PARTITION BY tree, node, f)::BIGINT::DOUBLE AS t_{g}" for g in ["n", *goals])
        part = " + ".join(
            f"(CASE WHEN abs(l_{g} * t_n - t_{g} * l_n) <= 1e-12 * (abs(l_{g}) * t_n + abs(t_{g}) * l_n) THEN 0 "
            f"ELSE (l_{g} * t_n - t_{g} * l_n) * (l_{g} * t_n - t_{g} * l_n) / (t_n * l_n * (t_n - l_n)) END)"
            for g in goals
        )
        allowed = "" if some >= width else (
            f"JOIN (SELECT tree, node, f FROM (SELECT DISTINCT tree, node FROM {name}_h{d}), range({width}) r(f) "
            f"QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY md5(tree::VARCHAR || ':' || node::VARCHAR || ':' || f::VARCHAR), f) <= {some}) "
            "USING (tree, node, f)"
        )
        out.append(f"""
{name}_h{d} AS MATERIALIZED (
  SELECT tree, node, f, b, sum(w) AS n, {", ".join(f"sum(w * {g})::BIGINT AS {g}" for g in goals)} FROM ({spread}) GROUP BY 1, 2, 3, 4),
{name}_c{d} AS MATERIALIZED (
  SELECT tree, node, f, b, gain FROM (
    SELECT tree, node, f, b, {part} AS gain
    FROM (SELECT tree, node, f, b, {left}, {whole} FROM {name}_h{d}) {allowed} WHERE l_n < t_n)
  WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, f, b) = 1),
{name}_{d + 1} AS MATERIALIZED (
  SELECT a.* EXCLUDE (node, done), a.done OR c.f IS NULL AS done,
    CASE WHEN a.done OR c.f IS NULL THEN node
      ELSE 2 * node + 1 + (CASE c.f {" ".join(f"WHEN {k} THEN b{k}" for k in range(width))} END > c.b)::INT END AS node
  FROM {at} a LEFT JOIN {name}_c{d} c USING (tree, node))""")
    return ",".join(out)


def value_sql(at: str, name: str = "g0", scale: str = "(SELECT scale FROM scale)") -> str:
    return f"SELECT tree, node, sum(w * {name})::BIGINT::DOUBLE / {scale} / sum(w) AS value FROM {at} WHERE w > 0 GROUP BY 1, 2"


def forest_sql(count: int, depth: int, some: int) -> str:
    return f"""
WITH {base_sql("round(l_extendedprice * 100)", count)},
start AS (SELECT *, 0 AS node, false AS done, round_even(y * scale, 0)::BIGINT AS g0 FROM rows, scale),{grow_sql("a", "start", depth, some)},
leaves AS ({value_sql(f"a_{depth}")}),
found AS (
  SELECT rid, list_sum(list(value ORDER BY tree)) / {count} AS prediction FROM a_{depth} JOIN leaves USING (tree, node) WHERE held GROUP BY rid)
SELECT l_orderkey, l_linenumber, y AS label, round(prediction, 3) AS prediction FROM lines JOIN found USING (rid)
"""


def boosted_sql(count: int, depth: int, step: float = 0.1) -> str:
    tables, before = [base_sql("round(l_extendedprice * 100)", 1), "f0 AS (SELECT *, 0.0::DOUBLE AS f FROM rows)"], "f0"
    for k in range(count):
        goal, weight = ("y", 1.0) if k == 0 else ("2.0 * (y - f)", step)
        tables.append(f"""
s{k} AS (SELECT * EXCLUDE (scale), 0 AS node, false AS done, round_even({goal} * scale, 0)::BIGINT AS g0 FROM {before}, scale),{grow_sql(f"a{k}", f"s{k}", depth, len(FEATURES))},
v{k} AS ({value_sql(f"a{k}_{depth}")}),
f{k + 1} AS MATERIALIZED (SELECT a.* EXCLUDE (node, done, g0, f), f + value * {weight} AS f FROM a{k}_{depth} a JOIN v{k} USING (tree, node))""")
        before = f"f{k + 1}"
    return f"WITH {','.join(tables)} SELECT l_orderkey, l_linenumber, lines.y AS label, round(f, 3) AS prediction FROM lines JOIN {before} USING (rid) WHERE lines.held"


def class_sql(depth: int, classes: int) -> str:
    goals = ", ".join(f"(y = {c})::BIGINT AS g{c}" for c in range(classes))
    counts = ", ".join(f"sum(w * g{c})" for c in range(classes))
    return f"""
WITH {base_sql("CASE l_returnflag WHEN 'R' THEN 2::DOUBLE WHEN 'N' THEN 1::DOUBLE ELSE 0::DOUBLE END", 1)},
start AS (SELECT *, 0 AS node, false AS done, {goals} FROM rows),{grow_sql("a", "start", depth, len(FEATURES), classes)},
leaves AS (SELECT tree, node, list_position([{counts}], greatest({counts})) - 1 AS value FROM a_{depth} WHERE w > 0 GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, lines.y AS label, value::DOUBLE AS prediction
FROM lines JOIN a_{depth} a USING (rid) JOIN leaves USING (tree, node) WHERE lines.held
"""


def scored(model: trees.Trees, test: DataFrame) -> DataFrame:
    return trees.predict(test, model).select(*KEY, "label", F.round("prediction", 3).alias("prediction"))


@query("decision_tree", forest_sql(1, 10, 4))
def decision_tree(spark, sf):
    train, test = lines(spark, sf, cents())
    return scored(learning.decision_tree(train, KEY), test)


@query("decision_tree_stump", forest_sql(1, 2, 4))
def decision_tree_stump(spark, sf):
    """The same at a depth of two."""
    train, test = lines(spark, sf, cents())
    return scored(learning.decision_tree(train, KEY, depth=2), test)


@query("decision_tree_classes", class_sql(6, 3))
def decision_tree_classes(spark, sf):
    """The return flag as one of three classes."""
    flag = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "N", 1).otherwise(0)
    train, test = lines(spark, sf, flag)
    return scored(learning.decision_tree(train, KEY, depth=6, label_type=3), test)


@query("random_forest", forest_sql(10, 10, 2))
def random_forest(spark, sf):
    train, test = lines(spark, sf, cents())
    return scored(learning.random_forest(train, KEY), test)


@query("gradient_boosted_tree", boosted_sql(10, 5))
def gradient_boosted_tree(spark, sf):
    train, test = lines(spark, sf, cents())
    return scored(learning.gradient_boosted_tree(train), test)
