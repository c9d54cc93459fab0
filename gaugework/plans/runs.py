"""Run-catalogue operators. Each order stands for one run; its keys and amounts give the fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.functions.times import clock_text
from gaugework.operators import runs
from gaugework.plans.registry import query
from gaugework.sources.lookups import (
    INSTANCE_MEMORY,
    INSTANCE_PRICE,
    WORKLOAD_CATEGORY,
    WORKLOAD_SIZES,
    instance_cores,
    lookup_tables,
)
from gaugework.sources.tables import load

INSTANCES = list(INSTANCE_PRICE)
APPS = list(WORKLOAD_CATEGORY) + ["kmeans-old"]  # the last one is in no category
FRAMEWORKS = ["hadoop", "spark", "spark1.5"]
SIZES = ["small", "medium", "large", "huge", "bigdata"]


def pick(values: list[str], key: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(key, F.lit(len(values))).cast("int"))


def pick_sql(values: list[str], key: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST(1 + {key} % {len(values)} AS BIGINT)]"


def run_table(spark: SparkSession, sf: str) -> DataFrame:
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    return load(spark, sf, "orders").select(
        order.alias("run"),
        (F.pmod(customer, F.lit(45)) + 4).cast("int").alias("nodes"),
        pick(INSTANCES, order).alias("instance_type"),
        pick(APPS, order + customer).alias("workload"),
        pick(FRAMEWORKS, customer).alias("framework"),
        pick(SIZES, order).alias("datasize"),
        (F.pmod(order, F.lit(3)) + 1).cast("string").alias("run_id"),
        F.when(F.pmod(customer, F.lit(3)) == 0, "n").when(F.pmod(customer, F.lit(3)) == 1, "n+1").alias("mode"),
        (F.col("o_orderstatus") != "F").alias("completed"),
        F.col("o_orderdate").alias("started"),
        (F.col("o_totalprice") * 100).cast("bigint").alias("input_size"),
    )


RUN_SQL = f"""
(SELECT o_orderkey AS run, CAST(o_custkey % 45 + 4 AS INTEGER) AS nodes,
        {pick_sql(INSTANCES, "o_orderkey")} AS instance_type,
        {pick_sql(APPS, "(o_orderkey + o_custkey)")} AS workload,
        {pick_sql(FRAMEWORKS, "o_custkey")} AS framework,
        {pick_sql(SIZES, "o_orderkey")} AS datasize,
        CAST(o_orderkey % 3 + 1 AS VARCHAR) AS run_id,
        CASE o_custkey % 3 WHEN 0 THEN 'n' WHEN 1 THEN 'n+1' END AS mode,
        o_orderstatus <> 'F' AS completed, o_orderdate AS started,
        CAST(trunc(o_totalprice * 100) AS BIGINT) AS input_size
 FROM orders)
"""


STAMP_SQL = "strftime(started, '%Y-%m-%d %H:%M:%S')"


def spec_text() -> Column:
    """Some specs lack the id, some have runs of spaces."""
    gap = F.when(F.pmod("run", F.lit(5)) == 0, "  ").otherwise(" ")
    last = F.when(F.pmod("run", F.lit(7)) != 0, F.concat(F.lit(" "), F.col("run_id"))).otherwise("")
    head = F.concat(F.lit("suite "), F.col("framework"), gap, F.col("workload"), F.lit(" "), F.col("datasize"))
    return F.concat(head, last)


SPEC_SQL = """
'suite ' || framework || CASE WHEN run % 5 = 0 THEN '  ' ELSE ' ' END || workload || ' ' || datasize
|| CASE WHEN run % 7 <> 0 THEN ' ' || run_id ELSE '' END
"""


@query(
    "parse_workload_spec",
    rf"""
SELECT run, w[1] AS benchmark, w[2] AS framework, w[3] AS app, w[4] AS datasize, w[5] AS run_id
FROM (SELECT run, regexp_split_to_array({SPEC_SQL}, '\s+') AS w FROM {RUN_SQL}) WHERE len(w) = 5
""",
)
def parse_workload_spec(spark, sf):
    specs = run_table(spark, sf).select("run", spec_text().alias("spec"))
    return runs.parse_workload_spec(specs).drop("spec")


@query(
    "parse_workload_id",
    f"""
SELECT run, p[1] AS app, p[2] AS framework
FROM (SELECT run, string_split(lower(upper(workload) || '.' || framework), '.') AS p FROM {RUN_SQL}) WHERE len(p) = 2
""",
)
def parse_workload_id(spark, sf):
    ids = run_table(spark, sf).select("run", F.concat_ws(".", F.upper("workload"), "framework").alias("workload_id"))
    return runs.parse_workload_id(ids).drop("workload_id")


@query(
    "workload_grid",
    f"""
SELECT run, workload, s.datasize, r.run_id
FROM {RUN_SQL.replace(" AS datasize", " AS d").replace(" AS run_id", " AS i")}
CROSS JOIN (VALUES ('huge'), ('bigdata')) s(datasize) CROSS JOIN (VALUES (1), (2), (3)) r(run_id)
""",
)
def workload_grid(spark, sf):
    return runs.workload_grid(run_table(spark, sf).select("run", "workload"), ["huge", "bigdata"], [1, 2, 3])


CATEGORY_SQL = ", ".join(f"('{w}', '{c}')" for w, c in WORKLOAD_CATEGORY.items())


@query(
    "workload_category",
    f"""
SELECT run, workload, category FROM {RUN_SQL} LEFT JOIN (VALUES {CATEGORY_SQL}) c(workload, category) USING (workload)
""",
)
def workload_category(spark, sf):
    table = run_table(spark, sf).select("run", "workload")
    return runs.workload_category(table, lookup_tables(spark)["categories"])


@query(
    "parse_run_key",
    f"""
SELECT run, CAST(p[1] AS INTEGER) AS nodes, p[2] AS instance_type, CASE WHEN len(p) = 7 THEN p[3] END AS instance_id,
       p[len(p) - 3] AS app, p[len(p) - 2] AS framework, p[len(p) - 1] AS datasize, p[len(p)] AS run_id
FROM (SELECT run, string_split(nodes || '_' || instance_type || '_' || CASE WHEN run % 4 = 0 THEN 'i-' || run || '_' ELSE '' END
             || workload || '_' || framework || '_' || datasize || '_' || run_id, '_') AS p FROM {RUN_SQL})
""",
)
def parse_run_key(spark, sf):
    older = F.when(F.pmod("run", F.lit(4)) == 0, F.concat(F.lit("i-"), F.col("run")))
    key = F.concat_ws("_", "nodes", "instance_type", older, "workload", "framework", "datasize", "run_id")
    keys = run_table(spark, sf).select("run", key.alias("run_key"))
    return runs.parse_run_key(keys).drop("run_key")


def finished_runs(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.pmod("run", F.lit(7200)) + F.lit(0.5)
    return (
        run_table(spark, sf).select(
            "run",
            "workload",
            "framework",
            "datasize",
            "completed",
            F.col("workload").alias("program"),
            "started",
            (F.col("started") + F.make_dt_interval(secs=seconds)).alias("ended"),
            (F.col("started") + F.make_dt_interval(secs=F.lit(30))).alias("finished"),
            "input_size",
            (F.pmod("run", F.lit(1000)) / 8).alias("elapsed_time"),
            F.pmod("input_size", F.lit(100000)).alias("throughput_cluster"),
            F.pmod("input_size", F.lit(1000)).alias("throughput_node"),
        )
    )


def reports(spark: SparkSession, sf: str) -> DataFrame:
    return runs.report_row(finished_runs(spark, sf))


REPORT_SQL = f"""
SELECT run, workload, framework, datasize, completed, CASE WHEN completed THEN workload ELSE '' END AS program,
       strftime(started + CASE WHEN completed THEN INTERVAL 30 SECOND ELSE INTERVAL 0 SECOND END,
                '%Y-%m-%d %H:%M:%S') AS "timestamp",
       CASE WHEN completed THEN input_size ELSE -1 END AS input_size,
       CASE WHEN completed THEN (run % 1000) / 8.0 ELSE run % 7200 + 0.5 END::DOUBLE AS elapsed_time,
       CASE WHEN completed THEN input_size % 100000 ELSE -1 END::DOUBLE AS throughput_cluster,
       CASE WHEN completed THEN input_size % 1000 ELSE -1 END::DOUBLE AS throughput_node
FROM {RUN_SQL}
"""


@query("report_row", REPORT_SQL)
def report_row(spark, sf):
    return reports(spark, sf)


@query(
    "report_row_unmeasured",
    f"""
SELECT run, workload, framework, datasize, completed, workload AS program,
       strftime(started, '%Y-%m-%d %H:%M:%S') AS "timestamp", CAST(-1 AS BIGINT) AS input_size,
       CAST(run % 7200 + 0.5 AS DOUBLE) AS elapsed_time, -1.0::DOUBLE AS throughput_cluster, -1.0::DOUBLE AS throughput_node
FROM {RUN_SQL}
""",
)
def report_row_unmeasured(spark, sf):
    return runs.report_row(finished_runs(spark, sf), measured=False)


@query(
    "write_run_reports",
    f"""
SELECT run, CASE WHEN completed
  THEN to_json({{completed: completed, datasize: datasize, elapsed_time: elapsed_time::VARCHAR, framework: framework,
       input_size: input_size::VARCHAR, program: program, throughput_cluster: throughput_cluster::VARCHAR,
       throughput_node: throughput_node::VARCHAR, timestamp: "timestamp", workload: workload}})::VARCHAR
  ELSE to_json({{completed: completed, datasize: datasize, elapsed_time: elapsed_time, framework: framework,
       input_size: input_size, program: program, throughput_cluster: throughput_cluster::BIGINT,
       throughput_node: throughput_node::BIGINT, timestamp: "timestamp", workload: workload}})::VARCHAR END AS report
FROM ({REPORT_SQL})
""",
)
def write_run_reports(spark, sf):
    return runs.report_json(reports(spark, sf)).select("run", "report")


@query(
    "latest_report",
    """
SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderkey, o_totalprice
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
""",
)
def latest_report(spark, sf):
    lines = load(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    last = runs.latest_report(lines, ["o_custkey"], "o_orderdate", ["o_orderkey"])
    return last.withColumn("o_orderdate", clock_text(F.col("o_orderdate")))


RESOURCE_COLUMNS = [
    "run", "instance_type", "workers", "cores", "memory_mb", "memory_per_core", "overhead", "am_memory",
    "executor_num", "executor_memory", "parallelism", "driver_local_memory",
]
INSTANCE_SQL = ", ".join(f"('{i}', {mb}, {instance_cores(i)})" for i, mb in INSTANCE_MEMORY.items())


@query(
    "run_resources",
    f"""
WITH sized AS (
  SELECT *, CASE WHEN coalesce(mode, 'n+1') = 'n+1' THEN nodes - 1 ELSE nodes END AS workers,
         CAST(trunc(memory_mb / cores) AS INTEGER) AS memory_per_core,
         CASE WHEN trunc(memory_mb / cores) <= 4096 THEN 512 ELSE 1024 END AS overhead
  FROM {RUN_SQL} JOIN (VALUES {INSTANCE_SQL}) i(instance_type, memory_mb, cores) USING (instance_type))
SELECT run, instance_type, workers, cores, memory_mb, memory_per_core, overhead,
       memory_per_core - overhead AS am_memory, workers * cores - 1 AS executor_num,
       memory_per_core - 2 * overhead AS executor_memory, cores * workers * 2 AS parallelism,
       CASE WHEN coalesce(mode, 'n+1') = 'n+1' THEN memory_mb ELSE memory_per_core END AS driver_local_memory
FROM sized
""",
)
def run_resources(spark, sf):
    return runs.run_resources(run_table(spark, sf), lookup_tables(spark)["instances"]).select(*RESOURCE_COLUMNS)


PRICE_SQL = ", ".join(f"('{i}', {p})" for i, p in INSTANCE_PRICE.items())
SIZE_SQL = ", ".join(
    f"('{w}', '{size}', {', '.join(str(v) for v in values[:1])})"
    for w, (_, sizes) in WORKLOAD_SIZES.items()
    for size, values in sizes.items()
)


@query(
    "lookup_tables",
    f"""
SELECT run, workload, instance_type, datasize, memory_mb, CAST(price AS DOUBLE) AS price, category, CAST(first_size AS VARCHAR) AS first_size
FROM {RUN_SQL}
LEFT JOIN (VALUES {INSTANCE_SQL}) i(instance_type, memory_mb, cores) USING (instance_type)
LEFT JOIN (VALUES {PRICE_SQL}) p(instance_type, price) USING (instance_type)
LEFT JOIN (VALUES {CATEGORY_SQL}) c(workload, category) USING (workload)
LEFT JOIN (VALUES {SIZE_SQL}) s(workload, datasize, first_size) USING (workload, datasize)
""",
)
def lookup_query(spark, sf):
    tables = lookup_tables(spark)
    first_name = {w: names[0] for w, (names, _) in WORKLOAD_SIZES.items()}
    names = F.create_map(*[F.lit(x) for pair in first_name.items() for x in pair])
    sizes = tables["sizes"].select(
        "workload",
        F.col("size").alias("datasize"),
        F.try_element_at("params", F.try_element_at(names, "workload")).alias("first_size"),
    )
    table = run_table(spark, sf).select("run", "workload", "instance_type", "datasize")
    return (
        table.join(F.broadcast(tables["instances"].drop("cores")), "instance_type", "left")
        .join(F.broadcast(tables["prices"]), "instance_type", "left")
        .join(F.broadcast(tables["categories"]), "workload", "left")
        .join(F.broadcast(sizes), ["workload", "datasize"], "left")
    )
