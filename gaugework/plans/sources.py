"""Sources and sinks: each query writes a whole table in the foreign form to the shared folder and reads
it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.functions.times import clock_text
from gaugework.lineage import scratch_path
from gaugework.operators import metrics, runs
from gaugework.plans.metrics import WIDE_SQL, shown, wide
from gaugework.plans.pricing import HISTORY_SQL, price_history
from gaugework.plans.registry import query
from gaugework.plans.runs import REPORT_SQL, RUN_SQL, STAMP_SQL, reports, run_table
from gaugework.sources import feeds, prices
from gaugework.sources import reports as report_files
from gaugework.sources.metric_names import DISK_METRICS, PLAIN_COLUMNS, plain_name
from gaugework.sources.tables import load

DISK = [plain_name(m) for m in DISK_METRICS]


@query(
    "read_metric_feed",
    f"""
SELECT CAST(user_id AS VARCHAR) AS host, 5 AS "interval", strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type AS "DEV",
       {", ".join(f"CAST(value + {i} AS DOUBLE) AS {name}" for i, name in enumerate(DISK))}
FROM events
""",
)
def read_metric_feed(spark, sf):
    feed = load(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("host"),
        F.lit(5).alias("interval"),
        "ts",
        F.col("event_type").alias("DEV"),
        *[(F.col("value") + i).alias(name) for i, name in enumerate(DISK)],
    )
    path = scratch_path(spark, "feed")
    feeds.write_metric_feed(feed, path, "disk")
    return shown(feeds.read_metric_feed(spark, path, "disk"))


@query("write_metric_table", WIDE_SQL)
def write_metric_table(spark, sf):
    table = metrics.metric_rename(wide(spark, sf), ["ts", *PLAIN_COLUMNS[1:]])
    path = scratch_path(spark, "metrics")
    feeds.write_metric_table(table.withColumn("ts", F.col("ts").cast("timestamp_ntz")), path)
    back = feeds.read_metric_table(spark, path)
    return back.withColumn("timestamp", clock_text(F.col("timestamp")))


@query(
    "read_suite_report",
    f"""
SELECT workload AS program, {STAMP_SQL} AS "timestamp", input_size, CAST(run % 7200 + 0.5 AS DOUBLE) AS elapsed_time,
       CASE WHEN run % 10 <> 0 THEN CAST(input_size % 100000 AS DOUBLE) END AS throughput_cluster,
       CAST(input_size % 1000 AS DOUBLE) AS throughput_node
FROM {RUN_SQL}
""",
)
def read_suite_report(spark, sf):
    """Fields are padded with spaces; every tenth throughput is not a number."""
    throughput = F.when(F.pmod("run", F.lit(10)) == 0, "n/a").otherwise(F.pmod("input_size", F.lit(100000)).cast("string"))
    line = F.concat_ws(
        "    ",
        F.col("workload"),
        clock_text(F.col("started")),
        F.col("input_size"),
        F.pmod("run", F.lit(7200)) + F.lit(0.5),
        throughput,
        F.pmod("input_size", F.lit(1000)),
    )
    path = scratch_path(spark, "suite")
    run_table(spark, sf).select(line).write.text(path)
    back = report_files.read_suite_report(spark, path)
    return back.withColumn("timestamp", clock_text(F.col("timestamp")))


@query("read_run_reports", f"SELECT * EXCLUDE (run) FROM ({REPORT_SQL})")
def read_run_reports(spark, sf):
    path = scratch_path(spark, "reports")
    report_files.write_run_reports(reports(spark, sf), path)
    back = report_files.read_run_reports(spark, path, multi_line=False)
    return back.withColumn("timestamp", clock_text(F.col("timestamp")))


@query(
    "run_report_folders",
    f"""
SELECT * EXCLUDE (run), workload || '.' || datasize || '.' || framework AS run_key
FROM ({REPORT_SQL}) QUALIFY row_number() OVER (PARTITION BY workload, datasize, framework ORDER BY "timestamp" DESC, run DESC) = 1
""",
)
def run_report_folders(spark, sf):
    """The last report of each spec, indented in its own folder, read back with the folder's name."""
    spec = ["workload", "datasize", "framework"]
    last = runs.latest_report(reports(spark, sf), spec, "timestamp", ["run"])
    path = scratch_path(spark, "report-folders")
    report_files.write_run_reports(last.withColumn("key", F.concat_ws(".", *spec)), path, "key")
    back = report_files.read_run_reports(spark, path, run_key=True)
    return back.withColumn("timestamp", clock_text(F.col("timestamp")))


@query(
    "read_price_history",
    f"SELECT instance_type, az, CAST(sum(price) AS DOUBLE) AS total, count(*) AS n FROM {HISTORY_SQL} GROUP BY 1, 2",
)
def read_price_history(spark, sf):
    path = scratch_path(spark, "prices")
    price_history(spark, sf).write.json(path)
    back = prices.read_price_history(spark, path).where(F.col("product") == "Linux/UNIX")
    return back.groupBy("instance_type", "az").agg(
        F.sum("price").cast("double").alias("total"), F.count(F.lit(1)).alias("n")
    )


@query(
    "read_text_lines",
    r"""
SELECT line, count(*) AS n
FROM (SELECT regexp_replace(unnest(string_split(text, chr(10))), '\s+$', '') AS line FROM documents) GROUP BY 1
""",
)
def read_text_lines(spark, sf):
    path = scratch_path(spark, "lines")
    load(spark, sf, "documents").select("text").write.text(path)
    lines = feeds.read_text_lines(spark, path).withColumnRenamed("value", "line")
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
