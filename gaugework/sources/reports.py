"""Suite report lines and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.functions.text import words
from gaugework.operators.runs import report_json

MEASURES = {"input_size": "bigint", "elapsed_time": "double", "throughput_cluster": "double", "throughput_node": "double"}
REPORT_SCHEMA = (
    "workload string, framework string, datasize string, completed boolean, program string, timestamp string, "
    "input_size string, elapsed_time string, throughput_cluster string, throughput_node string"
)


def parse_suite_report(lines: DataFrame, column: str = "value") -> DataFrame:
    """Seven typed fields of each line: program, time stamp (two words), sizes, time and throughput.

    Text that is not a number gives null, and so do words that are missing.
    """
    part = words(F.col(column))
    number = {name: F.get(part, F.lit(3 + i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(MEASURES.items())}
    stamp = F.concat_ws(" ", F.get(part, F.lit(1)), F.get(part, F.lit(2)))
    return lines.where(F.size(part) > 0).select(
        F.get(part, F.lit(0)).alias("program"), stamp.try_cast("timestamp_ntz").alias("timestamp"), *number.values()
    )


def read_suite_report(spark: SparkSession, path: str) -> DataFrame:
    return parse_suite_report(spark.read.text(path))


def read_run_reports(spark: SparkSession, path: str, multi_line: bool = True, run_key: bool = False) -> DataFrame:
    """JSON reports, one pretty-printed object per file, or one per line without ``multi_line``.

    The measures are text in some reports and numbers in others; all are read as text and cast.
    With ``run_key`` the name of the folder that holds the file is added, for ``parse_run_key``.
    """
    schema = REPORT_SCHEMA + ", run_key string" * run_key
    raw = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    if run_key:
        # a folder written by write_run_reports gives its key itself, and unescaped
        folder = F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1)
        raw = raw.withColumn("run_key", F.coalesce("run_key", folder))
    return raw.withColumns(
        {
            "timestamp": F.col("timestamp").try_cast("timestamp_ntz"),
            **{name: F.col(name).try_cast(kind) for name, kind in MEASURES.items()},
        }
    )


def write_run_reports(df: DataFrame, path: str, run_key: str | None = None) -> None:
    """One JSON object per run and line; with the column ``run_key`` one indented object per run in a folder of its own.

    A run has one row (take its ``latest_report`` first). Tasks write to attempt folders that are moved when they commit, so a
    task that is repeated leaves no second file.
    """
    if run_key is None:
        report_json(df).select("report").write.text(path)
    else:
        report_json(df, pretty=True).select(F.col(run_key).alias("run_key"), "report").write.partitionBy("run_key").text(path)
