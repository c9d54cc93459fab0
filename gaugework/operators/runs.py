"""Operators on the catalogue of runs: specs, keys, reports and sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.text import words
from gaugework.functions.times import clock_text, seconds_between

SPEC_FIELDS = ["benchmark", "framework", "app", "datasize", "run_id"]
REPORT_FIELDS = [
    "completed", "datasize", "elapsed_time", "framework", "input_size", "program", "throughput_cluster",
    "throughput_node", "timestamp", "workload",
]
OVERHEAD_LIMIT_MB = 4096


def parse_workload_spec(df: DataFrame, column: str = "spec") -> DataFrame:
    """Keep lines of exactly five words and split them; any run of white space separates."""
    fields = words(F.col(column))
    return df.where(F.size(fields) == len(SPEC_FIELDS)).withColumns(
        {name: F.get(fields, F.lit(i)) for i, name in enumerate(SPEC_FIELDS)}
    )


def parse_workload_id(df: DataFrame, column: str = "workload_id") -> DataFrame:
    """Split ``app.framework`` in lower case; ids of another shape are dropped."""
    parts = F.split(F.lower(column), r"\.")
    return df.where(F.size(parts) == 2).withColumns({"app": F.get(parts, F.lit(0)), "framework": F.get(parts, F.lit(1))})


def workload_grid(apps: DataFrame, sizes: list[str], run_ids: list[int]) -> DataFrame:
    """Every app at every size and run id. The lists are parameters, so each row is expanded in place."""
    return apps.withColumn("datasize", F.explode(F.array(*[F.lit(s) for s in sizes]))).withColumn(
        "run_id", F.explode(F.array(*[F.lit(r) for r in run_ids]))
    )


def workload_category(df: DataFrame, categories: DataFrame, strict: bool = False) -> DataFrame:
    """Look the category up; an unknown workload gets null, or stops the job if ``strict``.

    ``categories`` is the fixed lookup table of 15 rows, hence the hint.
    """
    joined = df.join(categories, "workload", "left")
    if not strict:
        return joined
    unknown = F.raise_error(F.concat(F.lit("unknown workload: "), F.col("workload"))).cast("string")
    return joined.withColumn("category", F.coalesce("category", unknown))


def parse_run_key(df: DataFrame, column: str = "run_key") -> DataFrame:
    """Split run keys of six fields, or of seven with an instance id third; other keys are dropped."""
    parts = F.split(column, "_")
    older = F.size(parts) == 7
    shift = older.cast("int")
    return df.where(F.size(parts).isin(6, 7)).select(
        "*",
        F.get(parts, F.lit(0)).try_cast("int").alias("nodes"),
        F.get(parts, F.lit(1)).alias("instance_type"),
        F.when(older, F.get(parts, F.lit(2))).alias("instance_id"),
        F.get(parts, shift + 2).alias("app"),
        F.get(parts, shift + 3).alias("framework"),
        F.get(parts, shift + 4).alias("datasize"),
        F.get(parts, shift + 5).alias("run_id"),
    )


def wall_seconds(started: Column, ended: Column) -> Column:
    """Seconds between two time stamps, with fractions."""
    return seconds_between(started, ended).cast("double")


def report_row(df: DataFrame, measured: bool = True) -> DataFrame:
    """Report fields of a run: those of the suite on success, sentinels and the wall time on failure.

    Needs ``workload, completed, started, ended, program, finished, input_size, elapsed_time,
    throughput_cluster, throughput_node``; a null ``completed`` counts as failed. A suite that writes no
    measures of its own (``measured=False``) gets sentinels and the wall time for every run, under the
    name of the workload.
    """
    completed = F.coalesce("completed", F.lit(False))
    done = completed if measured else F.lit(False)
    wall = wall_seconds(F.col("started"), F.col("ended"))
    failed = F.lit(-1).cast("double")
    return df.withColumns(
        {
            "completed": completed,
            "program": F.when(done, F.col("program")).otherwise("") if measured else F.col("workload"),
            "timestamp": clock_text(F.when(done, F.col("finished")).otherwise(F.col("started"))),
            "input_size": F.when(done, F.col("input_size")).otherwise(F.lit(-1)).cast("bigint"),
            "elapsed_time": F.when(done, F.col("elapsed_time")).otherwise(wall).cast("double"),
            "throughput_cluster": F.when(done, F.col("throughput_cluster").cast("double")).otherwise(failed),
            "throughput_node": F.when(done, F.col("throughput_node").cast("double")).otherwise(failed),
        }
    ).drop("started", "ended", "finished")


def report_json(df: DataFrame, pretty: bool = False, measured: bool = True) -> DataFrame:
    """One JSON object per run with sorted keys, in one line or ``pretty``, a line per field with four spaces. The four
    measures are the suite's words as they were written, where a run of a measured suite completed and the table has them
    in ``<measure>_word``; otherwise numbers, with ``-1`` for what was not measured."""
    measures = {"input_size", "elapsed_time", "throughput_cluster", "throughput_node"}

    def word(c: str) -> Column:
        if c not in measures:
            return F.col(c)
        return F.coalesce(*[F.col(n) for n in (f"{c}_word",) if n in df.columns], F.col(c).cast("string"))

    def number(c: str) -> Column:
        return F.col(c).cast("bigint") if c.startswith("throughput") else F.col(c)

    def text(fields: list[Column]) -> Column:
        if not pretty:
            return F.to_json(F.struct(*fields))
        lines = [
            F.regexp_replace(F.to_json(F.struct(field)), r'(?s)^\{("[^"]+"):(.*)\}$', r"    $1: $2") for field in fields
        ]
        present = F.filter(F.array(*lines), lambda x: x != "{}")
        return F.concat(F.lit("{\n"), F.array_join(present, ",\n"), F.lit("\n}"))

    as_word = text([word(c).alias(c) for c in REPORT_FIELDS])
    as_number = text([number(c).alias(c) for c in REPORT_FIELDS])
    return df.withColumn("report", F.when(F.col("completed") & F.lit(measured), as_word).otherwise(as_number))


def latest_report(df: DataFrame, keys: list[str], time: str, tiebreak: list[str] | None = None) -> DataFrame:
    """The last report of each run. Each map task lets one line of a run pass, so a run with very many lines is no
    hot spot."""
    rest = [c for c in df.columns if c not in keys]
    order = [F.desc(c) for c in [time, *[c for c in (tiebreak or rest) if c != time]]]
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", last).where("_place = 1").drop("_place").select(*keys, *rest)


def run_resources(runs: DataFrame, instances: DataFrame) -> DataFrame:
    """Workers, cores, memory and executor settings per run.

    ``runs`` has ``nodes, instance_type, mode``; ``instances`` is the fixed lookup of instance types
    with ``memory_mb`` and ``cores``; a type it does not know keeps its row with nulls. The overhead is taken off the executor memory twice.
    """
    one_master = F.coalesce("mode", F.lit("n+1")) == "n+1"
    per_core = (F.col("memory_mb") / F.col("cores")).cast("int")
    sized = runs.join(instances, "instance_type", "left").withColumns(
        {
            "workers": F.when(one_master, F.col("nodes") - 1).otherwise(F.col("nodes")),
            "memory_per_core": per_core,
            "overhead": F.when(per_core <= OVERHEAD_LIMIT_MB, F.lit(512)).otherwise(F.lit(1024)),
            "driver_local_memory": F.when(one_master, F.col("memory_mb")).otherwise(per_core),
        }
    )
    return sized.withColumns(
        {
            "am_memory": F.col("memory_per_core") - F.col("overhead"),
            "executor_num": F.col("workers") * F.col("cores") - 1,
            "executor_memory": F.col("memory_per_core") - 2 * F.col("overhead"),
            "parallelism": F.col("cores") * F.col("workers") * 2,
        }
    )
