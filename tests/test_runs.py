from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gaugework.operators import runs
from gaugework.sources import lookups, reports
from helpers import frame, rows

DAY = dt.datetime(2024, 1, 1)


def test_specs_of_five_words(spark):
    lines = ["suite spark sort small 1", "suite spark sort small", "suite  spark\tsort small 2 ", "", "a b c d e f"]
    got = runs.parse_workload_spec(frame(spark, [(x,) for x in lines], "spec string")).drop("spec")
    assert rows(got) == [("suite", "spark", "sort", "small", "1"), ("suite", "spark", "sort", "small", "2")]


def test_workload_ids(spark):
    df = frame(spark, [("Sort.Spark",), ("regression",), ("a.b.c",), (None,)], "workload_id string")
    assert rows(runs.parse_workload_id(df).drop("workload_id")) == [("sort", "spark")]


def test_run_keys_of_six_and_seven_fields(spark):
    keys = ["4_c4.large_block-matrix-mult_spark1.5_small_1", "4_c4.large_i-0ab_sort_spark_huge_2", "x_c4.large_a_b_c_d", "bad_key"]
    got = runs.parse_run_key(frame(spark, [(k,) for k in keys], "run_key string")).drop("run_key")
    assert rows(got) == sorted([
        (4, "c4.large", None, "block-matrix-mult", "spark1.5", "small", "1"),
        (4, "c4.large", "i-0ab", "sort", "spark", "huge", "2"),
        (None, "c4.large", None, "a", "b", "c", "d"),
    ], key=repr)


def test_grid(spark):
    got = runs.workload_grid(frame(spark, [("a",), ("b",)], "app string"), ["s", "l"], [1])
    assert rows(got) == [("a", "l", 1), ("a", "s", 1), ("b", "l", 1), ("b", "s", 1)]


def test_category_of_an_unknown_workload(spark):
    categories = lookups.lookup_tables(spark)["categories"]
    df = frame(spark, [("sort",), ("nope",)], "workload string")
    assert rows(runs.workload_category(df, categories)) == [("nope", None), ("sort", "micro")]
    assert rows(runs.workload_category(df.where("workload = 'sort'"), categories, strict=True)) == [("sort", "micro")]
    with pytest.raises(Exception, match="unknown workload: nope"):
        runs.workload_category(df, categories, strict=True).collect()


def finished(spark):
    data = [
        ("sort", "spark", "small", True, DAY, DAY + dt.timedelta(seconds=90.25), "ScalaSort", DAY + dt.timedelta(seconds=80), 1000, 80.5, 12, 6),
        ("join", "spark", "small", False, DAY, DAY + dt.timedelta(seconds=90.25), "x", DAY, 5, 1.0, 5, 5),
        ("scan", "spark", "small", None, DAY, DAY, "x", DAY, 5, 1.0, 5, 5),
    ]
    schema = (
        "workload string, framework string, datasize string, completed boolean, started timestamp_ntz, ended timestamp_ntz, "
        "program string, finished timestamp_ntz, input_size bigint, elapsed_time double, throughput_cluster int, throughput_node int"
    )
    return runs.report_row(frame(spark, data, schema))


def test_report_rows_of_completed_and_failed_runs(spark):
    got = {r["workload"]: r for r in finished(spark).collect()}
    ok, bad = got["sort"], got["join"]
    assert (ok["program"], ok["timestamp"], ok["input_size"], ok["elapsed_time"]) == ("ScalaSort", "2024-01-01 00:01:20", 1000, 80.5)
    assert (bad["program"], bad["timestamp"], bad["input_size"], bad["elapsed_time"]) == ("", "2024-01-01 00:00:00", -1, 90.25)
    assert (bad["throughput_cluster"], bad["throughput_node"]) == (-1.0, -1.0)
    assert got["scan"]["completed"] is False and got["scan"]["elapsed_time"] == 0.0


def test_report_json_has_sorted_keys_and_mixed_measures(spark):
    objects = [json.loads(r["report"]) for r in runs.report_json(finished(spark)).collect()]
    assert all(list(o) == sorted(o) and len(o) == 10 for o in objects)
    by_name = {o["workload"]: o for o in objects}
    assert by_name["sort"]["elapsed_time"] == "80.5" and by_name["join"]["elapsed_time"] == 90.25
    assert by_name["join"]["input_size"] == -1


def test_reports_read_back_from_pretty_files_and_lines(spark, tmp_path):
    table = finished(spark)
    pretty = tmp_path / "pretty"
    pretty.mkdir()
    for i, r in enumerate(runs.report_json(table).collect()):
        (pretty / f"report{i}.json").write_text(json.dumps(json.loads(r["report"]), indent=4, sort_keys=True))
    reports.write_run_reports(table, str(tmp_path / "lines"))
    order = sorted(table.columns)
    expected = rows(table.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).select(order))
    assert rows(reports.read_run_reports(spark, str(pretty / "*.json")).select(order)) == expected
    assert rows(reports.read_run_reports(spark, str(tmp_path / "lines"), multi_line=False).select(order)) == expected


def test_report_knows_its_run_folder(spark, tmp_path):
    folder = tmp_path / "4_c4.large_sort_spark_small_1"
    folder.mkdir()
    (folder / "report.json").write_text(json.dumps({"workload": "sort", "completed": True}, indent=4))
    got = runs.parse_run_key(reports.read_run_reports(spark, str(tmp_path / "*" / "report.json"), run_key=True)).first()
    assert (got["run_key"], got["nodes"], got["app"], got["completed"]) == (folder.name, 4, "sort", True)


def test_unmeasured_reports(spark):
    done = frame(spark, [("kmeans", True, DAY, DAY + dt.timedelta(seconds=9.5))], "workload string, completed boolean, started timestamp_ntz, ended timestamp_ntz")
    extra = {c: F.lit(None).cast("string") for c in ("program", "framework", "datasize", "input_size", "elapsed_time", "throughput_cluster", "throughput_node")}
    table = runs.report_row(done.withColumns({**extra, "finished": F.col("ended")}), measured=False)
    report = json.loads(runs.report_json(table, measured=False).first()["report"])
    assert report == {
        "completed": True, "elapsed_time": 9.5, "input_size": -1, "program": "kmeans", "throughput_cluster": -1,
        "throughput_node": -1, "timestamp": "2024-01-01 00:00:00", "workload": "kmeans",
    }


@pytest.mark.parametrize("completed", [True, False])
def test_pretty_reports_keep_the_words_of_the_suite(spark, completed):
    schema = "workload string, framework string, datasize string, completed boolean, program string, timestamp string, input_size bigint, elapsed_time double, throughput_cluster double, throughput_node double, input_size_word string, throughput_cluster_word string"
    table = frame(spark, [("sort", "spark", "tiny", completed, 'a "b"', "2024-01-01 00:00:00", 94626, 9.5, 94626.0, -1.0, "94626", "94626")], schema)
    report = runs.report_json(table, pretty=True).first()["report"]
    fields = {"workload": "sort", "framework": "spark", "datasize": "tiny", "completed": completed, "program": 'a "b"', "timestamp": "2024-01-01 00:00:00"}
    fields |= (
        {"input_size": "94626", "elapsed_time": "9.5", "throughput_cluster": "94626", "throughput_node": "-1.0"}
        if completed
        else {"input_size": 94626, "elapsed_time": 9.5, "throughput_cluster": 94626, "throughput_node": -1}
    )
    assert report == json.dumps(fields, indent=4, sort_keys=True)


def test_suite_report_lines(spark, tmp_path):
    (tmp_path / "r").write_text("ScalaSort  2024-01-01 00:01:20   1000   80.5  12 6\n\nBad 2024-13-01 x y z\n")
    got = rows(reports.read_suite_report(spark, str(tmp_path / "r")))
    assert got == [("Bad", None, None, None, None, None), ("ScalaSort", DAY + dt.timedelta(seconds=80), 1000, 80.5, 12.0, 6.0)]


@pytest.mark.parametrize("parts", [1, 64])
def test_latest_report(spark, parts):
    df = frame(spark, [("a", 1, "x"), ("a", 3, "y"), ("a", 3, "w"), ("b", None, "z")], "k string, t int, v string").repartition(parts)
    assert rows(runs.latest_report(df, ["k"], "t", ["v"])) == [("a", 3, "y"), ("b", None, "z")]


def test_run_resources_in_both_modes(spark):
    data = [(1, 5, "c4.large", "n+1"), (2, 5, "c4.large", "n"), (3, 3, "r4.2xlarge", None), (4, 3, "x1.huge", "n")]
    table = runs.run_resources(frame(spark, data, "run int, nodes int, instance_type string, mode string"), lookups.lookup_tables(spark)["instances"])
    got = {r["run"]: r for r in table.collect()}
    assert {k: got[1][k] for k in ("workers", "memory_per_core", "overhead", "am_memory", "executor_num", "executor_memory", "parallelism", "driver_local_memory")} == {
        "workers": 4, "memory_per_core": 2048, "overhead": 512, "am_memory": 1536, "executor_num": 7,
        "executor_memory": 1024, "parallelism": 16, "driver_local_memory": 4096,
    }
    assert (got[2]["workers"], got[2]["driver_local_memory"]) == (5, 2048)
    assert (got[3]["workers"], got[3]["overhead"], got[3]["executor_memory"]) == (2, 1024, 8192 - 2048)
    assert got[4]["workers"] == 3 and got[4]["executor_num"] is None


def test_lookup_tables(spark):
    tables = lookups.lookup_tables(spark)
    assert {k: t.count() for k, t in tables.items()} == {
        "instances": 21, "prices": 18, "categories": 15, "parameters": 23, "sizes": 100, "deployments": 23,
    }


def test_parameters_are_overlaid_and_missing_sizes_fail():
    p = lookups.workload_parameters("word2vec", "huge", partitions=7)
    assert (p["vector-size"], p["num-words"], p["num-partitions"], p["random-seed"]) == (100, 100000, 7, 5)
    assert lookups.workload_parameters("spearman", "small")["num-rows"] == 40000  # below the warm-up, as published
    with pytest.raises(KeyError):
        lookups.size_parameters("als", "bigdata")


def test_a_folder_with_one_indented_object_for_each_run(spark, tmp_path):
    table = finished(spark).withColumn("key", F.concat(F.lit("007:a b/"), F.monotonically_increasing_id().cast("string")))
    reports.write_run_reports(table, str(tmp_path / "runs"), "key")
    files = sorted((tmp_path / "runs").glob("run_key=*/part-*"))
    assert len(files) == table.count()
    for file in files:
        text = file.read_text().rstrip("\n")
        assert text == json.dumps(json.loads(text), indent=4, sort_keys=True)
    back = reports.read_run_reports(spark, str(tmp_path / "runs"), run_key=True)
    assert sorted(r["run_key"] for r in back.collect()) == sorted(r["key"] for r in table.collect())
