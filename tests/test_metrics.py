from __future__ import annotations

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from gaugework.operators import metrics
from gaugework.sources import feeds
from gaugework.sources.metric_names import DISK_METRICS, GENERAL_METRICS, METRIC_COLUMNS, NETWORK_METRICS, PLAIN_COLUMNS
from gaugework.streaming.metric_feed import stream_metric_feed, stream_metric_table, stream_resample
from helpers import frame, rows


def at(second):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


def test_the_header_has_73_names_in_their_groups():
    assert len(METRIC_COLUMNS) == len(set(METRIC_COLUMNS)) == len(set(PLAIN_COLUMNS)) == 73
    groups = {}
    for name in METRIC_COLUMNS:
        groups[name.split(".")[0]] = groups.get(name.split(".")[0], 0) + 1
    assert groups == {
        "timestamp": 1, "cpu": 10, "task": 2, "intr": 1, "swap": 7, "paging": 9, "io": 5, "memory": 16, "load": 6,
        "disk": 8, "network": 8,
    }
    assert len(GENERAL_METRICS) == 56 and len(DISK_METRICS) == len(NETWORK_METRICS) == 8


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_resample_takes_the_first_sample_whole(spark, parts):
    data = [("a", at(7), 1.0, "x"), ("a", at(5), 2.0, "y"), ("a", at(4), 3.0, "z"), ("b", at(9), None, "w"), ("b", at(9.5), 4.0, "v")]
    df = frame(spark, data, "host string, ts timestamp_ntz, value double, mark string").repartition(parts)
    assert rows(metrics.metric_resample(df, 5)) == [
        ("a", at(0), 3.0, "z"), ("a", at(5), 2.0, "y"), ("b", at(5), None, "w"),
    ]


def feed(spark, kind, data):
    """``data`` holds (host, second, device, base); metric i gets base + i."""
    columns = feeds.feed_columns(kind)
    out = []
    for host, second, device, base in data:
        row = {"host": host, "interval": 5, "ts": at(second), "CPU": "-1", "INTR": "sum", "DEV": device, "IFACE": device}
        out.append(tuple(row.get(c, float(base + i)) for i, c in enumerate(columns)))
    return frame(spark, out, feeds.feed_schema(kind))


def test_metric_table_rolls_devices_up(spark):
    general = feed(spark, "general", [("h", 0, None, 0), ("h", 5, None, 0)])
    disk = feed(spark, "disk", [("h", 0, "sda", 100), ("h", 0, "sdb", 200)])
    network = feed(spark, "network", [("h", 0, "eth0", 1), ("h", 0, "lo", 2), ("h", 0, "eth1", 3)])
    table = metrics.metric_table(general, disk, network)
    assert table.columns == ["host", "ts", *PLAIN_COLUMNS[1:]]
    (row,) = table.collect()  # the sample without disks and networks has no partner
    assert row["disk_tps"] == 104 + 204 and row["disk_await"] == (109 + 209) / 2 and row["disk_pct_util"] == 211
    assert row["network_rxpck_per_s"] == (1 + 4) + (2 + 4) + (3 + 4) and row["network_pct_ifutil"] == 3 + 11
    assert metrics.metric_table(general, disk, network, rollup=False).count() == 2 * 3


def test_metric_table_file_has_the_fixed_header(spark, tmp_path):
    table = metrics.metric_table(*(feed(spark, k, [("h", 0, "d", 0)]) for k in ("general", "disk", "network")))
    path = str(tmp_path / "csv")
    feeds.write_metric_table(table, path)
    first = open(next(f for f in glob.glob(path + "/part*"))).readline().strip()
    assert first == ",".join(METRIC_COLUMNS)
    back = feeds.read_metric_table(spark, path)
    assert rows(back) == rows(table.drop("host"))
    store = str(tmp_path / "store")
    feeds.write_metric_store(table.withColumn("run_id", F.lit("r1")), store)
    assert spark.read.parquet(store).where("run_id = 'r1' AND host = 'h'").count() == 1


def test_rename_needs_the_right_width(spark):
    df = frame(spark, [(1, 2)], "a int, b int")
    assert metrics.metric_rename(df, ["cpu.%usr", "disk.tps"]).columns == ["cpu.%usr", "disk.tps"]
    with pytest.raises(ValueError):
        metrics.metric_rename(df, ["x"])


def test_groups_and_long_form_take_dotted_names(spark):
    df = frame(spark, [("h", 1.0, 2.0, 3.0)], "host string, `cpu.%usr` double, `disk.tps` double, `disk.await` double")
    assert metrics.metric_group(df, "disk.", ["host"]).columns == ["host", "disk.tps", "disk.await"]
    long = metrics.metric_long(df, ["host"], ["disk.", "cpu."]).select("host", "group", "metric", "value")
    assert rows(long) == [("h", "cpu.", "cpu.%usr", 1.0), ("h", "disk.", "disk.await", 3.0), ("h", "disk.", "disk.tps", 2.0)]


def test_prune_keeps_the_device(spark):
    assert "DEV" in metrics.metric_prune(feed(spark, "disk", [])).columns
    assert not {"CPU", "INTR", "interval"} & set(metrics.metric_prune(feed(spark, "general", [])).columns)


def test_node_numbers_follow_the_sorted_hosts(spark):
    df = frame(spark, [("n2",), ("n10",), ("n2",), ("n1",)], "host string")
    assert rows(metrics.with_node_number(df).select("host", "node_no").distinct()) == [("n1", 1), ("n10", 2), ("n2", 3)]


def test_union_matches_names(spark):
    a, b = frame(spark, [(1, 2)], "x int, y int"), frame(spark, [(3, 4)], "y int, z int")
    assert rows(metrics.run_metrics_union([a, b])) == [(1, 2, None), (None, 3, 4)]


FEED = """# hostname;interval;timestamp;DEV;tps;rd_sec/s;wr_sec/s;avgrq-sz;avgqu-sz;await;svctm;%util[...]
h1;5;2024-01-01 00:00:05;sda;1.5;0;0;0;0;0;0;9
# hostname;interval;timestamp;DEV;tps;rd_sec/s;wr_sec/s;avgrq-sz;avgqu-sz;await;svctm;%util[...]
h1;5;2024-01-01 00:00:10;sda;2.5;0;0;0;0;0;0;8
"""


def test_feed_with_a_repeated_header(spark, tmp_path):
    (tmp_path / "disk.csv").write_text(FEED)
    got = feeds.read_metric_feed(spark, str(tmp_path / "disk.csv"), "disk")
    assert rows(got.select("host", "ts", "DEV", "disk_tps", "disk_pct_util")) == [
        ("h1", at(10), "sda", 2.5, 8.0), ("h1", at(5), "sda", 1.5, 9.0),
    ]


def test_streamed_feed_resamples_like_the_batch(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    feed(spark, "disk", [("h", s, "sda", s) for s in range(0, 120, 2)]).select("*").transform(
        lambda d: feeds.write_metric_feed(d, str(tmp_path / "out"), "disk") or d
    )
    for i, part in enumerate(glob.glob(str(tmp_path / "out" / "part*"))):
        (folder / f"{i}.csv").write_text(open(part).read())
    stream = stream_resample(stream_metric_feed(spark, str(folder), "disk"), 10, "1 second", ["host", "DEV"])
    started = stream.writeStream.format("memory").queryName("resampled").outputMode("complete").start()
    try:
        started.processAllAvailable()
    finally:
        started.stop()
    batch = metrics.metric_resample(metrics.metric_prune(feeds.read_metric_feed(spark, str(folder), "disk")), 10, ["host", "DEV"])
    assert rows(spark.table("resampled")) == rows(batch) and batch.count() == 12


def test_buckets_are_final_once_the_feed_is_late_past_them(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()

    def arrive(name, samples):
        feeds.write_metric_feed(feed(spark, "disk", samples).coalesce(1), str(tmp_path / name), "disk")
        (part,) = glob.glob(str(tmp_path / name / "part*"))
        (folder / f"{name}.csv").write_text(open(part).read())

    stream = stream_resample(stream_metric_feed(spark, str(folder), "disk"), 10, "20 seconds", ["host", "DEV"])
    arrive("first", [("h", s, "sda", s) for s in range(2, 100, 2)])
    sink = stream.writeStream.format("memory").queryName("appended").outputMode("append")
    started = sink.option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        started.processAllAvailable()
        early = {r["ts"] for r in spark.table("appended").collect()}
        # the watermark is 78: buckets up to 70 have been given out, those after it are open
        assert max(early) == at(60) and len(early) == 7
        arrive("second", [("h", 1, "sda", 1), ("h", 91, "sda", 91), ("h", 200, "sda", 200)])
        started.processAllAvailable()
        state = started.lastProgress["stateOperators"][0]
    finally:
        started.stop()
    batch = metrics.metric_resample(
        metrics.metric_prune(feeds.read_metric_feed(spark, str(tmp_path / "first"), "disk")), 10, ["host", "DEV"]
    )
    # the row of second 1 came too late to change its bucket, the last bucket is still open, the others are those of the batch
    assert rows(spark.table("appended")) == rows(batch) and batch.count() == 10
    assert state["numRowsTotal"] == 1


def test_joined_stream_gives_the_batch_table_once_all_feeds_are_past(spark, tmp_path):
    kinds = ("general", "disk", "network")
    for kind in kinds:
        (tmp_path / kind).mkdir()

    def arrive(name, kind, samples):
        feeds.write_metric_feed(feed(spark, kind, samples).coalesce(1), str(tmp_path / name / kind), kind)
        (part,) = glob.glob(str(tmp_path / name / kind / "part*"))
        (tmp_path / kind / f"{name}.csv").write_text(open(part).read())

    devices = {"general": [""], "disk": ["sda", "sdb"], "network": ["eth0"]}
    for kind in kinds:
        arrive("first", kind, [(h, s, d, s + len(d)) for h in ("h", "k") for s in range(0, 60, 4) for d in devices[kind]])
    table = stream_metric_table(*[stream_metric_feed(spark, str(tmp_path / k), k) for k in kinds], seconds=10, late="10 seconds")
    sink = table.writeStream.format("memory").queryName("joined").outputMode("append")
    started = sink.option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        started.processAllAvailable()
        early = {r["ts"] for r in spark.table("joined").collect()}
        # the watermark is 46: the buckets up to 30 are final
        assert early == {at(s) for s in (0, 10, 20, 30)}
        # a late row in each feed, and one that closes what is open; the network feed stays behind
        for kind, last in (("general", 300), ("disk", 200), ("network", 100)):
            arrive("second", kind, [("h", 1, devices[kind][0], 7000), ("h", last, devices[kind][0], 1)])
        started.processAllAvailable()
        state = sum(o["numRowsTotal"] for o in started.lastProgress["stateOperators"])
    finally:
        started.stop()
    batch = [metrics.metric_prune(feeds.read_metric_feed(spark, str(tmp_path / "first" / k), k)) for k in kinds]
    names = [["host"], ["host", "DEV"], ["host", "IFACE"]]
    expected = metrics.metric_table(*[metrics.metric_resample(b, 10, n) for b, n in zip(batch, names)])
    assert rows(spark.table("joined")) == rows(expected) and expected.count() == 12
    # only the closing rows are still held
    assert state <= 3 + 1


def test_feed_keeps_the_order_of_samples_within_a_second(spark, tmp_path):
    columns = feeds.feed_columns("disk")
    metric = [c for c in columns if c not in ("host", "interval", "ts", "DEV")]
    times = ["2024-01-01 00:00:01.25", "2024-01-01 00:00:01.5", "2024-01-01 00:00:02"]
    data = frame(spark, [(t, float(v)) for t, v in zip(times, (9, 1, 5))], "t string, v double")
    out = data.select(
        F.lit("h").alias("host"), F.lit(5).alias("interval"), F.col("t").cast("timestamp_ntz").alias("ts"), F.lit("sda").alias("DEV"),
        *[F.col("v").alias(m) for m in metric],
    )
    feeds.write_metric_feed(out.select(*columns), str(tmp_path / "out"), "disk")
    back = feeds.read_metric_feed(spark, str(tmp_path / "out"), "disk")
    assert [r[0] for r in rows(back.select(F.col("ts").cast("string")))] == times
    first = metrics.metric_resample(metrics.metric_prune(back), 10, ["host", "DEV"])
    assert {r[metric[0]] for r in first.collect()} == {9.0}
